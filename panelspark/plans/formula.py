"""Factor formulas as data: a small notation, read into a shared graph of operators and turned into staged relational plans.

A formula is one expression. ``lag5``, ``tsum20``, ``corr10``... carry their window in the name; a published window that
is no whole number is cut to one (``tsum3.92795`` is ``tsum3``), 1 at least. Quantities that several formulas use have names of their
own in ``shared.txt``. Three kinds of choice differ in what they make of missing values: ``where(c, x, y)`` takes a
comparison with a missing operand as false; ``when(c, x, y)`` is missing where an operand of c is; ``choose(c, x, y)`` is
missing where an operand of c, x or y is. Counts and conditional sums of a window skip what ``when`` and ``choose`` miss.
``keep(x, c)`` is x where c holds, else null.

The graph is hash-consed over all formulas compiled together, so that a shared window is computed once. Nodes are
grouped into stages: all windows whose inputs are ready go into one projection (Catalyst then shares one exchange and sort
for each partitioning), ordered recurrences go into one grouped pass, and elementwise parts are written in line.
"""

from __future__ import annotations

import ast
import functools
import re
from pathlib import Path

ELEMENT = {"neg", "add", "sub", "mul", "div", "pow", "sdiv", "spow", "log", "sqrt", "abs", "sign", "max2", "min2", "pos", "nullif0", "where", "keep", "lt", "le", "gt", "ge", "eq", "ne", "and", "or", "not", "has", "num", "const", "nullif", "power"}
BOOLEAN = {"lt", "le", "gt", "ge", "eq", "ne", "and", "or", "not", "has"}
#: Windows over a symbol's dates; the number in a name is how many rows they take.
SERIES = {"lag", "tsum", "tmean", "tmin", "tmax", "sd", "trank", "argmax", "argmin", "wlin", "wma", "corr", "cov", "tsprod", "hday", "lday", "seqbeta", "regbeta", "regresi", "tcount", "carry", "nullseg", "lastvalid", "covp", "filtsum"}
CROSS = {"cs", "l1", "neutral"}
FOLD = {"smacn", "mfresid", "fbeta"}


class UnresolvedFormula(ValueError):
    """The published text of this formula has no consistent reading."""


class Graph:
    """Operators of all formulas compiled together; equal subexpressions are one node."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.index: dict[tuple, int] = {}

    def add(self, op: str, *args) -> int:
        key = (op, *args)
        if key not in self.index:
            self.index[key] = len(self.nodes)
            self.nodes.append(key)
        return self.index[key]

    def inputs(self, i: int) -> list[int]:
        op, *args = self.nodes[i]
        return [] if op in ("field", "const") else [a for a in args if isinstance(a, int)]

    def numeric(self, i: int) -> int:
        return self.add("num", i) if self.nodes[i][0] in BOOLEAN or self.nodes[i][0] == "keep" and self.nodes[self.nodes[i][1]][0] in BOOLEAN else i


@functools.cache
def library(name: str) -> dict[str, str]:
    """Formula texts by name of ``formulas_101``, ``formulas_191`` or ``shared``."""
    lines = (Path(__file__).parent / f"{name}.txt").read_text(encoding="utf-8").splitlines()
    return dict(tuple(x.strip() for x in line.split(" | ", 1)) for line in lines if line and not line.startswith("#"))


@functools.cache
def _quantities() -> dict[str, tuple[list[str], str]]:
    """Parameters and text of each shared quantity."""
    out = {}
    for head, text in library("shared").items():
        name, _, inside = head.rstrip(")").partition("(")
        out[name] = ([p.strip() for p in inside.split(",") if p.strip()], text)
    return out


class Reader:
    """Reads formula texts into a graph."""

    def __init__(self, graph: Graph):
        self.g = graph

    def formula(self, text: str, names: dict | None = None):
        text = re.sub(r"\b([a-z]+)(\d+)\.\d+\(", r"\1\2(", text.replace("^", "**"))
        return self._walk(ast.parse(text, mode="eval").body, names or {})

    def _shared(self, name: str, args: list):
        """A shared quantity: numbers also stand for ``{parameter}`` in its text."""
        parameters, text = _quantities()[name]
        for p, a in zip(parameters, args):
            if self.g.nodes[a][0] == "const":
                text = text.replace("{" + p + "}", str(int(self.g.nodes[a][1])))
        return self.formula(text, dict(zip(parameters, args)))

    def _present(self, *parts: int) -> int | None:
        """Whether all operands of these conditions' comparisons, and all other parts, are there."""
        out: list[int] = []

        def visit(i: int) -> None:
            op, *rest = self.g.nodes[i]
            if op in BOOLEAN and op != "has":
                for a in rest:
                    visit(a)
            elif op not in ("const", "has") and i not in out:
                out.append(i)

        for p in parts:
            visit(p)
        return functools.reduce(lambda a, b: self.g.add("and", a, b), (self.g.add("has", i) for i in out)) if out else None

    def _kept(self, x: int, *parts: int) -> int:
        present = self._present(*parts)
        return x if present is None else self.g.add("keep", x, present)

    def _const(self, value: float) -> int:
        return self.g.add("const", float(value))

    def _walk(self, e: ast.expr, names: dict):
        g = self.g
        if isinstance(e, ast.Constant):
            return e.value if isinstance(e.value, str) else self._const(e.value)
        if isinstance(e, ast.Name):
            return names[e.id] if e.id in names else g.add("field", e.id)
        if isinstance(e, ast.Tuple):
            return tuple(self._walk(x, names) for x in e.elts)
        if isinstance(e, ast.UnaryOp):
            x = self._walk(e.operand, names)
            return self._const(-g.nodes[x][1]) if g.nodes[x][0] == "const" else g.add("neg", g.numeric(x))
        if isinstance(e, ast.BinOp):
            op = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "power"}[type(e.op)]
            return g.add(op, *(g.numeric(self._walk(x, names)) for x in (e.left, e.right)))
        if isinstance(e, ast.Compare):
            op = {ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Eq: "eq", ast.NotEq: "ne"}[type(e.ops[0])]
            return g.add(op, *(g.numeric(self._walk(x, names)) for x in (e.left, e.comparators[0])))
        if isinstance(e, ast.BoolOp):
            parts = [self._walk(x, names) for x in e.values]
            return functools.reduce(lambda a, b: g.add("and" if isinstance(e.op, ast.And) else "or", a, b), parts)
        if isinstance(e, ast.Call):
            return self._call(e, names)
        raise ValueError(f"not part of the notation: {ast.dump(e)}")

    def _call(self, e: ast.Call, names: dict):
        g, name = self.g, e.func.id
        args = [self._walk(x, names) for x in e.args]
        more = {k.arg: self._walk(k.value, names) for k in e.keywords}
        if name == "unresolved":
            raise UnresolvedFormula("no consistent reading")
        if name in _quantities():
            return self._shared(name, args)
        if name == "when":
            return self._kept(g.add("where", *args), args[0])
        if name == "choose":
            return self._kept(g.add("where", *args), *args)
        if name == "smacn":
            x = g.numeric(args[0])
            return g.add("smacn", x, *(("n", int(g.nodes[a][1])) for a in args[1:]), g.add("nullseg", x))
        if name in ("where", "keep", "has", "nullif"):
            return g.add(name, *args)
        if name == "neutral":
            return g.add("neutral", g.numeric(args[0]), ("by", args[1]))
        m = re.fullmatch(r"([a-z]+[a-z1]*?)(\d+)?", name)
        base, n = (name, 0) if name in ELEMENT or name in ("l1", "adv") else (m[1], max(1, int(m[2])) if m[2] else 0)
        if base == "tcount":
            one = g.add("num", args[0])
            x = g.add("keep", one, more["valid"]) if "valid" in more else self._kept(one, args[0])
            return g.add("tsum", x, ("n", n))
        if base == "tsumif":
            part = g.numeric(args[0])
            x = self._kept(g.add("where", args[2], part, self._const(0)), args[2], part)
            return g.add("tsum", x, ("n", int(g.nodes[args[1]][1])))
        if base == "diff":
            return g.add("sub", g.numeric(args[0]), g.add("lag", g.numeric(args[0]), ("n", n)))
        if base in ELEMENT or base in CROSS:
            return g.add(base, *(g.numeric(a) for a in args))
        return g.add(base, *(a if g.nodes[a][0] in BOOLEAN and base == "fbeta" else g.numeric(a) for a in args), ("n", n))


def compile_formulas(texts: dict[str, str]) -> tuple[Graph, dict[str, int]]:
    """A graph and the node of each formula's result."""
    g = Graph()
    out = {}
    for name, text in texts.items():
        text = re.sub(r"\badv(\d+)\b", r"tmean\1(amount)", text)
        out[name] = g.numeric(Reader(g).formula(text))
    return g, out


def stages(g: Graph, roots: list[int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each node that the roots need, the stage after which it is known, and how often it is used."""
    need: dict[int, int] = {}
    uses: dict[int, int] = {}

    def visit(i: int) -> int:
        uses[i] = uses.get(i, 0) + 1
        if i not in need:
            op = g.nodes[i][0]
            below = max((visit(a) for a in g.inputs(i)), default=0)
            need[i] = below + (op in SERIES or op in CROSS or op in FOLD)
        return need[i]

    for r in roots:
        visit(r)
    return need, uses


class Printer:
    """SQL text of nodes in one dialect: ``spark`` or ``duckdb``."""

    def __init__(self, graph: Graph, dialect: str):
        self.g, self.spark, self.columns = graph, dialect == "spark", {}

    def text(self, i: int) -> str:
        """An expression over columns that exist already."""
        if i in self.columns:
            return self.columns[i]
        op, *args = self.g.nodes[i]
        if op == "field":
            return args[0]
        if op == "const":
            return f"CAST({args[0]!r} AS DOUBLE)"
        a = [self.text(x) for x in args]
        sign = {"add": "+", "sub": "-", "mul": "*", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}.get(op)
        if op in ("add", "sub", "mul"):
            return f"({a[0]} {sign} {a[1]})"
        if sign:
            return f"coalesce({a[0]} {sign} {a[1]}, {'false' if op != 'ne' else 'true'})"
        match op:
            case "neg":
                return f"(-{a[0]})"
            case "div":
                return f"({a[0]} / nullif({a[1]}, 0))"
            case "sdiv":
                return f"(CASE WHEN abs({a[1]}) >= 1e-12 THEN {a[0]} / {a[1]} END)"
            case "power" | "pow":
                return self.finite(f"power({a[0]}, {a[1]})", f"{a[0]} >= 0 OR {a[1]} = floor({a[1]})", f"{a[0]} <> 0 OR {a[1]} >= 0")
            case "spow":
                return self.finite(f"(sign({a[0]}) * power(abs({a[0]}), {a[1]}))", f"{a[0]} <> 0 OR {a[1]} >= 0")
            case "log":
                return f"(CASE WHEN {a[0]} > 0 THEN {settled(f'ln({a[0]})')} END)"
            case "sqrt":
                return f"(CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END)"
            case "abs" | "sign":
                return f"CAST({op}({a[0]}) AS DOUBLE)"
            case "max2" | "min2":
                return f"(CASE WHEN {a[0]} IS NOT NULL AND {a[1]} IS NOT NULL THEN {'greatest' if op == 'max2' else 'least'}({a[0]}, {a[1]}) END)"
            case "pos":
                return f"(CASE WHEN {a[0]} > 0 THEN {a[0]} WHEN {a[0]} IS NOT NULL THEN CAST(0 AS DOUBLE) END)"
            case "nullif0":
                return f"nullif({a[0]}, CAST(0 AS DOUBLE))"
            case "nullif":
                return f"(CASE WHEN NOT {a[1]} THEN {a[0]} END)"
            case "where":
                return f"(CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2]} END)"
            case "keep":
                return f"(CASE WHEN {a[1]} THEN {a[0]} END)"
            case "and" | "or":
                return f"({a[0]} {op.upper()} {a[1]})"
            case "not":
                return f"(NOT {a[0]})"
            case "has":
                return f"({a[0]} IS NOT NULL)"
            case "num":
                return f"(CASE WHEN {a[0]} THEN CAST(1 AS DOUBLE) WHEN NOT {a[0]} THEN CAST(0 AS DOUBLE) END)"
        raise ValueError(f"{op} is no elementwise operator")

    def finite(self, x: str, *when: str) -> str:
        guard = " AND ".join(f"({w})" for w in when)
        bound = f"abs({x}) < CAST('Infinity' AS DOUBLE)" if self.spark else f"isfinite({x})"
        return f"(CASE WHEN {guard} THEN CASE WHEN {bound} THEN {x} END END)"

    # ---- windows

    def window(self, i: int) -> str:
        """The expression of a window node over columns of earlier stages."""
        op, *rest = self.g.nodes[i]
        x = [self.text(a) for a in rest if isinstance(a, int)]
        n = next((a[1] for a in rest if isinstance(a, tuple) and a[0] == "n"), 0)
        by = "PARTITION BY symbol ORDER BY date"
        w = f"OVER ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        full = lambda agg, v=x[0]: f"CASE WHEN count({v}) {w} = {n} THEN {agg} END"
        match op:
            case "lag":
                return f"lag({x[0]}, {n}) OVER ({by})"
            case "tsum" | "tmean" | "tmin" | "tmax":
                value = f"{ {'tsum': 'sum', 'tmean': 'avg', 'tmin': 'min', 'tmax': 'max'}[op] }({x[0]}) {w}"
                return full(settled(value) if op in ("tsum", "tmean") else value)
            case "sd":
                return full(settled(f"stddev_samp({x[0]}) {w}")) if n > 1 else "CAST(NULL AS DOUBLE)"
            case "corr" | "cov" | "regbeta" | "regresi":
                u, v = (f"CASE WHEN {x[1 - k]} IS NOT NULL THEN {x[k]} END" for k in range(2))
                if op == "cov":
                    return full(settled(f"covar_samp({u}, {v}) {w}"), u)
                if op in ("regbeta", "regresi"):
                    beta = f"(CASE WHEN max({v}) {w} > min({v}) {w} THEN covar_pop({u}, {v}) {w} / var_pop({v}) {w} END)"
                    return full(beta if op == "regbeta" else f"({u} - avg({u}) {w} - {beta} * ({v} - avg({v}) {w}))", u)
                flat = f"max({u}) {w} = min({u}) {w} OR max({v}) {w} = min({v}) {w}"
                r = f"covar_pop({u}, {v}) {w} / nullif(stddev_pop({u}) {w} * stddev_pop({v}) {w}, 0)"
                if n == 2:  # two points lie on a line
                    r = f"CAST(sign(covar_pop({u}, {v}) {w}) AS DOUBLE)"
                return full(f"CASE WHEN {flat} THEN CAST(0 AS DOUBLE) ELSE greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {settled(r)})) END", u)
            case "trank" | "argmax" | "argmin" | "wlin" | "wma" | "tsprod" | "hday" | "lday" | "seqbeta":
                value = self.listed(op, n, x[0], w)
                return full(settled(value) if op in ("wlin", "wma", "seqbeta") else value)
            case "nullseg":
                return f"sum(CASE WHEN {x[0]} IS NULL THEN 1 ELSE 0 END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            case "carry":
                return f"exp(sum(CASE WHEN {x[0]} > 0 THEN ln(1 + {x[0]}) ELSE CAST(0 AS DOUBLE) END) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
            case "cs":
                v = x[0]
                return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {v} IS NULL ORDER BY {v}) + (count(1) OVER (PARTITION BY date, {v}) - 1) / CAST(2 AS DOUBLE)) / count({v}) OVER (PARTITION BY date) END"
            case "l1":
                return f"{x[0]} / nullif(sum(abs({x[0]})) OVER (PARTITION BY date), 0)"
            case "neutral":
                group = rest[1][1]
                return f"CASE WHEN {group} IS NOT NULL THEN {x[0]} - avg({x[0]}) OVER (PARTITION BY date, {group}) END"
            case "smacn":
                steps, m = rest[1][1], rest[2][1]
                seg = self.text(rest[3])
                if self.spark:
                    raise ValueError("recurrences run as a grouped pass")
                return f"CASE WHEN {x[0]} IS NOT NULL THEN list_reduce(list({x[0]}) FILTER (WHERE {x[0]} IS NOT NULL) OVER (PARTITION BY symbol, {seg} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda acc, v: ({m} * v + ({steps} - {m}) * acc) / {steps}) END"
        raise ValueError(f"{op} can't be written as SQL")

    def listed(self, op: str, n: int, x: str, w: str) -> str:
        a = f"{'collect_list' if self.spark else 'list'}({x}) {w}"
        if op in ("argmax", "argmin"):
            return f"CAST({'array' if self.spark else 'list'}_position({a}, {op[3:]}({x}) {w}) AS DOUBLE)"
        if op in ("hday", "lday"):
            f = "max" if op == "hday" else "min"
            return f"CAST({'array' if self.spark else 'list'}_position({'reverse' if self.spark else 'list_reverse'}({a}), {f}({x}) {w}) - 1 AS DOUBLE)"
        if op == "tsprod":
            return f"aggregate({a}, CAST(1 AS DOUBLE), (p, v) -> p * v)" if self.spark else f"list_reduce({a}, lambda p, v: p * v)"
        if op == "trank":
            if self.spark:
                return f"(size(filter({a}, v -> v < {x})) + (size(filter({a}, v -> v = {x})) + 1) / CAST(2 AS DOUBLE)) / {n}"
            return f"(len(list_filter({a}, lambda v: v < {x})) + (len(list_filter({a}, lambda v: v = {x})) + 1) / CAST(2 AS DOUBLE)) / {n}"
        if op == "wlin":
            weight, total = "i", n * (n + 1) / 2
        elif op == "wma":
            weight, total = f"power(CAST(0.9 AS DOUBLE), {n} - i)", sum(0.9**k for k in range(n))
        else:  # the slope against 1..n, a weighted sum
            weight, total = f"(12 * i - 6 * {n + 1})", n * (n * n - 1)
        if self.spark:
            return f"aggregate(transform({a}, (v, j) -> v * {weight.replace('i', '(j + 1)', 1) if op != 'wma' else weight.replace('- i', '- (j + 1)')}), CAST(0 AS DOUBLE), (p, v) -> p + v) / CAST({total!r} AS DOUBLE)"
        return f"list_reduce(list_transform({a}, lambda v, i: v * {weight}), lambda p, v: p + v) / CAST({total!r} AS DOUBLE)"


def settled(x: str) -> str:
    """A window's sum without the last digits, which depend on the order of addition and would break ties of ranks."""
    return f"round({x}, 12)"


def final(x: str) -> str:
    """A factor's value as reported: no digits beyond what a float holds, and at most 1e37 either way."""
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(CAST(round(greatest(CAST(-1e37 AS DOUBLE), least(CAST(1e37 AS DOUBLE), {x})), 9) AS FLOAT) AS DOUBLE) END"


def duckdb_query(texts: dict[str, str], panel_sql: str) -> str:
    """One statement that computes the formulas over the panel that ``panel_sql`` selects."""
    g, roots = compile_formulas(texts)
    need, uses = stages(g, list(roots.values()))
    p = Printer(g, "duckdb")
    parts = [f"s0 AS ({panel_sql})"]
    for s in range(1, max(need.values(), default=0) + 1):
        now = [i for i, k in need.items() if k == s and (g.nodes[i][0] in SERIES or g.nodes[i][0] in CROSS or g.nodes[i][0] in FOLD)]
        parts.append(f"s{s} AS (SELECT *, {', '.join(f'{p.window(i)} AS n{i}' for i in now)} FROM s{s - 1})" if now else f"s{s} AS (SELECT * FROM s{s - 1})")
        p.columns |= {i: f"n{i}" for i in now}
    last = len(parts) - 1
    return f"WITH {', '.join(parts)} SELECT symbol, date, {', '.join(f'{final(p.text(i))} AS {name}' for name, i in roots.items())} FROM s{last}"
