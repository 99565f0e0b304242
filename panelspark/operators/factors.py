"""Factor formulas over a dense long panel: one plan for any number of formulas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.plans.formula import CROSS, FOLD, SERIES, Printer, compile_formulas, final, library, stages


WINDOWS = SERIES | CROSS | FOLD


def smooth(x: np.ndarray, n: int, m: int) -> np.ndarray:
    """Y = (m X + (n - m) Y') / n, seeded with X; a missing value ends the run, and the next one seeds anew."""
    out, state = np.full(len(x), np.nan), np.nan
    for k, v in enumerate(x.tolist()):
        state = v if state != state or v != v else (m * v + (n - m) * state) / n
        out[k] = state
    return out


def rolling_residual(y: np.ndarray, xs: np.ndarray, n: int) -> np.ndarray:
    """Last residual of a regression with intercept over each complete window of n rows."""
    out = np.full(len(y), np.nan)
    good = np.isfinite(y) & np.isfinite(xs).all(1)
    for k in range(n - 1, len(y)):
        rows = slice(k - n + 1, k + 1)
        if good[rows].all():
            design = np.column_stack([np.ones(n), xs[rows]])
            beta, *_ = np.linalg.lstsq(design, y[rows], rcond=None)
            out[k] = y[k] - design[-1] @ beta
    return out


def filtered_beta(y: np.ndarray, x: np.ndarray, chosen: np.ndarray, n: int) -> np.ndarray:
    """Slope over the latest n chosen rows, held until the next chosen row."""
    out, value = np.full(len(y), np.nan), np.nan
    at: list[int] = []
    for k in range(len(y)):
        if chosen[k]:
            at.append(k)
            if len(at) >= n:
                u, v = x[at[-n:]], y[at[-n:]]
                spread = ((u - u.mean()) ** 2).sum()
                value = ((u - u.mean()) * (v - v.mean())).sum() / spread if spread > 0 else np.nan
        out[k] = value
    return out


def _fold_pass(df: DataFrame, jobs: list[tuple[str, str, list[str], tuple[int, ...]]]) -> DataFrame:
    """Ordered recurrences of all jobs (column, kind, inputs, numbers) in one pass over each symbol."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name, *_ in jobs)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        new = {}
        for name, kind, cols, k in jobs:
            x = [pdf[c].to_numpy(dtype=float) for c in cols]
            if kind == "smacn":
                new[name] = smooth(x[0], *k)
            elif kind == "mfresid":
                new[name] = rolling_residual(x[0], np.column_stack(x[1:]), *k)
            else:
                new[name] = filtered_beta(x[0], x[1], x[2] > 0, *k)
        return pdf.assign(**new)

    return df.groupBy("symbol").applyInPandas(run, schema)


def compute(panel: DataFrame, texts: dict[str, str], report: bool = False) -> DataFrame:
    """``symbol, date`` and a column for each formula (name: text) over a dense panel with the fields that they read; ``report``: to a float's digits."""
    g, roots = compile_formulas(texts)
    need, uses = stages(g, list(roots.values()))
    p = Printer(g, "spark")
    doubles = {f.name for f in panel.schema if f.dataType == T.DoubleType()}
    df = panel.select(*(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in doubles else F.col(c) for c in panel.columns))
    for s in range(1, max(need.values(), default=0) + 1):
        now = [i for i, k in need.items() if k == s and (g.nodes[i][0] in SERIES or g.nodes[i][0] in CROSS)]
        folds = [i for i, k in need.items() if k == s and g.nodes[i][0] in FOLD]
        if folds:
            feeds, jobs = {}, []
            for i in folds:
                op, *rest = g.nodes[i]
                args = [a for a in rest if isinstance(a, int)][: 1 if op == "smacn" else None]
                cols = []
                for a in args:
                    feeds[a] = f"i{a}"
                    cols.append(f"i{a}")
                jobs.append((f"n{i}", op, cols, tuple(a[1] for a in rest if isinstance(a, tuple) and a[0] == "n")))
            df = df.selectExpr("*", *(f"CAST({p.text(a if g.nodes[a][0] not in ('lt', 'and', 'or') else g.numeric(a))} AS DOUBLE) AS {c}" for a, c in feeds.items()))
            df = _fold_pass(df, jobs).drop(*feeds.values())
        if now:
            df = df.selectExpr("*", *(f"{p.window(i)} AS n{i}" for i in now))
        p.columns |= {i: f"n{i}" for i in now + folds}
        still = _columns_of(g, [a for i, k in need.items() if k > s and g.nodes[i][0] in WINDOWS for a in g.inputs(i)] + list(roots.values()))
        keep = [c for c in df.columns if not (c[0] == "n" and c[1:].isdigit()) or int(c[1:]) in still]
        df = df.select(*keep)
    return df.selectExpr("symbol", "date", *(f"{final(p.text(i)) if report else p.text(i)} AS {name}" for name, i in roots.items()))


def _columns_of(g, nodes: list[int]) -> set[int]:
    """The windows that these nodes read, directly or through elementwise parts."""
    out, todo, seen = set(), list(nodes), set()
    while todo:
        i = todo.pop()
        if i in seen:
            continue
        seen.add(i)
        if g.nodes[i][0] in WINDOWS:
            out.add(i)
        else:
            todo += g.inputs(i)
    return out


def formulas(family: str, *numbers: int) -> dict[str, str]:
    """Texts of formulas of the family of 101 (``alpha``) or 191 (``gtja``) by number."""
    texts = library("formulas_101" if family == "alpha" else "formulas_191")
    return {f"{family}_{n:03d}": texts[f"{family}_{n:03d}"] for n in numbers}
