"""Ordered per-symbol recurrences, the selectors built on them, walk-forward regression and the portfolio simulators.

A symbol's history is one group: its length is bounded by the calendar. The simulators carry one cash account, so a scenario
is one group by nature; scenarios (here: holding periods) run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.trades import BARS_SQL, research_panel, weekly_bars


def recursive_mean(x: np.ndarray, alpha: float, seed: float | None = None) -> np.ndarray:
    """y = alpha x + (1 - alpha) y', begun with the first value or with ``seed`` before it."""
    out, state = np.empty(len(x)), seed
    for k, v in enumerate(x.tolist()):
        state = v if state is None else alpha * v + (1 - alpha) * state
        out[k] = state
    return out


def rci(x: np.ndarray, n: int) -> np.ndarray:
    """Rank correlation of time and value over n bars, in percent, ties by average rank."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        rank = pd.DataFrame(w).rank(axis=1).to_numpy()
        out[n - 1 :] = 100 * (1 - 6 * ((rank - np.arange(1, n + 1)) ** 2).sum(1) / (n * (n * n - 1)))
    return out


def brick_height(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 4, m: tuple[int, int, int] = (4, 6, 6), threshold: float = 4.0, shifts: tuple[float, float] = (90.0, 100.0)) -> tuple[np.ndarray, np.ndarray]:
    """Change and level of the brick chart: a smoothed gap of the close from both ends of its n-bar range, above a threshold."""
    top, floor = pd.Series(high).rolling(n, min_periods=1).max().to_numpy(), pd.Series(low).rolling(n, min_periods=1).min().to_numpy()
    span = np.where(top == floor, 0.01, top - floor)
    upper = recursive_mean((top - close) / span * 100 - shifts[0], 1 / m[0])
    lower = recursive_mean(recursive_mean((close - floor) / span * 100, 1 / m[1]), 1 / m[2])
    gap = lower - upper  # both sides carry the second shift, which cancels
    level = np.where(gap > threshold, gap - threshold, 0.0)
    return np.diff(level, prepend=level[:1]), level


_INDICATORS = "k double, d double, j double, dif double, dea double, hist double, zxdq double, brick double, brick_level double, rci9 double, rci26 double, rci52 double"


def indicators(bars: DataFrame) -> DataFrame:
    """``bars`` with KDJ, MACD, the fast ZX line, brick chart and RCI of each symbol, over its observed bars."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("date", kind="stable").reset_index(drop=True)
        high, low, close = (p[c].to_numpy(float) for c in ("high", "low", "close"))
        lo, hi = p["low"].rolling(9, min_periods=1).min().to_numpy(), p["high"].rolling(9, min_periods=1).max().to_numpy()
        rsv = (close - lo) / (hi - lo + 1e-9) * 100
        rsv[:1] = 50.0  # K and D of the first bar are 50
        k = recursive_mean(rsv, 1 / 3, 50.0)
        d = recursive_mean(k, 1 / 3, 50.0)
        late = np.arange(len(p))
        dif = np.where(late >= 25, recursive_mean(close, 2 / 13) - recursive_mean(close, 2 / 27), np.nan)
        dea = np.full(len(p), np.nan)
        if len(p) > 25:
            dea[25:] = recursive_mean(dif[25:], 0.2)
            dea[: 25 + 8] = np.nan
        brick, level = brick_height(high, low, close)
        return p.assign(k=k, d=d, j=3 * k - 2 * d, dif=dif, dea=dea, hist=2 * (dif - dea), zxdq=recursive_mean(recursive_mean(close, 2 / 11), 2 / 11), brick=brick, brick_level=level, rci9=rci(close, 9), rci26=rci(close, 26), rci52=rci(close, 52))

    return bars.groupBy("symbol").applyInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema) + ", " + _INDICATORS)


def _by():
    return Window.partitionBy("symbol").orderBy("date")


def _mean(c: str, n: int):
    w = _by().rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(w) == n, F.avg(c).over(w))


def _lag(c, n: int = 1):
    return F.lag(c, n).over(_by())


def _sure(c):
    return F.coalesce(c, F.lit(False))


def zx_long(periods: tuple[int, ...] = (14, 28, 57, 114)):
    """The slow ZX line: the mean of the closes' moving averages over complete windows."""
    return sum((_mean("close", n) for n in periods[1:]), _mean("close", periods[0])) / len(periods)


def weekly_bull(bars: DataFrame, periods: tuple[int, int, int] = (20, 60, 120)) -> DataFrame:
    """``symbol, date, bull``: whether the weekly closes' moving averages over ``periods`` weeks descend from the shortest to
    the longest, as of the last week (by ISO) whose last bar is not later; false before that is known."""
    last = F.coalesce(F.date_trunc("week", F.lead("date").over(_by())) > F.date_trunc("week", "date"), F.lit(True))
    ends = bars.select("symbol", "date", "close", last.alias("last")).where("last and close is not null")
    short, mid, long_ = (_mean("close", n) for n in periods)
    flags = ends.select("symbol", F.col("date").alias("d"), _sure((short > mid) & (mid > long_)).alias("flag"))
    held = bars.select("symbol", "date").join(flags.withColumnRenamed("d", "date"), ["symbol", "date"], "left")
    return held.select("symbol", "date", _sure(F.last("flag", True).over(_by().rowsBetween(Window.unboundedPreceding, 0))).alias("bull"))


def green_runs(bricks: DataFrame) -> DataFrame:
    """``symbol, date, run``: how many bars with a negative brick stand in a row right before each bar."""
    i = F.row_number().over(_by())
    x = bricks.select("symbol", "date", i.alias("i"), F.when(F.coalesce(F.col("brick") < 0, F.lit(False)), F.lit(0)).otherwise(i).alias("other"))
    before = F.max("other").over(_by().rowsBetween(Window.unboundedPreceding, -1))
    return x.select("symbol", "date", (F.col("i") - 1 - F.coalesce(before, F.lit(0))).cast("long").alias("run"))


#: Parameters of the rule selectors; None switches a filter off.
RULES = {
    "j_threshold": -5.0, "j_quantile": 0.1, "b1_zx": (10, 50, 200, 300), "b1_weeks": (10, 20, 30), "max_volume_days": 20,
    "brick_return": 0.05, "brick_growth": 1.0, "brick_greens": 1, "brick_zx": (14, 28, 57, 114), "brick_zxdq_ratio": 1.0, "brick_weeks": (20, 60, 120),
}


def selectors(bars: DataFrame, **rules) -> DataFrame:
    """The rule selectors' picks for every bar, each a conjunction of complete conditions: b1, brick, mbdsr (and the bar that
    confirms it), macd_obv. ``rules`` replaces some of RULES. Missing values meet no condition."""
    r = RULES | rules
    x = indicators(bars)
    step = F.when(_lag("close").isNull(), F.lit(0.0)).otherwise(F.signum(F.col("close") - _lag("close")) * F.col("volume"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - _lag("close")), F.abs(F.col("low") - _lag("close")))
    x = x.withColumns({"step": step, "tr": true_range, "ma20": _mean("close", 20), "ma60": _mean("close", 60), "vol20": _mean("volume", 20), "prev_brick": _lag("brick"), "prev_close": _lag("close"), "prev_rci9": _lag("rci9"), "prev_rci26": _lag("rci26"), "i": F.row_number().over(_by())})
    x = x.withColumns({"obv": F.sum("step").over(_by().rowsBetween(Window.unboundedPreceding, 0)), "atr14": _mean("tr", 14), "b1_long": zx_long(r["b1_zx"]), "brick_long": zx_long(r["brick_zx"]), "j_low": F.percentile("j", F.lit(r["j_quantile"])).over(_by().rowsBetween(Window.unboundedPreceding, 0)), "strong_day": F.max_by(F.col("close") >= F.col("open"), F.struct("volume", -F.col("i"))).over(_by().rowsBetween(1 - r["max_volume_days"], 0))})
    x = x.withColumns({"obv_ma": _mean("obv", 20), "obv_low": F.when(F.count("obv").over(_by().rowsBetween(-19, 0)) == 20, F.min("obv").over(_by().rowsBetween(-19, 0))), "high10": F.when(F.count("high").over(_by().rowsBetween(-9, 0)) == 10, F.max("high").over(_by().rowsBetween(-9, 0)))})
    x = x.join(green_runs(x).withColumnRenamed("run", "greens"), ["symbol", "date"])
    for name in ("b1_weeks", "brick_weeks"):
        x = x.join(weekly_bull(bars, r[name]).withColumnRenamed("bull", name), ["symbol", "date"]) if r[name] else x.withColumn(name, F.lit(True))
    c = F.col
    b1 = _sure((c("j") < r["j_threshold"]) | (c("j") <= c("j_low"))) & _sure((c("close") > c("b1_long")) & (c("zxdq") > c("b1_long"))) & c("b1_weeks") & _sure(c("strong_day"))
    brick = _sure(c("close") / c("prev_close") - 1 < r["brick_return"]) & _sure((c("brick") > 0) & (c("prev_brick") < 0) & (c("brick") >= r["brick_growth"] * F.abs("prev_brick"))) & (c("greens") >= r["brick_greens"]) & c("brick_weeks")
    if r["brick_zxdq_ratio"] is not None:
        brick = brick & _sure((c("zxdq") > 0) & (c("close") < c("zxdq") * r["brick_zxdq_ratio"]))
    brick = brick & _sure(c("zxdq") > c("brick_long"))
    trend = (c("ma60") > _lag("ma60", 5)) & (c("close") > c("ma60") * 0.98) & (c("rci26") > 0) & (c("rci52") > 0)
    near = _sure(F.abs(c("close") - c("ma20")) / c("ma20") < 0.03) | _sure(F.abs(c("close") - c("ma60")) / c("ma60") < 0.04)
    mbdsr = _sure(trend) & _sure((c("prev_rci9") < -80) & (c("rci9") > c("prev_rci9"))) & near & _sure(c("volume") < c("vol20") * 1.2) & _sure(c("obv") > c("obv_low")) & _sure(c("high10") - c("close") < 2 * c("atr14")) & _sure((c("close") > c("open")) & (c("close") > c("prev_close")))
    cross = _sure((_lag("rci9") <= _lag("rci26")) & (c("rci9") > c("rci26")))
    golden = _sure((_lag("dif") <= _lag("dea")) & (c("dif") > c("dea")) & (c("dif") > 0) & (c("dea") > 0))
    up = _sure((c("obv") > c("obv_ma")) & (c("obv_ma") > _lag("obv_ma", 3)))
    x = x.withColumns({"is_b1": b1, "is_brick": brick, "is_mbdsr": mbdsr, "is_cross": cross, "is_golden": golden, "is_up": up})
    confirmed = _sure(_lag("is_mbdsr")) & _sure(c("close") > _lag("high"))
    return x.select("symbol", "date", c("is_b1").alias("b1"), c("is_brick").alias("brick"), c("is_mbdsr").alias("mbdsr"), confirmed.alias("mbdsr_confirmed"), c("is_cross").alias("rci_cross"), c("is_golden").alias("macd_cross"), c("is_up").alias("obv_uptrend"), (c("is_cross") & c("is_golden") & c("is_up")).alias("macd_obv"))


# ---------------------------------------------------------------- simulation

LOT, CASH, MOST, BUY, SELL = 10, 1_000_000.0, 5, 0.0003, 0.0013


#: Largest daily change by the first digits of a symbol's code; other symbols have DAILY_LIMIT.
BOARD_LIMITS, DAILY_LIMIT = {"3": 0.2, "68": 0.2, "4": 0.3, "8": 0.3}, 0.1


def daily_limit(symbol: str) -> float:
    return next((v for k, v in BOARD_LIMITS.items() if symbol.startswith(k)), DAILY_LIMIT)


def account(prices: pd.DataFrame, picks: pd.DataFrame, hold: int, limit: Callable[[str], float] | None = None, position: float = 1 / MOST) -> pd.DataFrame:
    """Daily equity of one cash account: sells of due positions first, in symbol order, then buys of the day before's picks in
    rank order, whole lots, each at most ``position`` of the equity. No price or no volume, no trade; with ``limit`` no buy of
    what opens at its upper limit against the last close and no sale of what opens at its lower one (to a tenth of a percent).
    What can't be sold stays due. What is bought today isn't sold today."""
    prices = prices if "volume" in prices else prices.assign(volume=1.0)
    table = {d: dict(zip(g["symbol"], zip(g["open"], g["close"], g["volume"]))) for d, g in prices.groupby("date", sort=True)}
    wanted = {d: g.sort_values("pos")["symbol"].tolist() for d, g in picks.groupby("date")}
    dates = sorted(table)
    cash, held, last, rows = CASH, {}, {}, []

    def opens(s: str, now: dict, side: int) -> float | None:
        if s not in now or now[s][0] != now[s][0] or not now[s][2] > 0:
            return None
        moved = now[s][0] / last[s] - 1 if s in last else 0.0
        return None if limit and side * moved >= limit(s) - 0.001 else now[s][0]

    for t, day in enumerate(dates):
        now = table[day]
        bought = sold = blocked = 0
        for s in sorted(held):
            if t - held[s][1] >= max(hold, 1):
                if (price := opens(s, now, -1)) is None:
                    blocked += 1
                else:
                    cash += held.pop(s)[0] * price * (1 - SELL)
                    sold += 1
        for s in wanted.get(dates[t - 1], []) if t else []:
            if s in held or len(held) >= MOST:
                continue
            if (price := opens(s, now, 1)) is None:
                blocked += 1
                continue
            equity = cash + sum(n * last.get(k, now.get(k, (0, 0))[0]) for k, (n, _) in held.items())
            price *= 1 + BUY
            lots = int(min(cash, equity * position) / price / LOT)
            if lots > 0:
                held[s] = (lots * LOT, t)
                cash -= lots * LOT * price
                bought += 1
        last.update({s: c for s, (_, c, _) in now.items() if c == c})
        rows.append((day, hold, cash, cash + sum(n * last[s] for s, (n, _) in held.items()), len(held), bought, sold, blocked))
    return pd.DataFrame(rows, columns=["date", "hold", "cash", "equity", "positions", "bought", "sold", "blocked"])


def simulate(bars: DataFrame, picks: DataFrame, holds: tuple[int, ...] = (1, 4, 13), limits: bool = True) -> DataFrame:
    """Equity curves of each holding period. ``picks``: date, symbol, pos. Only the bars of symbols that are ever picked are read,
    and the dates of all."""
    picked = bars.join(picks.select("symbol").distinct(), "symbol", "left_semi")
    null = lambda kind: F.lit(None).cast(kind)
    rows = picked.select("date", "symbol", "open", "close", F.col("volume").cast("double").alias("volume"), null("int").alias("pos"))
    days = bars.select("date").distinct().select("date", F.lit("").alias("symbol"), null("double").alias("open"), null("double").alias("close"), null("double").alias("volume"), null("int").alias("pos"))
    wanted = picks.select("date", "symbol", null("double").alias("open"), null("double").alias("close"), null("double").alias("volume"), F.col("pos").cast("int").alias("pos"))
    # a scenario needs every price: bars are dealt out once for each of the few scenarios
    every = rows.unionByName(days).unionByName(wanted).withColumn("hold", F.explode(F.array(*(F.lit(h) for h in holds))))
    limit = daily_limit if limits else None

    def run(p: pd.DataFrame) -> pd.DataFrame:
        return account(p[p["pos"].isna()], p[p["pos"].notna()], int(p["hold"].iloc[0]), limit)

    return every.groupBy("hold").applyInPandas(run, "date date, hold int, cash double, equity double, positions int, bought int, sold int, blocked int")


def cohorts(bars: DataFrame, picks: DataFrame, hold: int = 4) -> DataFrame:
    """Staggered cohorts: sleeve k of ``hold`` trades every hold-th date with its own capital, so sleeves run side by side."""
    day = bars.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1).withColumn("sleeve", F.col("t") % hold)
    priced = bars.select("symbol", "date", "open", F.lead("open", 1).over(_by()).alias("entry"), F.lead("open", 1 + hold).over(_by()).alias("exit"))
    trades = picks.join(priced, ["symbol", "date"]).where("entry is not null and exit is not null").join(F.broadcast(day), "date")
    per = trades.groupBy("sleeve", "date").agg(F.avg(F.col("exit") * (1 - SELL) / (F.col("entry") * (1 + BUY)) - 1).alias("cohort_return"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sleeve").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("sleeve_equity", CASH / hold * F.exp(F.sum(F.log1p("cohort_return")).over(w)))


# ---------------------------------------------------------------- walk-forward regression

FEATURES, ALPHA = ("x1", "x2", "x3"), 1.0


def walk_forward_ridge(panel: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Out-of-sample predictions by calendar year: ridge with free intercept on all earlier years, from sums by year.

    The data are aggregated once to a few moments a year; each year's model is solved from the sums of the years before it.
    """
    x = panel.select("symbol", "date", F.lag("returns").over(_by()).alias("x1"), F.log(F.col("volume") / F.lag("volume").over(_by())).alias("x2"), (F.col("close") / F.col("vwap") - 1).alias("x3"), (F.lead("close").over(_by()) / F.col("close") - 1).alias("y")).dropna().withColumn("yr", F.year("date"))
    cols = [*FEATURES, "y"]
    moments = [F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in cols), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:])]
    sums = sorted(x.groupBy("yr").agg(*moments).collect(), key=lambda r: r["yr"])  # a row a year
    models, total = [], None
    for r in sums:
        if total is not None:
            n, m = total["n"], np.array([total[f"s_{c}"] for c in cols]) / total["n"]
            cross = np.array([[total[f"p_{a}_{b}" if i <= j else f"p_{b}_{a}"] for j, b in enumerate(cols)] for i, a in enumerate(cols)]) - n * np.outer(m, m)
            beta = np.linalg.solve(cross[:-1, :-1] + alpha * np.eye(len(FEATURES)), cross[:-1, -1])
            models.append((r["yr"], *beta.tolist(), float(m[-1] - beta @ m[:-1])))
        now = {k: float(v) for k, v in r.asDict().items() if k != "yr"}
        total = now if total is None else {k: total[k] + v for k, v in now.items()}
    fitted = panel.sparkSession.createDataFrame(models, "yr int, b1 double, b2 double, b3 double, b0 double")
    scored = x.join(F.broadcast(fitted), "yr")
    return scored.select("symbol", "date", "y", (F.col("b0") + sum(F.col(f"b{k}") * F.col(c) for k, c in enumerate(FEATURES, 1))).alias("score"))


def ridge_metrics(predictions: DataFrame) -> DataFrame:
    """Yearly squared and absolute error and correlation of predictions."""
    return predictions.groupBy(F.year("date").cast("int").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") - F.col("score")) ** 2).alias("mse"), F.avg(F.abs(F.col("y") - F.col("score"))).alias("mae"), F.corr("y", "score").alias("pearson"))


# ---------------------------------------------------------------- factor de-duplication


def deduplicate(pairs: list[tuple[str, str, float]], priority: dict[str, float], least: float = 0.8) -> dict[str, str]:
    """Representative of each factor: components of pairs correlated at ``least`` or more; best priority first, then name."""
    parent = {k: k for k in priority}

    def root(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b, r in pairs:
        if abs(r) >= least:
            parent[root(a)] = root(b)
    best: dict[str, str] = {}
    for k in sorted(priority, key=lambda k: (-priority[k], k)):
        best.setdefault(root(k), k)
    return {k: best[root(k)] for k in priority}


# ---------------------------------------------------------------- queries


def _volume_picks(bars: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("volume"), "symbol"))
    return bars.select("date", "symbol", pos.alias("pos")).where("pos <= 3")


_EMA = "list_reduce(list(close) OVER w, lambda a, v: a * (1 - {alpha}) + {alpha} * v)"
_KDJ_SQL = f"""WITH b AS ({BARS_SQL}), r AS (SELECT symbol, date, (close - min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) / (max(high) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) - min(low) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) + 1e-9::DOUBLE) * 100 AS raw, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM b),
k AS (SELECT symbol, date, list_reduce(list(CASE WHEN i = 1 THEN 50.0::DOUBLE ELSE raw END) OVER w, lambda a, v: a * 2 / 3 + v / 3) AS k FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT symbol, date, k, list_reduce(list(k) OVER w, lambda a, v: a * 2 / 3 + v / 3) AS d FROM k WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT symbol, date, k, d, 3 * k - 2 * d AS j FROM d"""
_MACD_SQL = f"""WITH b AS ({BARS_SQL}), e AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, {_EMA.format(alpha='2.0::DOUBLE / 13')} - {_EMA.format(alpha='2.0::DOUBLE / 27')} AS raw FROM b WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT symbol, date, i, CASE WHEN i >= 26 THEN raw END AS dif FROM e),
g AS (SELECT symbol, date, dif, CASE WHEN i >= 34 THEN list_reduce(list(dif) FILTER (WHERE dif IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: a * 0.8::DOUBLE + v * 0.2::DOUBLE) END AS dea FROM f)
SELECT symbol, date, dif, dea, 2 * (dif - dea) AS hist FROM g"""
_SIDE = "list_reduce(list({x}) OVER w, lambda a, v: a * (1 - 1.0::DOUBLE / {m}) + v / {m})"
_BRICK_SQL = f"""WITH b AS ({BARS_SQL}), h AS (SELECT symbol, date, close, max(high) OVER v AS t, min(low) OVER v AS l FROM b WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
s AS (SELECT symbol, date, (t - close) / (CASE WHEN t = l THEN 0.01 ELSE t - l END) * 100 - 90 AS u, (close - l) / (CASE WHEN t = l THEN 0.01 ELSE t - l END) * 100 AS d FROM h),
a AS (SELECT symbol, date, {_SIDE.format(x='u', m=4)} AS u1, {_SIDE.format(x='d', m=6)} AS d1 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT symbol, date, {_SIDE.format(x='d1', m=6)} - u1 AS gap FROM a WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT symbol, date, CASE WHEN gap > 4 THEN gap - 4 ELSE 0.0 END AS brick_level FROM g)
SELECT symbol, date, brick_level - coalesce(lag(brick_level) OVER (PARTITION BY symbol ORDER BY date), brick_level) AS brick, brick_level FROM r"""
_COHORT_SQL = f"""WITH b AS ({BARS_SQL}), p AS (SELECT date, symbol, open, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol) AS pos, lead(open, 1) OVER (PARTITION BY symbol ORDER BY date) AS entry, lead(open, 5) OVER (PARTITION BY symbol ORDER BY date) AS exit FROM b),
t AS (SELECT date, (row_number() OVER (ORDER BY date) - 1) % 4 AS sleeve FROM (SELECT DISTINCT date FROM b) z),
c AS (SELECT t.sleeve, p.date, count(1) AS n, avg(exit * (1 - 0.0013::DOUBLE) / (entry * (1 + 0.0003::DOUBLE)) - 1) AS cohort_return FROM p JOIN t ON p.date = t.date WHERE pos <= 3 AND entry IS NOT NULL AND exit IS NOT NULL GROUP BY t.sleeve, p.date)
SELECT CAST(sleeve AS INT) AS sleeve, date, n, cohort_return, 250000 * exp(sum(ln(1 + cohort_return)) OVER (PARTITION BY sleeve ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS sleeve_equity FROM c"""

_GREEN_SQL = f"""SELECT symbol, date, (SELECT count(*) FROM unnest(list_reverse(past)) WITH ORDINALITY u(b, k) WHERE k <= coalesce(list_position(list_transform(list_reverse(past), lambda x: x >= 0), true), len(past) + 1) - 1) AS run
FROM (SELECT symbol, date, coalesce(list(brick) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS past FROM ({_BRICK_SQL}) x) y"""
_WEEKLY_SQL = f"""WITH b AS ({BARS_SQL}), w AS (SELECT symbol, isoyear(date) * 100 + weekofyear(date) AS wk, max(date) AS d, arg_max(close, date) AS c FROM b GROUP BY symbol, isoyear(date) * 100 + weekofyear(date)),
m AS (SELECT symbol, d, list(c) OVER (PARTITION BY symbol ORDER BY d) AS past FROM w),
f AS (SELECT symbol, d, coalesce(len(past) >= 16 AND list_avg(past[-4:]) > list_avg(past[-8:]) AND list_avg(past[-8:]) > list_avg(past[-16:]), false) AS flag FROM m)
SELECT b.symbol, b.date, coalesce(f.flag, false) AS bull FROM b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.date >= f.d"""
_ZX_SQL = f"""WITH h AS (SELECT symbol, date, list(close) OVER (PARTITION BY symbol ORDER BY date) AS past FROM ({BARS_SQL}) b)
SELECT symbol, date, CASE WHEN len(past) >= 114 THEN (list_avg(past[-14:]) + list_avg(past[-28:]) + list_avg(past[-57:]) + list_avg(past[-114:])) / 4 END AS zx_long FROM h"""

#: name: (plan, key columns, value columns, SQL or none)
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str, str, str | None]] = {
    "indicator_kdj": (lambda s, d: indicators(weekly_bars(s, d)), "symbol date", "k d j", _KDJ_SQL),
    "indicator_macd": (lambda s, d: indicators(weekly_bars(s, d)), "symbol date", "dif dea hist", _MACD_SQL),
    "indicator_brick": (lambda s, d: indicators(weekly_bars(s, d)), "symbol date", "brick brick_level", _BRICK_SQL),
    "indicator_green_run": (lambda s, d: green_runs(indicators(weekly_bars(s, d))), "symbol date run", "", _GREEN_SQL),
    "indicator_weekly_bull": (lambda s, d: weekly_bull(weekly_bars(s, d), (4, 8, 16)), "symbol date bull", "", _WEEKLY_SQL),
    "indicator_zx_long": (lambda s, d: weekly_bars(s, d).select("symbol", "date", zx_long().alias("zx_long")), "symbol date", "zx_long", _ZX_SQL),
    "indicator_rci_zx": (lambda s, d: indicators(weekly_bars(s, d)), "symbol date", "rci9 rci26 zxdq", None),
    "selectors": (lambda s, d: selectors(weekly_bars(s, d)), "symbol date b1 brick mbdsr mbdsr_confirmed rci_cross macd_cross obv_uptrend macd_obv", "", None),
    "portfolio_realistic": (lambda s, d: simulate(weekly_bars(s, d), _volume_picks(weekly_bars(s, d))), "date hold positions bought sold blocked", "cash equity", None),
    "portfolio_cohorts": (lambda s, d: cohorts(weekly_bars(s, d), _volume_picks(weekly_bars(s, d))), "sleeve date n", "cohort_return sleeve_equity", _COHORT_SQL),
    "ml_walk_forward_ridge": (lambda s, d: walk_forward_ridge(research_panel(s, d)), "symbol date", "y score", None),
    "ml_ridge_metrics": (lambda s, d: ridge_metrics(walk_forward_ridge(research_panel(s, d))), "yr n", "mse mae pearson", None),
}
