"""Selection by one factor and rank by another, weighted rank ensembles, and the signals and picks made of them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import percentile_rank


def filter_rank_frame(panel: DataFrame, filter_factor: str, rank_factor: str, lag: int = 1, min_age: int = 20, lookback: int = 20, min_liquidity: float = 0.0, turnover: str | None = None, st: str | None = None) -> DataFrame:
    """For each cell of a dense panel the two factors and what decides eligibility, all as known ``lag`` rows before:
    ``date, symbol, filter_value, rank_value, reference_close, listing_age, liquidity, is_st, eligible``."""
    w = Window.partitionBy("symbol").orderBy("date")
    late = lambda c: F.lag(c, lag).over(w)
    paid = F.col(turnover) if turnover else F.col("close") * F.col("volume")
    x = panel.withColumns({"__age": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__paid": F.avg(paid).over(w.rowsBetween(1 - lookback, 0))})
    x = x.select("date", "symbol", late(filter_factor).alias("filter_value"), late(rank_factor).alias("rank_value"), late("close").alias("reference_close"), late("__age").alias("listing_age"), late("__paid").alias("liquidity"), (F.coalesce(late(st).cast("boolean"), F.lit(False)) if st else F.lit(False)).alias("is_st"))
    fit = F.col("reference_close").isNotNull() & (F.col("listing_age") >= min_age) & ~F.col("is_st")
    if min_liquidity > 0:
        fit = fit & (F.col("liquidity") >= min_liquidity)
    return x.withColumn("eligible", F.coalesce(fit, F.lit(False)))


def filter_then_rank(frame: DataFrame, share: float = 0.3, first: int = 1, last: int = 3, least: int = 5, filter_descending: bool = True, rank_descending: bool = True) -> DataFrame:
    """``date, symbol, final_rank, score``: of each date's eligible symbols with both values (``least`` at least) the best ``share``
    by filter_value, ranked by rank_value; positions ``first`` to ``last``. Ties go by symbol."""
    way = lambda c, down: F.desc(c) if down else F.asc(c)
    day = Window.partitionBy("date")
    a = frame.where("eligible and filter_value is not null and rank_value is not null")
    a = a.withColumns({"k": F.row_number().over(day.orderBy(way("filter_value", filter_descending), "symbol")), "n": F.count(F.lit(1)).over(day)})
    b = a.where((F.col("n") >= least) & (F.col("k") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))))
    c = b.withColumn("final_rank", F.row_number().over(day.orderBy(way("rank_value", rank_descending), "symbol")))
    return c.where(F.col("final_rank").between(first, last)).select("date", "symbol", "final_rank", F.col("rank_value").alias("score"))


def rank_ensemble(values: DataFrame, weights: Mapping[str, float], ascending: Iterable[str] = (), least_coverage: float = 0.5, first: int = 1, last: int = 5, least: int = 1) -> DataFrame:
    """``date, symbol, pos, score, coverage, weight`` from rows ``date, symbol, factor, factor_value`` (and ``eligible``).

    Each factor becomes a percentile among the date's eligible symbols (a large value ranks high, but for those of
    ``ascending``); the score is their weighted mean over the factors at hand, if these carry ``least_coverage`` of the
    weight. Dates with fewer than ``least`` scores are skipped. Ties go by symbol. A repeated key is an error.
    """
    total, down = float(sum(weights.values())), set(ascending)
    frame = values if "eligible" in values.columns else values.withColumn("eligible", F.lit(True))
    names = {f: f"f{k}" for k, f in enumerate(weights)}
    mine = lambda f: F.when(F.col("factor") == f, F.col("factor_value"))
    twice = F.greatest(*(F.count(F.when(F.col("factor") == f, 1)) for f in names), F.lit(0), F.lit(0))
    x = frame.where(F.col("factor").isin(list(names))).groupBy("date", "symbol").agg(*(F.max(mine(f)).alias(c) for f, c in names.items()), F.min(F.coalesce("eligible", F.lit(False))).alias("fit"), twice.alias("rows"))
    x = x.where(F.when(F.col("rows") > 1, F.raise_error(F.lit("a date, symbol and factor stands twice")).cast("boolean")).otherwise(F.col("fit")))
    for f, c in names.items():
        x = x.withColumn(f"p{c}", percentile_rank(c, "date", ascending=f not in down))
    share = {c: F.lit(weights[f] / total) for f, c in names.items()}
    x = x.withColumn("coverage", sum((F.when(F.col(f"p{c}").isNotNull(), share[c]).otherwise(0.0) for c in names.values()), F.lit(0.0)))
    score = sum((F.coalesce(F.col(f"p{c}"), F.lit(0.0)) * share[c] for c in names.values()), F.lit(0.0)) / F.col("coverage")
    x = x.where((F.col("coverage") > 0) & (F.col("coverage") >= least_coverage - 1e-12)).withColumn("score", F.round(score, 12))
    day = Window.partitionBy("date")
    x = x.withColumns({"pos": F.row_number().over(day.orderBy(F.desc("score"), "symbol")), "n": F.count(F.lit(1)).over(day)})
    x = x.where((F.col("n") >= least) & F.col("pos").between(first, last))
    return x.select("date", "symbol", "pos", "score", "coverage", (1 / F.count(F.lit(1)).over(day)).alias("weight"))


def factor_signals(frame: DataFrame, value: str, share: float = 0.15, whole: str = "floor") -> DataFrame:
    """``date, symbol, signal_type, score, weight``: each date's best ``share`` of the symbols with a value, one at least, in equal
    weights; ``whole`` says how a fraction is rounded, ``floor`` or ``ceil``. Ties go by symbol."""
    day = Window.partitionBy("date")
    x = frame.where(F.col(value).isNotNull()).withColumns({"k": F.row_number().over(day.orderBy(F.desc(value), "symbol")), "n": F.count(F.lit(1)).over(day)})
    most = {"floor": F.floor, "ceil": F.ceil}[whole](F.col("n") * F.lit(share))
    best = x.where(F.col("k") <= F.greatest(F.lit(1), most))
    return best.select("date", "symbol", F.lit("buy").alias("signal_type"), F.col(value).alias("score"), (1 / F.count(F.lit(1)).over(day)).alias("weight"))


def signal_picks(signals: DataFrame, most: int = 4, kind: str = "buy") -> DataFrame:
    """``date, symbol, pos, score``: each date's best signals of a kind, missing scores last, a symbol once, at its best."""
    one = signals.where(F.col("signal_type") == kind).groupBy("date", "symbol").agg(F.max("score").alias("score"))
    pos = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last("score"), "symbol"))
    return one.withColumn("pos", pos).where(F.col("pos") <= most).select("date", "symbol", "pos", "score")
