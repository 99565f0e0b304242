"""The registered queries of the panel engine and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators import folds, learning, ranking
from panelspark.operators.factors import compute, formulas
from panelspark.plans.formula import duckdb_query, final, library
from panelspark.plans.statements import _DUCK, _SPARK, CHECKS, STATEMENTS, for_engine
from panelspark.streaming.bars import EVENT_BARS_SQL, streamed_event_bars
from panelspark.sources.trades import BARS_SQL, PANEL_SQL, research_panel, weekly_bars

Query = Callable[[SparkSession, str], DataFrame]

#: Formulas without a consistent reading: their calculators raise.
UNRESOLVED = {"gtja_159", "gtja_181"}
#: Formulas computed by grouped regressions, which SQL doesn't express.
NO_SQL = {"gtja_030", "gtja_149"}
CUSTOM = {"custom_001": "-cs(cov5(cs(returns), cs(sdiv(amount, cap))))", "custom_002": "cs(sdiv(vwap-close, vwap))"}

#: Every panel operator by itself.
CORE = {"rank_cs": "cs(close)", "delay": "lag3(close)", "delta": "diff2(close)", "correlation": "corr10(close, volume)", "covariance": "cov10(close, volume)", "scale": "l1(returns)", "signed_power": "spow(returns, 2)", "decay_linear": "wlin8(close)", "ts_min": "tmin8(low)", "ts_max": "tmax8(high)", "ts_argmin": "argmin8(low)", "ts_argmax": "argmax8(high)", "ts_rank": "trank8(close)", "ts_sum": "tsum8(volume)", "ts_product": "tsprod4(1+returns)", "ts_stddev": "sd8(close)", "element_min": "min2(open, close)", "element_max": "max2(open, close)", "indneutralize": "neutral(returns, 'industry')", "fractional_window": "tmax3.92795(close)", "signed_condition": "when(close>open, 1, -1)", "boolean_condition": "when(close>open, 2, 0)"}
SECOND = {"sma_cn": "smacn(close, 9, 2)", "wma": "wma10(close)", "highday": "hday10(high)", "lowday": "lday10(low)", "regbeta": "regbeta12(close, volume)", "regresi": "regresi12(close, volume)", "sequence_beta": "seqbeta12(close)", "count_if": "tcount12(close>open)", "sum_if": "tsumif(volume, 12, close>open)", "ts_mean": "tmean12(close)", "conditional": "when(close>open, 1.0, -1.0)", "broadcast_series": "sdiv(close, bench_close)", "carry_product": "carry(returns)"}


def _reported(keys: str, values: str, text: str) -> str:
    columns = [*keys.split(), *(f"{final(v)} AS {v}" for v in values.split())]
    return f"SELECT {', '.join(columns)} FROM ({text}) reported"


def _statement(name: str) -> tuple[Query, str]:
    keys, values, text = STATEMENTS[name]
    whole = _reported(keys, values, text)
    spark_text = for_engine(whole, _SPARK)
    duck = for_engine(_reported(keys, values, CHECKS[name]) if name in CHECKS else whole, _DUCK)
    for place, sql in (("{panel}", PANEL_SQL), ("{bars0}", f"SELECT * FROM ({PANEL_SQL}) z WHERE close IS NOT NULL"), ("{bars}", BARS_SQL)):
        duck = duck.replace(place, f"({sql})")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {}
        if "{panel}" in spark_text or "{bars0}" in spark_text:
            frames["panel"] = research_panel(spark, sf_dir)
        if "{bars0}" in spark_text:
            frames["bars0"] = frames.pop("panel").where("close IS NOT NULL")
        if "{bars}" in spark_text:
            frames["bars"] = weekly_bars(spark, sf_dir)
        return spark.sql(spark_text, **frames)

    return run, duck


def _shown(make: Query, keys: str, values: str) -> Query:
    return lambda spark, sf_dir: make(spark, sf_dir).selectExpr(*keys.split(), *(f"{final(v)} AS {v}" for v in values.split()))


def _factors(texts: dict[str, str]) -> Query:
    return lambda spark, sf_dir: compute(research_panel(spark, sf_dir), texts, report=True)


def _lagged_factor(panel: DataFrame) -> DataFrame:
    """The evaluation frame's factor: minus the return of the row before, where the next return is known."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = panel.withColumns({"factor": -F.lag("returns").over(w), "fwd1": F.lead("close").over(w) / F.col("close") - 1, "age": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), "liquidity": F.avg("amount").over(w.rowsBetween(-20, -1))})
    return x.where("factor is not null and fwd1 is not null")


def _filter_then_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _lagged_factor(research_panel(spark, sf_dir)).select("date", "symbol", F.col("liquidity").alias("filter_value"), F.col("factor").alias("rank_value"), (F.col("age") >= 10).alias("eligible"))
    return ranking.filter_then_rank(frame)


def _rank_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = research_panel(spark, sf_dir).unpivot(["date", "symbol"], ["returns", "volume", "amount"], "factor", "factor_value")
    return ranking.rank_ensemble(values, {"returns": 0.5, "volume": 0.3, "amount": 0.2})


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("close") > F.col("open"), "buy").otherwise("hold")
    return ranking.signal_picks(weekly_bars(spark, sf_dir).select("date", "symbol", F.col("volume").alias("score"), kind.alias("signal_type")))


def _ml_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.dataset(research_panel(spark, sf_dir), ["returns", "volume"], [1, 4], directions={"returns": -1}, feature_transform="rank")


def _elastic_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _ml_dataset(spark, sf_dir)
    days = [r["date"] for r in frame.select("date").distinct().collect()]  # a row a date
    return learning.walk_forward(frame, ["returns", "volume"], "forward_return_1d", learning.folds_by_years(days, 2, 1, 1), learning.elastic_net())


def _prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _lagged_factor(research_panel(spark, sf_dir)).select("symbol", "date", F.col("factor").alias("score"), "fwd1", F.year("date").alias("yr"))
    return learning.prediction_metrics(scored, "fwd1", ["yr"])


_RANKED = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY date) END AS {x}"
_DATASET_SQL = f"""WITH p AS ({PANEL_SQL}), f AS (SELECT symbol, date, close, lag(CASE WHEN close IS NOT NULL THEN -returns END) OVER w AS returns, lag(CASE WHEN close IS NOT NULL THEN volume END) OVER w AS volume FROM p WINDOW w AS (PARTITION BY symbol ORDER BY date)),
r AS (SELECT symbol, date, {_RANKED.format(x='returns')}, {_RANKED.format(x='volume')} FROM f WHERE close IS NOT NULL),
l AS (SELECT symbol, date, lead(close, 1) OVER w / close - 1 AS forward_return_1d, lead(close, 4) OVER w / close - 1 AS forward_return_4d FROM p WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT r.*, forward_return_1d, forward_return_4d FROM r JOIN l USING (symbol, date)"""
_METRICS_SQL = f"""WITH z AS (SELECT symbol, date, -lag(returns) OVER w AS s, lead(close) OVER w / close - 1 AS y FROM ({PANEL_SQL}) p WINDOW w AS (PARTITION BY symbol ORDER BY date)),
k AS (SELECT year(date) AS yr, date, s, y, rank() OVER (PARTITION BY date ORDER BY s) + (count(*) OVER (PARTITION BY date, s) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0::DOUBLE AS ry FROM z WHERE s IS NOT NULL AND y IS NOT NULL),
d AS (SELECT yr, date, CASE WHEN min(rs) < max(rs) AND min(ry) < max(ry) THEN corr(rs, ry) END AS ic FROM k GROUP BY yr, date),
i AS (SELECT yr, avg(ic) AS rank_ic_mean, count(ic) AS rank_ic_date_count FROM d GROUP BY yr),
t AS (SELECT yr, count(*) AS count, avg((s - y) * (s - y)) AS mse, avg(abs(s - y)) AS mae, corr(s, y) AS pearson FROM k GROUP BY yr)
SELECT CAST(yr AS INT) AS yr, count, mse, mae, pearson, rank_ic_mean, rank_ic_date_count FROM t JOIN i USING (yr)"""

#: name: (plan, key columns, value columns, SQL or none)
LEARNING: dict[str, tuple[Query, str, str, str | None]] = {
    "ml_dataset": (_ml_dataset, "symbol date", "returns volume forward_return_1d forward_return_4d", _DATASET_SQL),
    "ml_walk_forward_elastic_net": (_elastic_net, "symbol date fold", "forward_return_1d score", None),
    "ml_prediction_metrics": (_prediction_metrics, "yr count rank_ic_date_count", "mse mae pearson rank_ic_mean", _METRICS_SQL),
}

#: Statements whose plan is an operator; their text is only the check.
OPERATORS: dict[str, Query] = {
    "filter_then_rank": _filter_then_rank,
    "rank_ensemble": _rank_ensemble,
    "factor_to_signals": lambda s, d: ranking.factor_signals(_lagged_factor(research_panel(s, d)), "factor"),
    "score_to_signals": lambda s, d: ranking.factor_signals(_lagged_factor(research_panel(s, d)), "factor", whole="ceil"),
    "signals_to_picks": _picks,
}


def registry() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}
    for family, lib in (("alpha", "formulas_101"), ("gtja", "formulas_191")):
        names = [n for n in library(lib) if n not in UNRESOLVED | NO_SQL]
        for a in range(0, len(names), 12):
            part = {n: library(lib)[n] for n in names[a : a + 12]}
            key = f"factors_{names[a]}_to_{names[min(a + 11, len(names) - 1)][-3:]}"
            queries[key], oracle[key] = _factors(part), duckdb_query(part, PANEL_SQL)
    for name, texts in (("panel_operators_core", CORE), ("panel_operators_second", SECOND)):
        queries[name], oracle[name] = _factors(texts), duckdb_query(texts, PANEL_SQL)
    queries["factors_gtja_regressions"] = _factors({n: library("formulas_191")[n] for n in sorted(NO_SQL)})
    queries["factors_custom"], oracle["factors_custom"] = _factors(CUSTOM), duckdb_query(CUSTOM, PANEL_SQL)
    queries["streaming_event_bars"], oracle["streaming_event_bars"] = streamed_event_bars, EVENT_BARS_SQL
    for name in STATEMENTS:
        queries[name], oracle[name] = _statement(name)
        if name in OPERATORS:
            keys, values, _ = STATEMENTS[name]
            queries[name] = _shown(OPERATORS[name], keys, values)
    for name, (make, keys, values, sql) in (folds.QUERIES | LEARNING).items():
        queries[name] = _shown(make, keys, values)
        if sql:
            oracle[name] = _reported(keys, values, sql)
    return queries, oracle
