"""Declarative plans of the evaluation, selection, join and label operators, as SQL over named inputs.

Each statement reads ``{panel}`` (dense weekly grid) or ``{bars}`` (observed weekly bars) and runs as one Catalyst plan. The
few functions whose names differ between SQL dialects are written as ``PCT(x, q)`` (linear-interpolated percentile),
``SD`` (sample deviation), ``SDP``, ``COVP`` (population forms), and printed for the engine at hand.
"""

from __future__ import annotations

import re

SYM = "PARTITION BY symbol ORDER BY date"
_SPARK = {"PCT": "percentile", "SD": "stddev_samp", "SDP": "stddev_pop", "COVP": "covar_pop", "MAXBY": "max_by", "MINBY": "min_by", "ENTRY": "struct"}
_DUCK = {"PCT": "quantile_cont", "SD": "stddev_samp", "SDP": "stddev_pop", "COVP": "covar_pop", "MAXBY": "arg_max", "MINBY": "arg_min", "ENTRY": "row"}


def avg_rank(v: str, by: str) -> str:
    """Average-tie percentile rank of ``v`` within ``by`` over its non-null values."""
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {by}, {v} IS NULL ORDER BY {v}) + (count(1) OVER (PARTITION BY {by}, {v}) - 1) / CAST(2 AS DOUBLE)) / count({v}) OVER (PARTITION BY {by}) END"


def quantile_group(r: str, n: str, q: int) -> str:
    """Group 1..q of rank ``r`` of ``n``: how many of the interpolated quantile edges of 1..n lie strictly below it, at least 1."""
    edges = []
    for k in range(q):
        p = k * (1.0 / q) * 100 / 100
        v = f"(({n} - 1) * CAST({p!r} AS DOUBLE))"
        lo, g = f"floor({v})", f"({v} - floor({v}))"
        a, b = f"(1 + {lo})", f"least(2 + {lo}, {n})"
        edges.append(f"CASE WHEN {r} > (CASE WHEN {g} >= 0.5 THEN {b} - ({b} - {a}) * (1 - {g}) ELSE {a} + ({b} - {a}) * {g} END) THEN 1 ELSE 0 END")
    return f"CAST(greatest(1, {' + '.join(edges)}) AS INT)"


def correlation(x: str, y: str) -> str:
    """Pearson correlation of an aggregate, null where either side is constant."""
    return f"CASE WHEN max({x}) > min({x}) AND max({y}) > min({y}) THEN COVP({x}, {y}) / (SDP({x}) * SDP({y})) END"


def for_engine(text: str, names: dict[str, str]) -> str:
    return re.sub(r"\b(PCT|SD|SDP|COVP|MAXBY|MINBY|ENTRY)\(", lambda m: names[m[1]] + "(", text)


#: The evaluation frame: a lagged factor, forward returns on the calendar, industry and capitalisation.
EVAL = f"""raw AS (SELECT symbol, date, close, open, volume, amount, cap, industry, sector, returns, -returns AS factor0 FROM {{panel}}),
ev AS (SELECT symbol, date, close, open, volume, amount, cap, industry, sector, returns, lag(factor0) OVER ({SYM}) AS factor,
       lead(close, 1) OVER ({SYM}) / close - 1 AS fwd1, lead(close, 4) OVER ({SYM}) / close - 1 AS fwd4, count(close) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS age,
       avg(amount) OVER ({SYM} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS liquidity FROM raw),
ok AS (SELECT * FROM ev WHERE factor IS NOT NULL AND fwd1 IS NOT NULL),
rk AS (SELECT *, {avg_rank('factor', 'date')} AS fr, {avg_rank('fwd1', 'date')} AS rr, row_number() OVER (PARTITION BY date ORDER BY factor, symbol) AS rn, count(1) OVER (PARTITION BY date) AS cnt FROM ok),
gr AS (SELECT *, {quantile_group('rn', 'cnt', 5)} AS grp FROM rk)"""

#: name: (key columns, value columns, statement). Value columns are doubles.
STATEMENTS: dict[str, tuple[str, str, str]] = {}


def _add(name: str, keys: str, values: str, text: str) -> None:
    STATEMENTS[name] = (keys, values, text)


# ---- cleaning, universe, predicates
_add("clean_bar_state", "symbol date board is_limit_up is_limit_down is_suspended is_tradeable", "prev_close daily_return limit_rate turnover_value signed_turnover", f"""
WITH b AS (SELECT *, lag(close) OVER ({SYM}) AS prev_close FROM {{bars}} WHERE open > 0 AND high > 0 AND low > 0 AND close > 0),
c AS (SELECT *, close / prev_close - 1 AS daily_return, CASE WHEN substr(symbol, 6, 1) = '3' THEN 'gem' WHEN substr(symbol, 6, 1) = '4' THEN 'bj' ELSE 'main' END AS board FROM b),
d AS (SELECT *, CASE board WHEN 'gem' THEN 0.2 WHEN 'bj' THEN 0.3 ELSE 0.1 END AS limit_rate FROM c)
SELECT symbol, date, board, coalesce(daily_return >= limit_rate - 0.001, false) AS is_limit_up, coalesce(daily_return <= -limit_rate + 0.001, false) AS is_limit_down, volume <= 0 AS is_suspended, NOT (volume <= 0) AND open > 0 AND close > 0 AS is_tradeable,
       prev_close, daily_return, CAST(limit_rate AS DOUBLE) AS limit_rate, amount AS turnover_value, (open + close) / 2 * volume AS signed_turnover FROM d""")
_add("top_turnover_pool", "date symbol pos", "turnover_n", f"""
WITH t AS (SELECT symbol, date, sum((open + close) / 2 * volume) OVER ({SYM} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS turnover_n FROM {{bars}}),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY turnover_n DESC, symbol) AS pos FROM t) SELECT date, symbol, pos, turnover_n FROM r WHERE pos <= 5""")
_add("winsorize_zscore", "date symbol", "winsorized zscore rank_pct", f"""
WITH x AS (SELECT symbol, date, volume AS v FROM {{bars}}),
q AS (SELECT date, PCT(v, 0.05) AS lo, PCT(v, 0.95) AS hi, avg(v) AS m, SD(v) AS s FROM x GROUP BY date)
SELECT x.date, x.symbol, greatest(lo, least(hi, v)) AS winsorized, (v - m) / nullif(s, 0) AS zscore, {avg_rank('v', 'x.date')} AS rank_pct FROM x JOIN q ON x.date = q.date""")
_add("market_regime", "date regime", "trailing_return", """
WITH d AS (SELECT date, avg(returns) AS r FROM {panel} GROUP BY date),
t AS (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) - 1 AS w, count(r) OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM d),
l AS (SELECT date, lag(CASE WHEN n >= 4 THEN w END) OVER (ORDER BY date) AS trailing_return FROM t)
SELECT date, CASE WHEN trailing_return > 0.1 THEN 'bull' WHEN trailing_return < -0.1 THEN 'bear' WHEN trailing_return IS NOT NULL THEN 'sideways' END AS regime, trailing_return FROM l""")
_add("factor_eligibility", "symbol date eligible", "liquidity", f"WITH {EVAL} SELECT symbol, date, coalesce(age >= 20 AND liquidity >= 10000 AND factor IS NOT NULL, false) AS eligible, liquidity FROM ev")
# ---- joins
_MEMBERS = """mem AS (SELECT DISTINCT symbol, CAST('1994-01-01' AS DATE) AS in_date, CAST('1998-01-01' AS DATE) AS out_date, concat('A', substr(symbol, 5, 1)) AS code FROM {bars}
UNION ALL SELECT DISTINCT symbol, CAST('1997-06-01' AS DATE), CAST(NULL AS DATE), concat('B', substr(symbol, 6, 1)) FROM {bars})"""
_add("join_interval_membership", "symbol date code", "close", f"""
WITH {_MEMBERS}, j AS (SELECT b.symbol, b.date, b.close, m.code, row_number() OVER (PARTITION BY b.symbol, b.date ORDER BY m.in_date DESC, m.code DESC) AS k
FROM {{bars}} b JOIN mem m ON b.symbol = m.symbol AND m.in_date <= b.date AND (m.out_date IS NULL OR b.date < m.out_date)) SELECT symbol, date, code, close FROM j WHERE k = 1""")
_add("join_asof_backward", "symbol date", "last_close strictly_before", f"""
SELECT symbol, date, MAXBY(close, CASE WHEN close IS NOT NULL THEN date END) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_close,
MAXBY(close, CASE WHEN close IS NOT NULL THEN date END) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS strictly_before FROM {{panel}}""")
_add("join_left_coalesce", "symbol date", "turnover", "WITH ctx AS (SELECT symbol, date, amount * 2 AS ctx_amount FROM {bars} WHERE volume > 200) SELECT b.symbol, b.date, coalesce(c.ctx_amount, b.amount) AS turnover FROM {bars} b LEFT JOIN ctx c ON b.symbol = c.symbol AND b.date = c.date")
_add("join_semi_pool", "symbol date", "close", "SELECT b.symbol, b.date, b.close FROM {bars} b WHERE EXISTS (SELECT 1 FROM {bars} p WHERE p.symbol = b.symbol AND p.date = b.date AND p.volume > 300)")
_add("join_anti_excluded", "symbol date", "close", "SELECT b.symbol, b.date, b.close FROM {bars} b WHERE NOT EXISTS (SELECT 1 FROM {bars} p WHERE p.symbol = b.symbol AND p.date = b.date AND substr(p.symbol, 6, 1) = '3')")
_add("join_benchmark_broadcast", "symbol date", "excess", "WITH m AS (SELECT date, avg(returns) AS mkt0 FROM {panel} GROUP BY date) SELECT p.symbol, p.date, p.returns - m.mkt0 AS excess FROM {panel} p JOIN m ON p.date = m.date WHERE p.returns IS NOT NULL")
# ---- aggregations
_add("resample_month", "symbol month n_weeks", "open high low close volume", """
SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, count(1) AS n_weeks, MINBY(open, date) AS open, max(high) AS high, min(low) AS low, MAXBY(close, date) AS close, sum(volume) AS volume
FROM {bars} GROUP BY symbol, CAST(date_trunc('month', date) AS DATE)""")
_add("coverage", "date n_values n_symbols", "coverage", f"WITH {EVAL} SELECT date, count(factor) AS n_values, count(1) AS n_symbols, count(factor) / CAST(count(1) AS DOUBLE) AS coverage FROM ev GROUP BY date")
_add("distribution", "n", "mean std p01 p05 p25 p50 p75 p95 p99 outliers", f"""
WITH {EVAL}, m AS (SELECT avg(factor) AS mu, SD(factor) AS sd FROM ok)
SELECT count(1) AS n, avg(factor) AS mean, SD(factor) AS std, PCT(factor, 0.01) AS p01, PCT(factor, 0.05) AS p05, PCT(factor, 0.25) AS p25, PCT(factor, 0.5) AS p50, PCT(factor, 0.75) AS p75, PCT(factor, 0.95) AS p95, PCT(factor, 0.99) AS p99,
CAST(sum(CASE WHEN abs(factor - (SELECT mu FROM m)) > 5 * (SELECT sd FROM m) THEN 1 ELSE 0 END) AS DOUBLE) AS outliers FROM ok""")
_add("style_factor_returns", "date", "mkt_return smb hml", f"""
WITH x AS (SELECT symbol, date, returns, MAXBY(cap, CASE WHEN cap IS NOT NULL THEN date END) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mc,
MAXBY(bm0, CASE WHEN bm0 IS NOT NULL THEN date END) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bm FROM (SELECT *, vwap / nullif(close, 0) AS bm0 FROM {{panel}}) z),
y AS (SELECT * FROM x WHERE returns IS NOT NULL AND mc > 0 AND bm > 0),
c AS (SELECT date, PCT(mc, 0.5) AS mid, PCT(bm, 0.3) AS lo, PCT(bm, 0.7) AS hi FROM y GROUP BY date),
s AS (SELECT y.*, CASE WHEN mc <= mid THEN 'S' ELSE 'B' END AS sz, CASE WHEN bm <= lo THEN 'L' WHEN bm > hi THEN 'H' ELSE 'M' END AS v FROM y JOIN c ON y.date = c.date),
p AS (SELECT date, sz, v, sum(returns * mc) / sum(mc) AS r FROM s GROUP BY date, sz, v),
m AS (SELECT date, sum(returns * mc) / sum(mc) AS mkt_return FROM s GROUP BY date)
SELECT m.date, mkt_return, avg(CASE WHEN sz = 'S' THEN r END) - avg(CASE WHEN sz = 'B' THEN r END) AS smb, avg(CASE WHEN v = 'H' THEN r END) - avg(CASE WHEN v = 'L' THEN r END) AS hml FROM m JOIN p ON m.date = p.date GROUP BY m.date, mkt_return""")
_add("yearly_returns", "symbol yr", "compounded volatility", "SELECT symbol, CAST(year(date) AS INT) AS yr, exp(sum(ln(1 + returns))) - 1 AS compounded, SD(returns) AS volatility FROM {panel} WHERE returns > -1 GROUP BY symbol, year(date)")
_add("drawdown", "symbol", "max_drawdown sharpe", f"""
WITH c AS (SELECT symbol, date, returns, close / max(close) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM {{bars0}})
SELECT symbol, -min(dd) AS max_drawdown, CASE WHEN max(returns) > min(returns) THEN avg(returns) / SD(returns) * sqrt(CAST(52 AS DOUBLE)) END AS sharpe FROM c GROUP BY symbol""")
# ---- evaluation
_add("eval_ic", "date n", "ic rank_ic", f"WITH {EVAL} SELECT date, count(1) AS n, {correlation('factor', 'fwd1')} AS ic, {correlation('fr', 'rr')} AS rank_ic FROM rk GROUP BY date HAVING count(1) >= 5")
_add("eval_ic_summary", "days", "ic_mean ic_std icir win_rate", f"""WITH {EVAL}, d AS (SELECT date, {correlation('fr', 'rr')} AS ic FROM rk GROUP BY date HAVING count(1) >= 5)
SELECT count(ic) AS days, avg(ic) AS ic_mean, SD(ic) AS ic_std, avg(ic) / nullif(SD(ic), 0) AS icir, avg(CASE WHEN round(ic, 12) > 0 THEN CAST(1 AS DOUBLE) WHEN ic IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS win_rate FROM d""")
_add("eval_ic_annual", "yr days", "ic_mean", f"WITH {EVAL}, d AS (SELECT date, {correlation('fr', 'rr')} AS ic FROM rk GROUP BY date) SELECT CAST(year(date) AS INT) AS yr, count(ic) AS days, avg(ic) AS ic_mean FROM d GROUP BY year(date)")
_add("eval_industry_ic", "industry n", "ic_mean", f"WITH {EVAL}, d AS (SELECT date, industry, {correlation('factor', 'fwd1')} AS ic FROM ok GROUP BY date, industry HAVING count(1) >= 3) SELECT industry, count(ic) AS n, avg(ic) AS ic_mean FROM d GROUP BY industry")
_add("eval_cap_bucket_ic", "bucket n", "ic_mean", f"""WITH {EVAL}, b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY cap, symbol) AS cn, count(1) OVER (PARTITION BY date) AS cc FROM ok),
g AS (SELECT *, {quantile_group('cn', 'cc', 3)} AS bucket FROM b), d AS (SELECT date, bucket, {correlation('factor', 'fwd1')} AS ic FROM g GROUP BY date, bucket HAVING count(1) >= 3) SELECT bucket, count(ic) AS n, avg(ic) AS ic_mean FROM d GROUP BY bucket""")
_add("eval_neutralized_ic", "date", "ic", f"""WITH {EVAL}, dm AS (SELECT date, symbol, fwd1, factor - avg(factor) OVER (PARTITION BY date, industry) AS f, CASE WHEN cap > 0 THEN ln(cap) END AS lc FROM ok),
re AS (SELECT date, count(1) AS n, avg(f) AS mf, avg(lc) AS ml, COVP(f, lc) / nullif(COVP(lc, lc), 0) AS beta FROM dm WHERE lc IS NOT NULL GROUP BY date),
rs AS (SELECT dm.date, dm.fwd1, dm.f - re.mf - re.beta * (dm.lc - re.ml) AS resid FROM dm JOIN re ON dm.date = re.date WHERE dm.lc IS NOT NULL AND re.n >= 5)
SELECT date, {correlation('resid', 'fwd1')} AS ic FROM rs GROUP BY date""")
_add("eval_group_returns", "date grp n", "group_return", f"WITH {EVAL} SELECT date, grp, count(1) AS n, avg(fwd1) AS group_return FROM gr GROUP BY date, grp")
_add("eval_monotonic", "grp", "mean_return", f"WITH {EVAL}, d AS (SELECT date, grp, avg(fwd1) AS r FROM gr GROUP BY date, grp) SELECT grp, avg(r) AS mean_return FROM d GROUP BY grp")
_add("eval_long_short_nav", "date", "spread nav", f"""WITH {EVAL}, d AS (SELECT date, avg(CASE WHEN grp = 5 THEN fwd1 END) - avg(CASE WHEN grp = 1 THEN fwd1 END) AS spread FROM gr GROUP BY date)
SELECT date, spread, exp(sum(CASE WHEN spread > -1 THEN ln(1 + spread) ELSE CAST(0 AS DOUBLE) END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS nav FROM d""")
_add("eval_top_n_returns", "top_n date n", "mean_return", f"WITH {EVAL}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS top FROM ok), k AS (SELECT 1 AS top_n UNION ALL SELECT 5 UNION ALL SELECT 10) SELECT k.top_n, t.date, count(1) AS n, avg(fwd1) AS mean_return FROM t JOIN k ON t.top <= k.top_n GROUP BY k.top_n, t.date")
_add("eval_turnover", "date n", "turnover", f"""WITH {EVAL}, v AS (SELECT * FROM gr WHERE cnt >= 5), d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM v) z), t AS (SELECT date, symbol FROM v WHERE grp = 5),
p AS (SELECT d.nxt AS date, t.symbol FROM t JOIN d ON t.date = d.date WHERE d.nxt IS NOT NULL), c AS (SELECT date, count(1) AS n FROM t GROUP BY date),
k AS (SELECT p.date, count(t.symbol) / CAST(count(1) AS DOUBLE) AS kept FROM p LEFT JOIN t ON t.date = p.date AND t.symbol = p.symbol GROUP BY p.date)
SELECT c.date, c.n, 1 - k.kept AS turnover FROM c LEFT JOIN k ON c.date = k.date""")
_add("eval_rank_autocorr", "date n", "autocorr", f"""WITH {EVAL}, v AS (SELECT * FROM gr WHERE cnt >= 5), d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM v) z),
j AS (SELECT b.date, a.fr AS x, b.fr AS y, a.grp = 5 AND b.grp = 5 AS together FROM v a JOIN d ON a.date = d.date JOIN v b ON b.date = d.nxt AND a.symbol = b.symbol),
r AS (SELECT *, {avg_rank('x', 'date')} AS xr, {avg_rank('y', 'date')} AS yr FROM j),
tops AS (SELECT d.nxt AS date, sum(CASE WHEN v.grp = 5 THEN 1 ELSE 0 END) AS before FROM v JOIN d ON v.date = d.date GROUP BY d.nxt), now AS (SELECT date, sum(CASE WHEN grp = 5 THEN 1 ELSE 0 END) AS here FROM v GROUP BY date),
c AS (SELECT date, count(1) AS n, {correlation('xr', 'yr')} AS rho, sum(CASE WHEN together THEN 1 ELSE 0 END) AS common FROM r GROUP BY date)
SELECT c.date, c.n, CASE WHEN c.n >= 5 AND rho IS NOT NULL THEN rho ELSE common / CAST(before + here - common AS DOUBLE) END AS autocorr FROM c JOIN tops ON c.date = tops.date JOIN now ON c.date = now.date""")
_add("eval_exposure", "date industry", "weight", f"WITH {EVAL}, t AS (SELECT date, industry, count(1) AS k FROM gr WHERE grp = 5 GROUP BY date, industry) SELECT date, industry, k / CAST(sum(k) OVER (PARTITION BY date) AS DOUBLE) AS weight FROM t")
_add("eval_horizons", "horizon n", "ic_mean", f"""WITH {EVAL}, u AS (SELECT date, factor, fwd1 AS r, 1 AS horizon FROM ev UNION ALL SELECT date, factor, fwd4, 4 FROM ev), d AS (SELECT horizon, date, {correlation('factor', 'r')} AS ic FROM u WHERE factor IS NOT NULL AND r IS NOT NULL GROUP BY horizon, date) SELECT horizon, count(ic) AS n, avg(ic) AS ic_mean FROM d GROUP BY horizon""")
_add("eval_samples", "sample days", "ic_mean", f"WITH {EVAL}, d AS (SELECT date, {correlation('fr', 'rr')} AS ic FROM rk GROUP BY date) SELECT CASE WHEN date < CAST('1999-01-01' AS DATE) THEN 'in_sample' ELSE 'out_of_sample' END AS sample, count(ic) AS days, avg(ic) AS ic_mean FROM d GROUP BY CASE WHEN date < CAST('1999-01-01' AS DATE) THEN 'in_sample' ELSE 'out_of_sample' END")
_add("factor_correlation", "a b days", "spearman pearson", f"""WITH f AS (SELECT symbol, date, lag(returns) OVER ({SYM}) AS f1, lag(volume) OVER ({SYM}) AS f2, lag(vwap / nullif(close, 0)) OVER ({SYM}) AS f3 FROM {{panel}}),
l AS (SELECT symbol, date, 'f1' AS k, f1 AS v FROM f UNION ALL SELECT symbol, date, 'f2', f2 FROM f UNION ALL SELECT symbol, date, 'f3', f3 FROM f),
p AS (SELECT x.date, x.k AS a, y.k AS b, x.v AS u, y.v AS w FROM l x JOIN l y ON x.date = y.date AND x.symbol = y.symbol AND x.k < y.k WHERE x.v IS NOT NULL AND y.v IS NOT NULL),
r AS (SELECT *, {avg_rank('u', 'date, a, b')} AS ur, {avg_rank('w', 'date, a, b')} AS wr FROM p),
d AS (SELECT date, a, b, {correlation('ur', 'wr')} AS s, {correlation('u', 'w')} AS c FROM r GROUP BY date, a, b HAVING count(1) >= 20)
SELECT a, b, count(s) AS days, avg(s) AS spearman, avg(c) AS pearson FROM d GROUP BY a, b""")
# ---- ranking, signals, labels
_add("filter_then_rank", "date symbol final_rank", "score", f"""WITH {EVAL}, e AS (SELECT * FROM ok WHERE age >= 10 AND liquidity IS NOT NULL),
a AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY liquidity DESC, symbol) AS k, count(1) OVER (PARTITION BY date) AS n FROM e), b AS (SELECT * FROM a WHERE n >= 5 AND k <= greatest(1, ceil(n * CAST(0.3 AS DOUBLE)))),
c AS (SELECT date, symbol, factor AS score, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS final_rank FROM b) SELECT date, symbol, final_rank, score FROM c WHERE final_rank BETWEEN 1 AND 3""")
_add("rank_ensemble", "date symbol pos", "score", f"""WITH x AS (SELECT symbol, date, returns AS a, volume AS b, amount AS c FROM {{panel}}), r AS (SELECT symbol, date, {avg_rank('a', 'date')} AS ra, {avg_rank('b', 'date')} AS rb, {avg_rank('c', 'date')} AS rc FROM x),
s AS (SELECT *, CASE WHEN ra IS NULL THEN 0 ELSE 0.5 END + CASE WHEN rb IS NULL THEN 0 ELSE 0.3 END + CASE WHEN rc IS NULL THEN 0 ELSE 0.2 END AS w FROM r),
t AS (SELECT date, symbol, round((coalesce(ra, 0) * 0.5 + coalesce(rb, 0) * 0.3 + coalesce(rc, 0) * 0.2) / CAST(w AS DOUBLE), 12) AS score FROM s WHERE w >= 0.5),
u AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS pos FROM t) SELECT date, symbol, pos, score FROM u WHERE pos <= 5""")
_add("factor_to_signals", "date symbol signal_type", "score weight", f"WITH {EVAL}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS k, count(1) OVER (PARTITION BY date) AS n FROM ok), u AS (SELECT * FROM t WHERE k <= greatest(1, floor(n * CAST(0.15 AS DOUBLE)))) SELECT date, symbol, 'buy' AS signal_type, factor AS score, 1 / CAST(count(1) OVER (PARTITION BY date) AS DOUBLE) AS weight FROM u")
_add("score_to_signals", "date symbol signal_type", "score weight", f"WITH {EVAL}, t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS k, count(1) OVER (PARTITION BY date) AS n FROM ok), u AS (SELECT * FROM t WHERE k <= greatest(1, ceil(n * CAST(0.15 AS DOUBLE)))) SELECT date, symbol, 'buy' AS signal_type, factor AS score, 1 / CAST(count(1) OVER (PARTITION BY date) AS DOUBLE) AS weight FROM u")
_add("labels_forward_returns", "symbol date", "forward_return_1d forward_return_5d next_open_return_1d next_open_return_5d", f"SELECT symbol, date, lead(close, 1) OVER ({SYM}) / close - 1 AS forward_return_1d, lead(close, 5) OVER ({SYM}) / close - 1 AS forward_return_5d, lead(open, 2) OVER ({SYM}) / lead(open, 1) OVER ({SYM}) - 1 AS next_open_return_1d, lead(open, 6) OVER ({SYM}) / lead(open, 1) OVER ({SYM}) - 1 AS next_open_return_5d FROM {{bars}}")
_add("signal_event_study", "horizon n", "mean_return median_return win_rate", f"""WITH b AS (SELECT symbol, date, close, volume, lag(volume) OVER ({SYM}) AS pv, lead(close, 1) OVER ({SYM}) / close - 1 AS r1, lead(close, 3) OVER ({SYM}) / close - 1 AS r3 FROM {{bars}}), s AS (SELECT * FROM b WHERE volume > 1.5 * pv),
u AS (SELECT 1 AS horizon, r1 AS r FROM s UNION ALL SELECT 3, r3 FROM s) SELECT horizon, count(r) AS n, avg(r) AS mean_return, PCT(r, 0.5) AS median_return, avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) WHEN r IS NOT NULL THEN CAST(0 AS DOUBLE) END) AS win_rate FROM u GROUP BY horizon""")
_add("basket_compounding", "date n", "basket_return equity", f"""WITH b AS (SELECT symbol, date, volume, lag(volume) OVER ({SYM}) AS pv, (lead(close, 1) OVER ({SYM}) * (1 - 0.0013)) / (close * (1 + 0.0003)) - 1 AS r FROM {{bars}}), d AS (SELECT date, count(r) AS n, avg(r) AS basket_return FROM b WHERE volume > 1.5 * pv AND r IS NOT NULL GROUP BY date)
SELECT date, n, basket_return, 100000 * exp(sum(ln(1 + basket_return)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM d""")
# ---- indicators without recurrences
_add("indicator_obv_atr", "symbol date", "obv atr", f"""WITH p AS (SELECT *, lag(close) OVER ({SYM}) AS pc FROM {{bars}}), t AS (SELECT symbol, date, CASE WHEN pc IS NULL THEN CAST(0 AS DOUBLE) ELSE sign(close - pc) * volume END AS step, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p)
SELECT symbol, date, sum(step) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv, CASE WHEN count(tr) OVER ({SYM} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) = 14 THEN avg(tr) OVER ({SYM} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM t""")
_add("indicator_max_volume_day", "symbol date not_bearish", "", f"SELECT symbol, date, MAXBY(close >= open, ENTRY(volume, -i)) OVER ({SYM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS not_bearish FROM (SELECT *, row_number() OVER ({SYM}) AS i FROM {{bars}}) z")
_add("indicator_crossover", "symbol date crossed", "fast slow", f"""WITH m AS (SELECT symbol, date, avg(close) OVER ({SYM} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS fast, avg(close) OVER ({SYM} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS slow FROM {{bars}}), l AS (SELECT *, lag(fast) OVER ({SYM}) AS pf, lag(slow) OVER ({SYM}) AS ps FROM m) SELECT symbol, date, coalesce(pf <= ps AND fast > slow, false) AS crossed, fast, slow FROM l""")
_add("indicator_monthly_ma_bull", "symbol date bull", "", f"""WITH w AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS m, MAXBY(close, date) AS c, max(date) AS last_day FROM {{bars}} GROUP BY symbol, CAST(date_trunc('month', date) AS DATE)),
x AS (SELECT symbol, last_day, CASE WHEN count(c) OVER w3 = 12 THEN avg(c) OVER w1 > avg(c) OVER w2 AND avg(c) OVER w2 > avg(c) OVER w3 END AS flag FROM w WINDOW w1 AS (PARTITION BY symbol ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY symbol ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY symbol ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
j AS (SELECT b.symbol, b.date, x.last_day, x.flag FROM {{bars}} b LEFT JOIN x ON b.symbol = x.symbol AND b.date = x.last_day)
SELECT symbol, date, coalesce(MAXBY(flag, CASE WHEN flag IS NOT NULL THEN date END) OVER ({SYM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS bull FROM j""")
# ---- more joins, reshapes and reports
_add("external_wide_to_long", "symbol date factor", "factor_value", "SELECT symbol, date, 'f_volume' AS factor, volume AS factor_value FROM {bars} UNION ALL SELECT symbol, date, 'f_vwap', vwap FROM {bars} UNION ALL SELECT symbol, date, 'f_amount', amount FROM {bars}")
_add("external_long_to_wide", "symbol date", "f_volume f_vwap", "WITH l AS (SELECT symbol, date, 'f_volume' AS factor, volume AS v FROM {bars} UNION ALL SELECT symbol, date, 'f_vwap', vwap FROM {bars}) SELECT symbol, date, max(CASE WHEN factor = 'f_volume' THEN v END) AS f_volume, max(CASE WHEN factor = 'f_vwap' THEN v END) AS f_vwap FROM l GROUP BY symbol, date")
_add("join_symbol_alias", "symbol date", "close", "WITH a AS (SELECT '000011' AS old_symbol, '900011' AS new_symbol, CAST('1997-01-01' AS DATE) AS since, CAST('1999-01-01' AS DATE) AS until) SELECT coalesce(a.new_symbol, b.symbol) AS symbol, b.date, b.close FROM {bars} b LEFT JOIN a ON b.symbol = a.old_symbol AND b.date >= a.since AND b.date < a.until")
_add("join_expected_universe", "symbol date is_suspended", "", "WITH u AS (SELECT s.symbol, d.date FROM (SELECT DISTINCT symbol FROM {bars}) s CROSS JOIN (SELECT DISTINCT date FROM {bars}) d) SELECT u.symbol, u.date, b.close IS NULL AS is_suspended FROM u LEFT JOIN {bars} b ON u.symbol = b.symbol AND u.date = b.date")
_add("aggregate_reasons", "date reasons", "", "WITH r AS (SELECT date, CASE WHEN volume < 100 THEN 'thin' WHEN close < open THEN 'down' ELSE 'up' END AS reason FROM {bars}) SELECT date, concat_ws(';', sort_array(collect_set(reason))) AS reasons FROM r GROUP BY date")
_add("universe_by_year", "yr n_rows n_symbols", "", "SELECT CAST(year(date) AS INT) AS yr, count(1) AS n_rows, count(DISTINCT symbol) AS n_symbols FROM {bars} GROUP BY year(date)")
_add("warmup_slice", "symbol date", "close", f"WITH i AS (SELECT symbol, date, close, row_number() OVER ({SYM}) AS k FROM {{bars}}), s AS (SELECT symbol, min(k) AS first_k FROM i WHERE date >= CAST('1998-01-01' AS DATE) GROUP BY symbol) SELECT i.symbol, i.date, i.close FROM i JOIN s ON i.symbol = s.symbol WHERE i.k >= s.first_k - 20")
_add("eval_regime_ic", "regime days", "ic_mean", f"""WITH {EVAL}, m AS (SELECT date, avg(returns) AS r FROM raw GROUP BY date), t AS (SELECT date, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) - 1 AS w FROM m),
g AS (SELECT date, lag(w) OVER (ORDER BY date) AS w FROM t), h AS (SELECT date, CASE WHEN w > 0.1 THEN 'bull' WHEN w < -0.1 THEN 'bear' ELSE 'sideways' END AS regime FROM g WHERE w IS NOT NULL), d AS (SELECT date, {correlation('fr', 'rr')} AS ic FROM rk GROUP BY date)
SELECT regime, count(ic) AS days, avg(ic) AS ic_mean FROM d JOIN h ON d.date = h.date GROUP BY regime""")
_add("eval_filter_status", "date n_total n_new n_thin n_eligible", "", f"WITH {EVAL} SELECT date, count(1) AS n_total, sum(CASE WHEN age < 20 THEN 1 ELSE 0 END) AS n_new, sum(CASE WHEN coalesce(liquidity, 0) < 10000 THEN 1 ELSE 0 END) AS n_thin, sum(CASE WHEN age >= 20 AND liquidity >= 10000 AND factor IS NOT NULL THEN 1 ELSE 0 END) AS n_eligible FROM ev GROUP BY date")
_add("eval_annual_long_only", "yr n", "year_return", f"WITH {EVAL}, d AS (SELECT date, avg(CASE WHEN grp = 5 THEN fwd1 END) AS r FROM gr GROUP BY date) SELECT CAST(year(date) AS INT) AS yr, count(r) AS n, exp(sum(CASE WHEN r > -1 THEN ln(1 + r) ELSE CAST(0 AS DOUBLE) END)) - 1 AS year_return FROM d GROUP BY year(date)")
_add("eval_tradable_top_n", "date n_wanted n_entered n_closed", "net_return", f"""WITH {EVAL}, n AS (SELECT symbol, date, close, lead(open, 1) OVER ({SYM}) AS entry, lead(volume, 1) OVER ({SYM}) AS v1, lead(close, 1) OVER ({SYM}) AS c1, lead(open, 2) OVER ({SYM}) AS exit, lead(volume, 2) OVER ({SYM}) AS v2, CASE WHEN substr(symbol, 6, 1) = '3' THEN 0.2 WHEN substr(symbol, 6, 1) = '4' THEN 0.3 ELSE 0.1 END AS lim FROM raw),
m AS (SELECT symbol, date, entry, exit, coalesce(v1 > 0 AND entry > 0 AND entry / close - 1 < lim - 0.001, false) AS can_buy, coalesce(v2 > 0 AND exit > 0 AND exit / c1 - 1 > -lim + 0.001, false) AS can_sell FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor DESC, symbol) AS top FROM ok), w AS (SELECT t.date, m.can_buy, m.can_sell, m.entry, m.exit FROM t JOIN m ON t.symbol = m.symbol AND t.date = m.date WHERE top <= 5)
SELECT date, count(1) AS n_wanted, sum(CASE WHEN can_buy THEN 1 ELSE 0 END) AS n_entered, sum(CASE WHEN can_buy AND can_sell THEN 1 ELSE 0 END) AS n_closed, avg(CASE WHEN can_buy AND can_sell THEN exit * (1 - 0.0013) / (entry * (1 + 0.0003)) - 1 END) AS net_return FROM w GROUP BY date""")
_add("eval_summary", "section metric", "value", f"""WITH {EVAL}, d AS (SELECT date, {correlation('fr', 'rr')} AS ic FROM rk GROUP BY date), g AS (SELECT date, avg(CASE WHEN grp = 5 THEN fwd1 END) - avg(CASE WHEN grp = 1 THEN fwd1 END) AS spread FROM gr GROUP BY date)
SELECT 'ic' AS section, 'mean' AS metric, avg(ic) AS value FROM d UNION ALL SELECT 'ic', 'icir', avg(ic) / nullif(SD(ic), 0) FROM d UNION ALL SELECT 'long_short', 'mean', avg(spread) FROM g UNION ALL SELECT 'coverage', 'mean', avg(CASE WHEN factor IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) FROM ev""")
_add("signals_to_picks", "date symbol pos", "score", f"WITH s AS (SELECT date, symbol, volume AS score, CASE WHEN close > open THEN 'buy' ELSE 'hold' END AS signal_type FROM {{bars}}), r AS (SELECT date, symbol, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS pos FROM s WHERE signal_type = 'buy') SELECT date, symbol, pos, score FROM r WHERE pos <= 4")
_add("set_operations", "symbol", "", "SELECT symbol FROM {bars} WHERE volume > 400 INTERSECT SELECT symbol FROM {bars} WHERE close > open EXCEPT SELECT symbol FROM {bars} WHERE substr(symbol, 6, 1) = '5'")
_add("benchmark_compare", "date", "portfolio_return benchmark_return excess", "WITH b AS (SELECT date, sum(close * amount) / sum(amount) AS level FROM {bars} GROUP BY date), r AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS benchmark_return FROM b), p AS (SELECT date, avg(returns) AS portfolio_return FROM {panel} GROUP BY date) SELECT p.date, portfolio_return, benchmark_return, portfolio_return - benchmark_return AS excess FROM p JOIN r ON p.date = r.date")
_add("grouping_sets_volume", "symbol yr n", "volume", "SELECT coalesce(symbol, 'all') AS symbol, coalesce(CAST(y AS INT), 0) AS yr, count(1) AS n, sum(volume) AS volume FROM (SELECT symbol, year(date) AS y, volume FROM {bars}) z GROUP BY GROUPING SETS ((symbol), (y), ())")

#: SQL written apart from the plan, for statements whose own text would only check the engine.
CHECKS: dict[str, str] = {
    "aggregate_reasons": "SELECT date, string_agg(DISTINCT reason, ';' ORDER BY reason) AS reasons FROM (SELECT date, if(volume < 100, 'thin', if(close < open, 'down', 'up')) AS reason FROM {bars}) r GROUP BY date",
    "eval_turnover": f"WITH {EVAL}, t AS (SELECT date, list(symbol) FILTER (WHERE grp = 5) AS top FROM gr GROUP BY date HAVING count(*) >= 5), p AS (SELECT date, top, lag(top) OVER (ORDER BY date) AS prev FROM t) SELECT date, len(top) AS n, 1 - len(list_intersect(top, prev)) / len(prev)::DOUBLE AS turnover FROM p",
    "style_factor_returns": """WITH z AS (SELECT symbol, date, returns, lag(cap IGNORE NULLS) OVER w AS mc, lag(vwap / nullif(close, 0) IGNORE NULLS) OVER w AS bm FROM {panel} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
y AS (SELECT *, quantile_cont(mc, 0.5) OVER d AS mid, quantile_cont(bm, 0.3) OVER d AS lo, quantile_cont(bm, 0.7) OVER d AS hi FROM z WHERE returns IS NOT NULL AND mc > 0 AND bm > 0 WINDOW d AS (PARTITION BY date)),
p AS (SELECT date, mc > mid AS big, (bm > lo)::INT + (bm > hi)::INT AS value, sum(returns * mc) / sum(mc) AS r, sum(returns * mc) AS num, sum(mc) AS den FROM y GROUP BY ALL)
SELECT date, sum(num) / sum(den) AS mkt_return, avg(r) FILTER (NOT big) - avg(r) FILTER (big) AS smb, avg(r) FILTER (value = 2) - avg(r) FILTER (value = 0) AS hml FROM p GROUP BY date""",
    "market_regime": """WITH d AS (SELECT row_number() OVER (ORDER BY date) AS t, date, avg(returns) AS r FROM {panel} GROUP BY date),
w AS (SELECT a.t, count(b.r) AS n, exp(sum(ln(1 + coalesce(b.r, 0)))) - 1 AS c FROM d a JOIN d b ON b.t BETWEEN a.t - 11 AND a.t GROUP BY a.t),
l AS (SELECT d.date, CASE WHEN w.n >= 4 THEN w.c END AS trailing_return FROM d LEFT JOIN w ON w.t = d.t - 1)
SELECT date, if(trailing_return > 0.1, 'bull', if(trailing_return < -0.1, 'bear', if(trailing_return IS NULL, NULL, 'sideways'))) AS regime, trailing_return FROM l""",
    "labels_forward_returns": """WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS t FROM {bars})
SELECT a.symbol, a.date, c1.close / a.close - 1 AS forward_return_1d, c5.close / a.close - 1 AS forward_return_5d, c2.open / c1.open - 1 AS next_open_return_1d, c6.open / c1.open - 1 AS next_open_return_5d FROM b a
LEFT JOIN b c1 ON c1.symbol = a.symbol AND c1.t = a.t + 1 LEFT JOIN b c2 ON c2.symbol = a.symbol AND c2.t = a.t + 2 LEFT JOIN b c5 ON c5.symbol = a.symbol AND c5.t = a.t + 5 LEFT JOIN b c6 ON c6.symbol = a.symbol AND c6.t = a.t + 6""",
    "join_asof_backward": """WITH o AS (SELECT symbol, date, close FROM {panel} WHERE close IS NOT NULL)
SELECT p.symbol, p.date, (SELECT arg_max(o.close, o.date) FROM o WHERE o.symbol = p.symbol AND o.date <= p.date) AS last_close, (SELECT arg_max(o.close, o.date) FROM o WHERE o.symbol = p.symbol AND o.date < p.date) AS strictly_before FROM {panel} p""",
    "drawdown": """WITH c AS (SELECT symbol, returns, list_max(list(close) OVER (PARTITION BY symbol ORDER BY date)) AS top, close FROM {bars0})
SELECT symbol, max(1 - close / top) AS max_drawdown, avg(returns) / nullif(stddev_samp(returns), 0) * sqrt(52) AS sharpe FROM c GROUP BY symbol""",
}
