"""Datasets, folds, linear models and their scores, against pandas and numpy."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from panelspark.operators import learning
from panelspark.queries import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    days = [datetime.date(2019, 1, 1) + datetime.timedelta(days=9 * k) for k in range(180)]
    rows = []
    for s in range(6):
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))
        for k, d in enumerate(days):
            gap = rng.random() < 0.1
            rows.append((f"s{s}", d, None if gap else float(close[k]), float(close[k] * 1.01), None if rng.random() < 0.05 else float(rng.integers(0, 4)), float(rng.normal())))
    return spark.createDataFrame(rows, "symbol string, date date, close double, open double, a double, b double")


def test_dataset_matches_pandas(panel):
    got = learning.dataset(panel, ["a", "b"], [2], directions={"a": -1}, feature_transform="zscore", target_transform="rank", entry="next_open").toPandas()
    p = panel.toPandas().sort_values(["symbol", "date"])
    want = p.copy()
    for c, way in (("a", -1), ("b", 1)):
        want[c] = (p[c].astype(float) * way).where(p["close"].notna()).groupby(p["symbol"]).shift(1)
    opens = p.groupby("symbol")["open"]
    label = "next_open_return_2d"
    want[label] = opens.shift(-3) / opens.shift(-1) - 1
    want = want[want["close"].notna()].copy()
    for c in ("a", "b"):
        g = want.groupby("date")[c]
        scale = g.transform("std")
        want[c] = ((want[c] - g.transform("mean")) / scale).where(scale > 1e-12, 0.0).where(want[c].notna())
    g = want.groupby("date")[label]
    want[f"{label}_cs_rank"] = g.rank() / g.transform("count")
    by = ["symbol", "date"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True)[[*by, "a", "b", label, f"{label}_cs_rank"]], want.sort_values(by).reset_index(drop=True)[[*by, "a", "b", label, f"{label}_cs_rank"]], rtol=1e-9)


def test_folds():
    days = [datetime.date(y, m, 1) for y in (2018, 2019, 2020, 2022) for m in (1, 5, 9)]
    by_dates = learning.folds_by_dates([*days, days[0]], 4, 2, 1)
    assert [(f.train[0], f.purge[0], f.test[-1]) for f in by_dates] == [(days[a], days[a + 4], days[a + 6]) for a in (0, 2, 4)]
    years = learning.folds_by_years(days, 2, 1, 1)
    assert [(f.train, f.purge, f.test) for f in years] == [(tuple(days[:5]), (days[5],), tuple(days[6:9]))]
    assert learning.folds_by_years([]) == [] and learning.folds_by_dates([], 1, 1) == []
    with pytest.raises(ValueError):
        learning.folds_by_dates(days, 0, 1)
    assert [learning.label_horizon(n) for n in ("forward_return_5d", "next_open_return_5d_cs_rank", "y")] == [5, 6, None]


def test_walk_forward_models_match_numpy(panel):
    frame = learning.dataset(panel, ["a", "b"], [1])
    p = frame.dropna().toPandas()
    folds = learning.folds_by_dates(p["date"], 60, 30, 2)  # they overlap
    alpha, mix = 0.002, 0.5
    for model, kind in ((learning.ridge(1.0), "ridge"), (learning.elastic_net(alpha, mix, tol=1e-12), "net")):
        got = learning.walk_forward(frame, ["a", "b"], "forward_return_1d", folds, model).toPandas()
        assert len(got) == sum(p["date"].isin(f.test).sum() for f in folds)
        for k, f in enumerate(folds):
            train, test = p[p["date"].isin(f.train)], p[p["date"].isin(f.test)]
            x, y = train[["a", "b"]].to_numpy(), train["forward_return_1d"].to_numpy()
            if kind == "ridge":
                xc = x - x.mean(0)
                beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
            else:
                z = (x - x.mean(0)) / x.std(0)
                w = np.zeros(2)
                for _ in range(500):
                    for j in range(2):
                        r = z[:, j] @ (y - y.mean() - z @ w + z[:, j] * w[j]) / len(z)
                        w[j] = np.sign(r) * max(abs(r) - alpha * mix, 0) / (1 + alpha * (1 - mix))
                beta = w / x.std(0)
            want = test.assign(score=y.mean() + (test[["a", "b"]].to_numpy() - x.mean(0)) @ beta).set_index(["symbol", "date"])["score"]
            mine = got[got["fold"] == k].set_index(["symbol", "date"])["score"]
            assert np.allclose(mine.sort_index(), want.sort_index(), atol=1e-10), (kind, k)


def test_prediction_metrics(spark):
    day = lambda d: datetime.date(2020, 1, d)
    rows = [(day(1), 1.0, 2.0), (day(1), 2.0, 2.0), (day(1), 3.0, 5.0), (day(2), 1.0, 1.0), (day(2), 1.0, 3.0), (day(3), 4.0, 4.0), (day(3), None, 1.0)]
    got = learning.prediction_metrics(spark.createDataFrame(rows, "date date, y double, score double"), "y").first()
    p = pd.DataFrame(rows, columns=["date", "y", "score"]).dropna()
    first = p[p["date"] == day(1)].rank()
    ic = first["y"].corr(first["score"])
    assert (got["count"], got["rank_ic_date_count"]) == (6, 1)
    assert np.allclose([got["mse"], got["mae"], got["pearson"], got["rank_ic_mean"]], [((p.y - p.score) ** 2).mean(), (p.y - p.score).abs().mean(), p.y.corr(p.score), ic])
    none = learning.prediction_metrics(spark.createDataFrame([], "date date, y double, score double"), "y").first()
    assert (none["count"], none["pearson"]) == (None, None)


@pytest.mark.parametrize("name", ["ml_dataset", "ml_prediction_metrics"])
def test_queries_match_their_sql(spark, name):
    queries, sql = registry()
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "orders", "customer", "nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql[name]).df()
    got = queries[name](spark, SF).toPandas()[want.columns]
    by = list(want.columns)
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True).astype({c: str for c in by if c == "date"}), want.assign(**({"date": want["date"].dt.date} if "date" in by else {})).sort_values(by).reset_index(drop=True).astype({c: str for c in by if c == "date"}), check_dtype=False, rtol=1e-6)
