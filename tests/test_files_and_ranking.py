import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import ranking
from panelspark.sources import files


def test_bars_of_a_folder(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Date,Close,Volume,Note\n2024-01-02,10,100,a\n20240103,x,200,b\nnever,1,1,c\n2024-01-02,11,300,d\n")
    (tmp_path / "600001.csv").write_text("Date,Close,Volume,Note\n2024/01/04,5.5,7,e\n")
    got = {(r["symbol"], r["date"]): (r["close"], r["volume"], r["note"]) for r in files.read_bars(spark, str(tmp_path)).collect()}
    d = lambda k: dt.date(2024, 1, k)
    assert got == {("000001", d(2)): (11.0, 300.0, "d"), ("000001", d(3)): (None, 200.0, "b"), ("600001", d(4)): (5.5, 7.0, "e")}
    assert {r["symbol"] for r in files.read_bars(spark, str(tmp_path), symbols=["600001.SH"]).collect()} == {"600001"}
    assert files.read_bars(spark, str(tmp_path), end="2024-01-02").count() == 1
    assert files.read_bars(spark, str(tmp_path), symbols=[]).count() == 0


def test_context_and_its_faults(spark, tmp_path):
    folder = tmp_path / "ctx"
    (folder / "2024").mkdir(parents=True)
    (folder / "2024" / "20240102.csv").write_text("date,symbol,Total_MV,industry\n20240102,1,5e9,bank\n20240102,000002.SZ,,steel\n")
    (folder / "2024" / "20240103.csv").write_text("date,symbol,Total_MV,industry\n20240103,1,6e9,\n")
    got = {(r["symbol"], r["date"].day): (r["market_cap"], r["industry"]) for r in files.read_context(spark, str(folder)).collect()}
    assert got == {("000001", 2): (5e9, "bank"), ("000002", 2): (None, "steel"), ("000001", 3): (6e9, None)}
    files.write_json(spark, f"{folder}/_context_manifest.json", {"status": "partial"})
    with pytest.raises(ValueError, match="manifest"):
        files.read_context(spark, str(folder))
    files.write_json(spark, f"{folder}/_context_manifest.json", {"status": "complete"})
    (folder / "2024" / "20240104.csv").write_text("date,symbol,Total_MV,industry\n20240103,1,6e9,\n")
    with pytest.raises(ValueError, match="repeated"):
        files.read_context(spark, str(folder))


def test_factor_files_wide_and_long(spark, tmp_path):
    (tmp_path / "w.csv").write_text("date,symbol,Mom,Val\n2024-01-02,1,1.5,\n2024-01-02,2,inf,3\n")
    (tmp_path / "l.csv").write_text("date,symbol,factor,factor_value\n2024-01-02,1,MOM,1.5\n2024-01-02,2,val,3\n")
    rows = lambda df: {r["symbol"]: (r["mom"], r["val"]) for r in df.collect()}
    want = {"000001": (1.5, None), "000002": (None, 3.0)}
    assert rows(files.read_factors(spark, f"{tmp_path}/w.csv")) == rows(files.read_factors(spark, f"{tmp_path}/l.csv")) == want
    assert files.read_factors(spark, f"{tmp_path}/l.csv", factors=["val"]).columns == ["date", "symbol", "val"]
    with pytest.raises(ValueError, match="missing"):
        files.read_factors(spark, f"{tmp_path}/w.csv", factors=["none"])
    (tmp_path / "bad.csv").write_text("date,symbol,mom\nnever,1,2\n")
    with pytest.raises(ValueError, match="key"):
        files.read_factors(spark, f"{tmp_path}/bad.csv")


def test_sinks_replace_whole_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, {"b": 2, "a": 1}), (2, None)], "k int, metadata map<string,int>")
    for _ in range(2):
        files.write_reports({"t": df}, f"{tmp_path}/out")
    back = {r["k"]: r["metadata"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out/t").collect()}
    assert back == {"1": '{"a":1,"b":2}', "2": "{}"}
    assert json.loads((tmp_path / "out" / "reports.json").read_text()) == {"t": ["k", "metadata"]}
    files.save_candidates(spark, f"{tmp_path}", "2024-01-02", [{"symbol": "000001"}])
    assert files.load_candidates(spark, f"{tmp_path}") == files.load_candidates(spark, f"{tmp_path}", "2024-01-02")
    with pytest.raises(FileNotFoundError):
        files.load_candidates(spark, f"{tmp_path}", "2024-01-09")


def test_rank_ensemble_matches_pandas_with_gaps_and_ties(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2024, 1, 1 + d), f"{s:06d}", f, None if rng.random() < 0.2 else float(rng.integers(0, 5)), bool(rng.random() < 0.85)) for d in range(6) for s in range(9) for f in ("a", "b", "c")]
    frame = pd.DataFrame(rows, columns=["date", "symbol", "factor", "factor_value", "eligible"])
    weights, share = {"a": 2.0, "b": 1.0, "c": 1.0}, {"a": 0.5, "b": 0.25, "c": 0.25}
    df = spark.createDataFrame(rows, "date date, symbol string, factor string, factor_value double, eligible boolean")
    got = ranking.rank_ensemble(df, weights, ascending=["b"], least_coverage=0.6, first=2, last=4, least=3).toPandas()
    want = []
    for date, daily in frame.groupby("date"):
        fit = daily.groupby("symbol")["eligible"].all()
        v = daily.pivot(index="symbol", columns="factor", values="factor_value").loc[fit[fit].index].astype(float)
        p = pd.DataFrame({f: v[f].rank(pct=True, ascending=f != "b") for f in weights})
        cover = sum(p[f].notna() * share[f] for f in weights)
        score = (sum(p[f].fillna(0) * share[f] for f in weights) / cover)[cover >= 0.6].round(12)
        if len(score) < 3:
            continue
        best = score.reset_index(name="score").sort_values(["score", "symbol"], ascending=[False, True]).iloc[1:4]
        want += [(date, r.symbol, k + 2, r.score, cover[r.symbol], 1 / len(best)) for k, r in enumerate(best.itertuples())]
    want = pd.DataFrame(want, columns=got.columns)
    assert len(want) > 8
    pd.testing.assert_frame_equal(got.sort_values(["date", "pos"]).reset_index(drop=True), want, check_dtype=False)
    with pytest.raises(Exception, match="stands twice"):
        ranking.rank_ensemble(df.unionByName(df.limit(1)), weights).collect()
    assert ranking.rank_ensemble(df.limit(0), weights).count() == 0


def test_filter_then_rank_and_signals(spark):
    rows = [(dt.date(2024, 1, 1), f"{s:06d}", float(s % 4), float(-s), s != 9) for s in range(10)] + [(dt.date(2024, 1, 2), "000001", 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "date date, symbol string, filter_value double, rank_value double, eligible boolean")
    got = [(r["symbol"], r["final_rank"], r["score"]) for r in ranking.filter_then_rank(df, share=0.5).orderBy("final_rank").collect()]
    assert got == [("000001", 1, -1.0), ("000002", 2, -2.0), ("000003", 3, -3.0)]
    signals = ranking.factor_signals(df, "rank_value", share=0.25)
    assert sorted((r["date"].day, r["symbol"], r["weight"]) for r in signals.collect()) == [(1, "000000", 0.5), (1, "000001", 0.5), (2, "000001", 1.0)]
    assert [(r["symbol"], r["pos"]) for r in ranking.signal_picks(signals.where("date = '2024-01-01'"), 1).collect()] == [("000000", 1)]


def test_filter_rank_frame_knows_only_the_past(spark):
    rows = [(dt.date(2024, 1, 1 + k), "000001", c, 10.0, float(k), float(-k)) for k, c in enumerate([10.0, None, 12.0, 13.0])]
    panel = spark.createDataFrame(rows, "date date, symbol string, close double, volume double, f double, g double")
    got = ranking.filter_rank_frame(panel, "f", "g", min_age=2, lookback=2, min_liquidity=110.0).orderBy("date").collect()
    assert [(r["filter_value"], r["rank_value"], r["listing_age"], r["liquidity"], r["eligible"]) for r in got] == [(None, None, None, None, False), (0.0, -0.0, 1, 100.0, False), (1.0, -1.0, 1, 100.0, False), (2.0, -2.0, 2, 120.0, True)]
