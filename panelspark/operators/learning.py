"""Supervised learning on panels: datasets, walk-forward folds, linear models from moments, out-of-sample scores.

Linear models see the data as moments only. The folds' bounds cut the dates into segments; one pass adds up each
segment's moments, and a fold's are the sum of its segments', so overlapping folds cost no further pass. What the driver
holds is folds x features squared, and a row a date.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[["Moments"], tuple[np.ndarray, float]]


# ---------------------------------------------------------------- dataset


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cross_section(frame: DataFrame, columns: Iterable[str], how: str) -> DataFrame:
    """``columns`` as they are (``raw``), as average rank among the date's finite values over their number (``rank``) or as
    standard scores with the sample deviation (``zscore``; 0 where it is at most 1e-12 or there is one value). Missing stays missing."""
    day = Window.partitionBy("date")
    for c in columns if how != "raw" else ():
        x = _finite(c)
        if how == "rank":
            ranks = F.rank().over(day.orderBy(x.asc_nulls_last())) + (F.count(x).over(Window.partitionBy("date", x)) - 1) / 2
            value = ranks / F.count(x).over(day)
        elif how == "zscore":
            scale = F.stddev_samp(x).over(day)
            value = F.when(scale > 1e-12, (x - F.avg(x).over(day)) / scale).otherwise(0.0)
        else:
            raise ValueError(f"unknown transform {how!r}")
        frame = frame.withColumn(c, F.when(x.isNotNull(), value))
    return frame


def dataset(panel: DataFrame, factors: Sequence[str], horizons: Sequence[int], lag: int = 1, directions: Mapping[str, int] | None = None, entry: str = "close", feature_transform: str = "raw", target_transform: str = "raw", start: str | None = None, end: str | None = None) -> DataFrame:
    """``date, symbol``, each of ``factors`` and a label for each horizon, for every cell of a dense panel with a finite close.

    A factor is taken times its direction, only where the close is finite, and ``lag`` dates late. Labels are returns over
    observed bars: ``forward_return_{h}d`` from close to close or, with ``entry`` ``next_open``, ``next_open_return_{h}d``
    from the next open on. A target transform adds ``{label}_cs_{transform}``. Dates are cut to ``start`` to ``end`` last.
    """
    if lag < 1 or any(h < 1 for h in horizons):
        raise ValueError("lag and horizons must be positive")
    by = Window.partitionBy("symbol").orderBy("date")
    there = _finite("close").isNotNull()
    late = [F.lag(F.when(there, _finite(f) * (directions or {}).get(f, 1)), lag).over(by).alias(f) for f in factors]
    features = cross_section(panel.select("date", "symbol", there.alias("__there"), *late).where("__there").drop("__there"), factors, feature_transform)
    if entry == "close":
        price, label, first = "close", "forward_return_{}d", F.col("close")
    elif entry == "next_open":
        price, label, first = "open", "next_open_return_{}d", F.lead("open").over(by)
    else:
        raise ValueError(f"unknown entry {entry!r}")
    names = [label.format(h) for h in horizons]
    later = lambda h: F.lead(price, h + (entry == "next_open")).over(by)
    observed = panel.where(_finite(price).isNotNull())
    labels = observed.select("date", "symbol", *((F.when(first != 0, later(h) / first) - 1).alias(n) for h, n in zip(horizons, names)))
    if target_transform != "raw":
        known = labels.join(features.select("date", "symbol"), ["date", "symbol"], "left_semi")
        more = [f"{n}_cs_{target_transform}" for n in names]
        labels = cross_section(known.withColumns(dict(zip(more, map(F.col, names)))), more, target_transform)
    out = features.join(labels, ["date", "symbol"], "left")
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end is not None else out


def label_horizon(name: str) -> int | None:
    """Dates that a label looks ahead, by its name; None if the name doesn't tell."""
    m = re.fullmatch(r"(forward|next_open)_return_(\d+)d(_cs_(rank|zscore))?", name.strip().lower())
    return int(m[2]) + (m[1] == "next_open") if m else None


# ---------------------------------------------------------------- folds


@dataclass(frozen=True)
class Fold:
    """Dates to train on, those left out before the test, and those to test on."""

    train: tuple[datetime.date, ...]
    purge: tuple[datetime.date, ...]
    test: tuple[datetime.date, ...]


def _check(train: int, test: int, purge: int) -> None:
    if train <= 0 or test <= 0 or purge < 0:
        raise ValueError("train and test must be positive, purge not negative")


def folds_by_dates(dates: Iterable[datetime.date], train: int, test: int, purge: int = 0) -> list[Fold]:
    """Folds of so many dates each; the next fold begins ``test`` dates later. An incomplete last fold is left out."""
    _check(train, test, purge)
    days, whole = tuple(sorted(set(dates))), train + purge + test
    cut = lambda a: Fold(days[a : a + train], days[a + train : a + train + purge], days[a + train + purge : a + whole])
    return [cut(a) for a in range(0, len(days) - whole + 1, test)]


def folds_by_years(dates: Iterable[datetime.date], train: int = 3, test: int = 1, purge: int = 0) -> list[Fold]:
    """Folds of calendar years, one for each first test year whose years all have dates; the last ``purge`` dates before
    the test are not trained on."""
    _check(train, test, purge)
    by_year: dict[int, list[datetime.date]] = {}
    for d in sorted(set(dates)):
        by_year.setdefault(d.year, []).append(d)
    out = []
    for year in range(min(by_year, default=0) + train, max(by_year, default=0) - test + 2):
        if all(y in by_year for y in range(year - train, year + test)):
            past = [d for y in range(year - train, year) for d in by_year[y]]
            if len(past) > purge:
                edge = len(past) - purge
                out.append(Fold(tuple(past[:edge]), tuple(past[edge:]), tuple(d for y in range(year, year + test) for d in by_year[y])))
    return out


# ---------------------------------------------------------------- moments and models


@dataclass(frozen=True)
class Moments:
    """Number of rows, and means and centred cross products of the features, the target last."""

    n: float
    mean: np.ndarray
    cross: np.ndarray


def ridge(alpha: float = 1.0) -> Model:
    """Least squares with ``alpha`` times the squared coefficients; the intercept is free."""

    def fit(m: Moments) -> tuple[np.ndarray, float]:
        b = np.linalg.solve(m.cross[:-1, :-1] + alpha * np.eye(len(m.mean) - 1), m.cross[:-1, -1])
        return b, float(m.mean[-1] - b @ m.mean[:-1])

    return fit


def elastic_net(alpha: float = 0.001, l1_ratio: float = 0.5, max_iter: int = 10_000, tol: float = 1e-6) -> Model:
    """Coordinate descent over standardised features (one that doesn't vary is only centred): half the mean squared error
    plus ``alpha`` times the mix of absolute and half squared coefficients, until no coefficient moves more than ``tol``."""
    if alpha < 0 or not 0 <= l1_ratio <= 1 or max_iter <= 0 or tol <= 0:
        raise ValueError("alpha, l1_ratio, max_iter or tol out of range")

    def fit(m: Moments) -> tuple[np.ndarray, float]:
        scale = np.sqrt(np.maximum(np.diag(m.cross)[:-1], 0) / m.n)
        scale = np.where(scale > 1e-12, scale, 1.0)
        gram, target = m.cross[:-1, :-1] / m.n / np.outer(scale, scale), m.cross[:-1, -1] / m.n / scale
        b = np.zeros(len(scale))
        for _ in range(max_iter):
            most = 0.0
            for j in range(len(b)):
                rest = target[j] - gram[j] @ b + gram[j, j] * b[j]
                curve = gram[j, j] + alpha * (1 - l1_ratio)
                new = np.sign(rest) * max(abs(rest) - alpha * l1_ratio, 0.0) / curve if curve > 1e-12 else 0.0
                most, b[j] = max(most, abs(new - b[j])), new
            if most <= tol:
                break
        return b / scale, float(m.mean[-1] - (b / scale) @ m.mean[:-1])

    return fit


def _segments(folds: Sequence[Fold]) -> tuple[dict[datetime.date, int], list[set[int]]]:
    """The segment of each training date, and the segments of each fold."""
    of: dict[datetime.date, list[int]] = {}
    for k, f in enumerate(folds):
        for d in f.train:
            of.setdefault(d, []).append(k)
    ids: dict[tuple[int, ...], int] = {}
    segment = {d: ids.setdefault(tuple(ks), len(ids)) for d, ks in sorted(of.items())}
    return segment, [{s for ks, s in ids.items() if k in ks} for k in range(len(folds))]


def _partial(width: int, shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(k + 1).to_numpy(zero_copy_only=False) - shift[k] for k in range(width))])
            segment = batch.column(0).to_numpy(zero_copy_only=False)
            for s in np.unique(segment).tolist():
                part = x[segment == s]
                sums[s] = sums.get(s, 0.0) + part.T @ part
        for s, total in sums.items():
            size = total.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, s, np.int32)), pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())], names=["segment", "place", "value"])

    return run


def fold_moments(rows: DataFrame, columns: Sequence[str], folds: Sequence[Fold]) -> list[Moments | None]:
    """Each fold's moments of ``columns`` (the target last) over its training rows; None for a fold without any. ``rows`` has
    no missing values in them. Values are taken from the means over all rows, so large means cost no digits."""
    spark, (segment, of_fold) = rows.sparkSession, _segments(folds)
    shift = np.array([x or 0.0 for x in rows.agg(*(F.avg(c) for c in columns)).first()])
    days = spark.createDataFrame(list(segment.items()), "date date, __segment int")
    known = rows.join(F.broadcast(days), "date").select("__segment", *(F.col(c).cast("double") for c in columns))
    sums = known.mapInArrow(_partial(len(columns), shift), "segment int, place int, value double").groupBy("segment", "place").agg(F.sum("value").alias("value"))
    side = len(columns) + 1
    total = np.zeros((len(set(segment.values())), side * side))
    for r in sums.collect():  # segments x columns squared
        total[r["segment"], r["place"]] = r["value"]
    out: list[Moments | None] = []
    for parts in of_fold:
        m = total[sorted(parts)].sum(axis=0).reshape(side, side)
        n, s = m[0, 0], m[0, 1:]
        out.append(Moments(n, shift + s / n, m[1:, 1:] - np.outer(s, s) / n) if n else None)
    return out


def walk_forward(frame: DataFrame, features: Sequence[str], target: str, folds: Sequence[Fold], model: Model) -> DataFrame:
    """``date, symbol, {target}, score, fold``: each fold's test rows scored by the model of its training rows. Rows with a
    missing or infinite feature or target are left out of both; a fold without training rows scores nothing."""
    columns = [*features, target]
    rows = frame.select("date", "symbol", *(_finite(c).alias(c) for c in columns)).dropna()
    fitted = [(k, model(m)) for k, m in enumerate(fold_moments(rows, columns, folds)) if m is not None]
    days = [(d, k, [float(x) for x in b], float(b0)) for k, (b, b0) in fitted for d in folds[k].test]
    models = frame.sparkSession.createDataFrame(days, "date date, fold int, __b array<double>, __b0 double")  # a row a test date
    score = sum((F.col("__b")[k] * F.col(c) for k, c in enumerate(features)), F.col("__b0"))
    return rows.join(F.broadcast(models), "date").select("date", "symbol", target, score.alias("score"), "fold")


def prediction_metrics(predictions: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """For each group of ``by``: count, mse, mae, pearson (null where either side doesn't vary), the mean of the dates' rank
    correlations and the number of such dates (two rows and two different values on either side at least)."""
    y, s = F.col(target), F.col("score")
    key = [*by, "date"]
    day = Window.partitionBy(*key)
    rank = lambda c: F.rank().over(day.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*key, c)) - 1) / 2
    ranked = predictions.where(y.isNotNull() & s.isNotNull()).select(*key, y.alias("y"), s.alias("s"), rank(target).alias("ry"), rank("score").alias("rs"))
    corr = lambda a, b: F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    daily = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), corr("ry", "rs").alias("ic"), F.sum((F.col("s") - F.col("y")) ** 2).alias("se"), F.sum(F.abs(F.col("s") - F.col("y"))).alias("ae"))
    pooled = ranked.groupBy(*by).agg(corr("y", "s").alias("pearson"))
    n = F.sum("n")
    totals = daily.groupBy(*by).agg(n.alias("count"), (F.sum("se") / n).alias("mse"), (F.sum("ae") / n).alias("mae"), F.avg("ic").alias("rank_ic_mean"), F.count("ic").alias("rank_ic_date_count"))
    both = totals.join(pooled, list(by)) if by else totals.join(F.broadcast(pooled), F.lit(True))  # one row each
    return both.select(*by, "count", "mse", "mae", "pearson", "rank_ic_mean", "rank_ic_date_count")
