"""Mixing sources to target weights by capped water-filling, with whole and fractional repetitions.

All sources share a budget of words by weight. A source whose share exceeds its words times the most epochs is clamped
there and its excess is shared among the others by weight, until none is above. In closed form: with sources ordered by
cap / weight, one is clamped if the level that would serve it and all after it, (budget - caps before) / (weights from
it on), is at or above its own cap / weight; the level of the first that isn't serves the rest.

A source repeats each of its documents floor(target / words) times. What is missing then goes, in the order of a seeded
hash, to one more whole repetition of document after document, and the last of these gives only as many of its leading
words as still lack. So each source's words come within half a word of its target, a document gives at most one
repetition more than another of its source, and reruns agree.

The order is found without sorting a source: its documents fall into 4096 bins of the hash, sums by bin tell the bin in
which the target is met, and only that bin's documents are put in order.

A word is a run of characters outside 0x20 and 0x09-0x0D. Null, empty and word-less texts have size 0 and are not
repeated. A null source is a source of its own, the last. Rows that repeat a doc_id count each; ties of the hash go by
doc_id, then size. An empty table gives an empty mix. Extra columns pass through ``mix`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.shared import bounded, tidy, written
from panelspark.llm.tokens import pieces, text_buffer, word_spans

WEIGHTS, BUDGET, MOST_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def _with_size(docs: DataFrame, text: str, keep_text: bool) -> DataFrame:
    names = [c for c in docs.columns if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in pieces(batch, text):
                data, offsets = text_buffer(t.column(text))
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in names), pa.array(np.diff(word_spans(data, offsets)[2]))], names=[*names, "__size"])

    return bounded(docs).mapInArrow(tidy(run), T.StructType([docs.schema[c] for c in names] + [T.StructField("__size", T.LongType())]))


def _place(doc: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))))


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for one row ``source, source_size`` of each source; weights repeat over the sources by code point, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((at - 1) % len(weights) + 1).cast("int"))
    every, up, on = Window.partitionBy(), Window.orderBy("ratio", F.col("source").isNull(), "source"), Window.orderBy(F.desc("ratio"), F.col("source").isNull().desc(), F.desc("source"))
    x = totals.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    x = x.withColumn("onward", F.sum("weight").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(budget)) - F.col("before")) / F.col("onward"))
    x = x.withColumn("clamped", F.col("level") >= F.col("ratio"))
    x = x.withColumn("common", F.min(F.when(~F.col("clamped"), F.struct("ratio", "level"))).over(every)["level"])
    return x.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _plan(sizes: DataFrame, weights, budget, most_epochs) -> DataFrame:
    """For each source its target, whole repetitions, and the bin in which one more repetition ends and the words it still takes there."""
    bins = written(sizes.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, budget, most_epochs)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    steps = bins.withColumn("before", upto - F.col("bin_size")).join(goal.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    met = steps.where("rest > before and rest <= before + bin_size").select(F.col("source").alias("s"), F.col("bin").alias("met_bin"), (F.col("rest") - F.col("before")).alias("met_rest"))
    return written(goal.join(met, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("met_bin", F.lit(-1)).alias("met_bin"), F.coalesce("met_rest", F.lit(0)).alias("met_rest")), "mix-plan")


def _taken(rows: DataFrame, plan: DataFrame, doc: str, source: str, size: str) -> DataFrame:
    """Adds source_size, target and taken. ``rows`` has bin and place beside the columns named."""
    p = plan.withColumnRenamed("source", "__source")
    x = rows.join(p, F.col(source).eqNullSafe(F.col("__source"))).drop("__source")
    upto = F.sum(size).over(Window.partitionBy(source).orderBy("place", F.col(doc).isNull(), doc, size).rowsBetween(Window.unboundedPreceding, -1))
    edge = x.where(F.col("bin") == F.col("met_bin")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col(size), F.col("met_rest") - F.coalesce(upto, F.lit(0)))))
    plain = x.where(F.col("bin") != F.col("met_bin")).withColumn("extra", F.when(F.col("bin") < F.col("met_bin"), F.col(size)).otherwise(F.lit(0)))
    return plain.unionByName(edge).withColumn("taken", F.col("whole") * F.col(size) + F.col("extra"))


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """Each row's ``doc_id, source, size, source_size, target, taken`` (words that the mix takes of it, repeats counted)."""
    sizes = _with_size(docs.select("doc_id", "source", F.col("text").cast("string").alias("text")), "text", False)
    sizes = written(sizes.select("doc_id", "source", F.col("__size").alias("size"), _place(F.col("doc_id"), seed).alias("place")).withColumn("bin", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")), "mix-sizes")
    plan = _plan(sizes, weights, budget, most_epochs)
    return _taken(sizes, plan, "doc_id", "source", "size").select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken; a fractional repetition has the leading words of its text only."""
    names = docs.columns
    doc, source, text = (f"c{names.index(c)}" for c in ("doc_id", "source", "text"))
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    rows = _with_size(plain, text, True).withColumn("place", _place(F.col(doc), seed)).withColumn("bin", F.conv(F.substring("place", 1, 3), 16, 10).cast("int"))
    sizes = written(_with_size(plain.select(doc, source, text), text, False).select(F.col(source).alias("source"), F.col("__size").alias("size"), F.conv(F.substring(_place(F.col(doc), seed), 1, 3), 16, 10).cast("int").alias("bin")), "mix-sizes")
    taken = _taken(rows, _plan(sizes, weights, budget, most_epochs), doc, source, "__size").where("taken > 0")
    times = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("__size"))), lambda k: F.least(F.col("__size"), F.col("taken") - (k - 1) * F.col("__size")))
    each = taken.withColumn("__words", F.explode(times))
    types = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, words = batch.column("__size"), batch.column("__words")
            part = pc.less(words, size).to_numpy(zero_copy_only=False).nonzero()[0]
            texts = batch.column(text)
            if len(part):
                all_ = texts.to_pylist()
                for i in part.tolist():
                    data, offsets = text_buffer(pa.array([all_[i]], pa.string()))
                    end = word_spans(data, offsets)[1][words[i].as_py() - 1]
                    all_[i] = data[:end].tobytes().decode()
                texts = pa.array(all_, pa.string())
            yield pa.RecordBatch.from_arrays([texts if f"c{k}" == text else batch.column(f"c{k}") for k in range(len(names))], names=[f"c{k}" for k in range(len(names))])

    out = each.select(*(f"c{k}" for k in range(len(names))), "__size", "__words").mapInArrow(tidy(run), T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(types)]))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


SIZES_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM words GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM totals),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS k FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ordered),
goals AS (
  SELECT source, source_size,
         CASE WHEN level >= cap / weight THEN cap
              ELSE (SELECT arg_min(level, k) FROM levels WHERE level < cap / weight) * weight END AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM goals),
rests AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM parts)
SELECT w.doc_id, w.source, w.size, r.source_size, r.target,
       r.whole * w.size + greatest(0, least(w.size, r.rest - coalesce(sum(w.size) OVER (
         PARTITION BY w.source ORDER BY w.place, w.doc_id IS NULL, w.doc_id, w.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM words w JOIN rests r ON w.source IS NOT DISTINCT FROM r.source
"""
