"""Token counts: totals by source, language and tokenizer version, kept up to date by signed deltas.

A ledger is a folder of the shared file system with two Parquet tables: ``deltas``, one folder for each committed batch,
and ``batches``, one marker for each. A batch holds per-document changes ``(doc_id, source, lang, version, op,
n_tokens, old_tokens)``: an insert adds a document and its tokens, a delete takes both away, a revision adds the
difference. Each batch is pre-aggregated to signed sums by key before it is stored, so a hot source is one row a task
and key; totals are sums of these rows, in any order.

Commits are idempotent. A batch's rows are written under its own name, whole, before its marker; a reader takes only
rows of marked batches. A batch that is already marked is skipped, and one that was cut short is written over, so a
retried job changes nothing twice. ``compact`` folds all marked batches into one base batch under the same rules.

Null sources and languages are keys of their own. Null texts have no tokens but count as documents. An insert, delete or
revision with a null count adds nothing for it. Unknown kinds of change are an error. Rows that repeat a document each count Extra columns of a change table are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded

KEYS = ["source", "lang", "version"]
_DELTA = "source string, lang string, version string, documents long, tokens long, batch string"
_MARK = "batch string, rows long, covers array<string>"


class Ledger:
    """Committed batches of signed sums under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.folder}/{kind}/batch={hashlib.sha256(batch.encode()).hexdigest()}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(self._path("batches", batch) + "/_SUCCESS")

    def _store(self, sums: DataFrame, batch: str, covers: list[str]) -> None:
        path = self._path("deltas", batch)
        sums.withColumn("batch_name", F.lit(batch)).write.mode("overwrite").parquet(path)
        mark = self.spark.range(1).select(F.lit(batch).alias("batch_name"), F.array(*map(F.lit, covers)).cast("array<string>").alias("covers"))
        mark.coalesce(1).write.mode("overwrite").parquet(self._path("batches", batch))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if it is there already."""
        if self.committed(batch):
            return False
        self._store(signed_sums(changes), batch, [])
        return True

    def _live(self) -> list[str]:
        """Marked batches that no base covers; a row a batch, few by compaction."""
        if not self._exists(f"{self.folder}/batches"):
            return []
        marks = self.spark.read.parquet(f"{self.folder}/batches").select("batch_name", "covers").collect()
        covered = {c for m in marks for c in m["covers"]}
        return sorted(m["batch_name"] for m in marks if m["batch_name"] not in covered)

    def totals(self) -> DataFrame:
        """``source, lang, version, documents, tokens`` of all committed batches; keys whose sums are both 0 are gone."""
        live = self._live()
        if not live:
            return self.spark.createDataFrame([], "source string, lang string, version string, documents long, tokens long")
        return self._totals_of(live).where("documents <> 0 or tokens <> 0")

    def _totals_of(self, batches: list[str]) -> DataFrame:
        return _summed(self.spark.read.parquet(*(self._path("deltas", b) for b in batches)))

    def compact(self, name: str) -> None:
        """Folds the batches that are marked now into the base batch ``name``; what is committed meanwhile stays beside it."""
        if self.committed(name):
            return
        live = self._live()
        if live:
            self._store(self._totals_of(live), name, live)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def signed_sums(changes: DataFrame) -> DataFrame:
    """Signed documents and tokens by key of a table of changes."""
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).otherwise(n - old)
    return _summed(changes.select(*KEYS, sign.cast("long").alias("documents"), tokens.cast("long").alias("tokens")))


@functools.lru_cache(maxsize=4)
def _tiktoken(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """A row for each document and tokenizer version (name: path of its ranks): ``doc_id, source, lang, version, n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                t = b.slice(a, 500)
                texts = t.column(3).to_pylist()
                for name, path in versions.items():
                    e = _tiktoken(path, pattern)
                    n = [len(e.encode_ordinary(x)) if x else 0 for x in texts]
                    yield pa.RecordBatch.from_arrays([*t.columns[:3], pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "version", "n_tokens"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return bounded(thin).mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")
