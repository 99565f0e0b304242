"""Where intermediate tables live, and how texts are dealt to blocks of bounded size."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a block holds on average; one Python worker has one block in memory.
BLOCK_BYTES = 8 << 20
#: Bytes of rows that are handed to a Python worker at once.
BATCH_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. A session of one machine that names none gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        pass


def tidy(run: Callable, *caches: Callable) -> Callable:
    """``run``, a function of batches or of one or two groups, that hands its memory back when it ends: Python workers
    outlive their tasks, and what they keep adds up over the stages of a job. ``caches`` are emptied too."""

    def done() -> None:
        for c in caches:
            c.cache_clear()
        _give_back()

    def batches(b):
        yield from run(b)
        done()

    def one(t):
        out = run(t)
        done()
        return out

    def keyed(key, a, b):
        out = run(key, a, b)
        done()
        return out

    if run.__code__.co_flags & 0x20:  # a generator function
        return batches
    return keyed if run.__code__.co_argcount == 3 else one


def bounded(df: DataFrame) -> DataFrame:
    """``df``, from now on handed to Python in batches of a few MB, however long its texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files when it ends, not whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read from there: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _own_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.panelspark_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Delete written tables that no plan will read again."""
    for t in tables:
        spark = t.sparkSession
        if name := getattr(t, "panelspark_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(t.panelspark_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks hold all texts; at least 1."""
    total = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_bytes))


def dealt(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """Adds ``__row``, a hash of key and text, and ``__block``, dealt by it and by the input partition, so that rows that
    repeat one key and text (or have neither) are spread over blocks too."""
    out = docs.withColumn("__row", F.xxhash64(key, text))
    return out.withColumn("__block", F.pmod(F.xxhash64("__row", F.spark_partition_id()), F.lit(blocks)).cast("int"))


def blocked_table(df: DataFrame, by: str, blocks: int) -> DataFrame:
    """``df``, written to the shared folder in buckets of ``by``: what groups by it reads whole groups without a shuffle."""
    spark = df.sparkSession
    name = f"panelspark_{uuid.uuid4().hex}"
    buckets = min(blocks, 50_000)
    with _own_shuffles(spark):
        df.repartition(buckets, by).write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, by).saveAsTable(name)
    out = spark.table(name)
    out.panelspark_path, out.panelspark_table = f"{shared_dir(spark)}/{name}", name
    return out
