"""The driver's queries over these operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.mixing import SIZES_SQL
from panelspark.llm.warc import RECORDS_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.language_model import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.vector_graph import link

    return link(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.language_id import identify

    return identify(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from panelspark.llm.bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op5_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.media import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"), report=True).select("doc_id", "n_lines", "n_removed", "text")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.mixing import mix_sizes

    return mix_sizes(_table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents"))


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents' counts by two tokenizer versions as inserts, takes the toxic ones down, gives those of good quality an end token, and
    commits the takedown a second time, which must change nothing."""
    import uuid

    import public_tokenizers

    from panelspark.llm.shared import shared_dir, written
    from panelspark.llm.token_rollup import Ledger, count_tokens

    versions = {v: str(public_tokenizers.path(f"{v}.tiktoken")) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    counts = written(count_tokens(_table(spark, sf_dir, "documents"), versions, public_tokenizers.PATTERN), "token-counts")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    labelled = counts.join(labels, "doc_id")
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.commit("load", counts.select("*", F.lit("insert").alias("op"), F.lit(None).cast("long").alias("old_tokens")))
    takedown = labelled.where("toxic = 1").select("*", F.lit("delete").alias("op"), F.lit(None).cast("long").alias("old_tokens"))
    ledger.commit("takedown", takedown)
    recount = labelled.where("quality = 1 and not coalesce(toxic = 1, false)").select(*counts.columns[:-1], (F.col("n_tokens") + 1).alias("n_tokens"), F.lit("revise").alias("op"), F.col("n_tokens").alias("old_tokens"))
    ledger.commit("recount", recount)
    ledger.commit("takedown", takedown)
    return ledger.totals()


def op10_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelspark.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_lm_scoring": op3_lm_scoring,
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_media_jpeg": op5_media_jpeg,
    "op6_line_dedup": op6_line_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_rollup": op9_token_rollup,
    "op10_warc_writer": op10_warc_writer,
}

ORACLE_SQL: dict[str, str] = {"op7_source_mixing": SIZES_SQL, "op10_warc_writer": RECORDS_SQL}
