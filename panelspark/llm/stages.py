"""The stages of the corpus pipeline: each applies one operator to all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is rejected when its best language is less probable than this, as one without letters is. None of the
#: 51,282 documents of check_s scores below 0.42; at 0.6 the stage rejected 146 of them, most of them ordinary prose.
LEAST_LANGUAGE_SCORE = 0.4


def _own_names(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` under names of its own, c0, c1 ..., but for ``kept``: no name clashes with what an operator adds."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in kept else f"c{k}") for k, c in enumerate(docs.columns)))


def _given_names(out: DataFrame, docs: DataFrame, *kept: str) -> DataFrame:
    return out.select(*(F.col(c if c in kept else f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, empty ones and texts without letters go. Rows, columns and texts stay
    as they are, repeated rows too; an empty table stays empty."""
    from panelspark.llm.language_id import fit, predicted

    told = predicted(_own_names(docs, "text"), fit(docs), "text")
    return _given_names(told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs, "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble an earlier one's; those of which no word is left go, so copies go whole.
    n_chars follows the text. Null and empty texts stay; of equal lines the one of the smallest id stays, a null id's last."""
    from panelspark.llm.line_dedup import dedup_lines

    kept = ("doc_id", "text")
    clean = dedup_lines(_own_names(docs, *kept), report=True)
    gone = (F.col("n_removed") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = clean.where(~gone)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return _given_names(out, docs, *kept)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram join the one of smallest id; documents without words or id all stay, as do rows
    that repeat the id that stays."""
    from panelspark.llm.ngram_join import ngram_join
    from panelspark.llm.shared import written

    joined = ngram_join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("copy_id")).distinct()
    copies = written(joined, "copies")
    plain = _own_names(docs, "doc_id")
    return _given_names(plain.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti"), docs, "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a document stands as often as it is taken, one without words not at all. n_chars follows
    texts that are taken in part. A null source is one of its own; an empty table stays empty."""
    from panelspark.llm.mixing import mix

    out = mix(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, n_tokens, token_ids`` of each row; a null or empty text has no tokens. Other columns go."""
    import public_tokenizers

    from panelspark.llm.bpe import encode

    out = encode(docs.select("doc_id", "source", "lang", "text"), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")
