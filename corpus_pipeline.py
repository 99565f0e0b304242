"""A corpus pipeline: language ID, line dedup, near-duplicate documents, source mixing and tokens, over `documents`.

Each stage's rows are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import stages
from panelspark.llm.shared import written

STAGES = [
    ("language_id", stages.keep_identified),
    ("line_dedup", stages.drop_repeated_lines),
    ("ngram_join", stages.keep_one_of_each_group),
    ("source_mixing", stages.mix_sources),
    ("bpe", stages.encode_tokens),
]

#: SQL can't express a trained network, so none can check the whole; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
