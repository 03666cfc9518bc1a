"""The corpus pipeline over documents: quality rules, line dedup, near-copy removal, source mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame. The columns are
those of documents, but for the last stage, which adds token_ids and n_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import light_batches
from folia.llm.jaccard import representatives
from folia.llm.lines import without_repeats
from folia.llm.mixing import mixed
from folia.llm.prefix_bpe import encoded
from folia.llm.quality import kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the likelihood ratio reject go."""
    return kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies of earlier lines go from the texts; n_chars follows the text."""
    light_batches(spark)
    out = without_repeats(docs, edits=None, least=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    light_batches(spark)
    return representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with their token ids."""
    light_batches(spark)
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("bpe_encoding", bpe_encoding),
]

#: SQL can't express the edit join of lines or the prefix tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
