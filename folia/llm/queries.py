"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import documents, light_batches


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.packing import packed_checksums

    light_batches(spark)
    return packed_checksums(documents(spark, sf_dir))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.prefix_bpe import round_trip

    light_batches(spark)
    return round_trip(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.quality import verdicts

    return verdicts(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.pii import replaced

    return replaced(documents(spark, sf_dir).select("doc_id", "text"))


def op6_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.licences import scanned

    return scanned(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.jaccard import linked

    light_batches(spark)
    return linked(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.lines import line_digests

    light_batches(spark)
    return line_digests(documents(spark, sf_dir), edits=None, least=1)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.exact import deduplicated

    light_batches(spark)
    return deduplicated(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folia.llm.secrets import secrets

    return secrets(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_packed_ids, op3_prefix_bpe, op4_quality_rules, op5_pii_surrogates, op6_licence_digests, op7_ngram_jaccard_join, op8_line_dedup, op9_exact_dedup, op10_secret_scan)}
