"""Driver queries of this package's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.sentences import sentence_table

    return sentence_table(table(spark, sf_dir, "paper"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.languages import mislabelled_blocks

    return mislabelled_blocks(table(spark, sf_dir, "paper"))


def p2_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.languages import paper_languages

    return paper_languages(table(spark, sf_dir, "paper"))


def p2_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.languages import language_stretches

    return language_stretches(table(spark, sf_dir, "paper"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.scans import scan_repairs

    return scan_repairs(table(spark, sf_dir, "paper"))


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.scans import repaired_texts

    return repaired_texts(table(spark, sf_dir, "paper"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "paper"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.duplicates import near_duplicate_groups

    return near_duplicate_groups(table(spark, sf_dir, "paper"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.names import name_variants

    return name_variants(table(spark, sf_dir, "paper"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.names import author_entities

    return author_entities(table(spark, sf_dir, "paper"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.spans import shared_spans

    return shared_spans(table(spark, sf_dir, "paper"))


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.spans import shared_share

    return shared_share(table(spark, sf_dir, "paper"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.leakage import leaked_items

    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.toxicity import found_content

    return found_content(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_rating"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.toxicity import content_scores

    return content_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_rating"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.llm.toxicity import content_rates

    return content_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_rating"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_papers, p2_segments, p3_found, p3_texts, p4_found, p4_groups, p5_found, p5_entities, p6_found, p6_share, p7_ids, p8_found, p9_found, p9_scores, p9_rates)}


def oracle_sql() -> dict[str, str]:
    from paperloom.llm.oracle import ORACLE

    return dict(ORACLE)
