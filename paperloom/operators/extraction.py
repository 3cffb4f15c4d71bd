"""Dictionary and pattern extraction: problem statements, open questions, gaps, methods, figure types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import FIGURE_TYPES, GAP_PATTERNS, METHOD_WORDS, PROBLEM_WORDS_EN, PROBLEM_WORDS_ZH, QUESTION_PATTERNS
from paperloom.operators.corpus import section_sentences, sections


def problem_sentences(rows: DataFrame) -> DataFrame:
    """(paper_idx, section_ord, section_name, pos, sentence, keyword): one row for each distinct beginning of 80 characters."""
    found = section_sentences(sections(rows, ["abstract", "introduction", "discussion", "conclusion"]), 6)
    english, both = T.first_match(F.col("sentence"), PROBLEM_WORDS_EN), T.first_match(F.col("sentence"), PROBLEM_WORDS_EN + PROBLEM_WORDS_ZH)
    found = found.withColumn("keyword", F.when(F.col("language").isin("zh", "mixed"), both).otherwise(english)).where("keyword IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("paper_idx", F.lower(F.left("sentence", F.lit(80)))).orderBy("section_ord", "pos"))
    return found.withColumn("n", first).where("n = 1").select("paper_idx", "section_ord", "section_name", F.col("pos").cast("long").alias("pos"), "sentence", "keyword")


def question_sentences(rows: DataFrame, patterns: list[str] = QUESTION_PATTERNS) -> DataFrame:
    """(paper_idx, section_ord, section_name, pos, sentence): each text once a paper."""
    found = section_sentences(sections(rows, ["discussion", "conclusion", "introduction"]), 31).where(T.any_pattern(F.col("sentence"), patterns))
    first = F.row_number().over(Window.partitionBy("paper_idx", "sentence").orderBy("section_ord", "pos"))
    return found.withColumn("n", first).where("n = 1").select("paper_idx", "section_ord", "section_name", F.col("pos").cast("long").alias("pos"), "sentence")


def gap_sentences(rows: DataFrame) -> DataFrame:
    """(paper_idx, section_ord, section_name, pos, text): repeated texts are kept; at most 500 characters."""
    found = section_sentences(sections(rows, ["discussion", "conclusion", "introduction"]), 31).where(T.any_pattern(F.col("sentence"), GAP_PATTERNS))
    return found.select("paper_idx", "section_ord", "section_name", F.col("pos").cast("long").alias("pos"), F.left("sentence", F.lit(500)).alias("text"))


def method_presence(rows: DataFrame, least: int = 2) -> DataFrame:
    """(method_ord, method, paper_idx, present): a method row where at least ``least`` papers contain it.

    The words are tested in one narrow pass; only hits are counted, the 0/1 grid is made last.
    """
    low = F.lower("full_text")
    words = F.array(*(F.struct(F.lit(i).alias("method_ord"), F.lit(w).alias("method")) for i, w in enumerate(METHOD_WORDS)))
    hits = rows.select("paper_idx", F.explode(F.filter(words, lambda w: F.contains(low, F.lower(w["method"])))).alias("w")).select("paper_idx", "w.*")
    kept = hits.groupBy("method_ord", "method").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    grid = F.broadcast(kept).crossJoin(rows.select("paper_idx"))  # at most one row a word of the fixed list
    return grid.join(hits.select("paper_idx", "method_ord", F.lit(1).alias("hit")), ["paper_idx", "method_ord"], "left").select("method_ord", "method", "paper_idx", F.coalesce("hit", F.lit(0)).alias("present"))


def figure_type_hits(figures: DataFrame) -> DataFrame:
    """(paper_idx, type_ord, figure_type): a row for each figure and type of its caption."""
    low = F.lower("caption")
    tests = F.array(*(F.struct(F.lit(i).alias("type_ord"), F.lit(n).alias("figure_type"), F.array(*(F.lit(w.lower()) for w in words)).alias("words")) for i, (n, words) in enumerate(FIGURE_TYPES)))
    hits = F.filter(tests, lambda t: F.exists(t["words"], lambda w: F.contains(low, w)))
    return figures.select("paper_idx", F.explode(hits).alias("t")).select("paper_idx", "t.type_ord", "t.figure_type")


def figure_types(figures: DataFrame, least: int = 2) -> DataFrame:
    """(type_ord, figure_type, paper_count, total_figures) of the types that at least ``least`` papers have."""
    counted = figure_type_hits(figures).groupBy("type_ord", "figure_type").agg(F.countDistinct("paper_idx").alias("paper_count"), F.count("*").alias("total_figures"))
    return counted.where(F.col("paper_count") >= least)
