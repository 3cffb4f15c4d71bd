"""Sections, captions and metadata of a paper from its lines and text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import FIGURE_CAPTION_EN, FIGURE_CAPTION_ZH, FIGURE_NAMES, FILL_WORDS, HEAD_ARXIV, HEAD_DOI, HEAD_YEAR, HEADINGS, NO_TITLE, TABLE_CAPTION_EN, TABLE_CAPTION_ZH


def heading(line: Column, longest: int) -> Column:
    """Section that a line is the heading of, or NULL; the first matching pattern decides."""
    found = None
    for pattern, name in HEADINGS:
        hit = line.rlike(f"(?iU)^(?:{pattern})")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.when(F.length(line) <= longest, found)


def boundaries(lines: DataFrame) -> DataFrame:
    """The lines with ``heading``: by pattern, or, in a paper with fewer than two, among its larger lines.

    lines: paper_idx, line_no, text, font_size (NULL counts as size 10).
    """
    size = F.coalesce("font_size", F.lit(10.0))
    paper = Window.partitionBy("paper_idx")
    sizes = F.sort_array(F.collect_set(size).over(paper))
    marked = lines.withColumn("by_pattern", heading(F.col("text"), 50)).withColumn("sizes", sizes)
    median = F.get("sizes", F.floor(F.size("sizes") / 2).cast("int"))
    by_font = F.when(size > median * 1.05, heading(F.col("text"), 60))
    marked = marked.withColumn("by_font", by_font).withColumn("n", F.count("by_pattern").over(paper))
    return marked.select("paper_idx", "line_no", "text", "font_size", F.when(F.col("n") < 2, F.col("by_font")).otherwise(F.col("by_pattern")).alias("heading"))


def segmented(lines: DataFrame) -> DataFrame:
    """(paper_idx, section_name, text): text between headings; of a repeated heading the last non-empty text.

    A paper without headings is all introduction; lines before the first heading belong to none.
    """
    order = Window.partitionBy("paper_idx").orderBy("line_no")
    placed = boundaries(lines).withColumn("part", F.count("heading").over(order)).withColumn("section_name", F.last("heading", True).over(order))
    whole = Window.partitionBy("paper_idx")
    placed = placed.withColumn("headings", F.count("heading").over(whole))
    body = placed.where("heading IS NULL AND (part > 0 OR headings = 0)").withColumn("section_name", F.coalesce("section_name", F.lit("introduction")))
    parts = body.groupBy("paper_idx", "section_name", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return parts.groupBy("paper_idx", "section_name").agg(F.max_by("text", "part").alias("text"))


def filled_sections(rows: DataFrame, delimiter: str = "\n\n", most: int = 5) -> DataFrame:
    """(paper_idx, section_name, text): text for the empty ones of four sections, the best paragraphs of full_text."""
    names = list(FILL_WORDS)
    blocks = rows.select("paper_idx", *names, F.posexplode(F.split("full_text", delimiter)).alias("pos", "block"))
    score = lambda words: sum((F.contains(F.lower("block"), F.lit(w)).cast("int") for w in words), F.lit(0))
    votes = F.array(*(F.struct(F.lit(n).alias("section_name"), F.col(n).alias("own"), score(FILL_WORDS[n]).alias("score")) for n in names))
    voted = blocks.select("paper_idx", "pos", "block", F.explode(votes).alias("v")).select("paper_idx", "pos", "block", "v.*").where("length(own) = 0 AND score > 0")
    best = voted.withColumn("rank", F.row_number().over(Window.partitionBy("paper_idx", "section_name").orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= most)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "block")))
    return best.groupBy("paper_idx", "section_name").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), delimiter).alias("text"))


def captions(rows: DataFrame, kind: str = "figure") -> DataFrame:
    """(paper_idx, index, caption): English captions of full_text first, then Chinese; numbered as found."""
    english, chinese = (FIGURE_CAPTION_EN, FIGURE_CAPTION_ZH) if kind == "figure" else (TABLE_CAPTION_EN, TABLE_CAPTION_ZH)
    found = F.concat(F.regexp_extract_all("full_text", F.lit("(?siU)" + english), 1), F.regexp_extract_all("full_text", F.lit("(?sU)" + chinese), 1))
    return rows.select("paper_idx", F.posexplode(found).alias("i", "caption")).select("paper_idx", (F.col("i") + 1).cast("long").alias("index"), T.strip(F.col("caption")).alias("caption"))


def figure_discussions(rows: DataFrame, delimiter: str = "\n\n") -> DataFrame:
    """(paper_idx, index, pos, paragraph): paragraphs of full_text that name a figure's number in one of six spellings."""
    numbered = rows.select("paper_idx", "full_text", F.explode(F.array_distinct(F.transform("figures", lambda f: f["index"]))).alias("index")).where("index IS NOT NULL")
    blocks = numbered.select("paper_idx", F.col("index").cast("long").alias("index"), F.posexplode(F.split("full_text", delimiter)).alias("pos", "block"))
    names = F.array(*(F.concat(F.lit(s), F.col("index").cast("string")) for s in FIGURE_NAMES))
    return blocks.where(F.exists(names, lambda n: F.contains("block", n))).select("paper_idx", "index", F.col("pos").cast("long").alias("pos"), T.strip(F.col("block")).alias("paragraph"))


def metadata(rows: DataFrame) -> DataFrame:
    """(paper_idx, title, doi, source, year) read from full_text; NULL where nothing was found."""
    text = F.col("full_text")
    head = F.left(text, F.lit(2000))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 30), T.strip)
    skipped = lambda s: reduce(or_, (F.startswith(s, F.lit(x)) for x in NO_TITLE))
    title = F.get(F.filter(lines, lambda s: (F.length(s) > 20) & ~skipped(s)), F.lit(0))
    found = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    arxiv = found("(?U)" + HEAD_ARXIV)
    source = F.when(arxiv.isNotNull() & ~F.startswith("source", F.lit("10.")), F.concat(F.lit("arXiv:"), arxiv)).otherwise(F.col("source"))
    return rows.select("paper_idx", title.alias("title"), found("(?U)" + HEAD_DOI).alias("doi"), source.alias("source"), found("(?U)" + HEAD_YEAR).cast("int").alias("year"))


def deduplicated(rows: DataFrame, order: list[str], loaded: DataFrame | None = None) -> DataFrame:
    """The first row of each source in load order, without sources that are already loaded.

    The first row is an aggregate, so of a source that holds a third of all rows one row a task is shuffled.
    """
    if loaded is not None:
        rows = rows.join(loaded.select("source").distinct(), "source", "left_anti")
    first = rows.groupBy("source").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first"))
    return first.select(*(F.col("first")[c].alias(c) for c in rows.columns))
