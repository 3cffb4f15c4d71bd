"""The corpus relations: papers, sections, lines, sentences, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.dictionaries import SECTIONS
from paperloom.session import table

HELD_KEYS = 500_000  # keys delivered more than once that are broadcast, some 20 MB


def once(rows: DataFrame, key: str, held: int = HELD_KEYS) -> DataFrame:
    """The rows of files with one row a key: the first, by file and place, of those delivered again.

    Only keys and places are shuffled. The keys delivered more than once are counted; up to
    ``held`` of them are broadcast and the texts stay where they are, beyond that rows meet by key.
    Rows without a key are left out.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    places = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), place.alias("_place"))
    again = places.groupBy("_key").agg(F.min("_place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    found = again.limit(held + 1).collect()  # of bounded number
    placed = rows.where(F.col(key).isNotNull()).withColumn("_place", place)
    if not found:
        return placed.drop("_place")
    if len(found) <= held:
        again = F.broadcast(rows.sparkSession.createDataFrame(found, again.schema))
    return placed.join(again, placed[key] == again["_key"], "left").where("_first IS NULL OR _first = _place").drop("_key", "_first", "_place")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores: a table of fewer parts than the session has cores is dealt out, others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def papers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a paper; missing texts are empty. Only the wanted columns are read; no text is shuffled unless the table has fewer parts than there are cores."""
    paper = table(spark, sf_dir, "paper")
    wanted = columns or tuple(c for c in paper.columns if c not in ("text_hash", "loaded_at"))
    rows = spread(once(paper, "paper_idx").select("paper_idx", *(c for c in wanted if c != "paper_idx")))
    strings = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    return rows.select(*(T.text_of(c).alias(c) if c in strings else F.col(c) for c in rows.columns))


def sections(rows: DataFrame, names: list[str] = SECTIONS) -> DataFrame:
    """(paper_idx, section_ord, section_name, text, other columns): long form of the non-empty sections."""
    rest = [c for c in rows.columns if c not in SECTIONS]
    items = F.array(*(F.struct(F.lit(i).alias("section_ord"), F.lit(n).alias("section_name"), F.col(n).alias("text")) for i, n in enumerate(names)))
    return rows.select(*rest, F.explode(items).alias("s")).select(*rest, "s.*").where("length(text) > 0")


def section_sentences(rows: DataFrame, least: int) -> DataFrame:
    """(..., pos, sentence): sentences of a long-form section relation."""
    return rows.select(*(c for c in rows.columns if c != "text"), F.posexplode(T.sentences(F.col("text"), least)).alias("pos", "sentence"))


def lines(rows: DataFrame) -> DataFrame:
    """(paper_idx, line_no, text): stripped non-blank lines of full_text."""
    found = rows.select("paper_idx", F.posexplode(F.split("full_text", "\n")).alias("line_no", "raw"))
    return found.select("paper_idx", F.col("line_no").cast("long").alias("line_no"), T.strip(F.col("raw")).alias("text")).where("length(text) > 0")


def figures(rows: DataFrame) -> DataFrame:
    """(paper_idx, place, index, caption, page, has_image, discussion_paragraphs); ``place`` counts the figures of a paper from 0."""
    return rows.select("paper_idx", F.posexplode("figures").alias("place", "f")).select(
        "paper_idx", "place", F.col("f.index").cast("long").alias("index"), T.text_of(F.col("f.caption")).alias("caption"), F.col("f.page").alias("page"), F.col("f.image_bytes").isNotNull().alias("has_image"), "f.discussion_paragraphs"
    )
