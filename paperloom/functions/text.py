"""Text functions as Column expressions: they stay inside the JVM and its generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"
MARK = "\u0001"


def text_of(column: Column | str) -> Column:
    """Missing text is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def clean_text(text: Column) -> Column:
    """De-hyphenate, one kind of line end, at most one blank line, single blanks."""
    out = F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?U)[^\S\n]+", " ")
    return strip(F.regexp_replace(out, " {2,}", " "))


def normalize_sentence(text: Column) -> Column:
    out = F.regexp_replace(strip(F.lower(text)), r"(?U)\s+", " ")
    return F.regexp_replace(out, r"(?U)^\W+|\W+$", "")


def sentences(text: Column, least: int) -> Column:
    """Array of stripped sentences of at least ``least`` characters."""
    marked = F.regexp_replace(F.translate(text, "\n", " "), r"(?U)(?<=[.!?。！？])\s+|(?<=[。！？])", MARK)
    return F.filter(F.transform(F.split(marked, MARK), strip), lambda s: F.length(s) >= least)


def paragraphs(text: Column, least: int = 50) -> Column:
    """Array of blank-line paragraphs of at least ``least`` characters; without any, groups of three sentences."""
    blocks = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), lambda b: F.translate(strip(b), "\n", " ")), lambda b: F.length(b) >= least)
    parts = sentences(text, 20)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(parts) / 3).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, k * 3 + 1, 3), " "))
    return F.when(F.size(blocks) > 0, blocks).otherwise(F.filter(groups, lambda g: F.length(g) >= least))


def text_stats(text: Column) -> dict[str, Column]:
    """Characters, words, sentences and paragraphs; zeros for the empty text."""
    filled = F.length(text) > 0
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0))
    blocks = F.size(F.filter(F.split(text, "\n\n"), lambda b: F.length(strip(b)) > 0))
    return {name: F.when(filled, value).otherwise(0).cast("long") for name, value in (("chars", F.length(text)), ("words", words), ("sentences", F.size(sentences(text, 10))), ("paragraphs", blocks))}


def detect_language(text: Column) -> Column:
    """zh, mixed or en, by the share of Chinese characters among the non-blank ones."""
    kept = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    share = F.length(F.regexp_replace(text, "[^一-鿿]", "")) / kept
    return F.when(kept == 0, "en").when(share > 0.5, "zh").when(share > 0.2, "mixed").otherwise("en")


def label(title: Column, source: Column, words: int = 4, source_chars: int = 30, long_title: int | None = None) -> Column:
    """Short label of a paper: its first words, or the beginning of its source."""
    parts = F.filter(F.split(title, r"(?U)\s+"), lambda w: F.length(w) > 0)
    head = F.array_join(F.slice(parts, 1, words), " ")
    whole = head if long_title is None else F.left(title, F.lit(long_title))
    return F.when(F.length(title) == 0, F.left(source, F.lit(source_chars))).when(F.size(parts) > words, F.concat(head, F.lit("..."))).otherwise(whole)


def title_case(text: Column) -> Column:
    """Capital after anything that isn't a letter, as in X-Ray."""
    low = F.lower(text)
    return F.array_join(F.transform(F.split(F.regexp_replace(low, r"([^\p{L}]?)(\p{L}+)", "$1\u0001$2"), MARK), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))), "")


def first_match(text: Column, words: list[str]) -> Column:
    """The first of the words (in list order) that the lower-cased text contains, or NULL."""
    return F.get(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(text), F.lower(w))), F.lit(0))


def any_pattern(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?iU)" + "|".join(patterns))
