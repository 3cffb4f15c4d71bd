"""Text functions against their definitions in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dictionaries as D
from paperloom.functions import text as T
from paperloom.operators.clusters import ranked_terms, shared_phrase
from paperloom.operators.structure import heading

TEXTS = [
    "One sentence here. Another one!  And a third? 这是中文。另一句！最后",
    "",
    "   ",
    "No stop at all",
    "Short. A. B. Longer sentence follows here.\nNew line inside. (Yes.) End",
    "词语，没有空格。第二句？第三句！ok. done here now.",
    "x" * 5000 + ". " + "y" * 10,
]


def python_sentences(text, least):
    parts = [q for p in re.split(r"(?<=[.!?。！？])\s+", text.replace("\n", " ")) for q in re.split(r"(?<=[。！？])", p)]
    return [s.strip() for s in parts if len(s.strip()) >= least]


def test_sentences_equal_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for least in (6, 10, 20):
        got = {r.i: r.s for r in rows.select("i", T.sentences(F.col("t"), least).alias("s")).collect()}
        assert got == {i: python_sentences(t, least) for i, t in enumerate(TEXTS)}


def test_clean_and_normalize(spark):
    rows = spark.createDataFrame([("exam-\nple  of\r\n\r\n\r\n\r\ntext \t x ", " (Hello,   World!) ")], "a string, b string")
    r = rows.select(T.clean_text(F.col("a")).alias("a"), T.normalize_sentence(F.col("b")).alias("b")).first()
    assert r.a == "example of\n\ntext x"
    assert r.b == "hello, world"


def test_paragraph_fallback(spark):
    parts = [f"Sentence number {i} has some words." for i in range(7)]
    rows = spark.createDataFrame([(" ".join(parts), "\n\n".join(parts), "a" * 60 + "\n\n" + "b" * 10)], "a string, b string, c string")
    r = rows.select(*(T.paragraphs(F.col(c)).alias(c) for c in "abc")).first()
    assert r.a == [" ".join(parts)]
    assert r.b == [" ".join(parts[:3]), " ".join(parts[3:6])]  # no block is long enough: groups of three sentences
    assert r.c == ["a" * 60]


@pytest.mark.parametrize(("text", "expected"), [("", "en"), ("中文中文", "zh"), ("中文 abcd", "mixed"), ("中 abcdefgh", "en"), ("naïve café", "en")])
def test_language(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(T.detect_language(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(("title", "source", "expected"), [("A b c d e", "s", "A b c d..."), ("A b", "s", "A b"), ("", "x" * 40, "x" * 30)])
def test_label(spark, title, source, expected):
    assert spark.createDataFrame([(title, source)], "t string, s string").select(T.label(F.col("t"), F.col("s"))).first()[0] == expected


HEADINGS = [
    ("3. RESULTS and discussion", "results"), ("III. Results", "results"), ("5) conclusion", "conclusion"), ("Conclusions", None), ("Abstract:", None), ("3 Results", None), ("IV. Results", None), ("2.1. Results", None),
    ("方法论研究", "methods"), ("理论abc", "methods"), ("模型x", None), ("我的方法", None), (" 1. 方法", "methods"), ("摘要", "abstract"), ("Related Work", "related_work"), ("x" * 60, None),
]


def test_headings(spark):
    rows = spark.createDataFrame([(t,) for t, _ in HEADINGS], "t string").select("t", heading(F.col("t"), 50).alias("h")).collect()
    assert {r.t: r.h for r in rows} == dict(HEADINGS)


def test_dictionaries():
    assert len(D.ENGLISH_STOPS) == len(set(D.ENGLISH_STOPS)) == 318
    assert len(D.METHOD_WORDS) == 54 and len(D.FIGURE_TYPES) == 27 and len(D.PROBLEM_WORDS_EN) == 29 and len(D.PROBLEM_WORDS_ZH) == 20


def test_title_case(spark):
    assert spark.createDataFrame([("x-ray of the 3d kiln",)], "t string").select(T.title_case(F.col("t"))).first()[0] == "X-Ray Of The 3D Kiln"


def test_phrases():
    assert shared_phrase("we use the same long method here", "They USE the same long methods") == "use the same long method"
    assert shared_phrase("two words", "two words") == "" and shared_phrase("", None) == ""
    assert ranked_terms("deep learning deep learning of the kiln", ["of", "the"], 2, 1) == [("deep learning", 4), ("deep learning deep", 3)]
    assert ranked_terms("", [], 5, 1) == []
