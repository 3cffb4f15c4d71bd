"""Sections, captions, metadata, sources, reports and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom import session
from paperloom.operators import corpus
from paperloom.operators import structure as S
from paperloom.plans.report import html_report, markdown_report
from paperloom.sources import arxiv
from paperloom.sources.mapping import map_with_errors
from paperloom.sources.pdf import read_pdfs
from paperloom.streaming.incremental import load_increment, stream_papers


def lines(spark, paper, *texts):
    return spark.createDataFrame([(paper, i, t, s) for i, (t, s) in enumerate(texts)], "paper_idx long, line_no int, text string, font_size double")


def test_segments(spark):
    plain = [("Title", 10.0), ("1. Introduction", 10.0), ("first", 10.0), ("2. Methods", 10.0), ("old", 10.0), ("Results", None), ("3. Methods", 10.0), ("new", 10.0), ("lines", 10.0)]
    got = {r.section_name: r.text for r in S.segmented(lines(spark, 1, *plain)).collect()}
    assert got == {"introduction": "first", "methods": "new\nlines"}
    none = {r.section_name: r.text for r in S.segmented(lines(spark, 2, ("a", 10.0), ("b", 10.0))).collect()}
    assert none == {"introduction": "a\nb"}
    one = {r.section_name: r.text for r in S.segmented(lines(spark, 3, ("Methods", 10.0), ("b", 10.0))).collect()}
    assert one == {"introduction": "Methods\nb"}  # a single heading of common size counts for none
    large = {r.section_name: r.text for r in S.segmented(lines(spark, 4, ("Methods", 14.0), ("b", 10.0), ("c", 12.0))).collect()}
    assert large == {"methods": "b\nc"}


def test_captions_and_metadata(spark):
    text = "arXiv:2101.00001 draft\nA title that is long enough here\nFigure 1: First caption\nFigure 2: second one\ngoes on\nTable 1: A table\nFig. 3. last caption is lost\n图 1: 中文图\n表 1: 中文表\n© 2021 Someone doi: 10.1/x"
    rows = spark.createDataFrame([(1, text, "upload.pdf", [])], "paper_idx long, full_text string, source string, figures array<struct<index:int>>")
    assert [r.caption for r in S.captions(rows).orderBy("index").collect()][:2] == ["First caption", "second one\ngoes on"]
    r = S.metadata(rows).first()
    assert (r.title, r.doi, r.source, r.year) == ("A title that is long enough here", "10.1/x", "arXiv:2101.00001", 2021)


def test_arxiv_ids(spark):
    cases = {"https://arxiv.org/abs/2101.00001v2": "2101.00001v2", "http://arxiv.org/pdf/2101.00001.pdf": "2101.00001", "arXiv:2101.1 x": "2101.1", "2101.00001": "2101.00001", "hep-th/9901001v3": "hep-th/9901001v3", "junk": None, "": None, "arxiv.org/abs/hep-th/9901001": "hep-th"}
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", arxiv.arxiv_id(F.col("raw")).alias("id")).collect()
    assert {r.raw: r.id for r in rows} == cases


def test_atom(spark):
    xml = "<feed xmlns='http://www.w3.org/2005/Atom' xmlns:a='http://arxiv.org/schemas/atom'><entry><title> A\n  title </title><author><name>X Y</name></author><summary> s </summary><published>2020-01-02T00:00:00Z</published><category term='cs.DB'/><link title='pdf' href='http://x/pdf'/><a:doi>10.5/z</a:doi></entry></feed>"
    r = arxiv.atom_metadata(spark.createDataFrame([("1", xml), ("2", "<feed/>")], "arxiv_id string, xml string")).collect()
    assert len(r) == 1 and (r[0].title, r[0].year, r[0].doi, r[0].pdf_url, r[0].categories, r[0].authors) == ("A title", 2020, "10.5/z", "http://x/pdf", ["cs.DB"], ["X Y"])


def test_errors_are_values(spark, tmp_path):
    rows = map_with_errors(spark.createDataFrame([(1, "4"), (2, "x")], "k int, v string"), "k", "v", lambda x: 8 // int(x)).orderBy("k").collect()
    assert rows[0].value == "2" and rows[1].error.startswith("ValueError")
    (tmp_path / "a.pdf").write_bytes(b"hello\nworld")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parse(data):
        if data == b"bad":
            raise ValueError("empty")
        return data.decode(), [(x, 10.0) for x in data.decode().split("\n")], 0

    got = {os.path.basename(r.path): (r.full_text, r.error) for r in read_pdfs(spark, str(tmp_path), parse).collect()}
    assert got == {"a.pdf": ("hello\nworld", None), "b.pdf": (None, "ValueError: empty")}


def test_report(spark):
    page = html_report(markdown_report({"T": spark.createDataFrame([("a|b <x>", 1)], "name string, n int"), "E": spark.createDataFrame([], "x int")}, "now"))
    assert "&lt;x&gt;" in page and "<th>name</th>" in page and "a|b" in page and "(nothing found)" in page


def test_stream_keeps_first_source(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "paper_idx long, source string").coalesce(1).write.parquet(source)
    stream_papers(spark, source, target, str(tmp_path / "c"), ["paper_idx"]).awaitTermination()
    spark.createDataFrame([(4, "b"), (5, "c")], "paper_idx long, source string").coalesce(1).write.mode("append").parquet(source)
    stream_papers(spark, source, target, str(tmp_path / "c"), ["paper_idx"]).awaitTermination()
    assert sorted((r.source, r.paper_idx) for r in spark.read.parquet(target).collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    target = str(tmp_path / "target")
    first, second = (spark.createDataFrame(rows, "paper_idx long, source string") for rows in ([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")]))
    for batch, rows in ((0, first), (1, second), (1, second), (0, first)):
        load_increment(rows, target, ["paper_idx"], batch).write.mode("overwrite").parquet(f"{target}/batch_id={batch}")
    assert sorted((r.paper_idx, r.source) for r in spark.read.parquet(target).collect()) == [(1, "a"), (2, "b"), (5, "c")]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": lambda self: type("D", (), {"isEmpty": lambda self: True})()})())

    frame = type("F", (), {"sparkSession": type("P", (), {"sparkContext": Context()})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.durable(frame)


def test_rows_delivered_twice_by_files(spark, tmp_path):
    rows = [(1, "x"), (2, "y"), (2, "y"), (None, "z"), (3, "w"), (2, "y")]
    spark.createDataFrame(rows, "paper_idx long, title string").repartition(3).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    for held in (100, 0):  # by broadcast, and by key
        assert sorted(map(tuple, corpus.once(frame, "paper_idx", held).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert corpus.once(frame.where("paper_idx = 9"), "paper_idx").count() == 0
