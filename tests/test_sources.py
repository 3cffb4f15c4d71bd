"""PDF parsers, figures and fetches with stand-ins for packages and network."""

import json

from pyspark.sql import functions as F

from paperloom.plans.report import as_json
from paperloom.sources import arxiv, pdf


class Page:
    def __init__(self, lines, images):
        self.lines, self.images = lines, images

    def get_text(self, kind):
        return {"blocks": [{"type": 1}, {"type": 0, "lines": [{"spans": [{"text": t, "size": s} for t, s in spans]} for spans in self.lines]}]}

    def get_images(self, full):
        return [(i, "other") for i in self.images]


class Library:
    """Two pages; image 2 is too small."""

    def open(self, stream, filetype):
        library = self

        class Document(list):
            __enter__ = lambda d: d
            __exit__ = lambda d, *e: None
            extract_image = lambda d, i: {1: {"width": 200, "height": 150, "image": b"one"}, 2: {"width": 90, "height": 400, "image": b"two"}}.get(i)

        library.seen = (stream, filetype)
        return Document([Page([[("Results", 14.0)], [(" ", 3.0)], [("a ", 8.0), ("b", 10.0), (" ", 99.0)]], [2]), Page([[("Body", 9.0)]], [1, 3])])


def test_pymupdf_lines_and_images():
    found = pdf.pymupdf_text(b"x", Library())
    assert found.text == "Results\na b\nBody" and found.lines == [("Results", 14.0), ("a b", 9.0), ("Body", 9.0)] and found.images == [(1, b"one")]


def test_read_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def parser(data):
        if data == b"bad":
            raise ValueError("broken")
        return pdf.Parsed("Results\nBody", [("Results", 14.0), ("Body", 10.0)], [(0, b"one")])

    got = {r.path.rsplit("/", 1)[1]: r for r in pdf.read_pdfs(spark, str(tmp_path), parser).collect()}
    assert got["a.pdf"].full_text == "Results\nBody" and got["a.pdf"].lines[0].font_size == 14.0 and bytes(got["a.pdf"].images[0].image_bytes) == b"one" and got["a.pdf"].error is None
    assert got["b.pdf"].full_text is None and got["b.pdf"].error == "ValueError: broken"


def test_figures_of_captions_and_images(spark):
    rows = [(1, ["c1", "c2"], [(3, b"i")]), (2, [], [(0, b"i"), (1, b"j")]), (3, ["c1", "c2"], []), (4, [], []), (5, ["c1"], [(2, b"i"), (4, b"j")])]
    frame = spark.createDataFrame(rows, "id int, captions array<string>, images array<struct<page:int,image_bytes:binary>>")
    got = {r.id: [(f["index"], f["caption"], f["page"], f["image_bytes"] is not None) for f in r.figures] for r in frame.select("id", pdf.figure_list(F.col("captions"), F.col("images")).alias("figures")).collect()}
    assert got == {1: [(1, "c1", 3, True)], 2: [(1, "Figure 1", 0, True), (2, "Figure 2", 1, True)], 3: [(1, "c1", 0, False), (2, "c2", 0, False)], 4: [], 5: [(1, "c1", 2, True)]}


def test_fetches_with_errors_as_rows(spark):
    def fetch(id_):
        if id_ == "2001.00002":
            raise OSError("down")
        return b"<feed></feed>" if id_ == "2001.00003" else f"<feed><entry><title>Paper {id_}</title></entry></feed>".encode()

    rows = spark.createDataFrame([("2001.00001v2",), ("arXiv:2001.00002",), ("https://arxiv.org/abs/2001.00003",), ("junk",), (None,)], "raw string")
    got = {r.raw: r for r in arxiv.fetch_records(rows, fetch).collect()}
    assert got["2001.00001v2"].arxiv_id == "2001.00001" and "Paper 2001.00001" in got["2001.00001v2"].xml and got["2001.00001v2"].error is None
    assert got["arXiv:2001.00002"].error == "OSError: down" and got["https://arxiv.org/abs/2001.00003"].error == "LookupError: no entry"
    assert got["junk"].error == got[None].error == "ValueError: no arXiv id"
    titles = arxiv.atom_metadata(arxiv.fetch_records(rows, fetch).where("error IS NULL"))
    assert [r.title for r in titles.collect()] == ["Paper 2001.00001"]


def test_pdf_downloads(spark):
    meta = spark.createDataFrame([("1", "u"), ("2", None), ("3", "bad")], "arxiv_id string, pdf_url string")

    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return b"%PDF"

    got = {r.arxiv_id: (r.content and bytes(r.content), r.error) for r in arxiv.fetch_pdfs(meta, fetch).collect()}
    assert got == {"1": (b"%PDF", None), "2": (None, "ValueError: no address"), "3": (None, "OSError: down")}


def test_nested_json(spark):
    clusters = spark.createDataFrame([(1, "a"), (2, "b")], "cluster long, label string")
    items = spark.createDataFrame([(1, 5, "x"), (1, 4, "y")], "cluster long, paper_idx long, text string")
    got = {r.cluster: json.loads(r.json) for r in as_json(clusters, items).collect()}
    assert got == {1: {"cluster": 1, "label": "a", "items": [{"paper_idx": 4, "text": "y"}, {"paper_idx": 5, "text": "x"}]}, 2: {"cluster": 2, "label": "b"}}
