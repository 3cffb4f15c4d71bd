"""PDF files as papers: binary files in, text, lines, images and errors as values out."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, full_text string, lines array<struct<text:string,font_size:double>>, images array<struct<page:int,image_bytes:binary>>, error string"
LEAST_PIXELS = 100  # an image counts as a figure if it is larger both ways
FONT_SIZE = 10.0  # of lines whose size isn't known


class Parsed(NamedTuple):
    """Text, lines with their font sizes, and images with the page (from 0) they stand on."""

    text: str
    lines: list[tuple[str, float]]
    images: list[tuple[int, bytes]]


def pdfplumber_text(data: bytes) -> Parsed:
    """Text of all pages; every line has font size 10. Needs the optional pdfplumber package."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [t for p in pdf.pages if (t := p.extract_text())]
    text = "\n".join(pages)
    return Parsed(text, [(x.strip(), FONT_SIZE) for x in text.split("\n") if x.strip()], [])


def pymupdf_text(data: bytes, library=None) -> Parsed:
    """Non-blank lines with the mean size of their non-blank pieces, and the larger images. Needs the optional PyMuPDF package."""
    if library is None:
        import fitz as library

    lines, images = [], []
    with library.open(stream=data, filetype="pdf") as document:
        for number, page in enumerate(document):
            pieces = (line["spans"] for block in page.get_text("dict")["blocks"] if block["type"] == 0 for line in block["lines"])
            for spans in pieces:
                sizes = [s["size"] for s in spans if s["text"].strip()]
                if sizes:
                    lines.append(("".join(s["text"] for s in spans).strip(), sum(sizes) / len(sizes)))
            for reference, *_ in page.get_images(full=True):
                image = document.extract_image(reference) or {}
                if min(image.get("width", 0), image.get("height", 0)) > LEAST_PIXELS:
                    images.append((number, image["image"]))
    return Parsed("\n".join(t for t, _ in lines), lines, images)


def best_parser() -> Callable[[bytes], Parsed]:
    """The parser whose package is there, PyMuPDF before pdfplumber."""
    from importlib.util import find_spec

    for package, parser in (("fitz", pymupdf_text), ("pdfplumber", pdfplumber_text)):
        if find_spec(package):
            return parser
    raise ImportError("reading PDF files needs PyMuPDF or pdfplumber")


def read_pdfs(spark: SparkSession, path: str, parser: Callable[[bytes], Parsed] | None = None) -> DataFrame:
    """One row a file under ``path``; a file that can't be parsed has its error as a value.

    ``parser`` gives a ``Parsed`` or any triple like it, without images also with 0 or None for them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for where, data in zip(pdf.path, pdf.content):
                try:
                    text, lines, images = (parser or best_parser())(bytes(data))
                    out.append((where, text, [{"text": t, "font_size": s} for t, s in lines], [{"page": p, "image_bytes": b} for p, b in images or []], None))
                except Exception as e:  # noqa: BLE001 - errors are values
                    out.append((where, None, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "full_text", "lines", "images", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def figure_list(captions: Column, images: Column) -> Column:
    """Array of (index, caption, page, image_bytes): captions with images in turn.

    Where there are images only so many captions count; images without any caption are ``Figure n``.
    Without images every caption is a figure on page 0.
    """
    n, m = F.size(captions), F.size(images)
    count = F.when(m == 0, n).when(n == 0, m).otherwise(F.least(n, m))
    image = lambda i: F.get(images, i - 1)
    caption = lambda i: F.coalesce(F.get(captions, i - 1), F.concat(F.lit("Figure "), i.cast("string")))
    made = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(i.alias("index"), caption(i).alias("caption"), F.coalesce(image(i)["page"], F.lit(0)).alias("page"), image(i)["image_bytes"].alias("image_bytes")))
    return F.when(count > 0, made).otherwise(F.slice(made, 1, 0))
