"""arXiv identifiers and stored metadata records."""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.dictionaries import ARXIV_BARE, ARXIV_PREFIX, ARXIV_URL, ARXIV_VERSION
from paperloom.functions.text import strip

API = "https://export.arxiv.org/api/query?id_list="
TIMEOUT = 30  # seconds a request


def arxiv_id(raw: Column) -> Column:
    """The id that a typed text holds (URL, arXiv: prefix, bare new or old style), or NULL."""
    text = strip(raw)
    url = F.regexp_replace(F.regexp_extract(text, ARXIV_URL, 1), r"\.pdf", "")
    prefixed = F.regexp_extract(text, ARXIV_PREFIX, 1)
    bare = F.regexp_extract(text, ARXIV_BARE, 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (url, prefixed, bare)))


def input_parts(inputs: DataFrame) -> DataFrame:
    """(input_id, pos, part): what was typed, split at commas and line ends, without blanks."""
    parts = inputs.select("input_id", F.posexplode(F.split(F.translate("raw", "\n", ","), ",")).alias("pos", "raw"))
    return parts.select("input_id", F.col("pos").cast("long").alias("pos"), strip(F.col("raw")).alias("part")).where("length(part) > 0")


def without_version(id_: Column) -> Column:
    return F.regexp_replace(id_, ARXIV_VERSION, "")


def fetched_feed(id_: str) -> bytes:
    """The Atom record of an id over the network."""
    with urllib.request.urlopen(API + id_, timeout=TIMEOUT) as reply:
        return reply.read()


def fetch_records(inputs: DataFrame, fetch: Callable[[str], bytes] = fetched_feed, column: str = "raw") -> DataFrame:
    """(raw, arxiv_id, xml, error): the record of each typed id, or why there is none.

    Texts that hold no id and records without an entry are errors, as is whatever ``fetch`` raises;
    no row stops the others. ``xml`` is what ``atom_metadata`` reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for raw, id_ in zip(pdf["raw"], pdf["arxiv_id"]):
                xml, error = None, None
                if id_ is None:
                    error = "ValueError: no arXiv id"
                else:
                    try:
                        found = fetch(id_)
                        xml = found.decode() if isinstance(found, bytes) else found
                        if "<entry" not in xml:
                            xml, error = None, "LookupError: no entry"
                    except Exception as e:  # noqa: BLE001 - errors are values
                        error = f"{type(e).__name__}: {e}"
                out.append((raw, id_, xml, error))
            yield pd.DataFrame(out, columns=["raw", "arxiv_id", "xml", "error"], dtype=object)

    ids = inputs.select(F.col(column).alias("raw"), without_version(F.regexp_replace(arxiv_id(F.col(column)), "(?i)^arxiv:", "")).alias("arxiv_id"))
    return ids.mapInPandas(run, "raw string, arxiv_id string, xml string, error string")


def fetched_file(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as reply:
        return reply.read()


def fetch_pdfs(meta: DataFrame, fetch: Callable[[str], bytes] = fetched_file) -> DataFrame:
    """(arxiv_id, content, error): the PDF of every record as bytes; NULL with the reason where it can't be had."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, url in zip(pdf["arxiv_id"], pdf["pdf_url"]):
                try:
                    out.append((id_, fetch(url), None) if url else (id_, None, "ValueError: no address"))
                except Exception as e:  # noqa: BLE001 - errors are values
                    out.append((id_, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["arxiv_id", "content", "error"], dtype=object)

    return meta.select("arxiv_id", "pdf_url").mapInPandas(run, "arxiv_id string, content binary, error string")


def atom_metadata(feeds: DataFrame) -> DataFrame:
    """(arxiv_id, title, authors, year, abstract, categories, published, doi, pdf_url) of stored Atom entries (column xml)."""
    node = lambda name: f"//*[local-name()='entry']/*[local-name()='{name}']"
    one = lambda path: F.xpath_string("xml", F.lit(path))
    tidy = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    link = F.xpath_string("xml", F.lit("//*[local-name()='entry']/*[local-name()='link' and contains(@href, 'doi.org/')]/@href"))
    published = strip(one(node("published")))
    return feeds.select(
        "arxiv_id",
        tidy(one(node("title"))).alias("title"),
        F.transform(F.xpath("xml", F.lit(node("author") + "/*[local-name()='name']/text()")), strip).alias("authors"),
        F.nullif(F.left(published, F.lit(4)), F.lit("")).cast("int").alias("year"),
        strip(one(node("summary"))).alias("abstract"),
        F.xpath("xml", F.lit(node("category") + "/@term")).alias("categories"),
        published.alias("published"),
        F.when(F.length(link) > 0, F.regexp_extract(link, r".*doi\.org/(.*)$", 1)).otherwise(strip(one(node("doi")))).alias("doi"),
        F.xpath_string("xml", F.lit("//*[local-name()='entry']/*[local-name()='link' and @title='pdf']/@href")).alias("pdf_url"),
    ).where(F.length("title") > 0)


def metadata_paper(meta: DataFrame) -> DataFrame:
    """Papers of records without PDF: the abstract also stands for introduction and full text."""
    text = F.coalesce("abstract", F.lit(""))
    return meta.select(F.concat(F.lit("arXiv:"), "arxiv_id").alias("source"), F.coalesce("title", F.lit("")).alias("title"), "authors", "year", F.coalesce("doi", F.lit("")).alias("doi"), text.alias("abstract"), text.alias("introduction"), text.alias("full_text")).where("arxiv_id IS NOT NULL")


def overridden(parsed: DataFrame, meta: DataFrame) -> DataFrame:
    """Title, authors, year and abstract of the record win over those read from the text; the source stays."""
    record = meta.select(F.concat(F.lit("arXiv:"), "arxiv_id").alias("source"), F.struct("title", "authors", "year", "abstract").alias("m")).dropDuplicates(["source"])
    joined = parsed.join(record, "source", "left")
    return joined.select(*(F.coalesce(F.col(f"m.{c}"), F.col(c)).alias(c) if c in ("title", "authors", "year", "abstract") else F.col(c) for c in parsed.columns))
