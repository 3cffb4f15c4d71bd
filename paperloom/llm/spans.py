"""Long spans that stand letter for letter in the texts of more than one paper.

Method: count-min prefilter. Every window of ``span`` characters has an anchor, the window of half
the length in it that hashes least, so equal windows have equal anchors, and a text has about one
anchor for each quarter of ``span``. Each task counts the anchors of its texts in a count-min sketch
(cells saturate at two, which is all that is asked); the merged sketch never underestimates. A second
pass groups exactly only the anchors estimated repeated, then, in the texts that hold an anchor of
several papers, the windows of those anchors by 96-bit hashes; nothing is lost.

The sketch grows with the corpus: it is kept as rows, in shards of a fixed number of anchors, and the
anchors go to their shard, so the share of lone anchors that pass (about 1 %) is the same at every
size. Anchors that several papers of one chunk hold are repeated for certain; they pass without a
test and are spread over the tasks, so no shard gathers a hot passage. No group is ever collected: a
window is shared if the least and the greatest paper number among its occurrences differ, and keys
that hold a large share of all rows are joined by broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.grams import SECOND_BASE, chunks, joined, mixed, points, rolling, sliding_min, window_owner
from paperloom.session import durable

SPAN = 200
DEPTH = 3
CELLS = 1 << 20  # in each of the rows of a shard of the sketch
LOAD = 4  # cells of a row for each anchor
HELD = 4_000_000  # cells that a task counts before it hands them on
HOT = 2_000  # a key is hot if it holds more than this part of all rows: there are at most so many hot keys


def anchors(parts: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, part, anchor) of every window of ``span`` characters, over the joined parts."""
    values, offsets = joined(parts)
    short = span // 2
    least = sliding_min(mixed(rolling(values, short), 5), span - short + 1)
    owner = window_owner(offsets, span, len(least))
    inside = np.flatnonzero(owner >= 0)
    return inside, owner[inside], least[inside]


def distinct_anchors(parts: list[np.ndarray], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, anchor), each once."""
    _, owner, least = anchors(parts, span)
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])] if len(least) else np.zeros(0, bool)
    pairs = np.unique(np.rec.fromarrays([owner[new], least[new]], names="owner,least"))
    return pairs["owner"], pairs["least"]


def long_texts(papers: DataFrame, fields: tuple[str, ...], span: int) -> DataFrame:
    """(paper_idx, section_name, text) of the texts that can hold a window."""
    rows = papers.where("paper_idx IS NOT NULL").select(F.col("paper_idx").cast("long").alias("paper_idx"), F.posexplode(F.array(*(papers[f].cast("string") for f in fields))).alias("k", "text"))
    return rows.where(F.length("text") >= span).select("paper_idx", F.col("k").cast("int").alias("k"), "text")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))))
        for some in chunks(rows, [len(r[2]) for r in rows]):
            yield some, [points(r[2]) for r in some]


def cells_of(least: np.ndarray, shards: int, cells: int) -> np.ndarray:
    """A row a depth: the cells of anchors, numbered through all shards."""
    shard = (mixed(least, 29) % np.uint64(shards)).astype(np.int64)
    return np.stack([(mixed(least, 31 + d) % np.uint64(cells)).astype(np.int64) + (shard * DEPTH + d) * cells for d in range(DEPTH)])


def estimated_repeated(texts: DataFrame, span: int, shards: int, cells: int = CELLS) -> DataFrame:
    """(anchor, paper_idx, k): the anchors of the texts that the sketch estimates in several texts."""
    whole = DEPTH * cells  # cells of a shard
    names = ["shard", "kind", "anchor", "paper_idx", "k", "cells"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)], names=names)

    def sketched(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows of partial sketches: the cells counted once, and those counted more often."""
        at, times = np.unique(np.concatenate(held), return_counts=True)
        for some, step in ((at, 1), (at[times > 1], 2)):
            own = some // whole
            for shard, part in zip(np.unique(own).tolist(), np.split(some % whole, np.flatnonzero(np.diff(own)) + 1) if len(some) else []):
                packed = zlib.compress(np.diff(part, prepend=0).astype(np.uint32).tobytes(), 1)
                yield batch_of(1, shard=[shard], kind=[0], k=[step], cells=[packed])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, parts in pieces(batches):
            owner, least = distinct_anchors(parts, span)
            if not len(least):
                continue
            held.append(cells_of(least, shards, cells).ravel())
            size += len(held[-1])
            paper, k = np.array([r[0] for r in rows], np.int64)[owner], np.array([r[1] for r in rows], np.int32)[owner]
            order = np.lexsort((paper, least))
            least, paper, k = least[order], paper[order], k[order]
            heads = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            sizes = np.diff(np.r_[heads, len(least)])
            certain = np.repeat(np.minimum.reduceat(paper, heads) != np.maximum.reduceat(paper, heads), sizes)
            shard = np.where(certain, -1 - (mixed(paper.view(np.uint64), 3) % np.uint64(1024)).astype(np.int64), (mixed(least, 29) % np.uint64(shards)).astype(np.int64))
            yield batch_of(len(least), shard=shard, kind=np.where(certain, 2, 1).astype(np.int32), anchor=least.view(np.int64), paper_idx=paper, k=k)
            if size > HELD:
                yield from sketched(held)
                held, size = [], 0
        if held:
            yield from sketched(held)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, known = None, np.zeros(whole, np.uint8)
        for batch in batches:
            where, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = kind == 2
            cuts = np.r_[0, np.flatnonzero((where[1:] != where[:-1]) | (kind[1:] != kind[:-1])) + 1, len(where)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b or kind[a] == 2:
                    continue
                if where[a] != shard:
                    shard = where[a]
                    known[:] = 0
                if kind[a] == 0:
                    for step, packed in zip(batch.column(4).slice(a, b - a).to_pylist(), batch.column(5).slice(a, b - a).to_pylist()):
                        at = np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32), dtype=np.int64)
                        known[at] = np.minimum(2, known[at] + step)
                else:
                    own = batch.column(2).slice(a, b - a).to_numpy().view(np.uint64)
                    keep[a:b] = (known[cells_of(own, shards, cells) % whole] >= 2).all(0)
            yield batch.select(["anchor", "paper_idx", "k"]).filter(pa.array(keep))

    rows = texts.mapInArrow(count, "shard long, kind int, anchor long, paper_idx long, k int, cells binary")
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(test, "anchor long, paper_idx long, k int")


def of_several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key stands in several papers.

    Only the least and greatest paper of a key are found, summed in each task first. Keys with more
    than a ``HOT``-th of all rows, so at most ``HOT`` of them, are broadcast, the others meet by key.
    """
    total = rows.count()
    found = durable(rows.groupBy(*keys).agg(F.min("paper_idx").alias("low"), F.max("paper_idx").alias("high"), F.count("*").alias("n")).where("low < high").select(*keys, "n"))
    hot = F.col("n") > max(1_000, total // HOT)
    few = F.broadcast(found.where(hot).select(*keys))
    return rows.join(few, list(keys), "left_semi").unionByName(rows.join(few, list(keys), "left_anti").join(found.where(~hot).select(*keys), list(keys), "left_semi"))


def shared_spans(papers: DataFrame, fields: tuple[str, ...] = ("introduction", "methods"), span: int = SPAN, cells: int = CELLS) -> DataFrame:
    """(paper_idx, section_name, start_pos, end_pos): the longest stretches of characters that lie in windows of
    ``span`` characters standing in a text of another paper too.

    NULL and short texts have none, NULL numbers are left out, rows delivered twice are one paper
    (their copies share nothing with each other), other columns are not read.
    """
    texts = long_texts(papers, fields, span)
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    anchors_of_all = total * 4 // span
    candidates = durable(estimated_repeated(texts, span, anchors_of_all * LOAD // cells + 1, cells))
    hits = of_several(candidates, "anchor").groupBy("paper_idx", "k").agg(F.collect_set("anchor").alias("anchors"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            for some in chunks(rows, [len(r[2]) for r in rows]):
                out = ([], [], [], [], [])
                for paper, k, text, wanted in some:
                    part = points(text)
                    start, _, least = anchors([part], span)
                    at = start[np.isin(least.view(np.int64), np.array(wanted, np.int64))]
                    out[0].append(mixed(rolling(part, span))[at].view(np.int64))
                    out[1].append((mixed(rolling(part, span, SECOND_BASE), 17)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    out[2].append(np.full(len(at), paper, np.int64))
                    out[3].append(np.full(len(at), k, np.int32))
                    out[4].append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["window", "more", "paper_idx", "k", "at"])

    found = durable(texts.join(hits, ["paper_idx", "k"]).select("paper_idx", "k", "text", "anchors").mapInArrow(windows, "window long, more int, paper_idx long, k int, at int"))
    starts = of_several(found, "window", "more").groupBy("paper_idx", "k").agg(F.collect_set("at").alias("starts"))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for paper, k, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = np.sort(np.array(at, np.int64))
                cut = np.flatnonzero(np.diff(at) > span)
                for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + span):
                    for column, value in zip(out, (paper, fields[k], int(a), int(b))):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["paper_idx", "section_name", "start_pos", "end_pos"])

    return starts.mapInArrow(stretches, "paper_idx long, section_name string, start_pos long, end_pos long")


def shared_share(papers: DataFrame, fields: tuple[str, ...] = ("introduction", "methods"), span: int = SPAN) -> DataFrame:
    """(paper_idx, section_name, n_chars, shared_chars, share): how much of each field stands in other papers."""
    sizes = papers.where("paper_idx IS NOT NULL").select("paper_idx", F.explode(F.array(*(F.struct(F.lit(f).alias("section_name"), F.length(f).cast("long").alias("n_chars")) for f in fields))).alias("s"))
    sizes = sizes.select(F.col("paper_idx").cast("long").alias("paper_idx"), "s.*").where("n_chars IS NOT NULL").groupBy("paper_idx", "section_name").agg(F.max("n_chars").alias("n_chars"))
    spans = shared_spans(papers, fields, span).groupBy("paper_idx", "section_name").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("found"))
    shared = F.coalesce("found", F.lit(0).cast("long"))
    return sizes.join(spans, ["paper_idx", "section_name"], "left").select("paper_idx", "section_name", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 4)).otherwise(0.0).alias("share"))
