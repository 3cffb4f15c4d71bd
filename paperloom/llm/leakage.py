"""Held-out evaluation items that stand, in whole or in part, in corpus documents.

Method: an index of window minima. Every window of ``run`` normalised characters, of items and of
documents alike, has a minimum, the least hash of its character shingles. Equal windows have equal
minima, so a passage of ``run`` characters in both is found with certainty: unlike MinHash signatures
of whole documents in bands by size, in which a hundred characters of a long document don't show,
nothing is lost and no threshold is set. Neighbouring windows mostly share their minimum, so a
document has about two minima per ``run - shingle`` characters to look up. Candidates are verified
by exact containment.

Items are a stated query set. Up to ``block_items`` of them go to the executors and the documents
are read in one narrow pass; more of them meet the documents' minima by a join, minima that many
documents have being dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.grams import CHUNK_CHARS, chunks, joined, letters_and_digits, mixed, rolling, sliding_min, window_owner
from paperloom.llm.pairs import HOT_ROWS
from paperloom.session import durable

RUN = 100
SHINGLE = 24
BLOCK_ITEMS = 20_000


def minima(values: np.ndarray, offsets: np.ndarray, run: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, minimum) of all partitions, consecutive equal ones once."""
    least = sliding_min(mixed(rolling(values, shingle)), run - shingle + 1)
    owner = window_owner(offsets, run, len(least))
    new = owner >= 0
    new[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], least[new]


class ItemIndex:
    """Items: minima with their items, and the hashes of all their windows."""

    def __init__(self, ids: list[int], texts: list[str], run: int = RUN, shingle: int = SHINGLE):
        self.ids, self.run, self.shingle = ids, run, shingle
        self.parts = [letters_and_digits(t) for t in texts]
        owner, least = minima(*joined(self.parts), run, shingle)
        order = np.argsort(least, kind="stable")
        self.least, self.owner = least[order], owner[order]
        self.windows = [rolling(p, run) for p in self.parts]

    def found(self, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        """Verified (position in parts, position in items), each pair once."""
        owner, least = minima(*joined(parts), self.run, self.shingle)
        if not len(self.least) or not len(least):
            return []
        low, high = np.searchsorted(self.least, least, "left"), np.searchsorted(self.least, least, "right")
        hit = np.flatnonzero(high > low)
        pairs = {(int(owner[i]), int(self.owner[j])) for i in hit for j in range(low[i], high[i])}
        hashes: dict[int, np.ndarray] = {}
        return [(d, i) for d, i in sorted(pairs) if self.contained(parts[d], i, hashes, d)]

    def contained(self, part: np.ndarray, item: int, hashes: dict[int, np.ndarray], key: int) -> bool:
        if key not in hashes:
            hashes[key] = rolling(part, self.run)
        mine, own = hashes[key], self.windows[item]
        for at in np.flatnonzero(np.isin(mine, own)):
            for to in np.flatnonzero(own == mine[at]):
                if np.array_equal(part[at : at + self.run], self.parts[item][to : to + self.run]):
                    return True
        return False


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, shingle: int = SHINGLE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id): the item and the document share ``run`` consecutive letters and digits.

    Both texts are lower-cased and kept to Unicode letters and digits. NULL, empty and short texts
    match nothing; a NULL id gives no row; repeated rows and ids give one row; extra columns are
    not read.
    """
    queries = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(f"item_id IS NOT NULL AND length(text) >= {run}").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(f"doc_id IS NOT NULL AND length(text) >= {run}")
    rows = queries.limit(block_items + 1).collect()  # of bounded number
    if len(rows) > block_items:
        return joined_items(texts, queries, run, shingle)
    index = documents.sparkSession.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], [r.text for r in rows], run, shingle))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), ([], [])
            docs = list(zip(ids, batch.column(1).to_pylist()))
            for some in chunks(docs, [len(t) for _, t in docs], CHUNK_CHARS):
                for d, i in known.found([letters_and_digits(t) for _, t in some]):
                    out[0].append(some[d][0])
                    out[1].append(known.ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["doc_id", "item_id"])

    return texts.mapInArrow(search, "doc_id long, item_id long").distinct()


def minima_rows(rows: DataFrame, run: int, shingle: int) -> DataFrame:
    """(id, least): the minima of each text, once. rows: an id and a text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for some in chunks(docs, [len(t) for _, t in docs], CHUNK_CHARS):
                owner, least = minima(*joined([letters_and_digits(t) for _, t in some]), run, shingle)
                once = np.unique(np.rec.fromarrays([owner, least], names="owner,least"))
                ids = np.array([d for d, _ in some], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[once["owner"]]), pa.array(once["least"].view(np.int64))], names=["id", "least"])

    return rows.mapInArrow(read, "id long, least long").distinct()


def joined_items(texts: DataFrame, queries: DataFrame, run: int, shingle: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``leaked_items`` for any number of items."""
    ours = durable(minima_rows(texts, run, shingle).join(minima_rows(queries, run, shingle).select("least").distinct(), "least", "left_semi"))
    hot = ours.groupBy("least").count().where(F.col("count") > hot_rows).select("least", F.ceil(F.col("count") / hot_rows).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    left = ours.join(hot, "least", "left").select("least", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.col("id").alias("doc_id"))
    right = minima_rows(queries, run, shingle).join(hot, "least", "left").select("least", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("id").alias("item_id"))
    pairs = left.join(right, ["least", "salt"]).select("doc_id", "item_id").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, held = [], (None, None)
            for text, item in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if held[0] != text:
                    held = text, letters_and_digits(text)
                good.append(ItemIndex([0], [item], run, shingle).contained(held[1], 0, {}, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["doc_id", "item_id"]).filter(pa.array(good, pa.bool_()))

    met = pairs.join(queries.withColumnRenamed("text", "item"), "item_id").join(texts, "doc_id").select("doc_id", "item_id", "text", "item")
    return met.mapInArrow(verify, "doc_id long, item_id long").distinct()
