"""Near-duplicate texts: groups whose character-shingle sets have a Jaccard similarity of 0.6 or more.

Method: binary trie self-join. A text becomes a binary signature, one bit for each of its MinHash
minima, so two texts of similarity s differ in (1 - s) / 2 of their bits. The signatures of a
partition, in order, are a binary trie; node pairs are traversed together, level by level, their
differing bits add up, and a pair is pruned when it exceeds the Hamming budget of the threshold.

To split the join over a cluster, the tries are rooted at bands of four equal minima: a pair of
similarity 0.6 shares at least one of the 48 bands with probability 0.9987 (0.65: 0.9999), and its
bits stay in the budget with probability above 0.9999. Texts of equal shingle sets are one class
and enter the join once; candidate pairs of classes are verified exactly on the texts.

A band key shared by more classes than ``hot_rows`` doesn't gather in one task: its rows leave the
first pass unjoined and are joined block by block, each pair of blocks a task of its own. So are the
members of a class of more than ``hot_rows`` papers where the result wants them in pairs;
``near_duplicate_groups`` gives every paper its class and group instead, without any pair of copies.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.grams import mixed, rolling, without_space
from paperloom.llm.pairs import HOT_ROWS, pairs_within
from paperloom.operators.clusters import components
from paperloom.session import durable

SHINGLE = 8
THRESHOLD = 0.6
BANDS, ROWS = 48, 4
BITS = BANDS * ROWS
SMALL = 400  # sets under this size also get a signature of independent permutations
DEVIATIONS = 4.3  # of the number of differing bits at the threshold

ODD = mixed(np.arange(1, BITS + 1, dtype=np.uint64), 7) | np.uint64(1)
FLIP = mixed(np.arange(1, BITS + 1, dtype=np.uint64), 11)


def budget(threshold: float) -> int:
    rate = (1 - threshold) / 2
    return int(BITS * rate + DEVIATIONS * (BITS * rate * (1 - rate)) ** 0.5)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` characters, lower-cased and without white space."""
    return np.unique(mixed(rolling(without_space(text), size))) if text else np.zeros(0, np.uint64)


def one_permutation(hashes: np.ndarray) -> np.ndarray:
    """One minimum per bin of the hash range; an empty bin takes that of the next full one, with the distance mixed in."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BITS)) >> np.uint64(32)
    first = np.searchsorted(bins, np.arange(BITS, dtype=np.uint64))
    full = first < len(hashes)
    full[full] = bins[first[full]] == np.flatnonzero(full).astype(np.uint64)
    where = np.flatnonzero(full)
    to = np.searchsorted(where, np.arange(BITS))
    source = where[to % len(where)]
    distance = (source - np.arange(BITS)) % BITS
    return mixed(hashes[first[source]] + distance.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def permutations(hashes: np.ndarray) -> np.ndarray:
    return mixed(((hashes[None, :] ^ FLIP[:, None]) * ODD[:, None]).min(1))


def signature(minima: np.ndarray, space: int) -> tuple[bytes, np.ndarray]:
    """(bits, band keys) of the minima; keys of different ``space`` never meet."""
    bits = np.packbits((minima & np.uint64(1)).astype(np.uint8)).tobytes()
    keys = mixed(np.arange(BANDS, dtype=np.uint64), 100 + space)
    for row in minima.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return bits, keys.view(np.int64)


def sketches(texts: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, id, class, space, bits, keys): a row for each text that has shingles, a second one for a small set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, out = part.column(0).to_pylist(), ([], [], [], [], [], [])
                for k in range(len(fields)):
                    for i, text in zip(ids, part.column(k + 1).to_pylist()):
                        hashes = shingle_set(text)
                        if not len(hashes):
                            continue
                        same = int(hashes.sum()).to_bytes(8, "big") + int(np.bitwise_xor.reduce(mixed(hashes, 3))).to_bytes(8, "big") + len(hashes).to_bytes(8, "big")
                        found = [(0, one_permutation(hashes))]
                        if len(hashes) < SMALL:
                            found.append((1, permutations(hashes)))
                        for space, minima in found:
                            bits, keys = signature(minima, 2 * k + space)
                            for column, value in zip(out, (k, i, same, space, bits, keys)):
                                column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["field", "id", "class", "space", "bits", "keys"])

    return texts.mapInArrow(run, "field int, id long, class binary, space int, bits binary, keys array<long>")


def trie_join(groups: np.ndarray, words: np.ndarray, most: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same group that differ in at most ``most`` bits.

    groups: one number per row, ascending; words: the signatures as big-endian uint64 words, in
    order within a group. sides: if given, only pairs of different sides are kept.
    """
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(groups)].astype(np.int64)
    keep = ends - starts > 1
    a0, a1 = starts[keep], ends[keep]
    b0, b1, off = a0, a1, np.zeros(len(a0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(bits.shape[1] + 1):
        if not len(a0):
            break
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1) if depth < bits.shape[1] else np.ones(len(a0), bool)
        if leaf.any():
            for x0, x1, y0, y1 in zip(*(v[leaf & ((a1 - a0 > 1) | (b1 - b0 > 1))] for v in (a0, a1, b0, b1))):  # equal signatures
                x, y = (v.ravel() for v in np.meshgrid(np.arange(x0, x1), np.arange(y0, y1), indexing="ij"))
                found.append((x[x < y], y[x < y]))
            single = leaf & (a1 - a0 == 1) & (b1 - b0 == 1) & (a0 < b0)
            x, y = a0[single], b0[single]
            near = np.bitwise_count(words[x] ^ words[y]).sum(1) <= most
            found.append((x[near], y[near]))
            a0, a1, b0, b1, off = (v[~leaf] for v in (a0, a1, b0, b1, off))
            if not len(a0):
                break
        zeros = np.r_[0, np.cumsum(bits[:, depth] == 0)]
        am, bm = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        same = (a0 == b0) & (a1 == b1)
        parts = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        other = ~same
        parts.append(tuple(v[other] for v in (am, a1, b0, bm, off + 1)))
        a0, a1, b0, b1, off = (np.concatenate(v) for v in zip(*parts))
        live = (a1 > a0) & (b1 > b0) & (off <= most)
        a0, a1, b0, b1, off = (v[live] for v in (a0, a1, b0, b1, off))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = (np.concatenate(v) for v in zip(*found))
    if sides is not None:
        x, y = x[sides[x] != sides[y]], y[sides[x] != sides[y]]
    return x, y


def joined_rows(table: pa.Table, most: int, sided: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the candidate pairs of a run of whole groups (sorted by key, bits)."""
    group = table["key"].to_numpy()
    words = np.frombuffer(b"".join(table["bits"].to_pylist()), ">u8").astype(np.uint64).reshape(len(group), -1)
    ids = table["id"].to_numpy()
    x, y = trie_join(group, words, most, table["side"].to_numpy() if sided else None)
    pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def band_join(rows: DataFrame, most: int, hot_rows: int) -> DataFrame:
    """(a, b) or, for the rows of a hot key, (key, id, bits). rows: key, id, bits, partitioned and sorted by key."""
    names = ["a", "b", "key", "id", "bits"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def pairs(table: pa.Table) -> pa.RecordBatch:
        a, b = joined_rows(table, most, False)
        none = [pa.nulls(len(a), k) for k in kinds[2:]]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], names=names)

    def overflow(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in table.to_batches():
            none = [pa.nulls(batch.num_rows, k) for k in kinds[:2]]
            yield pa.RecordBatch.from_arrays([*none, *(batch.column(c).cast(k) for c, k in zip(names[2:], kinds[2:]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        hot = None  # the key whose rows overflow
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held["key"].to_numpy()
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                yield from overflow(held.slice(0, n))
                held, keys = held.slice(n), keys[n:]
                hot = hot if not len(keys) else None
                if not len(keys):
                    continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from whole(held.slice(0, last))
                held = held.slice(last)
            if held.num_rows > hot_rows:
                hot = int(keys[-1])
                yield from overflow(held)
                held = held.slice(held.num_rows)
        if held is not None and held.num_rows:
            yield from whole(held)

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = table["key"].to_numpy()
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)])
        size = np.repeat(sizes, sizes)
        large, some = size > hot_rows, (size > 1) & (size <= hot_rows)
        if large.any():
            yield from overflow(table.filter(pa.array(large)))
        if some.any():
            yield pairs(table.filter(pa.array(some)))

    return rows.mapInArrow(run, "a long, b long, key long, id long, bits binary")


def hot_join(rows: DataFrame, most: int, hot_rows: int) -> DataFrame:
    """(a, b) within the hot keys: each key in blocks, each pair of its blocks a group that one task can hold."""
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / F.lit(hot_rows // 2)).cast("int").alias("blocks"))
    placed = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = placed.select("key", "id", "bits", "block", others).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "id", "bits", F.when(F.col("block") == F.col("other"), F.xxhash64("id")).otherwise(F.col("block").cast("long")).alias("side")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield out(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield out(held)

    def out(table: pa.Table) -> pa.RecordBatch:
        a, b = joined_rows(table, most, True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return cells.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(run, "a long, b long")


def class_links(texts: DataFrame, fields: tuple[str, ...], threshold: float, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(k, id), every text with its class, and (a, b), the verified pairs of different classes. texts: id and the fields.

    A class is one set of shingles in one field; its number k is its least id times the number of
    fields, plus the field.
    """
    known = durable(sketches(texts, fields))
    members = known.where("space = 0").select("field", "class", "id").distinct()
    entered = known.groupBy("field", "class", "space").agg(F.min_by(F.struct("id", "bits", "keys"), "id").alias("r"))
    most, n = budget(threshold), len(fields)
    bands = entered.select((F.col("r.id") * n + F.col("field")).alias("id"), F.col("r.bits").alias("bits"), F.explode("r.keys").alias("key"))
    first = durable(band_join(bands.repartition("key").sortWithinPartitions("key", "bits"), most, hot_rows))
    pairs = first.where("a IS NOT NULL").select("a", "b")
    hot = first.where("a IS NULL").select("key", "id", "bits")
    if not hot.isEmpty():
        pairs = pairs.union(hot_join(hot, most, hot_rows))
    pairs = durable(pairs.where("a <> b").distinct())

    # exact verification: only texts that are in a candidate pair are fetched
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    long = texts.select((F.col("id") * n).alias("base"), F.posexplode(F.array(*fields)).alias("field", "text")).where("text IS NOT NULL").select((F.col("base") + F.col("field")).alias("k"), "text")
    kept = long.join(wanted, "k", "left_semi").dropDuplicates(["k"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()  # the sets of the last texts: rows come in the order of b

        def shingles(key: int, text: str) -> np.ndarray:
            if key not in held:
                held[key] = shingle_set(text)
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(key)
            return held[key]

        for batch in batches:
            good = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = shingles(a, x), shingles(b, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(kept.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(kept.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = both.mapInArrow(verify, "a long, b long")
    owners = members.groupBy("field", "class").agg(F.min("id").alias("rep"))
    owned = durable(members.join(owners, ["field", "class"]).select((F.col("rep") * n + F.col("field")).alias("k"), "id"))
    return owned, links


def prepared(papers: DataFrame, fields: tuple[str, ...], id_column: str) -> DataFrame:
    return papers.where(papers[id_column].isNotNull()).select(papers[id_column].cast("long").alias("id"), *(papers[f].cast("string").alias(f) for f in fields))


def field_of(k: str, fields: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(f) for f in fields)), (F.pmod(k, F.lit(len(fields))) + 1).cast("int"))


def near_duplicates(papers: DataFrame, fields: tuple[str, ...] = ("full_text", "abstract"), threshold: float = THRESHOLD, id_column: str = "paper_idx", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(paper_a, paper_b, field_name): pairs of different ids whose texts have a Jaccard similarity of at least ``threshold``.

    Texts without shingles (NULL, empty, blank, shorter than eight characters) and NULL ids match
    nothing; rows delivered twice count once; other columns are not read.
    """
    owned, links = class_links(prepared(papers, fields, id_column), fields, threshold, hot_rows)
    across = links.join(owned.select(F.col("k").alias("a"), F.col("id").alias("x")), "a").join(owned.select(F.col("k").alias("b"), F.col("id").alias("y")), "b").where("x <> y").select(F.col("a").alias("k"), "x", "y")
    found = pairs_within(owned, "k", "id", hot_rows).union(across)
    return found.select(F.least("x", "y").alias("paper_a"), F.greatest("x", "y").alias("paper_b"), field_of("k", fields).alias("field_name")).distinct()


def near_duplicate_groups(papers: DataFrame, fields: tuple[str, ...] = ("full_text", "abstract"), threshold: float = THRESHOLD, id_column: str = "paper_idx", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(paper_idx, field_name, class_id, group_id, links): one row for each paper and field with shingles.

    ``class_id`` is the least paper of those with the same set of shingles, ``group_id`` the least of
    all that a chain of similar texts reaches, ``links`` the number of other classes similar to this
    one. The cases of missing texts and ids are those of ``near_duplicates``.
    """
    owned, links = class_links(prepared(papers, fields, id_column), fields, threshold, hot_rows)
    n = len(fields)
    links = durable(links)
    groups = components(links.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"))).select(F.col("idx").alias("k"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("links"))
    rows = owned.join(groups, "k", "left").join(degree, "k", "left")
    number = lambda c: F.floor(F.col(c) / n).cast("long")
    return rows.select(F.col("id").alias("paper_idx"), field_of("k", fields).alias("field_name"), number("k").alias("class_id"), F.coalesce(number("component"), number("k")).alias("group_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
