"""TF-IDF vectors and exact cosine joins.

A vector is a row (idx, terms ARRAY<BIGINT>, weights ARRAY<DOUBLE>) of unit length, its terms
ascending. ``fit`` makes the vocabulary in one pass whose tasks sum their counts before the shuffle;
``transform`` is a narrow map that emits kept terms only, so no n-gram of a text is ever written.

Joins are exact. The threshold join meets on the rare terms of each vector's prefix (a pair of
cosine t shares a term of both prefixes, by Cauchy-Schwarz) or multiplies sparse blocks of rows; the
number of meetings decides. The join for the first k pairs in reading order holds a front of bounded
size against all rows, and where that has too few pairs the threshold join makes the others.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.dictionaries import ENGLISH_STOPS
from paperloom.session import durable

BLANK = "placeholder"
BLOCKS = (512, 65_536)  # least and largest number of rows in a block of the block join
BLOCK_TERMS = 2_000_000  # terms of a block, some 32 MB
FOLDED = 0.3  # threshold from which the block join bounds pairs by folded vectors
FOLD_MASS = 2.0  # columns of a folded vector for each term of a row, times the squared threshold
TILE, TILE_NUMBERS = (1024, 2048), 4_000_000  # rows of both sides of a tile, numbers that it holds at once
GROUP_KEYS, GROUP_COSINE = 256, 0.25  # keys by which a block's rows are put in groups, least cosine of keys in one
PAIR_ROWS = 250_000  # pairs of an Arrow batch
FRONTS = (64, 512, 4096)  # rows of the fronts that look for the first pairs
MEETING_BYTES, POSTING_BYTES = 32, 16  # of a pair that meets, of a term in a row
HOT_TERM = 20_000  # postings of a term beyond which its meetings are dealt to several tasks
HELD_TERMS = 1_000_000  # different terms that a task counts before it hands them on
HELD_NUMBERS = 4_000_000  # terms of texts that it notes before it adds them up


def filled(text: Column) -> Column:
    return F.when(F.length(F.regexp_replace(text, r"(?U)\s", "")) == 0, F.lit(BLANK)).otherwise(text)


STOPS = frozenset(ENGLISH_STOPS)
WORD = regex.compile(r"[\p{L}\p{N}_]{2,}")
SPACES = re.compile(r"\s\s+")
Tokens = Callable[[str], Iterable[str]]


def word_tokens(text: str, bigrams: bool = True) -> list[str]:
    """Lower-cased words of two and more characters without English stop words, and pairs of what remains."""
    words = [w for w in WORD.findall(text.lower()) if w not in STOPS]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else words


def char_tokens(text: str, low: int, high: int) -> list[str]:
    """Character n-grams of the lower-cased text, runs of blanks taken as one."""
    t = SPACES.sub(" ", text.lower())
    return [t[k : k + n] for n in range(low, high + 1) for k in range(len(t) - n + 1)]


def words(bigrams: bool = True) -> Tokens:
    return partial(word_tokens, bigrams=bigrams)


def chars(low: int, high: int) -> Tokens:
    return partial(char_tokens, low=low, high=high)


def prepared(texts: DataFrame, blank: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return texts.select(F.col("idx").cast("long").alias("idx"), (filled(text) if blank else text).alias("text"))


def counted(texts: DataFrame, tokens: Tokens, blank: bool = True) -> DataFrame:
    """(idx, term, tf) of ``texts`` (idx, text). ``blank``: a blank text is one placeholder word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, found, counts = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = Counter(tokens(text))
                    ids += [i] * len(own)
                    found += own.keys()
                    counts += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["idx", "term", "tf"])

    return prepared(texts, blank).mapInArrow(run, "idx long, term string, tf long")


def word_counts(texts: DataFrame, bigrams: bool = True, blank: bool = True) -> DataFrame:
    """Counts of words and word pairs."""
    return counted(texts, words(bigrams), blank)


def char_counts(texts: DataFrame, low: int, high: int) -> DataFrame:
    """Counts of character n-grams."""
    return counted(texts, chars(low, high))


def corpus_counts(texts: DataFrame, tokens: Tokens, blank: bool = True) -> DataFrame:
    """(term, ctf, df) over all texts, and a row of NULL term whose df is the number of texts; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # terms get numbers as they come, so each costs one lookup; the numbers are counted by the array
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        every, once = array("i"), array("i")
        ctf = df = np.zeros(0, np.int64)
        n = 0

        def summed(known: np.ndarray, found: array) -> np.ndarray:
            out = np.bincount(np.frombuffer(found, np.int32), minlength=len(number))
            out[: len(known)] += known
            return out

        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(number.keys(), pa.string()), pa.array(summed(ctf, every), pa.int64()), pa.array(summed(df, once), pa.int64())], names=["term", "ctf", "df"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = [number[t] for t in tokens(text)]
                every.extend(found)
                once.extend(set(found))
                n += 1
                if len(number) > HELD_TERMS:
                    yield emitted()
                    number.clear()
                    every, once, ctf, df = array("i"), array("i"), ctf[:0], df[:0]
                elif len(every) > HELD_NUMBERS:
                    ctf, df, every, once = summed(ctf, every), summed(df, once), array("i"), array("i")
        yield emitted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["term", "ctf", "df"])

    parts = prepared(texts, blank).mapInArrow(run, "term string, ctf long, df long")
    return parts.groupBy("term").agg(F.sum("ctf").alias("ctf"), F.sum("df").alias("df"))


def vocabulary(texts: DataFrame, tokens: Tokens, features: int, blank: bool = True) -> DataFrame:
    """(term, ctf, df) of the ``features`` terms of highest corpus count, ties by term."""
    return corpus_counts(texts, tokens, blank).where("term IS NOT NULL").orderBy(F.desc("ctf"), "term").limit(features)


@dataclass(frozen=True)
class Vocabulary:
    """The terms of a fit, rarest first (a term's number is its place), their weights, and how texts are cut into terms."""

    terms: list[str]
    idf: np.ndarray
    tokens: Tokens
    blank: bool


def fit(texts: DataFrame, tokens: Tokens, features: int, blank: bool = True) -> Vocabulary:
    """The ``features`` terms of highest corpus count with the smoothed idf ``ln((1 + n) / (1 + df)) + 1``; so many rows reach the driver."""
    counts = corpus_counts(texts, tokens, blank).orderBy(F.col("term").isNotNull(), F.desc("ctf"), "term").limit(features + 1).collect()
    n = sum(r.df for r in counts if r.term is None)
    kept = sorted((r.df, r.term) for r in counts if r.term is not None)
    return Vocabulary([t for _, t in kept], np.log((1.0 + n) / (1.0 + np.array([d for d, _ in kept], np.float64))) + 1.0, tokens, blank)


def transform(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """(idx, terms, weights): unit vectors of texts over a fitted vocabulary; a text without any of its terms has no row."""
    shared = texts.sparkSession.sparkContext.broadcast(known)  # at most ``features`` terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        number = {t: i for i, t in enumerate(fitted.terms)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, sizes, found, weights = [], [0], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = np.array([k for k in map(number.get, fitted.tokens(text)) if k is not None], np.int64)
                    if len(own):
                        own, tf = np.unique(own, return_counts=True)
                        w = tf * fitted.idf[own]
                        ids.append(i)
                        sizes.append(len(own))
                        found.append(own)
                        weights.append(w / np.sqrt(w @ w))
                offsets = pa.array(np.cumsum(sizes), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v) if v else np.zeros(0, k))) for v, k in ((found, np.int64), (weights, np.float64))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["idx", "terms", "weights"])

    return prepared(texts, known.blank).mapInArrow(run, "idx long, terms array<long>, weights array<double>")


def vectors(texts: DataFrame, tokens: Tokens, features: int, blank: bool = True) -> DataFrame:
    """(idx, terms, weights) of the texts over the vocabulary of the same texts."""
    return transform(texts, fit(texts, tokens, features, blank))


def tfidf(texts: DataFrame, tokens: Tokens, features: int, blank: bool = True) -> DataFrame:
    """(idx, term, w): the vectors in long form, a row a term."""
    known = fit(texts, tokens, features, blank)
    names = texts.sparkSession.createDataFrame(list(enumerate(known.terms)), "number long, term string")
    rows = transform(texts, known).select("idx", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    return rows.select("idx", F.col("x.terms").alias("number"), F.col("x.weights").alias("w")).join(F.broadcast(names), "number").select("idx", "term", "w")  # at most ``features`` rows


def embedded(texts: DataFrame, model: Callable[[list[str]], np.ndarray], batch_rows: int = 256) -> DataFrame:
    """(idx, terms, weights): dense unit vectors of any model that maps a list of texts to a matrix, in the form that the joins take.

    Blank and NULL texts are the placeholder word; a row of zeros (or not finite) has no vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                matrix = np.asarray(model(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                norm = np.sqrt((matrix * matrix).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                unit = matrix[good] / norm[good, None]
                offsets = pa.array(np.arange(len(unit) + 1) * matrix.shape[1], pa.int32())
                terms = np.tile(np.arange(matrix.shape[1]), len(unit))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], names=["idx", "terms", "weights"])

    return prepared(texts, True).mapInArrow(run, "idx long, terms array<long>, weights array<double>")


def as_arrays(long: DataFrame) -> DataFrame:
    """(idx, terms, weights) of vectors in long form; terms as hashes."""
    row = F.sort_array(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "w")))
    return long.groupBy(F.col("idx").cast("long").alias("idx")).agg(row.alias("r")).select("idx", F.transform("r", lambda x: x["t"]).alias("terms"), F.transform("r", lambda x: x["w"]).alias("weights"))


def kept_pairs(s: np.ndarray, threshold: float, above: bool) -> np.ndarray:
    return s > threshold if above else s >= threshold - 1e-12


class Postings:
    """Sparse rows by term; products of a row with all of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.ids, self.known = ids, np.unique(terms)
        self.rows, self.weights = np.repeat(np.arange(len(ids)), sizes)[order].astype(np.int32), weights[order]
        self.starts = np.r_[np.searchsorted(terms[order], self.known), len(terms)]

    def products(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(self.known) or not len(terms):
            return np.zeros(len(self.ids))
        at = np.minimum(np.searchsorted(self.known, terms), len(self.known) - 1)
        hit = self.known[at] == terms
        low, high = self.starts[at[hit]], self.starts[at[hit] + 1]
        sizes = high - low
        where = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.rows[where], self.weights[where] * np.repeat(weights[hit], sizes), len(self.ids))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.r_[0, np.cumsum(sizes)], column.flatten().to_numpy()


PAIR = "idx_a long, idx_b long, similarity double"


def cosine_pairs(rows: DataFrame, threshold: float, above: bool = False, method: str | None = None, hot_term: int = HOT_TERM) -> DataFrame:
    """(idx_a, idx_b, similarity): all pairs idx_a < idx_b of at least (``above``: more than) ``threshold``, exactly.

    ``method`` is "prefix" (candidates that share a rare term, bounded by what their other terms can
    add, then their dot products) or "blocks" (products of sparse blocks of rows); both give the
    same pairs. By default the one decides that has less to shuffle: the meetings on prefix terms, or
    the rows as often as there are blocks.
    """
    rows = durable(rows)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (offsets, terms), (_, weights) = list_parts(batch.column(1)), list_parts(batch.column(2))
            ends = np.repeat(offsets[1:], np.diff(offsets))
            sums = np.r_[0, np.cumsum(weights * weights)]
            from_here, after = np.sqrt(np.maximum(sums[ends] - sums[:-1], 0)), np.sqrt(np.maximum(sums[ends] - sums[1:], 0))
            keep = from_here >= threshold - 1e-6
            ids = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(terms[keep]), pa.array(weights[keep]), pa.array(after[keep])], names=["idx", "term", "w", "after"])

    prefix = rows.mapInArrow(prefixes, "idx long, term long, w double, after double")
    n, postings = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = block_count(n, postings, rows)
    if method is None:
        met = prefix.groupBy("term").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0
        method = "blocks" if met * MEETING_BYTES > postings * POSTING_BYTES * blocks else "prefix"
    if method == "blocks":
        return block_products(rows, threshold, above, blocks)
    prefix = durable(prefix)
    return prefix_products(rows, prefix, prefix.groupBy("term").count(), threshold, above, hot_term)


def prefix_products(rows: DataFrame, prefix: DataFrame, counts: DataFrame, threshold: float, above: bool, hot_term: int) -> DataFrame:
    # a hot term's postings are dealt to tasks on one side and copied to them on the other
    hot = counts.where(F.col("count") > hot_term).select("term", F.ceil(F.col("count") / hot_term).cast("int").alias("salts"))
    salted = prefix.join(hot, "term", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = salted.select("term", F.pmod(F.xxhash64("idx"), F.col("salts")).cast("int").alias("salt"), F.col("idx").alias("idx_a"), F.col("w").alias("wa"), F.col("after").alias("fa"))
    right = salted.select("term", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("idx").alias("idx_b"), F.col("w").alias("wb"), F.col("after").alias("fb"))
    met = left.join(right, ["term", "salt"]).where("idx_a < idx_b").groupBy("idx_a", "idx_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("sure"), F.min(F.col("fa") * F.col("fb")).alias("open"))
    pairs = met.where(F.col("sure") + F.col("open") >= threshold - 1e-6).select("idx_a", "idx_b")

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            lists = [list_parts(batch.column(i)) for i in range(2, 6)]
            for k in range(batch.num_rows):
                ta, wa, tb, wb = (v[o[k] : o[k + 1]] for o, v in lists)
                at = np.minimum(np.searchsorted(ta, tb), len(ta) - 1)
                found[k] = float((wa[at] * (ta[at] == tb)) @ wb)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["idx_a", "idx_b", "similarity"]).filter(pa.array(kept_pairs(found, threshold, above)))

    a = rows.select(F.col("idx").alias("idx_a"), F.col("terms").alias("ta"), F.col("weights").alias("wa"))
    b = rows.select(F.col("idx").alias("idx_b"), F.col("terms").alias("tb"), F.col("weights").alias("wb"))
    return pairs.join(a, "idx_a").join(b, "idx_b").select("idx_a", "idx_b", "ta", "wa", "tb", "wb").mapInArrow(dots, PAIR)


def block_count(n: int, postings: int, rows: DataFrame) -> int:
    """A row goes to every pair of blocks that its own is in, so blocks are as few as memory and cores allow."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // BLOCKS[1]), -(-postings // BLOCK_TERMS), min(-(-n // BLOCKS[0]), int((6 * cores) ** 0.5)))


@dataclass(frozen=True)
class Block:
    """Sparse rows, one after another; terms are numbers of this task."""

    ids: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def taken(self, rows: np.ndarray) -> "Block":
        sizes = np.diff(self.starts)[rows]
        where = spans(self.starts[rows], sizes)
        return Block(self.ids[rows], np.r_[0, np.cumsum(sizes)], self.terms[where], self.weights[where])

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.starts))

    def within(self, known: np.ndarray) -> "Block":
        """The rows with those of their terms that ``known`` has a number for, under that number."""
        keep = known[self.terms] >= 0
        sizes = np.bincount(self.owners()[keep], minlength=len(self.ids))
        return Block(self.ids, np.r_[0, np.cumsum(sizes)], known[self.terms[keep]], self.weights[keep])

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.owners(), self.weights * self.weights, len(self.ids)))


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def blocks_of(batches: Iterable[pa.RecordBatch]) -> tuple[Block, Block, int]:
    """The lower and the higher block of a group (the same one twice on the diagonal) and the number of their terms."""
    parts: dict[int, list] = {}
    pair = (0, 0)
    for batch in batches:
        block, low, high = (batch.column(c).to_numpy() for c in ("block", "low", "high"))
        pair = (int(low[0]), int(high[0])) if len(low) else pair
        for k in np.unique(block):
            own = batch.filter(pa.array((block == k) & (batch.column("terms").value_lengths().to_numpy(zero_copy_only=False) > 0)))
            (offsets, terms), (_, weights) = list_parts(own.column("terms")), list_parts(own.column("weights"))
            parts.setdefault(int(k), []).append((own.column("idx").to_numpy(), np.diff(offsets), terms, weights))
    joined = {k: [np.concatenate(x) for x in zip(*v)] for k, v in parts.items()}
    parts.clear()
    known = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(v[2]) for v in joined.values())]))
    found = {k: Block(v[0], np.r_[0, np.cumsum(v[1])], np.searchsorted(known, v[2]).astype(np.int32), v[3]) for k, v in joined.items()}
    none = Block(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))
    return found.get(pair[0], none), found.get(pair[1], none), len(known)


def tiles(block: Block, terms: int, most: int) -> list[Block]:
    """The rows in tiles of up to ``most``, those of one vocabulary (a language, a subject) together, so that few terms are common to two tiles.

    A row's key is its most frequent term; keys whose rows have alike sums are one group.
    """
    if not len(block.ids):
        return []
    df = np.bincount(block.terms, minlength=terms)
    key = np.maximum.reduceat(df[block.terms] * terms + block.terms, block.starts[:-1]) % terms
    keys, of, count = np.unique(key, return_inverse=True, return_counts=True)
    largest = np.argsort(-count, kind="stable")[: max(1, min(GROUP_KEYS, TILE_NUMBERS // terms))]
    place = np.full(len(keys), -1)
    place[largest] = np.arange(len(largest))
    owner = place[of][block.owners()]
    own = owner >= 0
    sums = np.bincount(owner[own] * terms + block.terms[own], block.weights[own], len(largest) * terms).reshape(-1, terms)
    sums /= np.maximum(np.sqrt((sums * sums).sum(1)), 1e-300)[:, None]
    alike = sums @ sums.T
    group, leaders = np.full(len(keys), len(largest)), []
    for k in range(len(largest)):
        near = max(leaders, key=lambda x: alike[k, x], default=None)
        if near is None or alike[k, near] < GROUP_COSINE:
            near = k
            leaders.append(k)
        group[largest[k]] = near
    size = np.bincount(group[of], minlength=len(largest) + 1)
    group[size[group] < most // 4] = len(largest)  # small groups share their tiles
    order = np.argsort(group[of], kind="stable")
    edges = np.r_[0, np.flatnonzero(np.diff(group[of][order])) + 1, len(order)]
    return [block.taken(order[x : min(x + most, high)]) for low, high in zip(edges, edges[1:]) for x in range(low, high, most)]


def fold(block: Block, column: np.ndarray, single: np.ndarray) -> np.ndarray:
    """A row for each vector: the norm of its terms of each column, or its own weight where the column has a single term."""
    n, width = len(block.ids), len(single)
    key, w = block.owners() * width + column[block.terms], block.weights
    out = np.sqrt(np.bincount(key, w * w, n * width)).reshape(n, width)
    if len(w) and w.min() < 0:
        out[:, single] = np.bincount(key, w, n * width).reshape(n, width)[:, single]
    return out.astype(np.float32)


def folded_products(left: Block, right: Block, terms: int, threshold: float, above: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(idx, idx, similarity) of the pairs at or above the threshold, each once; ``left`` may be ``right``.

    Only rows whose common terms have norms that can reach the threshold are multiplied. Their common
    terms are dealt to columns, the most frequent ones alone; by Cauchy-Schwarz the products of the
    norms in each column add up to no less than the cosine, so a dense product of short rows bounds
    all pairs of a tile. What reaches the threshold is multiplied term by term.
    """
    first = tiles(left, terms, TILE[0])
    second = first if left is right else tiles(right, terms, TILE[1])
    for k, a in enumerate(first):
        for b in second[k:] if left is right else second:
            yield from tile_products(a, b, terms, threshold, above)


def tile_products(a: Block, b: Block, terms: int, threshold: float, above: bool) -> Iterator[tuple[np.ndarray, ...]]:
    same = a is b
    if not same:
        for _ in range(3):
            common = np.flatnonzero((np.bincount(a.terms, minlength=terms) > 0) & (np.bincount(b.terms, minlength=terms) > 0))
            if not len(common):
                return
            known = np.full(terms, -1)
            known[common] = np.arange(len(common))
            a, b, terms = a.within(known), b.within(known), len(common)
            x, y = a.norms(), b.norms()
            keep = np.flatnonzero(x * y.max() >= threshold - 1e-6), np.flatnonzero(y * x.max() >= threshold - 1e-6)
            if not len(keep[0]) or not len(keep[1]):
                return
            less = len(keep[0]) < len(x) or len(keep[1]) < len(y)
            a, b = a.taken(keep[0]), b.taken(keep[1])
            if not less:
                break
    count = np.bincount(a.terms, minlength=terms) + np.bincount(b.terms, minlength=terms)
    common = np.argsort(-count, kind="stable")
    terms = int((count > 0).sum())
    mean = max(len(x.terms) / len(x.ids) for x in (a, b))
    width = max(64, 16 * int(np.ceil(mean * FOLD_MASS / threshold**2 / 16)))
    width, alone = (terms, terms) if terms <= 2 * width else (width, width // 2)
    column = np.empty(len(common), np.int64)
    column[common[:alone]] = np.arange(alone)
    column[common[alone:]] = alone + np.arange(len(common) - alone) % max(1, width - alone) if width > alone else 0
    single = np.bincount(column[common[:terms]], minlength=width) == 1
    low_a = fold(a, column, single)
    low_b = low_a if same else fold(b, column, single)
    least = np.float32(threshold - 1e-9 - 1.2e-7 * (width + 8))  # less what single precision can lose
    hits = np.flatnonzero((low_a @ low_b.T).ravel() >= least)
    i, j = hits // len(b.ids), hits % len(b.ids)
    if same:
        i, j = (x[i < j] for x in (i, j))
    owners, step = a.owners(), max(1, TILE_NUMBERS // max(1, len(common)))
    for low in range(0, len(a.ids), step):  # so many rows are dense at once
        high = min(len(a.ids), low + step)
        p, q = (x[np.searchsorted(i, low) : np.searchsorted(i, high)] for x in (i, j))
        if not len(p):
            continue
        dense, own = np.zeros((high - low) * len(common)), slice(a.starts[low], a.starts[high])
        dense[(owners[own] - low) * len(common) + a.terms[own]] = a.weights[own]
        most = max(1, int(TILE_NUMBERS / 8 / max(1.0, mean)))
        for k in range(0, len(p), most):
            x, y = p[k : k + most], q[k : k + most]
            size = b.starts[y + 1] - b.starts[y]
            where = spans(b.starts[y], size)
            parts = dense.take(np.repeat((x - low) * len(common), size) + b.terms.take(where)) * b.weights.take(where)
            s = np.add.reduceat(np.append(parts, 0.0), np.cumsum(size) - size) * (size > 0)
            keep = kept_pairs(s, threshold, above)
            yield a.ids[x[keep]], b.ids[y[keep]], s[keep]


def row_products(left: Block, right: Block, threshold: float, above: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """The same by the postings of ``left``, a row of ``right`` at a time: for thresholds that most pairs reach."""
    index = Postings(left.ids, np.diff(left.starts), left.terms, left.weights)
    for k, j in enumerate(right.ids):
        own = slice(right.starts[k], right.starts[k + 1])
        s = index.products(right.terms[own], right.weights[own])
        keep = np.flatnonzero(kept_pairs(s, threshold, above) & (index.ids < j if left is right else index.ids != j))
        yield index.ids[keep], np.full(len(keep), j), s[keep]


def pair_batches(found: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of pairs with the lesser idx first, of some ``PAIR_ROWS`` rows; no more is held."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def batch() -> pa.RecordBatch:
        x, y, s = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(s)], names=["idx_a", "idx_b", "similarity"])

    for part in found:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= PAIR_ROWS:
            yield batch()
            held.clear()
            n = 0
    if held:
        yield batch()


def block_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows with their block, once for each pair of blocks (low, high) that it is in."""
    block = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")
    cells = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return cells.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def block_products(rows: DataFrame, threshold: float, above: bool, blocks: int) -> DataFrame:
    """The pairs by products of blocks of rows; a task holds two blocks, and hands its pairs on as it finds them."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, terms = blocks_of(batches)
        found = folded_products(left, right, terms, threshold, above) if threshold >= FOLDED else row_products(left, right, threshold, above)
        yield from pair_batches(found)

    return block_cells(rows, blocks).groupBy("low", "high").applyInArrow(product, PAIR)


def named_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(idx_a, name_a, idx_b, name_b, similarity): the pairs above the threshold of rows with a ``name`` each (NULL too).

    The names go with the rows of the blocks, so that of the pairs, which may be a whole matrix, nothing is shuffled.
    """
    rows = durable(rows)
    n, postings = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names = [], []

        def told() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids.append(batch.column("idx").to_numpy())
                names.append(pa.array(batch.column("name")))
                yield batch

        left, right, terms = blocks_of(told())
        known, first = np.unique(np.concatenate(ids), return_index=True)
        all_ = pa.concat_arrays(names).take(pa.array(first))
        found = folded_products(left, right, terms, threshold, True) if threshold >= FOLDED else row_products(left, right, threshold, True)
        for batch in pair_batches(found):
            a, b = (all_.take(pa.array(np.searchsorted(known, batch.column(c).to_numpy()))) for c in ("idx_a", "idx_b"))
            yield pa.RecordBatch.from_arrays([batch.column(0), a, batch.column(1), b, batch.column(2)], names=["idx_a", "name_a", "idx_b", "name_b", "similarity"])

    return block_cells(rows, block_count(n, postings, rows)).groupBy("low", "high").applyInArrow(product, "idx_a long, name_a string, idx_b long, name_b string, similarity double")


def first_pairs(rows: DataFrame, threshold: float, most: int, fronts: tuple[int, ...] = FRONTS) -> DataFrame:
    """(idx_a, idx_b, similarity): of the pairs at or above the threshold the first ``most`` in the order of (idx_a, idx_b).

    A front of rows, the largest of 4,096, goes sparse to all tasks and is held against all rows.
    Usually it has the pairs; where it hasn't, the threshold join over all rows makes them.
    """
    spark = rows.sparkSession
    rows = durable(rows)
    for size in fronts:
        front = rows.orderBy("idx").limit(size).collect()  # of bounded number
        ids = np.array([r.idx for r in front], np.int64)
        joined = lambda c, k: np.array([x for r in front for x in r[c]], k)
        shared = spark.sparkContext.broadcast(Postings(ids, np.array([len(r.terms) for r in front], np.int64), joined("terms", np.int64), joined("weights", np.float64)))

        def dots(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                (offsets, terms), (_, weights) = list_parts(batch.column(1)), list_parts(batch.column(2))
                out: tuple[list, ...] = ([], [], [])
                for k, j in enumerate(batch.column(0).to_numpy()):
                    s = index.products(terms[offsets[k] : offsets[k + 1]], weights[offsets[k] : offsets[k + 1]])
                    for i in np.flatnonzero(kept_pairs(s, threshold, False) & (index.ids < j)):
                        out[0].append(int(index.ids[i]))
                        out[1].append(int(j))
                        out[2].append(float(s[i]))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["idx_a", "idx_b", "similarity"])

        found = durable(rows.mapInArrow(dots, PAIR).orderBy("idx_a", "idx_b").limit(most))
        if len(front) < size or found.count() >= most:
            return found
    return cosine_pairs(rows, threshold).orderBy("idx_a", "idx_b").limit(most)


def text_cosine(a: str | None, b: str | None) -> float:
    """Cosine of two texts, TF-IDF fitted on just the two: an idf of 1 for a shared term, ln 1.5 + 1 for another."""
    x, y = (Counter(word_tokens(t if t and t.strip() else BLANK)) for t in (a, b))
    if not x or not y:
        return 0.0
    other = float(np.log(3 / 2) + 1)
    norm = lambda own, rest: sum((n * (1.0 if t in rest else other)) ** 2 for t, n in own.items()) ** 0.5
    return sum(n * y[t] for t, n in x.items() if t in y) / (norm(x, y) * norm(y, x))


def similarity(a: str, b: str) -> Column:
    """``text_cosine`` of two columns, by Arrow batches."""

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([text_cosine(p, q) for p, q in zip(x, y)], dtype="float64")

    return cosine(a, b)
