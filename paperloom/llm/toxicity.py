"""Abusive, hateful and sexual content: a score for each document and category, and rates per source.

Method: non-negative positive-unlabelled learning. A linear numpy classifier a category is trained
with the class-prior-corrected, non-negative risk
``p E+[l(+)] + max(0, EU[l(-)] - p E+[l(-)])`` from confirmed examples (documents that people rated
with the category) and unlabelled text. A rating names a document, not the passage, so the units
are sentences: of each confirmed document the sentence that the classifier of the round before
finds likeliest is the positive example, and a document without any (raters make mistakes) gives
none. A document's score is that of its likeliest sentence, so long technical texts hide nothing.

Disguised words are undone first: look-alike letters of other scripts, digits and signs for
letters, invisible characters, spaced, dotted and stretched letters; words with asterisks stand
for the known words that they fit.

Both training sets are bounded samples: ``labelled`` rated and ``unlabelled`` other documents, those
of least hash, and of either at most ``SAMPLE_CHARS`` characters. Tasks cut the samples into features
and fit the categories, one task each. Every document is scored, whole, in one narrow pass.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.sentences import sentence_spans

CATEGORIES = ("abuse", "hate", "sexual")
LABELLED = 6_000
UNLABELLED = 6_000
DIMENSIONS = 1 << 18
ROUNDS = 3
FOLDS = 3
SAMPLE_CHARS = 20_000_000  # of a training sample; documents beyond it don't train
CROSS = 12_000  # unlabelled sentences in the rounds; the final classifiers use all of the sample
STEPS = 120
THRESHOLD = 0.5

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans("аеіорсухкнмтвѕјԁӏһԛԝ", "aeiopcyxkhmtbsjdlhqw")
SIGNS = str.maketrans("0134578@$€!|", "oieastbaseil")
INVISIBLE = regex.compile(r"[­​-‏⁠-⁤﻿]")


@cache
def patterns() -> dict[str, regex.Pattern]:
    return {
        "mixed": regex.compile(r"(?=\w*[a-z])(?=\w*\p{Cyrillic})[\p{L}\p{M}\p{N}]+"),
        "look": regex.compile(r"\p{Cyrillic}+"),
        "signed": regex.compile(r"(?<![\p{L}\p{N}])(?=[\p{L}\p{N}@$€!|]*\p{L})(?=[\p{L}\p{N}@$€!|]*[0134578@$€|])[\p{L}\p{N}@$€!|]{3,}(?![\p{L}\p{N}-])"),
        "apart": regex.compile(r"(?<![\p{L}\p{N}])\p{L}([ .\-_*·])\p{L}(?:\1\p{L})+(?![\p{L}\p{N}]|[.\-_*·]\p{L})"),
        "han_apart": regex.compile(r"(?<=\p{Han}) (?=\p{Han})"),
        "letters": regex.compile(r"[^\p{L}]"),
        "latin": regex.compile(r"[a-z]{3}"),
        "long": regex.compile(r"(\p{L})\1{2,}"),
        "token": regex.compile(r"\p{Latin}\*{2,}\p{Latin}*|[\p{Han}\p{Hiragana}\p{Katakana}ー]+|\p{Thai}+|[\p{L}\p{M}]+|\p{N}+"),
        "dense": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]"),
    }


# quick tests, so that a pattern runs only over a text that can hold it
CYRILLIC = re.compile("[\u0400-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f]")
HAN_APART = re.compile("[\u2e80-\u3007\u3021-\u3029\u3038-\u303b\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff] [\u2e80-\u3007\u3021-\u3029\u3038-\u303b\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SIGN = re.compile(r"[\d@$€|]")
SET_APART = re.compile(r"([ .\-_*·])[^\W\d_]\1[^\W\d_](?![^\W_])")
LETTER_BY_SIGN = re.compile(r"[^\W\d_]!*[\d@$€|]|[\d@$€|]!*[^\W\d_]")
THRICE = re.compile(r"([^\W\d_])\1\1")
ASCII_TOKEN = re.compile(r"[a-z]+\*{2,}[a-z]*|[a-z]+|[0-9]+")
STARRED = re.compile(r"[^\W\d_]\*\*")
# letters outside of Latin, Greek and Cyrillic, and marks: the others' words are runs of letters
OTHER_SCRIPT = re.compile("[^\u0000-\u02ff\u0370-\u0482\u048a-\u052f\u1e00-\u1fff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
PLAIN_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def opened(text: str) -> str:
    """The text in its letter case, without invisible characters, with letters set apart joined."""
    p = patterns()
    text = (text if text.isascii() else INVISIBLE.sub("", text)).replace("\n", " ")
    if SET_APART.search(text):
        text = p["apart"].sub(lambda m: p["letters"].sub("", m[0]), text)
    return p["han_apart"].sub("", text) if not text.isascii() and HAN_APART.search(text) else text


def plain(text: str) -> str:
    """An opened text in lower case with disguised words undone."""
    p = patterns()
    if text.isascii():
        text = text.lower()
    else:
        text = (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).lower()
        if CYRILLIC.search(text):
            text = p["mixed"].sub(lambda m: m[0].translate(LOOKALIKES), text)
            if p["latin"].search(text):
                text = p["look"].sub(lambda m: t if (t := m[0].translate(LOOKALIKES)).isascii() and len(t) > 2 else m[0], text)
    if SIGN.search(text):
        signed = lambda m: (word := m[0].rstrip("!")).translate(SIGNS) + m[0][len(word) :]
        text = " ".join([w if w.isalpha() or not SIGN.search(w) or not LETTER_BY_SIGN.search(w) else p["signed"].sub(signed, w) for w in text.split(" ")])
    return p["long"].sub(r"\1", text) if THRICE.search(text) else text


def units(text: str | None) -> list[list[str]]:
    """Tokens of each sentence; dense scripts as single characters."""
    if not text:
        return []
    p, out = patterns(), []
    whole = opened(text)
    # no line end is left in an opened text, so one keeps the sentences apart while all are made plain at once
    for line in plain("\n".join(whole[a:b] for a, b in sentence_spans(whole))).split("\n"):
        words: list[str] = []
        if line.isascii() and not STARRED.search(line):
            words = ["#" if w[0] <= "9" else w for w in ASCII_TOKEN.findall(line)]
        elif not OTHER_SCRIPT.search(line) and not STARRED.search(line):
            words = ["#" if w[0] <= "9" else w for w in PLAIN_TOKEN.findall(line)]
        else:
            for w in p["token"].findall(line):
                if p["dense"].match(w):
                    words.extend(w)
                else:
                    words.append("#" if w.isdigit() else w)
        if words:
            out.append(words)
    return out


class Codes(dict):
    """Hashes of words, remembered for some hundred thousand of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[word] = zlib.crc32(word.encode()) & 0x7FFFFFFF
        return found


CODES = Codes()


def features(sentences: list[list[str]], masked: dict[tuple[str, str, int], list[str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, sizes) of sentences: of each, the hashed features of its tokens, pairs and triples, ascending, each once."""
    if masked:
        sentences = [[next(iter(masked.get((w[0], w[-1], len(w)), [])), w) if "*" in w else w for w in words] if any("*" in w for w in words) else words for words in sentences]
    sizes = np.fromiter((len(words) for words in sentences), np.int64, len(sentences))
    h = np.fromiter(map(CODES.__getitem__, chain.from_iterable(sentences)), np.int64, sizes.sum())
    owner = np.repeat(np.arange(len(sentences)), sizes)
    two = (h[:-1] * 1_000_003 + h[1:] * 7_919 + 13) & 0x7FFFFFFFFFFF
    three = (two[:-1] * 31 + h[2:] * 104_729 + 29) & 0x7FFFFFFFFFFF
    pairs, triples = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    codes, owners = np.concatenate([h, two[pairs], three[triples]]), np.concatenate([owner, owner[:-1][pairs], owner[:-2][triples]])
    keys = np.sort(owners * DIMENSIONS + (((codes * 2_654_435_761 & 0x7FFFFFFFFFFF) >> 11) & (DIMENSIONS - 1)))
    found = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
    return found & (DIMENSIONS - 1), np.bincount(found // DIMENSIONS, minlength=len(sentences))


def indices(words: list[str], masked: dict[tuple[str, str, int], list[str]] | None = None) -> np.ndarray:
    """The features of one sentence."""
    return features([words], masked)[0]


class Rows:
    """Sparse binary rows with unit length; equal rows are kept once, with their share as weight."""

    def __init__(self, rows: Iterable[np.ndarray], merged: bool = False):
        if merged:
            counts: dict[bytes, int] = defaultdict(int)
            first: dict[bytes, np.ndarray] = {}
            for r in rows:
                counts[key := r.tobytes()] += 1
                first.setdefault(key, r)
            rows, share = list(first.values()), np.array(list(counts.values()), np.float64)
        else:
            rows = list(rows)
            share = np.ones(len(rows))
        self.set(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows], np.int64))
        self.share = share / max(share.sum(), 1)

    @classmethod
    def of(cls, columns: np.ndarray, sizes: np.ndarray) -> "Rows":
        rows = cls([])
        rows.set(columns, sizes)
        return rows

    def set(self, columns: np.ndarray, sizes: np.ndarray) -> None:
        self.columns, self.sizes = columns, sizes
        self.share = np.full(len(sizes), 1 / max(len(sizes), 1))
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def __len__(self) -> int:
        return len(self.sizes)

    def times(self, weights: np.ndarray, bias: float) -> np.ndarray:
        if not len(self):
            return np.zeros(0)
        return np.bincount(self.owner, weights[self.columns], len(self)) * self.scale + bias


class Side:
    """Rows of one side of the risk over the columns of both, sorted both ways: sums are runs."""

    def __init__(self, rows: Rows, names: np.ndarray):
        self.share, self.scale, self.columns = rows.share, rows.scale, np.searchsorted(names, rows.columns)
        self.starts = np.cumsum(rows.sizes) - rows.sizes
        order = np.argsort(self.columns, kind="stable")
        self.owner = rows.owner[order]
        self.known, self.heads = np.unique(self.columns[order], return_index=True)

    def times(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.add.reduceat(weights[self.columns], self.starts) * self.scale + bias

    def add_gradient(self, errors: np.ndarray, total: np.ndarray) -> None:
        total[self.known] += np.add.reduceat((errors * self.scale)[self.owner], self.heads)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nn_pu(positive: Rows, unlabelled: Rows, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss. Neither side, and no row, is empty."""
    names = np.union1d(positive.columns, unlabelled.columns)
    ours, theirs = Side(positive, names), Side(unlabelled, names)
    w, b = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    seen, seen_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(steps):
        zp, zu = ours.times(w, b), theirs.times(w, b)
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = theirs.share @ np.logaddexp(0, zu) - prior * (ours.share @ np.logaddexp(0, zp))
        gp, gu = prior * (sp - 1) * ours.share, su * theirs.share  # of p E+[l(+)] and of EU[l(-)]
        if negative >= 0:
            gp = gp - prior * sp * ours.share
        else:  # the corrected part fell below zero: step back from it
            gp, gu = gp + prior * sp * ours.share, -gu
        g = 1e-7 * w
        ours.add_gradient(gp, g)
        theirs.add_gradient(gu, g)
        gb = float(gp.sum() + gu.sum())
        seen += g * g
        seen_b += gb * gb
        w -= 0.5 * g / np.sqrt(seen)
        b -= 0.1 * gb / np.sqrt(seen_b)
    out = np.zeros(DIMENSIONS)
    out[names] = w
    return out, b


class Classifiers:
    def __init__(self, weights: dict[str, tuple[np.ndarray, float]], masked: dict[tuple[str, str, int], list[str]]):
        self.weights = {k: (w.astype(np.float32), b) for k, (w, b) in weights.items()}
        self.masked = masked

    def scores(self, texts: list[str | None]) -> list[tuple[float, ...]]:
        """Score of each category for each text."""
        sentences = [units(t) for t in texts]
        rows = Rows.of(*features([s for some in sentences for s in some], self.masked))
        found = {k: sigmoid(rows.times(w, b)) for k, (w, b) in self.weights.items()}
        out, at = [], 0
        for some in sentences:
            out.append(tuple(float(found[c][at : at + len(some)].max()) if some and c in found else 0.0 for c in CATEGORIES))
            at += len(some)
        return out


class Sample:
    """What the classifiers are trained on: the features of the sentences of rated documents, with votes, and of unlabelled ones."""

    def __init__(self, labelled: list[tuple[list[list[str]], dict[str, int]]], unlabelled: list[list[list[str]]], shares: dict[str, float]):
        """labelled: (sentences as tokens, votes by category, ``none`` among them); shares: of all rated documents, by category."""
        votes: dict[tuple, dict[str, int]] = {}
        for some, own in labelled:  # equal texts are one
            known = votes.setdefault(tuple(map(tuple, some)), defaultdict(int))
            for k, n in own.items():
                known[k] += n
        words = {w for some, v in votes.items() for s in some for w in s if len(w) > 3 and any(v.get(c) for c in CATEGORIES)}
        background = {w for some in unlabelled for s in some for w in s}
        masked: dict[tuple[str, str, int], list[str]] = defaultdict(list)
        for w in sorted(words, key=lambda w: (w in background, w)):
            if "*" not in w:
                masked[w[0], w[-1], len(w)].append(w)
        self.masked = dict(masked)
        own = self.rows([s for some in votes for s in some])
        self.bags = [([next(own) for _ in some], dict(v)) for some, v in votes.items()]
        self.pool = list(self.rows([s for some in unlabelled for s in some]))
        self.length = len(self.pool) / max(1, len(unlabelled))
        self.shares = shares

    def rows(self, sentences: list) -> Iterator[np.ndarray]:
        for at in range(0, len(sentences), 5_000):
            columns, sizes = features(sentences[at : at + 5_000], self.masked)
            yield from np.split(columns.astype(np.int32), np.cumsum(sizes)[:-1])


def fitted(sample: Sample, category: str) -> tuple[np.ndarray, float] | None:
    """The classifier of a category, or None where fewer than two documents are confirmed."""
    marked = [some for some, v in sample.bags if v.get(category, 0) and v.get(category, 0) >= v.get("none", 0) and some]
    pool = sample.pool
    if len(marked) < 2 or not pool:
        return None
    everything, small = Rows(pool, True), Rows(pool[:: max(1, len(pool) // CROSS)], True)
    base = np.bincount(everything.columns, everything.share[everything.owner], DIMENSIONS) * len(pool) + 0.5
    counts = np.bincount(np.concatenate([np.unique(np.concatenate(some)) for some in marked]), minlength=DIMENSIONS)
    odds = np.log((counts + 0.1) / (len(marked) + 1)) - np.log(base / (len(pool) + 1))
    odds[counts < 1] = 0
    prior = float(np.clip(sample.shares.get(category, 0.03) / sample.length, 5e-4, 0.2))
    chosen: list[np.ndarray | None] = [max(some, key=lambda s: float(np.mean(np.sort(odds[s])[-12:]))) for some in marked]
    for _ in range(ROUNDS):
        # a document's sentence is chosen by a classifier that hasn't seen the document, so that
        # what is special to one wrongly rated document isn't learnt
        following: list[np.ndarray | None] = [None] * len(marked)
        for fold in range(FOLDS):
            train = [s for i, s in enumerate(chosen) if s is not None and i % FOLDS != fold]
            if not train:
                continue
            w, b = nn_pu(Rows(train, True), small, prior, STEPS // 2)
            for i in range(fold, len(marked), FOLDS):
                z = Rows(marked[i]).times(w, b)
                following[i] = marked[i][int(np.argmax(z))] if z.max() > 0 else None
        if sum(s is not None for s in following) < 2:
            break
        chosen = following
    return nn_pu(Rows((s for s in chosen if s is not None), True), everything, prior)


def token_rows(rows: DataFrame, kept: str) -> DataFrame:
    """The rows with ``sentences``, the tokens of the sentences of ``text``, instead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = pa.array([units(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], cut], names=[*batch.schema.names[:-1], "sentences"])

    return rows.mapInArrow(run, f"{kept}, sentences array<array<string>>")


def bounded(ids: DataFrame, most: int) -> DataFrame:
    """The ids (doc_id, h, chars, a bounded number of rows), in the order of h, of together at most ``most`` characters."""
    before = F.sum("chars").over(Window.partitionBy(F.lit(0)).orderBy("h", "doc_id"))
    return ids.withColumn("before", before).where(F.col("before") <= most).drop("before", "chars", "h")


def training_sample(documents: DataFrame, ratings: DataFrame, labelled: int, unlabelled: int, most_chars: int = SAMPLE_CHARS) -> Sample:
    """The bounded samples, rated documents with their votes (confirmed ones first) and any documents; and the shares of the categories."""
    votes = ratings.where("doc_id IS NOT NULL AND category IS NOT NULL").groupBy("doc_id").agg(*(F.count_if(F.col("category") == c).alias(c) for c in (*CATEGORIES, "none")))
    total = votes.agg(F.count("*").alias("n"), *(F.avg(((F.col(c) > 0) & (F.col(c) >= F.col("none"))).cast("double")).alias(c) for c in CATEGORIES)).first()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = F.when(F.greatest(*CATEGORIES) > 0, 0).otherwise(1)
    chosen = votes.withColumn("h", F.struct(first.alias("first"), F.xxhash64("doc_id").alias("hash"))).orderBy("h", "doc_id").limit(labelled)
    sized = texts.select("doc_id", F.length("text").cast("long").alias("chars"))
    chosen = bounded(sized.join(F.broadcast(chosen), "doc_id"), most_chars)  # at most ``labelled`` ids; a text delivered twice counts twice
    rows = texts.join(F.broadcast(chosen.distinct()), "doc_id").select(*CATEGORIES, "none", "text")
    known = [(r.sentences, {c: r[c] for c in (*CATEGORIES, "none")}) for r in token_rows(rows, ", ".join(f"{c} long" for c in (*CATEGORIES, "none"))).toLocalIterator()]
    ids = sized.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(unlabelled)
    others = texts.join(F.broadcast(bounded(ids, most_chars).distinct()), "doc_id", "left_semi").select("doc_id", "text")
    return Sample(known, [r.sentences for r in token_rows(others, "doc_id long").toLocalIterator()], {c: total[c] or 0.0 for c in CATEGORIES})


def trained(documents: DataFrame, ratings: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> Classifiers:
    """The classifiers of all categories, each fitted in a task of its own.

    The last ones stay with the session: queries over the same tables (by their plans, and by the
    numbers and hashes of their ids and ratings) are trained once.
    """
    context = documents.sparkSession.sparkContext
    seen = lambda rows, *columns: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())
    key = (documents.semanticHash(), ratings.semanticHash(), seen(documents, "doc_id"), seen(ratings, "doc_id", "category"), labelled, unlabelled)
    known = getattr(context, "_paperloom_content", None)
    if known is None or known[0] != key:
        known = context._paperloom_content = key, newly_trained(documents, ratings, labelled, unlabelled)
    return known[1]


def newly_trained(documents: DataFrame, ratings: DataFrame, labelled: int, unlabelled: int) -> Classifiers:
    spark = documents.sparkSession
    sample = training_sample(documents, ratings, labelled, unlabelled)
    shared = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(sample, 5), 1))  # of bounded size

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for category in batch.column(0).to_pylist():
                found = fitted(pickle.loads(zlib.decompress(shared.value)), category)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([category]), pa.array([found[0].astype(np.float32).tobytes()], pa.binary()), pa.array([found[1]], pa.float64())], names=["category", "weights", "bias"])

    parts = spark.range(len(CATEGORIES), numPartitions=len(CATEGORIES)).select(F.element_at(F.array(*(F.lit(c) for c in CATEGORIES)), (F.col("id") + 1).cast("int")).alias("category"))
    found = parts.mapInArrow(fit, "category string, weights binary, bias double").collect()
    shared.unpersist()
    return Classifiers({r.category: (np.frombuffer(r.weights, np.float32), r.bias) for r in found}, sample.masked)


def content_scores(documents: DataFrame, ratings: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, model: Classifiers | None = None) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual): a row for each row of ``documents``.

    NULL, empty and blank texts score 0; without ratings of a category (or any table empty) all
    its scores are 0. One narrow pass; other columns are not read. ``model``: classifiers that
    ``trained`` made before.
    """
    model = documents.sparkSession.sparkContext.broadcast(model or trained(documents, ratings, labelled, unlabelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                scores = model.value.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([s[k] for s in scores], pa.float64()) for k in range(len(CATEGORIES)))], names=["doc_id", "source", *CATEGORIES])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, source string, abuse double, hate double, sexual double")


def found_content(documents: DataFrame, ratings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, category): one row per document and category that applies."""
    scores = content_scores(documents, ratings)
    applies = F.array_compact(F.array(*(F.when(F.col(c) >= threshold, F.lit(c)) for c in CATEGORIES)))
    return scores.where("doc_id IS NOT NULL").select("doc_id", F.explode(applies).alias("category")).distinct()


def content_rates(documents: DataFrame, ratings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_docs, abuse_rate, hate_rate, sexual_rate), a row per source, the NULL one included."""
    scores = content_scores(documents, ratings)
    return scores.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.round(F.avg((F.col(c) >= threshold).cast("double")), 6).alias(f"{c}_rate") for c in CATEGORIES))
