"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every byte prefix of a pre-token the encoding has exactly
one last token, the token that ends the prefix and is compatible with the last token of the prefix
before it. Storing that token per prefix makes appends exact (later cells only) and lets an edit
re-encode from the first changed byte on.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# The pre-token pattern published with this vocabulary.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CACHE_ENTRIES = 200_000  # pre-tokens kept per Python worker; a full cache is emptied, results stay the same


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class PrefixEncoder:
    """Ids of byte strings under a rank-ordered vocabulary."""

    def __init__(self, vocabulary: str | bytes):
        """vocabulary: the file's path or its content, lines of a base64 token and its rank."""
        pairs = [line.split() for line in (vocabulary if isinstance(vocabulary, bytes) else vocabulary_bytes(vocabulary)).splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {b: a for a, b in self.ranks.items()}
        # lengths of the tokens that end in a byte pair (or are a single byte): the only ones to try
        ending: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 1:
                ending.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {k: sorted(v, reverse=True) for k, v in ending.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pattern = regex.compile(PRE_TOKEN)

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank until none is in the vocabulary."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their own bytes."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * CACHE_ENTRIES:
                self.pairs.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int], sizes: list[int]) -> None:
        """Fill the cells of the prefixes of ``data`` that ``last`` doesn't hold yet (cell 0 is the empty prefix)."""
        ranks, lengths = self.ranks, self.lengths
        for end in range(len(last), len(data) + 1):
            for size in (*lengths.get(data[end - 2 : end], ()), 1) if end > 1 else (1,):
                begin = end - size
                if begin < 0:
                    continue
                token = ranks.get(data[begin:end])
                if token is not None and (not begin or self.compatible(last[begin], token)):
                    last.append(token)
                    sizes.append(size)
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")

    @staticmethod
    def trace(last: list[int], sizes: list[int]) -> tuple[int, ...]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= sizes[at]
        return tuple(reversed(ids))

    def word(self, text: str) -> tuple[int, ...]:
        ids = self.words.get(text)
        if ids is None:
            data = text.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                ids = (whole,)
            else:
                last, sizes = [-1], [0]
                self.extend(data, last, sizes)
                ids = self.trace(last, sizes)
            if len(self.words) > CACHE_ENTRIES:
                self.words.clear()
            self.words[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, word, ids = self.words, self.word, []
        for piece in self.pattern.findall(text):
            ids += known.get(piece) or word(piece)
        return ids


class PrefixTable:
    """The cells of one growing pre-token: exact appends, and edits that keep the cells before them."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last, self.sizes = encoder, b"", [-1], [0]
        self.append(data)

    def append(self, data: bytes) -> "PrefixTable":
        self.data += data
        self.encoder.extend(self.data, self.last, self.sizes)
        return self

    def replace(self, begin: int, end: int, data: bytes) -> "PrefixTable":
        rest = self.data[end:]
        del self.last[begin + 1 :], self.sizes[begin + 1 :]
        self.data = self.data[:begin]
        return self.append(data + rest)

    def ids(self) -> tuple[int, ...]:
        return self.encoder.trace(self.last, self.sizes)


@lru_cache(maxsize=4)
def shared_encoder(vocabulary: bytes) -> PrefixEncoder:
    """One encoder a Python worker: its tables and caches serve all tasks."""
    return PrefixEncoder(vocabulary)


def encode_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", directory: str = VOCABULARY_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids ARRAY<INT>): one row per input row, without special tokens.

    NULL and empty texts get an empty list, repeated rows stay, other columns are not read. A
    narrow map without shuffle: Python sees Arrow batches of two columns. The driver reads the
    vocabulary (under a megabyte) and sends it along, so the machines need no copy of it.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(os.path.join(directory, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(shared.value)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                ids = [encoder.encode(x) for x in texts.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    out = documents.select(documents[id_column].alias("id"), documents[text_column].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_column)
