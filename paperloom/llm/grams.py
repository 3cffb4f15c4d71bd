"""Vectorised character windows: code points, rolling hashes and sliding minima over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import accumulate

import numpy as np
import regex

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
SECOND_BASE = 0xD1342543DE82EF95  # of another hash of the same windows
CHUNK_CHARS = 1_000_000  # characters handled at once by numpy; a longer text is a chunk of its own


@cache
def letter_or_digit() -> np.ndarray:
    """Code points of the Unicode categories L and N."""
    found = np.zeros(0x110000, bool)
    known = regex.compile(r"[\p{L}\p{N}]")
    found[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and known.match(chr(i))]] = True
    return found


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_and_digits(text: str) -> np.ndarray:
    """Lower-cased code points without anything but letters and digits."""
    found = points(text.lower())
    return found[letter_or_digit()[found]]


def without_space(text: str) -> np.ndarray:
    """Lower-cased code points without white space."""
    return points("".join(text.lower().split()))


def chunks(items: Sequence, sizes: Sequence[int], most: int = CHUNK_CHARS) -> Iterator[Sequence]:
    """Consecutive items of together about ``most`` characters."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield items[begin:i]
            begin, total = i, 0
        total += size
    if begin < len(items):
        yield items[begin:]


def joined(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and the offsets of the parts (one more than parts)."""
    offsets = np.fromiter(accumulate((len(p) for p in parts), initial=0), np.int64, len(parts) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a polynomial hash can be used."""
    x = values ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * MULTIPLIER
    return x ^ (x >> np.uint64(32))


def rolling(values: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of all windows of ``size`` values, built by doubling; shorter input gives none."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    power = {1: (values.astype(np.uint64) + np.uint64(1)) * MULTIPLIER}
    length = 1
    with np.errstate(over="ignore"):
        while 2 * length <= size:
            h, shift = power[length], np.uint64(pow(base, length, 1 << 64))
            power[2 * length] = h[:-length] * shift + h[length:]
            length *= 2
        out, done = power[length], length
        while done < size:
            length = 1 << ((size - done).bit_length() - 1)
            n = len(values) - done - length + 1
            out = out[:n] * np.uint64(pow(base, length, 1 << 64)) + power[length][done : done + n]
            done += length
    return out


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minima of all windows of ``size`` values."""
    if len(values) < size:
        return values[:0]
    out, length = values, 1
    while 2 * length <= size:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    if length < size:
        out = np.minimum(out[: len(values) - size + 1], out[size - length :])
    return out


def window_owner(offsets: np.ndarray, size: int, count: int) -> np.ndarray:
    """For each of ``count`` window starts the part that holds the whole window, or -1."""
    starts = np.arange(count)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    return np.where(starts + size <= offsets[owner + 1], owner, -1) if count else owner
