"""Words, shingles and their 64-bit hashes over whole Arrow batches, on bytes.

A word's hash is a polynomial of its bytes, with a random odd number for each byte, and a final mix; a shingle's is a
polynomial of its words' hashes. All constants are fixed, so hashes agree between workers and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

_random = np.random.Generator(np.random.PCG64(5))
_BYTE = _random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = np.multiply.accumulate(np.full(256, _BASE, np.uint64))

#: What separates words: the white space of [\\x20\\x09-\\x0D], or besides it all ASCII but letters and digits.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_WORD = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and the offset of each text and of the end. Nulls are empty."""
    if texts.null_count:
        texts = pa.compute.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def _power(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.multiply.accumulate(np.full(2 * n, _BASE, np.uint64))
    return _powers


def words(body: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and text of each word; A-Z count as a-z if fold."""
    inside = ~separators[body]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.empty(len(at), bool)
    begins[0] = True
    begins[1:] = np.diff(at) > 1
    edges = np.zeros(len(body) + 1, bool)
    edges[offsets] = True
    begins |= edges[at]
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    low = body[at]
    values = _BYTE[_FOLD[low] if fold else low] * _power(int(lengths.max()))[place]
    starts = at[first]
    return mix(np.add.reduceat(values, first)), starts, np.searchsorted(offsets, starts, "right") - 1


def _sums(values: np.ndarray, n: int, size: int, factors: np.ndarray | None = None) -> np.ndarray:
    total = np.zeros(n, values.dtype)
    for j in range(size):
        total += values[j : j + n] if factors is None else values[j : j + n] * factors[j]
    return total


def windows(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of size words within a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = _sums(hashes, n, size, _PLACE) + np.uint64(size * int(_BASE) & (2**64 - 1))
    whole = of[:n] == of[size - 1 :]
    return mix(total)[whole], of[:n][whole]


def shingles_of(hashes: np.ndarray, of: np.ndarray, n_texts: int, size: int = 5, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Of words (hash and text): hashes of all shingles, text by text, the text of each, and the sums of their words'
    levels if these are given. A text of fewer words has one shingle, of all (its sum is 0: it is the only one)."""
    found, texts = windows(hashes, of, size)
    n = len(hashes) - size + 1
    sums = None
    if levels is not None:
        sums = _sums(levels, n, size)[of[:n] == of[size - 1 :]] if n > 0 else levels[:0]
    counts = np.bincount(of, minlength=n_texts) if len(of) else np.zeros(n_texts, int)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        ends = np.cumsum(counts)
        extra = np.array([windows(hashes[ends[t] - counts[t] : ends[t]], of[ends[t] - counts[t] : ends[t]], int(counts[t]))[0][0] for t in short], np.uint64)
        found, texts = np.concatenate([found, extra]), np.concatenate([texts, short])
        order = np.argsort(texts, kind="stable")
        found, texts = found[order], texts[order]
        if sums is not None:
            sums = np.concatenate([sums, np.zeros(len(short), levels.dtype)])[order]
    return found, texts, sums


def shingles(body: np.ndarray, offsets: np.ndarray, size: int = 5, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and the offset of each text's first. A text of fewer words has one."""
    n_texts = len(offsets) - 1
    hashes, _, of = words(body, offsets, separators)
    found, texts, _ = shingles_of(hashes, of, n_texts, size)
    return found, np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=n_texts) if len(texts) else np.zeros(n_texts, int))]).astype(np.int64)


def shingle_sets(texts: pa.Array, size: int = 5, separators: np.ndarray = SPACE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found, at = shingles(*buffers(texts), size, separators)
    return [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
