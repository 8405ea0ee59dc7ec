"""Words of a text as numbers: splitting, 64-bit names and hashes of word runs, all on whole arrays.

A word is a longest run of bytes outside ``0x20, 0x09-0x0D`` of the UTF-8
text, which are the same words as in the characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Runs are polynomials modulo this prime; a power of two would give some different runs of two values one hash.
_PRIME = np.uint64((1 << 61) - 1)
_BASE = 0x0851F42D4C957F2D
_INVERSE = pow(_BASE, -1, int(_PRIME))
#: Words of more bytes than this are named one by one.
_LONG_WORD = 256
#: Bytes of text whose arrays are alive at a time; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    low, bits = np.uint64((1 << 31) - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> bits, a & low, b >> bits, b & low
    middle = a1 * b0 + a0 * b1
    # 2 ** 61 is 1, so the high product counts twice and the middle one is turned around.
    turned = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << bits)
    return _reduced(_reduced(np.uint64(2) * (a1 * b1) + turned) + _reduced(a0 * b0))


#: Powers of each base that a task has needed so far.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """``base ** 0 .. base ** (count - 1)`` modulo the prime."""
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        known = np.ones(1 << max(10, (count - 1).bit_length()), np.uint64)
        size = 1
        while size < len(known):
            known[size:2 * size] = _product(known[:size], np.uint64(pow(base, size, int(_PRIME))))
            size *= 2
        _POWERS[base] = known
    return known[:count]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair; equal runs have equal hashes wherever they stand."""
    terms = _product(_reduced(values), powers(_BASE, len(values)))
    sums = np.zeros((2, len(values) + 1), np.uint64)
    np.cumsum(terms & np.uint64((1 << 31) - 1), out=sums[0, 1:], dtype=np.uint64)
    np.cumsum(terms >> np.uint64(31), out=sums[1, 1:], dtype=np.uint64)
    low, high = sums[:, ends] - sums[:, starts]
    total = _reduced(low) + (high >> np.uint64(30)) + ((high & np.uint64((1 << 30) - 1)) << np.uint64(31))
    value = _product(_reduced(total), powers(_INVERSE, len(values) + 1)[starts])
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values, for small sizes: each value is mixed with all before it."""
    count = max(len(values) - size + 1, 0)
    found = np.full(count, size, np.uint64)
    for k in range(size):
        found = mix(found * np.uint64(0x9FB21C651E98DF25) ^ values[k:k + count])
    return found


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and where each word starts and ends."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    return data, np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit names of the byte ranges ``data[start:end]``: eight bytes at a time, each mixed with all before it."""
    size = ends - starts
    names = mix(size.astype(np.uint64) + np.uint64(seed << 40))
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    open_ = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    done = 0
    while len(open_):
        left = np.minimum(size[open_] - done, 8).astype(np.uint64)
        block = eight[starts[open_] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        names[open_] = mix(names[open_] * np.uint64(0x9FB21C651E98DF25) ^ block)
        done += 8
        open_ = open_[size[open_] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=bytes([seed]))
        names[i] = int.from_bytes(digest.digest(), "little")
    return names


def word_names(text: bytes, seeds: tuple[int, ...] = (1,)) -> list[np.ndarray]:
    """One array of 64-bit word names per seed."""
    data, starts, ends = word_spans(text)
    return [span_names(data, starts, ends, seed) for seed in seeds]


class Chunk:
    """Several texts side by side: bytes, spans and names of their words, and the word range of each text."""

    def __init__(self, rows: list, texts: list[bytes], seeds: tuple[int, ...]):
        self.rows = rows
        joined = b" ".join(texts)
        self.data, self.starts, self.ends = word_spans(joined)
        self.names = [span_names(self.data, self.starts, self.ends, seed) for seed in seeds]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        self.first = np.searchsorted(self.starts, begins)
        self.last = np.append(self.first[1:], len(self.starts))


def chunks(batches: Iterator[pa.RecordBatch], seeds: tuple[int, ...] = (1,), lower: bool = False) -> Iterator[Chunk]:
    """Texts of Arrow batches in chunks of about ``CHUNK`` bytes.

    ``rows`` of a chunk are the values of all columns but ``text``, in their
    order. A null text is empty. ``lower`` turns A-Z into a-z.
    """
    rows, texts, held = [], [], 0
    for batch in batches:
        others = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        at = batch.schema.get_field_index("text")
        for i in range(batch.num_rows):
            text = (batch.column(at)[i].as_py() or "").encode("utf-8", "surrogatepass")
            texts.append(text.lower() if lower else text)
            rows.append(tuple(c[i].as_py() for c in others))
            held += len(text)
            if held >= CHUNK:
                yield Chunk(rows, texts, seeds)
                rows, texts, held = [], [], 0
    if rows:
        yield Chunk(rows, texts, seeds)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit names as Spark longs."""
    return values.view(np.int64)
