"""Runs of letters and digits in Arrow text, and the CRC-32 of every run and pair of runs, on whole arrays.

A word is a longest run of bytes other than ``0x00-0x2F, 0x3A-0x60, 0x7B-0x7F``
of the UTF-8 text with A-Z as a-z: ASCII letters and digits and everything
beyond ASCII.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text whose arrays are alive at a time; a longer text is handled alone.
CHUNK = 1 << 21
#: Words up to this length take part in the array steps, longer ones go through zlib one by one.
SHORT = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_TABLE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what byte ``k`` of a CRC, of value ``b``, becomes behind ``n`` more bytes; the CRC is linear."""
    value = (np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]).astype(np.uint32)
    tables = [value]
    for _ in range(SHORT):
        value = _TABLE[value & np.uint32(255)] ^ (value >> np.uint32(8))
        tables.append(value)
    return np.stack(tables)


_SHIFT = _shift_tables()


@dataclass
class Words:
    """Words of several texts side by side: bytes ``data[start:end]`` in text number ``row``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray

    def crcs(self) -> np.ndarray:
        """CRC-32 of each word."""
        size = self.end - self.start
        order = np.argsort(-size, kind="stable")
        at, sizes = self.start[order], size[order]
        state = np.full(len(size), 0xFFFFFFFF, np.uint32)
        most = int(min(sizes[0], SHORT)) if len(sizes) else 0
        # Words with more than ``k`` letters are a prefix of the order.
        reach = np.searchsorted(-sizes, -np.arange(most), side="left")
        for k in range(most):
            n = reach[k]
            state[:n] = _TABLE[(state[:n] ^ self.data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
        out = np.empty(len(size), np.uint32)
        out[order] = ~state
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(self.data[self.start[i]:self.end[i]])
        return out

    def pairs(self, crc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``first, crc``: every two consecutive words of a text, by the number of the first one, joined by one space."""
        first = np.flatnonzero(self.row[1:] == self.row[:-1])
        state = ~crc[first]
        state = ~(_TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8)))
        size = self.end[first + 1] - self.start[first + 1]
        n = np.minimum(size, SHORT)
        joined = crc[first + 1].copy()
        for k in range(4):
            joined ^= _SHIFT[n, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(size > SHORT):
            second = first[i] + 1
            joined[i] = zlib.crc32(self.data[self.start[second]:self.end[second]], int(state[i]))
        return first, joined


def lower_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column with A-Z as a-z, and the offsets of the texts; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def word_chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """``begin, end, words`` of consecutive texts of a string column, about ``CHUNK`` bytes at a time."""
    if not len(column):
        return
    raw, bounds = lower_bytes(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(bounds, bounds[begin] + CHUNK, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        data = _LOWER[raw[bounds[begin]:bounds[end]]]
        cuts = bounds[begin:end + 1] - bounds[begin]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cuts] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        yield begin, end, Words(data, start, stop, np.searchsorted(cuts, start, side="right") - 1)
        begin = end
