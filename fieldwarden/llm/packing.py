"""Packing: shortest-pack-first over the length histogram, then patterns are joined back to documents by rank."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, staged, task_count
from .registry import query

#: Tokens of a sequence.
CAPACITY = 2048
#: Id put behind every document.
END_ID = 1
#: Characters that one task encodes between two output batches.
BATCH_CHARS = 4_000_000

Encoder = Callable[[], Callable[[str], list[int]]]


def byte_bpe(path: str, special: Mapping[str, int] | None = None) -> Encoder:
    """Encoder factory for a byte-level BPE given as a tokenizers JSON file.

    The ids are those of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)``. The merges run in tiktoken, which is several
    times faster on one core; a text it refuses goes through tokenizers.
    """
    def load() -> Callable[[str], list[int]]:
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = _byte_alphabet()
        marks = {t["content"]: t["id"] for t in spec["added_tokens"]} if special is None else dict(special)
        ranks = {bytes(shown[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in marks}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> list[int]:
            try:
                if any(mark in text for mark in marks):
                    return fast.encode(text, allowed_special="all")
                return fast.encode_ordinary(text)
            except Exception:  # noqa: BLE001 - any refusal has the same answer: the slow encoder
                return slow.encode(text, add_special_tokens=False).ids

        return encode

    return load


def _byte_alphabet() -> dict[str, int]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                     ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def cut_pieces(documents: DataFrame, encoder: Encoder, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, ids``.

    A document is its ids and ``end_id``. It is cut into full pieces of
    ``capacity`` ids and a rest, which may be empty and is then left out. A
    null text counts as empty; repeated rows are packed as often as they
    stand there, and a null ``doc_id`` stays null.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, held = encoder(), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                ids = np.array([*encode(text), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids),
                                 piece.astype(np.int32) if with_ids else None))
                held += len(text)
                if held > BATCH_CHARS:
                    yield _batch(rows)
                    rows, held = [], 0
        yield _batch(rows)

    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids array<int>"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pieces, fields)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


@dataclass(frozen=True)
class Slots:
    """Where the pieces of one length go, in the order of their ranks.

    Run ``j`` takes the ranks from ``first[j]`` on, ``each[j]`` to a sequence:
    rank ``first[j] + r`` lies in sequence ``sequence[j] + r // each[j]`` at
    ``offset[j] + r % each[j] * length``.
    """

    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray


def shortest_pack_first(histogram: Mapping[int, int], capacity: int = CAPACITY) -> dict[int, Slots]:
    """Pack a histogram of lengths: longest first, each into the pattern with the most room left.

    A pattern is a list of lengths with the number of sequences that have it.
    A pattern that gets a length for only some of its sequences is split. At
    most ``capacity`` lengths and room values exist, so the work depends on
    neither the number of documents nor their counts.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: set[int] = set()

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if room == 0:
            done.append((pattern, count))
        else:
            open_packs.setdefault(room, []).append((pattern, count))
            rooms.add(room)

    for length in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left = histogram[length]
        while left:
            room = max(rooms, default=0)
            if room < length:
                each = min(capacity // length, left)
                put((length,) * each, left // each, capacity - each * length)
                left -= left // each * each
                continue
            pattern, count = open_packs[room].pop()
            if not open_packs[room]:
                rooms.discard(room)
            used = min(count, left)
            if count > used:
                put(pattern, count - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    done += [pack for packs in open_packs.values() for pack in packs]
    return _slots(done)


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, Slots]:
    """Runs of slots: one per pattern and length, however often the pattern holds the length."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, count in sorted(patterns, key=lambda p: p[0], reverse=True):
        at = 0
        for length, same in groupby(pattern):
            each = sum(1 for _ in same)
            first = taken.get(length, 0)
            runs.setdefault(length, []).append((first, base, at, each))
            taken[length] = first + count * each
            at += length * each
        base += count
    return {length: Slots(*map(np.array, zip(*found))) for length, found in runs.items()}


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` from 0 within each length.

    A length is first split by a hash of the document into as many parts as
    there are tasks; the parts' counts give each its first rank. A length
    that a third of all pieces have is so numbered by many tasks.
    """
    parts = task_count(pieces.sparkSession)
    cut = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("length", "__part").orderBy("doc_id", "start", "ids_crc32")
    numbered = cut.withColumn("__row", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "__part"]).withColumn("rank", F.col("__first") + F.col("__row")).drop(
        "__part", "__row", "__first")


def _run_rows(histogram: Mapping[int, int], slots: Mapping[int, Slots]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Per length the ranks of a block, and every run once per block of ranks that it reaches: two rows a run at most on average."""
    widths, rows = [], []
    for length, s in slots.items():
        width = -(-histogram[length] // len(s.first))
        widths.append((int(length), width))
        ends = np.append(s.first[1:], histogram[length])
        for first, end, sequence, offset, each in zip(s.first.tolist(), ends.tolist(), s.sequence.tolist(), s.offset.tolist(), s.each.tolist()):
            rows += [(int(length), block, first, end, sequence, offset, each) for block in range(first // width, (end - 1) // width + 1)]
    return widths, rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The driver sees the histogram alone, at most ``capacity`` rows. Pieces of
    equal length are interchangeable; their rank chooses the slot. Ranks are
    cut into about as many blocks as a length has runs, and a piece meets the
    runs of its block: any number of runs is found by an equal key. Sequences
    are gapless from offset 0. A table without pieces gives no rows.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    widths, runs = _run_rows(histogram, shortest_pack_first(histogram, capacity))
    spark = pieces.sparkSession
    # One row per length, so this broadcast is bounded; the runs are joined as they come.
    width = spark.createDataFrame(widths, "length bigint, __width bigint")
    table = spark.createDataFrame(runs, "length bigint, __block bigint, __first bigint, __end bigint, __sequence bigint, __offset bigint, __each bigint")
    ranked = _ranked(pieces).join(F.broadcast(width), "length").withColumn("__block", F.expr("rank div __width"))
    inside = (F.col("rank") >= F.col("__first")) & (F.col("rank") < F.col("__end"))
    placed = ranked.join(table, ["length", "__block"]).filter(inside).withColumn("__r", F.col("rank") - F.col("__first"))
    return placed.select(*pieces.columns, F.expr("__sequence + __r div __each").alias("sequence_id"),
                         F.expr("__offset + __r % __each * length").alias("offset"))


def default_encoder() -> Encoder:
    """The public 50k byte-level BPE."""
    import public_tokenizers

    return byte_bpe(public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = staged(cut_pieces(documents, default_encoder(), with_ids=False).drop("ids"), "pieces")
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
