"""Repeated passages: recompression names word runs and pairs; shared names reveal and verify long repeats.

Rounds of naming turn every text into fewer and fewer symbols. A round first
names runs of one symbol, then pairs of neighbours, where a hash of the two
symbols decides which neighbours pair. A name is a hash of what it stands
for, so it is the same in every text without a global table, and what a
symbol depends on is known: an interval of words. Two equal windows of words
hold the same symbols wherever that interval lies inside the window. Each
window therefore picks its highest such symbol, and only windows whose symbol
occurs in another document too can be repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, staged
from .registry import query
from .words import chunks, mix, run_hashes, signed

#: Words of a window.
WINDOW = 50
#: Rounds of pair naming; later ones hold no symbol that a window of 50 words determines.
ROUNDS = 14
#: Rounds before which runs of one symbol are named.
RUN_ROUNDS = (0, 4)


def _runs(symbol, low, high, text):
    """Name runs of one symbol. A symbol stays itself only where its neighbours are known to differ."""
    same = (symbol[1:] == symbol[:-1]) & (text[1:] == text[:-1])
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(symbol)) - 1
    length = (last - first + 1).astype(np.uint64)
    named = np.where(length > 1, mix(symbol[first] + mix(length)), symbol[first])
    before = np.append(True, text[1:] != text[:-1])[first]
    after = np.append(text[1:] != text[:-1], True)[last]
    # The run ends where its neighbours differ: it depends on those two symbols, not on the runs they stand in.
    left = np.where(before, low[first] - 1, low[first - 1])
    right = np.where(after, high[last] + 1, high[np.minimum(last + 1, len(high) - 1)])
    return named, left, right, text[first]


def _pairs(symbol, low, high, text, salt):
    """Name neighbours of which the first is a left and the second a right symbol of this round."""
    right = (mix(symbol ^ np.uint64(salt)) >> np.uint64(63)).astype(bool)
    joined = text[1:] == text[:-1]
    pair = ~right[:-1] & right[1:] & joined
    head, tail = np.append(pair, False), np.append(False, pair)
    named, new_low, new_high = symbol.copy(), low.copy(), high.copy()
    at = np.flatnonzero(pair)
    named[at] = mix(symbol[at] * np.uint64(3) + mix(symbol[at + 1]))
    new_high[at] = high[at + 1]
    # A symbol left alone depends on the neighbour that it could have paired with.
    alone = ~head & ~tail
    next_high = np.where(np.append(joined, False), np.append(high[1:], 0), high + 1)
    prev_low = np.where(np.append(False, joined), np.append(0, low[:-1]), low - 1)
    new_high = np.where(alone & ~right, next_high, new_high)
    new_low = np.where(alone & right, prev_low, new_low)
    keep = ~tail
    return named[keep], new_low[keep], new_high[keep], text[keep]


def window_picks(names: np.ndarray, first: np.ndarray, last: np.ndarray, window: int = WINDOW,
                 rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, count, symbol``: runs of windows of one text that pick the same symbol.

    ``names`` are the words of several texts side by side, text ``t`` from
    ``first[t]`` to ``last[t]``; ``start`` counts from the text's first word.
    The pick of a window depends on nothing but its words.
    """
    number = np.maximum(last - first - window + 1, 0)
    text_of = np.repeat(np.arange(len(first)), number)
    starts = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + first[text_of]
    picks = np.zeros(len(starts), np.uint64)
    levels = []
    # A dependency interval that leaves the text is one word too long: no window holds it.
    symbol, text = names, np.repeat(np.arange(len(first)), last - first)
    low, high = np.arange(len(names)), np.arange(1, len(names) + 1)
    levels.append((symbol, low, high))
    for turn in range(rounds if len(starts) else 0):
        if turn in RUN_ROUNDS:
            symbol, low, high, text = _runs(symbol, low, high, text)
        symbol, low, high, text = _pairs(symbol, low, high, text, 0xA0761D6478BD642F * (turn + 1) & (2**64 - 1))
        held = np.flatnonzero(high - low <= window)
        if not len(held):
            break
        levels.append((symbol[held], low[held], high[held]))
    open_ = np.arange(len(starts))
    for symbol, low, high in reversed(levels):
        at = np.searchsorted(low, starts[open_])
        inside = at < len(low)
        inside[inside] = high[at[inside]] <= starts[open_[inside]] + window
        picks[open_[inside]] = symbol[at[inside]]
        open_ = open_[~inside]
    if not len(starts):
        return text_of, starts, starts, picks
    new = np.append(True, (picks[1:] != picks[:-1]) | (text_of[1:] != text_of[:-1]))
    begin = np.flatnonzero(new)
    return text_of[begin], starts[begin] - first[text_of[begin]], np.diff(np.append(begin, len(picks))), picks[begin]


def _pick_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            text, start, count, symbol = window_picks(chunk.names[0], chunk.first, chunk.last, window)
            ids = np.array([r[0] for r in chunk.rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(symbol)), pa.array(ids[text]), pa.array(start.astype(np.int32)),
                                              pa.array(count.astype(np.int32))], ["symbol", "doc_id", "start", "count"])
    return rows


def _spans(ranges: list[dict] | None, words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, counts and symbols of window ranges, cut to the windows that the text has."""
    start, count, symbol = (np.array([r[c] for r in ranges or []], np.int64) for c in ("start", "count", "symbol"))
    count = np.minimum(count, words - window + 1 - start)
    return start[count > 0], count[count > 0], symbol[count > 0]


def _hash_rows(window: int, each: bool):
    """Two hashes per range of windows (the words it covers), or per single window."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, (1, 2)):
            found = []
            for (doc_id, variant, ranges), first, last in zip(chunk.rows, chunk.first, chunk.last):
                start, count, symbol = _spans(ranges, last - first, window)
                if each:
                    start = np.unique(np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()))
                    count = symbol = np.ones(len(start), np.int64)
                found.append((np.full(len(start), doc_id), np.full(len(start), variant), start, count, symbol, start + first))
            doc_id, variant, start, count, symbol, begin = (np.concatenate(c).astype(np.int64) for c in zip(*found))
            end = begin + count + window - 1
            hashes = [signed(run_hashes(names, begin, end)) for names in chunk.names]
            columns = [*hashes, doc_id, variant.astype(np.int32), start.astype(np.int32)]
            if not each:
                columns += [count.astype(np.int32), symbol]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], list(_WINDOWS if each else _BLOCKS))
    return rows


_WINDOWS = {"h1": "bigint", "h2": "bigint", "doc_id": "bigint", "variant": "int", "start": "int"}
_BLOCKS = {**_WINDOWS, "count": "int", "symbol": "bigint"}


def _hashed(texts: DataFrame, window: int, each: bool) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in (_WINDOWS if each else _BLOCKS).items())
    return staged(texts.mapInArrow(_hash_rows(window, each), schema), "windows" if each else "blocks")


def _seen_before(hashed: DataFrame) -> DataFrame:
    """``hashed`` rows with ``seen``: whether the same words stand in a document with a smaller id."""
    shared = (hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
              .filter("least < most").drop("most"))
    joined = hashed.join(staged(shared, "shared"), ["h1", "h2"], "left")
    return joined.withColumn("seen", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("h1", "h2", "least")


def _ranges(rows: DataFrame) -> DataFrame:
    """The window ranges of each document: never more than the document has windows."""
    return rows.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "count", "symbol")).alias("ranges"))


def word_digest(text: Column) -> Column:
    """Struct ``n_words, sha256`` of the words of a text joined by one space; null has no words."""
    @F.pandas_udf("n_words bigint, sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        return pd.DataFrame({"n_words": [len(w) for w in words],
                             "sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]})

    return digest(text)


def _cut_rows(window: int, with_text: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, variant, ranges, text in zip(*(batch.column(c) for c in ("doc_id", "variant", "ranges", "text"))):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                start, count, _ = _spans(ranges.as_py(), len(words), window)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + count + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, out in zip(words, gone) if not out)
                found.append((doc_id.as_py(), variant.as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(),
                              kept.decode("utf-8", "surrogatepass") if with_text else None))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "variant", "n_removed", "kept_sha256", "kept"])
    return rows


def cut_repeats(documents: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept``.

    Every word covered by a window of ``window`` words that also starts in a
    document with a smaller id is removed. ``kept_sha256`` is that of the
    words left, joined by one space; ``kept`` is that text where words were
    removed and ``with_text`` is set, else null.

    Null and empty texts have no words. Rows without an id lose nothing and
    take nothing from others. Rows that repeat an id are not earlier than
    each other: equal ones get equal results, and different texts of one id
    are judged each for itself.

    1. Copies: of documents with the same words only the one with the
       smallest id goes on; the others lose every word if they fill a window.
    2. Symbols picked by windows are counted over all documents; ranges of
       windows whose symbol another document has too are candidates.
    3. Each range is compared as one block of words. A block of an earlier
       document is a repeat as a whole. Of the others, which are the first of
       their kind or stand at the ends of repeats, the windows are compared
       one by one where two documents have such blocks of one symbol.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    digests = documents.select("doc_id", word_digest(F.col("text")).alias("d")).select(
        "doc_id", F.col("d.n_words").alias("n_words"), F.col("d.sha256").alias("sha256"))
    rows = staged(digests, "digests")
    copies = staged(rows.filter(F.col("n_words") >= window).groupBy("sha256")
                    .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
                    .drop("most"), "copies")
    known = documents.filter("doc_id is not null")
    picks = staged(known.mapInArrow(_pick_rows(window), "symbol bigint, doc_id bigint, start int, count int"), "picks")
    shared = staged(picks.groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                    .filter("least < most").select("symbol"), "symbols")
    later = rows.join(copies, "sha256").filter(F.col("doc_id") > F.col("least")).select("doc_id", "sha256")
    hits = picks.join(shared, "symbol").groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "symbol")).alias("ranges"))
    firsts = rows.filter(F.col("n_words") >= window).select("doc_id", "sha256").distinct().join(later, ["doc_id", "sha256"], "left_anti")
    # Different texts of one id get small numbers; nearly always there is one.
    firsts = firsts.withColumn("variant", F.row_number().over(Window.partitionBy("doc_id").orderBy("sha256")))
    wanted = staged(firsts.join(hits, "doc_id").select("doc_id", "sha256", "variant", "ranges"), "wanted")
    texts = known.join(wanted, "doc_id").filter(word_digest(F.col("text"))["sha256"] == F.col("sha256"))
    texts = staged(texts.select("doc_id", "variant", "ranges", "text"), "texts")
    blocks = staged(_seen_before(_hashed(texts, window, False)), "blocks")
    unseen = blocks.filter("not seen")
    both = staged(unseen.groupBy("symbol").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .filter("least < most").select("symbol"), "symbols")
    edges = texts.drop("ranges").join(_ranges(unseen.join(both, "symbol")), ["doc_id", "variant"])
    single = _hashed(edges.select("doc_id", "variant", "ranges", "text"), window, True)
    one = [F.lit(1).alias("count"), F.lit(0).cast("bigint").alias("symbol")]
    gone = blocks.filter("seen").unionByName(_seen_before(single).filter("seen").select("*", *one))
    cut = texts.drop("ranges").join(_ranges(gone), ["doc_id", "variant"]).select("doc_id", "variant", "ranges", "text")
    cut = cut.mapInArrow(_cut_rows(window, with_text), "doc_id bigint, variant int, n_removed bigint, kept_sha256 string, kept string")
    cut = staged(cut.dropDuplicates(["doc_id", "variant"]).join(wanted.select("doc_id", "variant", "sha256"), ["doc_id", "variant"])
                 .drop("variant"), "cut")
    nothing = hashlib.sha256(b"").hexdigest()
    result = rows.join(copies, "sha256", "left").join(cut, ["doc_id", "sha256"], "left")
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return result.select(
        "doc_id", "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, nothing).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(copied, "").otherwise(F.col("kept")).alias("kept"), F.col("sha256").alias("words_sha256"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words and more that an earlier document has."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")
