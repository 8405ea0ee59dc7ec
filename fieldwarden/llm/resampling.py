"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Texts are cut at newlines. A line that occurs many times in the corpus is one
segment with a number: its words, n-grams and buckets are computed once and
multiplied by the occurrences. Only the pairs of words on either side of a
line break are counted document by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import attach, running_totals
from ..session import read_table, spread, staged
from .ngramcrc import Words, word_chunks
from .registry import query


@dataclass(frozen=True)
class Draw:
    """What is drawn: ``percent`` of the documents with ``least_words``, by n-grams in ``buckets``, noise by ``seed``."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7

    def __post_init__(self):
        # Buckets travel as 16-bit numbers and their gains are one broadcast array.
        if not 1 <= self.buckets <= 1 << 16:
            raise ValueError("buckets must be between 1 and 65,536")
        if not 0 <= self.percent <= 100:
            raise ValueError("percent must be between 0 and 100")


def _grouped(buckets: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The bucket numbers of each row as one binary value."""
    order = np.argsort(row, kind="stable")
    ends = np.cumsum(np.bincount(row, minlength=rows)) * 2
    data = pa.py_buffer(np.ascontiguousarray(buckets[order].astype("<u2")).tobytes())
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.append(0, ends).astype(np.int64)), data])


def _all_features(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all single words and pairs, and the text each belongs to."""
    crc = words.crcs()
    first, pair = words.pairs(crc)
    return np.concatenate([crc, pair]) % np.uint32(buckets), np.concatenate([words.row, words.row[first]])


def _crossing(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs of words with a newline between them, and the text each belongs to."""
    breaks = np.append(0, np.cumsum(words.data == 10))
    line = breaks[words.start]
    last = np.flatnonzero((words.row[1:] == words.row[:-1]) & (line[1:] != line[:-1]))
    # The two words of every break alone, next to each other under a number of their own.
    both = np.stack([last, last + 1], axis=1).ravel()
    alone = Words(words.data, words.start[both], words.end[both], np.repeat(np.arange(len(last)), 2))
    _, pair = alone.pairs(alone.crcs())
    return pair % np.uint32(buckets), words.row[last]


def _feature_rows(of, buckets: int, text: str):
    """Batches with ``text`` replaced by ``features``: the bucket numbers that ``of`` finds in it."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [i for i, name in enumerate(batch.schema.names) if name != text]
            names = [batch.schema.names[i] for i in others] + ["features"]
            for begin, end, words in word_chunks(batch.column(batch.schema.get_field_index(text))):
                found, row = of(words, buckets)
                part = [batch.column(i)[begin:end] for i in others]
                yield pa.RecordBatch.from_arrays([*part, _grouped(found, row, end - begin).cast(pa.binary())], names)
    return rows


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), "<u2"), np.diff(bounds) // 2


def _count_rows(buckets: int):
    """Rows ``bucket, n`` of one task: how often each bucket occurs, times the ``occurrences`` of its row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            number, size = _numbers(batch.column("features"))
            # Sums of a batch stay below 2**53, where doubles are whole numbers.
            weight = np.repeat(batch.column("occurrences").to_numpy(), size)
            total += np.bincount(number, weight, minlength=buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])
    return rows


def _gain_rows(gains, keys: list[str]):
    """Batches of ``keys``, the number of features of each row and the sum of their gains."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, size = _numbers(batch.column("features"))
            sums = np.append(0, np.cumsum(gains.value[number]))
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(size), pa.array(sums[ends] - sums[ends - size])],
                [*keys, "n_features", "gain"])
    return rows


def _gains(counts: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from rows ``bucket, n, target``: one aggregate of at most ``2 * buckets`` rows."""
    seen = np.zeros((2, buckets), np.int64)
    for bucket, target, n in counts.groupBy("bucket", "target").agg(F.sum("n")).toLocalIterator():
        seen[int(target)][bucket] = n
    s, t = seen.astype(np.float64)
    total_s, total_t = float(seen[0].sum()), float(seen[1].sum())
    ratio = (t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a function of seed and document; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(documents: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``documents`` (``doc_id, text``).

    Features are all words and pairs of neighbouring words of the text,
    hashed to buckets. A bucket's gain is the log ratio of its smoothed shares
    in ``target`` (``text``) and in ``documents``, in thousandths, rounded
    down; ``weight`` is the mean gain of a document's features, rounded down,
    0 without features. ``score`` adds Gumbel noise, so that the highest
    scores are a draw without replacement by importance. ``rank`` numbers the
    drawn ``percent`` of the documents with ``least_words``; the others' is
    null.

    A null text has no words. Rows that repeat an id are documents of their
    own with equal noise; ties go to the smaller id, null ids come last, then
    by a hash of the text; equal rows get consecutive ranks. Empty tables give
    no rows, or gains of the smoothed counts alone. Further columns are left
    aside.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"), text.alias("text"))
    key = ["doc_id", "x", "y"]
    line = [F.xxhash64("line").alias("lx"), F.xxhash64(F.lit(1), "line").alias("ly")]
    lines = rows.select(*key, F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")

    # Every distinct line once, with its number; equal lines of a task are summed before they are shuffled.
    segments = lines.groupBy("line").agg(F.count("*").alias("occurrences")).select(*line, "occurrences", "line")
    segments = staged(segments.mapInArrow(_feature_rows(_all_features, draw.buckets, "line"),
                                          "lx bigint, ly bigint, occurrences bigint, features binary"), "segments")
    between = staged(spread(rows).mapInArrow(_feature_rows(_crossing, draw.buckets, "text"),
                                             "doc_id bigint, x bigint, y bigint, features binary"), "between")
    wanted = (target.select(text.alias("text")).mapInArrow(_feature_rows(_all_features, draw.buckets, "text"), "features binary"))

    one = F.lit(1).cast("bigint").alias("occurrences")
    count = _count_rows(draw.buckets)
    counts = [df.mapInArrow(count, "bucket bigint, n bigint").withColumn("target", F.lit(t)) for df, t in (
        (segments.select("occurrences", "features"), 0), (between.select(one, "features"), 0), (wanted.select(one, "features"), 1))]
    gains = spark.sparkContext.broadcast(_gains(counts[0].unionByName(counts[1]).unionByName(counts[2]), draw.buckets))

    per_line = segments.mapInArrow(_gain_rows(gains, ["lx", "ly", "occurrences"]),
                                   "lx bigint, ly bigint, occurrences bigint, n_features bigint, gain bigint")
    parts = attach(lines.select(*key, *line), per_line, ["lx", "ly"], "occurrences", key)
    own = between.mapInArrow(_gain_rows(gains, key), "doc_id bigint, x bigint, y bigint, n_features bigint, gain bigint")
    sums = own.select(*key, one.alias("copies"), "n_features", "gain").unionByName(
        parts.select(*key, F.lit(0).cast("bigint").alias("copies"), "n_features", "gain"))
    # Equal rows have equal sums: the total of all copies is shared out evenly.
    found = sums.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("copies", "n_features", "gain")])
    mean = F.coalesce(F.expr("(gain - pmod(gain, nullif(n_features, 0))) div nullif(n_features, 0)"), F.lit(0).cast("bigint"))
    scores = staged(found.select(*key, "copies", F.expr("n_features div copies").alias("n_features"), mean.alias("weight"))
                    .withColumn("score", F.col("weight") + noise(F.col("doc_id"), draw.seed)), "scores")

    # n words have 2 n - 1 features.
    ranked = scores.filter(F.col("n_features") + 1 >= 2 * draw.least_words)
    number = ranked.agg(F.expr(f"coalesce(sum(copies), 0) * {draw.percent} div 100")).scalar()
    order = ranked.select(*key, "copies", (-F.col("score")).alias("low"), F.col("doc_id").isNull().alias("no_id"),
                          F.coalesce("doc_id", F.lit(0)).alias("id"))
    last = running_totals(order, ["low", "no_id", "id", "x", "y"], {"last": F.col("copies")}).filter(
        F.col("last") - F.col("copies") < number)
    same = [scores[c].eqNullSafe(last[c]) for c in key]
    out = scores.join(last.select(*key, "last"), same, "left").select(*[scores[c] for c in scores.columns], "last")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    at = F.col("last") - F.col("copies") + F.col("copy")
    return out.select("*", copy).select("doc_id", "n_features", "weight", "score",
                                        F.when(at <= number, at).alias("rank"))


@query("op13_importance_resampling")
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents drawn towards the texts of ``benchmark``."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(documents, read_table(spark, sf_dir, "benchmark").select("text"))
