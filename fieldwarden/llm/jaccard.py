"""N-gram Jaccard join: signature trees over groups of texts that share a minimum of their shingles.

Minimum hashes of a text's shingles, joined to bands, name the groups: the
tops of a forest. Below each top stands a tree whose nodes hold the OR of
their texts' token bitmaps, their range of set sizes and their range of
components; a dual traversal drops pairs of nodes that cannot overlap enough
or that are connected already, and compares the rest exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, staged, task_count
from .components import connected_components, sorted_groups
from .registry import query
from .words import chunks, mix, signed, window_hashes, word_names

#: Bands of every text.
BANDS = 64
#: Two sets at exactly the threshold share no band with at most this probability; it fixes the hashes per band.
MISS = 1e-11
#: Texts, and shingles, that one task compares at a time. Larger groups are cut into such blocks.
BLOCK, BLOCK_SHINGLES = 512, 400_000
#: Shingles whose minimum hashes are taken at a time: few enough for the cache of a core.
TILE = 128
#: Bits of a token bitmap.
BITS = 2048
#: Texts of a leaf, and children of a node.
FAN = 8


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; sets are linked when intersection / union is at least ``percent`` / 100."""

    words: int = 5
    percent: int = 80

    def linked(self, common: int, left: int, right: int) -> bool:
        """The exact test on set sizes."""
        return 100 * common >= self.percent * (left + right - common)

    @property
    def rows(self) -> int:
        """Most hashes per band for which a pair at the threshold is missed with probability below ``MISS``."""
        share, rows = self.percent / 100, 1
        while rows < 16 and (1 - share ** (rows + 1)) ** BANDS < MISS:
            rows += 1
        return rows


def shingles(names: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingles of one text's word names; the whole text as one if it is shorter; empty without words."""
    if not len(names):
        return np.zeros(0, np.uint64)
    return distinct(window_hashes(names, min(words, len(names))))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for the few hundred of a text sorting costs less than ``np.unique``, which hashes them first."""
    values = np.sort(values)
    first = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=first[1:])
    return values[first]


def set_name(found: np.ndarray) -> int:
    """One 64-bit name of a set of shingles, as a Spark long."""
    total = np.array([np.bitwise_xor.reduce(mix(found)), found.sum(dtype=np.uint64), len(found)], np.uint64)
    return int.from_bytes(hashlib.blake2b(total.tobytes(), digest_size=8).digest(), "little", signed=True)


def minimum_hashes(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the minimum hashes of all bands."""
    at = np.arange(1, BANDS * rows + 1, dtype=np.uint64)
    factors, shifts = mix(at) >> np.uint64(32), mix(at + np.uint64(1 << 40)) >> np.uint64(32)
    return factors.astype(np.uint32) | np.uint32(1), shifts.astype(np.uint32)


def minima(found: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of every minimum hash over the set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.uint32(0xFFFFFFFF))
    held = np.empty((min(TILE, len(low)), len(factors)), np.uint32)
    for at in range(0, len(low), TILE):
        some = low[at:at + TILE, None]
        part = np.bitwise_xor(some, shifts, out=held[:len(some)])
        part *= factors
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_names(least: np.ndarray, rows: int) -> np.ndarray:
    """One name per band from the minima of several sets, one set per line."""
    # Only candidates come from these names, so a sum with odd factors is enough to tell the minima apart.
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    values = (least.astype(np.uint64).reshape(-1, BANDS, rows) * factors).sum(axis=2, dtype=np.uint64)
    return mix(mix(values) + np.arange(BANDS, dtype=np.uint64))


def _set_rows(similarity: Similarity):
    words = similarity.words

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = minimum_hashes(similarity.rows)
        for chunk in chunks(batches, lower=True):
            # Windows are hashed for all texts of a chunk at once; those that reach into the next text belong to none.
            names, ids = chunk.names[0], [doc_id for (doc_id,) in chunk.rows]
            hashes = window_hashes(names, words)
            found = [distinct(hashes[first:last - words + 1]) if last - first >= words else shingles(names[first:last], words)
                     for first, last in zip(chunk.first, chunk.last)]
            filled = [i for i, own in enumerate(found) if len(own)]
            sets, bands = [None] * len(ids), [None] * len(ids)
            for at in range(0, len(filled), BLOCK):
                some = filled[at:at + BLOCK]
                named = signed(band_names(np.stack([minima(found[i], *hashed) for i in some]), similarity.rows))
                for i, own in zip(some, named):
                    sets[i], bands[i] = set_name(found[i]), own
            columns = (ids, [len(own) for own in found], sets, bands)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["doc_id", "n_shingles", "set", "bands"])
    return rows


class Tree:
    """Signature tree over sets sorted by size."""

    def __init__(self, sets: list[np.ndarray], parent: list[int]):
        self.sets, self.parent = sets, parent
        self.size = np.array([len(s) for s in sets])
        bits = np.zeros((len(sets), BITS), bool)
        for row, found in zip(bits, sets):
            row[(found % np.uint64(BITS)).astype(np.int64)] = True
        self.bitmap = np.packbits(bits, axis=1).view(np.uint64)
        #: Tokens of a set that share a bit with another of its tokens.
        self.excess = self.size - np.bitwise_count(self.bitmap).sum(axis=1)
        self.levels = [(self.bitmap, self.size, self.size, self.excess)]
        while len(self.levels[-1][0]) > FAN:
            bitmap, low, high, excess = self.levels[-1]
            at = np.arange(0, len(bitmap), FAN)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def root(self, x: int) -> int:
        """Representative of the component of set ``x``."""
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _members(self, level: int, node: int) -> range:
        width = FAN ** level
        return range(node * width, min((node + 1) * width, len(self.sets)))

    def _one_component(self, level: int, i: int, j: int) -> bool:
        first = self.root(self._members(level, i)[0])
        return all(self.root(x) == first for node in {i, j} for x in self._members(level, node))

    def links(self, similarity: Similarity, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Pairs that join two components, found by descending from the root against itself.

        With ``sides`` only pairs of different sides are compared.
        """
        found: list[tuple[int, int]] = []
        percent = similarity.percent
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        stack = [(top, i, j) for i in range(width) for j in range(i, width)]
        while stack:
            level, i, j = stack.pop()
            bitmap, low, high, excess = self.levels[level]
            if i != j or level:
                # Whole numbers as in ``Similarity.linked``: a bound exactly at the threshold must not be rounded below it.
                if 100 * int(min(high[i], high[j])) < percent * int(max(low[i], low[j])):
                    continue
                most = int(np.bitwise_count(bitmap[i] & bitmap[j]).sum()) + int(min(excess[i], excess[j]))
                if (100 + percent) * most < percent * (int(low[i]) + int(low[j])):
                    continue
            if level:
                if self._one_component(level, i, j):
                    continue
                below = len(self.levels[level - 1][0])
                left, right = (range(n * FAN, min((n + 1) * FAN, below)) for n in (i, j))
                stack += [(level - 1, x, y) for x in left for y in right if i != j or x <= y]
            elif i != j and (sides is None or sides[i] != sides[j]) and self.root(i) != self.root(j):
                if self._similar(i, j, similarity):
                    found.append((i, j))
                    self.parent[self.root(i)] = self.root(j)
        return found

    def _similar(self, i: int, j: int, similarity: Similarity) -> bool:
        x, y = self.bitmap[i], self.bitmap[j]
        most = min(self.size[i] - np.bitwise_count(x & ~y).sum(), self.size[j] - np.bitwise_count(y & ~x).sum())
        if not similarity.linked(int(most), int(self.size[i]), int(self.size[j])):
            return False
        a, b = self.sets[i], self.sets[j]
        at = np.searchsorted(b, a)
        common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return similarity.linked(common, len(a), len(b))


def _link_rows(similarity: Similarity, keys: list[str]):
    """Links inside every group of rows ``set, component, side, text`` sorted by ``keys``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for group in sorted_groups(batches, keys):
            names = np.array(group.column("set").to_pylist(), np.int64)
            for name, text in zip(names, group.column("text")):
                if name not in cache:
                    if len(cache) >= 2 * BLOCK:
                        cache.clear()
                    (words,) = word_names(text.as_py().encode("utf-8", "surrogatepass").lower())
                    cache[name] = shingles(words, similarity.words)
            held = [cache.get(n) for n in names]
            for k, text in enumerate(group.column("text")):
                if held[k] is None:
                    (words,) = word_names(text.as_py().encode("utf-8", "surrogatepass").lower())
                    held[k] = shingles(words, similarity.words)
            order = sorted(range(len(names)), key=lambda k: len(held[k]))
            names = names[order]
            start, parent = {}, []
            for k, component in enumerate(group.column("component").to_pylist()[o] for o in order):
                parent.append(start.setdefault((0, component) if component is not None else (1, k), k))
            sides = np.array(group.column("side").to_pylist())[order]
            tree = Tree([held[k] for k in order], parent)
            links = tree.links(similarity, sides if sides.max() > 0 else None)
            a = np.array([names[i] for i, _ in links], np.int64)
            b = np.array([names[j] for _, j in links], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return rows


def _compared(groups: DataFrame, texts: DataFrame, keys: list[str], similarity: Similarity) -> DataFrame:
    """Links found inside the groups ``keys, set, component, side``."""
    rows = groups.join(texts.hint("merge"), "set").select(*keys, "set", "component", "side", "text")
    rows = rows.repartition(task_count(groups.sparkSession), *keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_link_rows(similarity, keys), "a bigint, b bigint")


def _blocks(count: str, size: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")


def _links_between_blocks(members: DataFrame, texts: DataFrame, components: DataFrame, similarity: Similarity) -> DataFrame:
    """Links of groups that one task could not hold, beyond those inside their blocks.

    Members are dealt anew into nodes of one component, where it fills one, or
    mixed ones, each within one band of sizes; pairs of nodes that are one
    component or whose sizes differ too much are dropped before any text moves.
    """
    placed = (members.join(components, members["set"] == components["node"], "left")
              .select("top", "set", "n_shingles", F.coalesce("component", "set").alias("component")))
    placed = staged(placed, "members")
    mixed = placed.groupBy("top").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("top")
    placed = placed.join(staged(mixed, "mixed"), "top", "left_semi").withColumn(
        "band", F.floor(F.log("n_shingles") / -math.log(similarity.percent / 100)).cast("int"))
    per = staged(placed.groupBy("top", "component", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")), "parts")
    part = placed.join(per, ["top", "component", "band"]).withColumn(
        "own", F.when(F.col("n") * 2 >= BLOCK, F.col("component")))
    sizes = staged(part.groupBy("top", "own", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
                   .withColumn("blocks", _blocks("n", "s")).drop("n", "s"), "nodes")
    dealt = part.drop("n", "s").alias("p").join(sizes.alias("z"), F.expr(
        "p.top = z.top AND p.band = z.band AND p.own <=> z.own")).selectExpr(
        "p.top", "p.set", "p.component", "p.own", "p.band", "pmod(xxhash64(p.set, 7), z.blocks) AS block")
    dealt = staged(dealt.withColumn("node", F.xxhash64("own", "band", "block")), "dealt")
    nodes = staged(dealt.select("top", "node", "own", "band").distinct(), "nodes")
    pairs = nodes.alias("i").join(nodes.alias("j"), F.expr(
        "i.top = j.top AND i.node <= j.node AND abs(i.band - j.band) <= 1 AND "
        "NOT (i.own IS NOT NULL AND j.own IS NOT NULL AND i.own = j.own)")).selectExpr(
        "i.top AS top", "i.node AS left", "j.node AS right")
    pairs = staged(pairs, "pairs")
    sides = pairs.select("top", "left", "right", F.inline(F.when(
        F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("node"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("left").alias("node"), F.lit(0).alias("side")),
            F.struct(F.col("right").alias("node"), F.lit(1).alias("side"))))))
    rows = sides.join(dealt.select("top", "node", "set", "component"), ["top", "node"])
    return _compared(rows.select("top", "left", "right", "set", "component", "side"), texts, ["top", "left", "right"], similarity)


def near_duplicates(documents: DataFrame, similarity: Similarity = Similarity()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the least id reachable by links).

    A-Z are lower-cased. A document's set is its distinct shingles, or all its
    words as one shingle if they are fewer; without words or with a null text
    the set is empty and linked with nothing. Equal sets are one node of the
    graph. A row without an id is linked through rows of the same set that
    have one; alone it has no component. Repeated rows are repeated in the
    result.

    1. Equal sets collapse. Each set has ``BANDS`` band names; the least set
       of every name shared by two sets is the top of a group that holds all
       sets of the name. Every pair with a common band stands in a common group.
    2. Groups are compared by signature trees, in blocks where they are large.
       A block also holds the group's top.
    3. Groups of several blocks whose members are not yet one component go on
       with the pairs of blocks that can still hold links.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets = staged(documents.mapInArrow(_set_rows(similarity), "doc_id bigint, n_shingles bigint, set bigint, "
                                       "bands array<bigint>"), "sets")
    banded = sets.filter("set is not null").select("set", F.explode("bands").alias("band"))
    shared = staged(banded.groupBy("band").agg(F.min("set").alias("top"), F.max("set").alias("most"))
                    .filter("top < most").drop("most"), "bands")
    stars = staged(banded.join(shared, "band").filter("set <> top").select("top", "set").distinct(), "stars")
    wanted = stars.select("set").union(stars.select("top")).distinct()
    holder = staged(sets.join(wanted, "set").groupBy("set").agg(F.min("doc_id").alias("doc_id"),
                                                                F.first("n_shingles").alias("n_shingles")), "holders")
    # A merge join at every size: a small run must not profit from a broadcast that a large one cannot have.
    known = documents.join(holder.filter("doc_id is not null").select("doc_id", "set").hint("merge"), "doc_id")
    texts = staged(known.mapInArrow(_own_texts(similarity), "set bigint, text string"), "texts")
    sized = stars.join(holder.select("set", "n_shingles"), "set")
    tops = staged(sized.groupBy("top").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
                  .withColumn("blocks", _blocks("n", "s")).drop("n", "s"), "tops")
    dealt = sized.join(tops, "top").select("top", "set", "n_shingles", "blocks",
                                           F.expr("pmod(xxhash64(set), blocks)").cast("int").alias("block"))
    dealt = staged(dealt, "dealt")
    heads = tops.select("top", F.col("top").alias("set"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    nothing, whole = F.lit(None).cast("bigint").alias("component"), F.lit(0).alias("side")
    groups = dealt.select("top", "block", "set").unionByName(heads.select("top", "block", "set"))
    links = staged(_compared(groups.select("top", "block", "set", nothing, whole), texts, ["top", "block"], similarity), "links")
    components = staged(connected_components(links), "components")
    large = dealt.filter("blocks > 1")
    if not large.isEmpty():
        members = large.select("top", "set", "n_shingles").unionByName(
            large.select(F.col("top"), F.col("top").alias("set")).distinct().join(holder.select("set", "n_shingles"), "set")
            .select("top", "set", "n_shingles"))
        more = staged(_links_between_blocks(members, texts, components, similarity), "links")
        components = staged(connected_components(links.unionByName(more)), "components")
    return _with_components(sets.drop("bands"), components)


def _own_texts(similarity: Similarity):
    """Texts whose set is the one asked for, once per task: an id may stand on several rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("set").to_pylist(), batch.column("text")):
                (words,) = word_names((text.as_py() or "").encode("utf-8", "surrogatepass").lower())
                found = shingles(words, similarity.words)
                if len(found) and set_name(found) == name:
                    names.append(name)
                    texts.append(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())], ["set", "text"])
    return rows


def _with_components(sets: DataFrame, components: DataFrame) -> DataFrame:
    """Attach to every row the least document id of its component; ids of lone sets that repeat count too."""
    per_set = sets.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    joined = per_set.join(components, per_set["set"] == components["node"], "left").select(
        "set", "first", "n", F.coalesce("component", "set").alias("component"))
    joined = staged(joined, "classes")
    least = staged(joined.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("rows"))
                   .filter("rows > 1").drop("rows"), "least")
    named = staged(joined.join(least, "component").select("set", "component_id"), "named")
    # Only sets of repeated rows or linked sets are in ``named``; a hot set is one key with many rows on the left.
    out = sets.join(named, "set", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


@query("op9_ngram_jaccard_join")
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class under three-word shingles and a similarity of at least 0.9."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Similarity(3, 90))
