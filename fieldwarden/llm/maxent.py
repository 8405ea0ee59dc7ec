"""Language-model scores: a hashed maximum-entropy model over word n-grams and skip pairs.

Words are leaves of nested classes of at most 16 members (a 16-ary Huffman
tree over their counts). The probability of a word is the product of the
softmaxes along its path, whose weights are sums of hashed features of the
words before it. Rounds of distributed gradient updates train the weights;
counts over the whole corpus give the classes, their base rates and the
probabilities of the words that have no leaf of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, spread, staged, task_count
from .registry import query
from .words import Chunk, chunks, mix, signed, span_names


@dataclass(frozen=True)
class Settings:
    """Sizes of the model.

    ``leaves`` most frequent words have a leaf of their own, all others share
    one and are told apart by their counts. ``known`` bounds the broadcast
    list of words with counts; the counts of rarer words are joined. Weights
    are ``2**bits`` rows of 16 numbers. Every round of training reads another
    part of the documents once.
    """

    leaves: int = 1 << 16
    known: int = 1 << 20
    bits: int = 18
    rounds: int = 2
    rate: float = 0.1


#: Members of a class.
ARY = 16
#: Word, pair, skip and outer skip: which of the three words before are in each feature.
CONTEXTS = ((1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1))
#: Class decisions of one update, and of one slice of scoring.
BATCH = 1 << 13
#: Rows of weights that travel as one value.
BLOCK = 1 << 11
#: Most input splits that one learner reads where there are many.
SPLITS = 16
#: Distinct words of a task before their counts are sent on.
HELD = 1 << 20
#: Name of what stands before a text; the end of a text is a leaf without a name.
_BEFORE = np.uint64(0x6A09E667F3BCC909)
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_FOLD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Classes:
    """Nested classes: of leaf ``i`` the decisions ``start[i]:start[i + 1]``, each a class (``node``) and a member (``member``)."""

    start: np.ndarray
    node: np.ndarray
    member: np.ndarray
    base: np.ndarray
    salt: np.ndarray = field(init=False)

    def __post_init__(self):
        self.salt = mix(np.arange(len(self.base), dtype=np.uint64) + np.uint64(1 << 20))


def nested_classes(mass: np.ndarray) -> Classes:
    """Classes of leaves with positive ``mass``: the lightest are joined first; base rates are logarithms of shares."""
    count = len(mass)
    heap = [(int(m), i) for i, m in enumerate(mass)]
    heap += [(0, -1 - i) for i in range(-(count - 1) % (ARY - 1))]
    heapq.heapify(heap)
    parent, place, base = {}, {}, []
    while len(heap) > 1:
        members = [heapq.heappop(heap) for _ in range(ARY)]
        node = len(base)
        total = sum(m for m, _ in members)
        base.append([np.log(m / total) if m else -80.0 for m, _ in members])
        for at, (_, i) in enumerate(members):
            parent[i], place[i] = node, at
        heapq.heappush(heap, (total, count + node))
    start, nodes, picks = [0], [], []
    for leaf in range(count):
        at, path = leaf, []
        while at in parent:
            path.append((parent[at], place[at]))
            at = count + parent[at]
        for n, p in reversed(path):
            nodes.append(n)
            picks.append(p)
        start.append(len(nodes))
    return Classes(np.array(start), np.array(nodes, np.int32), np.array(picks, np.int32),
                   np.array(base, np.float32).reshape(-1, ARY))


@dataclass
class Vocabulary:
    """Counts of the corpus, as far as every task knows them.

    ``names`` (sorted) and ``counts`` of the known words; ``leaf`` is their
    number in the classes, the last two leaves are the shared one and the end
    of a text. ``rare_total`` and ``rare_words`` describe the words without a
    leaf, ``total`` and ``distinct`` all tokens.
    """

    names: np.ndarray
    counts: np.ndarray
    leaf: np.ndarray
    classes: Classes
    total: int
    distinct: int
    texts: int
    rare_total: int
    rare_words: int

    @property
    def shared(self) -> int:
        return len(self.classes.start) - 3

    @property
    def end(self) -> int:
        return len(self.classes.start) - 2

    def find(self, names: np.ndarray) -> np.ndarray:
        """Place of each name in the list, -1 if it is not known."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)


def vocabulary(names: np.ndarray, counts: np.ndarray, total_words: int, distinct_words: int, texts: int, leaves: int) -> Vocabulary:
    """The classes of the ``leaves`` most frequent of the known words; ties go to the smaller name."""
    order = np.lexsort((names, -counts))
    own = np.sort(order[:leaves])
    leaf = np.full(len(names), len(own))
    leaf[own] = np.arange(len(own))
    rare = int(total_words - counts[own].sum())
    mass = np.concatenate([counts[own], [rare + 1, max(texts, 1)]])
    return Vocabulary(names, counts, leaf, nested_classes(mass), total_words + texts, distinct_words + (texts > 0), texts,
                      rare, distinct_words - len(own))


@dataclass
class Tokens:
    """Tokens of a chunk of texts: every word and an end per text."""

    row: np.ndarray
    name: np.ndarray
    ends: np.ndarray
    word: np.ndarray

    def contexts(self) -> np.ndarray:
        """One number per token and feature: what the words before it are."""
        first = np.append(0, self.ends[:-1] + 1)
        back = np.arange(len(self.name)) - first[self.row]
        before = [np.where(back >= k, np.roll(self.name, k), _BEFORE + np.uint64(k)) for k in (1, 2, 3)]
        out = []
        for salt, used in zip(_SALTS, CONTEXTS):
            value = np.full(len(self.name), salt)
            for k, word in enumerate(before):
                if used[k]:
                    value = mix(value ^ word)
            out.append(value)
        return np.stack(out)


def tokens_of(chunk: Chunk) -> Tokens:
    """Tokens of a chunk; a text without words is its end alone."""
    size = chunk.last - chunk.first + 1
    ends = np.cumsum(size) - 1
    word = np.ones(size.sum(), bool)
    word[ends] = False
    name = np.full(len(word), _BEFORE)
    name[word] = chunk.names[0]
    return Tokens(np.repeat(np.arange(len(size)), size), name, ends, word)


def _steps(classes: Classes, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All class decisions of the leaves: number of the token, class, member."""
    size = classes.start[leaf + 1] - classes.start[leaf]
    token = np.repeat(np.arange(len(leaf)), size)
    at = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) + classes.start[leaf][token]
    return token, classes.node[at], classes.member[at]


def _rows(contexts: np.ndarray, salts: np.ndarray, bits: int) -> np.ndarray:
    return (((contexts ^ salts) * _FOLD) >> np.uint64(64 - bits)).astype(np.int64)


def _exponentials(base: np.ndarray, node: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the members of every decision, and their sums."""
    logits = base.take(node, axis=0)
    for feature in rows:
        logits += weights.take(feature, axis=0)
    # In this range neither single precision nor the sum can overflow, so no maximum is taken off.
    found = np.exp(np.clip(logits, -80, 80, out=logits), out=logits)
    return found, found @ np.ones(ARY, np.float32)


def log_probabilities(classes: Classes, weights: np.ndarray, leaf: np.ndarray, contexts: np.ndarray, bits: int) -> np.ndarray:
    """Natural logarithm of the probability of each token's leaf."""
    token, node, member = _steps(classes, leaf)
    found = np.empty(len(token))
    for begin in range(0, len(token), BATCH):
        part = slice(begin, begin + BATCH)
        rows = _rows(contexts[:, token[part]], classes.salt[node[part]], bits)
        shares, total = _exponentials(classes.base, node[part], weights, rows)
        found[part] = np.log(shares[np.arange(len(shares)), member[part]].astype(np.float64) / total)
    return np.bincount(token, found, minlength=len(leaf))


def _sums_by_row(rows: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of weights that a batch uses, the sum of the slopes of each (``rows`` has one line per feature), and its uses."""
    flat = rows.ravel()
    packed = np.sort((flat << 20) | np.arange(len(flat)))
    ordered = packed >> 20
    sums = slope.take((packed & ((1 << 20) - 1)) % len(slope), axis=0)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    uses = np.diff(np.append(first, len(ordered)))
    # Runs of equal rows are folded: neighbours first, then every second sum, every fourth ...
    size = np.repeat(uses, uses)
    place = np.arange(len(ordered)) - np.repeat(first, uses)
    open_, step = np.flatnonzero(size > 1), 1
    while len(open_):
        open_ = open_[(place[open_] & step) == 0]
        into = open_[place[open_] + step < size[open_]]
        sums[into] += sums.take(into + step, axis=0)
        step *= 2
        open_ = open_[size[open_] > step]
    return ordered[first], sums.take(first, axis=0), uses


class Learner:
    """Gradient updates of one task, with a step size per row that shrinks with its gradients (AdaGrad)."""

    def __init__(self, weights: np.ndarray, rate: float):
        self.weights = weights.copy()
        self.squares = np.zeros(len(weights), np.float32)
        self.touched = np.zeros(len(weights), np.int64)
        self.bits = len(weights).bit_length() - 1
        self.rate = rate

    def update(self, classes: Classes, leaf: np.ndarray, contexts: np.ndarray) -> None:
        token, node, member = _steps(classes, leaf)
        whole = self.weights.view(f"V{4 * ARY}").ravel()
        for begin in range(0, len(token), BATCH):
            part = slice(begin, begin + BATCH)
            rows = _rows(contexts[:, token[part]], classes.salt[node[part]], self.bits)
            slope, total = _exponentials(classes.base, node[part], self.weights, rows)
            slope /= total[:, None]
            slope[np.arange(len(slope)), member[part]] -= 1
            seen, sums, uses = _sums_by_row(rows, slope)
            self.squares[seen] += np.einsum("ij,ij->i", sums, sums) / ARY
            self.touched[seen] += uses
            sums *= (-self.rate / np.sqrt(self.squares[seen] + 1e-6))[:, None]
            sums += self.weights.take(seen, axis=0)
            np.put(whole, seen, sums.view(whole.dtype).ravel())


def held_out(doc_id: Column) -> Column:
    """Whether nothing is learned from this document; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task by two names with their counts; texts are counted under null names."""
    def sent(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b)), pa.array(n)], ["a", "b", "n"])

    def summed(parts):
        a, b, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[first], b[first], np.add.reduceat(n, first)

    texts, held, waiting = 0, [], 0
    for chunk in chunks(batches, lower=True):
        texts += len(chunk.rows)
        a, at, n = np.unique(chunk.names[0], return_index=True, return_counts=True)
        held.append((a, span_names(chunk.data, chunk.starts[at], chunk.ends[at], 2), n))
        waiting += len(a)
        # Sums are taken when as much has come as was left of the last ones.
        if waiting > HELD // 2 and waiting > len(held[0][0]):
            held, waiting = [summed(held)], 0
            if len(held[0][0]) > HELD:
                yield sent(*held.pop())
    if any(len(a) for a, _, _ in held):
        yield sent(*summed(held))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([texts])], ["a", "b", "n"])


def word_counts(documents: DataFrame) -> DataFrame:
    """``a, b, n`` of every word of the texts, one row per word; the row without names counts the texts. Staged."""
    counted = spread(documents.select("text")).mapInArrow(_count_rows, "a bigint, b bigint, n bigint")
    return staged(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "word_counts")


def known_words(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count with which at most ``most`` words are known, and names and counts of these.

    Counts are grouped by their highest six bits, so what the driver reads of
    the groups is a few hundred rows.
    """
    words = counts.filter("a is not null")
    shift = F.greatest(F.floor(F.log2("n")) - 5, F.lit(0)).cast("int")
    level = F.expr("shiftleft(shiftright(n, s), s)")
    levels = words.withColumn("s", shift).groupBy(level.alias("least")).agg(F.count("*").alias("words")).collect()
    least, number = 1 << 62, 0
    for at, size in sorted(((r["least"], r["words"]) for r in levels), reverse=True):
        if number + size > most:
            break
        least, number = at, number + size
    rows = words.filter(F.col("n") >= least).select("a", "n").toArrow()
    name, n = rows.column("a").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(name, kind="stable")
    return least, name[order], n[order]


def _update_rows(vocab, weights, settings: Settings):
    """One row per block of weights that a task changed: its number, the task, changes and how often each row was used."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, learner = vocab.value, Learner(weights.value, settings.rate)
        for chunk in chunks(batches, lower=True):
            tokens = tokens_of(chunk)
            leaf = _leaves(known, tokens)
            learner.update(known.classes, leaf, tokens.contexts())
        change = (learner.weights - weights.value).astype("<f2").reshape(-1, min(BLOCK, len(learner.weights)) * ARY)
        used = np.minimum(learner.touched, 0xFFFFFFFF).astype("<u4").reshape(len(change), -1)
        seen = np.flatnonzero(used.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), pa.array(np.full(len(seen), TaskContext.get().partitionId(), np.int64)),
             pa.array([change[i].tobytes() for i in seen], pa.binary()), pa.array([used[i].tobytes() for i in seen], pa.binary())],
            ["block", "task", "change", "used"])
    return rows


def _averaged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of a block averaged over tasks, each row weighted by its uses; sorted by block, one block held at a time."""
    def sent(block, total, weight):
        mean = (total / np.maximum(weight, 1)[:, None]).astype("<f4")
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["block", "change"])

    last, total, weight = None, None, None
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column(0)[i].as_py()
            used = np.frombuffer(batch.column("used")[i].as_py(), "<u4").astype(np.float64)
            change = np.frombuffer(batch.column("change")[i].as_py(), "<f2").astype(np.float64).reshape(len(used), ARY)
            if block != last:
                if last is not None:
                    yield sent(last, total, weight)
                last, total, weight = block, np.zeros_like(change), np.zeros_like(used)
            total += change * used[:, None]
            weight += used
    if last is not None:
        yield sent(last, total, weight)


def _leaves(vocab: Vocabulary, tokens: Tokens, place: np.ndarray | None = None) -> np.ndarray:
    leaf = np.full(len(tokens.name), vocab.shared)
    if place is None:
        distinct, back = np.unique(tokens.name[tokens.word], return_inverse=True)
        place = vocab.find(distinct)[back]
    own = np.flatnonzero(tokens.word)[place >= 0]
    leaf[own] = vocab.leaf[place[place >= 0]]
    leaf[tokens.ends] = vocab.end
    return leaf


def trained(documents: DataFrame, vocab, settings: Settings) -> np.ndarray:
    """Weights after all rounds over ``documents`` (``doc_id, text``); ``vocab`` is the broadcast vocabulary.

    In a round every task starts from the same weights and learns from its
    share of the texts; the changes of a row are averaged over the tasks,
    weighted by its uses there. The driver sees the averaged blocks alone,
    as many numbers as the model has.
    """
    spark = documents.sparkSession
    weights = np.zeros((1 << settings.bits, ARY), np.float32)
    # Every learner sends a whole model: small input splits are read one after the other by two learners a core.
    splits = documents.rdd.getNumPartitions()
    learners = max(1, min(splits, max(2 * spark.sparkContext.defaultParallelism, splits // SPLITS)))
    for turn in range(settings.rounds):
        sent = spark.sparkContext.broadcast(weights)
        part = documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(settings.rounds)) == turn)
        changes = part.select("text").coalesce(learners).mapInArrow(_update_rows(vocab, sent, settings), "block int, task bigint, change binary, used binary")
        mean = (changes.repartition(task_count(spark), "block").sortWithinPartitions("block", "task")
                .mapInArrow(_averaged_rows, "block int, change binary"))
        weights = weights.copy()
        blocks = weights.reshape(-1, min(BLOCK, len(weights)) * ARY)
        for block, change in mean.toLocalIterator():
            blocks[block] += np.frombuffer(change, "<f4")
    return weights


def _score_rows(vocab, weights, settings: Settings):
    """Scores of every text as far as the known words go, and the words that are left, twice named and counted."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = vocab.value, weights.value
        for chunk in chunks(batches, lower=True):
            tokens, count = tokens_of(chunk), len(chunk.rows)
            distinct, back = np.unique(tokens.name[tokens.word], return_inverse=True)
            place = known.find(distinct)[back]
            leaf = _leaves(known, tokens, place)
            logs = log_probabilities(known.classes, table, leaf, tokens.contexts(), settings.bits) / np.log(10)
            row = tokens.row[tokens.word]
            listed = place >= 0
            plus = np.zeros(len(row))
            plus[listed] = np.log10(known.counts[place[listed]] + 1.0)
            without = leaf[tokens.word] == known.shared
            score = np.bincount(tokens.row, logs, minlength=count) + np.bincount(
                row[without], plus[without] - np.log10(known.rare_total + known.rare_words + 1), minlength=count)
            base = np.bincount(row, plus, minlength=count) + np.log10(known.texts + 1)
            size = np.bincount(tokens.row, minlength=count)
            base -= size * np.log10(known.total + known.distinct + 1)
            seen = np.bincount(row[listed], minlength=count) + (known.texts > 0)
            # Equal words of a text side by side, texts in order.
            left = np.flatnonzero(~listed)
            a, b = chunk.names[0][left], span_names(chunk.data, chunk.starts[left], chunk.ends[left], 2)
            order = np.lexsort((b, a, row[left]))
            a, b, owner = a[order], b[order], row[left][order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(a)))
            words = pa.StructArray.from_arrays([pa.array(signed(a[first])), pa.array(signed(b[first])), pa.array(times)], ["a", "b", "k"])
            offsets = np.append(0, np.cumsum(np.bincount(owner[first], minlength=count))).astype(np.int32)
            keys = [pa.array([r[i] for r in chunk.rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(size), pa.array(seen), pa.array(base), pa.array(score),
                                              pa.ListArray.from_arrays(pa.array(offsets), words)],
                                             ["doc_id", "x", "y", "n_tokens", "n_known", "base", "score", "left"])
    return rows


def scored(documents: DataFrame, learn: Column, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``documents`` (``doc_id, text``): ``doc_id, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are the words of the text, A-Z as a-z, and one end; a null text is
    empty. ``learn`` marks the documents that are learned from (null: not).
    ``base_score`` sums ``log10((c + 1) / (N + V + 1))`` with a token's count
    ``c`` among the ``N`` learned tokens, ``V`` of them distinct; ``n_known``
    counts tokens with ``c > 0``. ``score`` is the logarithm of the text's
    probability under the model, which gives unseen words one share of the
    class of rare words, so that all probabilities sum to one.

    Rows that repeat an id are documents of their own; equal rows have equal
    scores. Without learned texts the model knows the end and unseen words
    alone. An empty table gives no rows, further columns are left aside.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    learned = rows.filter("learn").select("doc_id", "text")
    counts = word_counts(learned)
    totals = counts.agg(F.sum(F.when(F.col("a").isNotNull(), F.col("n"))).alias("words"), F.count("a").alias("distinct"),
                        F.sum(F.when(F.col("a").isNull(), F.col("n"))).alias("texts")).first()
    least, names, known = known_words(counts, settings.known)
    vocab = spark.sparkContext.broadcast(vocabulary(names, known, totals["words"] or 0, totals["distinct"], totals["texts"] or 0,
                                                    settings.leaves))
    weights = spark.sparkContext.broadcast(trained(learned, vocab, settings))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), "text")
    key = ["doc_id", "x", "y"]
    found = staged(spread(keyed).mapInArrow(
        _score_rows(vocab, weights, settings), "doc_id bigint, x bigint, y bigint, n_tokens bigint, n_known bigint, base double, score double, "
        "left array<struct<a:bigint,b:bigint,k:bigint>>"), "scored")
    # A word without a count adds log10(1) to every sum: only words with one are looked up.
    rare = counts.filter((F.col("n") < least) & F.col("a").isNotNull())
    plus = F.col("k") * F.log10(F.col("n") + 1.0)
    looked_up = found.select(*key, F.inline("left")).join(rare, ["a", "b"]).groupBy(*key).agg(
        F.sum("k").alias("more"), F.sum(plus).alias("plus"))
    copies = found.groupBy(*key).agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    same = [copies[c].eqNullSafe(looked_up[c]) for c in key]
    whole = copies.join(looked_up, same, "left").select(*[copies[c] for c in copies.columns], "more", "plus")
    extra = F.coalesce(F.col("plus") / F.col("copies"), F.lit(0.0))
    out = whole.select("doc_id", "n_tokens", (F.col("n_known") + F.expr("coalesce(more div copies, 0)")).alias("n_known"),
                       F.lit(int(vocab.value.total)).cast("bigint").alias("train_tokens"), (F.col("base") + extra).alias("base_score"),
                       (F.col("score") + extra).alias("score"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return out.drop("copy")


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of six sevenths of them."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    result = scored(documents, ~held_out(F.col("doc_id")))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
