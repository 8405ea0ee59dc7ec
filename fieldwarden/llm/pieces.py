"""SentencePiece encoding and decoding with the N best segmentations of whole texts.

A forward Viterbi pass scores every position of a piece lattice; these scores
are exact heuristics for an A* search from the end, so segmentations come out
best first and no hypothesis is expanded in vain.
"""

from __future__ import annotations

import heapq
import re
import sys
import types
import zlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from .registry import query

#: The mark that stands for a space inside pieces (fixed value).
SPACE = "▁"
#: Score of a byte below the worst piece: a character without a piece is spelled in bytes.
BYTE_PENALTY = 10.0
#: Units of each of the two generations that a worker process remembers.
CACHE = 250_000
#: Segmentations of the registered query.
BEST = 4


class PieceModel:
    """Pieces and scores of a SentencePiece model file.

    A text gets a space in front, spaces become ``SPACE``, and nothing else is
    changed, so decoding gives every text back. A literal ``SPACE`` in a text
    is spelled in bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.decoded: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.bytes[value] = i
                self.decoded.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.decoded.append(b"")
            else:
                self.ids[piece] = (i, model.get_score(i))
                self.decoded.append(piece.replace(SPACE, " ").encode())
        self.prepare()

    def prepare(self) -> None:
        """Derive what the lattice needs from pieces and scores."""
        self.byte_score = min((s for _, s in self.ids.values() if s > -1e8), default=0.0) - BYTE_PENALTY
        letters = set("".join(self.ids))
        #: Characters that stand in no piece are cuts of the lattice, as is every end of a word if no piece crosses it.
        cuts = "".join(c for c in "\n\t\r" if c not in letters)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            self.units = re.compile(f"[{cuts}]|[^{cuts}]+" if cuts else "(?s:.+)")
        else:
            self.units = re.compile(f"{SPACE}+[^{SPACE}{cuts}]*|[^{SPACE}{cuts}]+" + (f"|[{cuts}]" if cuts else ""))
        #: Every beginning of a piece: its id and score, or an empty tuple if it is none itself.
        self.prefixes: dict[str, tuple] = {piece[:k]: () for piece in self.ids for k in range(1, len(piece))}
        self.prefixes.update(self.ids)
        self.letters = frozenset(c for c in letters if c in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.ids.items():
            self.automaton.add_word(piece, (len(piece), score, (i,)))
        self.automaton.make_automaton()
        self.cache: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.known: dict[str, tuple[float, float, tuple[int, ...]]] = {}
        self.aged: dict[str, tuple[float, float, tuple[int, ...]]] = {}
        #: Neighbours inside some piece: no piece crosses any other two characters.
        self.inner = frozenset(piece[k:k + 2] for piece in self.ids for k in range(len(piece) - 1))

    def _lattice(self, unit: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Per end position the pieces that end there, as (start, score, ids), and the best score up to every position."""
        size, find = len(unit), self.prefixes.get
        ending: list[list] = [[] for _ in range(size + 1)]
        forward = [0.0] + [float("-inf")] * size
        for start in range(size):
            before = forward[start]
            if unit[start] not in self.ids:
                score, spelled = self._spelled(unit[start])
                ending[start + 1].append((start, score, spelled))
                forward[start + 1] = max(forward[start + 1], before + score)
            for end in range(start + 1, size + 1):
                found = find(unit[start:end])
                if found is None:
                    break
                if found:
                    ending[end].append((start, found[1], (found[0],)))
                    if before + found[1] > forward[end]:
                        forward[end] = before + found[1]
        return ending, forward

    def unit_nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of one unit, best first; fewer if there are no more."""
        known = self.cache.get((unit, n))
        if known is not None:
            return known
        ending, forward = self._lattice(unit)
        push, pop = heapq.heappush, heapq.heappop
        # A hypothesis is what stands behind a position: its score and a chain of pieces that shares its tail.
        found, heap, pushed = [], [(-forward[-1], 0, len(unit), 0.0, None)], 0
        while heap and len(found) < n:
            _, _, at, behind, tail = pop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                found.append((behind, tuple(ids)))
                continue
            for start, score, piece in ending[at]:
                pushed += 1
                total = behind + score
                push(heap, (-(forward[start] + total), pushed, start, total, (piece, tail)))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[unit, n] = found
        return found

    def best(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        """Score and ids of the best segmentation of a unit, and what the second one loses on it (infinite without one).

        A forward pass over all pieces that occur, in the order of their ends,
        keeps the two best scores of every position; no hypothesis is built.
        """
        found = self.aged.get(unit)
        if found is None:
            size = len(unit)
            # A tail that no piece reaches across (mostly punctuation) is segmented by itself, the rest may be known.
            cut = size
            while cut > 1 and unit[cut - 2:cut] not in self.inner:
                cut -= 1
            if cut < size:
                parts = [self.known.get(u) or self.best(u) for u in (unit[:cut], *unit[cut:])]
                found = (sum(p[0] for p in parts), min(p[1] for p in parts), tuple(i for p in parts for i in p[2]))
            else:
                found = self._forward(unit)
        if len(self.known) >= CACHE:
            # The units of the last generation that come up again are taken over.
            self.aged, self.known = self.known, {}
        self.known[unit] = found
        return found

    def _forward(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        size, none = len(unit), float("-inf")
        first, second = [0.0] + [none] * size, [none] * (size + 1)
        via: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (size + 1)
        for last, (length, score, ids) in self.occurring(unit):
            end = last + 1
            start = end - length
            total, old = first[start] + score, first[end]
            if total > old:
                other = second[start] + score
                second[end] = old if old > other else other
                first[end], via[end] = total, (start, ids)
            elif total > second[end]:
                second[end] = total
        path, at = [], size
        while at:
            at, ids = via[at]
            path.append(ids)
        path.reverse()
        return first[size], first[size] - second[size], tuple(chain.from_iterable(path))

    def occurring(self, unit: str) -> Iterable[tuple[int, tuple[int, float, tuple[int, ...]]]]:
        """All pieces inside a unit as (last position, (length, score, ids)), by their ends, the longest first."""
        found = self.automaton.iter(unit)
        if self.letters.issuperset(unit):
            return found
        return sorted([*found, *((i, (1, *self._spelled(c))) for i, c in enumerate(unit) if c not in self.letters)],
                      key=lambda x: (x[0], -x[1][0]))

    def _spelled(self, letter: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character without a piece; a lone surrogate of the units' alphabet marks a literal ``SPACE``."""
        raw = (SPACE if letter == "\ud800" else letter).encode("utf-8", "surrogatepass")
        return self.byte_score * len(raw), tuple(self.bytes[x] for x in raw)

    def split(self, text: str) -> list[str]:
        """Units of a text: no piece crosses from one to the next."""
        return self.units.findall(SPACE + text.replace(SPACE, "\ud800").replace(" ", SPACE)) if text else []

    def choices(self, text: str, n: int) -> tuple[list[tuple[int, ...]], list[tuple[float, dict[int, tuple[int, ...]]]]]:
        """Ids of the best segmentation unit by unit, and the ``n`` best of the whole text as (score, units that differ).

        Units are independent, so the best of the text are the best of all
        combinations. A combination among the ``n`` best departs from the best
        one only in the ``n - 1`` units whose second choice costs least: the
        search for more choices runs in these alone.
        """
        parts, get, make = self.split(text), self.known.get, self.best
        units = [get(u) or make(u) for u in parts]
        losses = np.array([u[1] for u in units])
        open_ = np.argsort(losses, kind="stable")[:n - 1].tolist()
        own = {i: self.unit_nbest(parts[i], n) for i in open_ if losses[i] < np.inf}
        combined: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for i, found in own.items():
            best = found[0][0]
            combined = heapq.nsmallest(n, ((loss + best - score, chosen + (((i, k),) if k else ()))
                                           for loss, chosen in combined for k, (score, _) in enumerate(found)))
        # The search may meet a tie of the best first: its choice stands in all segmentations.
        first = [u[2] for u in units]
        for i, found in own.items():
            first[i] = found[0][1]
        total = sum(u[0] for u in units)
        return first, [(total - loss, {i: own[i][k][1] for i, k in chosen}) for loss, chosen in combined]

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text as (score, ids); one empty segmentation for an empty text."""
        first, found = self.choices(text, n)
        return [(score, [x for i, ids in enumerate(first) for x in changed.get(i, ids)]) for score, changed in found]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation."""
        return b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def described(self, text: str, n: int) -> tuple[list[float], list[np.ndarray], bool]:
        """Scores and ids of the ``n`` best segmentations, and whether every one of them gives the text back."""
        first, found = self.choices(text, n)
        best = np.fromiter(chain.from_iterable(first), "<u4")
        ends = np.cumsum([len(u) for u in first]) if len(found) > 1 else None
        raw, arrays, good = self.decoded, [], self.decode(best.tolist()) == text
        for _, changed in found:
            pieces, at = [], 0
            for i in sorted(changed):
                pieces += [best[at:ends[i] - len(first[i])], np.array(changed[i], "<u4")]
                at = ends[i]
                # The rest is the best segmentation, which is decoded as a whole.
                good = good and b"".join(raw[x] for x in changed[i]) == b"".join(raw[x] for x in first[i])
            arrays.append(np.concatenate([*pieces, best[at:]]) if pieces else best)
        return [score for score, _ in found], arrays, good


def worker_model(path: str) -> PieceModel:
    """The model of a file, read once per worker process, so that later tasks find its segmented units again.

    Functions travel by value with globals of their own; what a process
    shares hangs in its table of modules.
    """
    shelf = sys.modules.setdefault("fieldwarden_worker_models", types.ModuleType("fieldwarden_worker_models"))
    models = shelf.__dict__.setdefault("models", {})
    if path not in models:
        models[path] = PieceModel(path)
    return models[path]


_FIELDS = [("doc_id", pa.int64()), ("n_segmentations", pa.int32()), ("n_pieces", pa.int64()), ("score", pa.float64()),
           ("scores", pa.list_(pa.float64())), ("ids_crc32", pa.list_(pa.int64())), ("decodes", pa.bool_()),
           ("ids", pa.list_(pa.list_(pa.int32())))]


def segmented(documents: DataFrame, model_path: str, n: int = BEST, with_ids: bool = False) -> DataFrame:
    """The ``n`` best segmentations of every text (``doc_id, text``), best first.

    ``n_segmentations`` (there may be fewer), ``n_pieces`` and ``score`` of
    the best, ``scores`` and ``ids_crc32`` (little-endian 32-bit ids) of all,
    ``decodes`` (every one gives the text back) and, with ``with_ids``,
    ``ids``. Null and empty texts have one segmentation without pieces.
    Repeated rows are segmented alike; scores that tie keep the order in which
    the search meets them, which the text alone decides. A task holds one text
    and its ids at a time, about 50 bytes a character. The scores of the file
    are those of the lattice: a file trained by merging encodes its own library's
    way by merges, not by the best sum.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, out, held = worker_model(model_path), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                scores, arrays, good = model.described(text, n)
                out.append((doc_id, len(scores), len(arrays[0]), scores[0], scores, [zlib.crc32(a.tobytes()) for a in arrays], good,
                            [a.astype(np.int32) for a in arrays] if with_ids else None))
                held += len(text)
                if held > 2_000_000:
                    yield _batch(out)
                    out, held = [], 0
        yield _batch(out)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id bigint, n_segmentations int, n_pieces bigint, score double, scores array<double>, "
              "ids_crc32 array<bigint>, decodes boolean, ids array<array<int>>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [f for f, _ in _FIELDS])


@query("op7_sentencepiece_nbest")
def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every document under the public 32k model."""
    import public_tokenizers

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return segmented(documents, public_tokenizers.path("piece_bpe_32k.model")).drop("ids")
