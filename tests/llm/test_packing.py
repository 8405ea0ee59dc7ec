"""Packing: whole documents, gapless sequences, little padding, ids of the tokenizer."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldwarden.llm import packing
from fieldwarden.llm.packing import shortest_pack_first

PATH = public_tokenizers.path("byte_bpe_50k.json")


def padded(n, capacity):
    return n if n & (n - 1) == 0 else capacity


@pytest.mark.parametrize("seed", range(4))
def test_histogram(seed):
    draw = random.Random(seed)
    capacity = 64
    histogram = {n: draw.randint(0, 500) for n in range(1, capacity + 1) if draw.random() < 0.6}
    slots = shortest_pack_first(histogram, capacity)
    sequences = defaultdict(list)
    for length, count in histogram.items():
        s = slots.get(length)
        for rank in range(count):
            j = int(np.searchsorted(s.first, rank, "right")) - 1
            r = rank - s.first[j]
            sequences[s.sequence[j] + r // s.each[j]].append((s.offset[j] + r % s.each[j] * length, length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(n for p in sequences.values() for _, n in p) == sum(n * c for n, c in histogram.items())


@pytest.mark.parametrize("documents", [700, 70_000])
def test_little_padding_for_lengths_of_documents(documents):
    draw, capacity = random.Random(9), 2048
    histogram = Counter(min(capacity, max(1, int(draw.lognormvariate(math.log(400), 1)))) for _ in range(documents))
    filled = Counter()
    for length, s in shortest_pack_first(histogram, capacity).items():
        for first, end, sequence, each in zip(s.first, [*s.first[1:], histogram[length]], s.sequence, s.each):
            filled.update({sequence + r: length * int(each) for r in range((end - first) // each)})
    assert sum(filled.values()) >= 0.99 * sum(padded(n, capacity) for n in filled.values())


def test_one_length_fills_sequences():
    slots = shortest_pack_first({10: 100}, 64)
    assert slots[10].sequence.max() < 17
    assert shortest_pack_first({}, 64) == {}
    with pytest.raises(ValueError):
        shortest_pack_first({65: 1}, 64)


def test_any_number_of_runs(spark):
    # One document of each length above a half, and 200,000 short ones that fill their rooms one by one.
    rows = spark.range(1025, 2048).selectExpr("id AS doc_id", "id AS length").unionByName(
        spark.range(200_000).selectExpr("id + 5000 AS doc_id", "1L AS length")).unionByName(
        spark.range(90_000).selectExpr("id + 500000 AS doc_id", "id % 700 + 2 AS length"))
    pieces = rows.selectExpr("doc_id", "0L AS start", "length", "doc_id AS ids_crc32")
    got = packing.pack(pieces).select("doc_id", "length", "sequence_id", "offset").toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(got.doc_id) == sorted(r.doc_id for r in rows.select("doc_id").toLocalIterator())
    at = got.groupby("sequence_id").length.cumsum() - got.length
    assert (at == got.offset).all() and (at + got.length <= 2048).all()
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))


def test_documents(spark):
    draw = random.Random(1)
    words = ["the", "éa", "  ", "\n", "12345", "naïve", "<|endoftext|>", "日本", "don't"]
    texts = [(d, " ".join(draw.choices(words, k=draw.choice([0, 3, 200, 900])))) for d in range(40)]
    texts += [(40, None), (41, ""), (3, texts[3][1]), (None, "no id"), (42, "word " * 3000)]
    df = spark.createDataFrame([(d, t, 5, 0) for d, t in texts], "doc_id bigint, text string, length int, rank int")
    pieces = packing.cut_pieces(df, packing.default_encoder(), 256).cache()
    rows = packing.pack(pieces, 256).collect()
    slow = Tokenizer.from_file(PATH)
    ids = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    by_doc = defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids == part and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
    for d, parts in by_doc.items():
        copies = sum(1 for x, _ in texts if x == d)
        assert sum(n for _, n in parts) == copies * len(ids[d])
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 256
    empty = packing.cut_pieces(df.limit(0), packing.default_encoder())
    assert packing.pack(empty).collect() == []


def test_fast_encoder_gives_the_ids_of_the_tokenizer():
    encode, slow = packing.default_encoder()(), Tokenizer.from_file(PATH)
    draw = random.Random(2)
    letters = list("abc XYZ  \n\t\r.,'-0123456789éßñ日本語😀\u0301\u200b\xa0\x1c") + ["'s", "'LL", "\r\n", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(draw.choices(letters, k=draw.randint(0, 60)))
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids, repr(text)
