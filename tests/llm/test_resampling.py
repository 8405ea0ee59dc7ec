"""Draws against a plain recomputation with zlib and hashlib, document by document."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldwarden.llm.ngramcrc import SHORT, word_chunks
from fieldwarden.llm.resampling import Draw, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def brute_force(rows, target, buckets=10_000, percent=25, least_words=20, seed=7):
    def counts(texts):
        return Counter(zlib.crc32(f.encode("utf-8")) % buckets for t in texts for f in features(t))

    s, t = counts(x for _, x in rows), counts(target)
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))

    out = []
    for doc_id, text in rows:
        found = features(text)
        weight = sum(gain(zlib.crc32(f.encode("utf-8")) % buckets) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + .5) / 4294967296))), None])
    pool = [r for r in out if r[1] + 1 >= 2 * least_words]
    pool.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(pool[:percent * len(pool) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=str)


def corpus(seed, count):
    draw = random.Random(seed)
    common = ["A line, that MANY documents share\twith 1234 and more", "ünïcode Wörter 日本語 mixed", "-- --", "x" * 90 + " end"]
    words = [f"w{i}" for i in range(60)] + ["Éa", "don't", "a_b", "Z9", "q" * (SHORT + 1), "\x00", "é" * 30]
    rows = []
    for d in range(count):
        lines = [draw.choice(common) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(0, 12)))
                 for _ in range(draw.randint(0, 9))]
        rows.append((d, draw.choice(["\n", "\n\n", "\r\n"]).join(lines)))
    return rows


def run(spark, rows, target, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, rank string, line int")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resampled(df, wanted, Draw(**how)).collect()), key=str)


def test_word_and_pair_crcs():
    texts = ["a b", "", None, "Ünï " + "k" * (SHORT - 1) + " " + "l" * SHORT + " " + "m" * (SHORT + 5), "A-b\nC", "tail", "日本 x"] * 3
    words, pairs, at = [], [], 0
    for begin, end, found in word_chunks(pa.array(["cut off", *texts])[1:]):
        crc = found.crcs()
        first, joined = found.pairs(crc)
        words += crc.tolist()
        pairs += joined.tolist()
        assert begin == at and np.all(np.diff(found.row) >= 0) and np.all(found.row[first] == found.row[first + 1])
        at = end
    split = [WORD.findall((t or "").replace("A", "a").replace("C", "c")) for t in texts]
    assert words == [zlib.crc32(w.encode()) for t in split for w in t]
    assert pairs == [zlib.crc32(f"{a} {b}".encode()) for t in split for a, b in zip(t, t[1:])]
    assert at == len(texts)


@pytest.mark.parametrize("how", [{}, {"buckets": 37, "percent": 60, "least_words": 1, "seed": 3}, {"percent": 100}])
def test_equals_plain_recomputation(spark, how):
    rows, target = corpus(5, 120), [t for _, t in corpus(6, 20)] + [None, ""]
    # Repeated rows, repeated ids with other texts, no id, no text, one very long text.
    rows += [rows[3], rows[3], (3, rows[40][1]), (None, rows[41][1]), (None, rows[41][1]), (None, None), (500, None), (501, ""),
             (502, " \n ".join(f"long{i % 1000} line" for i in range(60_000)))]
    assert run(spark, rows, target, **how) == brute_force(rows, target, **how)


def test_ties_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 3 + [(7, text)] * 5 + [(None, text + " more")]
    assert run(spark, rows, [text], percent=70) == brute_force(rows, [text], percent=70)
    assert run(spark, [], [text]) == []
    assert run(spark, rows, []) == brute_force(rows, [])


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        Draw(buckets=70_000)
    with pytest.raises(ValueError):
        Draw(percent=101)
