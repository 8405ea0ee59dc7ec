"""Substring dedup against every window of every text."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from fieldwarden.llm import substrings
from fieldwarden.llm.words import word_names

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_force(rows, window):
    """(doc_id, n_words, n_removed, sha256) per row, by comparing all windows."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, kept string, variant int")
    found = substrings.cut_repeats(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted(map(tuple, found), key=str)


def corpus(seed, count, vocabulary):
    draw = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    passages = [[draw.choice(words) for _ in range(draw.randint(5, 60))] for _ in range(6)]
    rows = []
    for d in range(count):
        text = []
        for _ in range(draw.randint(0, 6)):
            text += draw.choice(passages) if draw.random() < 0.5 else [draw.choice(words) for _ in range(draw.randint(1, 30))]
            if draw.random() < 0.2:
                text += [draw.choice(words)] * draw.randint(2, 40)
        rows.append((d, draw.choice([" ", "\n", "\t "]).join(text)))
    rows += [(count, rows[3][1]), (count + 1, rows[3][1] + " tail"), (count + 2, None), (count + 3, ""), (None, rows[4][1]),
             (None, None), (5, rows[5][1]), (7, rows[6][1])]
    return rows


@pytest.mark.parametrize("seed,window,vocabulary", [(1, 10, 400), (2, 10, 3), (3, 25, 2000)])
def test_every_window_is_judged(spark, seed, window, vocabulary):
    rows = corpus(seed, 60, vocabulary)
    assert run(spark, rows, window) == brute_force(rows, window)


def test_empty_table(spark):
    assert run(spark, [], 10) == []


def test_runs_and_periods(spark):
    rows = [(1, "a " * 200), (2, "b " + "a " * 70), (3, "a b " * 90), (4, "x a b " + "a b " * 40), (5, "a " * 30), (6, "a " * 200)]
    assert run(spark, rows, 50) == brute_force(rows, 50)


def test_kept_text(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {shared}\n two"), (2, f"three  {shared} four"), (3, "five\tsix")], "doc_id bigint, text string")
    kept = {r.doc_id: r.kept for r in substrings.cut_repeats(df, with_text=True).collect()}
    assert kept == {1: None, 2: "three four", 3: None}


@pytest.mark.parametrize("seed,window,vocabulary", [(2, 10, 3), (4, 20, 2), (5, 50, 5), (6, 12, 400)])
def test_a_pick_depends_on_the_window_alone(seed, window, vocabulary):
    picked = {}
    for _, text in corpus(seed, 150, vocabulary):
        words = WORD.findall(text or "")
        if len(words) < window:
            continue
        (names,) = word_names(text.encode())
        _, start, count, symbol = substrings.window_picks(names, np.array([0]), np.array([len(names)]), window)
        for at, name in enumerate(np.repeat(symbol, count)):
            assert picked.setdefault(tuple(words[at:at + window]), name) == name


def test_equal_windows_pick_equal_symbols():
    draw = random.Random(5)
    passage = [f"p{draw.randrange(500)}" for _ in range(80)]
    texts = [[f"q{draw.randrange(500)}" for _ in range(n)] + passage + [f"r{draw.randrange(500)}" for _ in range(40)]
             for n in (0, 1, 17, 60)]
    picks = []
    for text in texts:
        (names,) = word_names(" ".join(text).encode())
        _, start, count, symbol = substrings.window_picks(names, np.array([0]), np.array([len(names)]))
        each = np.repeat(symbol, count)
        assert len(each) == len(text) - 49 and start[0] == 0
        at = text.index(passage[0], len(text) - 120)
        picks.append(each[at:at + 31].tolist())
    assert all(p == picks[0] for p in picks)
