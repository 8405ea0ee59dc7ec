"""Names of words and runs: equal where the words are, different elsewhere."""

from __future__ import annotations

import random

import numpy as np

from fieldwarden.llm.words import _PRIME, powers, run_hashes, span_names, word_names, word_spans

P = int(_PRIME)


def thue_morse(letters, doublings):
    out, other = letters[0], letters[1]
    for _ in range(doublings):
        out, other = out + other, other + out
    return out, other


def test_powers_are_those_of_python():
    assert powers(0x0851F42D4C957F2D, 300).tolist() == [pow(0x0851F42D4C957F2D, i, P) for i in range(300)]
    assert len(powers(3, 0)) == 0


def test_runs_are_equal_wherever_they_stand():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 2**64, 4, np.uint64)[draw.integers(0, 4, 400)]
    starts = np.repeat(np.arange(390), 3)
    ends = starts + np.tile([1, 3, 10], 390)
    named = run_hashes(values, starts, ends)
    seen = {}
    for a, b, h in zip(starts, ends, named):
        assert seen.setdefault(tuple(values[a:b]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_thue_morse_runs_and_words_differ():
    a, b = thue_morse("ab", 12)
    for seed in (1, 2):
        one, two = word_names(f"{a} {b}".encode(), (seed,))[0]
        assert one != two
    first, second = thue_morse(([3], [7]), 12)
    values = np.array(first + second, np.uint64)
    n = len(first)
    one, two = run_hashes(values, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two


def test_names_of_words_of_all_lengths():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdé日", k=k)) for k in [*range(1, 60), 200, 255, 256, 257, 400, 3000] for _ in range(3)]
    data, starts, ends = word_spans(" ".join(words + words[::-1]).encode())
    for seed in (1, 2):
        names = span_names(data, starts, ends, seed)
        assert names[:len(words)].tolist() == names[len(words):][::-1].tolist()
        assert len(set(names.tolist())) == len(set(words))
    assert not set(span_names(data, starts, ends, 1).tolist()) & set(span_names(data, starts, ends, 2).tolist())
