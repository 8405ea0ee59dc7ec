"""Near duplicates against all pairs, and the tree and the components against plain searches."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fieldwarden.llm import jaccard
from fieldwarden.llm.components import connected_components
from fieldwarden.llm.jaccard import Similarity, Tree
from fieldwarden.llm.words import window_hashes, word_names

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def closure(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def brute_force(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        n = max(len(w) - words + 1, 1) if w else 0
        sets[d] = {tuple(w[i:i + words]) for i in range(n)}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = closure(ids, links)
    return sorted((d, len(sets[d]), least[d]) for d in ids)


def corpus(seed, families, copies, edits, length=60):
    draw = random.Random(seed)
    rows, passage = [], [f"w{draw.randrange(3000)}" for _ in range(25)]
    for _ in range(families):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.randint(1, length))] + draw.choice([[], passage])
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(len(text))] = f"e{draw.randrange(3000)}"
            rows.append((len(rows), draw.choice([" ", "\n"]).join(text)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, None), (len(rows) + 2, "  "), (len(rows) + 3, "one"),
             (len(rows) + 4, "One two"), (len(rows) + 5, "one TWO"), (len(rows) + 6, "a " * 500), (len(rows) + 7, "a " * 300)]
    return rows


def run(spark, rows, similarity):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, `set` int")
    return sorted(map(tuple, jaccard.near_duplicates(df, similarity).collect()))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_classes_of_all_pairs(spark, words, percent):
    rows = corpus(words, 25, 6, 3, 120)
    assert run(spark, rows, Similarity(words, percent)) == brute_force(rows, words, percent)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rows = corpus(9, 4, 60, 8, 150)
    assert run(spark, rows, Similarity(3, 80)) == brute_force(rows, 3, 80)


def test_repeated_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "x y z"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(map(tuple, jaccard.near_duplicates(df, Similarity(3, 90)).collect()), key=str)
    assert found == sorted([(1, 4, 1), (1, 4, 1), (1, 1, 1), (None, 4, 1), (2, 4, 1), (None, 0, None)], key=str)
    assert jaccard.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_tree_joins_what_all_pairs_join(seed):
    draw = np.random.default_rng(seed)
    base = [draw.integers(0, 2**63, draw.integers(20, 60)).astype(np.uint64) for _ in range(8)]
    sets = []
    for _ in range(150):
        s = base[draw.integers(8)].copy()
        s[draw.random(len(s)) < draw.random() * 0.2] = draw.integers(0, 2**63)
        sets.append(np.unique(s))
    sets.sort(key=len)
    similarity = Similarity(1, 85)
    pairs = [(i, j) for i in range(150) for j in range(i + 1, 150)
             if similarity.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    tree = Tree(sets, list(range(150)))
    assert set(tree.links(similarity)) <= set(pairs)
    want = closure(range(150), pairs)
    assert all((tree.root(i) == tree.root(j)) == (want[i] == want[j]) for i in range(150) for j in range(150))


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_links_exactly_at_the_threshold(percent):
    draw = np.random.default_rng(percent)
    ties = [(percent * n // 100, n) for n in range(1, 400) if percent * n % 100 == 0]
    for small, large in ties:
        whole = np.unique(draw.integers(0, 2**63, large).astype(np.uint64))
        sets = [np.sort(draw.permutation(whole)[:small]), whole]
        assert Tree(sets, [0, 1]).links(Similarity(3, percent)) == [(0, 1)], (small, large)
        # The same pair below inner nodes, whose other sets are too small or too large to be linked with anything.
        far = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64)) for n in [1] * 20 + [1000] * 20]
        tree = Tree(far[:20] + sets + far[20:], list(range(42)))
        assert tree.root(20) != tree.root(21) and (20, 21) in tree.links(Similarity(3, percent)), (small, large)


def test_ties_are_linked_in_the_join(spark):
    # Nine and ten, eighteen and twenty ... distinct shingles of one word with all of the smaller set in common.
    rows = []
    for n in (10, 20, 30, 40, 60, 70, 80, 120):
        words = [f"w{n}x{i}" for i in range(n)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(words[:n * 9 // 10]))]
    got = run(spark, rows, Similarity(1, 90))
    assert got == brute_force(rows, 1, 90)
    assert all(component == doc_id // 2 * 2 for doc_id, _, component in got)


def test_miss_probability():
    for percent in (80, 90):
        s = Similarity(5, percent)
        assert (1 - (percent / 100) ** s.rows) ** jaccard.BANDS < jaccard.MISS


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7), (3, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = closure({n for e in edges for n in e if n is not None}, [e for e in edges if e[1] is not None])
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert all(want[n] == c for n, c in got.items())
    assert {n for e in edges if e[1] is not None and e[0] != e[1] for n in e} == set(got)
    assert connected_components(df.limit(0)).collect() == []


def test_names_of_texts_side_by_side_are_those_of_each_alone():
    similarity = jaccard.Similarity(3, 90)
    texts = ["", None, "a", "b a", "x y z", "x y z x y z a b", "Z a b", " ".join(f"w{i % 700}" for i in range(900))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = pa.Table.from_batches(list(jaccard._set_rows(similarity)(iter([batch])))).to_pylist()
    factors, shifts = jaccard.minimum_hashes(similarity.rows)
    for line, text in zip(got, texts, strict=True):
        (names,) = word_names((text or "").encode().lower())
        # Windows that reach into the next text are no shingles.
        found = np.unique(window_hashes(names, min(3, len(names)))) if len(names) else names
        assert line["n_shingles"] == len(found) and (line["set"] is None) == (not len(found))
        if not len(found):
            assert line["bands"] is None
            continue
        # The whole set at once instead of tile by tile.
        least = (((found >> np.uint64(32)).astype(np.uint32)[:, None] ^ shifts) * factors).min(axis=0)
        assert line["set"] == jaccard.set_name(found)
        assert line["bands"] == jaccard.band_names(least[None], similarity.rows)[0].view(np.int64).tolist()
    assert len({tuple(line["bands"]) for line in got if line["bands"]}) == 6
