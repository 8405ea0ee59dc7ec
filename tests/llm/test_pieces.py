"""N-best segmentation against all segmentations, and decoding."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldwarden.llm import pieces
from fieldwarden.llm.pieces import SPACE, PieceModel


def small(names):
    model = PieceModel.__new__(PieceModel)
    model.bytes = list(range(256))
    model.decoded = [bytes([b]) for b in range(256)]
    model.ids = {}
    for k, (name, score) in enumerate(names.items()):
        model.ids[name] = (256 + k, score)
        model.decoded.append(name.replace(SPACE, " ").encode())
    model.prepare()
    return model


MODEL = {SPACE: -3.0, SPACE + "a": -1.5, SPACE + "ab": -2.25, "a": -1.0, "b": -1.125, "ab": -1.75, "bb": -2.5, "aba": -2.625,
         "c": -4.0, "é": -1.0, SPACE + SPACE: -9.0}


def every(model, text):
    """All segmentations of a text as (score, ids), without units, cuts or heuristics."""
    marked = SPACE + text.replace(SPACE, "\ud800").replace(" ", SPACE) if text else ""
    done = {len(marked): [(0.0, ())]}
    for at in range(len(marked) - 1, -1, -1):
        options = []
        for end in range(at + 1, len(marked) + 1):
            if marked[at:end] in model.ids:
                i, score = model.ids[marked[at:end]]
                options += [(score + s, (i, *ids)) for s, ids in done[end]]
        if marked[at] not in model.ids:
            raw = (SPACE if marked[at] == "\ud800" else marked[at]).encode()
            options += [(model.byte_score * len(raw) + s, (*raw, *ids)) for s, ids in done[at + 1]]
        done[at] = options
    return done[0]


@settings(max_examples=150, deadline=None)
@given(st.text("ab cé\nz" + SPACE, max_size=9), st.integers(1, 7))
def test_best_of_all_segmentations(text, n):
    model = small(MODEL)
    want = sorted(every(model, text), key=lambda s: -s[0])
    got = model.nbest(text, n)
    assert np.allclose([s for s, _ in got], [s for s, _ in want[:n]])
    assert len({tuple(ids) for _, ids in got}) == len(got)
    assert all((pytest.approx(s), tuple(ids)) in [(w, i) for w, i in want] for s, ids in got)
    assert all(model.decode(ids) == text for _, ids in got)


def test_crossing_pieces_and_long_units():
    model = small({**MODEL, "a" + SPACE + "b": -0.5})
    want = sorted(every(model, "ba ba b"), key=lambda s: -s[0])
    assert np.allclose([s for s, _ in model.nbest("ba ba b", 5)], [s for s, _ in want[:5]])
    long = "ab" * 20_000
    best = model.nbest(long, 3)
    assert model.decode(best[2][1]) == long and best[0][0] >= best[1][0] >= best[2][0]


def test_documents(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [(1, "Hello  world\nagain"), (2, None), (3, ""), (4, f"▁ {chr(0x1F600)} x\ty"), (1, "Hello  world\nagain"), (None, " a ")]
    df = spark.createDataFrame([(d, t, 0) for d, t in texts], "doc_id bigint, text string, ids int")
    rows = pieces.segmented(df, path, 3, with_ids=True).collect()
    model = PieceModel(path)
    assert len(rows) == 6 and all(r.decodes for r in rows)
    for r in rows:
        text = next(t for d, t in texts if d == r.doc_id) or ""
        assert all(model.decode(ids) == text for ids in r.ids)
        assert r.ids_crc32 == [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids in r.ids]
        assert 1 <= r.n_segmentations <= 3 and (text or r.n_pieces == 0) and r.scores == sorted(r.scores, reverse=True)
    assert pieces.segmented(df.limit(0), path).collect() == []
