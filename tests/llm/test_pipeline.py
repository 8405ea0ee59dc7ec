"""Stages of the pipeline on small tables, each against a plain search."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from test_jaccard import brute_force as classes
from test_substrings import brute_force as passages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, toxic string, stratum string, kept int, n_words string, identity double"


def rows(count=60):
    draw = random.Random(2)
    passage = " ".join(f"p{draw.randrange(900)}" for _ in range(70))
    out = []
    for d in range(count):
        words = [f"w{draw.randrange(900)}" for _ in range(draw.randint(12, 90))]
        if d % 5 == 0:
            words.insert(draw.randrange(len(words)), passage)
        if d % 6 == 0:
            words += ["nasty", "vile"]
        out.append((d, " ".join(words)))
    copy = out[7][1].split(" ")
    copy[3] = "changed"
    out += [(count, out[7][1]), (count + 1, " ".join(copy)), (count + 2, None), (count + 3, ""), (count + 4, "few words"), (7, out[7][1]),
            (None, "a row without an id has enough words to be kept here too")]
    return out


@pytest.fixture
def tables(spark, tmp_path):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "t", "u", 1, "v", 2.5) for d, t in rows()], SCHEMA)
    labels = [(d, int(not (t or "").startswith("few")), int("nasty" in (t or ""))) for d, t in rows() if d is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return df, str(tmp_path)


def test_every_stage(spark, tables):
    docs, folder = tables
    stage = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "quality_rules", "near_copies", "substring_dedup"):
        # Columns of the input keep their names, types and values, whatever an operator calls its own.
        out = stage[name](spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert {(r.lang, r.source, r.toxic, r.stratum, r.kept, r.n_words, r.identity) for r in out.collect()} == {
            ("en", "s", "t", "u", 1, "v", 2.5)}, name
    kept = stage["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns
    found = {(r.doc_id, r.text) for r in kept.collect()}
    assert found == {(d, t) for d, t in rows() if "nasty" not in (t or "")}

    good = stage["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns
    assert {(r.doc_id, r.text) for r in good.collect()} == {(d, t) for d, t in rows() if len((t or "").split()) >= 10}

    single = stage["near_copies"](spark, docs, folder)
    want = [c[0] for c in classes(list({d: t for d, t in rows() if d is not None}.items()), 5, 80) if c[0] == c[2]]
    assert sorted(r.doc_id for r in single.collect() if r.doc_id is not None) == want
    assert single.columns == docs.columns and single.filter("doc_id is null").count() == 1

    cut = {(r.doc_id, r.text, r.n_chars) for r in stage["substring_dedup"](spark, docs, folder).collect()}
    removed = {(d, k) for d, _, k, _ in passages(rows(), 50)}
    assert len(cut) == len({r for r in rows()})
    for d, t, n in cut:
        before = next(x for i, x in rows() if i == d)
        gone = next(k for i, k in removed if i == d)
        assert (t == before) == (gone == 0) and n == len(t or "") and len((t or "").split()) == len((before or "").split()) - gone

    packed = stage["packing"](spark, docs, folder).collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and {r.doc_id for r in packed} == {d for d, _ in rows()}


def test_empty_tables(spark, tables):
    docs, folder = tables
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name
