"""Rollups against recounting."""

from __future__ import annotations

import random
from collections import Counter

from fieldwarden.llm import rollups
from fieldwarden.llm.rollups import TokenLedger

SCHEMA = "doc_id bigint, source string, lang string, tokenizer string, tokens bigint, deleted boolean, sign int"


def test_batches(spark, tmp_path):
    draw = random.Random(1)
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().collect() == [] and ledger.batches() == []
    state = {}
    for batch in range(1, 5):
        rows = []
        for d in draw.sample(range(40), 25):
            rows.append((d, draw.choice(["s", "t", None]), draw.choice(["en", None]), f"v{draw.randint(1, 2)}",
                         draw.choice([None, 0, 5, 7]), draw.choice([False, False, True, None]), 9))
        rows.append((None, "s", "en", "v1", 5, False, 9))
        changes = spark.createDataFrame(rows, SCHEMA)
        assert ledger.commit(batch, changes)
        assert not ledger.commit(batch, changes)
        for d, source, lang, version, tokens, deleted, _ in rows[:-1]:
            state.pop(d, None)
            if not deleted:
                state[d] = (source, lang, version, tokens or 0)
        documents, tokens = Counter(), Counter()
        for *key, n in state.values():
            documents[tuple(key)] += 1
            tokens[tuple(key)] += n
        want = sorted(((*k, documents[k], tokens[k]) for k in documents), key=str)
        if batch == 2:
            ledger.compact()
        assert sorted(map(tuple, ledger.counted().collect()), key=str) == sorted(((d, *v) for d, v in state.items()), key=str)
        assert sorted(map(tuple, ledger.totals().collect()), key=str) == want


def test_repeated_documents_and_broken_batch(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    rows = [(1, "s", "en", "v1", 3, False, 0), (1, "s", "en", "v1", 3, False, 0), (2, "s", "en", "v1", 3, False, 0),
            (2, "s", "en", "v1", 3, True, 0)]
    ledger.commit(1, spark.createDataFrame(rows, SCHEMA))
    assert list(map(tuple, ledger.totals().collect())) == [("s", "en", "v1", 1, 3)]
    # A batch that broke off has entries but no finished sums: it counts for nothing and is written anew.
    spark.createDataFrame([(1, "s", "en", "v1", 3, -1)], rollups._ENTRY).write.parquet(f"file://{tmp_path}/ledger/entries/batch=2")
    assert ledger.batches() == [1]
    ledger.commit(2, spark.createDataFrame([(1, "s", "en", "v2", 4, False, 0)], SCHEMA))
    assert list(map(tuple, ledger.totals().collect())) == [("s", "en", "v2", 1, 4)]


def test_counts(spark):
    df = spark.createDataFrame([(1, "s", "en", "a", "x y"), (2, None, None, "b", None)],
                               "doc_id bigint, source string, lang string, tokenizer string, text string")
    counters = {"a": lambda: (lambda t: len(t.split())), "b": lambda: len}
    got = sorted(map(tuple, rollups.token_counts(df, counters).collect()))
    assert got == [(1, "s", "en", "a", 2), (2, None, None, "b", 0)]


def test_the_commits_of_the_query_against_recounting(spark):
    import public_tokenizers
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, rollups.op6_token_counts(spark, folder).collect()), key=str)
    one, other = (rollups.rank_file_counter(public_tokenizers.path(f"{n}.tiktoken"))() for n in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    poor = {r["doc_id"] for r in labels if r["quality"] == 0}
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1 and r["quality"] == 1}
    documents, tokens = Counter(), Counter()
    for r in pq.read_table(f"{folder}/documents.parquet").to_pylist():
        if r["doc_id"] not in poor or r["doc_id"] in toxic:
            name, count = ("byte_bpe_multi_50k", other) if r["doc_id"] in toxic else ("byte_bpe_50k", one)
            key = (r["source"], r["lang"], name)
            documents[key] += 1
            tokens[key] += count(r["text"] or "")
    assert toxic and got == sorted(((*k, documents[k], tokens[k]) for k in documents), key=str)
