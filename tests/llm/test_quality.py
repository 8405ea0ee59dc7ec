"""Quality rules: counts against plain Python, bounds against exact sums, false rejections of certified cutoffs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldwarden.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)),
            len(covered))


def test_counts(spark):
    draw = random.Random(1)
    texts = [None, "", "  \n\t", "a", "é #*", "a b c d e a b c d e", "a " * 40, "\x0b\x0c\x1c\x85 x", "l\nl\n\nl \nl", "x" * 100_000]
    texts += ["".join(draw.choices(["a ", "b ", "c\n", "#", "\t", "日 ", "\n"], k=draw.randint(0, 80))) for _ in range(150)]
    texts.append(" ".join(f"w{draw.randrange(40)}" for _ in range(20_000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = df.select("doc_id", quality.text_counts(F.col("text")).alias("c")).orderBy("doc_id").select("c.*").collect()
    for text, row in zip(texts, got):
        assert tuple(row[c] for c in quality.COUNTS) == counts(text), repr(text)[:200]


@pytest.mark.parametrize("p", [0.01, 0.2])
def test_binomial_tail(spark, p):
    cases = [(0, 1), (0, 300), (2, 300), (9, 1000), (40, 5000), (50, 5000), (150, 900), (0, 0), (3, 2)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), p))
    for k, n, t in df.collect():
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k < n * p else 1.0
        assert t == pytest.approx(exact, rel=1e-9)


def corpus(seed, n, symbols):
    """Labelled counts: bad documents have symbols, good ones have some with probability ``symbols``."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        good = int(draw.random() < 0.8)
        has = draw.random() < (symbols if good else 0.9)
        rows.append(("en" if i % 3 else "", f"{draw.randrange(2**32):08x}{i}", good, 100, 500, 60 if has else 0, 4, 0, 0))
    return rows


SCHEMA = ("stratum string, identity string, good int, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, "
          "n_dup_lines bigint, n_repeat_words bigint")


def test_cutoffs_are_certified(spark):
    clean = quality.certified_cutoffs(spark.createDataFrame(corpus(1, 6000, 0.0), SCHEMA)).first()["cutoffs"]
    assert set(clean) == {"en", ""} and all(c["symbols"] is not None and c["symbols"] <= 0.6 for c in clean.values())
    assert all(c["long_words"] is None and c["dup_lines"] is None for c in clean.values())
    # Too many good documents have symbols, or there are too few labels to say that they have not.
    risky = quality.certified_cutoffs(spark.createDataFrame(corpus(2, 6000, 0.05), SCHEMA)).first()["cutoffs"]
    few = quality.certified_cutoffs(spark.createDataFrame(corpus(3, 200, 0.0), SCHEMA)).first()["cutoffs"]
    none = quality.certified_cutoffs(spark.createDataFrame([], SCHEMA)).first()["cutoffs"]
    assert risky == {} and few == {} and none == {}


def test_every_stratum_is_certified(spark):
    # More strata than the 64 with cutoffs of their own before; bad documents have symbols, good ones have not.
    number = 70
    text = F.md5(F.col("id").cast("string"))
    labelled = spark.range(2000 * number).select(
        F.concat(F.lit("s"), F.col("id") % number).alias("stratum"), text.alias("identity"),
        (F.floor(F.col("id") / number) % 5 > 0).cast("int").alias("good")).selectExpr(
        "*", "100L AS n_words", "500L AS word_chars", "IF(good = 0, 60L, 0L) AS n_symbols", "4L AS n_lines", "0L AS n_dup_lines",
        "0L AS n_repeat_words")
    want = {f"s{i}" for i in range(number)}
    cutoffs = quality.certified_cutoffs(labelled).first()["cutoffs"]
    assert set(cutoffs) == want and all(c["symbols"] <= 0.6 for c in cutoffs.values())
    poor = spark.createDataFrame([(s,) for s in [*sorted(want), "unknown"]], "stratum string").selectExpr(
        "*", "100L AS n_words", "500L AS word_chars", "60L AS n_symbols", "4L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words")
    for found in (quality.certified_cutoffs(labelled), quality.cutoff_table(labelled)):
        assert {r.stratum for r in quality.judged(poor, found).collect() if r.kept} == {"unknown"}


def test_verdict(spark):
    texts = [(1, "en", "good word " * 3 + "and nine other quite different words stand in here"), (1, None, None), (None, "en", "%%% " * 40),
             (2, "en", " ".join(f"w{i}%" for i in range(60)))]
    docs = spark.createDataFrame([(*t, 7) for t in texts], "doc_id bigint, lang string, text string, n_words int")
    cutoffs = quality.certified_cutoffs(spark.createDataFrame(corpus(1, 6000, 0.0), SCHEMA))
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept, r.failed) for r in quality.judged(quality.with_counts(docs), cutoffs).collect()]
    assert got == [(1, 15, False, True, []), (1, 0, True, False, ["base"]), (None, 40, True, False, ["base"]), (2, 60, False, False, ["symbols"])]
    assert quality.judged(quality.with_counts(docs.limit(0)), cutoffs).collect() == []
