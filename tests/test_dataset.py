"""Grouping, splits, labels, cohorts and quotas on small fixtures."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from fieldwarden.operators import cohorts, dataset
from fieldwarden.operators import scale


def components(pairs):
    """Smallest id of every document's group, by plain union of sets."""
    groups = {}
    for doc, page in pairs:
        groups.setdefault(doc, {doc})
    by_page = {}
    for doc, page in pairs:
        if page is not None:
            by_page.setdefault(page, set()).add(doc)
    changed = True
    label = {d: d for d in groups}
    while changed:
        changed = False
        for members in by_page.values():
            least = min(label[d] for d in members)
            for d in members:
                if label[d] != least:
                    label[d], changed = least, True
    return label


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicate_groups_match_a_plain_closure(spark, seed, monkeypatch):
    rng = random.Random(seed)
    pairs = [(f"d{i:03d}", f"p{rng.randrange(150)}") for i in range(120) for _ in range(rng.randrange(1, 3))]
    pairs += [(f"d{i:03d}", "blank") for i in range(0, 120, 3)] + [(f"c{i:02d}", f"q{i + k}") for i in range(40) for k in (0, 1)] + [("lone", None)]
    pages = spark.createDataFrame(pairs, "document_id string, page_hash string")
    if seed == 2:  # the path for hot pages
        attach = scale.attach
        monkeypatch.setattr(dataset, "attach", lambda *a, **k: attach(*a, **{**k, "heavy_parts": 8}))
    got = {r.document_id: r.group_id for r in dataset.duplicate_groups(pages).collect()}
    assert got == components(pairs)


def test_split_proportions_and_reserve(spark):
    groups = spark.range(5000).select(F.concat(F.lit("g"), "id").alias("g"))
    counts = {r[0]: r[1] for r in groups.groupBy(dataset.split_of(F.col("g"))).count().collect()}
    assert abs(counts["train"] / 5000 - .8) < .03 and abs(counts["test"] / 5000 - .06) < .02
    documents = spark.range(300).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("g"), (F.col("id") % 100)).alias("group_id"),
                                        F.lit("f").alias("form"), F.lit("train").alias("split"))
    parts = [{r.group_id for r in dataset.selected(documents, p, 30).collect()} for p in ("train", "train_reserve")]
    assert not parts[0] & parts[1] and len(parts[0] | parts[1]) == 100 and 15 < len(parts[1]) < 45


def test_interleaving_takes_forms_in_turn(spark):
    docs = spark.createDataFrame([(f"{f}{i}", f) for f, n in (("a", 6), ("b", 2), ("c", 1)) for i in range(n)], "document_id string, form string")
    order = [r.form for r in dataset.run_order(docs, balanced=True).orderBy("run_position").collect()]
    assert sorted(order[:3]) == ["a", "b", "c"] and sorted(order[3:5]) == ["a", "b"] and order[5:] == ["a"] * 4
    plain = [r.document_id for r in dataset.run_order(docs).orderBy("run_position").collect()]
    assert sorted(plain) != plain and len(set(plain)) == 9
    firsts = [r.document_id for r in dataset.run_order(docs, balanced=True).orderBy("run_position").collect() if r.document_id[0] == "a"]
    assert firsts == [d for d in plain if d[0] == "a"]


def test_rejects_are_reported_and_the_run_continues(spark):
    rows = [("a", json.dumps({"x": "1"}), None, True), ("b", json.dumps({"x": "1"}), '["/x"]', True), ("c", "{broken", None, True),
            ("d", json.dumps({"x": "1"}), None, False), ("e", json.dumps({"x": "1", "y": "2"}), '{"no": "list"}', True)]
    df = spark.createDataFrame(rows, "document_id string, label string, unprinted string, pages_found boolean").withColumn(
        "description", F.lit(None).cast("string"))
    got = {r.document_id: (r.reason, None if r.fields is None else len(r.fields)) for r in dataset.labelled(df).collect()}
    assert got == {"a": (None, 1), "b": ("No usable fields", 0), "c": ("Malformed label", None), "d": ("Missing image", 1), "e": (None, 2)}


def test_cohorts_are_disjoint_and_risk_follows_its_source(spark):
    docs = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("document_id"), F.concat(F.lit("g"), "id").alias("group_id"),
                                    F.concat(F.lit("f"), F.col("id") % 4).alias("form"), dataset.split_of(F.concat(F.lit("g"), "id")).alias("split"))
    excluded = docs.filter("split = 'dev'").limit(5).select("document_id")
    used = {r[0] for r in excluded.collect()}
    excluded = spark.createDataFrame([(u,) for u in used], "document_id string")
    sizes = cohorts.CohortSizes(7, train_per_form=5, per_form=3, calibration_per_form=2, risk_per_form=4, risk_split="calibration", exclude_forms=("f3",))
    plan = cohorts.plan_cohorts(docs, sizes, excluded)
    counts = {r.cohort: r["count"] for r in plan.groupBy("cohort").count().collect()}
    assert counts == {"train": 15, "dev": 9, "calibration": 6, "risk_validation": 12, "audit": 9}
    assert cohorts.cohort_overlaps(plan).count() == 0 and cohorts.cohort_leaks(plan, excluded).count() == 0
    assert {r[0] for r in plan.select("form").distinct().collect()} == {"f0", "f1", "f2"}
    assert plan.exceptAll(cohorts.plan_cohorts(docs.repartition(3), sizes, excluded)).count() == 0
    shared = plan.unionByName(plan.filter("cohort = 'dev'").withColumn("cohort", F.lit("audit")))
    assert [tuple(r) for r in cohorts.cohort_overlaps(shared).collect()] == [("audit", "dev", 9)]
    with pytest.raises(ValueError):
        cohorts.sizes_from({"seed": 1, "train_per_form": 1, "typo": 2})


def test_quota_split_puts_preferred_groups_first(spark):
    groups = spark.createDataFrame([("x", f"g{i}", i in (3, 7)) for i in range(40)] + [("y", "h1", False)], "dataset string, group_id string, preferred boolean")
    got = dataset.quota_split(groups, test_cap=5, dev_cap=3).collect()
    by = {}
    for r in got:
        by.setdefault((r.dataset, r.split), set()).add(r.group_id)
    assert {k: len(v) for k, v in by.items()} == {("x", "test"): 5, ("x", "dev"): 3, ("x", "train"): 32, ("y", "train"): 1}
    assert {"g3", "g7"} <= by[("x", "test")]


def test_chat_labels(spark):
    prompt = 'Read:\n- "a": Field A\n- "b" (object)\n  - "c" (true/false): Is C\n'
    rows = [("x", prompt, '{"a": null, "b": {"c": true, "n": 12}}'), ("y", "prose", '["no object"]'), ("z", "prose", '{"k": "v"}')]
    df = spark.createDataFrame(rows, "document_id string, prompt string, answer string")
    got = {r.document_id: r for r in dataset.chat_fields(df).collect()}
    assert [tuple(f) for f in got["x"].fields] == [("/a", "Field A", '""', "scalar"), ("/b/c", "(true/false) Is C", "true", "scalar"), ("/b/n", "/b/n", '"12"', "scalar")]
    assert got["y"].reason and got["z"].fields[0].description == "/k"
    names = spark.createDataFrame([("l/a__v1.json", True), ("a__v2.json", False), ("plain.json", True)], "n string, k boolean")
    assert all(r[0] == r[1] for r in names.select(dataset.variant_kept(F.col("n")), "k").collect())
