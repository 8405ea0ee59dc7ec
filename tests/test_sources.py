"""Sources and sinks on small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fieldwarden.operators import dataset, features, rows
from fieldwarden.plans import bundle, workflows
from fieldwarden.operators import policy
from fieldwarden.sources import datasets, records


def test_jsonl_replace_append_and_broken_lines(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    records.write_jsonl(df, path)
    records.append_jsonl(df, path)
    assert records.read_jsonl(spark, path, df.schema).count() == 4
    records.write_jsonl(df, path)
    assert records.read_jsonl(spark, path, df.schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n{"id": \n')
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id long").collect()


def test_log_stops_at_the_first_torn_line(spark, tmp_path):
    lines = [json.dumps({"step": i, "loss": i / 10}) for i in range(1, 301)]
    (tmp_path / "log.jsonl").write_text("\n".join(lines[:200]) + '\n{"step": 201, "lo\n' + "\n".join(lines[201:]) + "\n")
    got = records.read_log(spark, str(tmp_path / "log.jsonl"), "step long, loss double")
    assert sorted(r.step for r in got.collect()) == list(range(1, 201))
    assert records.read_log(spark, str(tmp_path / "log.jsonl"), "step long, loss double", 150).count() == 150


def raw(tmp_path):
    root = tmp_path / "raw"
    for folder in ("images", "kie-labels", "schemas"):
        (root / folder).mkdir(parents=True)
    manifest = []
    for i in range(8):
        (root / "images" / f"p{i}.png").write_bytes(b"same" if i < 5 else f"page {i}".encode())
        (root / "kie-labels" / f"{i}.json").write_text(json.dumps({"fields": {"a": {"b": str(i)}, "n": ["x"]}, "unprinted": ["/n"] if i == 7 else []}))
        manifest.append({"form": "lift-x", "sample": str(i), "pages": [f"p{i}.png"] if i != 6 else ["gone.png"], "fields": f"{i}.json"})
    (root / "schemas" / "x.descriptions.json").write_text(json.dumps({"a": {"b": "The B"}, "n": ["Items"]}))
    (root / "manifest.jsonl").write_text("\n".join(map(json.dumps, manifest)))
    return root


def test_prepare_from_files(spark, tmp_path):
    root = raw(tmp_path)
    manifest, pages = datasets.raw_dataset(spark, str(root))
    documents = workflows.prepare(manifest, pages).collect()
    by = {r.document_id: r for r in documents}
    assert len(by) == 8 and by["lift-x__6"].reason == "Missing image"
    assert {by[f"lift-x__{i}"].group_id for i in range(5)} == {"lift-x__0"} and len({by[f"lift-x__{i}"].split for i in range(5)}) == 1
    assert [tuple(f) for f in by["lift-x__1"].fields] == [("/a/b", "The B", '"1"', "scalar"), ("/n", "Items", '["x"]', "array")]
    assert [f.id for f in by["lift-x__7"].fields] == ["/a/b"]
    report = workflows.write_prepared(workflows.prepare(manifest, pages), str(tmp_path / "out"))
    counts = {(r.section, r.name): r["count"] for r in report.collect()}
    assert counts[("rejected", "Missing image")] == 1 and counts[("branches", "array_branches")] == 6
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert dataset.duplicate_page_occurrences(pages.filter("page_hash is not null")).first()[0] == 4


def test_chat_dataset(spark, tmp_path):
    root = tmp_path / "cards"
    (root / "labels").mkdir(parents=True)
    entries = []
    for name in ("a__v1", "a__v2", "b"):
        (root / "labels" / f"{name}.json").write_text(json.dumps({"conversations": [
            {"role": "user", "content": '- "k": Key'}, {"role": "assistant", "content": "old"}, {"role": "assistant", "content": json.dumps({"k": name})}]}))
        entries.append({"label_path": f"/moved/{name}.json", "image_path": f"/moved/{name}.png", "split": "test" if name == "b" else "train"})
    (root / "image_label_details.json").write_text(json.dumps(entries))
    labels = datasets.chat_dataset(spark, str(root))
    assert {r.document_id for r in labels.collect()} == {"cards__a__v1", "cards__b"}
    fields = {r.document_id: r.fields for r in dataset.chat_fields(labels).collect()}
    assert tuple(fields["cards__b"][0]) == ("/k", "Key", '"b"', "scalar")
    assert datasets.chat_dataset(spark, str(root), None, "train").count() == 2


def test_exclusions_read_three_formats(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"document_id": "a"}\n{"id": "b"}\n{"step": 1}\n')
    spark.createDataFrame([("c",), ("a",)], "document_id string").write.parquet(str(tmp_path / "plan"))
    used = datasets.exclusions(spark, {str(tmp_path / "rows.jsonl"): "rows", str(tmp_path / "plan"): "plan"})
    assert sorted(r.document_id for r in used.collect()) == ["a", "a", "b", "c"]
    with pytest.raises(PySparkException):
        datasets.exclusions(spark, {str(tmp_path / "missing"): "plan"})
    with pytest.raises(ValueError):
        datasets.exclusions(spark, {"x": "csv"})


def test_digests_follow_content(spark, tmp_path):
    folder = tmp_path / "b"
    folder.mkdir()
    (folder / "one.bin").write_bytes(b"1")
    (folder / "two.bin").write_bytes(b"2")
    first = records.files_digest(spark, str(folder)).first()
    hashes = {r.name: r.page_hash for r in records.file_hashes(spark, str(folder)).collect()}
    assert hashes["one.bin"] == hashlib.sha256(b"1").hexdigest() and first.files == 2
    (folder / "two.bin").write_bytes(b"3")
    assert records.files_digest(spark, str(folder)).first().digest != first.digest


def test_plans_are_never_replaced(spark, tmp_path):
    df = spark.range(1)
    records.claim_new(df, str(tmp_path / "p"))
    with pytest.raises(PySparkException):
        records.claim_new(df, str(tmp_path / "p"))
    stored = spark.createDataFrame([("seed", "1"), ("model", "m")], "key string, value string")
    rows.claim(stored, stored, True)
    with pytest.raises(ValueError, match="seed"):
        rows.claim(stored, stored.withColumn("value", F.when(F.col("key") == "seed", "2").otherwise(F.col("value"))), True)
    with pytest.raises(ValueError):
        rows.claim(None, stored, True)


def test_bundles_and_traces(spark, tmp_path):
    base = spark.createDataFrame([("d", "/x", "ok")], "document_id string, field_id string, status string")
    saved = bundle.Bundle({"temperature": 2.0, "bias": .5, "method": "affine"}, policy.fixed_policy(base, .7), policy.supported_fields(base), None, "abc")
    bundle.save(saved, str(tmp_path / "bundle"))
    loaded = bundle.load(spark, str(tmp_path / "bundle"))
    assert loaded.calibration == {"temperature": 2.0, "bias": .5, "method": "affine"} and loaded.policy.first().threshold == .7
    loaded.check_source("abc")
    with pytest.raises(ValueError):
        loaded.check_source("other")
    mark = bundle.fingerprint(spark, str(tmp_path / "bundle"))
    assert mark == bundle.fingerprint(spark, str(tmp_path / "bundle"))
    with pytest.raises(PySparkException):
        bundle.save(saved, str(tmp_path / "bundle"))
    old = datasets.from_old_layout(spark.createDataFrame([(0, 1.0)], "feature_index int, end double"))
    assert old.columns == ["trace_index", "value"]
    parts = spark.createDataFrame([(0, 0), (0, -1), (0, 1), (2, 0), (1, 0)], "part int, trace_index long")
    merged = sorted(r.trace_index for r in features.merged_parts(parts).collect())
    assert merged == [-1, 0, 1, 2, 3]
    assert tuple(features.trace_index_problems(parts.withColumn("split", F.lit("s")), "s").first()) == (0, 2, 0)


def test_validated_traces(spark, tmp_path):
    from fieldwarden.sources import datasets

    def cache(name, indices, owners=None):
        rows = [("dev", i, o) for i, o in zip(indices, owners or ["dev"] * len(indices))]
        df = spark.createDataFrame([*rows, ("train", 0, "train")], "split string, trace_index long, row_split string")
        datasets.write_traces(df, df.select("split", "trace_index"), spark.createDataFrame([("dev", "k", "v")], "cohort string, key string, value string"),
                              str(tmp_path / name))
        return datasets.validated_traces(spark, str(tmp_path / name), "dev")

    assert sorted(r.trace_index for r in cache("sound", [2, 0, 1, -1, -1]).collect()) == [-1, -1, 0, 1, 2]
    assert cache("none", [-1]).count() == 1
    with pytest.raises(ValueError, match="gaps"):
        cache("gap", [0, 1, 3])
    with pytest.raises(ValueError, match="repeated"):
        cache("twice", [0, 2, 2, 3, 4, 5, 6])
    with pytest.raises(ValueError, match="another split"):
        cache("foreign", [0, 1], ["dev", "train"])


def test_import_of_several_datasets(spark, tmp_path):
    from fieldwarden.plans.workflows import import_datasets
    from fieldwarden.sources.records import read_jsonl

    rows = [("a", "a1", ["p1", "used"], ["f"]), ("a", "a2", ["p2"], ["f", "g"]), ("a", "a3", ["p3"], []), ("b", "b1", ["used"], ["f"]), ("c", "c1", [], ["f"])]
    df = spark.createDataFrame(rows, "dataset string, document_id string, image_sha256 array<string>, fields array<string>")
    used = spark.createDataFrame([("used",), ("used",), ("other",)], "page_hash string")
    got = {r.dataset: tuple(r)[1:] for r in import_datasets(df, used, str(tmp_path / "all")).collect()}
    assert got == {"a": (2, 2, 1), "b": (0, 0, 1), "c": (1, 1, 0)}
    assert sorted(r.document_id for r in read_jsonl(spark, str(tmp_path / "all"), df.schema).collect()) == ["a2", "a3", "c1"]
    one = {r.dataset: r.documents for r in import_datasets(df, used, str(tmp_path / "one"), 1).collect()}
    assert one == {"a": 1, "b": 0, "c": 1}
    again = import_datasets(df, used, str(tmp_path / "again"), 1)
    first, second = (sorted(r.document_id for r in read_jsonl(spark, str(tmp_path / n), df.schema).collect()) for n in ("one", "again"))
    assert again.count() == 3 and first == second
    assert import_datasets(df.limit(0), used, str(tmp_path / "none")).collect() == []


def test_split_of_several_datasets(spark, tmp_path):
    from fieldwarden.plans.workflows import split_datasets

    rows = [("a", f"a{i:02d}__v1", [f"p{i}"], ["p"], ["f", "g"]) for i in range(30)]
    # A page of another dataset's document joins the group of the least id; a second variant, a long document, one without pages.
    rows += [("b", "b1__v1", ["p3", "q1"], ["p", "p"], ["f"]), ("b", "b2__v2", ["q2"], ["p"], ["f"]), ("b", "b3__v1", ["q3"], ["p"] * 9, ["f"]),
             ("b", "b4__v1", [], [], ["f"]), ("b", "b5__v1", ["q5"], ["p"], ["f"])]
    df = spark.createDataFrame(rows, "dataset string, document_id string, image_sha256 array<string>, pages array<string>, fields array<string>")
    wanted = spark.createDataFrame([("a07__v1",), ("b5__v1",)], "document_id string")
    report = {r.dataset: r for r in split_datasets(df, wanted, str(tmp_path / "s"), test_cap=8).collect()}
    assert report["a"].groups == 30 and report["b"].groups == 4 and report["a"].test_preferred == 1 == report["b"].test_preferred
    assert report["a"].train_test_shared_pages == 0
    stored = spark.read.parquet(str(tmp_path / "s"))
    split = {r.document_id: r.split for r in stored.collect()}
    assert split["a07__v1"] == "test" == split["b5__v1"]
    # The copy of a page follows its group, with that group's dataset.
    follower = stored.filter("document_id = 'b1__v1'").first()
    assert (follower.dataset, follower.split) == ("a", split["a03__v1"])
    assert split.get("b2__v2", "train") == "train" and split.get("b3__v1") != "train"
    per = {d: sum(v == s for k, v in split.items() if k.startswith("a")) for d, s in (("test", "test"), ("dev", "dev"))}
    assert per == {"test": 8, "dev": 2}
    fields = sum(r.train_fields + r.dev_fields + r.test_fields for r in report.values())
    assert fields == stored.select(F.sum(F.size("fields"))).first()[0]


def test_exploded_rows_are_never_broadcast(spark):
    # Range and literals have known sizes far below the broadcast limit; their exploded rows have the same to the planner.
    own = spark.range(6).selectExpr("concat('d', id) AS document_id", "explode(array('/a', '/b')) AS field_id", "'\"x\"' AS prediction", "true AS correct")
    drawn = own.selectExpr("document_id", "field_id", "explode(array('ok', 'ok', 'truncated')) AS status", "'\" x \"' AS value")
    found = rows.agreement_features(drawn, own)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.agreement, r.distinct_share) for r in found.collect()} == {(2 / 3, 2 / 3)} and found.count() == 12


def test_agreement_of_samples_in_the_row(spark):
    sampled = spark.createDataFrame([(1, "x", ["ok:x", "ok:x", "ok:y", "cut:x"]), (2, "x", ["cut:a", "cut:b"]), (3, "x", []), (4, "<cut>", ["ok:<cut>", "cut:"])],
                                    "id int, own string, samples array<string>")
    key = F.transform("samples", lambda s: rows.candidate_key(F.split_part(s, F.lit(":"), F.lit(1)), F.split_part(s, F.lit(":"), F.lit(2))))
    found = {r.id: (r.agreement, r.distinct_share) for r in sampled.select(
        "id", *rows.agreement(rows.candidate_key(F.lit("ok"), F.col("own")), key)).collect()}
    # Every status but ok is one value, and not the text that is spelled like it.
    assert found == {1: (.5, .75), 2: (0, .5), 3: (None, None), 4: (.5, 1)}


@pytest.mark.parametrize("name", ["agreement_features", "agreement_distribution"])
def test_samples_of_a_row_are_not_shuffled(spark, name):
    from fieldwarden import catalog

    catalog.load()
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "hashpartitioning(" not in plan


def test_summaries_bind_what_they_share(spark):
    stats = ", ".join(f"cast(sin(i * {k} + id) as double) AS {n}" for k, n in enumerate(
        ("log_probability", "normalized_entropy", "probability_margin", "logit_margin", "close_log_probability"), 2))
    records = spark.range(5).selectExpr("id", "transform(sequence(1, 9), i -> named_struct(" + ", ".join(
        f"'{p.split(' AS ')[1]}', {p.split(' AS ')[0]}" for p in stats.split(", ")) + ")) AS stats", "array('a', ' ', 'b') AS pieces",
        "'scalar' AS kind", "array('a1b2', '٣x1', '²', 'x', '')[id] AS text").selectExpr("*", "stats[0] AS close")
    found = features.summaries(records, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") + plan.count("array_sort(") == 1
    rows_ = {r.id: r for r in found.collect()}
    x = [t.log_probability for t in records.filter("id = 3").first().stats]
    assert abs(rows_[3].std_log_probability - (sum((a - sum(x) / 9) ** 2 for a in x) / 9) ** .5) < 1e-12
    assert [rows_[i].digit_share for i in range(5)] == [.5, pytest.approx(2 / 3), 1.0, 0.0, 0.0]
