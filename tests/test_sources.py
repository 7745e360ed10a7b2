"""Sources, sinks, staged runs, audits and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, models
from tessera.plans import stages
from tessera.sources import files
from tessera.streaming import windows

SF = "/root/testdata/sf0.001"


def test_markdown_front_matter(spark, tmp_path):
    (tmp_path / "a b.md").write_text("---\ntitle: X\n---\n# H\ntext")
    (tmp_path / "c.md").write_text("---\nnothing known\n---\nbody")
    (tmp_path / "d.txt").write_text("no")
    rows = {r.document_id: r for r in files.markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b", "c"}
    assert (rows["a b"].metadata, rows["a b"].text) == ("title: X", "# H\ntext")
    assert rows["c"].metadata is None and rows["c"].text.startswith("---")


def test_jsonl_round_trip_and_canonical_form(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "b int, a string")
    files.write_jsonl(df, f"{tmp_path}/x")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect()) == ['{"a":"é","b":1}', '{"a":null,"b":2}']
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/x", "b int, a string").collect()), key=str) == [(1, "é"), (2, None)]
    assert files.read_jsonl(spark, f"{tmp_path}/none", "b int").count() == 0
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "b int").collect()


def test_csv_and_union(spark, tmp_path):
    both = files.union_by_name([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([("x, \"y\"\nz", [1, 2])], "a string, c array<int>")])
    assert both.columns == ["a", "b", "c"]
    files.write_csv(both, f"{tmp_path}/c")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c").collect()), key=str) == [('x, "y"\nz', None, "[1,2]"), (None, "1", None)]


def test_runs_are_partitions(spark, tmp_path):
    for method in ("m1", "m2"):
        files.write_run(spark.createDataFrame([(method,)], "v string"), str(tmp_path), "r", method)
    assert files.methods_of_run(spark, str(tmp_path), "r") == ["m1", "m2"]
    assert [r.v for r in files.read_run(spark, str(tmp_path), "r", "m2").collect()] == ["m2"]


def test_install_publishes_only_what_passes(spark, tmp_path):
    df = spark.range(5)
    with pytest.raises(ValueError):
        files.install(df, f"{tmp_path}/t", lambda d: d.where("id > 3"))
    assert not list(tmp_path.iterdir())
    assert files.install(df, f"{tmp_path}/t", lambda d: d.where("id > 9")) == 5
    with pytest.raises(FileExistsError):
        files.install(df, f"{tmp_path}/t", lambda d: d.limit(0))


def test_content_hash_ignores_order_and_volatile_columns(spark):
    df = spark.createDataFrame([(k, f"v{k}", f"run{k}") for k in range(20)], "k int, v string, run_name string")
    one = files.content_hash(df)
    assert one == files.content_hash(df.orderBy(F.desc("k")).repartition(3).withColumn("run_name", F.lit("other")))
    assert one != files.content_hash(df.where("k > 0"))


def test_stages_resume_and_invalidate(spark, tmp_path):
    steps = [("double", lambda t: t["raw"].select((F.col("id") * 2).alias("id"))), ("sum", lambda t: t["double"].agg(F.sum("id").alias("s")))]
    run = lambda df: stages.run_stages(spark, str(tmp_path), {"raw": df}, steps)
    tables, done = run(spark.range(4))
    assert tables["sum"].first().s == 12 and not any(d.reused for d in done)
    assert all(d.reused for d in run(spark.range(4))[1])
    tables, done = run(spark.range(5))
    assert tables["sum"].first().s == 20 and not any(d.reused for d in done)


def test_diagnostics(spark):
    found = {r.check: (r.failures, r.passed) for r in stages.diagnostics({"a": spark.range(2), "b": spark.range(0)}).collect()}
    assert found == {"a": (2, False), "b": (0, True)}


def test_audit_merge_and_mismatches(spark):
    rules = spark.createDataFrame([("CR_1", None, "yes"), (None, "2", "no")], "claim_id string, span_id string, v string")
    other = spark.createDataFrame([("1", 1, "no"), ("1", 0, "YES"), ("3", 2, "x")], "span_id string, pos int, v string")
    found = audit.merge(rules, {"llm": other}, ["claim_id", "span_id"], "pos")
    rows = {r.record_key: r for r in found.withColumn("m", audit.mismatches([("v", F.col("v"), F.col("llm.v"))])).collect()}
    assert rows["1"].llm.v == "YES" and rows["1"].m == [] and rows["2"].llm is None


def test_validate_and_migrate(spark):
    df = spark.createDataFrame([("a", "x", 2.0), (" ", "q", 9.0)], "id string, kind string, v double")
    rows = audit.validate(df, ["id"], {"kind": ["x", "y"]}, {"v": (0, 5)}).collect()
    assert rows[0].errors == [] and len(rows[1].errors) == 3
    moved = audit.migrate(df, {"kind": "none", "status": "unreviewed"}).first()
    assert moved.status == "unreviewed" and moved.migration_warnings == ["status set to its default"]


def test_text_classifier_learns(spark):
    rows = [(k, ("red apple pie" if k % 2 else "blue sky day") + f" n{k}", "fruit" if k % 2 else "air") for k in range(80)]
    train, test = models.held_out(spark.createDataFrame(rows, "k int, text string, label string"), "k", "label")
    found = models.text_classifier(train, "text", "label").transform(test)
    assert found.count() > 5 and found.where("label != predicted").count() == 0


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    query = windows.windowed(windows.event_stream(spark, SF)).writeStream.outputMode("complete").format("memory").queryName("told").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (str(r.begin), r.event_type)
    found = {key(r): (r.n, round(r.total, 6)) for r in spark.table("told").collect()}
    assert found == {key(r): (r.n, round(r.total, 6)) for r in windows.windowed(events).collect()}
