"""Ids of spans: digests by hand, ids that survive inserted text, and matches of two runs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tessera.operators import identity

SCHEMA = "paper_id string, document_id string, document_body_sha256 string, section_path array<string>, source_text string, source_span_id string, source_start_offset long, source_end_offset long, mapping_method string, verified_start long, verified_end long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_uids_are_digests_of_their_anchor(spark):
    rows = [
        ("p", "d", "b" * 8, ["A", " b "], "ﬁrst  text", "p_S3", 1, 9, "explicit_verified", 2, 10),
        ("p", None, None, None, "first text", "p_S3", 1, 9, None, None, None),
        ("p", "d", None, ["Results"], "é text", "p_s12", None, None, "unresolved", None, None),
        (None, None, None, None, None, " x ", 5, 2, None, None, None),
    ]
    got = identity.with_uid(spark.createDataFrame(rows, SCHEMA)).collect()
    text = sha("first text")
    payloads = [
        {"paper_id": "p", "document_id": "d", "document_body_sha256": "b" * 8, "verified_source_start_offset": 2, "verified_source_end_offset": 10, "normalized_text_sha256": text},
        {"paper_id": "p", "document_id": "p", "source_start_offset": 1, "source_end_offset": 9, "source_text_sha256": text},
        {"paper_id": "p", "document_id": "d", "section_path": "results", "source_text_sha256": sha("é text"), "legacy_span_order": 12},
        {"paper_id": "", "document_id": "", "section_path": "", "source_text_sha256": sha(""), "legacy_source_span_id": "x"},
    ]
    assert [r.stable_span_uid for r in got] == ["SPAN_" + sha(json.dumps(p, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for p in payloads]
    assert [r.stable_span_uid_method for r in got] == list(identity.METHODS)
    assert [len(r.stable_span_uid_warnings) for r in got] == [0, 0, 1, 1]


def test_repeats_are_told(spark):
    rows = [("p", "u"), ("p", "u"), ("p", "v"), ("q", "v"), ("q", "w")]
    found = identity.repeated_uids(spark.createDataFrame(rows, "paper_id string, stable_span_uid string")).collect()
    assert {tuple(r) for r in found} == {("u", 2, "same_paper"), ("v", 2, "cross_paper")}


def spans(spark, rows):
    return identity.with_content_id(spark.createDataFrame([(k, d, s, t, at) for k, (d, s, t, at) in enumerate(rows)], "span_id int, document_id string, section string, source_text string, start int"))


def test_ids_survive_inserted_text(spark):
    old = [("d", "a", "one", 0), ("d", "a", "two", 10), ("d", "a", "one", 20), ("e", None, None, 0)]
    new = [("d", "a", "put in", 0), *((d, s, t, at + 50) for d, s, t, at in old)]
    ids = [{r.content_id for r in spans(spark, rows).collect()} for rows in (old, new)]
    assert len(ids[0]) == 4 and ids[0] < ids[1]
    occurrences = {(r.source_text, r.start): r.occurrence for r in spans(spark, old).collect()}
    assert occurrences["one", 0] == 1 and occurrences["one", 20] == 2


def test_runs_are_matched(spark):
    old = spans(spark, [("d", "a", "one", 0), ("d", "a", "two", 5), ("d", "b", "gone", 9), ("d", "b", "twice", 12), ("d", "b", "twice", 15)])
    new = spans(spark, [("d", "a", "one  ", 3), ("d", "c", "two", 8), ("d", "c", "new", 12), ("d", "c", "twice", 15), ("d", "c", "twice", 19)])
    got = {tuple(r) for r in identity.matched(old, new).collect()}
    assert got == {(0, 0, "same_content"), (1, 1, "moved"), (2, None, "gone"), (3, None, "gone"), (4, None, "gone"), (None, 2, "added"), (None, 3, "added"), (None, 4, "added")}
    assert identity.matched(old.limit(0), new).where("how = 'added'").count() == 5
    assert identity.same_text_elsewhere(old.withColumn("end", F.col("start") + 1), ("document_id", "section")).count() == 1
