"""Families, gates and parts of triage scores on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import families, scoring

NAMES = ("mixed", "direct", "mediated", "nitrate")
EVIDENCE = (
    families.Evidence("direct", 8, "n2_to_ammonia", (r"n2 to (?:nh3|ammonia)",)),
    families.Evidence("mediated", 8, "lithium_mediated", (r"lithium[- ]mediated", r"n2|nitrogen reduction")),
    families.Evidence("nitrate", 8, "nitrate_to_ammonia", (r"nitrate to ammonia",), unless=r"nitrate contamination"),
    families.Evidence("nitrate", 1, "nitrate", (r"nitrate",)),
)


def decided(spark, text, stated=None):
    scores = families.family_scores([(F.col("t"), 1)], EVIDENCE, NAMES)
    scores = families.subsumed(scores, "mediated", "direct")
    d = families.decide_family(scores, F.lit(stated) if stated else None)
    return tuple(spark.createDataFrame([(text,)], "t string").select(d.alias("d")).first()["d"])


@pytest.mark.parametrize(
    ("text", "stated", "expected"),
    [
        ("n2 to nh3 on iron", None, ("direct", "high", False)),
        ("lithium-mediated route, n2 to nh3", None, ("mediated", "high", False)),
        ("n2 to nh3 beside nitrate to ammonia", None, ("mixed", "medium", True)),
        ("nitrate contamination; nitrate to ammonia", None, ("unclear", "unclear", False)),
        ("no such words", None, ("unclear", "unclear", False)),
        (None, None, ("unclear", "unclear", False)),
        ("nitrate to ammonia", "direct", ("direct", "high", True)),
        ("no such words", "nitrate", ("nitrate", "high", False)),
    ],
)
def test_decision(spark, text, stated, expected):
    assert decided(spark, text, stated) == expected


def test_labels_by_alias(spark):
    label = families.family_label(F.col("v"), {"n2rr": "direct", "unknown": "unclear"}, NAMES)
    found = spark.createDataFrame([("N2RR",), (" Direct ",), ("unknown",), ("other",), (None,)], "v string").select(label.alias("f"))
    assert [r["f"] for r in found.collect()] == ["direct", "direct", "unclear", "unclear", "unclear"]


@pytest.mark.parametrize(
    ("title", "abstract", "headings", "spans", "expected"),
    [
        ("direct", "nitrate", "unclear", ["direct"], ("direct", "high", True, ["nitrate"])),
        ("unclear", "nitrate", "nitrate", [], ("nitrate", "high", False, [])),
        ("unclear", "unclear", "direct", ["nitrate"], ("direct", "medium", False, [])),
        ("unclear", "unclear", "unclear", ["nitrate", "nitrate"], ("nitrate", "medium", False, [])),
        ("unclear", "unclear", "unclear", ["nitrate", "direct"], ("mixed", "medium", True, [])),
        ("unclear", "unclear", "unclear", None, ("unclear", "unclear", False, [])),
    ],
)
def test_document(spark, title, abstract, headings, spans, expected):
    df = spark.createDataFrame([(title, abstract, headings, spans)], "a string, b string, c string, d array<string>")
    assert tuple(df.select(families.document_family(*map(F.col, "abcd")).alias("x")).first()["x"]) == expected


@pytest.mark.parametrize(
    ("target", "explicit", "document", "sure", "earlier", "expected"),
    [
        ("nitrate", True, "direct", "high", "direct", ("nitrate", "span", True, False)),
        ("unclear", False, "direct", "high", "nitrate", ("direct", "document", True, True)),
        ("unclear", False, "direct", "medium", "nitrate", ("nitrate", "earlier", False, False)),
        ("mixed", True, "unclear", "unclear", "unclear", ("unclear", "unclear", False, False)),
    ],
)
def test_effective(spark, target, explicit, document, sure, earlier, expected):
    df = spark.createDataFrame([(target, explicit, document, sure, earlier)], "a string, b boolean, c string, d string, e string")
    assert tuple(df.select(families.effective_family(*map(F.col, "abcde")).alias("x")).first()["x"]) == expected


def test_consensus_fills_unclear_records_and_marks_others(spark):
    rows = [("p", 1, "direct", "high", 8), ("p", 2, "direct", "medium", 4), ("p", 3, "unclear", "unclear", 0), ("p", 4, "nitrate", "medium", 5), ("q", 5, "unclear", "unclear", 0), (None, 6, "unclear", "low", 0)]
    records = spark.createDataFrame(rows, "g string, id int, family string, confidence string, points int")
    weight = families.vote_weight(F.lit("body"), F.lit(False), F.col("confidence"))
    consensus = families.family_consensus(records, "g", "family", "confidence", F.col("points"), weight, NAMES)
    assert [tuple(r) for r in consensus.collect()] == [("p", "direct", "high", 3)]
    found = families.with_consensus(records, consensus, "g", "family", "confidence", F.col("points") < 4)
    told = {r["id"]: (r["final_family"], r["final_confidence"], r["filled"], r["against"]) for r in found.collect()}
    assert told[3] == ("direct", "medium", True, False)
    assert told[4] == ("nitrate", "medium", False, True)
    assert told[5] == ("unclear", "unclear", False, False) and told[6] == ("unclear", "low", False, False)
    assert len(told) == 6


@pytest.mark.parametrize(
    ("text", "stated", "expected"),
    [
        ("15N2 feed", None, (True, "text", False)),
        ("no 15N test was run", None, (False, "", False)),
        ("nothing said", "Explicit", (True, "stated", False)),
        ("no 15N test was run", "yes", (False, "stated", True)),
        (None, "unclear", (False, "", False)),
    ],
)
def test_gate(spark, text, stated, expected):
    g = families.gate(F.col("t"), "15N", r"\bno\b.{0,40}15N", F.col("s"))
    assert tuple(spark.createDataFrame([(text, stated)], "t string, s string").select(g.alias("g")).first()["g"]) == expected


def test_parts_of_triage(spark):
    df = spark.createDataFrame([(1,)], "x int")
    lit = F.lit
    full = scoring.validation_completeness(lit("yes"), lit("yes"), lit("confirmed"), lit("1"), lit("NMR"), lit(True))
    waived = scoring.validation_completeness(lit("not applicable"), lit("no"), lit(None), lit("unclear"), lit(" "), lit(False))
    needed = scoring.validation_completeness(lit("not applicable"), lit("no"), lit(None), lit("unclear"), lit(None), lit(True))
    sure = scoring.source_grounding(lit("x" * 40), lit("high"), lit(True))
    empty = scoring.source_grounding(lit(None), lit("low"), lit(True))
    unusable = scoring.source_grounding(lit("x" * 40), lit("high"), lit(False))
    flags = scoring.engineering_flags({"HOR_context": lit(True), "current_density_reported": lit(True)}, lit(12.0))
    brief = scoring.engineering_flags({}, lit(2.0))
    worst = scoring.contamination_penalty({"class": lit(True), "reassigned": lit(True)})
    row = df.select(full, waived, needed, sure, empty, unusable, flags, scoring.engineering_relevance(flags), brief, worst).first()
    assert [round(v, 9) for v in row[:6]] == [1.0, 0.2, 0.0, 1.0, 0.0, 0.0]
    assert row[6] == ["HOR_context", "long_runtime_or_stability", "current_density_reported"] and round(row[7], 9) == 0.45
    assert row[8] == ["stability_reported"] and row[9] == 0.6


def test_consensus_reads_texts_once(spark):
    from tessera.plans import queries

    found = queries.family_propagation(spark, "/root/testdata/sf0.001")
    assert "Relation" not in found._jdf.queryExecution().optimizedPlan().toString()
