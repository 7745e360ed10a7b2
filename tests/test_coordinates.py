"""Places of spans against a search through whole texts, and the joins by place against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import coordinates

WORD = re.compile(r"[^\s\xA0]+")


def brute(text, span):
    """Every place where the span's words stand as whole words."""
    held, asked = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)], WORD.findall(span or "")
    n = len(asked)
    return [(held[k][0], held[k + n - 1][1]) for k in range(len(held) - n + 1) if n and [h[2] for h in held[k : k + n]] == asked]


def some_text(rng, n):
    return "".join(rng.choice(["a", "b", "cc", "ü", "🙂x", "dd."]) + rng.choice([" ", "  ", "\n", "\xa0", "\t "]) for _ in range(n))


def test_places_equal_a_search(spark):
    rng = random.Random(1)
    texts = {k: some_text(rng, rng.randint(0, 60)) for k in range(40)} | {40: None, 41: "", 42: "  lead and end  "}
    spans = []
    for k, text in texts.items():
        held = WORD.findall(text or "")
        for _ in range(12):
            a = rng.randrange(len(held) + 1)
            spans.append((k, " ".join(held[a : a + rng.randint(0, 9)]) or rng.choice([None, "", "nowhere at all", "b cc"])))
    docs = spark.createDataFrame(list(texts.items()), "document_id int, text string")
    rows = spark.createDataFrame([(n, k, s) for n, (k, s) in enumerate(spans)] + [(-1, 99, "a b"), (-2, None, "a")], "span_id int, document_id int, source_text string").repartition(3)
    got = {r.span_id: r for r in coordinates.locate(rows, docs).collect()}
    assert len(got) == len(spans) + 2
    for n, (k, span) in enumerate(spans):
        wanted, row = brute(texts[k] or "", span), got[n]
        assert [tuple(c) for c in row.candidates] == wanted, (texts[k], span)
        if len(wanted) == 1:
            assert (row.mapping_method, row.mapping_confidence, row.mapping_warnings, (row.verified_start, row.verified_end)) == ("document_exact", "medium", [], wanted[0])
        else:
            missing = "document_unresolved" if texts[k] is None else "multiple_exact_matches" if wanted else "exact_text_not_found"
            assert (row.mapping_method, row.mapping_warnings, row.verified_start) == ("unresolved", [missing], None)
    assert got[-1].mapping_warnings == got[-2].mapping_warnings == ["document_unresolved"]


@pytest.mark.parametrize("given,section,method,start,warnings", [
    ((0, 3), (None, None), "explicit_verified", 0, []),
    ((8, 11), (0, 5), "explicit_verified", 8, []),
    ((1, 3), (6, 20), "section_constrained_exact", 8, ["offset_text_mismatch"]),
    ((5, 2), (None, None), "unresolved", None, ["invalid_offset_pair", "multiple_exact_matches"]),
    ((None, None), (0, 5), "section_constrained_exact", 0, []),
    ((None, None), (0, 20), "unresolved", None, ["multiple_exact_matches"]),
    ((None, None), (4, 7), "unresolved", None, ["multiple_exact_matches"]),
])
def test_stated_offsets_and_sections_tell_which(spark, given, section, method, start, warnings):
    docs = spark.createDataFrame([(1, "one two one")], "document_id int, text string")
    rows = spark.createDataFrame([(1, "one", *given, *section)], "document_id int, source_text string, a int, b int, s int, e int")
    row = coordinates.locate(rows, docs, given=("a", "b"), section=("s", "e")).first()
    assert (row.mapping_method, row.verified_start, row.mapping_warnings) == (method, start, warnings)


def test_points_in_intervals(spark):
    rng = random.Random(2)
    intervals = [(d, s, s + rng.randint(1, 9)) for d in range(5) for s in range(0, 300, 10)]
    points = [(d, rng.choice([None, rng.randint(0, 320)])) for d in range(6) for _ in range(60)]
    found = coordinates.within(spark.createDataFrame(points, "d int, at int"), spark.createDataFrame(intervals, "d int, start int, end int"), "d", "at", ["start"], width=50).collect()
    wanted = [(d, at, next((s for e, s, t in intervals if e == d and at is not None and s <= at < t), None)) for d, at in points]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_paragraphs_and_anchors(spark):
    text = "  first one\nstill\n\n \n second \n\n\nthird"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n")], "document_id int, text string")
    rows = coordinates.paragraphs(docs).orderBy("start").collect()
    assert [(r.paragraph_no, r.text) for r in rows] == [(1, "first one\nstill"), (2, "second"), (3, "third")]
    assert all(text[r.start : r.end] == r.text for r in rows)
    spans = spark.createDataFrame([(1, "d", [2, 1], 3, 10, 12), (2, "d", [2, 1], 3, 4, 8), (3, "d", [], 1, 0, 2), (4, "d", [1], None, None, None)], "span_id int, doc string, outline array<int>, par int, verified_start long, verified_end long")
    got = {r.span_id: (r.source_locator, r.source_order_key) for r in coordinates.anchored(spans, "doc", "outline", "par").collect()}
    assert got == {1: ("d::SEC002.001::PAR003::ANCHOR02", "000002.000001.000003.000002"), 2: ("d::SEC002.001::PAR003::ANCHOR01", "000002.000001.000003.000001"), 3: ("d::SECUNK::PAR001::ANCHOR01", "000000.000000.000001.000001"), 4: (None, None)}


def test_summary_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d a b")], "document_id int, text string")
    rows = spark.createDataFrame([(1, "c d", 4, 7), (1, "a b", None, None), (1, "x", None, None)], "document_id int, source_text string, s int, e int")
    located = coordinates.locate(rows, docs, given=("s", "e")).withColumn("source_locator", F.when(F.col("verified_start").isNotNull(), "here"))
    assert coordinates.ledger_summary(located).first().asDict() == {"span_count": 3, "verified_span_mapping_count": 1, "unresolved_span_mapping_count": 2, "multiple_exact_match_count": 1, "source_locator_coverage": 0.333333, "duplicate_source_locator_count": 0}
    assert coordinates.locate(rows.limit(0), docs).count() == 0
    assert coordinates.locate(rows, docs.limit(0)).where("mapping_method = 'unresolved'").count() == 3


def test_spans_are_read_once_and_groups_cover_all(spark, monkeypatch):
    monkeypatch.setattr(coordinates, "GROUP", 3)
    docs = spark.createDataFrame([(1, "a b c d e f g a b"), (1, "a b c d e f g a b")], "document_id int, text string")
    said = ["a", "a b", "b c d", "c d e f g", "f g a", "e g", "g a b", "d"]
    rows = spark.createDataFrame([(1, s) for s in said], "document_id int, source_text string")
    located = coordinates.locate(rows, docs)
    got = {r.source_text: [tuple(c) for c in r.candidates] for r in located.collect()}
    assert got == {s: brute("a b c d e f g a b", s) for s in said}
    # No table of words, and spans are not made anew for each join.
    assert located._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 3
    points = spark.createDataFrame([(1, 4), (1, None), (None, 4)], "d int, at int")
    placed = coordinates.within(points, spark.createDataFrame([(1, 0, 30)], "d int, start int, end int"), "d", "at", ["end"], width=2)
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert sorted(map(tuple, placed.collect()), key=str) == [(1, 4, 30), (1, None, None), (None, 4, None)]
