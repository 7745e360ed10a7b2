"""Literal rows in, literal rows out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import text as T
from tessera.operators import evidence, joins, metrics, sampling, scoring, segment


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, float) else 'double'}" for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "expected"), [("1,234.5 mA", 1234.5), ("-0.3 V", -0.3), ("none", None), ("", None), ("2e-7", 2e-7)])
def test_number(spark, text, expected):
    assert one(spark, T.number(F.col("x")), x=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("https://doi.org/10.1/AB.", "10.1/ab"), ("doi: 10.2/x)", "10.2/x"), ("10.3/s(96)01.", "10.3/s(96)01"), ("10.3/s(96)", "10.3/s(96)"), ("no", None)])
def test_doi(spark, text, expected):
    assert one(spark, T.doi(F.col("x")), x=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("a, b;a", ["a", "b"]), ('["x", " y ", "x"]', ["x", "y"]), ("", [])])
def test_labels(spark, text, expected):
    assert one(spark, T.labels(F.col("x")), x=text) == expected


@pytest.mark.parametrize(("text", "expected"), [("Yes", "yes"), (" no ", "no"), ("", "missing"), ("maybe", "unclear"), ("none", "missing"), ("N/A", "missing"), ("confirmed", "yes"), ("2", "yes"), ("0", "no"), ("not detected", "no"), ("unavailable", "no")])
def test_yes_no(spark, text, expected):
    assert one(spark, T.yes_no(F.col("x")), x=text) == expected


def test_reportable(spark):
    for text, status in (("not available", "not_reported"), ("", "missing"), ("3", "reported")):
        assert one(spark, T.reportable(F.col("x"))["status"], x=text) == status


def test_canonical_json_orders_keys_and_keeps_nulls(spark):
    assert one(spark, T.canonical_json(b=F.col("x"), a=F.lit(None).cast("int")), x="é") == '{"a":null,"b":"é"}'


def test_record_key(spark):
    df = spark.createDataFrame([(" ", "CR_7"), (None, "HT_8"), ("9", None)], "a string, b string")
    assert [r[0] for r in df.select(T.record_key(F.col("a"), F.col("b"))).collect()] == ["7", "8", "9"]


def test_keyword_score_needs_whole_words(spark):
    assert one(spark, rules.keyword_score(F.col("x"), ("FE", "flow cell"), ("flow cell",)), x="Safe flow cells, a Flow Cell") == 2
    assert one(spark, rules.keyword_score(F.col("x"), ("FE",)), x="an FE of 3 %") == 1


ROWS = [(1, "a", 1), (1, "b", 2), (2, "c", 3), (None, "d", 4)]


def test_last_and_first_win(spark):
    df = spark.createDataFrame(ROWS, "k int, v string, pos int")
    assert sorted((r.k, r.v) for r in joins.last_wins(df, "k", "pos").collect()) == [(1, "b"), (2, "c")]
    assert sorted((r.k, r.v) for r in joins.first_wins(df, "k", "pos").collect()) == [(1, "a"), (2, "c")]


def test_within_range_equals_all_pairs(spark):
    rows = [(k % 3, 7 * k % 50) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, at int")
    found = sorted((r.k, r.at, r.other_at) for r in joins.within_range(df, df, ["k"], "at", 9).collect())
    assert found == sorted((k, a, b) for k, a in rows for j, b in rows if j == k and abs(a - b) <= 9)


def test_nearest_before(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, at int")
    right = spark.createDataFrame([("x", 2, "p"), ("x", 5, "q"), ("y", 10, "r")], "k string, at int, v string")
    found = {(r.k, r.at): r.v for r in joins.nearest_before(left, right, ["k"], "at", ["v"]).collect()}
    assert found == {("x", 5): "q", ("x", 1): None, ("y", 9): None}


def test_nearest_before_by_cells_equals_the_plain_way(spark):
    left = spark.createDataFrame([(k % 2, 37 * k % 101) for k in range(60)], "k int, at int")
    right = spark.createDataFrame([(k % 2, 13 * k % 97, k) for k in range(25)], "k int, at int, v int")
    plain = sorted(map(tuple, joins.nearest_before(left, right, ["k"], "at", ["v"]).collect()), key=str)
    assert plain == sorted(map(tuple, joins.nearest_before(left, right, ["k"], "at", ["v"], width=7).collect()), key=str)


def test_by_precedence(spark):
    left = spark.createDataFrame([(1, " "), (2, "own")], "k int, v string")
    side = spark.createDataFrame([(1, "side", "w")], "id int, v string, w string")
    found = {r.k: (r.v, r.w) for r in joins.by_precedence(left, [(side, "id")], "k").collect()}
    assert found == {1: ("side", "w"), 2: ("own", None)}


def test_missing_equals_missing_only_with_a_row(spark):
    df = spark.createDataFrame([("", None, True), (None, "", False), ("A b", "a  B", True), ("x", "y", True)], "g string, p string, has boolean")
    row = metrics.categorical(df, "g", "p", has_row="has").first()
    assert (row.total, row.correct, row.missing, row.accuracy) == (4, 2, 2, 0.5)


def test_numeric_tolerance(spark):
    df = spark.createDataFrame([(10.0, 10.05), (10.0, 11.0), (10.0, None), (None, 1.0)], "g double, p double")
    row = metrics.numeric(df, "g", "p", absolute=0.1).first()
    assert (row.support, row.within, row.missing) == (3, 1, 1)
    assert row.max_error == 1.0


def test_kappa(spark):
    rows = [(i, r, v) for i, (a, b) in enumerate([("y", "y"), ("y", "n"), ("n", "n"), ("n", "n")]) for r, v in (("1", a), ("2", b))]
    row = metrics.kappa(spark.createDataFrame(rows, "i int, r string, v string"), ["i"], "r", "v").first()
    assert (row.pairs, row.observed, row.expected, row.kappa) == (4, 0.75, 0.5, 0.5)
    same = metrics.kappa(spark.createDataFrame([(1, "1", "y"), (1, "2", "y")], "i int, r string, v string"), ["i"], "r", "v").first()
    assert same.expected == 1.0 and same.kappa is None


def test_per_label_counts_labels_of_the_domain(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None)], "g string, p string")
    found = {r.label: (r.tp, r.fp, r.fn, r.f1) for r in metrics.per_label(df, "g", "p", ["a", "b", "c"]).collect()}
    assert found == {"a": (1, 0, 1, 2 / 3), "b": (0, 1, 1, 0.0), "c": (0, 0, 0, 0.0)}


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"g{k % 20}", k) for k in range(100)], "g string, k int")
    found = sampling.group_split(df, "g").groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r.s) == 1 for r in found)
    counts = {s: sum(r.s == [s] for r in found) for s in ("train", "dev", "test")}
    assert counts == {"train": 14, "dev": 3, "test": 3}
    two = sampling.group_split(df.where("g in ('g1', 'g2')"), "g").select("split").distinct().collect()
    assert sorted(r[0] for r in two) == ["test", "train"]
    assert {r[0] for r in sampling.group_split(df.where("g = 'g1'"), "g").select("split").collect()} == {"train"}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(200)], "k int, s string")
    picks = [sorted((r.k, r.selected_by) for r in sampling.quota_sample(df.repartition(n), "s", "k", {"a": 5, "b": 3, "c": 4}).collect()) for n in (1, 7)]
    assert picks[0] == picks[1] and len(picks[0]) == 12


def test_scaled_quotas():
    assert sampling.scaled_quotas({"a": 50, "b": 30, "c": 20}, 7) == {"a": 4, "b": 2, "c": 1}


def test_sections_and_paragraphs(spark):
    text = "intro\n\n# A\n\nfirst é\n\nsecond\n\n## B\nthird\n# C\n"
    df = spark.createDataFrame([("d", text)], "doc string, text string")
    found = segment.sections(df, "doc")
    rows = {r.section_no: r for r in found.collect()}
    assert [(r.level, r.heading, list(r.outline), r.parent_no) for _, r in sorted(rows.items())] == [(0, None, [1], None), (1, "A", [2], None), (2, "B", [2, 1], 2), (1, "C", [3], None)]
    for r in rows.values():
        for p in r.paragraphs:
            assert text[p.start : p.end] == p.text
    assert [p.text for p in rows[2].paragraphs] == ["first é", "second"]
    flat = segment.section_paragraphs(found, "doc").orderBy("start").collect()
    assert [r.text for r in flat] == ["intro", "first é", "second", "third"]
    assert flat[1].previous_start == flat[0].start and flat[3].next_start is None
    types = F.when(F.col("heading") == "A", "results").otherwise("unknown")
    typed = {r.section_no: r.type for r in segment.inherited_types(found, types, "doc").collect()}
    assert typed == {1: "unknown", 2: "results", 3: "results", 4: "unknown"}


CLASSES = [
    ("References\n[1] A\n[2] B", "reference_list", "reject"),
    ("Literature summary of catalysts", "review_table", "secondary"),
    ("A protocol: 15N isotope controls should be performed", "protocol_guideline", "protocol"),
    ("The claim was reassigned", "contamination_reassignment_evidence", "negative"),
    ("We found nitrate contamination", "contamination_detection_evidence", "negative"),
    ("Figure 2. Faradaic efficiency", "figure_caption", "context"),
    ("DFT adsorption energy of the surface", "computational_screening", "context"),
    ("Faradaic efficiency of 12 % NH3 with 15N isotope labeling", "primary_performance_with_validation", "performance"),
    ("Faradaic efficiency of 12 %", "primary_performance", "performance"),
    ("The nitrogen reduction reaction is promising", "background_context", "context"),
    ("Nothing here", "unknown", "context"),
    ("", "unknown", "context"),
]


def test_span_classes(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(CLASSES)], "k int, text string")
    found = {r.k: (r.text_class, r.ledger) for r in evidence.classify(df, "text").collect()}
    assert found == {k: (c, ledger) for k, (_, c, ledger) in enumerate(CLASSES)}
    routed = evidence.route(evidence.classify(df, "text"))
    assert sum(x.count() for x in routed.values()) == len(CLASSES)


def test_extracted_fields(spark):
    text = "NH3 was produced at 5.2 umol h-1 cm-2 with 12.5 % Faradaic efficiency; 15N2 and Ar blank; indophenol and NMR"
    row = evidence.extract(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert (row.faradaic_efficiency_percent, row.nh3_yield_value, row.nitrogen_source, row.detection_method) == (12.5, 5.2, "15N2", "indophenol and NMR")
    assert (row.isotope_validation, row.blank_control, row.reliability_label) == ("yes", "yes", "B")


def test_candidates_keep_the_best_of_each_document(spark):
    df = spark.createDataFrame([("d", 1, "reactor"), ("d", 2, "FE"), ("d", 3, "plain"), ("d", 4, "reactor and FE")], "doc string, n int, text string")
    found = evidence.candidates(df, "doc", "n", "text", most=2).orderBy("place").collect()
    assert [(r.span_id, r.score) for r in found] == [("d_S004", 3), ("d_S001", 2)]


def test_capped_risk_and_tiers(spark):
    reasons = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(w).alias("weight")) for c, w in (("a", 40.0), ("b", 30.0), ("c", 5.0))))
    score = scoring.capped_total(reasons, {"a": "g", "b": "g"}, {"g": 50})
    row = spark.range(1).select(score.alias("s"), scoring.risk_tier(score).alias("t")).first()
    assert (row.s, row.t) == (55.0, "T2")


def test_replicate_gate(spark):
    rows = [("p", 10.0, "success", True, True)] * 3 + [("c", 1.0, "success", False, True), ("f", 1.0, "failed", True, True), ("i", 1.0, "success", True, True), ("w", 1.0, "success", True, False)]
    df = spark.createDataFrame(rows, "g string, v double, s string, ok boolean, whole boolean")
    found = {r.g: r.gate for r in scoring.replicate_gate(df, "g", "v", "s", "ok", "whole", least=5, most_cv=0.5).collect()}
    assert found == {"p": "passed", "c": "invalid_controls", "f": "failed", "i": "insufficient", "w": "incomplete"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert segment.lines(docs).count() == segment.sections(docs).count() == evidence.classify(docs, "text").count() == 0


@pytest.mark.parametrize(
    ("text", "label"),
    [("## 1. Introduction", "introduction"), ("**Results and Discussion**", "results_and_discussion"), ("A b s t r a c t", "abstract"), ("IV. Experimental Section", "methods"), ("Results of runs", "results"), ("Literature Cited", "references"), ("Supporting Information", "supplementary"), ("Thoughts", "unknown"), ("", "unknown")],
)
def test_section_labels(spark, text, label):
    from tessera.operators import provenance

    assert one(spark, provenance.section_label(F.col("x")), x=text) == label


def test_provenance(spark):
    from tessera.operators import provenance

    cases = [
        ("[1] A, et al. 2001\n[2] B et al. 2002\n[3] C et al.", "References", "reference", False),
        ("| a | b |\n|---|---|\n| 1 | 2 |", None, "table", False),
        ("Figure 3. A cell", None, "figure_caption", False),
        ("Scheme 1: steps", None, "scheme_caption", False),
        ("We saw that", "3. Results", "results", True),
        ("We saw that", None, "body", True),
        ("", None, "unknown", False),
        (None, None, "unknown", False),
    ]
    df = spark.createDataFrame([(k, t, s) for k, (t, s, _, _) in enumerate(cases)], "k int, text string, section string")
    found = {r.k: (r.provenance, r.primary_admissible) for r in provenance.infer(df, "text", "section").collect()}
    assert found == {k: (p, ok) for k, (_, _, p, ok) in enumerate(cases)}


def test_given_provenance_holds(spark):
    from tessera.operators import provenance

    df = spark.createDataFrame([("We saw", "Figure Caption"), ("We saw", "hearsay"), ("We saw", None)], "text string, given string")
    assert [r.provenance for r in provenance.infer(df, "text", given_col="given").collect()] == ["figure_caption", "body", "body"]


def test_no_break_spaces_are_spaces(spark):
    df = spark.createDataFrame([("Faradaic\u00a0efficiency of 12\u00a0%",)], "text string")
    assert evidence.extract(df, "text").first().faradaic_efficiency_percent == 12.0
    assert evidence.classify(df, "text").first().text_class == "primary_performance"


def test_a_span_is_normalized_once_for_its_provenance(spark):
    from tessera.operators import provenance

    rows = [("Smith, J. 2001, 12-15; Jones, A. B. 1'999, 3–9",), ("in 1998 and 2005 of 11-12",), (None,), ("a-b",)]
    found = provenance.infer(spark.createDataFrame(rows, "text string"), "text")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?U)") == 1
    measured = provenance._measured(spark.createDataFrame(rows, "text string"), "text", None)
    assert [(r._n_pages, r._n_authors) for r in measured.collect()] == [(2, 2), (1, 0), (0, 0), (0, 0)]
