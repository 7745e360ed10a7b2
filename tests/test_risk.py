"""Risk reasons on literal rows: weights, caps, order, tiers and awkward rows."""

from __future__ import annotations

from tessera.operators import risk

SPAN = "needs_review boolean, semantic_confidence string, effective_reaction_family string, claim_ownership string, primary_semantic_eligibility string, semantic_claim_type string, all_matching_strata array<string>, validation_gate_decisions map<string,boolean>, hard_gate_failures array<string>, previous_context_excerpt string, linked_evidence_ids array<string>"


def told(row):
    return [(r.code, r.raw_weight, r.weight) for r in row.risk_reasons]


def test_a_sound_span_has_no_risk(spark):
    rows = spark.createDataFrame([(False, "high", "target", "own", "True", "protocol_claim", [], {}, [], "before", [])], SPAN)
    row = risk.with_risk(rows, "span").first()
    assert (told(row), row.risk_score, row.risk_tier, row.human_route) == ([], 0, "T0", "auto_validate_only")


def test_correlated_reasons_share_a_cap_in_order(spark):
    rows = spark.createDataFrame([(True, "Low", "MIXED", "unclear", None, "validation_claim", ["quantification"], {"blank": False}, ["a", "b"], "", [])], SPAN)
    row = risk.with_risk(rows, "span").first()
    assert told(row) == [
        ("span_needs_review", 12, 12), ("span_low_semantic_confidence", 22, 22), ("span_unclear_or_mixed_family", 18, 6), ("span_unclear_ownership", 10, 0),
        ("span_not_primary_eligible", 8, 8), ("span_quantification_claim_signal_conflict", 14, 14), ("span_validation_gate_conflict", 18, 18),
        ("span_hard_gate_failures", 16, 8), ("span_context_insufficient", 8, 8), ("span_expected_evidence_link_absent", 12, 4),
    ]
    assert (row.risk_score, row.risk_tier, row.machine_route) == (100, "T3", "abstention_recommended")


def test_papers_documents_and_links(spark):
    paper = spark.createDataFrame([("needs_review", 0, ["x", "y", "z", "w"], "review", "norr", True)], "paper_admissibility_status string, primary_eligible_count int, limitations array<string>, document_genre string, document_reaction_family string, has_validation_evidence boolean")
    assert [w for *_, w in told(risk.with_risk(paper, "paper").first())] == [18, 20, 0, 14, 10, 10]
    document = spark.createDataFrame([(["genre: a", "family: b"], "article", "linrr", " short ")], "document_conflicts array<string>, document_genre string, document_reaction_family string, front_matter_excerpt string")
    row = risk.with_risk(document, "document").first()
    assert told(row) == [("document_genre_conflict", 24, 24), ("document_family_conflict", 24, 6), ("document_off_target_family", 15, 15), ("document_front_matter_scope_insufficient", 15, 15)]
    assert (row.risk_score, row.risk_tier, row.risk_reasons[3].detail) == (60, "T2", "5")
    link = spark.createDataFrame([("true", ["a"], "primary_admissible", "far", "validation_claim", "performance_result_claim")], "is_context_only string, link_roles array<string>, source_eligibility string, source_distance_band string, target_claim_type string, evidence_claim_type string")
    assert told(risk.with_risk(link, "link").first()) == [("link_context_only", 22, 22), ("link_far_endpoint_distance", 10, 10), ("link_target_evidence_claim_conflict", 16, 14)]


def test_awkward_rows(spark):
    bare = spark.createDataFrame([(None, None)], "needs_review boolean, risk string")
    assert [c for c, *_ in told(risk.with_risk(bare, "span").first())] == ["span_not_primary_eligible", "span_context_insufficient"]
    assert risk.with_risk(bare, "link").first().risk_score == 34
    for item in ("span", "paper", "document", "link"):
        assert risk.with_risk(bare.limit(0), item).count() == 0
        assert set(bare.columns) < set(risk.with_risk(bare, item).columns)
