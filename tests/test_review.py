"""Review needs: every flag and level by a row of its own, merging, and the records that claim rights have judged."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import review, rights

CLEAN = {"text_class": "other", "provenance_type": "table", "source_text": "x", "blank_control": "yes", "nox_control": "yes", "isotope_15N": "yes"}
CASES = {
    "text_class_provenance_conflict_primary_vs_low_trust": {"text_class": "primary_performance", "provenance_type": "Reference", "text_class_provenance_conflict": "true"},
    "unsupported_or_missing_source_text": {"source_text": " "},
    "reaction_family_conflict": {"reaction_family_conflict": "yes"},
    "unpaired_caption_primary_claim": {"provenance_type": "figure caption", "paired_body_required": "1", "claim_type": "performance_claim"},
    "process_or_reactor_claim_low_trust_provenance": {"provenance_type": "metadata", "claim_type": "reactor_claim"},
    "n2_to_nh3_primary_claim_missing_isotope_attribution": {"provenance_type": "body", "reaction_family": "eNRR", "isotope_15N": "no"},
    "rule_boundary_potentially_overclaims_provenance": {"maximum_supported_boundary": "cell_metric"},
    "trusted_boundary_capped_by_provenance": {"overclaim_risk_flags": ["trusted_boundary_capped_by_provenance"]},
    "high_priority_contamination_or_source_attribution_gap": {"required_controls": ["15N2 isotope validation"]},
    "missing_blank_or_nox_controls": {"nox_control": "unclear"},
    "review_table_primary_pairing_required": {"missing_boundary_fields": ["primary body text"]},
    "medium_confidence_family_or_section_conflict": {"reaction_family_confidence": "Medium", "section_confidence": "medium"},
    "incomplete_metric_matrix": {"detected_taxes": ["measurement_matrix_tax"]},
    "optional_audit_note_only": {"audit_note": "see page 3"},
}
LISTS = ("overclaim_risk_flags", "required_controls", "missing_boundary_fields", "detected_taxes", "llm_audit_flags")
COLUMNS = ("text_class", "provenance_type", "source_text", "blank_control", "nox_control", "isotope_15N", "text_class_provenance_conflict", "reaction_family_conflict", "paired_body_required", "claim_type", "reaction_family", "maximum_supported_boundary", "reaction_family_confidence", "section_confidence", "audit_note", "llm_needs_human_review", "llm_more_permissive", "llm_parse_error", *LISTS)


def table(spark, rows):
    schema = "name string, " + ", ".join(f"{c} {'array<string>' if c in LISTS else 'string'}" for c in COLUMNS)
    return spark.createDataFrame([(name, *((CLEAN | row).get(c) for c in COLUMNS)) for name, row in rows.items()], schema)


@pytest.fixture(scope="module")
def found(spark):
    rows = CASES | {"clean": {}, "model asks": {"llm_needs_human_review": "yes"}, "model flag": {"llm_audit_flags": ["text_class_disagreement", "unknown"]}, "model error": {"llm_parse_error": "bad"}, "both": {"nox_control": "no", "llm_more_permissive": "true"}}
    return {r["name"]: r for r in review.bands(table(spark, rows)).collect()}


@pytest.mark.parametrize("flag", CASES)
def test_each_flag_and_its_level(spark, found, flag):
    levels = {f.flag: f.level for f in found[flag].rule_flags}
    assert flag in levels
    highest = next(level for level in review.LEVELS if level in levels.values())
    assert found[flag].rule_score == review.SCORES[highest]
    # Points of the audit and the model may raise a band, never lower it.
    assert review.LEVELS.index(found[flag].review_band) <= review.LEVELS.index(highest)
    assert found[flag].needs_review == (found[flag].review_band in review.NEEDED)


def test_levels_are_all_taken(found):
    assert {r.review_band for r in found.values()} == {*review.LEVELS, "none"}
    assert (found["clean"].review_band, found["clean"].review_flags, found["clean"].audit_score, found["clean"].needs_review) == ("none", [], 0, False)
    assert found["optional_audit_note_only"].review_band == "low" and not found["optional_audit_note_only"].needs_review


def test_models_are_merged(found):
    assert (found["model asks"].model_score, found["model asks"].needs_review, found["model asks"].review_band) == (4, True, "medium")
    assert (found["model flag"].model_score, found["model flag"].review_flags, found["model flag"].review_band, found["model flag"].needs_review) == (2, ["text_class_disagreement", "unknown"], "low", True)
    assert (found["model error"].model_score, found["model error"].review_band) == (8, "high")
    both = found["both"]
    assert (both.rule_score, both.model_score, both.review_score, both.review_band) == (4, 5, 9, "high")
    assert both.audit_reasons == ["llm_more_permissive", "missing_NOx_control"] and both.audit_score == 7


def test_judged_records_go_straight_in(spark):
    rows = [("primary_performance", "90% FE of N2 reduction", "body", "eNRR"), ("reference_list", "[1] x", "reference", None), (None, None, None, None)]
    judged = rights.adjudicate(spark.createDataFrame(rows, "text_class string, source_text string, provenance_type string, reaction_family string"))
    bands = [r.review_band for r in review.bands(judged).collect()]
    assert bands == ["high", "high", "critical"]
    counted = {r.review_band: (r.records, r.needed) for r in review.routes(review.bands(judged)).collect()}
    assert counted == {"high": (2, 2), "critical": (1, 1)}
    assert review.bands(judged.limit(0)).count() == 0


def test_bands(spark):
    row = spark.range(1).select(*(review.band(F.lit(n), F.array(F.lit(level))).alias(f"b{k}") for k, (n, level) in enumerate([(0, "x"), (1, "x"), (4, "low"), (8, "low"), (0, "critical"), (20, "medium"), (0, "medium")]))).first()
    assert tuple(row) == ("none", "low", "medium", "high", "critical", "high", "medium")
