"""Claim rights on literal rows of the domain: each case, each cap, the ladder, awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import rights

COLUMNS = ("text_class", "source_text", "provenance_type", "reaction_family", "nitrogen_source", "faradaic_efficiency_percent", "nh3_yield_value", "current_density", "potential_value", "isotope_validation", "blank_control", "nox_screening", "contamination_control", "detection_method", "reactor_type", "flow_rate", "HOR_or_anode_reaction", "outlet_product_state", "wetting_or_failure_disclosure", "hydrogen_source_boundary", "gas_liquid_product_split", "capture_route", "solvent_inventory", "paired_body_evidence")
FULL = {
    "text_class": "primary_performance_with_validation", "source_text": "A cell gave ammonia in 15N2.", "reaction_family": "eNRR", "faradaic_efficiency_percent": "61.5 %", "nh3_yield_value": "3.4", "current_density": "120", "potential_value": "-0.2", "isotope_validation": "performed", "blank_control": "yes",
    "nox_screening": "yes", "contamination_control": "yes", "detection_method": "NMR", "gas_liquid_product_split": "reported", "capture_route": "scrubber", "solvent_inventory": "20 mL", "hydrogen_source_boundary": "bottled",
}
REACTOR = FULL | {"capture_route": None, "source_text": "A cell gave ammonia with stability over 10 hours in 15N2.", "reactor_type": "flow cell", "flow_rate": "10 mL/min", "outlet_product_state": "gas", "wetting_or_failure_disclosure": "none seen"}
CASES = {
    "references": ({"text_class": "reference_list", "source_text": "[1] A. B., 2019. doi:10.1/x"}, "unsupported_claim", 0, "reject"),
    "review": ({"text_class": "review_table", "source_text": "Earlier FE values"}, "secondary_summary_claim", 0, "secondary_only"),
    "protocol": ({"text_class": "protocol_guideline", "source_text": "Use 15N2 and an argon blank."}, "protocol_claim", 1, "protocol_only"),
    "contamination": ({"text_class": "contamination_reassignment_evidence", "source_text": "NOx explains it"}, "negative_evidence_claim", 1, "negative_evidence"),
    "computation": ({"text_class": "computational_screening", "source_text": "DFT"}, "unsupported_claim", 0, "computational_only"),
    "other class": ({"text_class": "background_context", "source_text": "Ammonia matters."}, "unsupported_claim", 0, "insufficient_primary_support"),
    "no class": ({"source_text": "Ammonia matters."}, "unsupported_claim", 0, "insufficient_primary_support"),
    "efficiency only": ({"text_class": "primary_performance", "source_text": "N2 reduction reached 90% FE.", "reaction_family": "eNRR"}, "performance_claim", 2, "metric_only_or_validation_incomplete"),
    "process": (FULL, "process_claim", 4, "process_partial"),
    "process without capture": (FULL | {"capture_route": None}, "process_claim", 2, "metric_only_or_validation_incomplete"),
    "process by a class without validation": (FULL | {"text_class": "primary_performance"}, "process_claim", 2, "metric_only_or_validation_incomplete"),
    "reactor": (REACTOR, "process_claim", 3, "reactor_legible"),
    "reactor of hydrogen without its source": (REACTOR | {"HOR_or_anode_reaction": "HOR", "hydrogen_source_boundary": None}, "process_claim", 3, "reactor_legible"),
    "process in a flow cell that tells no outlet": (FULL | {"reactor_type": "flow cell"}, "process_claim", 3, "reactor_legible"),
    "plant": (REACTOR | {"source_text": "An industrial plant with stability over 10 hours in 15N2."}, "process_claim", 5, "plant_facing_incomplete"),
    "nitrate": ({"text_class": "primary_performance", "source_text": "Nitrate was reduced.", "reaction_family": "NO3RR", "nh3_yield_value": "1", "blank_control": "yes", "contamination_control": "yes", "detection_method": "yes"}, "performance_claim", 2, "cell_metric_admissible"),
    "no text": (FULL | {"source_text": None}, "process_claim", 0, "weak_grounding"),
    "blank text": (FULL | {"source_text": " \n"}, "process_claim", 0, "weak_grounding"),
    "bibliography": (FULL | {"provenance_type": "Bibliography"}, "unsupported_claim", 0, "reject_or_low_trust_provenance"),
    "review table": (FULL | {"provenance_type": "review table"}, "secondary_summary_claim", 0, "secondary_only"),
    "own table": (FULL | {"provenance_type": "table"}, "performance_claim", 2, "table_metric_only_requires_body_pairing"),
    "table of others": (FULL | {"provenance_type": "table", "source_text": "Literature summary of FE"}, "secondary_summary_claim", 0, "secondary_only"),
    "caption": (FULL | {"provenance_type": "figure_caption", "source_text": "Figure 1. Outlet over time"}, "unsupported_claim", 0, "context_only_caption"),
    "paired caption": (FULL | {"provenance_type": "figure_caption", "paired_body_evidence": "true"}, "process_claim", 4, "process_partial"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, *(case[0].get(c) for c in COLUMNS)) for name, case in CASES.items()]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ("name", *COLUMNS)))
    return {r["name"]: r for r in rights.adjudicate(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    _, claim_type, rank, status = CASES[name]
    row = found[name]
    assert (row.claim_type, row.boundary_rank, row.admissibility_status) == (claim_type, rank, status)
    assert row.maximum_supported_boundary == rights.LADDER[rank]


def test_what_is_lacking(found):
    only = found["efficiency only"]
    assert {"n2_claim_without_15n", "fe_without_complete_measurement_matrix"} == set(only.overclaim_risk_flags)
    assert only.required_controls == ["15N2 isotope validation", "Ar/N2-free blank", "NOx/nitrate/nitrite screening", "contamination-source accounting", "NH3 yield paired with FE"]
    assert "nh3_yield" in only.missing_boundary_fields and "reactor_type" not in only.missing_boundary_fields
    assert "capture_route" in found["process without capture"].missing_boundary_fields
    assert found["nitrate"].missing_boundary_fields[-1] == "nitrogen_balance"
    assert found["nitrate"].required_controls == ["nitrate/nitrite source accounting", "nitrogen mass balance", "NOx/nitrate/nitrite screening"]
    assert found["reactor of hydrogen without its source"].overclaim_risk_flags == ["hor_claim_missing_hydrogen_source"]
    assert "flow_claim_missing_outlet_or_wetting" in found["process in a flow cell that tells no outlet"].overclaim_risk_flags
    assert "plant_facing_without_process_closure" in found["plant"].overclaim_risk_flags
    assert found["plant"].recommended_experiment[-1].startswith("Add process closure")
    assert found["no text"].overclaim_risk_flags[-1] == "weak_source_grounding"


def test_checks_and_provenance(found):
    assert found["process"].validation_gates == {"isotope_15N": "yes", "blank_control": "yes", "nox_control": "yes", "contamination_control": "yes", "quantification_method": "unclear"}
    assert set(found["review"].validation_gates.values()) == {"secondary_only"}
    assert found["bibliography"].overclaim_risk_flags == ["text_class_provenance_conflict", "low_trust_provenance"]
    assert found["bibliography"].required_controls == []
    assert found["caption"].support_hint_boundary == "reactor_legibility" and found["process"].support_hint_boundary == "unsupported_or_secondary"
    assert found["own table"].required_controls[-1] == "pair_with_primary_body_text"
    assert found["no class"].text_class is None and found["no class"].missing_boundary_fields == ["primary performance source class", "nitrogen_source_disambiguation"]


def test_a_denied_check_is_a_no(spark):
    rows = [("blank control yes",), ("no specified blank was run",), ("an argon blank; without blank later",), ("none",), (None,)]
    df = spark.createDataFrame(rows, "source_text string")
    states = [r.validation_gates["blank_control"] for r in rights.adjudicate(df).collect()]
    assert states == ["yes", "no", "yes", "missing", "missing"]


def test_ladder(spark):
    yes, no = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        rights.climb([("cell_metric", yes), ("process_partial", yes)], [("reactor_legibility", yes)]).alias("capped"),
        rights.climb([("cell_metric", yes)], [("reactor_legibility", yes), ("process_partial", yes)]).alias("below"),
        rights.climb([("cell_metric", no)], []).alias("none"), rights.climb([("process_partial", F.lit(None).cast("boolean"))], [("cell_metric", no)]).alias("null"),
        rights.rank(F.lit("nothing known")).alias("unknown"), rights.rank(F.lit(None).cast("string")).alias("lacking"), rights.boundary_of(F.lit(5)).alias("top"),
    ).first()
    assert tuple(row) == (3, 2, 0, 0, 0, 0, "plant_facing_insufficient")


def test_best_of_a_group(spark):
    rows = [("a", "cell_metric"), ("a", "process_partial"), ("a", "process_partial"), ("b", None), (None, "cell_metric")]
    got = rights.best_supported(spark.createDataFrame(rows, "paper string, b string"), ["paper"], "b").collect()
    assert {tuple(r) for r in got} == {("a", "process_partial", 2), ("b", "unsupported_or_secondary", 1), (None, "cell_metric", 1)}


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "source_text string, boundary int, hint string")
    assert rights.adjudicate(df).collect() == []
    assert rights.adjudicate(df).columns[:3] == ["source_text", "boundary", "hint"]
