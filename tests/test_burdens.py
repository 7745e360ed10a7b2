"""Hidden burdens on literal rows: hints, families, the matrix, low trust, severity and awkward rows."""

from __future__ import annotations

import pytest

from tessera.operators import burdens

CASES = [
    ("The THF electrolyte was  replaced", None, "LiNRR", False, ["solvent_management_tax"], "medium"),
    ("The THF electrolyte was replaced", None, "eNRR", False, [], "low"),
    ("Nitrate and NOx were screened", None, None, None, ["contamination_tax"], "medium"),
    ("A Faradaic efficiency of 61 % at high current density", 61.0, "eNRR", False, ["measurement_matrix_tax"], "high"),
    ("A Faradaic efficiency of 12 % and impurity", 12.0, "NO3RR", False, ["contamination_tax", "measurement_matrix_tax"], "high"),
    ("FE of 12 %", 12.0, "other", False, [], "low"),
    ("SEI, gas diffusion and solvent", None, "unclear", False, ["solvent_management_tax", "resistance_or_renewal_tax", "wetting_outlet_capture_tax"], "high"),
    ("Ammonia yield with solvent", None, "LiNRR", True, ["measurement_matrix_tax"], "medium"),
    ("nitrite only", None, "eNRR", True, ["contamination_tax"], "high"),
    (None, None, None, None, [], "low"),
    ("", None, "", False, [], "low"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t, e, f, low, "") for k, (t, e, f, low, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, text string, fe double, family string, low boolean, state string")
    made = burdens.with_burdens(df, "text", "fe", {"product state": ["state"]}, "family", "low")
    assert burdens.with_burdens(df.limit(0), "text").count() == 0
    return made.orderBy("k").collect()


def test_burdens_and_severity(found):
    assert [(r.burdens, r.severity) for r in found] == [(b, s) for *_, b, s in CASES]


def test_measurements_that_are_missing(found):
    assert found[0].missing_measurements == ["solvent inventory", "electrolyte replacement or recycle", "donor/additive consumption"]
    assert found[3].missing_measurements == ["NH3 yield", "energy efficiency", "voltage or potential", "runtime or stability", "product state"]
    assert found[7].missing_measurements == ["primary_body_text_required", "energy efficiency", "voltage or potential", "current density", "runtime or stability", "product state"]
    assert found[9].missing_measurements == []


def test_a_text_is_brought_into_form_once(spark):
    found = burdens.with_burdens(spark.createDataFrame([("a",)], "text string"), "text")
    assert found.columns == ["text", "burdens", "missing_measurements", "severity"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
