"""The domain's families on literal texts."""

from __future__ import annotations

import pytest

from tessera.operators import domain

CASES = [
    ("We studied electrochemical N2 reduction to ammonia under 15N2.", None, None, "eNRR", "high", False),
    ("The NRR was run in water", None, None, "eNRR", "high", False),
    ("Lithium-mediated nitrogen reduction in THF with LiClO4", None, None, "LiNRR", "high", False),
    ("Li plating and protonation of lithium nitride", None, None, "LiNRR", "high", False),
    ("Electrocatalytic nitrate reduction to ammonia (NO3RR)", None, None, "NO3RR", "high", False),
    ("A nitrate feed of 0.1 M was used", None, None, "NO3RR", "high", False),
    ("Nitrate contamination was excluded in screening nitrate", None, None, "unclear", "unclear", False),
    ("Nitrite to ammonia conversion", None, None, "NO2RR", "high", False),
    ("Nitric oxide electroreduction", None, None, "NORR", "high", False),
    ("NO gas as nitrogen source next to NOx", None, None, "unclear", "unclear", False),
    ("N2 reduction and nitrite reduction reaction", None, None, "mixed", "medium", True),
    ("Nitrate reduction compared with earlier benchmark N2 reduction; nitrate to ammonia", None, None, "NO3RR", "high", False),
    ("ether and LiTFSI", None, None, "unclear", "unclear", False),
    ("nothing", "A nitrate-to-ammonia cell", None, "NO3RR", "high", False),
    ("nothing", None, "NO3RR", "NO2RR", "high", True),
    (None, None, None, "unclear", "unclear", False),
    ("", None, "li_nrr", "LiNRR", "high", False),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for k, (text, title, stated, *_) in enumerate(CASES):
        rows.append((k, text, "N2 to NH3" if k == 13 else None, title, "Nitrite-reduction" if k == 14 else stated))
    rows[14] = (14, "nitrate to ammonia", None, None, "Nitrite-reduction")
    df = spark.createDataFrame(rows, "k int, text string, abstract string, title string, stated string")
    assert domain.with_family(df.limit(0), "text").count() == 0
    return {r.k: r for r in domain.with_family(df, "text", "title", None, "stated").collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_families(found, k):
    row = found[k]
    assert (row.family, row.family_confidence, row.family_conflict) == CASES[k][3:], row.family_signals


def test_scopes_defaults_and_weights(spark, found):
    assert found[0].family_scope == "explicit_span" and found[13].family_scope == "section_context" and found[15].family_scope == "fallback"
    assert "title:nitrate_to_ammonia" in found[13].family_signals
    df = spark.createDataFrame([("x", "nitrite to ammonia")], "text string, abstract string")
    row = domain.with_family(df, "text", None, "abstract").first()
    assert {s.family: s.points for s in row.family_scores}["NO2RR"] == 16 and row.family == "NO2RR"
    row = domain.with_family(df, "text", default="eNRR").first()
    assert (row.family, row.family_confidence, row.family_scope) == ("eNRR", "low", "fallback")


def test_lithium_subsumes_plain_nitrogen_reduction(spark):
    row = domain.with_family(spark.createDataFrame([("lithium-mediated N2 reduction with n2 feed, li+ and ether",)], "text string"), "text").first()
    points = {s.family: s.points for s in row.family_scores}
    assert points["eNRR"] == 3 and row.family == "LiNRR"


def test_labels(spark):
    rows = spark.createDataFrame([(v,) for v in ("Li-NRR", "nitrate reduction", "NO2RR", "eNRR", "", None, "else", "Mixed source", "unclear")], "v string").select(domain.family_label(domain.F.col("v")).alias("f")).collect()
    assert [r.f for r in rows] == ["LiNRR", "NO3RR", "NO2RR", "eNRR", "unclear", "unclear", "unclear", "mixed", "unclear"]
