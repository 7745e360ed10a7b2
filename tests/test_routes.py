"""Grounding of fields, and routes from gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import grounding, routes


def test_grounding(spark):
    df = spark.createDataFrame([("d", "The FE of 12.5 % with Ar blank", 12.5, "yes", None, "unclear")], "id string, text string, fe double, blank string, x string, y string")
    rows = {r.field: r for r in grounding.ground(df, "text", ["fe", "blank", "x", "y"]).collect()}
    assert {k: r.status for k, r in rows.items()} == {"fe": "explicit", "blank": "inferred", "x": "missing", "y": "unclear"}
    assert "12.5" in rows["fe"].snippet and rows["blank"].risk and rows["fe"].risk is None
    row = grounding.summary(grounding.ground(df, "text", ["fe", "blank", "x", "y"])).first()
    assert (row.explicit, row.missing, row.inferred, row.unclear, row.risk_flags) == (1, 1, 1, 1, 1)
    assert grounding.ground(df.limit(0), "text", ["fe"]).count() == 0


def test_answers(spark):
    texts = ['Sure: [{"a": 1}, {"a": 2}] done', 'x {"a": 3} y', "none", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = {r.k: r.r and [x.a for x in r.r] for r in df.select("k", grounding.answer_records(F.col("t"), "a int").alias("r")).collect()}
    assert found == {0: [1, 2], 1: [3], 2: None, 3: None, 4: None}


def test_titles_and_tokens(spark):
    df = spark.createDataFrame([("A  title", "a TITLE"), ("abc", "xyz"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(grounding.title_likeness("a", "b")).collect()] == [1.0, 0.0, None]
    assert tuple(spark.range(1).select(grounding.token_bounds(F.lit("x" * 10)).alias("t")).first().t) == (3, 4)


def test_gaps_and_routes(spark):
    df = spark.createDataFrame([("p1", "eNRR", None, 1.0), ("p2", "eNRR", "yes", None), ("p3", "NO3RR", "yes", 2.0)], "id string, family string, blank string, fe double")
    found = routes.gaps(df, "id", {"no blank": F.col("blank").isNull(), "no efficiency": F.col("fe").isNull()})
    made = routes.propose(found.join(df.select("id", "family"), "id"), ["family"], "id").collect()
    assert [(r.family, r.gaps, r.records) for r in made] == [("eNRR", ["no blank", "no efficiency"], 2)]


def test_feasibility(spark):
    profile = spark.createDataFrame([("nmr", "yes"), ("ic", "0"), ("uv", "2"), ("gc", "no")], "capability string, value string")
    needs = spark.createDataFrame([("r", "isotope", 1, "nmr"), ("r", "nox", 1, "ic"), ("r", "nox", 1, "gc"), ("r", "nox", 2, "ic"), ("q", "blank", 1, "uv")], "route string, item string, option int, capability string")
    found = {r.route: r for r in routes.feasibility(needs, profile, "route", "item").collect()}
    assert (found["r"].feasible, found["r"].infeasible, found["r"].missing, found["r"].status) == (["isotope"], ["nox"], ["ic"], "partial")
    assert found["q"].status == "feasible"


def test_feasibility_by_mandatory_items(spark):
    profile = spark.createDataFrame([("nmr", "yes")], "capability string, value string")
    rows = [("a", "isotope", 1, "nmr", True), ("a", "nox", 1, "ic", True), ("b", "isotope", 1, "nmr", True), ("b", "nox", 1, "ic", False), ("c", "isotope", 1, "nmr", True), ("d", "nox", 1, "ic", False), ("e", "nox", 1, "ic", None)]
    needs = spark.createDataFrame(rows, "route string, item string, option int, capability string, must boolean")
    found = {r.route: r.status for r in routes.feasibility(needs, profile, "route", "item", mandatory="must").collect()}
    assert found == {"a": "infeasible", "b": "partial", "c": "feasible", "d": "partial", "e": "infeasible"}
    assert routes.feasibility(needs.limit(0), profile, "route", "item", mandatory="must").count() == 0


def test_replicates_gates_and_order(spark):
    df = spark.createDataFrame([("a", ["x", "y"], [], "ready", 1, 5.0), ("b", None, ["a", "z"], "late", 0, 9.0)], "route string, m array<string>, needs array<string>, status string, stage int, score double")
    rows = routes.replicates(df, "m", F.lit(3)).collect()
    assert sorted((r.route, r.condition_no, r.condition, r.replicate) for r in rows if r.route == "a") == [("a", k, c, n) for k, c in ((1, "x"), (2, "y")) for n in (1, 2, 3)]
    assert [r.condition for r in rows if r.route == "b"] == [None] * 3
    gated = {r.route: (r.gate, r.lacking) for r in routes.gate_stages(df, spark.createDataFrame([("a",)], "route string"), "route", "needs").collect()}
    assert gated == {"a": ("completed", []), "b": ("blocked", ["z"])}
    assert [r.route for r in routes.ranked(df, "route", "status", ["ready", "late"], "stage", "score").collect()] == ["a", "b"]
