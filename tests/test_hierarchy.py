"""Prerequisite graphs against a plain search, and gates on literal routes."""

from __future__ import annotations

import random

import pytest

from tessera.operators import hierarchy


def brute(edges):
    needs = {}
    for a, b in edges:
        if a is not None and b is not None:
            needs.setdefault(a, set()).add(b)
    found = {}
    for node in needs:
        depth, now = 0, {node}
        while now:
            depth += 1
            now = {b for a in now for b in needs.get(a, ())} - {b for a, b in found if a == node}
            found |= {(node, b): depth for b in now}
    return found


def test_closure_equals_a_search(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(12)] + [(112, 100), (None, 3), (4, None), (7, 7)]
    df = spark.createDataFrame(edges, "node int, needs int")
    reached = hierarchy.closure(df)
    wanted = brute(edges)
    assert {(r.node, r.needs): r.depth for r in reached.collect()} == wanted
    inside = {a for a, b in wanted if a == b}
    behind = {a for a, b in wanted if b in inside} - inside
    got = {r.node: (r.in_cycle, r.behind_cycle) for r in hierarchy.cycles(reached).collect()}
    assert got == {a: (True, False) for a in inside} | {a: (False, True) for a in behind}
    assert hierarchy.closure(df.limit(0)).count() == 0


SCHEMA = "route_id string, run string, family string, route_type string, priority_label string, priority_score int, parent_route_id string, shared_evidence_group string"
ROUTES = [
    ("b", "r", "f", "baseline_repeatability", None, 5, None, None), ("v", "r", "f", "validation_gap_closure", None, 9, None, None), ("e", "r", "f", "electrolyte_window", None, 7, None, "g"),
    ("w", "r", "f", "water_content_window", None, 8, "e", "g"), ("s", "r", "f", "salt_solvent_window", None, 8, "e", "g"), ("o", "r", "f", "operating_field_matrix", None, 3, "gone", "h"),
    ("p", "r", "f", "product_state_accounting", None, 4, None, None), ("h", "r", "f", "HOR_proton_economy", "defer_until_capability_available", 4, None, None), ("m", "r", "f", "postmortem_failure_analysis", None, 1, None, None),
    ("x", "r", None, "flow_wetting", None, 1, None, None), ("y", "r", "f", "something else", None, 1, None, None),
]


def gated(spark, completed=(), **context):
    routes = spark.createDataFrame(ROUTES, SCHEMA)
    needs = hierarchy.prerequisites(routes, ["run", "family"])
    done = spark.createDataFrame([(c,) for c in completed], "route_id string")
    return {r.route_id: r for r in hierarchy.gates(routes, needs, done, **context).collect()}


def test_prerequisites(spark):
    got = {}
    for r in hierarchy.prerequisites(spark.createDataFrame(ROUTES, SCHEMA), ["run", "family"]).collect():
        got.setdefault(r.route_id, set()).add(r.needs)
    contamination = "r::f::contamination_control"
    assert got == {"v": {"b"}, "e": {"b", "v", contamination}, "w": {"b", "v", contamination}, "s": {"b", "v", contamination}, "o": {"b", "v", contamination}, "p": {"b", "w", "s", "o"}, "h": {"b", "p"}, "m": {"r::f::stability_failure"}, "x": {"r::::baseline_repeatability"}, "y": {"r::f::stability_failure"}}


def test_gates(spark):
    first = gated(spark)
    assert {k: r.stage_gate_status for k, r in first.items()} == {"b": "actionable", "v": "blocked", "e": "non_executable", "w": "blocked", "s": "blocked", "o": "blocked", "p": "blocked", "h": "blocked", "m": "blocked", "x": "blocked", "y": "blocked"}
    assert first["p"].blocked_by_route_ids == ["b", "o", "s", "w"] and first["e"].blocked_by_route_ids == []
    assert (first["p"].stage_rank, first["p"].execution_stage) == (3, "interphase_flow_product_state")
    later = gated(spark, ["b", "w", "s", "o"])
    assert (later["b"].stage_gate_status, later["v"].stage_gate_status, later["p"].stage_gate_status, later["h"].stage_gate_status) == ("completed", "actionable", "actionable", "blocked")
    assert gated(spark, ["b", "v"])["w"].blocked_by_route_ids == ["r::f::contamination_control"]
    assert gated(spark, ["b", "v"], satisfied=["contamination_control"])["w"].stage_gate_status == "actionable"
    assert gated(spark, satisfied=["baseline_repeatability"])["b"].stage_gate_status == "completed"
    assert gated(spark, waived=[2])["w"].stage_gate_status == "waived" and gated(spark, waived=[2])["p"].stage_gate_status == "blocked"
    assert gated(spark, waive_all=True)["p"].stage_gate_status == "waived"
    assert gated(spark, failure=True)["m"].stage_gate_status == "event_triggered"
    assert gated(spark, enforced=False)["p"].stage_gate_status == "actionable" and gated(spark, enforced=False)["h"].stage_gate_status == "blocked"


def test_groups_and_what_comes_next(spark):
    routes = spark.createDataFrame(ROUTES, SCHEMA)
    found = hierarchy.with_children(routes)
    by = {r.route_id: r for r in found.collect()}
    assert by["e"].child_route_ids == ["w", "s"] and by["e"].within_stage_score == 0
    assert by["w"].within_stage_score == by["s"].within_stage_score == 4.0 and by["v"].within_stage_score == 9.0
    assert by["o"].parent_route_id is None and by["o"].child_route_ids is None
    gate = hierarchy.gates(found, hierarchy.prerequisites(routes, ["run", "family"]), routes.where("route_id in ('b', 'v')").select("route_id"), satisfied=["contamination_control"])
    assert {tuple(r) for r in hierarchy.next_actionable(gate, ["run", "family"]).collect()} == {("r", "f", "s", 2)}
    assert hierarchy.with_children(routes.limit(0)).count() == 0


@pytest.mark.parametrize("most", [0, 4, 1000])
def test_long_chains_take_few_rounds(spark, monkeypatch, most):
    rounds = []
    cut = hierarchy._cut
    monkeypatch.setattr(hierarchy, "_cut", lambda df: rounds.append(1) or cut(df))
    monkeypatch.setattr(hierarchy, "MOST_MADE", most)
    n = 20 if most else 6
    # A chain, a circle with a way in, and two ways of unlike length.
    edges = [(k, k + 1) for k in range(n)] + [(100, 101), (101, 102), (102, 103), (103, 101)] + [(200, 201), (201, 202), (202, 203), (200, 203), (203, 204)]
    got = hierarchy.closure(spark.createDataFrame(edges, "node int, needs int")).coalesce(2)
    assert sorted(map(tuple, got.collect())) == sorted((*pair, depth) for pair, depth in brute(edges).items())
    assert len(rounds) <= (7 if most else n + 1)
