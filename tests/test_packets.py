"""Packets against a plain loop over neighbours, and gates and sufficiency on literal rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import packets

SCHEMA = "document_id string, span_no int, length int, shows long, denies long, key string"


def brute(rows, budget):
    found = {}
    docs = {}
    for d, n, length, shows, *_ in rows:
        if d is not None and n is not None:
            docs.setdefault(d, []).append((n, length or 0, shows or 0))
    for d, spans in docs.items():
        spans.sort()
        for i, (n, _, _) in enumerate(spans):
            order = sorted((j for j in range(len(spans)) if j != i), key=lambda j: (abs(i - j), j > i))
            used, taken = 0, []
            for j in order:
                if used + spans[j][1] > budget:
                    break
                used += spans[j][1]
                taken.append(spans[j])
            around = 0
            for t in taken:
                around |= t[2]
            numbers = [n, *(t[0] for t in taken)]
            found[d, n] = ([t[0] for t in taken], used, min(numbers), max(numbers), around)
    return found


def test_neighbourhoods_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(f"d{d}", 3 * k, rng.choice([None, 0, 1, 5, 20, 60]), rng.randrange(16), 0, "k") for d in range(12) for k in range(rng.randint(1, 30))] + [(None, 1, 5, 1, 0, "k"), ("d0", None, 5, 1, 0, "k")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for budget in (0, 40, 100_000):
        got = {(r.document_id, r.span_no): ([s.number for s in r.neighbours], r.used, r.first, r.last, r.around) for r in packets.neighbourhoods(df, budget).collect()}
        assert got == brute(rows, budget)
    assert packets.neighbourhoods(df.limit(0), 10).columns == [*df.columns, "neighbours", "used", "first", "last", "around"]


def test_coverage(spark):
    gates = ["isotope", "blank", "nox", "quantified", "impurity", "balance"]
    spans = spark.createDataFrame([("e1", 0b010000, 0b001000), ("e2", None, None)], "span_id string, shows long, denies long")
    linked = packets.linked_masks(spark.createDataFrame([("t", "e1"), ("t", "e2"), ("t", "gone")], "target_id string, span_id string"), spans)
    assert [tuple(r) for r in linked.collect()] == [("t", 0b010000, 0b001000)]
    rows = spark.createDataFrame([("t", 0b000011, 0b000001, 0b000100)], "target_id string, shows long, denies long, around long").join(linked, "target_id", "left")
    row = packets.coverage(rows, gates).first()
    assert row.gates_covered == dict(zip(gates, packets.STATES))
    assert (row.gates_observed, row.gates_missing, row.gate_status) == (["blank", "nox", "impurity"], ["isotope", "quantified", "balance"], "partial")
    none = packets.coverage(rows.withColumns({c: F.lit(None).cast("long") for c in ("shows", "denies", "around", "linked", "against")}), gates).first()
    assert none.gate_status == "none" and none.gates_missing == gates


def test_sufficiency(spark):
    rows = [(True, False, True, 0, True, True, [], True), (True, False, True, 4, False, False, [], True), (True, False, True, 2, False, False, ["a"], False), (False, False, True, 0, True, True, ["a"], True), (True, True, True, 5, False, False, ["a"], False), (True, False, False, 0, True, True, [], True), (None, None, None, None, None, None, [], None)]
    df = spark.createDataFrame(rows, "p boolean, c boolean, k boolean, r int, re boolean, pr boolean, gates_missing array<string>, m boolean")
    got = packets.sufficiency(df, F.col("p"), F.col("c"), F.col("k"), {"metric": ~F.col("m")}, F.col("r"), F.col("re"), F.col("pr")).collect()
    assert [(r.sufficient_for_claim_support, r.missing, r.context_confidence) for r in got] == [(True, [], "high"), (False, ["reactor_details", "process_boundary"], "medium"), (False, ["metric", "a"], "medium"), (False, [], "medium"), (False, [], "high"), (False, [], "low"), (False, [], "low")]
