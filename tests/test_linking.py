"""Links against all pairs of each paper, and rows for which each of the ten weights counts."""

from __future__ import annotations

import random

from tessera.operators import linking
from tessera.operators.scoring import LINK_WEIGHTS

SCHEMA = "paper_id string, span_id int, span_order int, paragraph int, section int, family string, primary boolean, context_only boolean, family_conflict boolean, roles array<struct<role:string,structured:boolean,phrase:boolean,specific:boolean,relation:boolean>>, place string"
WEIGHTS = dict(LINK_WEIGHTS)


def brute(spans, targets):
    found = {}
    for t in targets:
        kept = {}
        for c in spans:
            if c[0] != t[0] or c[1] == t[1] or c[0] is None or c[2] is None or t[2] is None:
                continue
            for role, structured, phrase, specific, relation in c[9]:
                hint = role == "context_hint"
                if hint != bool(c[7]):
                    continue
                beside = None not in (c[3], t[3]) and abs(c[3] - t[3]) <= 1
                near = c[4] is not None and c[4] == t[4]
                sure = c[5] not in (None, "unclear", "mixed") and t[5] not in (None, "unclear", "mixed")
                if sure and c[5] != t[5]:
                    continue
                held = {"structured": structured, "phrase": phrase and not hint, "adjacent": beside, "same_section": near, "primary": c[6], "family_match": sure, "family_conflict": c[8], "context_only": not c[6], "generic": (hint or phrase) and not specific and not structured}
                score = min(1.0, max(0.0, sum(WEIGHTS[k] for k, v in held.items() if v)))
                if hint and beside:
                    score = max(score, 0.65)
                elif hint and near:
                    score = max(score, 0.60)
                strong = structured or relation or (beside and phrase) or (phrase and role in ("validation", "quantification"))
                score = round(score, 4)
                if (hint or strong) and score >= 0.6:
                    kept.setdefault(role, []).append((-score, abs(c[2] - t[2]), c[1]))
        best = {}
        for role, rows in kept.items():
            for minus, distance, span in sorted(rows)[:2]:
                old = best.get(span, (0, distance, span, set()))
                best[span] = (min(old[0], minus), distance, span, old[3] | {role})
        for place, (minus, distance, span, roles) in enumerate(sorted(best.values(), key=lambda b: b[:3])[:12], 1):
            found[(t[0], t[1], span)] = (-minus, distance, sorted(roles), place)
    return found


def paper(rng, name, n, first=0):
    rows = []
    for k in range(n):
        context = rng.random() < 0.2
        roles = [("context_hint", False, True, False, False)] if context else [(r, rng.random() < 0.5, rng.random() < 0.7, rng.random() < 0.8, rng.random() < 0.1) for r in rng.sample(linking.ROLES[:-1], rng.randint(0, 3))]
        rows.append((name, first + k, 3 * k, k // 2, k // 7, rng.choice([None, "unclear", "a", "a", "a", "b"]), not context and rng.random() < 0.9, context, rng.random() < 0.1, roles, "p"))
    return rows


def test_links_equal_all_pairs(spark):
    rng = random.Random(1)
    spans = [r for k in range(12) for r in paper(rng, f"p{k}", rng.randint(1, 40), 100 * k)] + paper(rng, "long", 300, 10_000) + paper(rng, None, 3, 90_000)
    df = spark.createDataFrame(spans, SCHEMA).repartition(3)
    assert linking.repeated_orders(df).count() == 0
    targets = df.where("span_id % 3 = 0")
    for width in (None, 50):
        rows = linking.links(df, targets, width=width).collect()
        got = {(r.paper_id, r.target_id, r.span_id): (r.score, r.distance, r.roles, r.place) for r in rows}
        assert got == brute(spans, [s for s in spans if s[1] % 3 == 0])
        assert len(rows) == len(got) > 100
        assert linking.across_papers(linking.links(df, targets, width=width), df).count() == 0


def test_each_weight_counts(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(paper(rng, "p", 200), SCHEMA)
    found = linking.scored(linking.pairs(df, df))
    seen = {s for r in found.select("signals").collect() for s in r.signals}
    assert seen == set(WEIGHTS)
    assert {r[0] for r in found.select("rejected").distinct().collect()} == {None, "family_mismatch", "no_strong_signal", "below_threshold"}


def test_awkward_rows(spark):
    rows = [("p", 1, 0, None, None, None, None, None, None, [("validation", None, True, None, None)], ""), ("p", 2, 1, None, None, "a", True, False, False, [("validation", True, True, True, None)], ""), ("p", 3, None, 0, 0, "a", True, False, False, [("validation", True, True, True, True)], ""), ("p", 4, 5, 0, 0, "a", True, False, False, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.target_id, r.span_id) for r in linking.links(df, df).collect()} == {(1, 2), (4, 2)}
    assert linking.links(df.limit(0), df).count() == linking.links(df, df.limit(0)).count() == 0


def test_candidates_come_without_a_join_of_their_own_and_hopeless_classes_not_at_all(spark):
    rng = random.Random(3)
    df = spark.createDataFrame(paper(rng, "p", 60), SCHEMA)
    joins = linking.links(df, df, width=50)._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    # Classes (twice, as cells begin with what the ones ahead end with) and cells; none for candidates.
    assert joins == 3
    weak = spark.createDataFrame([("p", k, k, k, k, "a", False, False, True, [("process", False, True, False, False)], "") for k in range(5)], SCHEMA)
    assert linking._around(weak, weak, None, True).count() == 0 < linking._around(weak, weak, None, False).count()
