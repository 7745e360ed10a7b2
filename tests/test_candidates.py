"""Candidate windows against plain loops over sentences and intervals."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import candidates


def plain_windows(text, most):
    if len(text) <= most:
        return [(0, len(text))]
    sentences = [m.span() for m in re.finditer(r"[^.!?\n]+(?:[.!?]+|\Z)", text)]
    if not sentences:
        return [(k, min(len(text), k + most)) for k in range(0, len(text), most)]
    found, (start, end) = [], sentences[0]
    for a, b in sentences[1:]:
        if b - start > most and end > start:
            found.append((start, end))
            start = a
        end = b
    return [*found, (start, end)]


def test_windows_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "c", ". ", "! ", "?", "\n", "ü🙂", "..."]) for _ in range(rng.randint(1, 80))) for _ in range(300)] + ["no end at all " * 5, "....", "\n" * 50, "x" * 41 + "."]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", candidates.sentence_windows(F.col("t"), 40).alias("w")).collect()
    for r in rows:
        assert [tuple(w) for w in r.w] == plain_windows(texts[r.k], 40), texts[r.k]


def test_candidates_of_the_domain(spark):
    long = "Nothing here. " * 5 + "The ammonia yield was measured by NMR. " + "Still nothing here. " * 5
    rows = [(1, 100, "The FE of a flow cell, and 15N."), (1, 100, "The FE of a flow cell, and 15N."), (2, 0, long), (3, 0, "prose"), (4, 0, None), (5, 0, " \n")]
    nodes = spark.createDataFrame(rows, "document_id int, start int, text string")
    found = candidates.candidates(nodes, most=60).orderBy("document_id", "candidate_start").collect()
    first, second = found
    assert (first.candidate_kind, first.trigger_signals, first.candidate_score, first.candidate_priority, first.generation_method) == ("validation_signal", ["validation_signal", "performance_signal", "reactor_signal"], 0.65, 2, "whole_source_node")
    assert (first.candidate_start, first.candidate_end) == (100, 131)
    assert second.generation_method == "bounded_sentence_window" and second.candidate_kind == "quantification_signal"
    assert long[second.candidate_start : second.candidate_end] == second.candidate_text and "NMR." in second.candidate_text
    assert {tuple(r) for r in candidates.summary(candidates.candidates(nodes, most=60), nodes).collect()} == {(1, 2), (0, 3)}
    assert candidates.candidates(nodes.limit(0)).collect() == []


def plain_merge(intervals, gap):
    found = []
    for a, b in sorted(intervals):
        if found and a <= found[-1][1] + gap:
            found[-1] = (found[-1][0], max(b, found[-1][1]), found[-1][2] + 1)
        else:
            found.append((a, b, 1))
    return found


def test_merged_equals_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(d, a, a + rng.randint(0, 60)) for d in range(6) for a in (rng.randint(0, 900) for _ in range(rng.randint(1, 40)))] + [(None, 5, 9), (None, 8, 12)]
    df = spark.createDataFrame(rows, "d int, a int, b int").repartition(3)
    for gap in (0, 7):
        got = {}
        for r in candidates.merged(df, ["d"], "a", "b", gap, cell=50).orderBy("d", "start").collect():
            got.setdefault(r.d, []).append((r.start, r.end, r.n))
        assert got == {d: plain_merge([(a, b) for e, a, b in rows if e == d], gap) for d in {r[0] for r in rows}}


def test_hits_and_windows_around_them(spark):
    text = "xx key yy key zz" + " " * 30 + "key"
    nodes = spark.createDataFrame([(1, 10, text), (2, 0, None), (3, 0, "none")], "d int, start int, text string")
    found = candidates.hits(nodes, "key").orderBy("hit_start")
    assert [(r.hit_start - 10, r.hit_end - 10) for r in found.collect()] == [m.span() for m in re.finditer("key", text)]
    windows = candidates.around(found.withColumn("n", F.lit(10 + len(text))), ["d"], 4, "n").orderBy("start").collect()
    assert [tuple(r) for r in windows] == [(1, 9, 27, 2), (1, 52, 59, 1)]
