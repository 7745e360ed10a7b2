"""Section trees against a plain walk with a stack, on random and literal Markdown."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import outline

TYPES = {"results": "results", "methods": "methods", "abstract": "abstract", "references": "references", "discussion": "discussion"}


def plain(text):
    """(start, end, level, heading, form, path, outline, parent, direct, type, origin, distance, broken)"""
    marks, at, lines = [], 0, text.split("\n")
    for k, line in enumerate(lines):
        line = line.rstrip("\r")
        m, bare = re.match(r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$", line), line.strip()
        if m:
            marks.append((at, len(m[1]), m[2], TYPES.get(m[2].lower(), "unknown"), "marked"))
        elif bare and bare.lower().rstrip(".") in TYPES and (not bare.endswith(".") or bare.lower() == "references."):
            under = re.match(r"^\s*(=+|-+)\s*$", lines[k + 1]) if k + 1 < len(lines) else None
            marks.append((at, 1 if under and under[1][0] == "=" else 2, bare, TYPES.get(bare.lower().rstrip("."), "unknown"), "underlined" if under else "plain"))
        at += len(lines[k]) + 1
    found, stack, counts = [], [], {}
    if not marks or marks[0][0] > 0:
        found.append((0, marks[0][0] if marks else len(text), 0, None, None, [], [], None, "unknown", "unknown", None, None, False))
    for k, (start, level, heading, kind, form) in enumerate(marks):
        if k == 0 and level == 1 and kind == "unknown":
            kind = "title"
        while stack and stack[-1]["level"] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        key = parent["start"] if parent else None
        counts[key] = counts.get(key, 0) + 1
        own = {"level": level, "start": start, "type": kind, "origin": start if kind != "unknown" else None, "distance": 0, "path": [*(parent["path"] if parent else []), heading], "outline": [*(parent["outline"] if parent else []), counts[key]]}
        broken = inherited = False
        if kind == "unknown" and parent:
            broken = level != parent["level"] + 1
            if not broken and parent["type"] not in ("title", "abstract", "unknown"):
                inherited = True
                own.update(type=parent["type"], origin=parent["origin"], distance=parent["distance"] + 1)
        end = marks[k + 1][0] if k + 1 < len(marks) else len(text)
        found.append((start, end, level, heading, form, own["path"], own["outline"], key, kind, own["type"], own["origin"] if inherited else None, own["distance"] if inherited else None, broken))
        stack.append(own)
    return found


def label(heading):
    key = F.rtrim(F.lower(heading), F.lit("."))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), key), F.lit("unknown"))


COLUMNS = ("start", "end", "level", "heading", "form", "path", "outline", "parent_start", "direct_type", "type", "inherited_from", "distance", "broken")


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {}
    for r in outline.sections(docs, label=label).orderBy("doc_id", "section_no").collect():
        got.setdefault(r.doc_id, []).append(tuple(r[c] for c in COLUMNS))
        assert r.section_no == len(got[r.doc_id])
    for k, text in enumerate(texts):
        assert got.get(k, []) == ([] if text is None else plain(text)), (k, text)


def test_random_documents_equal_a_plain_walk(spark):
    rng = random.Random(4)
    parts = ["# Results", "## methods ##", "### part", "#### deep", "###### deepest", "  ## other", "    # no heading", "Results", "methods.", "references.", "Discussion\n===", "abstract\n---", "prose of some words here.", "", "a | b", "# Title", "#nothing", "## Abstract\r", "Références 中文"]
    check(spark, ["\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(200)])


def test_awkward_documents(spark):
    check(spark, [None, "", "\n\n", "no heading", "# only", "x\n# late", "Results", "Results\n", "# A\n### skipped\n#### below", "===\n---", "# results\n## a\n### b\n#### c"])


def test_closing_marks(spark):
    rng = random.Random(7)
    check(spark, ["\n".join("#" * rng.randint(0, 3) + "".join(rng.choice("  ##\tab") for _ in range(rng.randint(0, 9))) for _ in range(20)) for _ in range(100)])


def test_a_text_is_read_once_and_stays_where_it_is(spark, tmp_path):
    text = "# A\n" + "word " * 200 + "\n## " + "b " * 5000
    spark.createDataFrame([(k, text) for k in range(20)], "doc_id int, text string").write.parquet(f"{tmp_path}/docs")
    found = outline.sections(spark.read.parquet(f"{tmp_path}/docs"), label=label).select("doc_id", "section_no", "start", "end", "type", F.array_join("outline", ".").alias("outline"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    ahead_of_it = plan[: plan.index("Exchange hashpartitioning")]
    assert "heading#" not in ahead_of_it and plan.count("regexp_extract(") == 2
    assert {(r.start, r.end, r.outline) for r in found.collect()} == {(0, 1005, "1"), (1005, len(text), "1.1")}


def test_the_domain_labels(spark):
    docs = spark.createDataFrame([(1, "# A paper\n\n## 2. Results and Discussion\ntext\n### Cell tests\nmore\nReferences\n[1] x")], "doc_id int, text string")
    rows = outline.sections(docs).orderBy("start").collect()
    assert [(r.heading, r.type, r.outline) for r in rows] == [("A paper", "title", [1]), ("2. Results and Discussion", "results_and_discussion", [1, 1]), ("Cell tests", "results_and_discussion", [1, 1, 1]), ("References", "references", [1, 2])]


@pytest.mark.parametrize("numbers", [[], [5], list(range(100)), [3] * 31, [3] * 32, [3] * 33, list(range(1000))])
def test_sums_ahead(spark, numbers):
    row = spark.createDataFrame([(numbers,)], "n array<int>").select(T.sums_ahead(F.col("n")).alias("s")).first()
    assert row.s == [sum(numbers[:k]) for k in range(len(numbers))]


def test_pieces(spark):
    texts = ["a\n\nbb\n", "", "x", "\n", "ü🙂\nz"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.pieces(F.col("t"), "\n").alias("p")).orderBy("k").collect()
    for text, row in zip(texts, rows):
        assert [p.text for p in row.p] == text.split("\n")
        assert all(text[p.start : p.start + len(p.text)] == p.text for p in row.p)
