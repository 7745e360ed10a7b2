"""The pipeline's stages against brute force on a small corpus, and the registered queries against their SQL."""

from __future__ import annotations

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries
from tests.llm.test_ops import LONG, brute_groups, brute_targets, near, prose, words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(k, rng.randint(60, 200)) for k in range(120)]
    texts += [near(texts[k], rng, 2) for k in range(30)] + [texts[5]] * 4 + ["".join(rng.choice("%$#@^XQZ") for _ in range(400)) for _ in range(10)]
    texts += [texts[7] + " write to ann.lee7@mail.example.com or call +1 (988) 555-2485", None, "", LONG]
    rows = [(k, t, "en" if k % 7 else None, rng.choice(["a", "b", "c", None]), len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        if name != "pack":
            assert docs.columns == columns, name
            assert all(r.n_chars == len(r.text or "") for r in rows), name
        if name == "quality":
            gone = set(before) - {r.doc_id for r in rows}
            assert set(range(154, 164)) <= gone and len(gone & set(range(154))) <= 4
        elif name == "near_duplicates":
            ids = sorted(before)
            classes, _ = brute_groups([before[i].text for i in ids])
            assert sorted(r.doc_id for r in rows) == sorted({ids[c] for c in classes})
        elif name == "surrogates":
            for r in rows:
                if r.text != before[r.doc_id].text:
                    assert "ann.lee7" not in r.text and "555-2485" not in r.text
            assert len(rows) == len(before)
        elif name == "mix":
            sizes = collections.Counter()
            for r in before.values():
                sizes[r.source] += len(words_of(r.text))
            order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
            wanted = brute_targets(sizes, {s: (5, 2, 1)[j % 3] for j, s in enumerate(order)})
            got = collections.Counter()
            for r in rows:
                got[r.source] += len(words_of(r.text))
            assert all(abs(got[s] - wanted[s]) <= 1 for s in sizes)
        else:
            mixed = spark.read.parquet(f"{tmp_path}/mix")
            assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
            assert collections.Counter(r.doc_id for r in rows if r.start == 0) == collections.Counter(r.doc_id for r in mixed.collect())
        before = {r.doc_id: r for r in rows}


def test_run_gives_the_last_stage(spark, corpus):
    found = corpus_pipeline.run(spark, corpus)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(found.columns)
    fills = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert fills[0] <= 4096 and fills[1] > 0


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "surrogates", "mix", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, con.sql(queries.ORACLES[name]).project(", ".join(columns)).fetchall()))


@pytest.mark.parametrize("name", sorted(n for n in set(queries.QUERIES) - set(queries.ORACLES) if not n.startswith(("op11_", "op13_"))))
def test_query_gives_a_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op4") else "documents"
    rows = queries.QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert rows.count() >= n if name.startswith("op2") else rows.count() == n


def test_registered_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
