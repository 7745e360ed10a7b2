"""Trees of digests: equal for equal tables, and one changed row is named."""

from __future__ import annotations

from tessera.operators import freeze

SCHEMA = "paper string, id int, text string, n double"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


ROWS = [(f"p{k % 3}", k, f"text {k}", k / 7) for k in range(300)] + [(None, None, None, None), ("p0", 5, "again", None), ("p0", 5, "again", None)]


def test_equal_tables_have_equal_trees(spark, monkeypatch):
    monkeypatch.setattr(freeze, "BUCKET_ROWS", 4)
    a, b = (freeze.tree(freeze.leaves(table(spark, ROWS, n), "id", "paper")) for n in (1, 5))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    assert freeze.differing(a, b).count() == 0
    assert {r.folder: r.rows for r in freeze.roots(a).collect()} == {"p0": 102, "p1": 100, "p2": 100, "\0null": 1}
    assert {r.level for r in a.select("level").distinct().collect()} == {0, 1, 2}


def test_changes_are_named(spark, monkeypatch):
    monkeypatch.setattr(freeze, "BUCKET_ROWS", 4)
    new = [r for r in ROWS if r[1] != 17]
    new[new.index(("p2", 50, "text 50", 50 / 7))] = ("p2", 50, "text 50!", 50 / 7)
    new.append(("p9", 999, None, None))
    new.remove(("p0", 5, "again", None))
    got = {tuple(r) for r in freeze.changes(table(spark, ROWS), table(spark, new), "id", "paper").collect()}
    assert got == {("p2", "17", "removed"), ("p2", "50", "changed"), ("p9", "999", "added"), ("p0", "5", "changed")}
    nodes = freeze.differing(*(freeze.tree(freeze.leaves(table(spark, x), "id", "paper", 2)) for x in (ROWS, new)))
    assert {r.folder for r in nodes.where("level = 0").collect()} == {"p0", "p2", "p9"}
    assert freeze.changes(table(spark, ROWS), table(spark, ROWS, 7), "id").count() == 0
    assert [tuple(r) for r in freeze.changes(table(spark, []), table(spark, [ROWS[0]]), "id").collect()] == [("", "0", "added")]


def test_leaks(spark):
    held = table(spark, [("p", 1, "one", None), ("p", 2, "two", None), ("p", 3, "three", None), ("p", 4, None, None)])
    other = table(spark, [("p", 1, "else", None), ("p", 9, "two", None), ("p", 3, "three", None), ("p", 8, None, None)])
    assert {tuple(r) for r in freeze.leaks(held, other, "id", "text").collect()} == {(1, "same_id"), (3, "same_id"), (2, "same_text")}
    assert freeze.leaks(held, other.limit(0), "id", "text").count() == 0
