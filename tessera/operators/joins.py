"""Joins whose build side has one row a key, by explicit rules for repeated keys, and joins by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import present


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row by `order` of each key. Rows with a missing key go."""
    # A struct of the ordering's ranks would shuffle whole rows; the window sorts them once, within their key.
    ranked = df.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def first_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    return keep_one(df.where(present(F.col(key))), [key], [F.col(position).asc()])


def last_wins(df: DataFrame, key: str, position: str) -> DataFrame:
    return keep_one(df.where(present(F.col(key))), [key], [F.col(position).desc()])


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """`left` with `columns` of `right`, by the first pair of keys (left's, right's) that finds a row.

    `right` has one row for each value of each of its keys.
    """
    found = left
    for n, (own, other) in enumerate(keys):
        side = right.where(F.col(other).isNotNull()).select(F.col(other).alias(f"_key{n}"), F.struct(*columns).alias(f"_row{n}"))
        found = found.join(side, found[own] == side[f"_key{n}"], "left")
    row = F.coalesce(*(F.col(f"_row{n}") for n in range(len(keys))))
    found = found.withColumn("_row", row)
    return found.select(*left.columns, *(F.col(f"_row.{c}").alias(c) for c in columns))


def by_precedence(left: DataFrame, sides: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """`left` with each side joined on `key`; a column that several have comes from the first in which it is present."""
    found, held = left, {c: [F.col(f"_0.{c}")] for c in left.columns}
    found = left.alias("_0")
    for n, (side, side_key) in enumerate(sides, 1):
        found = found.join(side.alias(f"_{n}"), F.col(f"_0.{key}") == F.col(f"_{n}.{side_key}"), "left")
        for c in side.columns:
            if c != side_key:
                held.setdefault(c, []).append(F.col(f"_{n}.{c}"))
    return found.select(*(F.coalesce(*(F.when(present(x), x) for x in xs)).alias(c) for c, xs in held.items()))


def within_range(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, reach: int, prefix: str = "other_") -> DataFrame:
    """Pairs with equal keys whose positions differ by `reach` at most.

    Positions fall into cells of width `reach`; a row of `right` is in its own cell and both beside it. So the join is
    on keys and cell, and a key with many rows is dealt out by cells instead of being compared with itself.
    """
    cell = F.floor(F.col(position) / reach)
    other = right.select(*(F.col(c).alias(prefix + c) for c in right.columns))
    own_cell = F.floor(F.col(prefix + position) / reach)
    other = other.withColumn("_cell", F.explode(F.array(own_cell - 1, own_cell, own_cell + 1)))
    own = left.withColumn("_own_cell", cell)
    same = F.col("_own_cell") == F.col("_cell")
    for k in keys:
        same = same & (F.col(k) == F.col(prefix + k))
    found = own.join(other, same).where(F.abs(F.col(position) - F.col(prefix + position)) <= reach)
    return found.drop("_cell", "_own_cell")


def nearest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """`left` with `columns` of the last row of `right` at or before its position, within equal keys.

    Both sides are sorted together once; each row then carries the latest values of the other side. With a `width`, a
    key's rows are dealt out by cells of positions, and each cell begins with what the cells ahead of it end with: so a
    key with many rows is not one task's work.
    """
    cell = F.floor(F.col(position) / width).cast("long") if width else F.lit(0).cast("long")
    kind = _struct_type(right, columns)
    own = left.withColumn("_from", F.lit(1)).withColumn("_row", F.lit(None).cast(kind)).withColumn("_cell", cell)
    other = right.select(*keys, position, F.struct(*columns).alias("_row"), F.lit(0).alias("_from"), cell.alias("_cell"))
    both = own.unionByName(other, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_cell").orderBy(position, "_from").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_row", ignorenulls=True).over(order)).where("_from = 1")
    if width:
        ends = both.groupBy(*keys, "_cell").agg(F.max_by(F.col("_row"), F.when(F.col("_from") == 0, F.col(position))).alias("_end"))
        ahead = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "_cell", F.last("_end", ignorenulls=True).over(ahead).alias("_carried"))
        found = found.join(ends, [*keys, "_cell"]).withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select(*left.columns, *(F.col(f"_last.{c}").alias(c) for c in columns))


def _struct_type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): the keys that only one of them has, as left or right."""
    a, b = left.select(*keys).distinct().withColumn("_l", F.lit(True)), right.select(*keys).distinct().withColumn("_r", F.lit(True))
    found = a.join(b, list(keys), "full").where("_l is null or _r is null")
    return found.select(*keys, F.when(F.col("_l").isNotNull(), "left").otherwise("right").alias("side"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of `child` whose key `parent` does not have."""
    return child.join(parent.select(F.col(parent_key).alias("_parent")).distinct(), F.col(key) == F.col("_parent"), "left_anti")
