"""Frozen tables: trees of digests by folder and key, what two runs differ in, and held-out ids that leak.

A row's digest is that of its columns in order. Rows fall into buckets by the first digits of their key's hash, as many digits
as keep a bucket small, so that equal tables have equal trees however their rows are dealt. A node's digest is that of its
children in order. Two trees are compared from their roots down, and only the rows of buckets that differ are read again.

Defined results: repeated rows count, as a bucket's digest is over all of them; a null folder and a null key are values of
their own. Columns are compared by name, whatever their order; a column that only one side has is a change of every row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import canonical_json

#: Rows of a bucket, about; each more digit of the hash makes sixteen of one.
BUCKET_ROWS = 4096


def _digest(df: DataFrame, leave_out: Sequence[str] = ()) -> Column:
    return F.sha2(canonical_json(**{c: F.col(c) for c in df.columns if c not in leave_out}), 256)


def digits_for(rows: int) -> int:
    return max(0, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16))) if rows > BUCKET_ROWS else 0


def leaves(df: DataFrame, key: str, folder: str | None = None, digits: int | None = None) -> DataFrame:
    """(folder, bucket, key, digest) of every row; `digits` go by the number of rows unless they are given."""
    digits = digits_for(df.count()) if digits is None else digits
    name = F.coalesce(F.col(folder).cast("string"), F.lit("\0null")) if folder else F.lit("")
    shown = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    return df.select(name.alias("folder"), F.left(F.sha2(shown, 256), F.lit(digits)).alias("bucket"), shown.alias("key"), _digest(df).alias("digest"))


def tree(rows: DataFrame) -> DataFrame:
    """(folder, bucket, level, digest, rows) of all nodes over `leaves`: buckets, what is above them, and the root of each folder, whose bucket is empty."""
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "digest"))), lambda r: F.concat(r["key"], F.lit("="), r["digest"])), "\n"), 256)
    level = rows.groupBy("folder", "bucket").agg(joined.alias("digest"), F.count("*").alias("rows"))
    # A row of every level's own depth: the buckets say how many there are.
    depth = level.agg(F.max(F.length("bucket"))).first()[0] or 0
    found = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        above = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda r: F.concat(r["bucket"], F.lit("="), r["digest"])), "\n"), 256)
        level = level.groupBy("folder", F.left("bucket", F.lit(k)).alias("_up")).agg(above.alias("digest"), F.sum("rows").alias("rows")).withColumnRenamed("_up", "bucket")
        found = found.unionByName(level.withColumn("level", F.lit(k)))
    return found.select("folder", "bucket", "level", "digest", "rows")


def differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(folder, bucket, level, side) of the nodes of two trees that differ: changed, or only in one of them."""
    other = new.select(F.col("folder").alias("_f"), F.col("bucket").alias("_b"), F.col("level").alias("_l"), F.col("digest").alias("_d"))
    both = old.join(other, (F.col("folder") == F.col("_f")) & (F.col("bucket") == F.col("_b")) & (F.col("level") == F.col("_l")), "full")
    side = F.when(F.col("_f").isNull(), "old").when(F.col("folder").isNull(), "new").otherwise("both")
    return both.where("not (digest <=> _d)").select(F.coalesce("folder", "_f").alias("folder"), F.coalesce("bucket", "_b").alias("bucket"), F.coalesce("level", "_l").alias("level"), side.alias("side"))


def changes(old: DataFrame, new: DataFrame, key: str, folder: str | None = None) -> DataFrame:
    """(folder, key, change): the rows that were added, removed or changed. Rows of buckets with equal digests are not compared."""
    digits = digits_for(max(old.count(), new.count()))
    a, b = leaves(old, key, folder, digits), leaves(new, key, folder, digits)
    buckets = differing(tree(a), tree(b)).where(F.col("level") == digits).select("folder", "bucket")
    sides = [x.join(buckets, ["folder", "bucket"], "left_semi").groupBy("folder", "key").agg(F.sort_array(F.collect_list("digest")).alias(name)) for x, name in ((a, "_old"), (b, "_new"))]
    both = sides[0].join(sides[1], ["folder", "key"], "full").where("not (_old <=> _new)")
    clean = lambda c: F.when(F.col(c) != "\0null", F.col(c))
    return both.select(clean("folder").alias("folder"), clean("key").alias("key"), F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed").alias("change"))


def roots(found: DataFrame) -> DataFrame:
    """(folder, digest, rows): what a manifest keeps of each folder."""
    return found.where("level = 0").select("folder", "digest", "rows")


def leaks(held_out: DataFrame, other: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """(id, leak): held-out ids that the other table has, by id, or by the same text under another id."""
    known = other.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    found = held_out.join(known, F.col(id_col) == F.col("_id"), "left_semi").select(id_col, F.lit("same_id").alias("leak"))
    if text_col:
        texts = other.select(F.col(id_col).alias("_id"), F.sha2(text_col, 256).alias("_sha")).where("_sha is not null").distinct()
        own = held_out.select(id_col, F.sha2(text_col, 256).alias("_own"))
        copies = own.join(texts.groupBy("_sha").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")), F.col("_own") == F.col("_sha"))
        found = found.unionByName(copies.where(~F.col("_low").eqNullSafe(F.col(id_col)) | ~F.col("_high").eqNullSafe(F.col(id_col))).select(id_col, F.lit("same_text").alias("leak")))
    return found.distinct()
