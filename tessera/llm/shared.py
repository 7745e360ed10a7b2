"""What the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and DuckDB pattern of a word: anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, computed once into the folder that spark.checkpoint.dir names, so that later stages and lost executors read it there."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


class Scratch:
    """Tables written into a folder of their own under spark.checkpoint.dir, to be dropped together once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="scratch-")
        self.folder = f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        """`df`, written and read again: compressed and by column, unlike a checkpoint."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def surrogate_key(spark: SparkSession) -> str:
    """The key of surrogates, from spark.tessera.surrogates.key; without one, a known key for trials."""
    return spark.conf.get("spark.tessera.surrogates.key", "known key for trials")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores ahead as no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: Column) -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


#: A key with more than this share of all rows is hot, and dealt over so many tasks.
HOT, SALTS = 1 / 256, 64


def hot_keys(counts: DataFrame, key: str, count: str) -> list:
    """The keys with more than HOT of all rows: fewer than 1 / HOT, whatever the input's size."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(count) > HOT * total).select(key).collect()]


def salted_join(rows: DataFrame, facts: DataFrame, key: str, row: list[Column], hot: list, how: str = "inner") -> DataFrame:
    """`rows` with the one row that `facts` holds for their key. A hot key's rows are dealt by the hash of `row`, and its facts repeated."""
    part, salt = free(facts, free(rows, "_part")), F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")
    parts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.withColumn(part, F.when(F.col(key).isin(hot), salt).otherwise(F.lit(0)))
    return dealt.join(facts.select("*", F.explode(parts).alias(part)), [key, part], how).drop(part)


def running_sum(df: DataFrame, by: str, bucket: str, within: list[Column], value: Column, facts: DataFrame | None = None) -> DataFrame:
    """`df` with `before`: the sum of `value` over the rows of the same `by` ahead of this one, buckets first in order, then `within`.

    `facts`: more columns by `by`. They come with the buckets' totals, so that no join is on `by` alone.
    """
    sums = df.groupBy(by, bucket).agg(F.sum(value).alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(by).alias("_by"), F.col(bucket).alias("_bucket"), ahead.alias("_ahead"))
    if facts is not None:
        sums = sums.join(facts.withColumnRenamed(by, "_fact"), F.col("_by").eqNullSafe(F.col("_fact"))).drop("_fact")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(by, bucket).orderBy(*within).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = df.withColumn("_inside", inside).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col(bucket) == F.col("_bucket")))
    return found.withColumn("before", F.col("_ahead") + F.col("_inside")).drop("_inside", "_ahead", "_by", "_bucket")
