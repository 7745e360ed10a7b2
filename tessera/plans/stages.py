"""Staged runs: each stage's rows are written once, with a manifest by which later runs know whether it still holds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import content_hash, exists

Stage = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Done:
    name: str
    inputs: str
    output: str
    rows: int
    reused: bool


def run_stages(spark: SparkSession, base: str, inputs: dict[str, DataFrame], stages: Sequence[tuple[str, Stage]]) -> tuple[dict[str, DataFrame], list[Done]]:
    """The tables by name after all stages, and what was done.

    A stage is made anew if its inputs' hash is not that of its manifest; then so are all stages behind it whose inputs change with it.
    """
    tables, hashes, done = dict(inputs), {k: content_hash(v) for k, v in sorted(inputs.items())}, []
    for name, stage in stages:
        key = "|".join(f"{k}={v}" for k, v in sorted(hashes.items()))
        folder = f"{base}/{name}"
        held = spark.read.json(f"{folder}/manifest").first() if exists(spark, f"{folder}/manifest/_SUCCESS") else None
        reused = bool(held and held["inputs"] == key)
        if not reused:
            stage(tables).write.mode("overwrite").parquet(f"{folder}/rows")
        tables[name] = spark.read.parquet(f"{folder}/rows")
        hashes[name] = content_hash(tables[name])
        if not reused:
            rows = tables[name].count()
            spark.createDataFrame([(name, key, hashes[name], rows)], "stage string, inputs string, output string, rows long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        else:
            if hashes[name] != held["output"]:
                raise ValueError(f"{name}: its rows are not those of its manifest")
            rows = held["rows"]
        done.append(Done(name, key, hashes[name], rows, reused))
    return tables, done


def diagnostics(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, failures, passed): how many rows each check found; none is a pass."""
    counted = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed")) for name, df in checks.items()]
    found = counted[0]
    for c in counted[1:]:
        found = found.unionByName(c)
    return found
