"""Review sheets: rule records with what other sources say of them, weighted reasons, agreement between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_missing, label, record_key
from tessera.operators.joins import first_wins


def keyed(df: DataFrame, ids: Sequence[str], position: str) -> DataFrame:
    """`df` with `record_key`, by the first of the ids that is there; of rows with one key the first stays."""
    return first_wins(df.withColumn("record_key", record_key(*(F.col(c) for c in ids))), "record_key", position)


def merge(rules: DataFrame, others: dict[str, DataFrame], ids: Sequence[str], position: str) -> DataFrame:
    """All rule records, each with a struct (or null) of every other source's first record of the same key."""
    found = rules.withColumn("record_key", record_key(*(F.col(c) for c in ids)))
    for name, df in others.items():
        have = [c for c in ids if c in df.columns]
        side = keyed(df, have, position)
        side = side.select(F.col("record_key").alias("_key"), F.struct(*(c for c in df.columns if c != position)).alias(name))
        found = found.join(side, F.col("record_key") == F.col("_key"), "left").drop("_key")
    return found


def mismatches(pairs: Sequence[tuple[str, Column, Column]]) -> Column:
    """The names of the fields in which two sources differ, where both are there, as array<string>."""
    return F.array_compact(F.array(*(F.when(~is_missing(a) & ~is_missing(b) & (F.lower(label(a)) != F.lower(label(b))), F.lit(name)) for name, a, b in pairs)))


def validate(df: DataFrame, required: Sequence[str] = (), allowed: dict[str, Sequence[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """`df` with `errors`: a message for each missing column value, unknown label and value out of range."""
    found = [F.when(is_missing(F.col(c)), F.lit(f"{c} is required")) for c in required]
    found += [F.when(~is_missing(F.col(c)) & ~F.col(c).isin(*values), F.concat(F.lit(f"{c} has unknown value "), F.col(c).cast("string"))) for c, values in (allowed or {}).items()]
    found += [F.when(~F.col(c).cast("double").between(low, high), F.lit(f"{c} is out of range")) for c, (low, high) in (ranges or {}).items()]
    return df.withColumn("errors", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def migrate(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """`df` with columns that it lacks filled by their defaults, and `migration_warnings` naming them."""
    lacking = [c for c in defaults if c not in df.columns]
    warned = F.array(*(F.lit(f"{c} set to its default") for c in lacking)) if lacking else F.array().cast("array<string>")
    return df.withColumns({c: F.lit(defaults[c]) for c in lacking} | {"migration_warnings": warned})
