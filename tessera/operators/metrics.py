"""Evaluation metrics over rows with a reference and a predicted value. Every metric is one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_missing, present, same_label


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole; `empty` where the whole is 0."""
    return F.when(whole != 0, part / F.nullif(whole.cast("double"), F.lit(0.0))).otherwise(F.lit(empty).cast("double"))


def categorical(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = (), has_row: str | None = None) -> DataFrame:
    """(by, total, correct, missing, accuracy). Missing equals missing; without a prediction row (`has_row` false) nothing is correct."""
    right = same_label(F.col(gold), F.col(predicted))
    if has_row:
        right = right & F.coalesce(F.col(has_row), F.lit(False))
    found = pairs.groupBy(*by).agg(F.count("*").alias("total"), _count(right).alias("correct"), _count(is_missing(F.col(predicted))).alias("missing"))
    return found.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def numeric(pairs: DataFrame, gold: str, predicted: str, absolute: float = 0.0, relative: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """(by, support, within, missing, mean_error, max_error) over rows with a reference value.

    Within: the difference is at most max(relative * the larger magnitude, absolute).
    """
    g, p = F.col(gold), F.col(predicted)
    error = F.abs(g - p)
    close = error <= F.greatest(F.lit(relative) * F.greatest(F.abs(g), F.abs(p)), F.lit(absolute))
    return pairs.where(g.isNotNull()).groupBy(*by).agg(F.count("*").alias("support"), _count(close).alias("within"), _count(p.isNull()).alias("missing"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def unsupported_rate(pairs: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(predicted, unsupported, rate): of the values predicted in `fields` (gold, predicted), those without a reference value."""
    given = sum((_count(present(F.col(p))) for _, p in fields), F.lit(0))
    wrong = sum((_count(present(F.col(p)) & is_missing(F.col(g))) for g, p in fields), F.lit(0))
    return pairs.agg(given.cast("long").alias("predicted"), wrong.cast("long").alias("unsupported")).withColumn("rate", ratio(F.col("unsupported"), F.col("predicted")))


def missing_rate(pairs: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """(expected, missing, rate): of the reference values in `fields` (gold, predicted), those that are not predicted."""
    given = sum((_count(present(F.col(g))) for g, _ in fields), F.lit(0))
    lost = sum((_count(present(F.col(g)) & is_missing(F.col(p))) for g, p in fields), F.lit(0))
    return pairs.agg(given.cast("long").alias("expected"), lost.cast("long").alias("missing")).withColumn("rate", ratio(F.col("missing"), F.col("expected")))


def confusion(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return pairs.groupBy(*by, F.coalesce(F.col(gold).cast("string"), F.lit("<missing>")).alias("gold"), F.coalesce(F.col(predicted).cast("string"), F.lit("<missing>")).alias("predicted")).agg(F.count("*").alias("n"))


def per_label(pairs: DataFrame, gold: str, predicted: str, domain: Sequence[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) for the labels of `domain`, or all that occur."""
    spark = pairs.sparkSession
    sides = pairs.select(F.inline(F.array(F.struct(F.col(gold).cast("string").alias("label"), F.lit("gold").alias("side"), (F.col(gold) == F.col(predicted)).alias("hit")), F.struct(F.col(predicted).cast("string").alias("label"), F.lit("predicted").alias("side"), (F.col(gold) == F.col(predicted)).alias("hit")))))
    hit = F.coalesce("hit", F.lit(False))
    counts = sides.where("label is not null").groupBy("label").agg(_count((F.col("side") == "gold") & hit).alias("tp"), _count((F.col("side") == "predicted") & ~hit).alias("fp"), _count((F.col("side") == "gold") & ~hit).alias("fn"))
    if domain is not None:
        counts = spark.createDataFrame([(x,) for x in domain], "label string").join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"), empty)
    return counts.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def macro_f1(pairs: DataFrame, gold: str, predicted: str, domain: Sequence[str] | None = None, empty: float | None = 0.0) -> DataFrame:
    return per_label(pairs, gold, predicted, domain, empty).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("labels"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; two empty ones are alike."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def multilabel(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, exact_rate, mean_jaccard) over arrays of labels."""
    j = jaccard(F.col(gold), F.col(predicted))
    return pairs.select(*by, j.alias("j")).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("j") == 1.0, 1.0).otherwise(0.0)).alias("exact_rate"), F.avg("j").alias("mean_jaccard"))


def ordinal_errors(pairs: DataFrame, gold: str, predicted: str, ranks: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, over, under, over_rate, under_rate) by the ranks of ordered labels; an unknown label has rank 0."""
    table = F.create_map(*(x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))))
    g, p = (F.coalesce(F.element_at(table, F.col(c)), F.lit(0)) for c in (gold, predicted))
    found = pairs.groupBy(*by).agg(F.count("*").alias("n"), _count(p > g).alias("over"), _count(p < g).alias("under"))
    return found.withColumn("over_rate", ratio(F.col("over"), F.col("n"))).withColumn("under_rate", ratio(F.col("under"), F.col("n")))


def kappa(ratings: DataFrame, item: Sequence[str], rater: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, pairs, observed, expected, kappa) between two raters. Items with another number of raters do not count; kappa is null if chance agreement is 1.

    Each item's two ratings meet in one aggregation; expected agreement comes from the two raters' label counts.
    """
    pairs = ratings.groupBy(*by, *item).agg(F.count("*").alias("n"), F.countDistinct(rater).alias("raters"), F.min(F.struct(rater, value)).alias("a"), F.max(F.struct(rater, value)).alias("b"))
    pairs = pairs.where("n = 2 and raters = 2").select(*by, F.col(f"a.{value}").alias("x"), F.col(f"b.{value}").alias("y"))
    totals = pairs.groupBy(*by).agg(F.count("*").alias("pairs"), F.avg(F.when(F.col("x").eqNullSafe(F.col("y")), 1.0).otherwise(0.0)).alias("observed"))
    sides = pairs.select(*by, F.explode(F.array(F.struct(F.col("x").alias("label"), F.lit(1).alias("first")), F.struct(F.col("y").alias("label"), F.lit(0).alias("first")))).alias("s"))
    chance = sides.groupBy(*by, "s.label").agg(F.sum("s.first").alias("n1"), F.sum(1 - F.col("s.first")).alias("n2"))
    chance = chance.groupBy(*by).agg(F.sum(F.col("n1") * F.col("n2")).alias("both"))
    found = totals.join(chance, list(by)) if by else totals.join(chance)
    expected = F.col("both") / (F.col("pairs") * F.col("pairs"))
    return found.select(*by, "pairs", "observed", expected.alias("expected"), F.when(expected != 1, (F.col("observed") - expected) / F.nullif(1 - expected, F.lit(0.0))).alias("kappa"))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, sd, cv, low, high): the sample standard deviation from 2 values on; cv is sd / |mean|."""
    v = F.col(value)
    found = df.where(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.when(F.count("*") > 1, F.stddev_samp(v)).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"))
    return found.select(*by, "n", "mean", "sd", F.when(F.col("mean") != 0, F.col("sd") / F.nullif(F.abs("mean"), F.lit(0.0))).alias("cv"), "low", "high")


def percentiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, p<q>) with linear interpolation between the values around (n - 1) * q."""
    return df.groupBy(*by).agg(*(F.percentile(value, q).alias(f"p{round(100 * q)}") for q in at))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; a missing value counts as <missing>."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.when(is_missing(F.col(c)), "<missing>").otherwise(F.col(c).cast("string")).alias("value")) for c in columns))
    return df.select(F.inline(cells)).groupBy("field", "value").agg(F.count("*").alias("n"))
