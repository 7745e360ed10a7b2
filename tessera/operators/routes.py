"""From gaps in records to planned experiments: grouping, feasibility, replicates, order and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import first_match
from tessera.functions.text import canonical_json, truthy


def gaps(records: DataFrame, key: str, found: Mapping[str, Column]) -> DataFrame:
    """A row for each record and gap whose condition holds; equal ones once."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in found.items())))
    return records.select(key, F.explode(named).alias("gap")).distinct()


def propose(gap_rows: DataFrame, groups: Sequence[str], key: str, gap: str = "gap") -> DataFrame:
    """One route for each group: its gaps and how many records they concern, with a stable id."""
    made = gap_rows.groupBy(*groups).agg(F.sort_array(F.collect_set(gap)).alias("gaps"), F.countDistinct(key).alias("records"))
    return made.withColumn("route_id", F.concat(F.lit("R_"), F.substr(F.sha2(canonical_json(**{g: F.col(g) for g in groups}), 256), F.lit(1), F.lit(16))))


def available(profile: DataFrame, key: str = "capability", value: str = "value") -> DataFrame:
    """(capability) of a flat profile whose value is true, yes, available or a positive number."""
    yes = truthy(F.col(value), ("true", "yes", "available", "1")) | F.coalesce(F.col(value).cast("string").try_cast("double") > 0, F.lit(False))
    return profile.where(yes).select(F.col(key).alias("capability")).distinct()


def feasibility(needs: DataFrame, profile: DataFrame, route: str, item: str, option: str = "option", capability: str = "capability", mandatory: str | None = None) -> DataFrame:
    """(route, feasible, infeasible, missing, status) from needs (route, item, option, capability).

    An item is feasible if one of its options has all its capabilities; else its least lacking option tells what is missing.
    With `mandatory`, a column of needs, a route that lacks a mandatory item is infeasible and one that lacks others only is
    partial; a null counts as mandatory. Without it, a route is partial as long as it has any item.
    """
    must = F.coalesce(F.col(mandatory).cast("boolean"), F.lit(True)) if mandatory else F.lit(False)
    needs = needs.withColumn("_must", must)
    have = available(profile).withColumn("_has", F.lit(1))
    options = needs.join(have.withColumnRenamed("capability", capability), capability, "left").groupBy(route, item, option)
    options = options.agg(F.sort_array(F.collect_set(F.when(F.col("_has").isNull(), F.col(capability)))).alias("lacking"), F.max("_must").alias("_must"))
    best = options.groupBy(route, item).agg(F.min(F.struct(F.size("lacking").alias("n"), F.col(option), F.col("lacking"))).alias("best"), F.max("_must").alias("_must"))
    names = lambda c: F.sort_array(F.collect_set(F.when(c, F.col(item))))
    found = best.groupBy(route).agg(names(F.col("best.n") == 0).alias("feasible"), names(F.col("best.n") > 0).alias("infeasible"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("best.lacking")))).alias("missing"), F.max(F.col("_must") & (F.col("best.n") > 0)).alias("_stops"))
    stops = F.col("_stops") if mandatory else F.size("feasible") == 0
    status = first_match([("feasible", F.size("infeasible") == 0), ("infeasible", stops)], "partial")
    return found.withColumn("status", status).drop("_stops")


def replicates(routes: DataFrame, matrix: str, count: Column) -> DataFrame:
    """A row for each route, condition of its `matrix` (an array) and replicate from 1; a route without conditions has one, null."""
    conditions = routes.withColumn("condition_no", F.lit(0)).select("*", F.posexplode_outer(matrix).alias("_at", "condition"))
    found = conditions.withColumn("condition_no", F.coalesce(F.col("_at"), F.lit(0)) + 1).drop("_at", matrix)
    return found.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.greatest(count, F.lit(1)))))


def gate_stages(routes: DataFrame, completed: DataFrame, route: str, needs: str) -> DataFrame:
    """`routes` with lacking (prerequisites in `needs` that are not completed) and gate: completed, blocked or actionable."""
    wanted = routes.select(route, F.explode(needs).alias("_need")).join(completed.select(F.col(route).alias("_need")).distinct(), "_need", "left_anti")
    wanted = wanted.groupBy(F.col(route).alias("_route")).agg(F.sort_array(F.collect_set("_need")).alias("lacking"))
    done = completed.select(F.col(route).alias("_done")).distinct()
    found = routes.join(wanted, F.col(route) == F.col("_route"), "left").join(done, F.col(route) == F.col("_done"), "left")
    lacking = F.coalesce("lacking", F.array().cast("array<string>"))
    gate = first_match([("completed", F.col("_done").isNotNull()), ("blocked", F.size(lacking) > 0)], "actionable")
    return found.withColumn("lacking", lacking).withColumn("gate", gate).drop("_route", "_done")


def ranked(routes: DataFrame, route: str, status: str, order: Sequence[str], stage: str, score: str) -> DataFrame:
    """Routes by status (in the order given), stage, descending score and id."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(status))
    return routes.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), stage, F.desc(score), route)
