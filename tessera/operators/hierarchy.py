"""Routes that wait for other routes: prerequisites by stage, everything a route rests on, cycles, gates and groups.

`closure` follows edges from all nodes at once, round by round, and takes up a pair only when it is new, so that cycles end
and are seen as nodes that need themselves. A round goes as far again as all before it, so that long chains take few rounds;
where that would make many more pairs than there are, it goes one edge on. Each round is written out. What it gives is as
large as its result, which the graph decides; `gates` needs the direct edges only.

Defined results: edges with a null end are left out; equal edges count once. Routes of one id count as one. A route whose
type no stage names is of the last stage. A parent that is not there is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import first_match
from tessera.sources.files import cut as _cut

# Stages, what runs in each, and what each waits for in its scope: types, or all of a stage.
STAGES = ("baseline_establishment", "admission_and_contamination", "electrolyte_operating_window", "interphase_flow_product_state", "hor_and_process_probe", "failure_triggered_postmortem")
STAGE_OF = {
    "baseline_repeatability": 0, "validation_gap_closure": 1, "contamination_control": 1, "electrolyte_window": 2, "water_content_window": 2, "proton_donor_window": 2, "salt_solvent_window": 2, "operating_field_matrix": 2,
    "interphase_resistance": 3, "flow_wetting": 3, "outlet_product_split": 3, "product_state_accounting": 3, "stability_failure": 3, "HOR_proton_economy": 4, "process_boundary_probe": 4, "postmortem_failure_analysis": 5,
}
WAITS_FOR: Mapping[int, Sequence[str]] = {1: ("baseline_repeatability",), 2: ("baseline_repeatability", "validation_gap_closure", "contamination_control"), 3: ("baseline_repeatability", "stage 2"), 4: ("baseline_repeatability", "product_state_accounting"), 5: ("stability_failure",)}
GROUP, CHILDREN = "electrolyte_window", ("water_content_window", "proton_donor_window", "salt_solvent_window")
#: Pairs that a round may make before equal ones are merged, as a multiple of those known.
MOST_MADE = 4
LAST, DEFERRED = len(STAGES) - 1, "defer_until_capability_available"


def closure(edges: DataFrame, node: str = "node", needs: str = "needs") -> DataFrame:
    """(node, needs, depth): all that a node needs, directly or not, and over how many edges at least."""
    direct = edges.select(F.col(node).alias("node"), F.col(needs).alias("needs")).where("node is not null and needs is not null").distinct()
    found = new = direct = _cut(direct.withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        # `found` has all pairs that are `reach` apart at most: one farther apart has a node on its way that is just that far.
        far = new.where(F.col("depth") == reach)
        if far.isEmpty():
            return found
        ends = far.groupBy("needs").agg(F.count("*").alias("_far"))
        made, known = found.groupBy(F.col("node").alias("_at")).agg(F.count("*").alias("_known")).join(ends, F.col("needs") == F.col("_at"), "left").agg(F.sum(F.col("_far") * F.col("_known")), F.sum("_known")).first()
        doubled = (made or 0) <= MOST_MADE * known
        step = (found if doubled else direct).select(F.col("node").alias("_at"), F.col("needs").alias("_next"), F.col("depth").alias("_more"))
        ahead = far.join(step, F.col("needs") == F.col("_at")).groupBy("node", F.col("_next").alias("needs")).agg((F.min("_more") + reach).alias("depth"))
        new = _cut(ahead.join(found.select("node", "needs"), ["node", "needs"], "left_anti").select("node", "needs", "depth"))
        found, reach = found.unionByName(new), 2 * reach if doubled else reach + 1


def cycles(reached: DataFrame) -> DataFrame:
    """(node, in_cycle, behind_cycle) of all nodes of `closure` that a cycle keeps from ever being ready."""
    inside = reached.where("node = needs").select(F.col("node").alias("_on")).distinct()
    waiting = reached.join(inside, F.col("needs") == F.col("_on"), "left_semi").groupBy("node").agg(F.max(F.col("node") == F.col("needs")).alias("in_cycle"))
    return waiting.select("node", "in_cycle", (~F.col("in_cycle")).alias("behind_cycle"))


def stage(route_type: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in STAGE_OF.items() for x in pair))
    return F.coalesce(F.element_at(known, route_type), F.lit(LAST))


def expected_id(scope: Sequence[str], route_type: Column) -> Column:
    """The id that a route of this scope and type would have, if it were there."""
    return F.concat_ws("::", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope), route_type)


def prerequisites(routes: DataFrame, scope: Sequence[str], route: str = "route_id", route_type: str = "route_type") -> DataFrame:
    """(route, needs): a row for each route of the scope that a stage waits for, or for the id expected of a type without route; of a whole stage only what is there."""
    rows = routes.select(F.col(route).cast("string").alias("_route"), *scope, F.col(route_type).alias("_type"), stage(F.col(route_type)).alias("_stage")).dropDuplicates(["_route"])
    there = rows.withColumn("_as", F.explode(F.when(F.col("_type") == GROUP, F.array("_type")).otherwise(F.array(F.col("_type"), F.concat(F.lit("stage "), F.col("_stage"))))))
    there = there.select(*(F.col(c).alias(f"_s{k}") for k, c in enumerate(scope)), "_as", F.col("_route").alias("_needed"))
    waits = F.create_map(*(x for k, types in WAITS_FOR.items() for x in (F.lit(k), F.array(*map(F.lit, types)))))
    asked = rows.withColumn("_want", F.explode(F.element_at(waits, F.col("_stage"))))
    same = F.col("_want") == F.col("_as")
    for k, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    found = asked.join(there, same, "left")
    needs = F.coalesce("_needed", F.when(~F.col("_want").startswith("stage "), expected_id(scope, F.col("_want"))))
    return found.select(F.col("_route").alias(route), needs.alias("needs")).where("needs is not null").distinct()


def with_children(routes: DataFrame, route: str = "route_id", parent: str = "parent_route_id", route_type: str = "route_type", score: str = "priority_score", group: str = "shared_evidence_group") -> DataFrame:
    """`routes` with child_route_ids (in the order of CHILDREN) and within_stage_score; children that share evidence share their score."""
    ids = routes.select(F.col(route).alias("_id")).distinct()
    rows = routes.join(ids, F.col(parent) == F.col("_id"), "left").withColumn(parent, F.col("_id")).drop("_id")
    place = F.array_position(F.array(*map(F.lit, CHILDREN)), F.col(route_type))
    order = F.struct(F.when(place == 0, len(CHILDREN) + 1).otherwise(place).alias("place"), F.col(route).alias("id"))
    children = rows.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda c: c["id"]).alias("child_route_ids"))
    shared = rows.where(F.col(parent).isNotNull()).groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_sharing"))
    rows = rows.join(children, F.col(route) == F.col("_parent"), "left").join(shared, F.col(group).eqNullSafe(F.col("_group")), "left")
    is_group = F.col(route_type) == GROUP
    part = F.when(is_group, F.lit(0.0)).when(F.col(parent).isNotNull() & (F.col("_sharing") > 1), F.round(F.col(score) / F.col("_sharing"), 3)).otherwise(F.col(score).cast("double"))
    return rows.withColumns({"child_route_ids": F.when(is_group, F.coalesce("child_route_ids", F.array().cast(f"array<{routes.schema[route].dataType.simpleString()}>"))), "within_stage_score": part}).drop("_parent", "_group", "_sharing")


def gates(routes: DataFrame, needs: DataFrame, completed: DataFrame, route: str = "route_id", route_type: str = "route_type", label: str = "priority_label", satisfied: Sequence[str] = (), waived: Sequence[int] = (), waive_all: bool = False, failure: bool = False, enforced: bool = True) -> DataFrame:
    """`routes` with stage_rank, execution_stage, prerequisite_route_ids, stage_gate_status and blocked_by_route_ids.

    `needs` is that of `prerequisites`, `completed` has the ids of completed routes; all routes of the types in `satisfied`
    count as completed too. `waived` are stages whose gate is waived, `failure` lets the last stage begin.
    """
    rows = routes.withColumns({"_id": F.col(route).cast("string"), "stage_rank": stage(F.col(route_type))})
    done = completed.select(F.col(route).cast("string").alias("_done")).distinct()
    if satisfied:
        by_type = rows.where(F.col(route_type).isin(*satisfied)).select(F.col("_id").alias("_done"))
        ends = F.regexp_extract("needs", r"::([A-Za-z_0-9]+)$", 1)
        done = done.unionByName(by_type).unionByName(needs.where(ends.isin(*satisfied)).select(F.col("needs").alias("_done"))).distinct()
    told = needs.join(done, F.col("needs") == F.col("_done"), "left").groupBy(F.col(route).cast("string").alias("_of")).agg(F.sort_array(F.collect_set("needs")).alias("_all"), F.sort_array(F.collect_set(F.when(F.col("_done").isNull(), F.col("needs")))).alias("_open"))
    rows = rows.join(told, F.col("_id") == F.col("_of"), "left").join(done.withColumn("_is_done", F.lit(True)), F.col("_id") == F.col("_done"), "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_all": F.coalesce("_all", none), "_open": F.coalesce("_open", none)})
    last, is_open = F.col("stage_rank") == LAST, F.size("_open") > 0
    status = first_match([
        ("non_executable", F.col(route_type) == GROUP), ("completed", F.col("_is_done").isNotNull()), ("blocked", F.coalesce(F.col(label) == DEFERRED, F.lit(False))), ("event_triggered", last & F.lit(failure)), ("actionable", F.lit(not enforced)),
        ("blocked", last), ("waived", is_open & (F.lit(waive_all) | F.col("stage_rank").isin(*waived))), ("blocked", is_open),
    ], "actionable")
    rows = rows.withColumns({"execution_stage": F.get(F.array(*map(F.lit, STAGES)), F.col("stage_rank")), "prerequisite_route_ids": F.col("_all"), "stage_gate_status": status})
    return rows.withColumn("blocked_by_route_ids", F.when(F.col("stage_gate_status") == "blocked", F.col("_open")).otherwise(none)).drop("_id", "_of", "_all", "_open", "_done", "_is_done")


def next_actionable(routes: DataFrame, scope: Sequence[str], route: str = "route_id", score: str = "within_stage_score") -> DataFrame:
    """Of each scope the first route that can be run: earliest stage, highest score, least id."""
    ready = routes.where(F.col("stage_gate_status").isin("actionable", "event_triggered", "waived"))
    # A minimum is combined before rows move, unlike a rank.
    best = F.min(F.struct(F.col("stage_rank").alias("a"), (-F.col(score)).alias("b"), F.col(route).alias("c")))
    return ready.groupBy(*scope).agg(best.alias("_best")).select(*scope, F.col("_best.c").alias(route), F.col("_best.a").alias("stage_rank"))
