"""Evidence of a paper for each target span: ten weights on what a candidate says and where it stands, and the best by role.

What a candidate adds by itself (its role, fields, phrases, provenance and family) is the same for all targets; candidates
that agree in it form a class. Within a class only the distance decides, and being in the same section or an adjacent
paragraph only gets rarer with it. So for each target and class the nearest NEAREST candidates to either side are enough, and
come with the candidate before them: a paper's pairs are never made, however many spans it has. For links, classes are those
of equal scores in all cases; what no case accepts is left out, and of a target and class no more than PER_ROLE rows move on.

Defined results: spans without a paper, an id or an order are no candidates and no targets; a span is not linked to itself
or to another one of the same id. Orders have to be distinct within a paper (`repeated_orders`), and sections and paragraphs
to be runs of them. A null family counts as unclear, a null flag as false.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import signals
from tessera.operators.joins import nearest_before
from tessera.operators.scoring import LINK_THRESHOLD, link_score

# Roles in order; the least scores of a hint beside its target and in its section; how many links are kept.
ROLES = ("performance", "validation", "quantification", "reactor", "process", "negative_or_contradicting", "context_hint")
HINT, BESIDE, IN_SECTION = "context_hint", 0.65, 0.60
PER_ROLE, IN_ALL = 2, 12
UNSURE = ("unclear", "mixed")
#: One more than PER_ROLE, as the target itself may be among them.
NEAREST = PER_ROLE + 1
FLAGS = ("structured", "phrase", "specific", "relation", "primary", "context_only", "family_conflict")
CANDIDATE = ("span_id", "span_order", "paragraph", "section", "family", "role", *FLAGS)
#: An order ahead of all spans, with the first candidates of a class.
AHEAD = -(2**62)


def _verdict(of: Callable[[str], Column], beside: Column, near: Column, match: Column, mismatch: Column) -> tuple[dict[str, Column], Column, Column]:
    """(conditions of the weights, score, why it is rejected or null) of a candidate's fields and its place beside a target."""
    hint, phrase = of("role") == HINT, of("phrase")
    conditions = {
        "structured": of("structured"), "phrase": phrase & ~hint, "adjacent": beside, "same_section": near, "primary": of("primary"), "family_match": match,
        "family_mismatch": mismatch, "family_conflict": of("family_conflict"), "context_only": ~of("primary"), "generic": (hint | phrase) & ~of("specific") & ~of("structured"),
    }
    score = link_score(conditions)
    score = F.when(hint & beside, F.greatest(score, F.lit(BESIDE))).when(hint & near, F.greatest(score, F.lit(IN_SECTION))).otherwise(score)
    strong = of("structured") | of("relation") | (beside & phrase) | (phrase & of("role").isin("validation", "quantification"))
    reason = F.when(mismatch, "family_mismatch").when(~hint & ~strong, "no_strong_signal").when(F.round(score, 4) < LINK_THRESHOLD, "below_threshold")
    return conditions, F.round(score, 4), reason


def _of_target(of: Callable[[str], Column]) -> tuple[Column, Column, Column, Column]:
    """(beside, near, match, mismatch) of a candidate and its target, t_*."""
    sure = ~of("family").isin(*UNSURE) & ~F.col("t_family").isin(*UNSURE)
    beside = F.coalesce(F.abs(of("paragraph") - F.col("t_paragraph")) <= 1, F.lit(False))
    return beside, F.coalesce(of("section") == F.col("t_section"), F.lit(False)), sure & (of("family") == F.col("t_family")), sure & (of("family") != F.col("t_family"))


def _ready(spans: DataFrame, hopeful: bool) -> DataFrame:
    """Spans by role, with the class of each; `hopeful` ones by their scores, as `_neutral` and `_matching`, if any is accepted."""
    rows = spans.where("paper_id is not null and span_id is not null and span_order is not null")
    rows = rows.select("paper_id", "span_id", "span_order", "paragraph", "section", F.coalesce("family", F.lit("unclear")).alias("family"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("primary", "context_only", "family_conflict")), F.inline("roles"))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("structured", "phrase", "specific", "relation")})
    # A span that is context only gives hints and nothing else.
    rows = rows.where((F.col("role") == HINT) == F.col("context_only"))
    if not hopeful:
        return rows.withColumn("class", F.xxhash64("role", "family", *FLAGS))

    def scores(match: bool) -> Column:
        cases = [_verdict(F.col, F.lit(beside), F.lit(near), F.lit(match), F.lit(False)) for beside, near in product((False, True), repeat=2)]
        return F.array(*(F.when(reason.isNull(), score).otherwise(-1.0) for _, score, reason in cases))

    rows = rows.withColumns({"_neutral": scores(False), "_matching": scores(True)})
    return rows.where(F.greatest(F.array_max("_neutral"), F.array_max("_matching")) >= 0).withColumn("class", F.xxhash64("role", "family", "_neutral", "_matching"))


def _around(spans: DataFrame, targets: DataFrame, width: int | None, hopeful: bool) -> DataFrame:
    """(target_id, t_* of the target, around): the nearest candidates of each class, as an array<struct>."""
    rows = _ready(spans, hopeful)
    order = Window.partitionBy("paper_id", "class").orderBy("span_order", "span_id")
    near = F.collect_list(F.struct(*CANDIDATE)).over(order.rowsBetween(1 - NEAREST, NEAREST))
    held = rows.select("paper_id", "class", "span_order", near.alias("around"), F.row_number().over(order).alias("_n"))
    # Targets ahead of a class' first candidate find it by a row ahead of all.
    own, first = F.struct(F.col("span_order").cast("long").alias("span_order"), "around"), F.struct(F.lit(AHEAD).cast("long").alias("span_order"), F.slice("around", 1, NEAREST).alias("around"))
    held = held.select("paper_id", "class", F.inline(F.when(F.col("_n") == 1, F.array(own, first)).otherwise(F.array(own))))
    classes = rows.select("paper_id", "class", *([F.col("family").alias("_family"), "_neutral", "_matching"] if hopeful else [])).distinct()
    asked = targets.where("paper_id is not null and span_id is not null and span_order is not null").select("paper_id", F.col("span_id").alias("target_id"), F.col("span_order").cast("long").alias("span_order"), F.col("span_order").alias("t_order"), F.col("paragraph").alias("t_paragraph"), F.col("section").alias("t_section"), F.coalesce("family", F.lit("unclear")).alias("t_family"))
    asked = asked.join(classes, "paper_id")
    if hopeful:
        sure = ~F.col("_family").isin(*UNSURE) & ~F.col("t_family").isin(*UNSURE)
        best = F.when(~sure, F.array_max("_neutral")).when(F.col("_family") == F.col("t_family"), F.array_max("_matching")).otherwise(-1.0)
        asked = asked.where(best >= 0).drop("_family", "_neutral", "_matching")
    return nearest_before(asked, held, ["paper_id", "class"], "span_order", ["around"], width).drop("span_order")


def pairs(spans: DataFrame, targets: DataFrame, width: int | None = None) -> DataFrame:
    """(target_id, t_* of the target, and the candidate's columns) of the nearest candidates of each class."""
    return _around(spans, targets, width, False).select("*", F.inline("around")).drop("around").where(F.col("span_id") != F.col("target_id"))


def repeated_orders(spans: DataFrame) -> DataFrame:
    """(paper_id, span_order, n) where several spans of a paper have one order: none, if all is well."""
    return spans.where("paper_id is not null and span_order is not null").groupBy("paper_id", "span_order").agg(F.count_distinct("span_id").alias("n")).where("n > 1")


def scored(found: DataFrame) -> DataFrame:
    """`pairs` with score, signals, rejected (null if accepted) and distance."""
    conditions, score, reason = _verdict(F.col, *_of_target(F.col))
    return found.select("*", score.alias("score"), signals(conditions).alias("signals"), reason.alias("rejected"), F.abs(F.col("span_order") - F.col("t_order")).alias("distance"))


def links(spans: DataFrame, targets: DataFrame, per_role: int = PER_ROLE, in_all: int = IN_ALL, width: int | None = None) -> DataFrame:
    """(paper_id, target_id, span_id, score, distance, roles, signals, place): the best of each target and role, then of each target.

    `spans` and `targets`: paper_id, span_id, span_order, paragraph, section, family; spans also primary, context_only,
    family_conflict and roles array<struct<role, structured, phrase, specific, relation>>.
    """
    if per_role > PER_ROLE:
        raise ValueError(f"no more than {PER_ROLE} links a role are looked for")

    def told(c: Column) -> Column:
        _, score, reason = _verdict(c.getField, *_of_target(c.getField))
        # Sorted by its first fields.
        return F.struct((-score).alias("_minus"), F.abs(c["span_order"] - F.col("t_order")).alias("distance"), *(c[n].alias(n) for n in CANDIDATE if n != "span_order"), reason.alias("_rejected"))

    others = F.filter("around", lambda c: c["span_id"] != F.col("target_id"))
    best = F.slice(F.array_sort(F.filter(F.transform(others, told), lambda c: c["_rejected"].isNull())), 1, per_role)
    kept = _around(spans, targets, width, True).select("paper_id", "target_id", "t_paragraph", "t_section", "t_family", F.inline(best))
    by_role = Window.partitionBy("paper_id", "target_id", "role").orderBy("_minus", "distance", "span_id")
    kept = kept.withColumn("_place", F.row_number().over(by_role)).where(F.col("_place") <= per_role)
    conditions, score, _ = _verdict(F.col, *_of_target(F.col))
    kept = kept.withColumns({"score": score, "signals": signals(conditions)})
    merged = kept.groupBy("paper_id", "target_id", "span_id").agg(F.max("score").alias("score"), F.min("distance").alias("distance"), F.sort_array(F.collect_set("role")).alias("roles"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"))
    place = F.row_number().over(Window.partitionBy("paper_id", "target_id").orderBy(F.desc("score"), "distance", "span_id"))
    return merged.withColumn("place", place).where(F.col("place") <= in_all)


def across_papers(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Links whose evidence belongs to another paper than the link says: none, if all is well."""
    owner = spans.select(F.col("span_id").alias("_id"), F.col("paper_id").alias("evidence_paper")).distinct()
    return found.join(owner, F.col("span_id") == F.col("_id"), "left").where(~F.col("paper_id").eqNullSafe(F.col("evidence_paper"))).drop("_id")
