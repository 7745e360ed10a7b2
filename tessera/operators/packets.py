"""Context packets: the neighbours that fit a budget around each span, and which gates target, neighbours and links cover.

A neighbour is taken while the characters of all nearer ones and its own fit the budget; of two at one distance the earlier
comes first. Only spans whose sums of lengths are within the budget of the span's own can fit, so that windows over these sums
(not over a number of rows) bring each span all that it may take: sorted passes over a document's numbers, without texts. What a span shows is a mask
of bits, so that what a packet covers is an or over its parts.

Defined results: spans without a document or a number make no packets; a null length counts as 0. Numbers have to be distinct
within a document. A span that is longer than the budget has no neighbours taken away:
the budget is for neighbours only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import first_match, signals

# The ladder's ranks from which details of a reactor and a process have to be there, and the most that may lack for medium confidence.
REACTOR_RANK, PROCESS_RANK, FEW = 3, 4, 2
#: How a gate is covered, in the order in which it counts.
STATES = ("conflict_in_target", "observed_in_target", "observed_in_local_context", "conflict_in_linked_evidence", "observed_in_linked_evidence", "missing")


def mask(named: Mapping[str, Column]) -> Column:
    """A bit for each condition that holds, the first one lowest."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(named.values()):
        bits = bits + F.when(F.coalesce(condition, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))
    return bits.cast("long")


def _or(masks: Column) -> Column:
    return F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m))


def neighbourhoods(spans: DataFrame, budget: int, document: str = "document_id", number: str = "span_no", length: str = "length", shows: str = "shows") -> DataFrame:
    """`spans` with neighbours array<struct<number, length, shows>> by distance, used (their characters), first, last and around (what they show)."""
    own = F.struct(F.col(number).alias("number"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"), F.coalesce(F.col(shows), F.lit(0)).cast("long").alias("shows"))
    rows = spans.where(F.col(document).isNotNull() & F.col(number).isNotNull())
    by_number = Window.partitionBy(document).orderBy(number)
    ranked = rows.withColumns({"_of": F.count("*").over(Window.partitionBy(document)), "_rank": F.row_number().over(by_number), "_upto": F.sum(F.coalesce(F.col(length), F.lit(0)).cast("long")).over(by_number)}).withColumn("_span", F.struct(F.col("_rank").alias("rank"), own.alias("span")))
    # Sums of lengths up to and with a span: behind, one that fits ends within the budget; ahead, it begins within it.
    ends = F.collect_list("_span").over(Window.partitionBy(document).orderBy("_upto").rangeBetween(0, budget))
    begins = ranked.withColumn("_from", F.col("_upto") - F.coalesce(F.col(length), F.lit(0)))
    starts = F.collect_list("_span").over(Window.partitionBy(document).orderBy("_from").rangeBetween(-budget, 0))
    found = begins.withColumns({"_behind": ends, "_ahead": starts}).withColumn("_near", F.array_union("_behind", "_ahead"))
    away = lambda s: F.abs(s["rank"] - F.col("_rank"))
    others = F.transform(F.filter("_near", lambda s: s["rank"] != F.col("_rank")), lambda s: F.struct((2 * away(s) - F.when(s["rank"] < F.col("_rank"), 1).otherwise(0)).alias("key"), s["span"].alias("span")))
    # The first of a side that is not brought does not fit by itself, and ends the packet.
    n_behind, n_ahead = (F.size(F.filter("_near", c)) for c in (lambda s: s["rank"] > F.col("_rank"), lambda s: s["rank"] < F.col("_rank")))
    end = F.least(F.when(n_ahead < F.col("_rank") - 1, 2 * n_ahead + 1), F.when(n_behind < F.col("_of") - F.col("_rank"), 2 * n_behind + 2), F.lit(2**31 - 1))
    found = found.withColumn("_end", end).withColumn("_others", F.transform(F.filter(F.sort_array(others), lambda s: s["key"] < F.col("_end")), lambda s: s["span"]))
    ahead = T.sums_ahead(F.transform("_others", lambda s: s["length"]))
    taken = F.transform(F.filter(F.arrays_zip(F.col("_others").alias("s"), ahead.alias("a")), lambda x: x["a"] + x["s"]["length"] <= budget), lambda x: x["s"])
    found = found.withColumn("neighbours", taken)
    numbers = F.transform("neighbours", lambda s: s["number"])
    return found.withColumns({
        "used": F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, s: a + s["length"]), "first": F.array_min(F.concat(numbers, F.array(number))), "last": F.array_max(F.concat(numbers, F.array(number))), "around": _or(F.transform("neighbours", lambda s: s["shows"])),
    }).drop("_of", "_end", "_rank", "_span", "_upto", "_from", "_behind", "_ahead", "_near", "_others")


def linked_masks(links: DataFrame, spans: DataFrame, target: str = "target_id", evidence: str = "span_id", shows: str = "shows", denies: str = "denies") -> DataFrame:
    """(target, linked, against): what the evidence linked to each target shows and denies. Masks are or-ed before they move together."""
    facts = spans.select(F.col(evidence).alias("_id"), F.coalesce(F.col(shows), F.lit(0)).cast("long").alias("_shows"), F.coalesce(F.col(denies), F.lit(0)).cast("long").alias("_denies"))
    joined = links.join(facts, F.col(evidence) == F.col("_id"))
    return joined.groupBy(target).agg(F.bit_or("_shows").alias("linked"), F.bit_or("_denies").alias("against"))


def coverage(packets: DataFrame, gates: Sequence[str], shows: str = "shows", denies: str = "denies", around: str = "around", linked: str = "linked", against: str = "against") -> DataFrame:
    """`packets` with gates_covered map<gate, state of STATES>, gates_observed and gates_missing, and gate_status complete, partial or none."""

    def has(column: str, k: int) -> Column:
        return F.coalesce(F.col(column).bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))

    states = {g: first_match([(STATES[0], has(denies, k)), (STATES[1], has(shows, k)), (STATES[2], has(around, k)), (STATES[3], has(against, k)), (STATES[4], has(linked, k))], STATES[5]) for k, g in enumerate(gates)}
    found = packets.withColumn("gates_covered", F.create_map(*(x for g, c in states.items() for x in (F.lit(g), c))))
    state = lambda g: F.element_at("gates_covered", F.lit(g))
    found = found.withColumns({"gates_observed": signals({g: state(g).startswith("observed") for g in gates}), "gates_missing": signals({g: ~state(g).startswith("observed") for g in gates})})
    return found.withColumn("gate_status", F.when(F.size("gates_missing") == 0, "complete").when(F.size("gates_observed") > 0, "partial").otherwise("none"))


def sufficiency(packets: DataFrame, primary: Column, context_only: Column, classified: Column, lacking: Mapping[str, Column], rank: Column, reactor: Column, process: Column, gates: str = "gates_missing") -> DataFrame:
    """`packets` with sufficient_for_classification, sufficient_for_claim_support, missing and context_confidence.

    `lacking`: what a claim has to have besides its gates, by name, where it is not there; `reactor` and `process`: whether
    their details are there, which counts from the boundary's rank on. Only primary claims can be supported.
    """
    said = F.coalesce(classified, F.lit(False))
    more = {"reactor_details": (rank >= REACTOR_RANK) & ~reactor, "process_boundary": (rank >= PROCESS_RANK) & ~process}
    named = F.concat(signals({k: v for k, v in lacking.items()}), F.col(gates), signals(more))
    applies = primary & ~context_only
    missing = F.when(applies, F.array_distinct(named)).otherwise(F.array().cast("array<string>"))
    found = packets.withColumns({"_said": said, "_applies": F.coalesce(applies, F.lit(False)), "_context": F.coalesce(context_only, F.lit(False)), "missing": missing})
    supported = F.col("_applies") & F.col("_said") & (F.size("missing") == 0)
    confidence = first_match([("low", ~F.col("_said")), ("high", F.col("_context") | supported), ("medium", ~F.col("_applies") | (F.size("missing") <= FEW))], "low")
    return found.withColumns({"sufficient_for_classification": F.col("_said"), "sufficient_for_claim_support": supported, "context_confidence": confidence}).drop("_said", "_applies", "_context")
