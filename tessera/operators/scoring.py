"""Scores that decide: capped risk, links between evidence, triage, review bands, gates of repeated experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import clamp, first_match, signals, weighted
from tessera.functions.text import present, yes_no


def capped_total(reasons: Column, groups: Mapping[str, str], caps: Mapping[str, float], most: float = 100.0) -> Column:
    """The sum of `reasons`, array<struct<code, weight>>, where the codes of one group give no more than its cap, and all no more than `most`."""
    total = F.lit(0.0)
    known = F.create_map(*(x for k, v in groups.items() for x in (F.lit(k), F.lit(v))))

    def add(chosen: Column) -> Column:
        return F.aggregate(chosen, F.lit(0.0), lambda s, r: s + r["weight"])

    def of_group(group: str) -> Column:
        return F.filter(reasons, lambda r: F.element_at(known, r["code"]) == group)

    for group, cap in caps.items():
        total = total + F.least(F.lit(float(cap)), add(of_group(group)))
    alone = F.filter(reasons, lambda r: ~F.coalesce(F.element_at(known, r["code"]), F.lit("")).isin(*caps))
    return F.least(F.lit(float(most)), total + add(alone))


def risk_tier(score: Column) -> Column:
    """T3 from 70, T2 from 40, T1 from 20, else T0."""
    return first_match([("T3", score >= 70), ("T2", score >= 40), ("T1", score >= 20)], "T0")


def link_by_reach(reach: int, digits: int | None = 4) -> Column:
    """max(0.1, 1 - distance / reach) for a column `distance`, rounded half to even unless `digits` is None."""
    score = F.greatest(F.lit(0.1), 1 - F.col("distance") / F.lit(float(reach)))
    return score if digits is None else F.bround(score, digits)


LINK_WEIGHTS: Sequence[tuple[str, float]] = (
    # Evidence for and against a link, by condition.
    ("structured", 0.35), ("phrase", 0.25), ("adjacent", 0.15), ("same_section", 0.08), ("primary", 0.10),
    ("family_match", 0.07), ("family_mismatch", -0.35), ("family_conflict", -0.25), ("context_only", -0.30), ("generic", -0.25),
)
LINK_THRESHOLD = 0.60


def link_score(conditions: Mapping[str, Column]) -> Column:
    return clamp(weighted([(conditions[name], w) for name, w in LINK_WEIGHTS if name in conditions]))


def best_links(links: DataFrame, target: str, role: str, evidence: str, score: str, per_role: int = 2, in_all: int = 12, least: float = LINK_THRESHOLD) -> DataFrame:
    """Links of at least `least`: the best of each target and role, then of each target; roles of one evidence are merged into `roles`."""
    by_role = Window.partitionBy(target, role).orderBy(F.desc(score), evidence)
    kept = links.where(F.col(score) >= least).withColumn("_place", F.row_number().over(by_role)).where(F.col("_place") <= per_role)
    merged = kept.groupBy(target, evidence).agg(F.max(score).alias(score), F.sort_array(F.collect_set(role)).alias("roles"))
    place = F.row_number().over(Window.partitionBy(target).orderBy(F.desc(score), evidence))
    return merged.withColumn("place", place).where(F.col("place") <= in_all)


# Weights of the triage scores.
METRIC_WEIGHTS = (("fe", 0.25), ("yield", 0.25), ("potential", 0.20), ("current", 0.20), ("stability", 0.10))
TRIAGE_WEIGHTS = {"metric": 0.25, "validation": 0.30, "source": 0.20, "engineering": 0.25}


def metric_completeness(fields: Mapping[str, Column]) -> Column:
    return clamp(weighted([(present(fields[name]), w) for name, w in METRIC_WEIGHTS]))


# What each check, each mark of practical use and each sign of contamination counts.
VALIDATION_WEIGHTS = {"isotope": 0.35, "isotope_not_applicable": 0.20, "blank": 0.20, "contamination": 0.20, "nox": 0.15, "detection": 0.10}
GROUNDING = {"high": 1.0, "medium": 0.75, "low": 0.50, "other": 0.65, "short": 0.15, "empty": 0.35, "short_below": 30}
ENGINEERING_WEIGHTS = {
    "flow_or_GDE_reactor": 0.20, "HOR_context": 0.10, "energy_efficiency_reported": 0.15, "long_runtime_or_stability": 0.15,
    "stability_reported": 0.08, "gas_phase_product": 0.10, "product_state_disclosed": 0.10, "current_density_reported": 0.20,
}
PENALTY_WEIGHTS = {"class": 0.40, "reassigned": 0.35, "uncertain": 0.20, "no_control": 0.12, "no_screening": 0.08}
MOST_PENALTY, LONG_RUNTIME_HOURS = 0.60, 10


def validation_completeness(isotope: Column, blank: Column, contamination: Column, nox: Column, detection: Column, needs_isotope: Column) -> Column:
    """Checks that are said to be done (yes, no, ... as `text.yes_no` has them; `detection` any value), added.

    Where no isotope test is needed, one that is not applicable counts in part.
    """
    w = VALIDATION_WEIGHTS
    waived = ~needs_isotope & F.coalesce(F.lower(F.trim(isotope)).isin("not_applicable", "not applicable"), F.lit(False))
    done = {name: yes_no(c) == "yes" for name, c in (("isotope", isotope), ("blank", blank), ("contamination", contamination), ("nox", nox))}
    first = F.when(done["isotope"], w["isotope"]).when(waived, w["isotope_not_applicable"]).otherwise(0.0)
    return clamp(first + weighted([(done["blank"], w["blank"]), (done["contamination"], w["contamination"]), (done["nox"], w["nox"]), (present(detection), w["detection"])]))


def source_grounding(text: Column, confidence: Column, usable: Column) -> Column:
    """By how sure the text's class is, less for a short text and still less for none; 0 if it may not be used at all."""
    g = GROUNDING
    sure = F.lower(F.coalesce(confidence, F.lit("")))
    base = F.when(sure == "high", g["high"]).when(sure == "medium", g["medium"]).when(sure == "low", g["low"]).otherwise(g["other"])
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    less = F.when(n < g["short_below"], g["short"]).otherwise(0.0) + F.when(n == 0, g["empty"]).otherwise(0.0)
    return F.when(F.coalesce(usable, F.lit(False)), clamp(base - less)).otherwise(F.lit(0.0))


def engineering_flags(marks: Mapping[str, Column], stability_hours: Column) -> Column:
    """The marks of ENGINEERING_WEIGHTS that hold, in its order; those of stability come from the hours."""
    long = F.coalesce(stability_hours >= LONG_RUNTIME_HOURS, F.lit(False))
    by_hours = {"long_runtime_or_stability": long, "stability_reported": ~long & F.coalesce(stability_hours > 0, F.lit(False))}
    return signals({name: (by_hours | dict(marks))[name] for name in ENGINEERING_WEIGHTS if name in by_hours or name in marks})


def engineering_relevance(flags: Column) -> Column:
    return clamp(weighted([(F.array_contains(flags, name), w) for name, w in ENGINEERING_WEIGHTS.items()]))


def contamination_penalty(conditions: Mapping[str, Column]) -> Column:
    """The weights of PENALTY_WEIGHTS whose condition holds, no more than MOST_PENALTY."""
    return F.least(F.lit(MOST_PENALTY), weighted([(conditions[name], w) for name, w in PENALTY_WEIGHTS.items() if name in conditions]))


def triage_total(metric: Column, validation: Column, source: Column, engineering: Column, penalty: Column) -> Column:
    w = TRIAGE_WEIGHTS
    return clamp(w["metric"] * metric + w["validation"] * validation + w["source"] * source + w["engineering"] * engineering - penalty)


def recommendation(metric: Column, validation: Column, source: Column, total: Column, penalty: Column, blocked: Column) -> Column:
    return first_match(
        [
            ("deprioritize", penalty >= 0.35),
            ("insufficient_evidence", (metric < 0.30) | (validation < 0.25)),
            ("priority", (total >= 0.72) & ~blocked & (metric >= 0.65) & (validation >= 0.65) & (source >= 0.70)),
            ("conditional", total >= 0.42),
        ],
        "insufficient_evidence",
    )


def review_band(score: Column, flags: Column, critical: Sequence[str], high: Sequence[str], medium: Sequence[str], low: Sequence[str]) -> Column:
    """critical by flag; high by flag or from 8, medium from 4, low from 1, else none."""

    def any_of(names: Sequence[str]) -> Column:
        return F.arrays_overlap(flags, F.array(*map(F.lit, names))) if names else F.lit(False)

    return first_match([("critical", any_of(critical)), ("high", any_of(high) | (score >= 8)), ("medium", any_of(medium) | (score >= 4)), ("low", any_of(low) | (score >= 1))], "none")


def weighted_consensus(votes: DataFrame, group: str, label: str, points: Column, unclear: str = "unclear", mixed: str = "mixed") -> DataFrame:
    """(group, consensus, confidence, top, second) by the labels' points: below 6 unclear; a second from 6 on within 3 mixed; high from 10 with a lead of 4."""
    totals = votes.groupBy(group, label).agg(F.sum(points).alias("points"))
    ranked = totals.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("points")).alias("less"), F.col(label).alias("label")))).alias("r"))
    top, second = -F.get("r", F.lit(0))["less"], F.coalesce(-F.get("r", F.lit(1))["less"], F.lit(0))
    consensus = F.when(top < 6, unclear).when((second >= 6) & (top - second <= 3), mixed).otherwise(F.get("r", F.lit(0))["label"])
    confidence = F.when(consensus.isin(unclear, mixed), "low").when((top >= 10) & (top - second >= 4), "high").otherwise("medium")
    return ranked.select(group, consensus.alias("consensus"), confidence.alias("confidence"), top.alias("top"), second.alias("second"))


def replicate_gate(results: DataFrame, group: str, value: str, status: str, controls_ok: str, complete: str, least: float, most_cv: float, min_valid: int = 3) -> DataFrame:
    """(group, valid, mean, sd, cv, gate). The first that holds decides: invalid_controls, incomplete, failed, insufficient, above_cv, below_mean, else passed."""
    ok, whole, failed = F.col(controls_ok), F.col(complete), F.col(status) == "failed"
    valid = F.when(ok & whole & ~failed, F.col(value))
    found = results.groupBy(group).agg(F.count(valid).alias("valid"), F.avg(valid).alias("mean"), F.when(F.count(valid) > 1, F.stddev_samp(valid)).alias("sd"), F.max(~ok).alias("_bad"), F.max(~whole).alias("_part"), F.min(failed).alias("_failed"))
    cv = F.when(F.col("mean") != 0, F.col("sd") / F.nullif(F.abs("mean"), F.lit(0.0)))
    gate = first_match([("invalid_controls", F.col("_bad")), ("incomplete", F.col("_part")), ("failed", F.col("_failed")), ("insufficient", F.col("valid") < min_valid), ("above_cv", F.coalesce(cv > most_cv, F.lit(False))), ("below_mean", F.col("mean") < least)], "passed")
    return found.select(group, "valid", "mean", "sd", cv.alias("cv"), gate.alias("gate"))
