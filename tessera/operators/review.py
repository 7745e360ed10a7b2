"""Which records people have to look at, and how soon: flags by level, points by reason, and requirements of several sources merged.

Rules are rows (flag, level, condition). A record's band is the highest level of its flags or the one that its score reaches;
bands are ordered, and merging takes the flags of all sources, adds scores and reads the band anew, so that no source can
lower what another asks for. `domain_rules` and `domain_points` are those for records that `rights.adjudicate` has judged.

Defined results: a condition that is null does not hold; flags come in the order of the rules, once each; a record without flags
and points has band none. Columns that a table lacks count as null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import signals
from tessera.operators.provenance import LOW_TRUST, PRIMARY
from tessera.operators.rights import CAPTIONS, PRIMARY_CLASSES

# Bands from above, the score by level, the least score of a band, and the bands that need a person.
LEVELS = ("critical", "high", "medium", "low")
SCORES = {"critical": 10, "high": 8, "medium": 4, "low": 1}
LEAST = {"high": 8, "medium": 4, "low": 1}
NEEDED = ("critical", "high", "medium")
# What a model's flags score, and what it scores to be asked for a person without any.
MODEL_SCORES = {
    "llm_parse_or_schema_error": 8, "llm_more_permissive_than_rule": 5, "llm_more_conservative_than_rule": 4, "missing_boundary_field_disagreement": 4, "required_control_disagreement": 4,
    "llm_overrode_low_trust_provenance": 6, "llm_upgraded_unpaired_caption": 6, "possible_unsupported_isotope_claim": 5, "text_class_disagreement": 2,
}
ASKED = 4

Rule = tuple[str, str, Column]


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def band(score: Column, levels: Column) -> Column:
    """The band of a score and of array<string> levels: whichever is higher."""
    found = F.lit("none")
    for level in reversed(LEVELS):
        reached = F.array_contains(levels, level) | (score >= LEAST[level]) if level in LEAST else F.array_contains(levels, level)
        found = F.when(reached, level).otherwise(found)
    return found


def requirements(records: DataFrame, rules: Sequence[Rule], prefix: str = "rule") -> DataFrame:
    """`records` with <prefix>_flags array<struct<flag, level>>, <prefix>_score and <prefix>_needs_review."""
    flags = F.array_compact(F.array(*(F.when(_holds(c), F.struct(F.lit(flag).alias("flag"), F.lit(level).alias("level"))) for flag, level, c in rules)))
    found = records.withColumn(f"{prefix}_flags", flags)
    levels = F.transform(f"{prefix}_flags", lambda f: f["level"])
    score = F.coalesce(F.array_max(F.transform(levels, lambda x: F.element_at(F.create_map(*(F.lit(v) for pair in SCORES.items() for v in pair)), x))), F.lit(0))
    return found.withColumns({f"{prefix}_score": score, f"{prefix}_needs_review": band(score, levels).isin(*NEEDED)})


def model_requirements(records: DataFrame, flags: Column, asked: Column, more: Mapping[str, Column] | None = None) -> DataFrame:
    """`records` with model_flags array<string>, model_score and model_needs_review: a known flag or a stated wish asks for a person."""
    own = F.array_distinct(F.concat(F.coalesce(flags, F.array().cast("array<string>")), signals({k: _holds(c) for k, c in (more or {}).items()})))
    found = records.withColumn("model_flags", own)
    scores = F.create_map(*(F.lit(v) for pair in MODEL_SCORES.items() for v in pair))
    best = F.coalesce(F.array_max(F.transform("model_flags", lambda f: F.element_at(scores, f))), F.lit(0))
    needed = _holds(asked) | (best > 0)
    return found.withColumns({"model_needs_review": needed, "model_score": F.when(needed & (best == 0), ASKED).otherwise(best)})


def merged(records: DataFrame, points: str | None = None) -> DataFrame:
    """`records` with review_flags, review_score, review_band and needs_review, of rules and model, and of `points`, a column of an audit's score."""
    audit = F.coalesce(F.col(points), F.lit(0)) if points else F.lit(0)
    score = F.greatest(audit, F.col("rule_score") + F.col("model_score"))
    levels = F.transform("rule_flags", lambda f: f["level"])
    found = records.withColumns({"review_flags": F.array_distinct(F.concat(F.transform("rule_flags", lambda f: f["flag"]), F.col("model_flags"))), "review_score": score, "review_band": band(score, levels)})
    return found.withColumn("needs_review", F.col("review_band").isin(*NEEDED) | F.col("model_needs_review"))


def priority(records: DataFrame, points: Sequence[tuple[int, str, Column]]) -> DataFrame:
    """`records` with audit_score and audit_reasons; a reason counts once, whichever of its conditions hold."""
    by_reason: dict[str, tuple[int, Column]] = {}
    for n, reason, condition in points:
        held = by_reason.get(reason)
        by_reason[reason] = (n, _holds(condition) | held[1] if held else _holds(condition))
    total = F.lit(0)
    for n, condition in by_reason.values():
        total = total + F.when(condition, n).otherwise(0)
    return records.withColumns({"audit_score": total, "audit_reasons": signals({reason: c for reason, (_, c) in by_reason.items()})})


def routes(reviewed: DataFrame) -> DataFrame:
    """(review_band, records, needed): how many records each band has; counted before rows move."""
    return reviewed.groupBy("review_band").agg(F.count("*").alias("records"), F.count_if("needs_review").alias("needed"))


def _facts(records: DataFrame) -> dict[str, Column]:
    known = {c.lower() for c in records.columns}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c.lower() in known else F.lit("")
    items = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c.lower() in known else F.array().cast("array<string>")
    yes = lambda c: T.truthy(text(c))
    state = lambda g: F.coalesce(F.element_at("validation_gates", F.lit(g)), F.lit("")) if "validation_gates" in known else text(g)
    explicit = lambda g: F.lower(F.trim(state(g))).isin("yes", "explicit", "true", "present")
    provenance = F.regexp_replace(F.lower(F.trim(text("provenance_type"))), r"[\s-]+", "_")
    said, flags, controls, missing, burdens = F.lower(text("source_text")), items("overclaim_risk_flags"), items("required_controls"), items("missing_boundary_fields"), items("detected_taxes")
    joined = F.lower(F.array_join(F.concat(controls, missing, burdens, flags), " "))
    pairing = F.lower(F.array_join(F.concat(controls, missing), " "))
    boundary, claim, of_class, status = text("maximum_supported_boundary"), text("claim_type"), text("text_class"), text("admissibility_status")
    n2 = F.lower(text("reaction_family")).isin("enrr", "linrr") | F.lower(text("nitrogen_source")).isin("n2", "15n2") | said.contains("n2-to-nh3") | said.contains("n2 to nh3") | said.contains("nitrogen reduction") | said.contains("dinitrogen") | (said.contains("n2") & said.contains("nh3"))
    return {
        "provenance": provenance, "boundary": boundary, "claim": claim, "class": of_class, "status": status, "n2": n2, "caption": provenance.isin(*CAPTIONS),
        "low": provenance.isin(*LOW_TRUST) | yes("low_trust_provenance") | yes("is_reject_or_low_trust"), "primary": of_class.isin(*PRIMARY_CLASSES) | claim.isin("performance_claim", "validation_claim", "process_claim", "reactor_claim") | provenance.isin(*PRIMARY),
        "conflict": yes("text_class_provenance_conflict") | F.array_contains(flags, "text_class_provenance_conflict"), "weak": (F.trim(text("source_text")) == "") | (status == "weak_grounding") | F.array_contains(flags, "weak_source_grounding"),
        "family_conflict": yes("reaction_family_conflict"), "unpaired": yes("paired_body_required"), "constrained": yes("provenance_constrained"), "isotope": explicit("isotope_15N"), "blank": explicit("blank_control"), "nox": explicit("nox_control"),
        "gap": F.exists(F.array(*map(F.lit, ("contamination", "source_attribution", "isotope", "15n"))), lambda w: joined.contains(w)), "pairing": pairing.contains("primary") & (pairing.contains("pair") | pairing.contains("body")),
        "named_conflict": F.exists(flags, lambda f: f.contains("conflict") & (f.contains("family") | f.contains("section"))), "both_medium": (F.lower(text("reaction_family_confidence")) == "medium") & (F.lower(text("section_confidence")) == "medium"),
        "matrix": F.array_contains(burdens, "measurement_matrix_tax") | ((boundary == "cell_metric") & F.arrays_overlap(missing, F.array(*map(F.lit, ("FE", "NH3_yield", "EE", "current_density", "potential_or_voltage", "runtime"))))),
        "note": F.trim(F.concat(text("optional_audit_note"), text("audit_note"), text("audit_notes"))) != "", "flags": flags, "hint": ~text("support_hint_boundary").isin("", "unsupported_or_secondary"), "severity": F.lower(text("hidden_tax_severity")),
        "model_asked": yes("llm_needs_human_review"), "permissive": yes("llm_more_permissive"), "conservative": yes("llm_more_conservative"), "differs": (boundary != "") & (text("llm_maximum_supported_boundary") != "") & (boundary != text("llm_maximum_supported_boundary")),
    }


def domain_rules(records: DataFrame) -> list[Rule]:
    f = _facts(records)
    strong = f["claim"].isin("process_claim", "reactor_claim") | f["boundary"].isin("process_partial", "reactor_legibility")
    over = ~f["boundary"].isin("", "unsupported_or_secondary") & (f["constrained"] | ~f["provenance"].isin(*PRIMARY))
    return [
        ("text_class_provenance_conflict_primary_vs_low_trust", "critical", f["conflict"] & f["primary"] & f["provenance"].isin(*LOW_TRUST)),
        ("unsupported_or_missing_source_text", "critical", f["weak"]),
        ("reaction_family_conflict", "critical", f["family_conflict"]),
        ("unpaired_caption_primary_claim", "critical", f["caption"] & f["unpaired"] & f["primary"]),
        ("process_or_reactor_claim_low_trust_provenance", "critical", f["low"] & strong),
        ("n2_to_nh3_primary_claim_missing_isotope_attribution", "high", f["primary"] & f["n2"] & ~f["isotope"]),
        ("rule_boundary_potentially_overclaims_provenance", "high", over),
        ("trusted_boundary_capped_by_provenance", "high", F.array_contains(f["flags"], "trusted_boundary_capped_by_provenance")),
        ("high_priority_contamination_or_source_attribution_gap", "high", f["gap"]),
        ("missing_blank_or_nox_controls", "medium", ~f["blank"] | ~f["nox"]),
        ("review_table_primary_pairing_required", "medium", f["provenance"].isin("review_table", "table") & f["pairing"]),
        ("medium_confidence_family_or_section_conflict", "medium", f["named_conflict"] | f["both_medium"]),
        ("incomplete_metric_matrix", "low", f["matrix"]),
        ("optional_audit_note_only", "low", f["note"]),
    ]


def domain_points(records: DataFrame) -> list[tuple[int, str, Column]]:
    f = _facts(records)
    flagged = lambda name: F.array_contains(f["flags"], name)
    return [
        (4, "llm_needs_human_review", f["model_asked"]), (5, "llm_more_permissive", f["permissive"]), (3, "llm_more_conservative", f["conservative"]), (6, "llm_overrode_low_trust_provenance", flagged("llm_overrode_low_trust_provenance")),
        (5, "trusted_boundary_capped_by_provenance", flagged("trusted_boundary_capped_by_provenance")), (3, "provenance_constrained", f["constrained"]), (3, "text_class_provenance_conflict", f["conflict"]), (4, "low_trust_provenance", f["low"] | flagged("low_trust_provenance")),
        (4, "low_trust_llm_boundary_differs_from_rule", f["low"] & f["differs"]), (2, "review_table_not_primary", (f["provenance"] == "review_table") | (f["class"] == "review_table") | flagged("review_table_not_primary")),
        (2, "context_only_caption", (f["status"] == "context_only_caption") | f["caption"]), (4, "caption_has_support_hint_requires_body_pairing", f["caption"] & f["hint"]), (4, "missing_15N_for_N2_to_NH3_claim", f["n2"] & ~f["isotope"]),
        (2, "missing_blank_control", ~f["blank"]), (2, "missing_NOx_control", ~f["nox"]), (2, "process_partial_claim", (f["boundary"] == "process_partial") | (f["claim"] == "process_claim")),
        (1, "reactor_legibility_claim", (f["boundary"] == "reactor_legibility") | (f["claim"] == "reactor_claim")), (3, "hidden_taxes_high_severity", f["severity"] == "high"), (3, "source_text_missing_or_weak_grounding", f["weak"]), (8, "reaction_family_conflict", f["family_conflict"]),
    ]


def bands(records: DataFrame) -> DataFrame:
    """Judged records with rule, model and merged requirements and audit score, by the domain's rules."""
    found = priority(requirements(records, domain_rules(records)), domain_points(records))
    f = _facts(records)
    flags = F.col("llm_audit_flags") if "llm_audit_flags" in records.columns else None
    error = F.col("llm_parse_error").isNotNull() if "llm_parse_error" in records.columns else F.lit(False)
    more = {"llm_parse_or_schema_error": error, "llm_more_permissive_than_rule": f["permissive"], "llm_more_conservative_than_rule": f["conservative"]}
    return merged(model_requirements(found, flags if flags is not None else F.array().cast("array<string>"), f["model_asked"], more), "audit_score")
