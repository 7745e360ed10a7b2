"""Risk of spans, papers, documents and links: reasons by rule, capped where they say the same, and the route they lead to.

A rule is a condition on a row's columns. Signals of one group are correlated, so that a group adds no more than its cap:
reasons take their weight in order until nothing of it is left, and those that come too late stay in the list with 0.

Defined results: columns that a table lacks count as null; a null is neither said nor found, so that what is expected of a
row and null is missing; an empty table gives no rows. Everything is worked out row by row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import truthy
from tessera.operators.scoring import risk_tier

# Groups of correlated reasons with their cap. A code in no group is capped at its own weight.
GROUPS: dict[str, tuple[int, tuple[str, ...]]] = {
    "span_eligibility": (28, ("span_needs_review", "span_not_primary_eligible", "span_hard_gate_failures")),
    "span_semantic_ambiguity": (28, ("span_low_semantic_confidence", "span_medium_semantic_confidence", "span_unclear_or_mixed_family", "span_unclear_ownership")),
    "span_scope_alignment": (22, ("span_off_target_family", "span_external_or_context_ownership")),
    "span_evidence_availability": (30, ("span_context_insufficient", "span_expected_evidence_link_absent", "span_validation_gate_conflict")),
    "paper_review_metadata": (18, ("paper_admissibility_needs_review", "paper_limitations_present")),
    "paper_evidence_gap": (32, ("paper_no_primary_eligible_evidence", "paper_validation_evidence_missing", "paper_quantification_evidence_missing")),
    "paper_classification": (24, ("paper_non_primary_or_unclear_genre", "paper_unclear_or_off_target_family")),
    "document_structured_conflict": (30, ("document_genre_conflict", "document_family_conflict")),
    "document_classification": (25, ("document_non_primary_or_unclear_genre", "document_unclear_or_mixed_family", "document_off_target_family")),
    "link_source_admissibility": (28, ("link_context_only", "link_source_not_primary_eligible", "link_contextual_provenance")),
    "link_ambiguity": (20, ("link_needs_review", "link_role_ambiguity")),
    "link_endpoint_quality": (24, ("link_far_endpoint_distance", "link_target_evidence_claim_conflict")),
}
# Labels that count as a risk, what a target's evidence may claim, and the routes of a tier.
OFF_TARGET = ("linrr", "no2rr", "no3rr", "norr")
NO_FAMILY = ("unclear", "mixed")
WEAK_GENRES = ("review", "perspective", "mixed", "unclear")
OTHERS_CLAIMS = ("external_or_cited_authors", "general_literature", "secondary_context")
CONTEXT_PROVENANCE = ("figure_or_scheme_caption", "secondary_document_body", "background")
SUPPORT = {
    "performance_result_claim": ("ammonia_quantification_claim", "validation_claim", "protocol_claim"),
    "ammonia_quantification_claim": ("ammonia_quantification_claim", "protocol_claim"),
    "validation_claim": ("validation_claim", "protocol_claim", "ammonia_quantification_claim"),
}
ROUTES = {
    "T0": ("auto_validate_only", "deterministic_validation"),
    "T1": ("final_output_review", "standard_generation_checks"),
    "T2": ("intermediate_anchor_and_final_review", "enhanced_generation_checks"),
    "T3": ("abstain_then_review", "abstention_recommended"),
}
SHORT_FRONT_MATTER, MOST_RISK = 80, 100


class _Row:
    """The columns of a table by name and type."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)

    def text(self, name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in self.types else F.lit("")

    def label(self, name: str) -> Column:
        return F.lower(self.text(name))

    def yes(self, name: str) -> Column:
        return truthy(F.col(name), ("true",)) if name in self.types else F.lit(False)

    def number(self, name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("long"), F.lit(0)) if name in self.types else F.lit(0)

    def items(self, name: str) -> Column:
        nothing = F.array().cast("array<string>")
        return F.coalesce(F.col(name).cast("array<string>"), nothing) if self.types.get(name, "").startswith("array") else nothing

    def decisions(self, name: str) -> Column:
        """The values of a map or struct of decisions."""
        kind = self.types.get(name, "")
        if kind.startswith("map"):
            return F.coalesce(F.map_values(F.col(name)).cast("array<string>"), F.array().cast("array<string>"))
        if kind.startswith("struct"):
            return F.coalesce(F.map_values(F.from_json(F.to_json(F.col(name)), "map<string,string>")), F.array().cast("array<string>"))
        return F.array().cast("array<string>")


@dataclass(frozen=True)
class Rule:
    """`weight` for `code` where `holds`; `detail` tells by what."""

    code: str
    weight: Column | int
    holds: Column
    detail: Column | None = None


def _reason(code: Column, weight: Column, detail: Column) -> Column:
    return F.struct(code.alias("code"), weight.cast("int").alias("raw_weight"), detail.cast("string").alias("detail"))


def _span(row: _Row) -> list[Rule]:
    sure, family, owner = row.label("semantic_confidence"), row.label("effective_reaction_family"), row.label("claim_ownership")
    stratum, selection, claim = row.text("assigned_primary_stratum"), row.text("selection_stratum"), row.text("semantic_claim_type")
    quantified = F.array_contains(row.items("all_matching_strata"), "quantification")
    failures, gates = row.items("hard_gate_failures"), row.decisions("validation_gate_decisions")
    none_met = (F.size(gates) > 0) & ~F.exists(gates, lambda g: truthy(g, ("true",)))
    no_context = (row.text("previous_context_excerpt") == "") & (row.text("next_context_excerpt") == "")
    return [
        Rule("span_needs_review", 12, row.yes("needs_review")),
        Rule("span_low_semantic_confidence", 22, sure == "low"),
        Rule("span_medium_semantic_confidence", 10, sure == "medium"),
        Rule("span_unclear_or_mixed_family", 18, family.isin(*NO_FAMILY), family),
        Rule("span_off_target_family", 14, family.isin(*OFF_TARGET), family),
        Rule("span_external_or_context_ownership", 14, owner.isin(*OTHERS_CLAIMS), owner),
        Rule("span_unclear_ownership", 10, owner == "unclear"),
        Rule("span_trap_only", 18, stratum == "trap_only"),
        Rule("span_high_risk_reservoir", 4, selection == "high_risk_reservoir"),
        Rule("span_structured_text_conflict", 70, (stratum == "structured_text_conflict") | (selection == "structured_text_conflict")),
        Rule("span_not_primary_eligible", 8, ~row.yes("primary_semantic_eligibility")),
        Rule("span_quantification_claim_signal_conflict", 14, quantified != (claim == "ammonia_quantification_claim")),
        Rule("span_validation_gate_conflict", 18, (claim == "validation_claim") & none_met),
        Rule("span_hard_gate_failures", F.least(F.lit(24), 8 + 4 * F.size(failures)), F.size(failures) > 0, F.to_json(failures)),
        Rule("span_context_insufficient", 8, no_context),
        Rule("span_expected_evidence_link_absent", 12, claim.isin(*SUPPORT) & (F.size(row.items("linked_evidence_ids")) == 0)),
    ]


def _paper(row: _Row) -> list[Rule]:
    limits, genre, family = row.items("limitations"), row.label("document_genre"), row.label("document_reaction_family")
    return [
        Rule("paper_admissibility_needs_review", 18, row.text("paper_admissibility_status") == "needs_review"),
        Rule("paper_no_primary_eligible_evidence", 20, row.number("primary_eligible_count") == 0),
        Rule("paper_limitations_present", F.least(F.lit(8), 2 + 2 * F.size(limits)), F.size(limits) > 0, F.to_json(limits)),
        Rule("paper_non_primary_or_unclear_genre", 14, genre.isin(*WEAK_GENRES), genre),
        Rule("paper_unclear_or_off_target_family", 14, family.isin(*NO_FAMILY, *OFF_TARGET), family),
        Rule("paper_validation_evidence_missing", 10, ~row.yes("has_validation_evidence")),
        Rule("paper_quantification_evidence_missing", 10, ~row.yes("has_quantification_evidence")),
    ]


def _document(row: _Row) -> list[Rule]:
    genre, family = row.label("document_genre"), row.label("document_reaction_family")
    front = F.length(F.regexp_replace(row.text("front_matter_excerpt"), r"^\s+|\s+$", ""))
    return [
        Rule("document_non_primary_or_unclear_genre", 15, genre.isin(*WEAK_GENRES), genre),
        Rule("document_unclear_or_mixed_family", 20, family.isin(*NO_FAMILY), family),
        Rule("document_off_target_family", 15, family.isin(*OFF_TARGET), family),
        Rule("document_front_matter_scope_insufficient", 15, front < SHORT_FRONT_MATTER, front),
    ]


def _link(row: _Row) -> list[Rule]:
    roles, target, evidence = row.items("link_roles"), row.text("target_claim_type"), row.text("evidence_claim_type")
    provenance, eligible = row.text("evidence_provenance"), row.text("source_eligibility")
    against = F.lit(False)
    for claim, support in SUPPORT.items():
        against = against | ((target == claim) & ~evidence.isin(*support))
    return [
        Rule("link_context_only", 22, row.yes("is_context_only")),
        Rule("link_needs_review", 18, row.yes("needs_review")),
        Rule("link_role_ambiguity", 14, F.size(roles) != 1, F.to_json(roles)),
        Rule("link_source_not_primary_eligible", 20, eligible != "primary_admissible", eligible),
        Rule("link_contextual_provenance", 18, provenance.isin(*CONTEXT_PROVENANCE), provenance),
        Rule("link_far_endpoint_distance", 10, row.text("source_distance_band") == "far"),
        Rule("link_target_evidence_claim_conflict", 16, against, F.concat_ws(" by ", target, evidence)),
    ]


_RULES = {"span": _span, "paper": _paper, "document": _document, "link": _link}


def capped_reasons(reasons: Column) -> Column:
    """`reasons`, array<struct<code, raw_weight, detail>>, with `group`, `cap` and `weight`: what their group has left for each, in order."""
    in_group = {code: name for name, (_, codes) in GROUPS.items() for code in codes}
    names = F.create_map(*(F.lit(x) for pair in in_group.items() for x in pair))
    caps = F.create_map(*(F.lit(x) for name, (cap, _) in GROUPS.items() for x in (name, cap)))

    def placed(r: Column) -> Column:
        group = F.element_at(names, r["code"])
        return F.struct(r["code"].alias("code"), r["raw_weight"].alias("raw_weight"), r["detail"].alias("detail"), F.coalesce(group, r["code"]).alias("group"), F.coalesce(F.element_at(caps, group), r["raw_weight"]).alias("cap"))

    def taken(done: Column, r: Column) -> Column:
        before = F.aggregate(F.filter(done, lambda d: d["group"] == r["group"]), F.lit(0), lambda s, d: s + d["weight"])
        return F.concat(done, F.array(r.withField("weight", F.least(r["raw_weight"], F.greatest(F.lit(0), r["cap"] - before)))))

    empty = F.array().cast("array<struct<code:string,raw_weight:int,detail:string,group:string,cap:int,weight:int>>")
    return F.aggregate(F.transform(reasons, placed), empty, taken)


def with_risk(df: DataFrame, item: str) -> DataFrame:
    """`df` with risk_reasons, risk_score, risk_tier, human_route and machine_route. `item`: span, paper, document or link."""
    row = _Row(df)
    found = [F.when(F.coalesce(r.holds, F.lit(False)), _reason(F.lit(r.code), F.lit(r.weight) if isinstance(r.weight, int) else r.weight, F.lit(None) if r.detail is None else r.detail)) for r in _RULES[item](row)]
    reasons = F.array_compact(F.array(*found))
    if item == "document":
        # Each conflict is a reason of its own, ahead of the others.
        conflicts = F.transform(row.items("document_conflicts"), lambda c: _reason(F.when(c.contains("genre"), "document_genre_conflict").otherwise("document_family_conflict"), F.lit(24), c))
        reasons = F.concat(conflicts, reasons)
    scored = df.withColumn("risk_reasons", capped_reasons(reasons))
    scored = scored.withColumn("risk_score", F.least(F.lit(MOST_RISK), F.aggregate("risk_reasons", F.lit(0), lambda s, r: s + r["weight"])))
    scored = scored.withColumn("risk_tier", risk_tier(F.col("risk_score")))
    routes = {name: F.create_map(*(F.lit(x) for tier, pair in ROUTES.items() for x in (tier, pair[k]))) for k, name in enumerate(("human_route", "machine_route"))}
    return scored.withColumns({name: F.element_at(by_tier, F.col("risk_tier")) for name, by_tier in routes.items()})
