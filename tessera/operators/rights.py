"""What a record may claim: facts shown by a record, a ladder of boundaries, and an ordered table of cases.

`facts` looks for each fact once, by stated values, numbers, words and patterns. `climb` folds them over the ladder: the
boundaries that evidence supports are joined (the highest counts), those that a lack of evidence allows at most are met
(the lowest counts). `adjudicate` takes the first case that fits a record's provenance and class; what is left, primary
evidence, goes by the ladder.

Which facts there are, by boundary, and how they show is a Lexicon; DOMAIN is the one for ammonia synthesis.

Defined results: a record without text supports nothing (weak_grounding); columns that a table lacks count as null; an
unknown family is unclear, an unknown provenance is taken for none of the cases. Records are judged one by one, so that
repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import first_match, signals
from tessera.operators.provenance import LOW_TRUST, PRIMARY

# The ladder, from below, and a record's status by the boundary that primary evidence reaches.
LADDER = ("unsupported_or_secondary", "product_admissibility", "cell_metric", "reactor_legibility", "process_partial", "plant_facing_insufficient")
STATUS = {"unsupported_or_secondary": "insufficient_primary_support", "product_admissibility": "product_admissible", "cell_metric": "cell_metric_admissible", "reactor_legibility": "reactor_legible", "process_partial": "process_partial", "plant_facing_insufficient": "plant_facing_incomplete"}
PRIMARY_CLASSES = ("primary_performance", "primary_performance_with_validation")
NEGATIVE_CLASSES = ("contamination_detection_evidence", "contamination_reassignment_evidence")
CAPTIONS = ("figure_caption", "scheme_caption")


@dataclass(frozen=True)
class Shows:
    """A fact is shown by a value in one of `values`, a number in one of `numbers`, a word, or a pattern of the text."""

    words: tuple[str, ...] = ()
    pattern: str | None = None
    values: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    #: The fact is that this check was made.
    check: str | None = None


@dataclass(frozen=True)
class Check:
    """A check that records state in `stated`, and texts show by words or a pattern, or deny by a pattern."""

    stated: tuple[str, ...]
    words: tuple[str, ...] = ()
    pattern: str | None = None
    denied: str | None = None


@dataclass(frozen=True)
class Lexicon:
    checks: Mapping[str, Check]
    #: By boundary, from the ladder's second one to its fifth, the facts that belong to it.
    levels: Mapping[str, Mapping[str, Shows]]
    #: hydrogen, flow, gas_phase, plant, source (claims that need an isotope), own_table, others_table.
    topics: Mapping[str, Shows]
    #: Families whose nitrogen is given, with the facts that they have to account for, and families that claim dinitrogen.
    given: Mapping[str, str] = field(default_factory=dict)
    dinitrogen: tuple[str, ...] = ()
    #: Words of captions by the boundary that they hint at.
    hints: Mapping[str, Shows] = field(default_factory=dict)
    controls: Mapping[str, tuple[str, ...]] = field(default_factory=dict)


# Facts of ammonia synthesis by boundary, and how they show.
DOMAIN = Lexicon(
    checks={
        "isotope_15N": Check(("isotope_15N", "isotope_validation"), pattern=r"\b15\s*n(?:2|h4|\b)", denied=r"\b(?:no|without)\s+15\s*n"),
        "blank_control": Check(("blank_control",), ("blank control", "ar blank", "argon blank", "n2-free", "open circuit blank"), denied=r"\bno\s+(?:specified\s+)?blank|\bwithout\s+blank"),
        "nox_control": Check(("nox_control", "nox_screening"), ("nox screening", "screening for nox", "nitrate contamination", "nitrite contamination", "nitrate/nitrite", "remove x-nh3 and nox", "nox contaminants")),
        "contamination_control": Check(("contamination_control",), ("contamination control", "contamination check", "contamination checks", "background ammonia", "impurity", "gas purification", "scrubbed", "contaminants")),
        "quantification_method": Check(("quantification_method", "detection_method", "ammonia_quantification"), ("indophenol", "nessler", "nmr", "ion chromatography", "colorimetric", "calibration curve", "standard addition", "quantified")),
    },
    levels={
        "product_admissibility": {
            "ammonia_quantification": Shows(check="quantification_method"),
            "isotope_15N": Shows(check="isotope_15N"),
            "blank_control": Shows(check="blank_control"),
            "nox_control": Shows(check="nox_control"),
            "contamination_control": Shows(check="contamination_control"),
        },
        "cell_metric": {
            "faradaic_efficiency": Shows(numbers=("faradaic_efficiency_percent", "FE_percent"), pattern=r"\bfe\b|\bfaradaic efficiency\b.*(?:%|percent)|(?:%|percent).*\bfaradaic efficiency\b"),
            "nh3_yield": Shows(("nh3 yield", "ammonia yield", "yield rate", "production rate"), numbers=("nh3_yield_value", "NH3_yield")),
            "current_density": Shows(("current density", " ma cm", "ma/cm"), numbers=("current_density_mA_cm2", "current_density")),
            "potential_or_voltage": Shows(("potential", "voltage", " v vs", "vvs", "two-electrode"), numbers=("potential_value", "voltage", "cell_voltage")),
            "charge_or_runtime": Shows((" charge", "coulomb", "runtime", "stability", "electrolysis", " for 2 h", " for 2 hours"), numbers=("charge", "runtime", "runtime_hours", "stability_hours")),
            "electrode_area": Shows(("cm-2", "cm^-2", "cm2", "surface area", "geometric area"), values=("electrode_area", "geometric_area")),
        },
        "reactor_legibility": {
            "reactor_type": Shows(("h-cell", "h cell", "divided cell", "flow cell", "reactor", "electrolyzer"), values=("reactor_type",)),
            "flow_rate": Shows(("flow rate", "continuous flow"), pattern=r"\b\d+(?:\.\d+)?\s*m?l\s*min", values=("flow_rate",)),
            "active_area": Shows(("active area", "geometric area", "electrode area"), values=("active_area",)),
            "GDE_or_SSC": Shows(("gde", "gas diffusion electrode", "ssc", "solid-state cell", "solid state cell"), values=("GDE_or_SSC", "solid_state_cell")),
            "HOR_or_anode_reaction": Shows((" hor", "hydrogen oxidation", "anode reaction", "h2 oxidation"), values=("HOR_or_anode_reaction", "anode_reaction")),
            "runtime_or_stability": Shows(("runtime", "stability", "stable for", "electrolysis process", "hours"), values=("runtime_or_stability", "runtime", "runtime_hours", "stability_hours")),
            "outlet_product_state": Shows(("gas-phase ammonia", "gas phase ammonia", "aqueous ammonia", "aqueous nh3", "nh4+", "ammonium", "acid trap", "outlet"), values=("outlet_product_state", "product_state")),
            "wetting_or_failure_disclosure": Shows(("wetting", "flooding", "failure", "crossover", "water management"), values=("wetting_or_failure_disclosure", "failure_disclosure")),
        },
        "process_partial": {
            "gas_liquid_product_split": Shows(("gas/liquid", "gas-liquid", "gas and liquid", "product accounting"), values=("gas_liquid_product_split", "product_split")),
            "capture_route": Shows(("capture route", "acid trap", "scrubber", "outlet capture", "captured"), values=("capture_route",)),
            "solvent_inventory": Shows(("solvent inventory", "electrolyte volume", "electrolyte inventory", "thf", "water inventory"), values=("solvent_inventory", "electrolyte_volume")),
            "electrolyte_replacement_or_recycle": Shows(("electrolyte replacement", "electrolyte recycle", "recycle", "replenished"), values=("electrolyte_replacement_or_recycle",)),
            "hydrogen_source_boundary": Shows(("hydrogen source", "h2 supply", "h2 feed", "renewable hydrogen"), values=("hydrogen_source_boundary", "hydrogen_source", "h2_source")),
            "auxiliary_loads": Shows(("auxiliary load", "balance of plant", "compression", "pumping", "separation load"), values=("auxiliary_loads",)),
            "voltage_basis": Shows(("cell voltage", "voltage basis", "two-electrode", " v vs", "vvs"), values=("voltage_basis",), numbers=("potential_value", "voltage", "cell_voltage")),
            "first_failure_signal": Shows(("first failure", "failure signal", "flooding", "wetting", "resistance increase", "passivation"), values=("first_failure_signal",)),
        },
    },
    topics={
        "hydrogen": Shows((" hor", "hydrogen oxidation", "h2 oxidation"), values=("HOR_or_anode_reaction",)),
        "flow": Shows(("flow cell", "flow reactor", "continuous flow", "gde", "gas diffusion")),
        "gas_phase": Shows(("gas-phase ammonia", "gas phase ammonia", "gas-phase nh3", "gas phase nh3")),
        "plant": Shows(("plant", "industrial", "commercial", "process relevance", "scale-up", "scale up", "technoeconomic", "tea", "recycle", "auxiliary load", "balance of plant", "practical application")),
        "source": Shows(("n2 reduction", "nitrogen reduction", "dinitrogen", "n2-to-nh3", "n2 to nh3"), pattern="n2.*nh3|nh3.*n2"),
        "own_table": Shows(("this work", "our catalyst", "this study", "sample", "n-ov", "pristine")),
        "others_table": Shows(("previous reports", "previous studies", "literature summary", "review table")),
    },
    given={"NO3RR": "nitrogen_balance", "NO2RR": "nitrogen_balance", "NORR": "NOx_balance"},
    dinitrogen=("eNRR", "LiNRR"),
    hints={
        "product_admissibility": Shows(("15n", "15 n", "isotope", "isotopic", "blank", "nox", "contamination", "contaminant")),
        "cell_metric": Shows(("faradaic efficiency", "nh3 yield", "ammonia yield", "yield rate", "current density", "potential", "voltage", " v vs", "ma cm", "ma/cm"), pattern=r"\bfe\b"),
        "reactor_legibility": Shows(("flow", "gde", "gas diffusion", "hor", "hydrogen oxidation", "outlet", "runtime", "stability", "stable for")),
        "process_partial": Shows(("capture", "solvent inventory", "electrolyte inventory", "recycle", "h2 source", "hydrogen source", "auxiliary", "tea", "technoeconomic")),
    },
    controls={
        "NO3RR": ("nitrate/nitrite source accounting", "nitrogen mass balance"),
        "NO2RR": ("nitrate/nitrite source accounting", "nitrogen mass balance"),
        "NORR": ("NO source purity", "NOx balance", "gas handling blank"),
        "mixed": ("clarify nitrogen source", "nitrogen-source accounting"),
        "unclear": ("clarify nitrogen source",),
    },
)


def rank(boundary: Column, ladder: Sequence[str] = LADDER) -> Column:
    """The boundary's place on the ladder; 0 for an unknown one."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, ladder)), boundary), F.lit(0)) - 1, F.lit(0)).cast("int")


def boundary_of(ranks: Column, ladder: Sequence[str] = LADDER) -> Column:
    return F.element_at(F.array(*map(F.lit, ladder)), ranks + 1)


def join(supports: Sequence[tuple[str, Column]], ladder: Sequence[str] = LADDER) -> Column:
    """The rank of the highest boundary whose condition holds."""
    return F.greatest(*(F.when(c, F.lit(ladder.index(b))).otherwise(F.lit(0)) for b, c in supports), F.lit(0), F.lit(0)).cast("int")


def meet(caps: Sequence[tuple[str, Column]], ladder: Sequence[str] = LADDER) -> Column:
    """The rank of the lowest boundary whose condition holds; without one, the ladder's top."""
    return F.least(*(F.when(c, F.lit(ladder.index(b))).otherwise(F.lit(len(ladder) - 1)) for b, c in caps), *[F.lit(len(ladder) - 1)] * 2).cast("int")


def climb(supports: Sequence[tuple[str, Column]], caps: Sequence[tuple[str, Column]], ladder: Sequence[str] = LADDER) -> Column:
    return F.least(join(supports, ladder), meet(caps, ladder))


def best_supported(records: DataFrame, group: Sequence[str], boundary: str, ladder: Sequence[str] = LADDER) -> DataFrame:
    """(group, boundary, n): the highest boundary of each group's records and how many records reach it; ranks are counted before they move."""
    by_rank = records.groupBy(*group, rank(F.col(boundary), ladder).alias("_rank")).agg(F.count("*").alias("_n"))
    return by_rank.groupBy(*group).agg(F.max(F.struct("_rank", "_n")).alias("_top")).select(*group, boundary_of(F.col("_top._rank"), ladder).alias(boundary), F.col("_top._n").alias("n"))


def _get(records: DataFrame, name: str) -> Column:
    known = {c.lower() for c in records.columns}
    return F.col(f"`{name}`").cast("string") if name.lower() in known else F.lit(None).cast("string")


def stated(value: Column) -> Column:
    """Whether a value says something: neither missing nor unknown or unclear."""
    return (T.yes_no(value) != "missing") & ~F.coalesce(F.lower(F.trim(value)).isin("unknown", "unclear"), F.lit(False))


def shown(records: DataFrame, text: Column, by: Shows) -> Column:
    ways = [stated(_get(records, c)) for c in by.values] + [T.number(_get(records, c)).isNotNull() for c in by.numbers]
    ways += [text.contains(w) for w in by.words] + ([text.rlike(by.pattern)] if by.pattern else [])
    found = F.lit(False)
    for way in ways:
        found = found | F.coalesce(way, F.lit(False))
    return found


def check_state(records: DataFrame, text: Column, check: Check) -> Column:
    """yes, no, unclear or missing: a yes, stated or shown, counts before a no."""
    said = F.array(*(T.yes_no(_get(records, c)) for c in check.stated))
    yes = shown(records, text, Shows(check.words, check.pattern))
    no = F.coalesce(text.rlike(check.denied), F.lit(False)) if check.denied else F.lit(False)
    return first_match([("yes", F.array_contains(said, "yes") | yes), ("no", F.array_contains(said, "no") | no), ("unclear", F.array_contains(said, "unclear"))], "missing")


def facts(records: DataFrame, lexicon: Lexicon = DOMAIN, text_col: str = "source_text") -> DataFrame:
    """`records` with _text, _checks struct<check: state>, _facts struct<fact: boolean> and _topics struct<topic: boolean>."""
    found = records.withColumn("_text", F.lower(T.squeeze(F.coalesce(F.col(text_col), F.lit("")))))
    text = F.col("_text")
    found = found.withColumn("_checks", F.struct(*(check_state(found, text, c).alias(name) for name, c in lexicon.checks.items())))
    own = [(F.col(f"_checks.{by.check}") == "yes" if by.check else shown(found, text, by)).alias(name) for level in lexicon.levels.values() for name, by in level.items()]
    topics = [shown(found, text, by).alias(name) for name, by in lexicon.topics.items()]
    hints = join([(b, shown(found, text, by)) for b, by in lexicon.hints.items()]).alias("hint")
    return found.withColumns({"_facts": F.struct(*own), "_topics": F.struct(*topics, hints)})


def _names(conditions: Mapping[str, Column]) -> Column:
    return signals(dict(conditions)) if conditions else F.array().cast("array<string>")


def _list(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


@dataclass(frozen=True)
class Case:
    """A result for the records for which it is the first that holds. `gates`: own, or the one word that stands for all."""

    name: str
    holds: Column
    claim_type: Column
    boundary: Column
    status: Column
    missing: Column
    flags: Column
    controls: Column
    own_gates: bool = True

    def value(self) -> Column:
        made = {"case": F.lit(self.name), "claim_type": self.claim_type, "boundary": self.boundary, "status": self.status, "missing": self.missing, "flags": self.flags, "controls": self.controls, "own_gates": F.lit(self.own_gates)}
        return F.struct(*(c.alias(k) for k, c in made.items()))


def adjudicate(records: DataFrame, lexicon: Lexicon = DOMAIN, text_col: str = "source_text") -> DataFrame:
    """`records` with claim_type, maximum_supported_boundary, boundary_rank, admissibility_status, support_hint_boundary, validation_gates, boundary_fields_present and _missing, missing_boundary_fields, overclaim_risk_flags, required_controls, recommended_experiment and reason.

    Read are text_class, provenance_type, reaction_family, nitrogen_source, paired_body_evidence and the columns that the lexicon names.
    """
    family = F.coalesce(_get(records, "reaction_family"), F.lit("unclear"))
    known = (*lexicon.given, *lexicon.dinitrogen, "mixed")
    found = facts(records, lexicon, text_col).withColumns({
        "_family": F.when(family.isin(*known), family).otherwise("unclear"),
        "_class": T.label(_get(records, "text_class"), "unknown"),
        "_provenance": F.regexp_replace(F.lower(F.trim(F.coalesce(_get(records, "provenance_type"), F.lit("unknown")))), r"[\s-]+", "_"),
    })
    fact, check, topic = (lambda n: F.col(f"_facts.{n}")), (lambda n: F.col(f"_checks.{n}") == "yes"), (lambda n: F.col(f"_topics.{n}"))
    family, of_class, provenance = F.col("_family"), F.col("_class"), F.col("_provenance")
    level = {b: F.exists(F.array(*(fact(n) for n in names)), lambda x: x) for b, names in lexicon.levels.items()}
    present = {b: _names({n: fact(n) for n in names}) for b, names in lexicon.levels.items()}
    lacking = {b: _names({n: ~fact(n) for n in names}) for b, names in lexicon.levels.items()}

    unsure = family.isin("mixed", "unclear")
    settled = F.when(family.isin(*lexicon.given), check("blank_control") & check("contamination_control") & check("quantification_method")).when(unsure, F.lit(False)).otherwise(check("isotope_15N") & check("blank_control") & (check("nox_control") | check("contamination_control")))
    flows = topic("flow") | F.coalesce(F.lower(_get(records, "reactor_type")).contains("flow"), F.lit(False))
    claims_n2 = ~unsure & ~family.isin(*lexicon.given) & (family.isin(*lexicon.dinitrogen) | F.coalesce(F.lower(_get(records, "nitrogen_source")).isin("n2", "15n2"), F.lit(False)) | topic("source"))
    whole_matrix = fact("nh3_yield") & fact("charge_or_runtime") & fact("potential_or_voltage")
    metric, core = level["cell_metric"], fact("faradaic_efficiency") & fact("nh3_yield") & (fact("potential_or_voltage") | fact("current_density"))
    described = F.size(F.filter(F.array(*(fact(n) for n in lexicon.levels["reactor_legibility"] if n != "active_area")), lambda x: x))
    reactor = fact("reactor_type") & (fact("flow_rate") | fact("GDE_or_SSC") | fact("HOR_or_anode_reaction")) & fact("outlet_product_state") & (described >= 4)
    process = fact("gas_liquid_product_split") & fact("capture_route") & fact("solvent_inventory") & fact("hydrogen_source_boundary") & fact("voltage_basis")
    validated = of_class == "primary_performance_with_validation"
    lacks = {
        "n2_claim_without_15n": claims_n2 & ~check("isotope_15N"),
        "fe_without_complete_measurement_matrix": fact("faradaic_efficiency") & ~whole_matrix,
        "hor_claim_missing_hydrogen_source": topic("hydrogen") & ~fact("hydrogen_source_boundary"),
        "flow_claim_missing_outlet_or_wetting": flows & ~(fact("outlet_product_state") & fact("wetting_or_failure_disclosure")),
        "gas_phase_nh3_without_capture_route": topic("gas_phase") & ~fact("capture_route"),
        "plant_facing_without_process_closure": topic("plant") & ~process,
    }
    found = found.withColumns({
        "_lacks": F.struct(*(c.alias(n) for n, c in lacks.items())),
        "_settled": settled,
        "_supports": join([("product_admissibility", level["product_admissibility"]), ("cell_metric", metric), ("reactor_legibility", validated & reactor & metric & settled), ("process_partial", validated & process & core & settled)]),
        "_controls": F.array_distinct(F.concat(
            _names({"15N2 isotope validation": claims_n2 & ~check("isotope_15N")}),
            F.coalesce(F.element_at(F.create_map(*(x for k, v in lexicon.controls.items() for x in (F.lit(k), _list(*v)))), family), _list()) if lexicon.controls else _list(),
            _names({
                "Ar/N2-free blank": ~check("blank_control"), "NOx/nitrate/nitrite screening": ~check("nox_control"), "contamination-source accounting": ~check("contamination_control"), "H2-off/HOR-off control": topic("hydrogen"),
                "gas/liquid product accounting and wetting/flooding diagnosis": flows, "NH3 yield paired with FE": fact("faradaic_efficiency") & ~fact("nh3_yield"),
            }),
        )),
        "_owed": F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in {**lexicon.given, "mixed": "nitrogen_source_disambiguation", "unclear": "nitrogen_source_disambiguation"}.items() for x in (k, v))), family), F.lit("")),
        "_years": F.regexp_count("_text", F.lit(r"\b(?:19|20)\d{2}\b|\bet al\.?")),
    })
    lack, controls, own_controls = (lambda n: F.col(f"_lacks.{n}")), F.col("_controls"), _list("pair_with_primary_body_text")
    top = LADDER.index("reactor_legibility")
    capped = F.least(F.col("_supports"), meet([("reactor_legibility", lack("hor_claim_missing_hydrogen_source") | lack("flow_claim_missing_outlet_or_wetting") | lack("gas_phase_nh3_without_capture_route"))]))
    reached = F.when(lack("plant_facing_without_process_closure") & ((capped >= top) | level["process_partial"]), F.lit(len(LADDER) - 1)).otherwise(capped)
    found = found.withColumn("_reached", F.when(F.col("_text") == "", F.lit(0)).otherwise(reached))

    def lacking_up_to(ranks: Column) -> Column:
        below = [F.when(ranks >= LADDER.index(b), names).otherwise(_list()) for b, names in lacking.items()]
        open_end = F.when(topic("plant") | level["process_partial"], lacking["process_partial"]).otherwise(_list())
        return F.when(ranks == 0, lacking["product_admissibility"]).otherwise(F.concat(*below, open_end))

    low, body = provenance.isin(*LOW_TRUST), provenance.isin(*PRIMARY)
    conflict = (of_class.isin(*PRIMARY_CLASSES) & (low | provenance.isin("review_table", *CAPTIONS))) | (of_class.isin("reference_list", "review_table") & body)
    first = _names({"text_class_provenance_conflict": conflict})
    supplement = _names({"text_class_provenance_conflict": conflict, "supplementary_requires_crosscheck": provenance == "supplementary"})
    own_table = ~(of_class == "review_table") & ~topic("others_table") & ~(F.col("_text").contains("reference") & (F.col("_years") >= 3)) & (topic("own_table") | (metric & (F.col("_years") < 3)))
    table_rank = F.when(metric, F.lit(2)).otherwise(F.lit(1))
    paired = T.truthy(_get(records, "paired_body_evidence")) | T.truthy(_get(records, "paired_primary_body_evidence"))
    caption_type = first_match([("protocol_claim", of_class == "protocol_guideline"), ("negative_evidence_claim", of_class.isin(*NEGATIVE_CLASSES)), ("secondary_summary_claim", of_class.isin("figure_caption", "background_context", "review_table"))], "unsupported_claim")
    negative = _names({"NOx/nitrate/nitrite screening": ~check("nox_control"), "contamination-source accounting": ~check("contamination_control"), "Ar/N2-free blank": ~check("blank_control")})
    none, at, say = _list(), (lambda k: F.lit(LADDER[k])), F.lit
    own_type = first_match([
        ("process_claim", topic("plant") | level["process_partial"]), ("reactor_claim", flows | topic("hydrogen") | level["reactor_legibility"]), ("validation_claim", level["product_admissibility"] & ~metric),
    ], "performance_claim")
    complete = F.col("_settled") & ~lack("fe_without_complete_measurement_matrix")
    by_boundary = F.element_at(F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair)), boundary_of(F.col("_reached")))
    own_status = first_match([("weak_grounding", F.col("_text") == ""), ("metric_only_or_validation_incomplete", (F.col("_reached") == 2) & ~complete)], "")
    cases = [
        Case("provenance that is not trusted", low, say("unsupported_claim"), at(0), say("reject_or_low_trust_provenance"), _list("primary body text"), F.concat(first, _list("low_trust_provenance")), none, False),
        Case("table of a review", provenance == "review_table", say("secondary_summary_claim"), at(0), say("secondary_only"), _list("primary body text", "source-specific validation evidence"), F.concat(first, _list("review_table_not_primary")), own_controls, False),
        Case("table of own results", (provenance == "table") & own_table, say("performance_claim"), boundary_of(table_rank), say("table_metric_only_requires_body_pairing"), lacking_up_to(table_rank), F.concat(first, _list("table_requires_primary_body_pairing")), F.concat(controls, own_controls)),
        Case("table of others", provenance == "table", say("secondary_summary_claim"), at(0), say("secondary_only"), _list("primary body text"), F.concat(first, _list("table_not_primary_body_text")), F.concat(controls, own_controls)),
        Case("caption alone", provenance.isin(*CAPTIONS) & ~paired, caption_type, at(0), say("context_only_caption"), _list("primary body text pairing"), F.concat(first, _list("caption_not_primary_evidence", "pair_with_primary_body_text_required")), F.concat(controls, _list("primary body text pairing"), own_controls), False),
        Case("list of references", of_class == "reference_list", say("unsupported_claim"), at(0), say("reject"), _list("all primary boundary fields require source text outside the reference list"), supplement, none, False),
        Case("review table", of_class == "review_table", say("secondary_summary_claim"), at(0), say("secondary_only"), _list("primary source span", "source-specific validation evidence"), F.concat(supplement, _list("secondary_source_overclaim")), own_controls, False),
        Case("protocol", of_class == "protocol_guideline", say("protocol_claim"), at(1), say("protocol_only"), lacking["product_admissibility"], supplement, controls),
        Case("evidence of contamination", of_class.isin(*NEGATIVE_CLASSES), say("negative_evidence_claim"), at(1), say("negative_evidence"), negative, _list("negative_evidence_blocks_positive_claim"), F.concat(controls, negative)),
        Case("computation", of_class == "computational_screening", say("unsupported_claim"), at(0), say("computational_only"), _list("experimental NH3 quantification", "validation controls"), supplement, controls),
        Case("not primary", ~of_class.isin(*PRIMARY_CLASSES), say("unsupported_claim"), at(0), say("insufficient_primary_support"), _list("primary performance source class"), supplement, controls),
        Case("primary", F.lit(True), own_type, boundary_of(F.col("_reached")), F.when(own_status != "", own_status).otherwise(by_boundary), lacking_up_to(F.col("_reached")), F.concat(supplement, _names({n: lack(n) for n in lacks} | {"weak_source_grounding": F.col("_text") == ""})), controls),
    ]
    chosen = cases[-1].value()
    for case in reversed(cases[:-1]):
        chosen = F.when(case.holds, case.value()).otherwise(chosen)
    found = found.withColumn("_chosen", chosen)
    c = lambda n: F.col(f"_chosen.{n}")
    missing = F.array_distinct(F.filter(F.concat(c("missing"), F.array("_owed")), lambda m: m != ""))
    controls, flags = F.array_distinct(c("controls")), F.array_distinct(c("flags"))
    gates = F.create_map(*(x for n in lexicon.checks for x in (F.lit(n), F.when(c("own_gates"), F.col(f"_checks.{n}")).otherwise("secondary_only"))))
    advice = F.array_compact(F.array(
        F.when(F.size(controls) > 0, F.concat(F.lit("Run missing controls: "), F.array_join(controls, "; "))),
        F.when(F.size(missing) > 0, F.concat(F.lit("Report missing boundary fields: "), F.array_join(F.slice(missing, 1, 8), "; "))),
        F.when(F.array_contains(flags, "plant_facing_without_process_closure"), F.lit("Add process closure before making plant-facing claims.")),
    ))
    per_level = lambda of: F.create_map(*(x for b, names in of.items() for x in (F.lit(b), names)))
    return found.select(
        *records.columns, c("claim_type").alias("claim_type"), c("boundary").alias("maximum_supported_boundary"), rank(c("boundary")).alias("boundary_rank"), c("status").alias("admissibility_status"),
        F.when(c("case") == "caption alone", boundary_of(F.col("_topics.hint"))).otherwise(LADDER[0]).alias("support_hint_boundary"), gates.alias("validation_gates"), per_level(present).alias("boundary_fields_present"),
        per_level(lacking).alias("boundary_fields_missing"), missing.alias("missing_boundary_fields"), flags.alias("overclaim_risk_flags"), controls.alias("required_controls"), advice.alias("recommended_experiment"), c("case").alias("reason"),
    )
