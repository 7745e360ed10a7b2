"""The domain's families of ammonia synthesis: names, evidence and what a record's text, title and abstract say together.

The evidence is data for the engine of `families`. Patterns are over lower-case text with single blanks, one of them at each end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import families
from tessera.operators.families import UNCLEAR, Evidence

# The families in order, and other names of them.
FAMILIES = ("eNRR", "LiNRR", "NO3RR", "NO2RR", "NORR", "mixed")
ALIASES = {
    "unknown": "unclear", "not_specified": "unclear", "ambiguous": "unclear", "mixed_source": "mixed", "multiple": "mixed", "nrr": "eNRR", "enrr": "eNRR", "e_nrr": "eNRR", "electrochemical_nrr": "eNRR", "electrochemical_nitrogen_reduction": "eNRR",
    "li_nrr": "LiNRR", "linrr": "LiNRR", "li_mediated_nrr": "LiNRR", "lithium_mediated_nrr": "LiNRR", "lithium_mediated": "LiNRR", "no3rr": "NO3RR", "no3_rr": "NO3RR", "nitrate_reduction": "NO3RR", "nitrate_rr": "NO3RR",
    "no2rr": "NO2RR", "no2_rr": "NO2RR", "nitrite_reduction": "NO2RR", "nitrite_rr": "NO2RR", "norr": "NORR", "no_rr": "NORR", "nitric_oxide_reduction": "NORR",
}
ABSTRACT_WEIGHT = 2


def _any(*phrases: str) -> str:
    return "|".join(re.escape(p) for p in phrases)


def _both_ways(what: str, of: str) -> str:
    """One within 45 characters of the other."""
    return rf"\b(?:{what})\b.{{0,45}}\b(?:{of})\b|\b(?:{of})\b.{{0,45}}\b(?:{what})\b"


def _all(*patterns: str) -> str:
    return "^" + "".join(f"(?=.*(?:{p}))" for p in patterns)


# Wording that several pieces of evidence share.
_N2_REACTION = _any("n2 reduction", "nitrogen reduction", "dinitrogen reduction", "n2-to-nh3", "n2 to nh3", "nitrogen-to-ammonia", "nitrogen to ammonia")
_LI_SALT = _any("li salt", "lithium salt", "liclo4", "litfsi", "lipf6", "liotf", "li triflate", "li+")
_INTERPHASE = _any("nonaqueous", "non-aqueous", "tetrahydrofuran", " thf ", "diglyme", "glyme", "ether", "solid electrolyte interphase", " sei ", "interphase")
_EXPLICIT_LI = _any("linrr", "li-nrr", "li nrr", "lithium-mediated nitrogen reduction", "lithium mediated nitrogen reduction", "li-mediated nrr", "li mediated nrr")
_MEDIATED, _OF_N2 = _any("lithium-mediated", "lithium mediated", "li-mediated", "li mediated"), _any("n2", "nitrogen reduction", "nrr", "dinitrogen", "ammonia", "nh3")
_PLATING, _NITRIDE = _any("li plating", "lithium plating", "li deposition", "lithium deposition"), _any("nitridation", "protonation", "lithium nitride", "li3n")
_FEED, _SOURCE = "feed|reactant|substrate|nitrogen source|source", "feed|reactant|substrate|source"
_NITRATE_FEED = f"{_both_ways('nitrate', _FEED)}|{_both_ways('no3', _SOURCE)}"
_NITRITE_FEED = f"{_both_ways('nitrite', _FEED)}|{_both_ways('no2', _SOURCE)}"


def _screened(ion: str, feed: str, short: str) -> str:
    """The ion is spoken of as an impurity, and nowhere as what is fed."""
    screened = _any(f"{ion} screening", f"screening {ion}", f"{ion} impurity", f"{ion} contamination", f"exclude {ion}", f"excluded {ion}", f"background {ion}", "nox contamination", "background nox")
    return f"^(?!.*(?:{feed}|{ion}[- ]to[- ]ammonia|{short}rr)).*(?:{screened})"


_NO_NITRATE, _NO_NITRITE = _screened("nitrate", _NITRATE_FEED, "no3"), _screened("nitrite", _NITRITE_FEED, "no2")
#: A nitrate paper that compares itself with dinitrogen reduction.
_COMPARED = _all(r"\bnitrate (?:electro)?reduction\b|\bno3\s*-{0,2}\s*(?:to|reduction)\b|kno3", r"\breported\s+n2[- ]to[- ]nh3\s+conversions?\b|\bdifferent from n2 reduction studies\b|\b(?:compared|comparison|benchmark(?:ed)?)\b.{0,120}\bn2[- ](?:to[- ]nh3|reduction)\b")
_CLEARLY_LI = f"{_EXPLICIT_LI}|{_all(_MEDIATED, _OF_N2)}|{_all(_PLATING, _NITRIDE)}|{_all(_N2_REACTION, _LI_SALT, _INTERPHASE)}"

# Points, name and wording of each piece of evidence.
EVIDENCE = (
    Evidence("mixed", 8, "mixed_nitrogen_source", (_any("mixed nitrogen source", "multiple nitrogen sources", "nitrate and n2", "nitrite and n2"),)),
    Evidence("LiNRR", 9, "explicit_lithium_mediated_nrr", (_EXPLICIT_LI,)),
    Evidence("LiNRR", 8, "lithium_mediated_n2_reduction", (_MEDIATED, _OF_N2)),
    Evidence("LiNRR", 8, "li_plating_nitridation_protonation", (_PLATING, _NITRIDE)),
    Evidence("LiNRR", 7, "n2_li_salt_nonaqueous_interphase_reaction", (_N2_REACTION, _LI_SALT, _INTERPHASE)),
    Evidence("LiNRR", 1, "li_salt_context", (_LI_SALT,)),
    Evidence("LiNRR", 1, "thf_context", (_any("tetrahydrofuran", " thf ", " thf.", " thf,", " thf)"),)),
    Evidence("LiNRR", 1, "nonaqueous_or_interphase_context", (_INTERPHASE,)),
    Evidence("eNRR", 8, "explicit_enrr", (_any("enrr", "e-nrr", "electrochemical nrr"),), _COMPARED),
    Evidence("eNRR", 8, "n2_to_ammonia", (_any("n2-to-nh3", "n2 to nh3", "dinitrogen to ammonia", "dinitrogen-to-ammonia"),), _COMPARED),
    Evidence("eNRR", 7, "n2_feed_or_source", (_any("n2 feed", "n2 gas feed", "nitrogen gas feed", "n2 as nitrogen source", "n2 as the nitrogen source"),), _COMPARED),
    Evidence("eNRR", 7, "nitrogen_reduction_under_n2", (_any("electrochemical nitrogen reduction under n2", "nitrogen reduction under n2"),), _COMPARED),
    Evidence("eNRR", 7, "15n2_nitrogen_source", (_any("15n2", "15 n2"),), _COMPARED),
    Evidence("eNRR", 6, "n2_reduction_reaction", (_N2_REACTION,), _COMPARED),
    Evidence("eNRR", 6, "nrr_without_lithium_mediation", (r"\bnrr\b",), f"{_COMPARED}|{_CLEARLY_LI}"),
    Evidence("NO3RR", 9, "explicit_no3rr", (r"\bno3\s*rr\b",), _NO_NITRATE),
    Evidence("NO3RR", 8, "nitrate_to_ammonia", (_any("nitrate-to-ammonia", "nitrate to ammonia", "no3- to nh3", "no3 to nh3"),), _NO_NITRATE),
    Evidence("NO3RR", 8, "nitrate_reduction_reaction", (_any("nitrate reduction reaction", "nitrate electroreduction", "nitrate reduction to ammonia"),), _NO_NITRATE),
    Evidence("NO3RR", 8, "explicit_electrochemical_nitrate_reduction", (r"\b(?:electrochemical|electrocatalytic) nitrate reduction\b",), _NO_NITRATE),
    Evidence("NO3RR", 8, "no3_to_nh3", (r"\bno3\s*-+\s*to\s*-?\s*nh3\b",), _NO_NITRATE),
    Evidence("NO3RR", 7, "nitrate_feed_or_source", (_NITRATE_FEED,), _NO_NITRATE),
    Evidence("NO2RR", 9, "explicit_no2rr", (r"\bno2\s*rr\b",), _NO_NITRITE),
    Evidence("NO2RR", 8, "nitrite_to_ammonia", (_any("nitrite-to-ammonia", "nitrite to ammonia", "no2- to nh3", "no2 to nh3"),), _NO_NITRITE),
    Evidence("NO2RR", 8, "no2_reduction_to_ammonia", (r"\bno2\s*-?\s+reduction\s+to\s+(?:ammonia|nh3)\b",), _NO_NITRITE),
    Evidence("NO2RR", 8, "nitrite_reduction_reaction", (_any("nitrite reduction reaction", "nitrite electroreduction", "nitrite reduction to ammonia"),), _NO_NITRITE),
    Evidence("NO2RR", 7, "nitrite_feed_or_source", (_NITRITE_FEED,), _NO_NITRITE),
    Evidence("NORR", 9, "explicit_norr", (r"\bno\s*rr\b",)),
    Evidence("NORR", 8, "no_to_ammonia_or_reduction", (_any("nitric oxide reduction", "nitric oxide electroreduction", "no-to-ammonia", "no to ammonia", "no-to-nh3", "no to nh3"),)),
    Evidence("NORR", 8, "no_reduction_to_ammonia", (r"\bno\s+reduction\s+to\s+(?:ammonia|nh3)\b",)),
    Evidence("NORR", 7, "no_feed_or_source", (_both_ways("no|nitric oxide", _FEED),), "nox"),
)


def padded(text: Column) -> Column:
    squeezed = F.lower(T.squeeze(F.coalesce(text.cast("string"), F.lit(""))))
    return F.when(squeezed == "", "").otherwise(F.concat(F.lit(" "), squeezed, F.lit(" ")))


def family_label(value: Column) -> Column:
    return families.family_label(value, ALIASES, (*FAMILIES, UNCLEAR))


def with_family(records: DataFrame, text_col: str, title_col: str | None = None, abstract_col: str | None = None, stated_col: str | None = None, default: str = UNCLEAR) -> DataFrame:
    """`records` with family, family_confidence, family_conflict, family_scope, family_scores and family_signals.

    A stated family stays; a default stands in, with low confidence, where nothing is found. The scope tells whether the
    record's own text decided (explicit_span), its title or abstract (section_context), or neither (fallback).
    """
    parts = {"_span": text_col} | ({"_title": title_col} if title_col else {}) | ({"_abstract": abstract_col} if abstract_col else {})
    rows = records.withColumns({name: padded(F.col(c)) for name, c in parts.items()})
    weighted = [(F.col(name), ABSTRACT_WEIGHT if name == "_abstract" else 1) for name in parts]
    named = [(name.removeprefix("_"), F.col(name)) for name in parts]
    rows = rows.withColumns({"_scores": families.subsumed(families.family_scores(weighted, EVIDENCE, FAMILIES), "LiNRR", "eNRR"), "family_signals": families.family_signals(named, EVIDENCE)})
    own = [e for e in EVIDENCE if e.points > 1]
    rows = rows.withColumn("_explicit", F.exists(F.array(*(e.holds(F.col("_span")) for e in own)), lambda x: x))
    stated = family_label(F.col(stated_col)) if stated_col else F.lit(UNCLEAR)
    rows = rows.withColumn("_stated", stated).withColumn("_found", families.decide_family(F.col("_scores"), F.col("_stated")))
    found, is_stated = F.col("_found.family"), F.col("_stated") != UNCLEAR
    fills = (found == UNCLEAR) & F.lit(default != UNCLEAR)
    outer = F.lit(False)
    for name in ("_title", "_abstract"):
        if name in parts:
            outer = outer | (F.col(name) != "")
    sure = F.array_max(F.transform("_scores", lambda s: s["points"])) >= families.CLEAR
    scope = F.when(is_stated, "explicit_span").when(found == UNCLEAR, "fallback").when(sure & F.col("_explicit"), "explicit_span").when(outer | ~sure, "section_context").otherwise("explicit_span")
    return rows.select(*records.columns, F.when(fills, default).otherwise(found).alias("family"), F.when(fills, "low").otherwise(F.col("_found.confidence")).alias("family_confidence"), F.col("_found.conflict").alias("family_conflict"), scope.alias("family_scope"), F.col("_scores").alias("family_scores"), "family_signals")
