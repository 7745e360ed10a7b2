"""Families of texts by weighted evidence: points, the decision, whole documents, and consensus by group.

A family's evidence is a table of rules; `scores` is array<struct<family, points>> in the families' order, which also
settles ties. `unclear` stands for no family, `mixed` for several.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import first_match

UNCLEAR, MIXED = "unclear", "mixed"
# Points for a clear family, for a likely one, and the lead that tells two clear ones apart.
CLEAR, LIKELY, LEAD = 6, 4, 3
# Points of a stated family; a consensus' points and lead for high confidence; the least points of a vote.
STATED, SURE, SURE_LEAD, LEAST_VOTE = 8, 10, 4, 4
# What a vote's place, scope and confidence add to its points.
VOTE_WEIGHTS = {"abstract": 4, "results": 2, "methods": 2, "discussion": 2, "body": 2, "explicit": 3, "high": 2}


@dataclass(frozen=True)
class Evidence:
    """`points` for `family` where all patterns of `needs` occur in a text and `unless` does not."""

    family: str
    points: int
    signal: str
    needs: tuple[str, ...]
    unless: str | None = None

    def holds(self, text: Column) -> Column:
        found = F.lit(True)
        for pattern in self.needs:
            found = found & F.coalesce(text.rlike(pattern), F.lit(False))
        return found & ~F.coalesce(text.rlike(self.unless), F.lit(False)) if self.unless else found


def family_label(value: Column, aliases: Mapping[str, str], families: Sequence[str]) -> Column:
    """A family for its name or an alias, whatever the case and the signs between its words; else unclear."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "_"), "^_|_$", "")
    known = {f.lower(): f for f in families} | dict(aliases)
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), key), F.lit(UNCLEAR))


def family_scores(parts: Sequence[tuple[Column, int]], evidence: Sequence[Evidence], families: Sequence[str]) -> Column:
    """The points of each family over the parts (text, weight)."""

    def total(family: str) -> Column:
        return sum((F.when(e.holds(text), F.lit(e.points * weight)).otherwise(F.lit(0)) for text, weight in parts for e in evidence if e.family == family), F.lit(0))

    return F.array(*(F.struct(F.lit(f).alias("family"), total(f).cast("int").alias("points")) for f in families))


def subsumed(scores: Column, strong: str, weak: str, cap: int = 3) -> Column:
    """Where both families are clear, the weak one's points fall to `cap`: its evidence was the strong one's."""
    clear = F.size(F.filter(scores, lambda s: s["family"].isin(strong, weak) & (s["points"] >= CLEAR))) == 2
    return F.transform(scores, lambda s: F.struct(s["family"].alias("family"), F.when(clear & (s["family"] == weak), F.least(s["points"], F.lit(cap))).otherwise(s["points"]).alias("points")))


def family_signals(parts: Sequence[tuple[str, Column]], evidence: Sequence[Evidence]) -> Column:
    """`part:signal` of all evidence that holds, by part."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(e.holds(text), F.lit(f"{name}:{e.signal}")) for name, text in parts for e in evidence))))


def _ranked(scores: Column) -> Column:
    return F.array_sort(F.transform(scores, lambda s, i: F.struct((-s["points"]).alias("less"), i.alias("place"), s["family"].alias("family"))))


def _decision(family: Column, confidence: Column, conflict: Column) -> Column:
    return F.struct(family.alias("family"), confidence.alias("confidence"), conflict.alias("conflict"))


def decide_family(scores: Column, stated: Column | None = None) -> Column:
    """struct<family, confidence, conflict>: a stated family stays, in conflict if the text clearly has another; else the points decide."""
    if stated is not None:
        raised = F.transform(scores, lambda s: F.struct(s["family"].alias("family"), F.when(s["family"] == stated, F.greatest(s["points"], F.lit(STATED))).otherwise(s["points"]).alias("points")))
        first = F.get(_ranked(raised), F.lit(0))
        kept = _decision(stated, F.lit("high"), (first["family"] != stated) & (first["less"] <= -CLEAR))
        return F.when(F.coalesce(stated != UNCLEAR, F.lit(False)), kept).otherwise(decide_family(scores))
    ranked = _ranked(scores)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    top, next_ = -first["less"], F.coalesce(-second["less"], F.lit(0))
    both = (next_ >= CLEAR) & (top - next_ <= LEAD)
    family = F.when(both, MIXED).when(top >= LIKELY, first["family"]).otherwise(UNCLEAR)
    confidence = first_match([("medium", both), ("high", top >= CLEAR), ("medium", top >= LIKELY)], UNCLEAR)
    return _decision(family, confidence, F.coalesce(both, F.lit(False)))


def document_family(title: Column, abstract: Column, headings: Column, spans: Column) -> Column:
    """struct<family, confidence, conflict, others> of a document.

    `title`, `abstract` and `headings` hold the families clear there, else unclear; `spans` is an array of those stated in
    its spans. The first that is clear decides, spans only if they agree; `others` are what disagrees with title or abstract.
    """

    def clear(f: Column) -> Column:
        return F.coalesce(f != UNCLEAR, F.lit(False))

    found = F.array_distinct(F.filter(F.coalesce(spans, F.array().cast("array<string>")), clear))
    said = F.when(clear(title), F.concat(F.array(abstract, headings), found)).when(clear(abstract), F.concat(F.array(headings), found)).otherwise(F.array().cast("array<string>"))
    alone = F.when(F.size(found) == 1, F.get(found, F.lit(0))).when(F.size(found) > 1, MIXED).otherwise(UNCLEAR)
    family = F.when(clear(title), title).when(clear(abstract), abstract).when(clear(headings), headings).otherwise(alone)
    confidence = first_match([("high", clear(title) | clear(abstract)), ("medium", clear(headings) | (F.size(found) > 0))], UNCLEAR)
    others = F.sort_array(F.array_distinct(F.filter(said, lambda f: clear(f) & (f != family))))
    conflict = (F.size(others) > 0) | (~clear(title) & ~clear(abstract) & ~clear(headings) & (F.size(found) > 1))
    return F.struct(family.alias("family"), confidence.alias("confidence"), conflict.alias("conflict"), others.alias("others"))


def effective_family(target: Column, explicit: Column, document: Column, document_confidence: Column, earlier: Column) -> Column:
    """struct<family, source, correction, conflict>: an explicit span's family, else a sure document's, else the earlier label."""
    in_span = explicit & ~target.isin(UNCLEAR, MIXED)
    sure = (document_confidence == "high") & ~document.isin(UNCLEAR, MIXED)
    source = first_match([("span", in_span), ("document", sure), ("earlier", earlier != UNCLEAR)], UNCLEAR)
    family = F.when(in_span, target).when(sure, document).otherwise(earlier)
    correction = (earlier != UNCLEAR) & (family != UNCLEAR) & (earlier != family)
    return F.struct(family.alias("family"), source.alias("source"), correction.alias("correction"), (sure & ~in_span & ~earlier.isin(UNCLEAR, MIXED) & (earlier != document)).alias("conflict"))


def vote_weight(place: Column, explicit: Column, confidence: Column) -> Column:
    w = VOTE_WEIGHTS
    by_place = F.when(place == "abstract", w["abstract"]).when(place.isin("results", "methods", "discussion", "body"), w["body"]).otherwise(0)
    return by_place + F.when(explicit, w["explicit"]).otherwise(0) + F.when(confidence == "high", w["high"]).otherwise(0)


def family_consensus(records: DataFrame, group: str, family: str, confidence: str, points: Column, weight: Column, families: Sequence[str]) -> DataFrame:
    """(group, consensus, consensus_confidence, votes) by the points of clear and likely records.

    Points are added by group and family before they move, so that a group of any size comes to one row a family.
    """
    votes = records.where(F.col(confidence).isin("high", "medium") & ~F.col(family).isin(UNCLEAR, MIXED))
    totals = votes.groupBy(group, family).agg(F.sum(F.greatest(points, F.lit(LEAST_VOTE)) + weight).alias("_points"), F.count("*").alias("_votes"))
    place = F.array_position(F.array(*map(F.lit, families)), F.col(family))
    ranked = totals.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col("_points")).alias("less"), place.alias("place"), F.col(family).alias("family")))).alias("_r"), F.sum("_votes").alias("votes"))
    top, second = -F.get("_r", F.lit(0))["less"], F.coalesce(-F.get("_r", F.lit(1))["less"], F.lit(0))
    few, both = top < CLEAR, (second >= CLEAR) & (top - second <= LEAD)
    name = F.when(few, UNCLEAR).when(both, MIXED).otherwise(F.get("_r", F.lit(0))["family"])
    sure = first_match([(UNCLEAR, few), ("medium", both), ("high", (top >= SURE) & (top - second >= SURE_LEAD))], "medium")
    return ranked.select(group, name.alias("consensus"), sure.alias("consensus_confidence"), "votes")


def with_consensus(records: DataFrame, consensus: DataFrame, group: str, family: str, confidence: str, fillable: Column) -> DataFrame:
    """`records` with `final_family`, `final_confidence`, `filled` and `against`.

    A group's consensus fills the unclear records that are `fillable` (little evidence, trusted place), one step less
    sure; `against` marks clear records of another family. The join is by group; adaptive splitting deals with a hot one.
    """
    joined = records.join(consensus.withColumnRenamed(group, "_group"), F.col(group) == F.col("_group"), "left").drop("_group")
    agreed = F.coalesce(~F.col("consensus").isin(UNCLEAR, MIXED), F.lit(False))
    own = F.col(family)
    filled = agreed & fillable & (own == UNCLEAR) & F.col(confidence).isin(UNCLEAR, "low")
    against = agreed & ~own.isin(UNCLEAR, MIXED) & (own != F.col("consensus")) & F.col(confidence).isin("high", "medium")
    less = F.when(F.col("consensus_confidence") == "high", "medium").otherwise("low")
    return joined.select("*", F.when(filled, F.col("consensus")).otherwise(own).alias("final_family"), F.when(filled, less).otherwise(F.col(confidence)).alias("final_confidence"), filled.alias("filled"), against.alias("against"))


def gate(text: Column, shown: str, denied: str | None = None, stated: Column | None = None) -> Column:
    """struct<satisfied, source, conflict>: whether a check was made, by a record's own word or else by its text.

    `shown` and `denied` are patterns. What the record states (yes, explicit, pass, present) counts unless the text denies
    it, which is a conflict; a text that denies never satisfies.
    """
    said = F.lower(F.trim(stated)).isin("yes", "explicit", "pass", "present") if stated is not None else F.lit(False)
    said = F.coalesce(said, F.lit(False))
    no = F.coalesce(text.rlike(denied), F.lit(False)) if denied else F.lit(False)
    yes = F.coalesce(text.rlike(shown), F.lit(False))
    source = first_match([("stated", said), ("text", yes & ~no)], "")
    return F.struct(((said | yes) & ~no).alias("satisfied"), source.alias("source"), (said & no).alias("conflict"))

