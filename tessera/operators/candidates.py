"""Candidate spans: windows of whole sentences that a trigger names, and windows around triggers, merged where they meet.

Windows of sentences are folded within a row. Windows around hits come from any number of rows of a document; they are
merged in cells of the document first and then over the cells' edges, so that one long document is not one task's work.

Defined results: a null or blank text has no candidates; equal windows of a document count once. A text of up to the limit
is a window by itself; a longer one without the end of a sentence is cut into windows of the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.rules import signals

MOST_CHARACTERS = 3000
# What names a candidate, strongest kind first; patterns ignore case.
TRIGGERS: Sequence[tuple[str, str]] = (
    ("quantification_signal", r"\b(?:quantif(?:y|ied|ication)|measur(?:e|ed|ement)|assay|indophenol|nessler|ion chromatograph|nmr|nuclear magnetic resonance|mass spectrom|colorimetric)\b"),
    ("validation_signal", r"\b(?:15\s*N|nitrogen[- ]15|isotop|blank control|contamination|impurit|NOx|mass balance|nitrogen balance|feed source|nitrogen source)\b"),
    ("performance_signal", r"\b(?:faradaic efficiency|FE|yield rate|ammonia yield|NH\s*3\s+yield|current density|selectivity|conversion|production rate)\b"),
    ("reactor_signal", r"\b(?:reactor|electroly[sz]er|flow cell|membrane electrode assembly|MEA|gas diffusion electrode|zero[- ]gap|cell configuration)\b"),
    ("process_signal", r"\b(?:process|plant[- ]level|scale[- ]up|techno[- ]economic|life cycle|separation|downstream|continuous operation|single[- ]pass)\b"),
    ("energy_boundary_signal", r"\b(?:energy efficiency|energy consumption|electricity|cell voltage|overpotential|energy intensity|kwh)\b"),
    ("product_state_signal", r"\b(?:aqueous ammonia|ammonium|NH\s*4|product concentration|product state|ammonia solution|anhydrous ammonia)\b"),
    ("control_signal", r"\b(?:control experiment|control test|argon blank|Ar blank|N2[- ]free|background ammonia|background NH\s*3)\b"),
    ("general_ammonia_context", r"\b(?:ammonia|NH\s*3|nitrogen reduction|NRR)\b"),
)
# The score of a candidate without and by trigger.
BASE, BY_TRIGGER = 0.35, 0.1


def _spans(rows: Column) -> Column:
    return rows.cast("array<struct<start:bigint,end:bigint>>")


def sentence_windows(text: Column, most: int = MOST_CHARACTERS) -> Column:
    """array<struct<start, end>> of as many whole sentences each as `most` characters hold; a longer sentence is a window by itself."""
    n = F.length(text)
    tiles = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*|[.!?\n]+"), F.lit(0))
    marked = T.let(tiles, lambda t: F.transform(t, lambda p, i: F.struct(F.length(p).cast("long").alias("n"), (p.rlike(r"^[^.!?\n]") & (p.rlike(r"[.!?]$") | (i == F.size(t) - 1))).alias("ends"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), _spans(F.array()).alias("done"))

    def add(a: Column, p: Column) -> Column:
        end = a["at"] + p["n"]
        cut = p["ends"] & (a["start"] >= 0) & (end - a["start"] > most) & (a["end"] > a["start"])
        start = F.when(p["ends"] & (cut | (a["start"] < 0)), a["at"]).otherwise(a["start"])
        return F.struct(end.alias("at"), start.alias("start"), F.when(p["ends"], end).otherwise(a["end"]).alias("end"), F.when(cut, F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["done"]).alias("done"))

    folded = F.aggregate(marked, zero, add, lambda a: F.when(a["start"] >= 0, F.array_append(a["done"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["done"]))
    even = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda k: F.struct((k * most).cast("long").alias("start"), F.least(n, (k + 1) * most).cast("long").alias("end")))
    whole = _spans(F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))))
    return F.when(n <= most, whole).otherwise(T.let(folded, lambda f: F.when(F.size(f) > 0, f).otherwise(even)))


def candidates(nodes: DataFrame, document_col: str = "document_id", start_col: str = "start", text_col: str = "text", triggers: Sequence[tuple[str, str]] = TRIGGERS, most: int = MOST_CHARACTERS) -> DataFrame:
    """`nodes` columns but the text, with candidate_start, candidate_end, candidate_text, candidate_kind, trigger_signals, candidate_score, candidate_priority and generation_method."""
    own = [c for c in nodes.columns if c != text_col]
    text = F.col(text_col)
    rows = nodes.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(*own, F.col(text_col).alias("_text"), F.explode(sentence_windows(text, most)).alias("_w"))
    method = F.when(F.length("_text") <= most, "whole_source_node").when(F.rlike("_text", F.lit(r"[^.!?\n](?:[.!?]|\z)")), "bounded_sentence_window").otherwise("bounded_character_window")
    rows = rows.select(*own, F.substr("_text", (F.col("_w.start") + 1).cast("int"), (F.col("_w.end") - F.col("_w.start")).cast("int")).alias("candidate_text"), (F.col(start_col) + F.col("_w.start")).alias("candidate_start"), (F.col(start_col) + F.col("_w.end")).alias("candidate_end"), method.alias("generation_method"))
    rows = rows.withColumn("trigger_signals", signals({name: F.rlike("candidate_text", F.lit(f"(?i){pattern}")) for name, pattern in triggers})).where(F.size("trigger_signals") > 0)
    rows = rows.dropDuplicates([document_col, "candidate_start", "candidate_end"])
    kinds = F.array(*(F.lit(name) for name, _ in triggers))
    kind = F.get("trigger_signals", F.lit(0))
    return rows.withColumns({"candidate_kind": kind, "candidate_score": F.round(F.least(F.lit(1.0), F.lit(BASE) + F.lit(BY_TRIGGER) * F.size("trigger_signals")), 3), "candidate_priority": F.array_position(kinds, kind).cast("int")})


def hits(nodes: DataFrame, pattern: str, start_col: str = "start", text_col: str = "text") -> DataFrame:
    """`nodes` columns but the text, with hit_start and hit_end of each match of the pattern."""
    own = [c for c in nodes.columns if c != text_col]
    rows = nodes.where(F.col(text_col).isNotNull()).select(*own, T.pieces(F.col(text_col), pattern).alias("_p"))
    between = F.transform("_p", lambda p, i: F.struct((p["start"] + F.length(p["text"])).alias("a"), F.get("_p", i + 1)["start"].alias("b")))
    return rows.select(*own, F.inline(between)).where("b is not null").select(*own, (F.col(start_col) + F.col("a")).alias("hit_start"), (F.col(start_col) + F.col("b")).alias("hit_end"))


def _islands(rows: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(ahead.isNull() | (F.col("start") > ahead + gap), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def merged(intervals: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, cell: int = 100_000) -> DataFrame:
    """(keys, start, end, n): intervals that overlap, or are `gap` apart at most, as one, and of how many it is made."""
    rows = intervals.select(*keys, F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.lit(1).cast("long").alias("n"))
    by_cell = _islands(rows.withColumn("_cell", F.floor(F.col("start") / cell)), [*keys, "_cell"], gap).drop("_cell")
    return _islands(by_cell, list(keys), gap)


def around(found: DataFrame, keys: Sequence[str], reach: int, length: str, gap: int = 0, cell: int = 100_000) -> DataFrame:
    """`merged` windows that reach this many characters to both sides of each hit, within 0 and `length`."""
    rows = found.select(*keys, F.greatest(F.col("hit_start") - reach, F.lit(0)).alias("_a"), F.least(F.col("hit_end") + reach, F.col(length)).alias("_b"))
    return merged(rows, keys, "_a", "_b", gap, cell)


def summary(found: DataFrame, nodes: DataFrame, document_col: str = "document_id") -> DataFrame:
    """(candidates, documents): how many documents have so many candidates, those with none included."""
    counts = nodes.select(document_col).distinct().join(found.groupBy(document_col).agg(F.count("*").alias("candidates")), document_col, "left")
    return counts.groupBy(F.coalesce("candidates", F.lit(0)).alias("candidates")).agg(F.count("*").alias("documents"))
