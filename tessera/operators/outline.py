"""The sections of Markdown documents as a tree: headings in three forms, parents, outline numbers and types from above.

A heading is a line that begins with `#` to `######` (up to three spaces ahead), a line that is underlined by `=` or `-`,
or a line by itself; the last two only if they are short and `label` knows them. A heading's parent is the nearest one
ahead of it with a lower level. There are six levels, so that a document's headings need one sorted pass with the latest
heading of each level at hand, however deep and long it is; lines are taken apart within their row.

Defined results: a null text has no sections, an empty one has one without heading. Text ahead of the first heading is a
section of level 0. Rows repeated in the table need ids of their own. Offsets are characters of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.provenance import section_label

UNKNOWN = "unknown"
LEVELS = 6
# What sections hand down to those below them; how long a heading without a mark may be.
NOT_HANDED_DOWN = ("title", "abstract", UNKNOWN)
LONGEST, MOST_WORDS = 140, 12
SURE = ("abstract", "methods", "results", "discussion", "results_and_discussion")
_WHITE = " \t\n\x0b\f\r"
# A heading's last character is looked for from the line's end, ahead of one run of closing marks: from its beginning, each character would be tried.
_MARKED = r"^\s{0,3}(#{1,6})\s+(.*(?:[^\s#\x85\u2028\u2029]|#(?=\s+#))|.)\s*#*\s*$"
_UNDERLINE = r"^\s*(?:=+|-+)\s*$"


def _rows(docs: DataFrame, id_col: str, text_col: str, label: Callable[[Column], Column]) -> DataFrame:
    """(id, start, level, heading, direct_type, form, _rank): headings with rank 1, and each text's start and end, of level 0, with ranks 0 and 2.

    A text is read once, and a line's patterns are worked out within its text's row: there no filter repeats them.
    """

    def taken(line: Column) -> Column:
        return F.struct(
            line["start"].alias("start"), line["next"].alias("_next"), F.regexp_extract(line["text"], _MARKED, 1).alias("_marks"), F.regexp_extract(line["text"], _MARKED, 2).alias("_said"),
            F.btrim(line["text"], F.lit(_WHITE)).alias("_bare"), F.lit(1).alias("_rank"),
        )

    def edge(start: Column, rank: int) -> Column:
        return F.struct(start.cast("long").alias("start"), F.lit("").alias("_next"), F.lit("").alias("_marks"), F.lit("").alias("_said"), F.lit("").alias("_bare"), F.lit(rank).alias("_rank"))

    def lines(pieces: Column) -> Column:
        return F.transform(pieces, lambda x, i: F.struct(x["start"].alias("start"), F.rtrim(x["text"], F.lit("\r")).alias("text"), F.coalesce(F.get(pieces, i + 1)["text"], F.lit("")).alias("next")))

    text = F.col(text_col)
    rows = docs.select(id_col, T.pieces(text, "\n").alias("_lines"), F.length(text).alias("_length"))
    # A null text has no lines, and so no rows.
    rows = rows.select(id_col, F.inline(F.concat(F.transform(lines(F.col("_lines")), taken), F.array(edge(F.lit(0), 0), edge(F.col("_length"), 2)))))
    marks, bare, in_text = F.col("_marks"), F.col("_bare"), F.col("_rank") == 1
    short = (bare != "") & (F.length(bare) <= LONGEST) & ~bare.contains("|") & ~F.left(bare, F.lit(1)).isin(">", "-", "*", "+") & (F.size(F.split(bare, r"\s+")) <= MOST_WORDS)
    rows = rows.where(~in_text | (marks != "") | short).withColumn("heading", F.when(marks != "", F.col("_said")).when(in_text, bare))
    rows = rows.withColumn("direct_type", F.when(in_text, label(F.col("heading"))).otherwise(UNKNOWN))
    known = (F.col("direct_type") != UNKNOWN) & (~bare.endswith(".") | (F.col("direct_type") == "references"))
    form = F.when(marks != "", "marked").when(F.rlike("_next", F.lit(_UNDERLINE)), "underlined").when(in_text, "plain")
    level = F.when(~in_text, 0).when(marks != "", F.length(marks)).when((form == "underlined") & F.trim("_next").startswith("="), 1).otherwise(2)
    return rows.where(~in_text | (marks != "") | known).select(id_col, "start", level.cast("int").alias("level"), "heading", "direct_type", form.alias("form"), "_rank")


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: Callable[[Column], Column] = section_label) -> DataFrame:
    """(id, start, level, heading, direct_type, form) of every heading."""
    return _rows(docs, id_col, text_col, label).where("_rank = 1").drop("_rank")


def _latest(value: Column, order: Window) -> list[Column]:
    """The latest heading's value at each level ahead of this one, by level."""
    return [F.last(F.when(F.col("level") == k, value), ignorenulls=True).over(order) for k in range(1, LEVELS + 1)]


def _above(latest: Column) -> Column:
    """Of those, the ones that are ancestors: below this level, and not ended by a later one of a lower level; outermost first."""
    return F.filter(latest, lambda h: (h["level"] < F.col("level")) & ~F.exists(latest, lambda g: (g["level"] < h["level"]) & (g["start"] > h["start"])))


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: Callable[[Column], Column] = section_label, not_handed_down: Sequence[str] = NOT_HANDED_DOWN) -> DataFrame:
    """(id, section_no, start, end, level, heading, form, path, outline, parent_start, direct_type, type, inherited_from, distance, broken, confidence).

    `type` is the section's own, or else that of the nearest typed ancestor, at any distance, as long as each level on the
    way is one below the other; `broken` tells that it is not. `outline` numbers siblings from 1.
    """
    # A document's rows are shuffled once; headings' texts only go along if their paths are asked for.
    order = Window.partitionBy(id_col).orderBy("start", "_rank")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    found = _rows(docs, id_col, text_col, label)
    # The parent is the latest of those with a lower level.
    found = found.withColumns({"_first": F.coalesce(F.max("level").over(ahead), F.lit(0)) == 0, "parent_start": F.greatest(*(F.when(F.col("level") > k, at) for k, at in enumerate(_latest(F.col("start"), ahead), 1)))})
    title = F.col("_first") & (F.col("level") == 1) & (F.col("direct_type") == UNKNOWN)
    found = found.withColumn("direct_type", F.when(title, "title").otherwise(F.col("direct_type")))
    found = found.withColumn("_place", F.row_number().over(Window.partitionBy(id_col, "parent_start", "_rank").orderBy("start")))
    own = F.struct("level", "start", F.col("direct_type").alias("type"), F.col("_place").alias("place"))
    found = found.withColumns({"_latest": F.array_compact(F.array(*_latest(own, ahead))), "_headings": F.array(*_latest(F.col("heading"), ahead))}).withColumn("_above", _above(F.col("_latest")))
    start = F.struct(F.lit(0).alias("level"), F.lit(UNKNOWN).alias("type"), F.lit(None).cast("long").alias("origin"), F.lit(0).alias("distance"), F.lit(False).alias("broken"))

    def down(above: Column, h: Column) -> Column:
        typed, next_ = h["type"] != UNKNOWN, (above["level"] == h["level"] - 1)
        takes = ~typed & next_ & ~above["type"].isin(*not_handed_down)
        return F.struct(
            h["level"].alias("level"), F.when(typed, h["type"]).when(takes, above["type"]).otherwise(UNKNOWN).alias("type"), F.when(typed, h["start"]).when(takes, above["origin"]).alias("origin"),
            F.when(takes, above["distance"] + 1).otherwise(0).alias("distance"), (~typed & ~next_ & (above["level"] > 0)).alias("broken"),
        )

    found = found.withColumn("_took", F.aggregate(F.concat("_above", F.array(own)), start, down))
    inherited = (F.col("direct_type") == UNKNOWN) & (F.col("_took.type") != UNKNOWN)
    confidence = F.when(inherited, F.when(F.col("_took.distance") == 1, "medium").otherwise("low")).when(F.col("direct_type") == UNKNOWN, "low").when(F.col("direct_type").isin(*SURE), "high").otherwise("medium")
    # A row at a document's end gives its last section's end; a text that no heading begins has a section of its own ahead of them.
    found = found.withColumns({"end": F.lead("start").over(order), "_next": F.lead("_rank").over(order)}).where("_rank = 1 or (_rank = 0 and (end > 0 or _next = 2))")
    is_heading = F.col("_rank") == 1
    path = F.concat(F.transform("_above", lambda h: F.get("_headings", h["level"] - 1)), F.array("heading"))
    places = F.concat(F.transform("_above", lambda h: h["place"]), F.array("_place"))
    return found.select(
        id_col, F.row_number().over(order).alias("section_no"), "start", "end", "level", "heading", "form", F.when(is_heading, path).otherwise(F.array().cast("array<string>")).alias("path"), F.when(is_heading, places).otherwise(F.array().cast("array<int>")).alias("outline"),
        "parent_start", "direct_type", F.col("_took.type").alias("type"), F.when(inherited, F.col("_took.origin")).alias("inherited_from"), F.when(inherited, F.col("_took.distance")).alias("distance"), F.col("_took.broken").alias("broken"), confidence.alias("confidence"),
    )
