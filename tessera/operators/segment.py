"""Segmentation of documents into lines, sections and paragraphs, with neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import pieces


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no from 1, start, line): every line with its offset in code points, blank lines too."""
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(pieces(F.col(text_col), "\n")).alias("_pos", "_p"))
    return found.select(id_col, (F.col("_pos") + 1).alias("line_no"), F.col("_p.start").alias("start"), F.col("_p.text").alias("line"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_no from 1, text): what blank lines part, trimmed, empty ones left out."""
    parts = F.filter(F.transform(F.split(F.col(text_col), r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return docs.select(F.col(id_col), F.posexplode(parts).alias("_pos", "text")).select(id_col, (F.col("_pos") + 1).alias("paragraph_no"), "text")


_ATX = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
_PARAGRAPH = re.compile(r"\S.*?(?=\n\s*\n|\Z)", re.DOTALL)

SECTIONS_SCHEMA = "id {id}, section_no int, level int, heading string, path array<string>, outline array<int>, parent_no int, start int, end int, paragraphs array<struct<start:int,end:int,text:string>>"


def _sections(text: str) -> list[tuple]:
    marks, at = [], 0
    for line in text.split("\n"):
        m = _ATX.match(line)
        if m:
            marks.append((at, len(m[1]), m[2], at + len(line)))
        at += len(line) + 1
    blocks = [(0, 0, None, 0)] if not marks or marks[0][0] > 0 else []
    blocks += marks
    found, stack, counts = [], [], {}
    for k, (start, level, heading, body) in enumerate(blocks):
        end = blocks[k + 1][0] if k + 1 < len(blocks) else len(text)
        while stack and stack[-1][1] >= level:
            stack.pop()
        parent = stack[-1] if stack else None
        outline_ahead = parent[3] if parent else []
        place = counts[tuple(outline_ahead)] = counts.get(tuple(outline_ahead), 0) + 1
        outline = [*outline_ahead, place]
        path = [*(parent[2] if parent else []), *([heading] if heading else [])]
        inside = [(m.start() + body, m.start() + body + len(m[0].rstrip()), m[0].rstrip()) for m in _PARAGRAPH.finditer(text[body:end])]
        found.append((k + 1, level, heading, path, outline, parent[0] if parent else None, start, end, inside))
        if heading:
            stack.append((k + 1, level, path, outline))
    return found


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a section of each Markdown document: number, level, heading, path, outline, parent, offsets and paragraphs.

    Text ahead of the first heading is a section without heading, of level 0. Offsets are code points of the whole text.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "section_no", "level", "heading", "path", "outline", "parent_no", "start", "end", "paragraphs"]
        for frame in frames:
            rows = [(i, *s) for i, text in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for s in _sections(text)]
            out = pd.DataFrame(rows, columns=names)
            out["paragraphs"] = [[{"start": a, "end": b, "text": t} for a, b, t in p] for p in out["paragraphs"]]
            out["parent_no"] = out["parent_no"].astype("Int32")
            yield out

    found = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col).mapInPandas(run, SECTIONS_SCHEMA.format(id=kind))
    return found.withColumnRenamed("id", id_col)


def section_paragraphs(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The paragraphs of `sections`: number in the section, offsets, relative place, and neighbours across the document."""
    order = Window.partitionBy(id_col).orderBy("start")
    rows = found.select(id_col, "section_no", "path", F.size("paragraphs").alias("_n"), F.posexplode("paragraphs").alias("_pos", "p"))
    rows = rows.select(id_col, "section_no", "path", (F.col("_pos") + 1).alias("in_section"), F.when(F.col("_n") > 1, F.col("_pos") / (F.col("_n") - 1)).otherwise(0.0).alias("relative"), "p.start", "p.end", "p.text")
    return rows.withColumn("number", F.row_number().over(order)).withColumn("previous_start", F.lag("start").over(order)).withColumn("next_start", F.lead("start").over(order))


def inherited_types(found: DataFrame, types: Column, id_col: str = "doc_id", unknown: str = "unknown", never: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """`found`, as `sections` makes it, with `direct_type` and `type`: an untyped section takes its parent's, one level up, unless that is one of `never`."""
    typed = found.withColumn("direct_type", types)
    parents = typed.select(F.col(id_col).alias("_id"), F.col("section_no").alias("_no"), F.col("level").alias("_level"), F.col("direct_type").alias("_type"))
    joined = typed.join(parents, (F.col(id_col) == F.col("_id")) & (F.col("parent_no") == F.col("_no")), "left")
    takes = (F.col("direct_type") == unknown) & (F.col("_type") != unknown) & ~F.col("_type").isin(*never) & (F.col("level") == F.col("_level") + 1)
    return joined.withColumn("type", F.when(F.coalesce(takes, F.lit(False)), F.col("_type")).otherwise(F.col("direct_type"))).drop("_id", "_no", "_level", "_type")


def neighbours(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, before: int = 1, after: int = 1) -> DataFrame:
    """`rows` with `before` and `after`: arrays of the values of the rows around each, in order."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("before", F.collect_list(value).over(w.rowsBetween(-before, -1))).withColumn("after", F.collect_list(value).over(w.rowsBetween(1, after)))


def nearest_in_section(rows: DataFrame, groups: Sequence[str], number: str, key: str, reach: int) -> DataFrame:
    """(key, other, distance): for each row those at most `reach` places away in its group."""
    w = Window.partitionBy(*groups).orderBy(number)
    seen = rows.withColumn("_place", F.row_number().over(w))
    around = Window.partitionBy(*groups).orderBy("_place").rowsBetween(-reach, reach)
    near = seen.withColumn("_near", F.collect_list(F.struct(F.col(key).alias("other"), F.col("_place").alias("at"))).over(around))
    return near.select(key, "_place", F.inline("_near")).where(F.col("at") != F.col("_place")).select(key, "other", F.abs(F.col("at") - F.col("_place")).alias("distance"))
