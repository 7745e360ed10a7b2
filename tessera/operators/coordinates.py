"""Where spans stand in their documents: exact places by a positional index of words, sections by place, anchors and ids.

A span is looked for as a run of whole words; white space does not count, so that line breaks and no-break spaces are as
good as spaces. The distinct spans of a document come to its text in groups of at most GROUP; one pass over the text's words
looks up each run of WIDTH words (of fewer, for shorter spans) among the spans' first words, and compares the rest where one
begins. So the work grows with the words of documents and spans, not with their product, and no word is shuffled by itself.

Defined results: a null or blank span, and one whose document is not there, is unresolved (exact_text_not_found,
document_unresolved); one that is found at several places is unresolved (multiple_exact_matches), with all of them as
candidates, unless stated offsets or its section tell which. Rows keep all their columns; their ids need not be unique.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

WIDTH, GROUP = 3, 10_000
_WORD = r"[^\s\xA0]+"
# Java's white space, which Python's is more than.
_WORDS = re.compile(r"[^ \t\n\x0B\f\r\xA0]+")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))


def _said(text: Column) -> Column:
    return F.array_join(words(text), " ")


def _runs(text: str, asked: list[str]) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of each place of each of the spans, whose words are apart by a space."""
    spans = [said.split(" ") for said in asked]
    firsts: dict[int, dict[tuple, list[int]]] = {}
    for k, span in enumerate(spans):
        if asked[k]:
            firsts.setdefault(min(len(span), WIDTH), {}).setdefault(tuple(span[:WIDTH]), []).append(k)
    held = [(m[0], m.start(), m.end()) for m in _WORDS.finditer(text)] if firsts else []
    tokens = [word for word, _, _ in held]
    for width, known in firsts.items():
        for at, gram in enumerate(zip(*(tokens[k:] for k in range(width)))):
            for k in known.get(gram, ()):
                n = len(spans[k])
                if at + n <= len(tokens) and (n <= WIDTH or tokens[at : at + n] == spans[k]):
                    yield k, held[at][1], held[at + n - 1][2]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, said, start, end) of each place; a span without one has a row without offsets."""
    for batch in batches:
        rows, said, starts, ends = [], [], [], []
        for row, (text, asked) in enumerate(zip(batch["text"], batch["asked"])):
            spans = asked.as_py()
            missing = set(range(len(spans)))
            for k, start, end in _runs(text.as_py(), spans):
                missing.discard(k)
                rows.append(row), said.append(spans[k]), starts.append(start), ends.append(end)
            rows += [row] * len(missing)
            said += [spans[k] for k in missing]
            starts += [None] * len(missing)
            ends += [None] * len(missing)
        yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(rows, pa.int32())), pa.array(said, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "said", "start", "end"])


def _looked_up(spans: DataFrame, docs: DataFrame, id_col: str, span_text: str, text_col: str) -> DataFrame:
    """(id, key, candidates) of each distinct span of a document that is there, also of those without a place."""
    asked = spans.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _said(F.col(span_text)).alias("said")).repartition("id").distinct()
    number = F.row_number().over(Window.partitionBy("id").orderBy("said"))
    groups = asked.withColumn("_group", F.floor(number / GROUP)).groupBy("id", "_group").agg(F.collect_list("said").alias("asked"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = spans.schema[id_col].dataType.simpleString()
    found = groups.join(texts.withColumn("id", F.col("id").cast(kind)), "id").select("id", "text", "asked").mapInArrow(_found, f"id {kind}, said string, start bigint, end bigint")
    candidates = F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end"))))
    return found.select("id", F.sha2("said", 256).alias("key"), "start", "end").groupBy("id", "key").agg(candidates.alias("candidates")).withColumnRenamed("id", id_col)


def places(spans: DataFrame, docs: DataFrame, id_col: str = "document_id", span_text: str = "source_text", text_col: str = "text") -> DataFrame:
    """(id, key, candidates array<struct<start, end>>) of each distinct span that has a place; key is that of `span_key`."""
    return _looked_up(spans, docs, id_col, span_text, text_col).where(F.size("candidates") > 0)


def span_key(text: Column) -> Column:
    return F.sha2(_said(text), 256)


def locate(spans: DataFrame, docs: DataFrame, id_col: str = "document_id", span_text: str = "source_text", text_col: str = "text", given: tuple[str, str] | None = None, section: tuple[str, str] | None = None) -> DataFrame:
    """`spans` with mapping_method, mapping_confidence, mapping_warnings, verified_start, verified_end and candidates.

    `given`: columns with stated offsets, which hold if the span stands there; `section`: columns with a section's bounds,
    within which a span that stands once is resolved even if it stands elsewhere as well.
    """
    # A document that is there has a row for each of its spans, found or not.
    found = _looked_up(spans, docs, id_col, span_text, text_col).select(F.col(id_col).alias("_doc"), F.col("key").alias("_its"), F.col("candidates").alias("_all"), F.lit(True).alias("_known"))
    rows = spans.withColumn("_key", span_key(F.col(span_text)))
    rows = rows.join(found, (F.col(id_col) == F.col("_doc")) & (F.col("_key") == F.col("_its")), "left")
    every = F.coalesce("_all", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    none = F.lit(None).cast("struct<start:bigint,end:bigint>")
    stated = F.filter(every, lambda c: (c["start"] == F.col(given[0])) & (c["end"] == F.col(given[1]))) if given else F.array().cast("array<struct<start:bigint,end:bigint>>")
    inside = F.filter(every, lambda c: (c["start"] >= F.col(section[0])) & (c["end"] <= F.col(section[1]))) if section else F.array().cast("array<struct<start:bigint,end:bigint>>")
    method = F.when(F.size(stated) > 0, "explicit_verified").when(F.size(inside) == 1, "section_constrained_exact").when((F.size(inside) == 0) & (F.size(every) == 1), "document_exact").otherwise("unresolved")
    place = F.when(F.size(stated) > 0, F.get(stated, F.lit(0))).when(F.size(inside) == 1, F.get(inside, F.lit(0))).when((F.size(inside) == 0) & (F.size(every) == 1), F.get(every, F.lit(0))).otherwise(none)
    has_given = (F.col(given[0]).isNotNull() | F.col(given[1]).isNotNull()) if given else F.lit(False)
    valid = (F.col(given[0]) >= 0) & (F.col(given[0]) < F.col(given[1])) if given else F.lit(False)
    unresolved = method == "unresolved"
    warnings = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "document_unresolved"),
        F.when(has_given & ~F.coalesce(valid, F.lit(False)), "invalid_offset_pair").when(has_given & (F.size(stated) == 0) & F.col("_known").isNotNull(), "offset_text_mismatch"),
        F.when(unresolved & (F.size(every) > 0), "multiple_exact_matches").when(unresolved & F.col("_known").isNotNull(), "exact_text_not_found"),
    ))
    rows = rows.withColumns({"_method": method, "_place": place, "_warnings": warnings, "_kept": F.when((F.size(inside) > 0) & (F.size(stated) == 0), inside).otherwise(every)})
    sure = F.when(F.col("_method") == "explicit_verified", "high").when(F.col("_method") == "unresolved", "unresolved").otherwise("medium")
    return rows.select(*spans.columns, F.col("_method").alias("mapping_method"), sure.alias("mapping_confidence"), F.col("_warnings").alias("mapping_warnings"), F.col("_place.start").alias("verified_start"), F.col("_place.end").alias("verified_end"), F.col("_kept").alias("candidates"))


def within(spans: DataFrame, intervals: DataFrame, id_col: str, position: str, columns: list[str], start: str = "start", end: str = "end", width: int | None = 100_000) -> DataFrame:
    """`spans` with `columns` of the interval [start, end) of its document that holds its position, else null. Intervals do not overlap."""
    # Both sides are sorted together once, by cells of positions; an interval begins anew in each cell that it reaches into.
    cell = lambda at: F.floor(at / width) if width else F.lit(0).cast("long")
    first, last = F.col(start).cast("long"), F.col(end).cast("long") - 1
    side = intervals.where(F.col(id_col).isNotNull() & (first <= last)).select(id_col, F.explode(F.sequence(cell(first), cell(last))).alias("_cell"), first.alias("_at"), F.struct(*(F.col(c).alias(f"_of_{c}") for c in columns), F.col(end).cast("long").alias("_until")).alias("_row"), F.lit(0).alias("_from"))
    at = F.col(position).cast("long")
    # Spans without a position find nothing; they are dealt out, as they may be many.
    own = spans.select("*", F.coalesce(cell(at), -1 - F.spark_partition_id()).cast("long").alias("_cell"), at.alias("_at"), F.lit(1).alias("_from"))
    order = Window.partitionBy(id_col, "_cell").orderBy("_at", "_from").rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(side, allowMissingColumns=True).withColumn("_last", F.last("_row", ignorenulls=True).over(order)).where("_from = 1")
    holds = F.col("_at") < F.col("_last._until")
    return both.select(*spans.columns, *(F.when(holds, F.col(f"_last._of_{c}")).alias(c) for c in columns))


def paragraphs(docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_no, start, end, text): what blank lines part, trimmed, with offsets; blank pieces are left out."""
    parts = T.pieces(F.col(text_col), r"\n\s*\n+")
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    whole = F.filter(F.transform(parts, lambda p: F.struct((p["start"] + lead(p["text"])).alias("start"), bare(p["text"]).alias("text"))), lambda p: p["text"] != "")
    rows = docs.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(whole).alias("_n", "_p"))
    return rows.select(id_col, (F.col("_n") + 1).alias("paragraph_no"), F.col("_p.start").alias("start"), (F.col("_p.start") + F.length("_p.text")).alias("end"), F.col("_p.text").alias("text"))


def anchored(spans: DataFrame, id_col: str, outline: str, paragraph: str, start: str = "verified_start", end: str = "verified_end", tie: str = "span_id") -> DataFrame:
    """`spans` with anchor_no, source_locator and source_order_key, by their order in their paragraph; null where a span has no place."""
    order = Window.partitionBy(id_col, outline, paragraph).orderBy(start, end, tie)
    number = F.row_number().over(order)
    pad = lambda n, k: F.lpad(n.cast("string"), k, "0")
    found = spans.where(F.col(start).isNotNull() & F.col(paragraph).isNotNull()).withColumn("anchor_no", number)
    section = F.when(F.size(outline) > 0, F.concat(F.lit("SEC"), F.array_join(F.transform(outline, lambda n: pad(n, 3)), "."))).otherwise("SECUNK")
    locator = F.concat_ws("::", F.col(id_col).cast("string"), section, F.concat(F.lit("PAR"), pad(F.col(paragraph), 3)), F.concat(F.lit("ANCHOR"), pad(F.col("anchor_no"), 2)))
    levels = [F.coalesce(F.get(outline, F.lit(k)), F.lit(0)) for k in range(2)]
    key = F.array_join(F.array(*(pad(n, 6) for n in (*levels, F.col(paragraph), F.col("anchor_no")))), ".")
    made = found.withColumns({"source_locator": locator, "source_order_key": key})
    rest = spans.where(F.col(start).isNull() | F.col(paragraph).isNull())
    return made.unionByName(rest.select("*", F.lit(None).cast("int").alias("anchor_no"), F.lit(None).cast("string").alias("source_locator"), F.lit(None).cast("string").alias("source_order_key")))


def ledger_summary(spans: DataFrame) -> DataFrame:
    """One row: spans, how many are resolved, ambiguous and located, and repeated locators."""
    repeated = F.count("source_locator") - F.count_distinct("source_locator")
    return spans.agg(
        F.count("*").alias("span_count"), F.count_if(F.col("mapping_confidence") == "high").alias("verified_span_mapping_count"), F.count_if(F.col("mapping_method") == "unresolved").alias("unresolved_span_mapping_count"),
        F.count_if(F.array_contains("mapping_warnings", "multiple_exact_matches")).alias("multiple_exact_match_count"), F.coalesce(F.round(F.count("source_locator") / F.count("*"), 6), F.lit(0.0)).alias("source_locator_coverage"), repeated.alias("duplicate_source_locator_count"),
    )
