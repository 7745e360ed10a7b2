"""Ids of spans that come from what and where they are: the same in every run, and matched across runs by content.

`with_uid` names a span by the best anchor that it has: verified offsets, stated offsets, its number in an older id, or that
id. `with_content_id` names it by its document, section, text and which of the equal texts there it is, so that text that is
put in elsewhere changes nothing. `matched` tells which span of a new run is which of an old one.

Text is compared in Unicode's NFKC form with any white space as one blank. Defined results: nulls count as empty; rows with one
id stay as they are and are told by `repeated_uids`.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import squeeze

METHODS = ("offset_anchored_verified", "offset_anchored", "legacy_order_anchored", "legacy_id_fallback")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t) if t is not None and not t.isascii() else t)


def normalized(text: Column) -> Column:
    return squeeze(_nfkc(F.coalesce(text.cast("string"), F.lit(""))))


def section_path(parts: Column) -> Column:
    """The parts of a path in lower case, blank ones left out, with a slash between them."""
    return F.lower(F.array_join(F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda p: squeeze(p)), lambda p: p != ""), " / "))


def legacy_order(span_id: Column) -> Column:
    """The number at the end of an id that ends in _S and digits."""
    return F.regexp_extract(F.coalesce(F.trim(span_id), F.lit("")), r"(?i)_S(\d+)$", 1).try_cast("long")


def with_uid(spans: DataFrame) -> DataFrame:
    """`spans` with normalized_text_sha256, stable_span_uid, stable_span_uid_method and stable_span_uid_warnings.

    Read are paper_id, document_id, document_body_sha256, section_path (array), source_text, source_span_id, the offsets
    source_start_offset and source_end_offset, and of a mapping mapping_method, verified_start and verified_end.
    """
    said = lambda c: squeeze(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = spans.withColumn("_sha", F.sha2(normalized(F.col("source_text")), 256))
    document = F.when(said("document_id") == "", said("paper_id")).otherwise(said("document_id"))
    start, end = F.col("source_start_offset"), F.col("source_end_offset")
    verified = (F.col("mapping_method") == "explicit_verified") & (F.col("verified_end") > F.col("verified_start")) & (said("document_body_sha256") != "")
    stated = (F.coalesce(F.col("mapping_method"), F.lit("")) == "") & (start >= 0) & (end > start)
    order = legacy_order(F.col("source_span_id"))
    # The keys of each payload are in order, so that equal contents give equal strings.
    ids = {"document_id": document, "paper_id": said("paper_id")}
    payloads = (
        {"document_body_sha256": said("document_body_sha256"), **ids, "normalized_text_sha256": F.col("_sha"), "verified_source_end_offset": F.col("verified_end"), "verified_source_start_offset": F.col("verified_start")},
        {**ids, "source_end_offset": end, "source_start_offset": start, "source_text_sha256": F.col("_sha")},
        {"document_id": document, "legacy_span_order": order, "paper_id": said("paper_id"), "section_path": section_path(F.col("section_path")), "source_text_sha256": F.col("_sha")},
        {"document_id": document, "legacy_source_span_id": F.trim(F.coalesce("source_span_id", F.lit(""))), "paper_id": said("paper_id"), "section_path": section_path(F.col("section_path")), "source_text_sha256": F.col("_sha")},
    )
    written = [F.to_json(F.struct(*(p[k].alias(k) for k in sorted(p)))) for p in payloads]
    which = F.when(F.coalesce(verified, F.lit(False)), 0).when(F.coalesce(stated, F.lit(False)), 1).when(order.isNotNull(), 2).otherwise(3)
    rows = rows.withColumn("_which", which)
    chosen = written[3]
    for k in (2, 1, 0):
        chosen = F.when(F.col("_which") == k, written[k]).otherwise(chosen)
    warnings = F.when(F.col("_which") == 2, F.array(F.lit("stable_span_uid_offsets_unavailable"))).when(F.col("_which") == 3, F.array(F.lit("stable_span_uid_offsets_and_order_unavailable"))).otherwise(F.array().cast("array<string>"))
    found = rows.withColumns({"stable_span_uid": F.concat(F.lit("SPAN_"), F.sha2(chosen, 256)), "stable_span_uid_method": F.get(F.array(*map(F.lit, METHODS)), F.col("_which")), "stable_span_uid_warnings": warnings})
    return found.withColumnRenamed("_sha", "normalized_text_sha256").drop("_which")


def with_content_id(spans: DataFrame, keys: tuple[str, ...] = ("document_id", "section"), text_col: str = "source_text", order: str = "start") -> DataFrame:
    """`spans` with text_sha256, occurrence (from 1, among equal texts of the same keys, by place) and content_id.

    Ranks are within one text of one section, so that only copies of one text meet.
    """
    rows = spans.withColumn("text_sha256", F.sha2(normalized(F.col(text_col)), 256))
    rows = rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys, "text_sha256").orderBy(order)).cast("long"))
    parts = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "text_sha256", "occurrence")))
    return rows.withColumn("content_id", F.concat(F.lit("CONTENT_"), F.sha2(F.to_json(parts), 256)))


def repeated_uids(spans: DataFrame, uid: str = "stable_span_uid", scope: str = "paper_id") -> DataFrame:
    """(uid, n, scope_of_repeat): ids that several rows have, within one paper or across papers: none, if all is well."""
    counts = spans.groupBy(uid).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(scope).cast("string"), F.lit(""))).alias("_scopes")).where("n > 1")
    return counts.select(uid, "n", F.when(F.col("_scopes") > 1, "cross_paper").otherwise("same_paper").alias("scope_of_repeat"))


def same_text_elsewhere(spans: DataFrame, keys: tuple[str, ...] = ("paper_id", "section"), text_sha: str = "text_sha256", start: str = "start", end: str = "end") -> DataFrame:
    """(keys, text_sha, n): texts that stand at several places of a section."""
    return spans.groupBy(*keys, text_sha).agg(F.count_distinct(F.struct(start, end)).alias("n")).where("n > 1")


def matched(old: DataFrame, new: DataFrame, span_id: str = "span_id", document: str = "document_id") -> DataFrame:
    """(old_id, new_id, how): by content_id; else by a text that its document has once in what is left of either run; else one side is null.

    Both sides are those of `with_content_id`; a content id names one row of each.
    """
    a = old.select(F.col(span_id).alias("old_id"), F.col(document).alias("_doc"), F.col("text_sha256").alias("_text"), "content_id")
    b = new.select(F.col(span_id).alias("new_id"), F.col(document).alias("_new_doc"), F.col("text_sha256").alias("_new_text"), F.col("content_id").alias("_new_content"))
    both = a.join(b, F.col("content_id") == F.col("_new_content"), "full")
    same = both.where("content_id is not null and _new_content is not null").select("old_id", "new_id", F.lit("same_content").alias("how"))
    left = both.where("_new_content is null").select("old_id", "_doc", "_text")
    right = both.where("content_id is null").select("new_id", "_new_doc", "_new_text")
    once_left = left.groupBy("_doc", "_text").agg(F.count("*").alias("_n"), F.first("old_id").alias("_old")).where("_n = 1")
    once_right = right.groupBy("_new_doc", "_new_text").agg(F.count("*").alias("_n"), F.first("new_id").alias("_new")).where("_n = 1")
    moved = once_left.join(once_right, F.col("_doc").eqNullSafe(F.col("_new_doc")) & (F.col("_text") == F.col("_new_text"))).select(F.col("_old").alias("old_id"), F.col("_new").alias("new_id"), F.lit("moved").alias("how"))
    gone = left.join(moved, "old_id", "left_anti").select("old_id", F.lit(None).cast(new.schema[span_id].dataType).alias("new_id"), F.lit("gone").alias("how"))
    added = right.join(moved, "new_id", "left_anti").select(F.lit(None).cast(old.schema[span_id].dataType).alias("old_id"), "new_id", F.lit("added").alias("how"))
    return same.unionByName(moved).unionByName(gone).unionByName(added)
