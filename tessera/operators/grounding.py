"""Fields of draft records against the text they come from, and records out of a model's answer."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import is_missing

# Labels that state nothing.
OPEN_LABELS = ("unclear", "unknown", "no", "not_applicable")
AROUND = 50


def ground(drafts: DataFrame, text_col: str, fields: Sequence[str]) -> DataFrame:
    """A row for each draft and field: `drafts` without the fields, and field, value, status, snippet and risk.

    missing: no value; explicit: the value stands in the text as a whole word; unclear: an open label; else inferred, which
    is a risk. The snippet has AROUND characters on either side.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_replace(F.col(f).cast("string"), r"\.0$", "").alias("value")) for f in fields))
    rest = [c for c in drafts.columns if c not in fields]
    rows = drafts.select(*rest, F.explode(cells).alias("_f")).select(*rest, "_f.field", "_f.value")
    quoted = F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}.])\Q"), F.replace("value", F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}])"))
    at = F.regexp_instr(text, quoted)
    status = F.when(is_missing(F.col("value")), "missing").when(at > 0, "explicit").when(F.lower("value").isin(*OPEN_LABELS), "unclear").otherwise("inferred")
    begin = F.greatest(at - AROUND, F.lit(1))
    snippet = F.substr(text, begin, at - begin + F.length("value") + AROUND)
    found = rows.withColumn("status", status)
    return found.withColumn("snippet", F.when(F.col("status") == "explicit", snippet)).withColumn("risk", F.when(F.col("status") == "inferred", F.concat("field", F.lit(" is not stated in the source"))))


def summary(grounded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, explicit, missing, inferred, unclear, risk_flags)."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("explicit", "missing", "inferred", "unclear")]
    return grounded.groupBy(*by).agg(*counts, F.count("risk").alias("risk_flags"))


def answer_records(answer: Column, schema: str) -> Column:
    """The records in a model's answer: from its first bracket to the last that closes it; one object is a list of one. Null if it cannot be read."""
    begin = F.regexp_extract(answer, r"(?s)([\[{].*)", 1)
    array = F.regexp_extract(begin, r"(?s)\A(\[.*\])", 1)
    single = F.regexp_extract(begin, r"(?s)\A(\{.*\})", 1)
    body = F.when(begin.startswith("["), array).otherwise(F.when(single != "", F.concat(F.lit("["), single, F.lit("]"))).otherwise(F.lit("")))
    return F.when(body != "", F.from_json(body, f"array<struct<{schema}>>"))


@F.pandas_udf(T.DoubleType())
def title_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two titles are, by matching blocks, without case and spacing; null if one is missing."""
    from difflib import SequenceMatcher

    squeeze = lambda x: " ".join(x.casefold().split())
    return pd.Series([SequenceMatcher(None, squeeze(x), squeeze(y)).ratio() if x and y and x.strip() and y.strip() else None for x, y in zip(a, b)], dtype="float64")


def token_bounds(text: Column) -> Column:
    """Tokens of a text, struct<low, high>: its characters by 4.5 and by 3, rounded up."""
    n = F.length(text)
    return F.struct(F.ceil(n / 4.5).alias("low"), F.ceil(n / 3.0).alias("high"))
