"""Quality rules as a bitmask ledger.

`ledger` measures every text and evaluates every rule once: bit k of `failed` is set if rule k fails. A policy is a
named, versioned list of rules; `apply_policy` is one AND with its mask, so a policy can change without another look
at the texts. `ablation` tells, by bitwise aggregation alone, what each rule of a policy rejects and what only it rejects.

Defined results: a null text counts as empty; an empty text or one of separators alone has no words and fails `few_words`.
Rows are judged one by one: repeated rows and ids repeat their result, an empty table gives an empty ledger, and other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunks, distinct, sums_by_row, text_buffers

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Name and SQL condition of failure, over MEASURES in whole numbers. The place in this list is the bit.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 25 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("capitals", "n_upper > n_lower and n_upper >= 20"),
)
BASE = ("few_words", "repeated_words")
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-v1": BASE,
    "web-v1": (*BASE, "symbols", "repeated_lines", "long_words", "short_words", "capitals"),
    "web-v2": (*BASE, "symbols", "repeated_lines", "capitals"),
}

_SYMBOL, _UPPER, _LOWER = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", range(65, 91), range(97, 123)))
_BLANKS = " \t\n\x0b\x0c\r"


def mask(rules: tuple[str, ...]) -> int:
    bits = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << bits[x] for x in rules)


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, offsets)
    n_chars = sums_by_row((w.data & 0xC0) != 0x80, w.offsets)
    inside = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    blank = np.cumsum(inside)[:-1] == 0
    at, h = w.windows(3)
    rows = w.row[at]
    order = np.lexsort((h, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(w.start), dtype=bool)
    for k in range(3):
        covered[at[order[twice]] + k] = True
    n_lines, n_dup = np.zeros((2, len(offsets) - 1), dtype=np.int64)
    raw = w.data.tobytes()
    for k in range(len(offsets) - 1):
        lines = [x for x in raw[w.offsets[k] : w.offsets[k + 1]].split(b"\n") if x.strip(_BLANKS.encode())]
        n_lines[k], n_dup[k] = len(lines), len(lines) - len(set(lines))
    return {
        "n_words": w.count, "word_chars": n_chars - sums_by_row(blank, w.offsets), "n_symbols": sums_by_row(_SYMBOL[w.data], w.offsets), "n_dup_lines": n_dup,
        "n_repeat_words": np.bincount(w.row[covered], minlength=len(w.count)), "n_lines": n_lines, "n_upper": sums_by_row(_UPPER[w.data], w.offsets), "n_lower": sums_by_row(_LOWER[w.data], w.offsets),
    }


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, MEASURES as long, failed long) for every row of `docs`. One pass, no shuffle; a task holds one Arrow batch."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                found = _measure(data, offsets[a : b + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(found[k].astype(np.int64)) for k in MEASURES)], names=["id", *MEASURES])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = found.mapInArrow(measured, f"id {found.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in MEASURES))
    bits = sum((F.expr(f"case when {rule} then {1 << k}L else 0L end") for k, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    return found.select(F.col("id").alias(id_col), *MEASURES, bits.alias("failed"))


def rejects(policy: str, failed: Column | None = None) -> Column:
    """Whether the policy of this name rejects a row of a ledger."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def apply_policy(found: DataFrame, policy: str) -> DataFrame:
    """The ledger and `kept`, by the policy of this name."""
    return found.withColumn("kept", ~rejects(policy))


def ablation(found: DataFrame, policy: str) -> DataFrame:
    """(policy, rule, n_rows, n_failed, n_only) by rule of the policy; n_only: rows that would be kept without this rule."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    counts = found.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(mask((name,))).cast("long").alias("bit")) for name in POLICIES[policy])))
    each = counts.select("bits", "n", rules.alias("r"))
    return each.groupBy(F.lit(policy).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
