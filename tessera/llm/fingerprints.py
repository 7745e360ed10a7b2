"""Document fingerprints: sketches that keep every shingle hash below a fixed fraction of the hash range, and the lowest
LEAST hashes in any case.

A sketch grows with its document, so that two documents of any lengths can be compared: the share of one's kept hashes
that the other has estimates containment, and Jaccard similarity likewise. The sketch of several documents together is
the union of theirs (`merge`).

A fingerprint is a string: the number of distinct shingles, a colon, and the kept hashes as 8 hexadecimal digits each, in
order, being the high 32 bits of the 64-bit hashes. A text of at most LEAST shingles has all of them in its sketch; two
sketches are compared up to the hash that both reach, on LEAST hashes at least or on all that there are.

Defined results: a null text is empty; a text without words has no shingles and the fingerprint `0:`. A text with fewer
words than a shingle has one shingle, all its words. The likeness of two texts without shingles is 1, of one
without and one with shingles 0. Equal texts have equal fingerprints; repeated rows repeat them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, chunks, distinct, text_buffers

WIDTH = 5
#: The share of shingle hashes that a sketch keeps.
FRACTION = 1 / 8
#: Hashes that a sketch keeps at least, if its text has so many.
LEAST = 64
ALL = 2**32 - 1
#: Bytes of text that share a range of ids in `with_next`.
RANGE_BYTES = 24_000_000
MOST_RANGES = 8192
#: Characters of text compared at a time in a task.
HELD_CHARS = 2_000_000


def sketch(data: np.ndarray, offsets: np.ndarray, fraction: float = FRACTION, width: int = WIDTH) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each text the number of its distinct shingles and its kept hashes, sorted, as 32-bit integers."""
    counts, kept = [], []
    limit = _limit(fraction)
    for a, b in chunks(offsets):
        rows, h = distinct(*Words(data, offsets[a : b + 1]).shingles(width))
        counts.append(np.bincount(rows, minlength=b - a))
        rows, high = distinct(rows, (h >> np.uint64(32)).astype(np.uint32))
        edges = np.searchsorted(rows, np.arange(b - a))
        keep = (high <= limit) | (np.arange(len(rows)) - edges[rows] < LEAST)
        rows, high = rows[keep], high[keep]
        kept += np.split(high, np.searchsorted(rows, np.arange(1, b - a)))
    return (np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)), kept


def _limit(fraction: float) -> int:
    """The largest hash that the fraction keeps."""
    return min(max(int(fraction * 2**32) - 1, 0), ALL)


def encode(count: int, kept: np.ndarray) -> str:
    return f"{count}:{kept.astype('>u4').tobytes().hex()}"


def decode(fingerprint: str) -> tuple[int, np.ndarray]:
    count, _, kept = fingerprint.partition(":")
    return int(count), np.frombuffer(bytes.fromhex(kept), dtype=">u4").astype(np.uint32)


def _reach(a: tuple[int, np.ndarray], fraction: float) -> int:
    """The hash up to which a sketch has all of its document's."""
    return ALL if len(a[1]) >= a[0] else max(_limit(fraction), int(a[1][-1]) if len(a[1]) else 0)


def _alike(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], fraction: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Both sketches' hashes as far as both reach, and how far that is."""
    reach = min(_reach(a, fraction), _reach(b, fraction))
    return a[1][a[1] <= reach], b[1][b[1] <= reach], reach


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], fraction: float = FRACTION) -> float:
    """Estimated Jaccard similarity; exact where both sketches have all their shingles."""
    x, y, _ = _alike(a, b, fraction)
    if not len(x) and not len(y):
        return float(a[0] == b[0] == 0)
    both = _shared(x, y)
    return both / (len(x) + len(y) - both)


def containment(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], fraction: float = FRACTION) -> float:
    """Estimated share of a's shingles that b has; 0 if a keeps none as far as b reaches."""
    x, y, _ = _alike(a, b, fraction)
    return _shared(x, y) / len(x) if len(x) else 0.0


def merge(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray], fraction: float = FRACTION) -> tuple[int, np.ndarray]:
    """The sketch of both documents together, as far as both reach; its count is exact if both have all, else estimated."""
    x, y, reach = _alike(a, b, fraction)
    kept = np.union1d(x, y)
    if reach == ALL:
        return len(kept), kept
    return max(a[0], b[0], round(len(kept) * 2**32 / (reach + 1)), len(kept) + 1), kept


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles long, fingerprint string) of every row's whole text. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kept = sketch(*text_buffers(batch.column(1)), fraction, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array([encode(c, k) for c, k in zip(counts.tolist(), kept)], pa.string())], names=["id", "n_shingles", "fingerprint"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, n_shingles long, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, range, border), dealt and sorted so that within a task every text is followed by that of the next id.

    Ids are whole numbers, nulls first; equal ids are in order of their texts. The texts are dealt by ranges of ids in one
    shuffle. Each range ends with its border: a copy of the first row of the range behind it, in the last range of the
    very first row. Only the ranges' edges and first ids come to the driver, MOST_RANGES of them at most.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("bytes"))
    total = int(ids.agg(F.sum("bytes")).first()[0] or 0)
    n = min(MOST_RANGES, max(1, math.ceil(total / RANGE_BYTES)))
    edges = (ids.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None) or []
    place = _place(F.col("id"), sorted(set(edges)))
    firsts = [tuple(r) for r in ids.groupBy(place.alias("range")).agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none")).orderBy("range").collect()]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("border")).withColumn("range", place)
    if not firsts:
        return rows
    ahead = {r[0]: firsts[k - 1][0] for k, r in enumerate(firsts)}
    known = [r[1] for r in firsts if r[1] is not None]
    first = rows.where(F.col("id").isNull() if firsts[0][2] else F.lit(False)).unionByName(rows.where(F.col("id").isin(known) if known else F.lit(False)))
    first = first.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "text")).alias("r"))
    links = spark.createDataFrame(list(ahead.items()), "range int, into int")
    borders = first.join(links, "range").select("r.id", "r.text", F.lit(True).alias("border"), F.col("into").alias("range"))
    dealt = rows.unionByName(borders).repartitionByRange(len(firsts), "range")
    return dealt.sortWithinPartitions("range", "border", F.col("id").asc_nulls_first(), "text")


def _place(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are at most `value`, looked up in two steps."""
    if not edges:
        return F.lit(0)
    width = math.isqrt(len(edges)) + 1
    held = [edges[k : k + width] for k in range(0, len(edges), width)]
    at_most = lambda array: F.size(F.filter(array, lambda e: e <= value))
    coarse = F.greatest(at_most(F.array(*(F.lit(x[0]) for x in held))), F.lit(1))
    fine = at_most(F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in held)), coarse))
    return F.coalesce((coarse - 1) * width + fine, F.lit(0))


def _edited(text: str, following: str) -> str:
    m = len(text) // 2
    return text[: len(text) - m] + following[:m]


def against_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """A trial of the sketches on every text, its edited text and the text of the next id.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited text has its last
    half, floor(n_chars / 2) code points, replaced by the beginning of the next text.
    """

    def compare(held: list[tuple], following: tuple) -> pa.RecordBatch | None:
        rows = [*held, following]
        texts = [r[1] for r in rows]
        own = [_edited(a, b) for a, b in zip(texts, texts[1:])]
        plain = list(zip(*sketch(*text_buffers(pa.array(texts, pa.large_string())), fraction, width)))
        edited = list(zip(*sketch(*text_buffers(pa.array(own, pa.large_string())), fraction, width)))
        keep = [k for k, r in enumerate(held) if not r[2]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[k][0] for k in keep], pa.int64()),
                pa.array([len(texts[k]) for k in keep], pa.int64()),
                pa.array([hashlib.sha256(own[k].encode()).hexdigest() for k in keep], pa.string()),
                pa.array([encode(*plain[k]) for k in keep], pa.string()),
                pa.array([encode(*edited[k]) for k in keep], pa.string()),
                pa.array([likeness(plain[k], edited[k], fraction) for k in keep], pa.float64()),
                pa.array([likeness(plain[k], plain[k + 1], fraction) for k in keep], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if n > HELD_CHARS:
                    yield compare(held, row)
                    held, n = [], 0
                held.append(row)
                n += len(row[1])
        if held:
            yield compare(held, (None, "", True))

    dealt = with_next(docs, id_col, text_col).select("id", "text", "border")
    found = dealt.select(F.col("id").cast("long"), "text", "border").mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return found.withColumnRenamed("id", id_col)
