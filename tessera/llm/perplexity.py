"""Perplexity by an interpolated modified Kneser-Ney n-gram model of trusted text, and a filter on it.

The model's units are characters, ORDER of them at a time, over all languages: no tokenizer decides what a word is. A zero
character counts as U+FFFD.

Two models are trained, each on the trusted documents of one half; every document is scored by the model of the other
half, so that no document is judged by a model that has seen it or a copy of it (halves go by a hash of the text).

1. Counts. Texts are read in blocks; each block gives its distinct n-grams with counts, summed over all blocks. Lower
   orders count distinct left neighbours. Discounts come from the counts of counts, by order and model.
2. Probabilities. Joins by context and by suffix interpolate each order with the one below.
3. Scores. Each block of text asks for its distinct n-grams only: the questions are dealt by n-gram and joined with
   the model's counts, order by order, and the answers return to the block, where they meet the block's packed texts.
   A task holds a block's answers and some of its texts at a time, and parts of long ones.
4. Thresholds. For each language, documents above the `keep` quantile of the trusted documents' perplexities go, where
   a perplexity is lowered by how little its text is evidence of (SLACK). Quantiles are read from counts by step of a
   log perplexity, so that they do not depend on how rows are dealt.

A language with fewer than `least_trusted` trusted documents uses the quantile over all languages.

Defined results: a null or empty text has no n-grams; its perplexity is null and it is kept, as is everything when there
is no trusted text. A null language is a language of its own. Equal texts get equal verdicts within a language, so that
repeated rows repeat them. Texts are whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, cut_lineage, free
from tessera.llm.words import chunks, give_back, mix, sums_by_row, text_buffers

ORDER = 5
#: Bytes of text of a block, or up to a chunk more.
BLOCK_BYTES = 32_000_000
#: Bytes of text worked on at a time, also within a longer text.
CHUNK_BYTES = 500_000
#: N-grams that are gathered before they are merged with those of the block so far.
MERGED = 200_000
#: Trusted ids that are broadcast at most: 8 bytes each, some 50 MB in memory.
BROADCAST_IDS = 2_000_000
KEEP = 0.998
#: A short text says little: its log perplexity counts as lower by this over the square root of its characters.
SLACK = 4.0
#: Steps to one in which log perplexities are told apart for the thresholds.
STEPS = 4096
LEAST_TRUSTED = 50
_START = 2
_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def _codes(data: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 bytes; a zero counts as a replacement character."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    return np.where(codes == 0, np.uint32(0xFFFD), codes)


def _keys(windows: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of code points."""
    return mix(sum((windows[:, k].astype(np.uint64) + np.uint64(1)) * _LANES[k] for k in range(windows.shape[1])))


def _windows(column: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The n-grams that end at each character of the texts, as (first row, characters by row, code points of each n-gram).

    Some texts at a time, or a part of a long one, which begins with the characters ahead of it.
    """
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets, CHUNK_BYTES):
        at, stop = int(offsets[a]), int(offsets[b])
        ahead = np.full(order - 1, _START, dtype=np.uint32)
        if b - a == 1 and stop - at > CHUNK_BYTES:
            while at < stop:
                end = min(at + CHUNK_BYTES, stop)
                while end < stop and data[end] & 0xC0 == 0x80:
                    end += 1
                padded = np.concatenate([ahead, _codes(data[at:end])])
                yield a, np.array([len(padded) - order + 1]), np.lib.stride_tricks.sliding_window_view(padded, order)
                ahead, at = padded[len(padded) - order + 1 :], end
        elif stop > at:
            own = data[at:stop]
            lengths = sums_by_row((own & 0xC0) != 0x80, offsets[a : b + 1] - at)
            codes = _codes(own)
            place = np.arange(len(codes)) + (order - 1) * np.repeat(np.arange(b - a), lengths)
            padded = np.full(len(codes) + (order - 1) * (b - a), _START, dtype=np.uint32)
            padded[place + order - 1] = codes
            yield a, lengths, np.lib.stride_tricks.sliding_window_view(padded, order)[place]


class _Distinct:
    """Distinct n-grams with counts, in the order of their keys."""

    def __init__(self, order: int):
        self.order = order
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, windows: np.ndarray) -> None:
        place, keys = pd.factorize(_keys(windows))
        first = np.zeros(len(keys), dtype=np.int64)
        first[place[::-1]] = np.arange(len(place))[::-1]
        self.parts.append((keys, windows[first], np.bincount(place, minlength=len(keys))))
        self.size += len(keys)
        if self.size > MERGED + len(self.parts[0][0]):
            self._merge()

    def _merge(self) -> None:
        keys, windows, counts = (np.concatenate([x[k] for x in self.parts]) for k in range(3))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[edges], windows[order[edges]], np.add.reduceat(counts[order], edges))]
        self.size = len(edges)

    def grams(self) -> tuple[pa.Array, pa.Array]:
        """The n-grams as strings, and their counts."""
        if not self.parts:
            return pa.array([], pa.string()), pa.array([], pa.int64())
        self._merge()
        _, windows, counts = self.parts[0]
        found = np.ascontiguousarray(windows).view(f"<U{self.order}").ravel()
        return pa.array(found, pa.string()), pa.array(counts.astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch | None]]:
    """The rows (column `text`), some at a time, with the number of their block; None ends a block.

    The same rows in the same order give the same blocks.
    """
    number = size = 0
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        for a, b in chunks(offsets, BLOCK_BYTES // 8):
            yield number, batch.slice(a, b - a)
            size += int(offsets[b] - offsets[a])
            if size >= BLOCK_BYTES:
                yield number, None
                number, size = number + 1, 0
    if size:
        yield number, None
    give_back()


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """(half, gram, n) over the rows (half, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_Distinct(order), _Distinct(order)]
        for _, rows in _blocks(batches):
            if rows is None:
                for half, own in enumerate(found):
                    grams, n = own.grams()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), half, dtype=np.int32)), grams, n], names=["half", "gram", "n"])
                found = [_Distinct(order), _Distinct(order)]
                continue
            halves = rows.column("half").to_numpy()
            for at, lengths, windows in _windows(rows.column("text"), order):
                own = np.repeat(halves[at : at + len(lengths)], lengths)
                for half in (0, 1):
                    if (own == half).any():
                        found[half].add(windows[own == half])

    return rows.select("half", "text").mapInArrow(run, "half int, gram string, n long").groupBy("half", "gram").agg(F.sum("n").alias("n"))


def model(trusted: DataFrame, scratch: Scratch, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """By order from 1: (half, gram, p) and (half, context, backoff), from the trusted rows (half, text)."""
    counts = {order: scratch.write(_counts(trusted, order))}
    for k in range(order - 1, 0, -1):
        below = counts[k + 1].groupBy("half", F.substr("gram", F.lit(2)).alias("gram")).agg(F.sum("n").alias("own"), F.count("*").alias("left"))
        # What begins at a text's start has no left neighbour but the start: its own count holds.
        counts[k] = below.select("half", "gram", F.when(F.startswith("gram", F.lit(chr(_START))), F.col("own")).otherwise(F.col("left")).alias("n"))
    grams, contexts = [], []
    lower = None
    for k in range(1, order + 1):
        seen = counts[k].groupBy("half").agg(*(F.sum(F.when(F.col("n") == c, 1).otherwise(0)).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)), F.count("*").alias("kinds"))
        y = F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0)), F.lit(0.5))
        # Where counts of counts leave a discount undefined or outside its range, half the way to the bound.
        discount = [F.coalesce(F.when((c - (c + 1) * y * F.col(f"n{c + 1}") / F.nullif(F.col(f"n{c}"), F.lit(0.0))).between(1e-3, c - 1e-3), c - (c + 1) * y * F.col(f"n{c + 1}") / F.nullif(F.col(f"n{c}"), F.lit(0.0))), F.lit(c / 2)).alias(f"d{c}") for c in (1, 2, 3)]
        discounts = seen.select("half", "kinds", *discount)
        # A row for each of the two models: broadcasting it is bounded.
        with_d = counts[k].join(F.broadcast(discounts), "half").withColumn("context", F.substr("gram", F.lit(1), F.lit(k - 1)))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = with_d.groupBy("half", "context").agg(F.sum("n").alias("total"), F.sum(d).alias("left"), F.max("kinds").alias("kinds"))
        own = scratch.write(own.withColumn("backoff", F.col("left") / F.col("total")))
        p = with_d.select("half", "gram", "context", (F.col("n") - d).alias("above")).join(own, ["half", "context"])
        if lower is None:
            p = p.withColumn("below", 1.0 / (F.col("kinds") + 1))
        else:
            p = p.withColumn("suffix", F.substr("gram", F.lit(2))).join(lower.select("half", F.col("gram").alias("suffix"), F.col("p").alias("below")), ["half", "suffix"])
        lower = scratch.write(p.select("half", "gram", (F.col("above") / F.col("total") + F.col("backoff") * F.col("below")).alias("p"), "kinds"))
        grams.append(lower)
        contexts.append(own.select("half", "context", "backoff", "kinds"))
    return grams, contexts


def _answers(asked: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(half, gram, logp) for the distinct (half, gram) asked for, by joins from the highest order down.

    What an order has not seen goes on to the one below by its suffix, at the weight of its context's back-off.
    """
    open_ = asked.withColumn("weight", F.lit(1.0)).withColumn("key", F.col("gram"))
    done = None
    for k in range(len(grams), 0, -1):
        found = scratch.write(open_.join(grams[k - 1].select("half", F.col("gram").alias("key"), "p"), ["half", "key"], "left"))
        hit = found.where("p is not null").select("half", "gram", F.log(F.col("weight") * F.col("p")).alias("logp"))
        done = hit if done is None else done.unionByName(hit)
        missed = found.where("p is null").drop("p").withColumn("context", F.substr("key", F.lit(1), F.lit(k - 1)))
        missed = missed.join(contexts[k - 1].select("half", "context", "backoff", "kinds"), ["half", "context"], "left")
        open_ = missed.select("half", "gram", (F.col("weight") * F.coalesce("backoff", F.lit(1.0))).alias("weight"), F.substr("key", F.lit(2)).alias("key"), *(["kinds"] if k == 1 else []))
    unseen = open_.select("half", "gram", F.log(F.col("weight") / (F.coalesce("kinds", F.lit(0)) + 1)).alias("logp"))
    return done.unionByName(unseen)


def perplexities(rows: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(key, chars long, log_perplexity double), where it has a text, for each row (key, half int, trusted boolean, text).

    The rows are read twice and must come in the same order both times, as they do from files: a text that meets no
    answers raises an error.
    """
    grams, contexts = model(rows.where("trusted"), scratch, order)
    blocks = rows.where(F.length("text") > 0).select("key", "half", "text")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, found = TaskContext.get().partitionId(), _Distinct(order)
        for number, rows in _blocks(batches):
            if rows is None:
                own, _ = found.grams()
                asked = pa.RecordBatch.from_arrays([pa.array(np.full(len(own), (task << 32) + number)), own], names=["block", "gram"])
                # In order, they take little space.
                yield asked.sort_by("gram")
                found = _Distinct(order)
                continue
            for *_, windows in _windows(rows.column("text"), order):
                found.add(windows)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), None
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        for number, rows in _blocks(batches):
            if rows is None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), pa.array([table.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])
                out = None
                continue
            if out is None:
                table = pa.BufferOutputStream()
                out = pa.ipc.new_stream(table, rows.schema, options=options)
            out.write_batch(rows)

    asked = scratch.write(blocks.mapInArrow(ask, "block long, gram string"))
    both = asked.select("gram").distinct().select("gram", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    answers = _answers(both, grams, contexts, scratch).groupBy("gram").agg(*(F.max(F.when(F.col("half") == h, F.col("logp"))).cast("float").alias(f"logp{h}") for h in (0, 1)))
    replies = asked.join(scratch.write(answers), "gram").select("block", "gram", "logp0", "logp1")
    carried = blocks.mapInArrow(carry, "block long, rows binary")

    def scores(batch: pa.RecordBatch, keys: np.ndarray, logps: np.ndarray) -> pa.RecordBatch:
        """`logps`: for each key what the models of either half say, one behind the other."""
        halves = batch.column("half").to_numpy()
        chars, sums = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
        for at, lengths, windows in _windows(batch.column("text"), order):
            place, own = pd.factorize(_keys(windows))
            where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            if (keys[where] != own).any():
                raise RuntimeError("the documents came in another order when they were read again")
            other = np.repeat(1 - halves[at : at + len(lengths)].astype(np.int64), lengths)
            total = np.zeros(len(place) + 1)
            np.cumsum(logps[where[place] + other * len(keys)], out=total[1:], dtype=np.float64)
            stop = np.cumsum(lengths)
            chars[at : at + len(lengths)] += lengths
            sums[at : at + len(lengths)] += total[stop - lengths] - total[stop]
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(chars), pa.array(sums / np.maximum(chars, 1))], names=["key", "chars", "log_perplexity"])

    def score(answers: pa.Table, texts: pa.Table) -> pa.Table:
        data, offsets = text_buffers(answers.column("gram"))
        keys = _keys(_codes(data[offsets[0] : offsets[-1]]).reshape(-1, order))
        at = np.argsort(keys)
        logps = np.concatenate([answers.column(f"logp{h}").to_numpy()[at] for h in (0, 1)])
        keys = keys[at]
        found = [scores(rows, keys, logps) for blob in texts.column("rows") for rows in pa.ipc.open_stream(blob.as_buffer())]
        found = pa.Table.from_batches(found)
        # Fields that are never null are not to say so: the result's type doesn't either.
        key = pa.struct([pa.field(f.name, f.type) for f in found.column("key").type])
        return found.set_column(0, "key", found.column("key").cast(key))

    # A partition for each block on average: however many there are, a task's share stays the same.
    partitions = max(asked.select("block").distinct().count(), 1)
    replies, carried = (x.repartition(partitions, "block").groupBy("block") for x in (replies, carried))
    return replies.cogroup(carried).applyInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, chars long, log_perplexity double")


def _thresholds(known: DataFrame, by: list[str], keep: float) -> DataFrame:
    """(by, top, n): the least step that at least the share `keep` of the rows (by, step) do not exceed, and their number."""
    counts = known.groupBy(*by, "step").agg(F.count("*").alias("rows"))
    within = Window.partitionBy(*by)
    counts = counts.withColumn("upto", F.sum("rows").over(within.orderBy("step"))).withColumn("n", F.sum("rows").over(within))
    return counts.where(F.col("upto") >= F.lit(keep) * F.col("n")).groupBy(*by).agg(F.min("step").alias("top"), F.first("n").alias("n"))


def judge(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: float = KEEP, least_trusted: int = LEAST_TRUSTED, order: int = ORDER) -> DataFrame:
    """(id, lang, text_hash, chars, perplexity, lowered, threshold, kept) for every row of `docs`; `trusted_ids`: (id) of the trusted documents.

    The ids of the trusted are broadcast if they are BROADCAST_IDS at most, else both sides are shuffled and the marked
    documents written out, as their order must not change any more.
    """
    ids = trusted_ids.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("id") == F.col("_id"), "left")
    hashed = F.xxhash64("text")
    rows = rows.select(F.struct("id", "lang", F.col("_id").isNotNull().alias("trusted"), hashed.alias("text_hash")).alias("key"), F.pmod(hashed, F.lit(2)).cast("int").alias("half"), F.col("_id").isNotNull().alias("trusted"), "text")
    rows = rows if few else cut_lineage(rows)
    scratch = Scratch(docs.sparkSession)
    scored = perplexities(rows, scratch, order).select("key.*", "chars", F.exp("log_perplexity").alias("perplexity"), F.exp(F.col("log_perplexity") - F.lit(SLACK) / F.sqrt("chars")).alias("lowered"))
    empty = rows.where(F.length("text") == 0).select("key.*", F.lit(0).cast("long").alias("chars"), *(F.lit(None).cast("double").alias(x) for x in ("perplexity", "lowered")))
    scored = cut_lineage(scored.unionByName(empty))
    scratch.drop()
    step = F.floor(F.log("lowered") * STEPS)
    known = scored.where("trusted and perplexity is not null").select("lang", step.alias("step"))
    by_lang = _thresholds(known, ["lang"], keep).select(F.col("lang").alias("_lang"), F.col("top").alias("_own"), F.col("n").alias("_n"))
    overall = _thresholds(known, [], keep).first()
    # Languages are as many as the documents' labels tell: the join is left to Spark, which knows the size by then.
    found = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    top = F.when(F.col("_n") >= least_trusted, F.col("_own")).otherwise(F.lit(overall["top"] if overall else None).cast("long"))
    return found.select(F.col("id").alias(id_col), "lang", "text_hash", "chars", "perplexity", "lowered", F.exp((top + 1) / STEPS).alias("threshold"), F.coalesce(step <= top, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that `judge` keeps."""
    own_id, own_lang, own_hash = (free(docs, c) for c in ("_id", "_lang", "_text_hash"))
    gone = judged.where("not kept").select(F.col(id_col).alias(own_id), F.col("lang").alias(own_lang), F.col("text_hash").alias(own_hash)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & F.col(lang_col).cast("string").eqNullSafe(F.col(own_lang)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(own_hash))
    return docs.join(gone, same, "left_anti")
