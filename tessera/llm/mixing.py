"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions alone.

1. Targets. Each source's share of all words follows its weight; no target exceeds `most_repeats` times the source's
   size, and what that leaves over is shared among the others by weight, until none is above.
2. Schedule. Slot j of the mix is worth one block of words. Its van der Corput point (the bits of j reversed, behind the
   binary point) falls into one source's interval of the cumulative targets, so that any stretch of the mix holds each
   source in proportion. Slots are ranked within their source; slots past the target are dropped and a source that is
   short gets the rest at the end.
3. Blocks. A source's documents are shuffled by a keyed hash and laid end to end, lap after lap; block k holds the words
   from k blocks on. The k-th slot of a source takes its block k, and a document comes into the mix, in each lap, with
   the first of its words: the schedule decides how sources alternate.

Ranks and running sums are made in two steps, inside bounded buckets and over the buckets' totals, so that a source with
a third of all rows is not one task's work.

Defined results: a null text has no words; a null source is a source of its own, after all others. A document without
words is taken 0 times. If no document has words, all targets are 0. Repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import WORD, cut_lineage, free, n_words, running_sum

#: A block is a 2**16th of the mix, within 1 and this many words.
BLOCK_WORDS = 1024
SLOT_BITS = 48
#: Cells of the unit interval in which slots and sources' intervals meet.
CELLS = 1024
#: Slots that are ranked together.
CHUNK = 1 << 16
CYCLE = (5, 2, 1)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, shuffle key, bucket of the shuffle) by document, without its text."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    return rows.withColumn("bucket", F.substring("key", 1, 3))


def cycle_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Weights by place: sources in code-point order, null last, get the cycle's weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), (F.pmod(place, F.lit(len(cycle))) + 1).cast("int"))
    return sources.select("source", weight.alias("weight"))


def targets(sizes: DataFrame, most_repeats: int = 3) -> DataFrame:
    """`sizes` (source, source_size, weight) with `target`: min(most_repeats * size, weight * level), where the targets add up to all sizes.

    Sources reach their cap in order of cap / weight; the level is that of the first source which the remaining words
    do not lift above its cap.
    """
    cap = F.col("source_size") * F.lit(most_repeats)
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    found = sizes.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights"))
    level = (F.col("total") - F.col("capped")) / F.col("weights")
    # The level rises until the first source stays below its cap, and would fall again after it.
    found = found.withColumn("level", F.max(level).over(everything))
    target = F.least(cap.cast("double"), F.col("weight") * F.col("level"))
    return found.select("source", "source_size", "weight", target.alias("target"), "total")


def schedule(plan: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, source_id, k): which block of which source each slot of the mix takes, by `plan` (source_id, target)."""
    spark = plan.sparkSession
    slots = -(-total // block)
    bits = F.reverse(F.lpad(F.bin(F.col("slot")), SLOT_BITS, "0"))
    drawn = spark.range(slots).select(F.col("id").alias("slot"), (F.conv(bits, 2, 10).cast("double") / F.lit(float(1 << SLOT_BITS))).alias("point"))
    by_target = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    edges = plan.where("target > 0").select("source_id", "target", (F.sum("target").over(by_target) / whole).alias("high"), F.row_number().over(Window.orderBy(F.col("source_id").desc())).alias("from_end"))
    edges = edges.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_id")), F.lit(0.0))).withColumn("high", F.when(F.col("from_end") == 1, 2.0).otherwise(F.col("high")))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1))
    cells = edges.select("source_id", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)).alias("cell"))
    drawn = drawn.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell").where("point >= low and point < high")
    drawn = drawn.select("slot", "source_id", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    ranked = running_sum(drawn, "source_id", "chunk", [F.col("slot")], F.lit(1)).select("slot", "source_id", F.col("before").cast("long").alias("k"))
    need = plan.select("source_id", F.ceil(F.round("target") / block).alias("need"))
    counts = drawn.groupBy("source_id").agg(F.count("*").alias("n"))
    kept = ranked.join(need, "source_id").where("k < need").select("slot", "source_id", "k")
    short = need.join(counts, "source_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    extra = short.select((F.lit(slots) + F.col("n")).alias("slot"), "source_id", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("k"))
    return kept.unionByName(extra.select("slot", "source_id", F.col("k").cast("long")))


def mix(rows: DataFrame, weights: DataFrame | None = None, most_repeats: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken long, slots array<long>) for every row of `rows`, as `sized` makes them.

    `weights`: (source, weight > 0), a row for each source; by default `cycle_weights`. `taken`: words the mix takes from
    the document, repeats counted: whole laps, and part of one document where its source's target ends. `slots`: where
    it comes into the mix, by lap.
    """
    rows = cut_lineage(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = weights or cycle_weights(sizes)
    named = sizes.join(weights.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    plan = targets(named, most_repeats)
    plan = cut_lineage(plan.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    total = int(plan.agg(F.max("total")).first()[0] or 0)
    block = max(1, min(block_words, total >> 16))
    facts = plan.select("source", "source_id", "source_size", "target")
    placed = cut_lineage(running_sum(rows, "source", "bucket", [F.col("key"), F.col("size")], F.col("size"), facts))
    laps = placed.where("size > 0").select("source_id", "before", "size", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1))).alias("lap"))
    start = F.col("lap") * F.col("source_size") + F.col("before")
    spans = laps.select("source_id", "before", "lap", start.alias("start"), F.least(start + F.col("size"), F.round("target").cast("long")).alias("stop")).where("start < stop")
    parts = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("k"))
    words = F.least(F.col("stop"), (F.col("k") + 1) * block) - F.greatest(F.col("start"), F.col("k") * block)
    in_lap = [F.min(F.when(F.col("lap") == k, F.col("slot"))) for k in range(most_repeats)]
    taken = parts.join(schedule(plan, total, block), ["source_id", "k"]).groupBy("source_id", "before").agg(F.sum(words).alias("taken"), F.array_compact(F.array(*in_lap)).alias("slots"))
    found = placed.join(taken, ["source_id", "before"], "left")
    has = (F.col("size") > 0) & F.col("taken").isNotNull()
    slots = F.when(has, F.col("slots")).otherwise(F.array().cast("array<bigint>"))
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(has, F.col("taken")).otherwise(0).cast("long").alias("taken"), slots.alias("slots"))


def mixed_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` as often as the mix takes them, in the order of their slots.

    Where a source's target ends within a document, its last copy has the words up to there, one space apart. The order
    is that of the partitions, and of the rows in each.
    """
    given = docs.columns

    def name(doc: str, source: str, size: Column) -> Column:
        return F.md5(F.concat_ws("|", F.coalesce(F.col(doc).cast("string"), F.lit("")), F.col(doc).isNull(), F.coalesce(F.col(source).cast("string"), F.lit("")), F.col(source).isNull(), size))

    fact, row, taken, size, slots, slot, copy, turn, row_turn = (free(docs, c) for c in ("_fact", "_row", "_taken", "_size", "_slots", "_slot", "_copy", "_turn", "_row_turn"))
    facts = mixed.select(name("doc_id", "source", F.col("size")).alias(fact), F.col("taken").alias(taken), F.col("size").alias(size), F.col("slots").alias(slots))
    rows = docs.withColumn(row, name(id_col, source_col, n_words(F.col(text_col))))
    same = F.col(fact) == F.col(row)
    if not facts.groupBy(fact).agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # ids repeat: rows with one name by turns
        facts = facts.withColumn(turn, F.row_number().over(Window.partitionBy(fact).orderBy(taken, slots)))
        rows = rows.withColumn(row_turn, F.row_number().over(Window.partitionBy(row).orderBy(text_col)))
        same = same & (F.col(turn) == F.col(row_turn))
    rows = rows.join(facts.where(F.col(taken) > 0), same)
    rows = rows.select("*", F.posexplode(slots).alias(copy, slot))
    rest = F.col(taken) - F.col(copy) * F.col(size)
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(rest < F.col(size), cut).otherwise(F.col(text_col)))
    return rows.repartitionByRange(slot).sortWithinPartitions(slot).select(*given)
