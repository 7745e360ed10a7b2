"""Near-duplicate groups by one-permutation hashing: documents whose word shingles have Jaccard similarity SIMILAR % or more.

A document is the set of its shingles (WIDTH consecutive words; A-Z are lower-cased before, a shorter text is one shingle).
Documents with the same set form one class and go on as one.

1. One permutation. Each shingle is hashed once; the hash names one of BINS bins and a value, and a bin keeps its least
   value. An empty bin takes the value of another one: bins are tried in an order that depends on the empty bin alone
   until one is found that was not empty (optimal densification).
2. Bands. Each BAND bins in a row name a bucket. A pair at the threshold misses all buckets with probability 3e-5 (`miss`).
3. Stars. Each set of a bucket is a candidate with the bucket's hub only, its smallest set: as many candidates as rows,
   however large the bucket. They are confirmed on full sets, and the links' connected components are the groups so far.
4. The rest. Two sets of a bucket that are in different groups were compared only if one was its hub. Where a bucket has
   such sets, those outside of its largest group are compared with all others, in blocks, by several tasks: on their bins
   first, then on full sets. A task tells one root for each set, never pairs; groups are joined where it finds links.

Result: a row for each document, with the smallest id of its group.

Defined results: a null or empty text, or one without words, has an empty set and is a group of its own. Rows repeated in
the table are documents of their own, linked as copies; each whose id is its group's smallest is kept. A null id counts only
where a group has no other. An empty table gives no rows. Other columns are not read. Texts are whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.jaccard_join import BLOCK, HOPEFUL, _groups, _incidence, _lists, _own_pairs, components
from tessera.llm.shared import SALTS, Scratch, cut_lineage, hot_keys, salted_join
from tessera.llm.words import Words, chunks, distinct, give_back, mix, text_buffers

WIDTH = 2
#: Per cent.
SIMILAR = 80
BINS, BAND = 130, 5
#: Bins that an empty one tries; then the next filled one to its right is taken.
TRIES = 1024
_EMPTY = np.uint32(0xFFFFFFFF)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def miss(similar: float = SIMILAR / 100, bins: int = BINS, band: int = BAND) -> float:
    """The probability that a pair of this similarity shares no bucket, as if its bins were independent."""
    return (1 - similar**band) ** (bins // band)


def _shingles(batch_texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, row, hash) of distinct shingles, ordered by both, some texts at a time."""
    data, offsets = text_buffers(batch_texts)
    for i, j in chunks(offsets):
        yield i, j, *distinct(*Words(data, offsets[i : j + 1]).shingles(width))


def _orders(bins: int) -> np.ndarray:
    """The bins that each empty bin tries, by bin and try."""
    k = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(TRIES) + np.arange(TRIES, dtype=np.uint64)[None, :]
    return (mix(k + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


def signatures(row: np.ndarray, h: np.ndarray, n_rows: int, orders: np.ndarray) -> np.ndarray:
    """The densified bins of each row that has shingles; rows without stay empty."""
    bins = len(orders)
    g = mix(h ^ np.uint64(0xA0761D6478BD642F))
    place = row.astype(np.int64) * bins + (((g >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    value = np.minimum((g & np.uint64(0xFFFFFFFF)).astype(np.uint32), _EMPTY - np.uint32(1))
    order = np.argsort(place, kind="stable")
    place, value = place[order], value[order]
    found = np.full(n_rows * bins, _EMPTY, dtype=np.uint32)
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        found[place[first]] = np.minimum.reduceat(value, first)
    found = found.reshape(n_rows, bins)
    filled = found != _EMPTY
    r, b = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for t in range(TRIES):
        if not len(r):
            break
        other = orders[b, t]
        hit = filled[r, other]
        found[r[hit], b[hit]] = found[r[hit], other[hit]]
        r, b = r[~hit], b[~hit]
    for x, y in zip(r.tolist(), b.tolist()):
        others = np.flatnonzero(filled[x])
        found[x, y] = found[x, others[np.searchsorted(others, y) % len(others)]]
    return found


def sets(docs: DataFrame, width: int = WIDTH, bins: int = BINS) -> DataFrame:
    """(doc_id, text_hash, a, b, n, bins array<int>) of (doc_id, text): a and b name the set, n is its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(bins)
        for batch in batches:
            for i, j, row, h in _shingles(batch.column(2), width):
                n = np.bincount(row, minlength=j - i)
                names = np.zeros((2, j - i), dtype=np.uint64)
                if len(row):
                    has = np.flatnonzero(n)
                    for k in range(2):
                        names[k, has] = np.add.reduceat(mix(h + np.uint64(k + 1)), np.searchsorted(row, has))
                made = signatures(row, h, j - i, orders)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bins, bins, dtype=np.int32)), pa.array(made.ravel().view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), *(pa.array(x.view(np.int64)) for x in names), pa.array(n.astype(np.int64)), lists], names=["doc_id", "text_hash", "a", "b", "n", "bins"])
        give_back()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, a long, b long, n long, bins array<int>")


def buckets(classes: DataFrame, bins: int = BINS, band: int = BAND) -> DataFrame:
    """(path, cid, size, hub): the buckets of two sets or more that each set (cid, bins) is in."""
    paths = F.transform(F.sequence(F.lit(0), F.lit(bins // band - 1)), lambda k: F.xxhash64(k, F.slice("bins", k * band + 1, F.lit(band))))
    rows = classes.select("cid", F.explode(paths).alias("path"))
    sizes = cut_lineage(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("cid").alias("hub")).where("size > 1"))
    return salted_join(rows, sizes, "path", [F.col("cid")], hot_keys(sizes, "path", "size")).select("path", "cid", "size", "hub")


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(cid, shingles array<long>), in order, of the wanted classes (cid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, h in _shingles(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["cid", "shingles"])
        give_back()

    named = classes.join(wanted, "cid", "left_semi").select("cid", F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"))
    texts = docs.join(named, docs["doc_id"].eqNullSafe(named["_doc"]) & (F.xxhash64("text") == F.col("_hash")))
    return texts.select("cid", "text").mapInArrow(run, "cid long, shingles array<long>").dropDuplicates(["cid"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (hub, member 1, cid, shingles) that are similar to their hub, whose own set (member 0) comes ahead of them."""
    hub, own = None, np.zeros(0, dtype=np.uint64)
    for batch in batches:
        hubs, member, cid = (batch.column(c).to_numpy() for c in ("hub", "member", "cid"))
        offsets, values = _lists(pa.Table.from_batches([batch]), "shingles")
        values = values.view(np.uint64)
        linked = np.zeros(len(cid), dtype=bool)
        starts = [0, *(np.flatnonzero((hubs[1:] != hubs[:-1]) | (member[1:] < member[:-1])) + 1).tolist(), len(cid)]
        for a, b in zip(starts, starts[1:]):
            if a < b and member[a] == 0:
                hub, own = hubs[a], values[offsets[a] : offsets[a + 1]].copy()
                a += 1
            if a >= b or hubs[a] != hub or not len(own):
                continue
            part, size = values[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
            at = np.minimum(np.searchsorted(own, part), len(own) - 1)
            both = np.concatenate([[0], np.cumsum(own[at] == part)])[offsets[a : b + 1] - offsets[a]]
            both = np.diff(both)
            linked[a:b] = 100 * both >= SIMILAR * (size + len(own) - both)
        if linked.any():
            yield pa.RecordBatch.from_arrays([pa.array(cid[linked]), pa.array(hubs[linked])], names=["cid", "root"])
    give_back()


def star_links(edges: DataFrame, whole: DataFrame) -> DataFrame:
    """(cid, root): the candidates (cid, hub) that are similar on their full sets. A hot hub's members are dealt over tasks."""
    spark = edges.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    hot = hot_keys(cut_lineage(edges.groupBy("hub").agg(F.count("*").alias("n"))), "hub", "n")
    dealt = edges.withColumn("salt", F.when(F.col("hub").isin(hot), F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    members = dealt.join(whole, "cid").select("hub", "salt", F.lit(1).alias("member"), "cid", "shingles")
    hubs = dealt.select("hub", "salt").distinct().join(whole.withColumnRenamed("cid", "hub"), "hub").select("hub", "salt", F.lit(0).alias("member"), F.col("hub").alias("cid"), "shingles")
    rows = hubs.unionByName(members).repartition(partitions, "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return rows.mapInArrow(_confirmed, "cid long, root long")


def unfinished(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(path, cid, comp, main, n_main, n_rest): the sets of buckets that hold several groups besides what their hub was compared with."""
    rows = found.where("cid != hub").join(groups, found["cid"] == groups["node"], "left").select("path", "cid", F.coalesce("root", "cid").alias("comp"))
    sizes = rows.groupBy("path", "comp").agg(F.count("*").alias("n"))
    facts = sizes.groupBy("path").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    facts = cut_lineage(facts.select("path", F.col("main.comp").alias("main"), F.col("main.n").alias("n_main"), (F.col("all") - F.col("main.n")).alias("n_rest")))
    hot = hot_keys(facts.withColumn("n", F.col("n_main") + F.col("n_rest")), "path", "n")
    return salted_join(rows, facts, "path", [F.col("cid")], hot)


def _dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Each pair of blocks with at least one from outside the main group, its rows together and in order."""
    n_rest, n_main = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n_rest", "n_main"))
    spread = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
    is_rest = F.col("comp") != F.col("main")
    own = F.when(is_rest, spread(n_rest)).otherwise(n_rest + spread(n_main))
    last = F.when(is_rest, n_rest + n_main - 1).otherwise(n_rest - 1)
    pairs = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, own).alias("left"), F.greatest(k, own).alias("right")))
    found = rows.withColumn("block", own).select("*", F.inline(pairs)).drop("n_main", "n_rest", "main")
    return found.repartition(partitions, "path", "left", "right").sortWithinPartitions("path", "left", "right", "cid")


def _own(group: pa.Table) -> np.ndarray:
    """Pairs that these two blocks are to compare: of different groups, and not in a bucket with a smaller name."""
    comp = group.column("comp").to_numpy()
    return _own_pairs(group) & (comp[:, None] != comp[None, :])


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        n = group.num_rows
        if n < 2 or not (own := _own(group)).any():
            continue
        size = group.column("n").to_numpy().astype(float)
        own &= 100 * np.minimum(size[:, None], size[None, :]) >= SIMILAR * np.maximum(size[:, None], size[None, :])
        _, bins = _lists(group, "bins")
        bins = bins.reshape(n, -1)
        same = np.zeros((n, n), dtype=np.int32)
        for k in range(bins.shape[1]):
            same += bins[:, k, None] == bins[None, :, k]
        own &= same >= HOPEFUL * bins.shape[1]
        some = own.any(axis=1)
        if some.any():
            yield from group.select(["path", "left", "right", "block", "cid", "comp", "paths"]).filter(pa.array(some)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        own, n = _own(group), group.num_rows
        offsets, shingles = _lists(group, "shingles")
        size, both = np.diff(offsets).astype(float), np.zeros((n, n))
        for matrix in _incidence(offsets, shingles, n):
            both += matrix @ matrix.T
        linked = own & (100 * both >= SIMILAR * (size[:, None] + size[None, :] - both))
        if not linked.any():
            continue
        cid = group.column("cid").to_numpy()
        root = cid.copy()
        while True:
            lowest = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lowest == root).all():
                break
            root = lowest
        some = linked.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(root[some])], names=["cid", "root"])


def rest_links(rows: DataFrame, classes: DataFrame, whole: DataFrame) -> DataFrame:
    """(cid, root): the links between sets of different groups in the buckets that `unfinished` names."""
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    paths = rows.groupBy("cid").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    facts = classes.join(paths, "cid").select("cid", "n", "bins", "paths")
    hopeful = cut_lineage(_dealt(rows.join(facts, "cid"), partitions).mapInArrow(_hopeful, "path long, left int, right int, block int, cid long, comp long, paths array<long>"))
    dealt = hopeful.join(whole, "cid").repartition(partitions, "path", "left", "right").sortWithinPartitions("path", "left", "right", "cid")
    return dealt.mapInArrow(_linked, "cid long, root long")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("cid").alias("u"), F.col("root").alias("v"))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), lowered(F.col(text_col)).alias("text"))
    rows = cut_lineage(sets(docs))
    one = F.min(F.struct("doc_id", "text_hash"))
    classes = rows.where("n > 0").groupBy("a", "b").agg(one.alias("one"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bins").alias("bins"))
    classes = cut_lineage(classes.select("a", "b", F.col("one.doc_id").alias("doc"), F.col("one.text_hash").alias("text_hash"), "first_id", "n", "bins", F.monotonically_increasing_id().alias("cid")))
    found = scratch.write(buckets(classes))
    edges = cut_lineage(found.where("cid != hub").select("cid", "hub").distinct())
    wanted = edges.select("cid").unionByName(edges.select(F.col("hub").alias("cid"))).distinct()
    whole = scratch.write(full_sets(docs, classes, wanted))
    links = cut_lineage(star_links(edges, whole))
    roots = components(_edges(links))
    rest = cut_lineage(unfinished(found, roots))
    if not rest.isEmpty():
        more = cut_lineage(rest_links(rest, classes, whole))
        if not more.isEmpty():
            # Groups so far are joined, so that their sets do not go through the stars again.
            ends = more.join(roots.withColumnRenamed("root", "_u"), F.col("cid") == F.col("node"), "left").drop("node").join(roots.withColumnRenamed("root", "_v"), F.col("root") == F.col("node"), "left")
            joined = ends.select(F.coalesce("_u", "cid").alias("u"), F.coalesce("_v", "root").alias("v"))
            roots = components(joined.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = classes.select("a", "b", "cid", "first_id").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = cut_lineage(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("size")))
    named = cut_lineage(salted_join(named, smallest, "root", [F.col("cid")], hot_keys(smallest, "root", "size")).select("a", "b", "component_id"))
    scratch.drop()
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    own = rows.where("n > 0").select("doc_id", "n", "a", "b").withColumn("set", F.xxhash64("a", "b"))
    copies = cut_lineage(own.groupBy("set").agg(F.count("*").alias("copies")).where("copies > 1"))
    facts = named.select(F.xxhash64("a", "b").alias("set"), F.col("a").alias("_a"), F.col("b").alias("_b"), "component_id")
    linked = salted_join(own, facts, "set", [F.col("doc_id")], hot_keys(copies, "set", "copies")).where("a = _a and b = _b")
    found = linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
