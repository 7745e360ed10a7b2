"""Similarity join on word shingles by chosen paths: every pair of documents with Jaccard similarity SIMILAR or more.

A document is the set of its shingles (WIDTH consecutive words, as they are; a shorter text is one shingle). Documents
with the same set form one class and go on as one.

1. Paths. In each run a set follows the token that a hash function of the run picks from it, the same one for all sets
   that share it. A bucket of SMALL sets or fewer is compared as it is; a larger one is split again, each set following
   BRANCHES more tokens, up to DEPTH times, unless it has kept over half of the bucket that it came from: its sets are
   alike. Two similar sets stay together in a run with a known probability
   (`run_recall`); runs repeat until the target recall is reached (`runs_for`).
2. Buckets. Sets meet in each bucket that they share, and a pair counts in the bucket with the smallest name only, so
   that no pair is found twice. Small sketches tell which sets of a bucket may have a partner; only these are sent as a
   whole and compared exactly. A bucket that stays large is compared in blocks, block against block, by several tasks.
   A bucket's task reports a number of links and one root for each set, never its pairs.
3. Groups are the connected components of the links, by alternating large and small stars, each round written out.

Result: a row for each document, with the smallest id of its group and the number of other documents that it is linked
to itself.

Defined results: a null or empty text, or one without words, has no shingles: it is a group of its own, without links.
Rows repeated in the table are documents of their own, linked as copies. Texts are whole, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut_lineage, free, hot_keys, salted_join
from tessera.llm.words import Words, chunks, distinct, give_back, mix, text_buffers

WIDTH = 5
SIMILAR = 0.8
RECALL = 0.9999
SMALL = 64
DEPTH = 3
BRANCHES = 2
#: Sets of a large bucket that are compared with each other or with another such block in one go.
BLOCK = 512
#: Sketches tell similarity within some standard errors of this fraction: pairs below it are not compared exactly.
HOPEFUL = 0.5


def run_recall(similar: float = SIMILAR, depth: int = DEPTH, branches: int = BRANCHES) -> float:
    """The least probability that one run compares a pair of this similarity: as if each of its buckets were split to the end."""
    together = 1.0
    for _ in range(depth):
        together = 1 - (1 - similar * together) ** branches
    return similar * together


def runs_for(recall: float = RECALL, similar: float = SIMILAR) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - run_recall(similar)))


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets(docs: DataFrame, tokens: int, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, a, b, n, picks array<long>): a and b name the set, n is its size, picks its token by each of `tokens` hash functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(tokens)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in chunks(offsets):
                rows, h = distinct(*Words(data, offsets[i : j + 1]).shingles(width))
                n = np.bincount(rows, minlength=j - i)
                picks, names = np.zeros((j - i, tokens), dtype=np.uint64), np.zeros((2, j - i), dtype=np.uint64)
                if len(rows):
                    has = np.flatnonzero(n)
                    first = np.searchsorted(rows, has)
                    for k, seed in enumerate(seeds):
                        picks[has, k] = np.minimum.reduceat(h * seed, first)
                    for k in range(2):
                        names[k, has] = np.add.reduceat(mix(h + np.uint64(k + 1)), first)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * tokens, tokens, dtype=np.int32)), pa.array(picks.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), *(pa.array(x.view(np.int64)) for x in names), pa.array(n.astype(np.int64)), lists], names=["doc_id", "text_hash", "a", "b", "n", "picks"])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, a long, b long, n long, picks array<long>")


def leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(path, cid, size): the buckets, of two sets or more, in which each set (cid, picks) is compared."""
    each = 1 + BRANCHES * DEPTH
    start = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.xxhash64(r, F.get(F.col("picks"), r * each)).alias("path")))
    rows = classes.select("cid", F.inline(start)).withColumn("whole", F.lit(None).cast("long"))
    found = None
    for depth in range(DEPTH + 1):
        sizes = cut_lineage(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"))
        rows = cut_lineage(salted_join(rows, sizes, "path", [F.col("cid")], hot_keys(sizes, "path", "size")))
        ends = F.lit(True) if depth == DEPTH else (F.col("size") <= SMALL) | F.coalesce(2 * F.col("size") > F.col("whole"), F.lit(False))
        done = rows.where(ends)
        found = done.select("path", "cid", "size") if found is None else found.unionByName(done.select("path", "cid", "size"))
        if depth < DEPTH:
            large = rows.where(~ends).join(classes.select("cid", "picks"), "cid")
            at = F.col("run") * each + 1 + depth * BRANCHES
            split = F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b: F.xxhash64(F.col("path"), b, F.get(F.col("picks"), at + b)))
            rows = large.select("cid", "run", F.explode(split).alias("path"), F.col("size").alias("whole"))
    return found


def _dealt(buckets: DataFrame, partitions: int) -> DataFrame:
    """Buckets (path, size, cid, ...) with their rows together and in order, large ones as pairs of blocks (left, right)."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.least(k, own).alias("left"), F.greatest(k, own).alias("right")))
    found = buckets.withColumn("block", own).select("*", F.inline(pairs)).drop("size")
    return found.repartition(partitions, "path", "left", "right").sortWithinPartitions("path", "left", "right", "cid")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (path, left, right), which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("path", "left", "right")], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
    held = []
    give_back()


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy()[offsets[0] : offsets[-1]]


def _incidence(offsets: np.ndarray, values: np.ndarray, n: int, step: int = 2048) -> Iterator[np.ndarray]:
    """Which of n rows have which of the values that several rows have, some values at a time, as matrices of 0 and 1."""
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    shared = count > 1
    place, rows = (np.cumsum(shared) - 1)[place[shared[place]]], rows[shared[place]]
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(place, [at, at + step])
        matrix = np.zeros((n, step), dtype=np.float32)
        matrix[rows[a:b], place[a:b] - at] = 1
        yield matrix


def _own_pairs(group: pa.Table) -> np.ndarray:
    """Pairs of rows that this bucket and these two blocks are to compare: not both in a bucket with a smaller name."""
    n = group.num_rows
    path, left, right = (group.column(c)[0].as_py() for c in ("path", "left", "right"))
    offsets, paths = _lists(group, "paths")
    keep = paths < path
    rows = np.repeat(np.arange(n), np.diff(offsets))[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    own = np.ones((n, n), dtype=bool)
    for matrix in _incidence(offsets, paths[keep], n):
        own &= matrix @ matrix.T == 0
    if left != right:
        block = group.column("block").to_numpy()
        own &= block[:, None] != block[None, :]
    np.fill_diagonal(own, False)
    return own


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        n = group.num_rows
        if n < 2:
            continue
        own = _own_pairs(group)
        if not own.any():
            continue
        _, picks = _lists(group, "picks")
        picks = picks.reshape(n, -1)
        size = group.column("n").to_numpy().astype(float)
        least, most = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
        own &= least >= SIMILAR * most
        same = np.zeros((n, n), dtype=np.int32)
        for k in range(picks.shape[1]):
            same += picks[:, k, None] == picks[None, :, k]
        own &= same >= HOPEFUL * picks.shape[1]
        some = own.any(axis=1)
        if some.any():
            found = group.select(["path", "left", "right", "block", "cid", "copies", "paths"]).filter(pa.array(some)).combine_chunks()
            yield from found.to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        n = group.num_rows
        own = _own_pairs(group)
        offsets, shingles = _lists(group, "shingles")
        size = np.diff(offsets).astype(np.float32)
        both = np.zeros((n, n), dtype=np.float32)
        for matrix in _incidence(offsets, shingles, n):
            both += matrix @ matrix.T
        linked = own & (both >= np.float32(SIMILAR) * (size[:, None] + size[None, :] - both) - 1e-3)
        if not linked.any():
            continue
        cid, copies = group.column("cid").to_numpy(), group.column("copies").to_numpy()
        root = cid.copy()
        while True:
            lowest = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lowest == root).all():
                break
            root = lowest
        some = linked.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(root[some]), pa.array((linked @ copies)[some].astype(np.int64)), pa.array(linked.sum(axis=1)[some].astype(np.int64))], names=["cid", "root", "links", "partners"])


def links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(cid, root, links, partners): for each set and bucket the documents and sets that it is linked to there, and a set of its group."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    paths = buckets.groupBy("cid").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    facts = classes.join(paths, "cid").select("cid", "n", "copies", "picks", "paths")
    rows = _dealt(buckets.join(facts, "cid"), partitions)
    hopeful = cut_lineage(rows.mapInArrow(_hopeful, "path long, left int, right int, block int, cid long, copies long, paths array<long>"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                rows, h = distinct(*Words(data, offsets[i : j + 1]).shingles(width))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(j - i + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["cid", "shingles"])
        give_back()

    wanted = hopeful.select("cid").distinct().join(classes.select("cid", "doc", "text_hash"), "cid").select("cid", "doc", F.col("text_hash").alias("_hash"))
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_hash"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, (texts["doc"].eqNullSafe(wanted["doc"])) & (texts["_hash"] == wanted["_hash"]))
    whole = texts.select("cid", "text").mapInArrow(shingled, "cid long, shingles array<long>").dropDuplicates(["cid"])
    rows = hopeful.join(whole, "cid").repartition(partitions, "path", "left", "right").sortWithinPartitions("path", "left", "right", "cid")
    return rows.mapInArrow(_linked, "cid long, root long, links long, partners long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for the nodes of `edges` (u, v). A hub's rows are dealt over tasks."""
    edges = cut_lineage(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        hot = hot_keys(edges.groupBy("v").agg(F.count("*").alias("n")), "v", "n")
        for larger in (True, False):
            # Large star: each node sends its larger neighbours to its smallest one. Small star: its smaller ones and itself.
            sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
            least = sides.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
            joined = salted_join(sides, least, "u", [F.col("v")], hot)
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger else joined.select("v", "m").unionByName(joined.select(F.col("u").alias("v"), "m")).toDF("u", "v")
            edges = moved.where("u != v").distinct()
        edges = cut_lineage(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, class_id, n_links, n_partners, component) for every row.

    n_partners counts linked sets other than the document's own. component tells groups apart even where ids repeat; it
    is null for a document without shingles.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    runs = runs_for(recall)
    rows = cut_lineage(sets(docs, runs * (1 + BRANCHES * DEPTH)))
    one = F.min(F.struct("doc_id", "text_hash"))
    classes = rows.where("n > 0").groupBy("a", "b").agg(one.alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("picks").alias("picks"))
    classes = cut_lineage(classes.select("a", "b", F.col("one.doc_id").alias("doc"), F.col("one.text_hash").alias("text_hash"), "copies", "n", "picks", F.monotonically_increasing_id().alias("cid")))
    found = cut_lineage(links(docs, classes, leaves(classes, runs)))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    roots = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    # A root is not among the nodes, as it has no smaller neighbour.
    named = classes.select("a", "b", "cid", "doc", "copies").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    first = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = named.join(first, "root").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("partners", F.lit(0)).alias("n_partners"), F.col("root").alias("component"))
    alone = rows.where("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), *(F.lit(0).cast("long").alias(x) for x in ("n_links", "n_partners")), F.lit(None).cast("long").alias("component"))
    linked = rows.where("n > 0").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("doc_id", "text_hash", "class_id", "n_links", "n_partners", "component")
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group in `found`, which `groups` made of them: the one with the smallest id.

    Documents without shingles all stay.
    """
    keep_id, keep_hash, own_hash, has_words = (free(docs, c) for c in ("_keep", "_keep_hash", "_hash", "_words"))
    keep = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    keep = keep.unionByName(found.where("component is null").select("doc_id", "text_hash")).distinct().toDF(keep_id, keep_hash)
    hashed = docs.withColumn(own_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = hashed.join(keep, F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(own_hash) == F.col(keep_hash)), "left_semi")
    repeated = found.where("component is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.withColumn(has_words, F.rlike(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
        kept = kept.where(F.col(has_words)).dropDuplicates([id_col, own_hash]).unionByName(kept.where(~F.col(has_words))).drop(has_words)
    return kept.drop(own_hash)
