"""Embedding whitening by a tiled covariance.

1. Whole numbers. An entry c becomes x = floor(1024 c) + 100000. One pass gives the number of vectors n and the sums S.
2. Column blocks. Each block of rows is centred by whole numbers (S / n, rounded) and cut into blocks of TILE columns. A
   pair of column blocks is a tile; every column block of a row block goes to the tiles that it is part of.
3. Tiles. The two column blocks of a (row block, tile) meet in a task, which adds their product up for its tile; then the
   tiles are summed over all tasks. The products are whole numbers, so that no order of adding changes a bit; the rest of
   the centring, below 1/2 by dimension, is taken off at the end.
4. One task puts the tiles together, d x d for d dimensions however many rows there are, and finds the eigenvectors.
5. Rows are projected on the first COMPONENTS eigenvectors.

Defined results: a vector that is null or has a null or a non-finite entry is dropped; without vectors there are no rows.
Vectors have as many dimensions as the longest one; entries that a shorter one lacks count as 0. x is held within 2^25 of
100000. A deviation beyond a long is null. A component without variance (an eigenvalue of 1e-12 of the largest, or less) has no
direction that could be scaled: its whitened is null, and identity_error leaves it out; with no variance at all, explained
and identity_error are null too. Repeated rows and ids count as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut_lineage, free
from tessera.llm.words import give_back

COMPONENTS = 8
#: Columns of a tile's side, and rows of a block.
TILE, ROWS = 32, 1024
#: x - SHIFT is held within FARTHEST, so that a block's products fit a long.
SHIFT, SCALE, FARTHEST = 100_000, 1024, 2.0**25
#: A component's variance at least, as a share of the largest.
LEAST_VARIANCE = 1e-12


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """The rows whose vector is there and has neither null nor non-finite entries."""
    bad = F.exists(F.col(vector_col), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & ~bad)


def _matrices(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, x) for up to ROWS rows at a time."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for a in range(0, len(column), ROWS):
        b = min(a + ROWS, len(column))
        n = np.diff(offsets[a : b + 1])
        row = np.repeat(np.arange(b - a), n)
        place = np.arange(offsets[a], offsets[b]) - np.repeat(offsets[a:b], n)
        full = np.zeros((b - a, width))
        full[row, place] = values[offsets[a] : offsets[b]]
        yield a, b, (np.clip(np.floor(full * SCALE), -FARTHEST, FARTHEST)).astype(np.int64) + SHIFT


def sums(rows: DataFrame, vector_col: str) -> tuple[int, list[int]]:
    """(n, S): how many vectors there are, and the sum of x by dimension."""
    width = rows.agg(F.max(F.size(vector_col))).first()[0]
    if not width:
        return rows.count() if width == 0 else 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            for a, b, x in _matrices(batch.column(0), width):
                n, total = n + b - a, total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array(np.concatenate([[n], total]))], names=["dimension", "total"])

    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    # A row for each dimension: bounded by the width of a vector.
    found = {r[0]: int(r[1]) for r in vectors.mapInArrow(run, "dimension long, total long").groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)"))).collect()}
    return found[-1], [found[k] for k in range(width)]


def column_blocks(rows: DataFrame, vector_col: str, centre: list[int], tile: int = TILE) -> DataFrame:
    """(row_block, column_block, n, matrix binary): the centred x of a block of rows, by blocks of columns."""
    width, middle = len(centre), np.array(centre, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b, x in _matrices(batch.column(0), width):
                x = x - middle
                cut = [np.ascontiguousarray(x[:, k : k + tile]).tobytes() for k in range(0, width, tile)]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array([b - a] * len(cut), pa.int32()), pa.array(cut, pa.binary())], names=["row_block", "column_block", "n", "matrix"])
                block += 1

    return rows.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "row_block long, column_block int, n int, matrix binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b in whole numbers: by floating point where every sum stays exact in it."""
    if len(a) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**53:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    return a.T @ b


def tile_sums(blocks: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """(left, right, place, total): the products of all pairs of columns, by tile and the place in it."""
    n_blocks = -(-width // tile)
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    pairs = F.transform(others, lambda k: F.struct(F.least(k, "column_block").alias("left"), F.greatest(k, "column_block").alias("right")))
    dealt = blocks.select("*", F.inline(pairs))
    partitions = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(partitions, "row_block", "left", "right").sortWithinPartitions("row_block", "left", "right", "column_block")

    def told(left: int, right: int, total: np.ndarray) -> pa.RecordBatch:
        flat = total.ravel()
        return pa.RecordBatch.from_arrays([pa.array([k] * len(flat), pa.int32()) for k in (left, right)] + [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["left", "right", "place", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        held: tuple[tuple, np.ndarray] | None = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("row_block", "left", "right", "n", "matrix"))):
                *key, n, matrix = row
                x = np.frombuffer(matrix, dtype=np.int64).reshape(n, -1)
                at = (key[1], key[2])
                if at[0] == at[1]:
                    a, b = x, x
                elif held and held[0] == tuple(key):
                    a, b = held[1], x
                else:
                    held = (tuple(key), x)
                    continue
                total = _product(a, b)
                if at in found and float(np.abs(found[at]).max()) + float(np.abs(total).max()) >= 2.0**63:
                    yield told(*at, found.pop(at))
                found[at] = found[at] + total if at in found else total
        for at, total in found.items():
            yield told(*at, total)
        give_back()

    products = dealt.select("row_block", "left", "right", "n", "matrix").mapInArrow(run, "left int, right int, place int, total long")
    return products.groupBy("left", "right", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _spectrum(tiles: DataFrame, n: int, totals: list[int], centre: list[int], components: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors by row, trace) of the covariance, found in one task from its d x d entries."""
    width = len(totals)
    rest = np.array([(s - n * c) / n for s, c in zip(totals, centre)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.zeros((width, width))
        for batch in batches:
            left, right, place, total = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            side = np.minimum(tile, width - right * tile)
            i, j = left * tile + place // side, right * tile + place % side
            v[i, j] = v[j, i] = total
        v = v - np.outer(rest, rest)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(values, kind="stable")[::-1]
        for k in order[:components]:
            yield pa.RecordBatch.from_arrays([pa.array([float(values[k])]), pa.array([float(np.trace(v))]), pa.array([vectors[:, k].tolist()], pa.list_(pa.float64()))], names=["value", "trace", "vector"])

    # d x d entries come to the task, which needs them all; the driver gets `components` rows of d.
    whole = tiles.select("left", "right", "place", (F.col("total") / n).cast("double").alias("total")) if n else tiles
    rows = sorted(whole.coalesce(1).mapInArrow(run, "value double, trace double, vector array<double>").collect(), key=lambda r: -r["value"])
    return np.array([r["value"] for r in rows]), np.array([r["vector"] for r in rows]).reshape(len(rows), width), float(rows[0]["trace"]) if rows else 0.0


def projected(rows: DataFrame, id_col: str, vector_col: str, n: int, totals: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(id, deviation, w array<double>) by row: w holds its coordinate on each component, scaled to variance 1."""
    width, total = len(totals), np.array(totals, dtype=np.int64)
    quotient, remainder = np.divmod(total, n)
    can = values > LEAST_VARIANCE * max(float(values.max(initial=0)), 0.0)
    scaled = np.where(can[:, None], vectors / np.sqrt(np.where(can, values, 1.0))[:, None], 0.0).T

    def deviation(x: np.ndarray) -> pa.Array:
        off = x - quotient  # n x - S = n off - remainder
        if float(n) * (float(np.abs(off).max(initial=0)) + 1) < 2.0**31 / max(width, 1) ** 0.5:
            return pa.array(((n * off - remainder) ** 2).sum(axis=1))
        exact = [(sum((n * o - r) ** 2 for o, r in zip(row, remainder.tolist()))) for row in off.tolist()]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _matrices(batch.column(1), width):
                w = ((x - quotient) - remainder / n) @ scaled
                lists = pa.array([[v if c else None for v, c in zip(row, can)] for row in w.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), deviation(x), lists], names=["id", "deviation", "w"])
        give_back()

    chosen = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, column: str, can: list[bool]) -> float | None:
    """The largest absolute entry of the covariance of `column`'s entries, less the identity."""
    k = [i for i, c in enumerate(can) if c]
    if not k:
        return None
    flat = whitened.select(*(F.get(F.col(column), F.lit(i)).alias(f"w{i}") for i in k))
    found = flat.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in k for j in k if i <= j)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in k for j in k if i <= j)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component, from 1."""
    rows = usable(rows, vector_col)
    n, totals = sums(rows, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()
    if not n or not totals:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    centre = [(2 * s + n) // (2 * n) for s in totals]
    tiles = tile_sums(column_blocks(rows, vector_col, centre, tile), len(totals), tile)
    values, vectors, trace = _spectrum(tiles, n, totals, centre, components, tile)
    can = (values > LEAST_VARIANCE * max(float(values.max(initial=0)), 0.0)).tolist()
    scored = cut_lineage(projected(rows, id_col, vector_col, n, totals, values, vectors))
    error = identity_error(scored, "w", can)
    shares = F.array(*(F.lit(max(float(v), 0.0) / trace if trace > 0 else None).cast("double") for v in values))
    at = free(scored, "at")
    found = scored.select("id", "deviation", F.posexplode("w").alias(at, "whitened"))
    return found.select(F.col("id").alias(id_col), (F.col(at) + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col(at)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
