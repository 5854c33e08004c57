"""Exact L2 similarity join: all pairs of vectors closer than a threshold.

A pair closer than ``t`` lies in the same or in neighbouring shells of width
``t`` around any pivot (triangle inequality). Two pivots, a vector and the one
farthest from it, cut the space into cells, and a vector meets its own cell
and half of the neighbouring ones. Rows stay in tiles of bounded size in their
cell; rows that must meet them are copied there and stream past, so a task
holds one tile. Cells prune well while the threshold is small against the
spread of the data; otherwise the work is that of all pairs, in bounded tiles.
Distances near the threshold are decided in single precision, and a pair at
exactly the threshold is no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from assetloom.storage import Scratch

TILE = 8192
#: Visiting rows whose distances are held at once.
STEP = 512
#: Half of the neighbouring cells; the others are met from their side.
NEIGHBOURS = ((0, 1), (1, -1), (1, 0), (1, 1))


def _matrix(batch) -> np.ndarray:
    vectors = batch["embedding"].combine_chunks() if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index("embedding"))
    return np.asarray(vectors.flatten(), np.float32).reshape(len(vectors), -1)


def _close_pairs(limit: float, kind: pa.DataType):
    def pairs(ids, a: np.ndarray, held_ids, b: np.ndarray, wide: np.ndarray, norms: np.ndarray, same: bool) -> pa.RecordBatch:
        left, right = [], []
        for at in range(0, len(a), STEP):
            part = a[at : at + STEP].astype(np.float64)
            rough = (part**2).sum(axis=1)[:, None] + norms[None, :] - 2 * part @ wide.T
            i, j = np.nonzero(rough < limit * (1 + 1e-4) + 1e-6)
            i += at
            if same:
                i, j = i[i < j], j[i < j]
            close = ((a[i] - b[j]) ** 2).sum(axis=1, dtype=np.float32) < np.float32(limit)
            left.append(i[close])
            right.append(j[close])
        x, y = ids.take(pa.array(np.concatenate(left))), held_ids.take(pa.array(np.concatenate(right)))
        swap = pc.less(y, x)
        return pa.RecordBatch.from_arrays([pc.if_else(swap, y, x).cast(kind), pc.if_else(swap, x, y).cast(kind)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, tile = None, [], None
        for batch in batches:
            names = ("dim", "s1", "s2", "tile", "visits")
            keys = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in names])
            edges = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                some, here = batch.slice(lo, hi - lo), tuple(keys[:4, lo].tolist())
                if here != cell:
                    if held:
                        yield from own(held)
                    cell, held, tile = here, [], None
                if not keys[4, lo]:
                    held.append(some)
                    continue
                if held:
                    tile = loaded(held)
                    yield pairs(tile[0], tile[1], *tile, same=True)
                    held = []
                if tile:
                    yield pairs(some.column(some.schema.get_field_index("asset_id")), _matrix(some), *tile, same=False)
        if held:
            yield from own(held)

    def loaded(held):
        table = pa.Table.from_batches(held).combine_chunks()
        b = _matrix(table)
        wide = b.astype(np.float64)
        return table["asset_id"].combine_chunks(), b, wide, (wide**2).sum(axis=1)

    def own(held):
        tile = loaded(held)
        yield pairs(tile[0], tile[1], *tile, same=True)

    return run


def _distance(x: Column, y: Column) -> Column:
    wide = [c.cast("array<double>") for c in (x, y)]
    return F.sqrt(F.aggregate(F.zip_with(*wide, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, z: acc + z))


def similar_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` with ``a < b`` and an L2 distance strictly below the threshold.

    ``vectors`` has ``asset_id``, unique and of any ordered type, which the
    pairs keep, and ``embedding``. Empty and null vectors, and those with null
    or non-finite components, have no pairs; vectors of different length are
    no pair.
    """
    kind = vectors.schema["asset_id"].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    if threshold <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    scratch = Scratch(vectors.sparkSession, "similar")
    rows = vectors.select("asset_id", F.col("embedding").cast("array<float>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where((F.size("embedding") > 0) & F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding"))
    # any pivots are right; one row for each length, stored, so that Spark broadcasts them by their size
    first = scratch.save(rows.groupBy("dim").agg(F.min_by("embedding", "asset_id").alias("p1")), "first")
    far = rows.join(first, "dim").select("dim", "embedding", "p1", _distance(F.col("embedding"), F.col("p1")).alias("d"))
    pivots = scratch.save(far.groupBy("dim").agg(F.max_by("embedding", "d").alias("p2"), F.first("p1").alias("p1")), "pivots")
    shell = lambda p: F.floor(_distance(F.col("embedding"), F.col(p)) / (threshold * (1 + 1e-6))).cast("bigint")
    placed = rows.join(pivots, "dim").select("asset_id", "embedding", "dim", shell("p1").alias("s1"), shell("p2").alias("s2"))
    placed = scratch.save(placed, "placed")
    tiles = placed.groupBy("dim", "s1", "s2").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tiles = scratch.save(tiles, "tiles")
    cell, base = ["dim", "s1", "s2"], ["asset_id", "embedding", "dim", "s1", "s2"]
    sized = placed.join(tiles, cell).withColumn("tile", F.pmod(F.xxhash64("asset_id"), F.col("tiles")).cast("int"))
    stay = sized.select(*base, "tile", F.lit(0).alias("visits"))
    # each pair of a cell's tiles meets once: a row visits the next half of the tiles around
    half = F.expr("filter(sequence(1, cast(floor(tiles / 2) as int)), k -> 2 * k < tiles or (2 * k = tiles and tile < k))")
    around = sized.where("tiles > 1").select(*base, "tiles", "tile", F.explode(half).alias("k"))
    moved = [around.select(*base, F.pmod(F.col("tile") + F.col("k"), F.col("tiles")).cast("int").alias("tile"), F.lit(1).alias("visits"))]
    for x, y in NEIGHBOURS:
        there = tiles.select("dim", (F.col("s1") - x).alias("s1"), (F.col("s2") - y).alias("s2"), F.col("tiles").alias("n"))
        visits = placed.join(there, cell).select(
            "asset_id", "embedding", "dim", (F.col("s1") + x).alias("s1"), (F.col("s2") + y).alias("s2"),
            F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile"), F.lit(1).alias("visits"),
        )
        moved.append(visits)
    every = stay
    for frame in moved:
        every = every.unionByName(frame)
    dealt = every.repartition(*cell, "tile").sortWithinPartitions(*cell, "tile", "visits")
    limit = float(np.float32(threshold * threshold))
    from pyspark.sql.pandas.types import to_arrow_type

    return dealt.mapInArrow(_close_pairs(limit, to_arrow_type(kind)), schema)
