"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's score is the sum of partial scores over ``slices`` of its
components. Each slice of each block of rows lies in a partition of its own,
which sees that slice of the queries only. Rows stay where they are, and
queries are copied to the blocks.

1. Each partition lists its best partial scores for each query. The longest
   lists' rows are scored in whole, and the k-th best of these is a safe
   cutoff: k rows reach it.
2. The cutoff goes out with the queries. A row that reaches it has a partial
   score of at least its uniform share (cutoff / slices) in some slice, and
   each partition collects its entries at or over that share.
3. Only for the entries are the remaining partial scores resolved, exactly.
   The best k by score and id stay, first of a block and then of all.

Rows: vectors that are null or hold nulls or non-finite components take no
part, nor do null ids; rows that repeat both id and vector count once; only
vectors of the query's dimension are its candidates; rows with the query's id
are its own. Of equal vectors only the k + 1 smallest ids can be in any result,
so the others need not be scored. Scores beyond a long are set to its limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assetloom.llm.arrow import bound_batches, give_back
from assetloom.storage import Scratch

SCALE = 256
SLICES = 2
#: Rows of a block at most; tables that make fewer blocks than this have smaller ones, for more tasks.
ROW_BLOCK, LEAST_BLOCKS, SMALL_BLOCK = 8192, 32, 256
#: Rows that the first phase scores in whole for each query and slice, as a multiple of k.
LISTED = 8
#: Queries, or entries, that are scored at once.
STEP, ENTRY_STEP = 128, 8192
EXACT = float(1 << 53)
#: Beyond any long, and within a float.
LARGE = 1 << 200

#: What the partitions emit; queries and rows are numbered, since ids may repeat.
ENTRY = "query bigint, slice int, row bigint, partial double"
SCORED = "query bigint, row bigint, vec_id bigint, score bigint"


def _matrices(batch: pa.RecordBatch | pa.Table, rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Numbers of the given rows, and their quantised vectors or slices, by the whole vector's dimension."""
    column = batch["vector"].combine_chunks() if isinstance(batch, pa.Table) else _column(batch, "vector")
    sizes = np.asarray(batch["size"] if isinstance(batch, pa.Table) else _column(batch, "size"))[rows]
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    out = {}
    for size in np.unique(sizes):
        own = rows[sizes == size]
        d = offsets[own[0] + 1] - offsets[own[0]]
        out[int(size)] = own, _quantised(flat[offsets[own][:, None] + np.arange(d)].reshape(len(own), d))
    return out


def _quantised(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.floor(SCALE * matrix)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(SCALE * int(x)) if abs(x) > EXACT else math.floor(SCALE * x) for x in row] for row in matrix], object).reshape(matrix.shape)


def _whole(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices as they are if floats give exact products, else as integers of any size."""
    bound = max(1, q.shape[1]) * float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0))
    if bound < EXACT:
        return q, v
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(q), whole(v)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of all queries with all rows, as floats."""
    q, v = _whole(q, v)
    out = q @ v.T if q.shape[1] else np.zeros((len(q), len(v)))
    return np.clip(out, -LARGE, LARGE).astype(float) if out.dtype == object else out


def _long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


class _Block(NamedTuple):
    """The rows of a partition: their numbers in order, ids, and by dimension their places and matrix."""

    rows: np.ndarray
    ids: np.ndarray
    by_size: dict[int, tuple[np.ndarray, np.ndarray]]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.RecordBatch]]:
    """Each batch of queries and entries with the rows of its part; a part's rows come first."""
    part, held, block = None, [], None
    for batch in batches:
        parts, kinds = np.asarray(_column(batch, "part")), np.asarray(_column(batch, "kind"))
        edges = np.flatnonzero((parts[1:] != parts[:-1]) | ((kinds[1:] > 0) != (kinds[:-1] > 0))) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
            some = batch.slice(lo, hi - lo)
            if parts[lo] != part:
                part, held, block = parts[lo], [], None
            if kinds[lo] == 0:
                held.append(some)
                continue
            if block is None and held:
                table = pa.Table.from_batches(held).sort_by("id").combine_chunks()
                rows = table["id"].to_numpy()
                block, held = _Block(rows, table["query"].to_numpy(), _matrices(table, np.arange(len(rows)))), []
            if block is not None:
                yield block, some


def _lists(k: int):
    """Phase 1, or phase 2 for queries that come with a cutoff: the entries of each query in a slice of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in _blocks(batches):
            number, own, shares, slices = (np.asarray(_column(some, c)) for c in ("query", "id", "number", "slice"))
            found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0))]
            for size, (at, q) in _matrices(some, np.arange(some.num_rows)).items():
                rows, v = block.by_size.get(size, (None, None))
                for s in range(0, len(at) if rows is not None else 0, STEP):
                    which, ids = at[s : s + STEP], block.ids[rows]
                    partial = _products(q[s : s + STEP], v)
                    partial[own[which][:, None] == ids[None, :]] = -np.inf
                    if np.isnan(shares[which[0]]):
                        top = min(k, len(ids))
                        j = np.argpartition(-partial, top - 1, axis=1)[:, :top].ravel()
                        i = np.repeat(np.arange(len(which)), top)
                    else:  # half a unit below the share, so that rounding loses no row
                        share = shares[which][:, None]
                        i, j = np.nonzero(partial >= share - 0.5 - np.abs(share) * 1e-9)
                    keep = np.isfinite(partial[i, j])
                    i, j = i[keep], j[keep]
                    found.append((number[which[i]], slices[which[i]], block.rows[rows[j]], partial[i, j]))
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "slice", "row", "partial"])
        give_back()

    return run


def _resolver(k: int, slices: int):
    """Phase 3: whole scores of the entries, from the partial score that is known and those that remain."""

    def scores(q: np.ndarray, v: np.ndarray, partial: np.ndarray, known: np.ndarray) -> np.ndarray:
        q, v = _whole(q, v)
        if q.dtype == object:
            return np.array([_long(x) for x in v @ q[0]], np.int64)
        cuts = _cuts(q.shape[1], slices)
        total = partial.copy()
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            rest = known != s
            total[rest] += v[rest, a:b] @ q[0, a:b]
        return total.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}  # the query whose entries may go on in the next batch
        for block, some in _blocks(batches):
            number, ids, partial, known, kinds = (np.asarray(_column(some, c)) for c in ("query", "id", "number", "slice", "kind"))
            own = _matrices(some, np.flatnonzero(kinds == 1))
            vectors = last | {int(number[i]): m[n : n + 1] for at, m in own.values() for n, i in enumerate(at)}
            place = np.empty(len(block.rows), np.int64)
            for rows, _ in block.by_size.values():
                place[rows] = np.arange(len(rows))
            out = [(np.empty(0, np.int64),) * 4]
            entries = np.flatnonzero(kinds == 2)
            for at in np.split(entries, np.flatnonzero(np.diff(number[entries])) + 1) if len(entries) else []:
                q = vectors[int(number[at[0]])]
                v = block.by_size[q.shape[1]][1]
                row = np.searchsorted(block.rows, ids[at])
                score = np.empty(len(at), np.int64)
                for s in range(0, len(at), ENTRY_STEP):
                    part = slice(s, s + ENTRY_STEP)
                    score[part] = scores(q, v[place[row[part]]], partial[at[part]], known[at[part]])
                # a row may have an entry in each slice
                best = np.lexsort((block.ids[row], ~score))[: k * slices]
                out.append((np.full(len(best), number[at[0]]), ids[at[best]], block.ids[row[best]], score[best]))
            name = int(number[-1])
            last = {name: vectors[name]}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", "row", "vec_id", "score"])
        give_back()

    return run


def _cuts(size: int, slices: int) -> list[int]:
    return [size * s // slices for s in range(slices + 1)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = SLICES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Return ``query_id, rank, vec_id, score`` of the k best rows of each query.

    ``is_query`` is a condition on ``vec_id``. The score is the inner product
    of the vectors of floor(256 * component), ties go to smaller ids.
    """
    return _Search(vectors, is_query, k, slices, vec_id, embedding).result()


class _Search:
    def __init__(self, vectors: DataFrame, is_query: Column, k: int, slices: int, vec_id: str, embedding: str):
        bound_batches(vectors.sparkSession)
        self.k, self.slices, self.scratch = k, slices, Scratch(vectors.sparkSession, "topk")
        given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        valid = given.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()
        valid = self.scratch.save(valid, "valid")
        copies = Window.partitionBy("embedding").orderBy("vec_id")
        rows = valid.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy").withColumn("row", F.monotonically_increasing_id())
        n = valid.count()
        self.blocks = max(1, min(LEAST_BLOCKS, -(-n // SMALL_BLOCK)), -(-n // ROW_BLOCK))
        self.rows = self.scratch.save(rows.withColumn("block", self._block()), "rows")
        queries = valid.where(is_query).select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "embedding")
        self.queries = self.scratch.save(queries, "queries")
        self.scratch.drop(valid)

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(self.blocks)).cast("int")

    def _moved(self, frames: list[DataFrame], parts: int) -> DataFrame:
        moved = frames[0]
        for frame in frames[1:]:
            moved = moved.unionByName(frame)
        return moved.repartitionById(parts, "part").sortWithinPartitions("part", F.col("kind") > 0, "query", "kind", "id")

    def _frame(self, frame: DataFrame, kind: int, block: Column, each: Column, query: Column, name: str, number: Column, whole: bool) -> DataFrame:
        """Vectors in their parts, whole or one row for each slice."""
        size = F.size("embedding")
        cut = lambda s: F.floor(size * s / self.slices).cast("int")
        part = F.slice("embedding", cut(F.col("s")) + 1, cut(F.col("s") + 1) - cut(F.col("s")))
        out = frame.withColumn("b", each).withColumn("s", F.lit(-1) if whole else F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))
        place = block if whole else F.col("s") * self.blocks + block
        return out.select(
            place.cast("int").alias("part"), F.lit(kind).alias("kind"), query.alias("query"), F.col(name).alias("id"), number.alias("number"),
            F.col("s").alias("slice"), size.alias("size"), (F.col("embedding") if whole else part).alias("vector"),
        )

    def _sides(self, queries: DataFrame, number: Column, whole: bool) -> list[DataFrame]:
        every = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)))
        return [
            self._frame(self.rows, 0, F.col("block"), F.lit(0), F.col("vec_id"), "row", F.lit(None).cast("double"), whole),
            self._frame(queries, 1, F.col("b"), every, F.col("query"), "query_id", number, whole),
        ]

    def entries(self, queries: DataFrame, share: Column) -> DataFrame:
        """Partial scores by slice: local lists where ``share`` is null, else all at or over it."""
        sides = self._sides(queries, share, whole=False)
        return self._moved(sides, self.blocks * self.slices).mapInArrow(_lists(self.k), ENTRY)

    def resolved(self, entries: DataFrame) -> DataFrame:
        """The best whole scores of the entries: at least the k best of each query, each pair once."""
        pairs = entries.select(
            self._block().alias("part"), F.lit(2).alias("kind"), "query", F.col("row").alias("id"), F.col("partial").alias("number"), "slice",
            F.lit(-1).alias("size"), F.lit(None).cast("array<double>").alias("vector"),
        )
        sides = self._sides(self.queries, F.lit(None).cast("double"), whole=True)
        found = self._moved([*sides, pairs], self.blocks).mapInArrow(_resolver(self.k, self.slices), SCORED)
        return found.distinct()

    def best(self, scored: DataFrame) -> DataFrame:
        ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= self.k)

    def cutoffs(self) -> DataFrame:
        """Each query with the k-th best whole score of the rows in its lists; the least long if there are fewer."""
        lists = self.entries(self.queries, F.lit(None).cast("double"))
        longest = Window.partitionBy("query", "slice").orderBy(F.desc("partial"), "row")
        listed = lists.withColumn("n", F.row_number().over(longest)).where(F.col("n") <= LISTED * self.k).drop("n")
        kth = self.best(self.resolved(listed)).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("cutoff"))
        return kth.select("query", F.when(F.col("n") == self.k, F.col("cutoff")).otherwise(F.lit(-(1 << 63))).alias("cutoff"))

    def over_share(self) -> DataFrame:
        queries = self.queries.join(self.scratch.save(self.cutoffs(), "cutoffs"), "query")
        return self.entries(queries, F.col("cutoff").cast("double") / self.slices)

    def result(self) -> DataFrame:
        found = self.best(self.resolved(self.over_share()))
        return found.join(self.queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")
