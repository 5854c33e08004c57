import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import queries, topk_search
from tests.llm.conftest import SF
from tests.oracle import same


def test_against_sql(spark):
    same(spark, SF, queries.queries()["op4_topk_search"], queries.oracle_sql()["op4_topk_search"])


def plain(rows, k=5):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    q = lambda v: [math.floor(256 * x) for x in v]
    for i, v in seen:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q(v), q(w))), j) for j, w in seen if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, topk_search.top_k(frame, F.col("vec_id") % 50 == 0, **options).collect()))


@pytest.mark.parametrize("slices", [1, 2, 4])
def test_against_plain(spark, slices):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(7).tolist()) for i in range(400)] + [(1000 + i, [-0.5] * 7) for i in range(40)] + [(i, [0.1] * 7) for i in range(2000, 2060)]
    assert found(spark, rows, slices=slices) == plain(rows)


def test_messy(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1e300, 1e300]), (50, [0.5]), (51, [0.25])]
    rows += [(52, []), (100, []), (None, [1.0, 1.0]), (0, [1.0, 2.0]), (6, [float("inf"), 0.0])] + [(200 + i, [3.0, 3.0]) for i in range(40)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [], slices=4) == []


def test_only_entries_are_resolved(spark):
    """The cutoff is safe and leaves a small part of all pairs to the third phase; no result lies outside of it."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    search = topk_search._Search(vectors, F.col("vec_id") % 50 == 0, 5, topk_search.SLICES, "vec_id", "embedding")
    entries = {(r["query"], r["row"]) for r in search.over_share().collect()}
    n, queries = vectors.count(), search.queries.count()
    assert len(entries) < 0.25 * n * queries
    ids = {r["query"]: r["query_id"] for r in search.queries.collect()}
    row_ids = {r["row"]: r["vec_id"] for r in search.rows.collect()}
    named = {(ids[q], row_ids[v]) for q, v in entries}
    result = search.result().collect()
    assert all((r["query_id"], r["vec_id"]) in named for r in result)
    least = {r["query_id"]: r["score"] for r in result if r["rank"] == 5}
    assert all(r["cutoff"] <= least[ids[r["query"]]] for r in search.cutoffs().collect())


def test_ids_of_several_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 60, rng.standard_normal(6).tolist()) for i in range(300)] + [(i % 60, rng.standard_normal(4).tolist()) for i in range(100)]
    assert found(spark, rows) == plain(rows)


def test_batches_may_cut_a_query(spark):
    """Entries of one query go on over many Arrow batches."""
    rng = np.random.default_rng(4)
    rows = [(i, np.abs(rng.standard_normal(3)).tolist()) for i in range(3_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert found(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
