"""Every registered query of the library against its SQL, at the smallest scale."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.plans import catalogue
from assetloom.sources import carriers
from tests.oracle import connect, ordered, same

SF = "/root/testdata/sf0.001"
DIGITS = 12
#: Queries whose result has assets.
WITH_IDS = sorted(n for n, sql in catalogue.oracle_sql().items() if "asset_id" in sql or "group" in n or n in ("similar_pairs", "burst_edges", "album_summaries"))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    same(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name])


def numbers(table: pa.Table) -> pa.Table:
    """Padded ids as numbers again."""

    def back(x):
        if isinstance(x, list):
            return [back(y) for y in x]
        return int(x) if isinstance(x, str) and len(x) == DIGITS and x.isdigit() else x

    return pa.table({n: pa.array([back(x) for x in table[n].to_pylist()]) for n in table.column_names})


@pytest.mark.parametrize("name", WITH_IDS)
def test_query_with_string_ids(spark, name, monkeypatch):
    """Ids may be strings; padded ones have the order of the numbers."""
    if name in ("size_cache_store", "date_label", "byte_label", "count_label"):
        pytest.skip("makes text or numbers of its carrier's ids")
    monkeypatch.setattr(carriers, "asset_id", lambda c: F.lpad(F.col(c).cast("string"), DIGITS, "0").alias("asset_id"))
    same(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name], numbers)


def test_byte_label_beyond_64_bits(spark, tmp_path):
    """The cube of an id above 2,097,151 is no BIGINT; DuckDB runs the same SQL on ids of 128 bits."""
    ids = [0, 1, 9, 10, 99, 100, 999, 1_000, 150_000, 2_097_151, 2_097_152, 8_999_999, 36_000_000, 4_600_000_000_000]
    rows = [(i, None, "F") for i in ids]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.queries()["byte_label"](spark, str(tmp_path)).collect()
    con = connect(str(tmp_path))
    con.execute("CREATE OR REPLACE VIEW orders AS SELECT CAST(o_orderkey AS HUGEINT) AS o_orderkey FROM '" + f"{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()["byte_label"]).fetchall())


def test_order_is_compared():
    assert ordered("SELECT a FROM t ORDER BY a DESC") and not ordered("SELECT list(a ORDER BY a) FROM (SELECT a FROM t ORDER BY a)")
