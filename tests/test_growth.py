"""What queries hold must not grow with their tables, and what replaces a plain form must give its results."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

from lodestone import queries
from lodestone.operators import batch
from lodestone.operators.assign import nearest

_PLAIN = """SELECT l_returnflag, approx_count_distinct(l_partkey, 0.02) AS parts_near, percentile_approx(l_extendedprice, 0.5, 10000) AS median_near,
median(l_extendedprice) AS median, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag"""
_APART = f"WITH {queries._APPROXIMATE} SELECT m.l_returnflag, parts_near, median_near, median, parts FROM medians m JOIN parts p ON m.l_returnflag <=> p.l_returnflag"


def _odd(spark):
    """Groups by their number of rows: odd, even, one, ties at the middle, only nulls, skewed, negative; and a null group."""
    price = """CASE g WHEN 'A' THEN hash(id) % 1000 / 8D WHEN 'B' THEN exp(hash(id) % 600) WHEN 'C' THEN 5D WHEN 'D' THEN IF(id % 2 = 0, 1D, 2D)
      WHEN 'F' THEN -power(id, 3) WHEN 'G' THEN IF(id % 3 = 0, double('NaN'), id) WHEN 'H' THEN IF(id % 5 = 0, NULL, id) ELSE IF(g IS NULL, id / 7D, NULL) END"""
    groups = "explode(array('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H', NULL)) AS g"
    rows = spark.range(0, 12_001, 1, 7).selectExpr("id", groups).where("g <=> NULL OR g NOT IN ('B', 'D', 'C') OR (g <> 'C' AND id < 12000) OR id = 0")
    return rows.selectExpr("g AS l_returnflag", f"{price} AS l_extendedprice", "IF(g = 'E', NULL, id % 700) AS l_partkey")


def test_exact_median_apart_from_sketches(spark):
    _odd(spark).createOrReplaceTempView("lineitem")
    key = lambda r: str(r["l_returnflag"])
    want, got = (sorted(spark.sql(text).collect(), key=key) for text in (_PLAIN, _APART))
    assert len(want) == 9
    for a, b in zip(want, got, strict=True):
        assert [str(a[c]) for c in ("l_returnflag", "parts_near", "parts", "median")] == [str(b[c]) for c in ("l_returnflag", "parts_near", "parts", "median")]


def test_no_sketch_for_each_part(spark):
    plan = queries.queries()["sql_approximate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    by_part = [line for line in plan.split("\n") if re.search(r"Aggregate\(keys?=\[", line) and "l_partkey" in line.split("functions=")[0]]
    assert by_part and not [line for line in by_part if "approx" in line or "percentile" in line or "median" in line]
    assert "median(l_extendedprice" not in plan and "percentile(l_extendedprice" not in plan


def _peak(f) -> float:
    """MB of arrays that ``f`` holds at most."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


def test_a_pair_of_full_blocks_is_small():
    rng, dim = np.random.default_rng(0), 64
    lists = lambda n: pa.FixedSizeListArray.from_arrays(pa.array(rng.standard_normal(n * dim).astype(np.float32)), dim).cast(pa.list_(pa.float32()))
    ids = lambda n: pa.array(np.arange(n, dtype=np.int64))
    asked = pa.table({"query_id": ids(batch.QUERIES), "asked": lists(batch.QUERIES)})
    rows = pa.table({"key": ids(batch.ROWS), "cluster_id": ids(batch.ROWS).cast(pa.int32()), "vector": lists(batch.ROWS)})
    assert _peak(lambda: batch._meet(10, dim)(asked, rows)) < 40
    vectors, centroids = rng.standard_normal((10_000, dim)), rng.standard_normal((800, dim))
    assert _peak(lambda: nearest(vectors, centroids)) < 20


def test_blocks_of_long_vectors_have_fewer_rows(spark, monkeypatch):
    monkeypatch.setattr(batch, "BLOCK_BYTES", 8 * 12 * 50)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 12))
    seen, meet = spark.sparkContext.accumulator(0), batch._meet

    def counted(k, dim):
        of = meet(k, dim)

        def f(left, right):
            seen.add(1)
            return of(left, right)

        return f

    monkeypatch.setattr(batch, "_meet", counted)
    rows = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "key long, cluster_id int, vector array<double>")
    got = batch.exact_search_all(rows.where("key % 50 = 0").selectExpr("key AS query_id", "vector"), rows, 3, 12).collect()
    want = {(i, p + 1): int(j) for i in range(0, 300, 50) for p, j in enumerate(np.argsort(((v - v[i]) ** 2).sum(1), kind="stable")[:3])}
    assert {(r["query_id"], r["place"]): r["key"] for r in got} == want
    assert seen.value == 6  # of 300 rows, 50 in a block
