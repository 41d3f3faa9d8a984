"""Many searches at once: brute force against numpy, and the recall that measured probes give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import mean_recall
from lodestone.operators import batch, exact_search_all, ivf_search_all, probes_for


def tables(spark, n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[5] = v[6]  # a tie
    centroids = v[rng.permutation(n)[:27]]
    near = ((v[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
    rows = spark.createDataFrame([(i, int(c), x.tolist()) for i, (x, c) in enumerate(zip(v, near, strict=True))] + [(n, -1, None)], "key long, cluster_id int, vector array<double>")
    return v, centroids, rows, rows.where("key % 7 = 0").select(F.col("key").alias("query_id"), "vector")


@pytest.mark.parametrize(("n_rows", "n_queries"), [(16_384, 1_024), (90, 30)])
def test_all_searches(spark, monkeypatch, n_rows, n_queries):
    monkeypatch.setattr(batch, "ROWS", n_rows)
    monkeypatch.setattr(batch, "QUERIES", n_queries)
    v, centroids, rows, asked = tables(spark)
    d = np.sqrt(((v[::7, None] - v[None]) ** 2).sum(2))
    want = {(7 * i, p + 1): (int(j), round(d[i, j], 9)) for i in range(len(d)) for p, j in enumerate(np.argsort(d[i], kind="stable")[:10])}
    exact = exact_search_all(asked, rows, 10, 12)
    for got in (exact, ivf_search_all(asked, rows, centroids, 10, len(centroids))):
        assert {(r["query_id"], r["place"]): (r["key"], round(r["distance"], 9)) for r in got.collect()} == want
    nprobe = probes_for(0.95, rows, centroids, 10)
    recall = lambda p: mean_recall(ivf_search_all(asked, rows, centroids, 10, p), exact, "query_id", "key").first()
    few, enough = recall(3), recall(nprobe)
    assert few["recall"] < 0.9 <= enough["recall"] and 3 < nprobe < len(centroids) and enough["queries"] == 100 and enough["truth_size"] == 1000


def test_every_100th_is_found(spark):
    sf_dir = "/root/testdata/sf0.1"
    n = queries.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").count()
    found = queries.queries()["ivf_recall_every_100th"](spark, sf_dir).first()
    assert found["queries"] == n > 1 and found["truth_size"] == 10 * n and found["recall"] >= 0.9 and found["nprobe"] < found["clusters"]
