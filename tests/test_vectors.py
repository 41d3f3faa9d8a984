"""Distance, validation, index, search, SQL: fixtures small enough to check by hand."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import IndexBuilder, TopkBuilder, VectorTopKOptions, enable_vector_search, ensure_indexed, has_vector_index, read_index
from lodestone.functions import check_column, check_vectors, l2_distance, recall_at_k, register, squared_l2, vector_column, vector_dim
from lodestone.operators import assign, cap_round_robin, exact_topk, sample_size
from lodestone.operators.assign import nearest
from lodestone.operators.kmeans import default_clusters

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("vec", T.ArrayType(T.FloatType()), True)])
A2 = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [5.0, 5.0]), (4, [2.0, 2.0]), (5, [0.1, 0.1])]
A3 = [(0, [0.0, 0.0]), (1, [0.05, 0.05]), (2, [0.2, 0.2]), (3, [1.0, 1.0]), (4, [1.1, 1.1]), (5, [1.4, 1.4])]


def write(spark, tmp_path, rows, name="t", schema=SCHEMA, files=1):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(files).sortWithinPartitions("id").write.parquet(path)
    return path


def ids(df):
    return [r[0] for r in df.select("id").collect()]


def test_squared_l2(spark):
    row = spark.sql("SELECT array(1f, 2f, 3f) a, array(4f, 5f, 6f) b").select(squared_l2(F.col("a"), F.col("b")), l2_distance(F.col("a"), [4, 5, 6])).first()
    assert row[0] == 27 and row[1] == math.sqrt(27)


def test_distance_of_what_does_not_fit_is_null(spark):
    df = spark.createDataFrame([([1.0],), (None,), ([1.0, None],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(l2_distance(F.col("v"), [0.0, 0.0])).collect()] == [None, None, None, 5.0]
    register(spark)
    df.createOrReplaceTempView("odd")
    assert [r[0] for r in spark.sql("SELECT array_distance(v, array(0D, 0D)) FROM odd").collect()] == [None, None, None, 5.0]


def test_end_to_end(spark, tmp_path):
    out = str(tmp_path / "out")
    IndexBuilder(spark, write(spark, tmp_path, A2), "vec").build_new(out)
    session = enable_vector_search(spark, VectorTopKOptions(nprobe=64))
    session.register("t", out)
    q = session.query("SELECT id FROM t WHERE id >= 2 ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2")
    assert q.accelerated and ids(q.df) == [5, 2]
    m = q.metrics()
    assert m["candidate_rows"] == 6 and m["embeddings_fetched"] == 4 and m["files_scanned"] == 1
    assert "nprobe=64" in q.explain() and "k=2" in q.explain()


def test_filter_after_pruning(spark, tmp_path):
    out = str(tmp_path / "out")
    IndexBuilder(spark, write(spark, tmp_path, A3), "vec").build_new(out)
    session = enable_vector_search(spark, VectorTopKOptions(nprobe=64))
    session.register("t", out)
    q = session.query("SELECT id FROM t WHERE id >= 3 ORDER BY array_distance(array(0.0, 0.0), vec) LIMIT 2")
    assert q.accelerated and ids(q.df) == [3, 4] and q.metrics()["embeddings_fetched"] == 3


def test_inplace_build_leaves_the_data(spark, tmp_path):
    path = write(spark, tmp_path, A2[:3])
    assert not has_vector_index(spark, path)
    before = sorted(p.name for p in (tmp_path / "t").iterdir())
    index = IndexBuilder(spark, path, "vec").build_inplace()
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name != "_ivf") == before
    assert has_vector_index(spark, path) and index.manifest.column == "vec" and index.manifest.dim == 2
    assert spark.read.parquet(path).columns == ["id", "vec"] and spark.read.parquet(path).count() == 3
    assert [round(r["distance"], 6) for r in TopkBuilder(spark, path, [0.0, 0.0]).k(2).nprobe(9).search().collect()] == [0.0, 1.0]


def test_index_of_a_single_file(spark, tmp_path):
    write(spark, tmp_path, A2)
    (part,) = (tmp_path / "t").glob("part-*.parquet")
    IndexBuilder(spark, str(part), "vec").build_inplace()
    assert ids(read_index(spark, str(part)).search([5.0, 5.0], 1, 9)) == [3]


def test_rebuild_replaces(spark, tmp_path):
    path = write(spark, tmp_path, A2)
    first = IndexBuilder(spark, path, "vec").n_clusters(1).build_inplace()
    second = IndexBuilder(spark, path, "vec").n_clusters(2).build_inplace()
    assert read_index(spark, path).manifest == second.manifest != first.manifest
    assert len([p for p in (tmp_path / "t" / "_ivf").iterdir() if p.is_dir()]) == 1


def test_schema_is_kept_and_doubles_work(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("note", T.StringType())])
    path = write(spark, tmp_path, [(i, v, f"n{i}") for i, v in A2], schema=schema)
    out = str(tmp_path / "out")
    index = ensure_indexed(spark, path, out, "vec")
    assert index.table.schema.simpleString() == spark.read.parquet(path).schema.simpleString()
    assert ensure_indexed(spark, path, out, "vec").manifest == index.manifest
    assert index.search([5.0, 5.0], 1, 9).select("note").first()[0] == "n3"


def test_rows_that_do_not_fit_are_skipped(spark, tmp_path):
    path = write(spark, tmp_path, A2)
    spark.createDataFrame([(7, None), (8, [1.0, 2.0, 3.0])], SCHEMA).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert 7 not in ids(exact_topk(df, "vec", [0.0, 0.0], 20, ["id"])) and len(ids(exact_topk(df, "vec", [0.0, 0.0], 20))) == 6


def test_probing_misses_and_filters_only_candidates(spark, tmp_path):
    rows = [(i, [10.0 * (i // 4), float(i % 4) / 10]) for i in range(12)]
    index = IndexBuilder(spark, write(spark, tmp_path, rows), "vec").n_clusters(3).build_new(str(tmp_path / "out"))
    assert index.search([0.0, 0.0], 10, 1, where="id >= 4").count() == 0
    assert index.search([0.0, 0.0], 10, 3, where="id >= 4").count() == 8
    plan = index.candidates([0.0, 0.0], 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "_ivf_cluster" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_round_robin_cap(spark):
    rows = [("a", r, 1) for r in range(6)] + [("b", r, 1) for r in range(1)] + [("c", r, 1) for r in range(3)]
    df = spark.createDataFrame(rows, "file string, row int, probe_rank int")
    got = {(r["file"], r["row"]) for r in cap_round_robin(df, 5, "file", "row").collect()}
    assert got == {("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1)}
    assert cap_round_robin(df, 0, "file", "row").count() == 0 and cap_round_robin(df, None, "file", "row").count() == 10


@pytest.mark.parametrize(
    "text",
    [
        "SELECT id FROM t ORDER BY array_distance(vec, array(0.0, 0.0)) DESC LIMIT 2",
        "SELECT id FROM t ORDER BY array_distance(vec, array(0.0, 0.0)), id LIMIT 2",
        "SELECT id FROM t ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2 OFFSET 1",
        "SELECT id FROM t ORDER BY array_distance(vec, array(0.0, 0.0))",
        "SELECT id FROM t ORDER BY array_distance(vec, vec) LIMIT 2",
        "SELECT a.id FROM t a JOIN t b ON a.id = b.id ORDER BY array_distance(a.vec, array(0.0, 0.0)) LIMIT 2",
        "SELECT id FROM (SELECT id, vec FROM t LIMIT 3) ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2",
        "SELECT id FROM (SELECT max(id) AS id, vec FROM t GROUP BY vec) ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2",
        "SELECT id FROM plain ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2",
    ],
)
def test_other_shapes_run_exactly(spark, tmp_path, text):
    path = write(spark, tmp_path, A2)
    IndexBuilder(spark, path, "vec").build_new(str(tmp_path / "out"))
    session = enable_vector_search(spark)
    session.register("t", str(tmp_path / "out"))
    session.register("plain", path)
    q = session.query(text)
    assert not q.accelerated and q.df.count() > 0


def test_options_of_nothing(spark, tmp_path):
    IndexBuilder(spark, write(spark, tmp_path, A2), "vec").build_new(str(tmp_path / "out"))
    for options in (VectorTopKOptions(nprobe=0), VectorTopKOptions(max_candidates=0)):
        session = enable_vector_search(spark, options)
        session.register("t", str(tmp_path / "out"))
        assert session.sql("SELECT id FROM t ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 2").count() == 0


def test_parameters_and_casts(spark, tmp_path):
    IndexBuilder(spark, write(spark, tmp_path, A2), "vec").build_new(str(tmp_path / "out"))
    session = enable_vector_search(spark, VectorTopKOptions(nprobe=9))
    session.register("t", str(tmp_path / "out"))
    q = session.query("SELECT id FROM t ORDER BY CAST(array_distance(CAST(vec AS array<double>), :q) AS float) LIMIT 1", {"q": [5.0, 5.0]})
    assert q.accelerated and ids(q.df) == [3]


def test_errors(spark, tmp_path):
    path = write(spark, tmp_path, A2)
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            check_column(bad)
    for wrong in (IndexBuilder(spark, path, "vec").n_clusters(0), IndexBuilder(spark, path, "vec").max_iters(0), IndexBuilder(spark, path, "vec").n_clusters(7), IndexBuilder(spark, path, "no"), IndexBuilder(spark, path, "id")):
        with pytest.raises(ValueError):
            wrong.build_new(str(tmp_path / "never"))
    with pytest.raises(ValueError):
        read_index(spark, path)
    builder = TopkBuilder(spark, path, [0.0])
    for step in (lambda: builder.k(0), lambda: builder.nprobe(0), lambda: builder.k(1).search()):
        with pytest.raises(ValueError):
            step()
    index = IndexBuilder(spark, path, "vec").build_inplace()
    with pytest.raises(ValueError):
        index.search([1.0], 1, 1)
    with pytest.raises(ValueError):
        index.check_query([1.0, 2.0], "other")
    session = enable_vector_search(spark, strict=True)
    session.register("plain", write(spark, tmp_path, A2, "plain"))
    with pytest.raises(ValueError):
        session.sql("SELECT id FROM plain ORDER BY array_distance(vec, array(0.0, 0.0)) LIMIT 1")


@pytest.mark.parametrize(
    ("rows", "kind"),
    [([], "array<float>"), ([(None,)], "array<float>"), ([([1.0, None],)], "array<float>"), ([([],)], "array<float>"), ([([1.0],), ([1.0, 2.0],)], "array<float>"), ([([1],)], "array<int>"), ([("x",)], "string")],
)
def test_columns_that_cannot_be_indexed(spark, rows, kind):
    with pytest.raises(ValueError):
        check_vectors(spark.createDataFrame(rows, f"vec {kind}"), "vec")


def test_inference(spark):
    df = spark.createDataFrame([(1, None, None), (2, [1.0, 2.0], [1.0])], "id int, a array<double>, b array<float>")
    assert vector_column(df) == "a" and vector_dim(df, "a") == 2
    with pytest.raises(ValueError):
        vector_column(df.select("id"))
    with pytest.raises(ValueError):
        vector_dim(df.where("id = 1"), "a")


def test_degenerate_training(spark, tmp_path):
    one = IndexBuilder(spark, write(spark, tmp_path, A2[:1], "one"), "vec").build_new(str(tmp_path / "o1"))
    assert one.manifest.clusters == 1 and ids(one.search([9.0, 9.0], 3, 1)) == [0]
    same = IndexBuilder(spark, write(spark, tmp_path, [(i, [1.0, 1.0]) for i in range(9)], "same"), "vec").build_new(str(tmp_path / "o2"))
    assert same.search([1.0, 1.0], 9, 3).count() == 9


def test_sizes_by_rule():
    assert [default_clusters(n) for n in (1, 4, 5, 1_000_000)] == [1, 2, 3, 1000]
    assert [sample_size(*x) for x in ((100, 10), (1000, 10), (10**7, 10), (30, 25))] == [10, 50, 100_000, 25]


def test_recall(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert recall_at_k(a, b, "k").first()["recall"] == 0.5 and recall_at_k(a, b.limit(0), "k").first()["recall"] == 0.0


def test_assign_marks_what_does_not_fit(spark):
    df = spark.createDataFrame([([0.0, 1.0],), (None,), ([1.0],), ([None, 1.0],), ([9.0, 9.0],)], "v array<double>")
    assert [r["cluster_id"] for r in assign(df, "v", np.array([[0.0, 0.0], [8.0, 8.0]])).collect()] == [0, -1, -1, -1, 1]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 10**6))
def test_nearest_is_the_least(n, k, seed):
    rng = np.random.default_rng(seed)
    v, c = rng.standard_normal((n, 5)), rng.standard_normal((k, 5))
    want = ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert (nearest(v, c) == want).all()


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_full_probe_is_exact_and_recall_grows(spark, tmp_path_factory, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(60)]
    tmp = tmp_path_factory.mktemp("probe")
    path = write(spark, tmp, rows)
    index = IndexBuilder(spark, path, "vec").n_clusters(6).build_new(str(tmp / "out"))
    q = [0.1, 0.2, -0.3, 0.4]
    exact = ids(exact_topk(spark.read.parquet(path), "vec", q, 10, ["id"]))
    assert set(ids(index.search(q, 10, 6))) == set(exact)
    hits = [len(set(ids(index.search(q, 10, p))) & set(exact)) for p in (1, 3, 6)]
    assert hits == sorted(hits)


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for part in (1, 2):
        rows = [(part * 100 + i, [float(part), float(i)]) for i in range(20)]
        spark.createDataFrame(rows, "id int, vec array<float>").coalesce(1).write.parquet(str(tmp_path / "t" / f"a={part}"))
        file = next((tmp_path / "t" / f"a={part}").glob("*.parquet"))
        file.rename(file.with_name("data.parquet"))
    index = IndexBuilder(spark, str(tmp_path / "t"), "vec").n_clusters(2).build_inplace()
    found = index.search([1.0, 0.0], 100, 2)
    assert sorted(r["id"] for r in found.collect()) == [p * 100 + i for p in (1, 2) for i in range(20)]
    assert {r["_ivf_file"] for r in found.collect()} == {"a=1/data.parquet", "a=2/data.parquet"}


def test_equal_data_train_equal_indexes(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5), float(i)]) for i in range(200)]
    sizes = []
    for copy in range(2):  # other file names, another order, other files
        df = spark.createDataFrame(rows if copy else rows[::-1], "id int, vec array<float>")
        df.repartition(1 + copy).write.parquet(str(tmp_path / f"in{copy}"))
        index = IndexBuilder(spark, str(tmp_path / f"in{copy}"), "vec").n_clusters(4).build_new(str(tmp_path / f"out{copy}"))
        sizes.append([(r["cluster_id"], r["n_rows"], r["centroid"]) for r in index.centroids.orderBy("cluster_id").collect()])
    assert sizes[0] == sizes[1]


def test_vectors_that_do_not_fit_have_no_place_without_an_index(spark, tmp_path):
    rows = [(1, None), (2, [1.0]), (3, [5.0, 5.0]), (4, [1.0, 1.0]), (5, [None, 1.0])]
    spark.createDataFrame(rows, "id int, vec array<float>").write.parquet(str(tmp_path / "t"))
    session = enable_vector_search(spark)
    session.register("plain_vectors", str(tmp_path / "t"))
    found = session.sql("SELECT id FROM plain_vectors ORDER BY array_distance(vec, array(1.0D, 1.0D)) LIMIT 3")
    assert [r["id"] for r in found.collect()] == [4, 3]
    assert session.sql("SELECT id FROM plain_vectors").count() == 5


def test_damaged_indexes_and_writer_options(spark, tmp_path):
    import shutil

    import pyarrow.parquet as pq

    rows = [(i, [float(i), 0.0]) for i in range(40)]
    index = IndexBuilder(spark, write(spark, tmp_path, rows), "vec").n_clusters(2).option("compression", "gzip").build_new(str(tmp_path / "o"))
    file = next((tmp_path / "o").rglob("_ivf_cluster=*/*.parquet"))
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "GZIP"
    shutil.rmtree(index.folder.removeprefix("file:") + "/centroids")
    with pytest.raises(ValueError, match="damaged"):
        read_index(spark, str(tmp_path / "o"))


def test_long_vectors_by_arrow(spark):
    import numpy as np

    r = np.random.default_rng(1)
    v = r.standard_normal((20, 300))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(20, None), (21, [1.0]), (22, [None] * 300)], "id int, vec array<double>")
    got = {r["id"]: r["d"] for r in df.select("id", l2_distance(F.col("vec"), [float(x) for x in v[0]]).alias("d")).collect()}
    assert all(got[i] == pytest.approx(np.linalg.norm(v[i] - v[0])) for i in range(20)) and [got[i] for i in (20, 21, 22)] == [None] * 3
