"""The engine's queries over the tables of a folder, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import l2_distance, mean_recall, recall_at_k, vector_column, vector_dim, vector_report
from .operators import assign, candidates, cap_round_robin, exact_search_all, exact_topk, ivf_search_all, lloyd_step, probes_for, rank_candidates, rank_clusters, seeded_centroids
from .operators.kmeans import default_clusters, sample_size
from .plans import VectorSession, VectorTopKOptions
from .scratch import new_path
from .sources import IndexBuilder, TopkBuilder
from .sources.tables import embedding_at, generate, identified

K, CLUSTERS, NPROBE, CAP = 10, 16, 3, 40
EVERY, RECALL = 100, 0.95  # searches of every 100th id; what the probes are measured to find
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    """The embeddings, and the vector of vec_id 0 that the queries look around."""
    df = table(spark, sf_dir, "embeddings")
    return df, embedding_at(df, "embedding", "vec_id", 0)


# -- distance and exact ranking ----------------------------------------------------------

_Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_D = f"list_distance(embedding::DOUBLE[], {_Q})"


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings")
def l2_distance_all(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    return df.select("vec_id", F.round(l2_distance(F.col("embedding"), q), 6).alias("distance"))


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D}, vec_id LIMIT {K}")
def exact_topk_plain(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    return exact_topk(df, "embedding", q, K, ["vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, label, round({_D}, 6) AS distance FROM embeddings WHERE label >= 5 ORDER BY {_D}, vec_id LIMIT {K}")
def exact_topk_filtered(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    return exact_topk(df.where("label >= 5"), "embedding", q, K, ["vec_id"]).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _sql_exact(spark, sf_dir, order: str) -> DataFrame:
    session = VectorSession(spark)
    session.register("embeddings", f"{sf_dir}/embeddings.parquet")
    _, q = vectors(spark, sf_dir)
    constant = f"array({', '.join(f'{x!r}D' for x in q)})"
    distance = f"array_distance(embedding, {constant})"
    return session.sql(f"SELECT vec_id, round({distance}, 6) AS distance FROM embeddings ORDER BY {order.format(d=distance, q=constant)}")


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D} DESC LIMIT {K}")
def exact_topk_desc(spark, sf_dir):
    return _sql_exact(spark, sf_dir, "{d} DESC LIMIT " + str(K))


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D} LIMIT {K} OFFSET 5")
def exact_topk_offset(spark, sf_dir):
    return _sql_exact(spark, sf_dir, "{d} LIMIT " + str(K) + " OFFSET 5")


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D} LIMIT {K}")
def exact_topk_alias(spark, sf_dir):
    """The sort key is the distance's alias."""
    return _sql_exact(spark, sf_dir, f"distance LIMIT {K}")


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D} LIMIT {K}")
def exact_topk_swapped_cast(spark, sf_dir):
    """The constant on the left, and a cast around the column."""
    return _sql_exact(spark, sf_dir, "array_distance({q}, CAST(embedding AS array<double>)) LIMIT " + str(K))


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings")
def exact_sorted_without_limit(spark, sf_dir):
    return _sql_exact(spark, sf_dir, "{d}")


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_D}, vec_id) AS r FROM embeddings) WHERE r <= 2")
def exact_topk_by_label(spark, sf_dir):
    """The two nearest of each label: a window over the distance."""
    df, q = vectors(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id"))
    return df.withColumn("d", l2_distance(F.col("embedding"), q)).withColumn("r", place).where("r <= 2").select("label", "vec_id")


@query(f"SELECT vec_id, label FROM embeddings ORDER BY label, {_D}, vec_id LIMIT {K}")
def exact_topk_two_keys(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    return df.withColumn("d", l2_distance(F.col("embedding"), q)).orderBy("label", "d", "vec_id").limit(K).select("vec_id", "label")


@query("""SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE embedding IS NULL)::BIGINT AS n_null,
       count(*) FILTER (WHERE list_count(embedding) < len(embedding))::BIGINT AS n_null_elements,
       min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim FROM embeddings""")
def vector_validation(spark, sf_dir):
    return vector_report(table(spark, sf_dir, "embeddings"), "embedding")


# -- the index, stage by stage, with deterministic centroids -----------------------------

_C = f"""c AS (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS cluster_id, v AS centroid FROM (
  SELECT md5(vec_id::VARCHAR) AS h, embedding::DOUBLE[] AS v FROM embeddings ORDER BY h LIMIT {CLUSTERS}))"""
_A = """a AS (SELECT * EXCLUDE (r) FROM (
  SELECT e.vec_id, e.label, e.embedding, c.cluster_id, list_distance(e.embedding::DOUBLE[], c.centroid) AS d,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], c.centroid), c.cluster_id) AS r
  FROM embeddings e, c) WHERE r = 1)"""
_P = f"""p AS (SELECT cluster_id, d, probe_rank FROM (
  SELECT cluster_id, list_distance(centroid, {_Q}) AS d,
         row_number() OVER (ORDER BY list_distance(centroid, {_Q}), cluster_id)::INTEGER AS probe_rank FROM c)
  WHERE probe_rank <= {NPROBE})"""
_F = f"f AS (SELECT a.vec_id, a.label, a.embedding, a.cluster_id, p.probe_rank, list_distance(a.embedding::DOUBLE[], {_Q}) AS dq FROM a JOIN p USING (cluster_id))"


def _centroids(df: DataFrame) -> tuple[DataFrame, np.ndarray]:
    c = seeded_centroids(df, "vec_id", "embedding", CLUSTERS)
    rows = c.orderBy("cluster_id").collect()  # CLUSTERS rows
    return c, np.array([r["centroid"] for r in rows])


def _assigned(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[float]]:
    df, q = vectors(spark, sf_dir)
    c, matrix = _centroids(df)
    return assign(df, "embedding", matrix), c, q


@query(f"WITH {_C} SELECT cluster_id, d::INTEGER AS d, round(x, 6) AS x FROM (SELECT cluster_id, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS d FROM c)")
def ivf_centroids_seeded(spark, sf_dir):
    c = seeded_centroids(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", CLUSTERS)
    return c.select("cluster_id", F.posexplode("centroid").alias("d", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_C}, {_A} SELECT vec_id, cluster_id FROM a")
def ivf_assign(spark, sf_dir):
    return _assigned(spark, sf_dir)[0].select("vec_id", "cluster_id")


@query(f"WITH {_C}, {_A} SELECT cluster_id, count(*)::BIGINT AS n_rows FROM a GROUP BY cluster_id")
def ivf_list_sizes(spark, sf_dir):
    return _assigned(spark, sf_dir)[0].groupBy("cluster_id").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {_C}, {_A}, x AS (SELECT cluster_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM a)
SELECT cluster_id, d::INTEGER AS d, round(avg(x), 6) AS x FROM x GROUP BY cluster_id, d""")
def ivf_lloyd_step(spark, sf_dir):
    assigned, c, _ = _assigned(spark, sf_dir)
    return lloyd_step(assigned, "embedding", c).select("cluster_id", F.posexplode("centroid").alias("d", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_C}, {_P} SELECT cluster_id, probe_rank, round(d * d, 6) AS d2 FROM p")
def ivf_probe_rank(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    return rank_clusters(_centroids(df)[0], q, NPROBE).select("cluster_id", "probe_rank", F.round("d2", 6).alias("d2"))


def _probed(spark, sf_dir, nprobe: int = NPROBE) -> tuple[DataFrame, list[float]]:
    assigned, c, q = _assigned(spark, sf_dir)
    return candidates(assigned, rank_clusters(c, q, nprobe)), q


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, cluster_id, probe_rank FROM f")
def ivf_candidates(spark, sf_dir):
    return _probed(spark, sf_dir)[0].select("vec_id", "cluster_id", "probe_rank")


def _ranked(found: DataFrame, q: list[float], where: str | None = None) -> DataFrame:
    return rank_candidates(found, "embedding", q, K, ["vec_id"], where).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, round(dq, 6) AS distance FROM f ORDER BY dq, vec_id LIMIT {K}")
def ivf_topk(spark, sf_dir):
    return _ranked(*_probed(spark, sf_dir))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, round(dq, 6) AS distance FROM f WHERE label >= 8 ORDER BY dq, vec_id LIMIT {K}")
def ivf_topk_postfilter(spark, sf_dir):
    found, q = _probed(spark, sf_dir)
    return _ranked(found, q, "label >= 8")


@query(f"SELECT vec_id, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D}, vec_id LIMIT {K}")
def ivf_topk_full_probe(spark, sf_dir):
    return _ranked(*_probed(spark, sf_dir, CLUSTERS))


@query(f"""WITH {_C}, {_A}, {_P}, {_F}, t AS (SELECT *, vec_id % 4 AS file, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY probe_rank, vec_id) AS turn FROM f)
SELECT vec_id, file FROM t ORDER BY turn, file LIMIT {CAP}""")
def ivf_multifile_cap(spark, sf_dir):
    found, _ = _probed(spark, sf_dir)
    return cap_round_robin(found.withColumn("file", F.col("vec_id") % 4), CAP, "file", "vec_id").select("vec_id", "file")


@query(f"""WITH {_C}, {_A}, {_P}, {_F}, found AS (SELECT vec_id FROM f ORDER BY dq, vec_id LIMIT {K}),
truth AS (SELECT vec_id FROM embeddings ORDER BY {_D}, vec_id LIMIT {K})
SELECT count(found.vec_id)::BIGINT AS hits, count(*)::BIGINT AS truth_size, count(found.vec_id) / count(*)::DOUBLE AS recall
FROM truth LEFT JOIN found USING (vec_id)""")
def recall_at_10(spark, sf_dir):
    found, q = _probed(spark, sf_dir)
    truth = exact_topk(table(spark, sf_dir, "embeddings"), "embedding", q, K, ["vec_id"])
    return recall_at_k(_ranked(found, q), truth, "vec_id")


# -- the built index ---------------------------------------------------------------------


@cache
def _index_path(app: str, source: str, layout: str) -> str:
    return f"{new_path(SparkSession.active())}-{layout}"


def _built(spark, sf_dir, clusters: int = CLUSTERS):
    """The index over the embeddings, trained, written and read once for each application."""
    from .sources import ensure_indexed, has_vector_index

    source = f"{sf_dir}/embeddings.parquet"
    path = _index_path(spark.sparkContext.applicationId, source, "rows")
    if not has_vector_index(spark, path):
        IndexBuilder(spark, source, "embedding").n_clusters(clusters).build_new(path)
    return ensure_indexed(spark, source, path, "embedding")


@query(f"SELECT vec_id, label, round({_D}, 6) AS distance FROM embeddings ORDER BY {_D}, vec_id LIMIT {K}")
def ivf_index_full_probe(spark, sf_dir):
    _, q = vectors(spark, sf_dir)
    return _built(spark, sf_dir).search(q, K, CLUSTERS).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query()
def ivf_index_search_trained(spark, sf_dir):
    _, q = vectors(spark, sf_dir)
    return _built(spark, sf_dir).search(q, K, NPROBE, where="label >= 1").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@cache
def _seeded_index(app: str, source: str, layout: str) -> str:
    """The path of an index over given centroids, those that SQL can name; in place over a copy."""
    spark = SparkSession.active()
    df, path = spark.read.parquet(source), f"{new_path(spark)}-seeded"
    builder = IndexBuilder(spark, source, "embedding").centroids(_centroids(df)[1])
    if layout == "rows":
        builder.build_new(path)
    else:
        for part in range(3):  # files of one name in several folders
            df.where(F.col("vec_id") % 3 == part).coalesce(1).write.parquet(f"{path}/part={part}")
        IndexBuilder(spark, path, "embedding").centroids(_centroids(df)[1]).build_inplace()
    return path


def _seeded(spark, sf_dir, layout: str):
    from .sources import read_index

    return read_index(spark, _seeded_index(spark.sparkContext.applicationId, f"{sf_dir}/embeddings.parquet", layout))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, label, round(dq, 6) AS distance FROM f WHERE label >= 1 ORDER BY dq, vec_id LIMIT {K}")
def ivf_index_search(spark, sf_dir):
    """A built index over given centroids, NPROBE clusters of it probed, candidates filtered."""
    _, q = vectors(spark, sf_dir)
    return _seeded(spark, sf_dir, "rows").search(q, K, NPROBE, where="label >= 1").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, probe_rank FROM f")
def ivf_inplace_candidates(spark, sf_dir):
    """Rows read by their addresses, file and row, beside an index in place."""
    _, q = vectors(spark, sf_dir)
    return _seeded(spark, sf_dir, "postings").candidates(q, NPROBE).select("vec_id", F.col("probe_rank").cast("int").alias("probe_rank"))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, label, round(dq, 6) AS distance FROM f WHERE label >= 1 ORDER BY dq, vec_id LIMIT {K}")
def ivf_inplace_search(spark, sf_dir):
    _, q = vectors(spark, sf_dir)
    return _seeded(spark, sf_dir, "postings").search(q, K, NPROBE, where="label >= 1").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {_C}, {_A}, {_P}, {_F} SELECT vec_id, round(dq, 6) AS distance FROM f ORDER BY dq, vec_id LIMIT {K}")
def ivf_direct_search(spark, sf_dir):
    """TopkBuilder gives addresses; the rows at them."""
    _, q = vectors(spark, sf_dir)
    index = _seeded(spark, sf_dir, "postings")
    found = TopkBuilder(spark, index.path, q).k(K).nprobe(NPROBE).search()
    at = (F.col("_ivf_file") == F.col("file")) & (F.col("_ivf_row") == F.col("row_index"))
    return identified(spark, index.path).join(F.broadcast(found), at).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {_C}, {_A}, {_P} SELECT (SELECT count(*) FROM a JOIN p USING (cluster_id))::BIGINT AS candidate_rows, (SELECT count(*) FROM a JOIN p USING (cluster_id) WHERE label >= 1)::BIGINT AS embeddings_fetched")
def ivf_metrics(spark, sf_dir):
    session = VectorSession(spark, VectorTopKOptions(nprobe=NPROBE))
    session.register("metered_embeddings", _seeded(spark, sf_dir, "rows").path)
    _, q = vectors(spark, sf_dir)
    vector = ", ".join(f"{x!r}D" for x in q)
    found = session.query(f"SELECT vec_id FROM metered_embeddings WHERE label >= 1 ORDER BY array_distance(embedding, array({vector})) LIMIT {K}").metrics()
    return spark.createDataFrame([(found["candidate_rows"], found["embeddings_fetched"])], "candidate_rows long, embeddings_fetched long")


def _of_queries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("key") % EVERY == 0).select(F.col("key").alias("query_id"), "vector")


def _keyed(df: DataFrame) -> DataFrame:
    return df.select(F.col("vec_id").cast("long").alias("key"), "cluster_id", F.col("embedding").alias("vector"))


@cache
def _default_index(app: str, source: str) -> tuple[str, int]:
    """The path of an index with a number of clusters that follows the rows, and how many of them to probe."""
    spark, path = SparkSession.active(), f"{new_path(SparkSession.active())}-default"
    index = IndexBuilder(spark, source, "embedding").build_new(path)
    return path, probes_for(RECALL, _keyed(index.assigned), index.matrix(), K)


def _search_all(spark, sf_dir) -> tuple[DataFrame, DataFrame, int, int]:
    """The index's answers to all searches, those of brute force, probes and clusters."""
    from .sources import read_index

    path, nprobe = _default_index(spark.sparkContext.applicationId, f"{sf_dir}/embeddings.parquet")
    index = read_index(spark, path)
    matrix, rows = index.matrix(), _keyed(index.assigned)
    found = ivf_search_all(_of_queries(rows), rows, matrix, K, nprobe)
    return found, exact_search_all(_of_queries(rows), rows, K, index.manifest.dim), nprobe, len(matrix)


_ALL = "query_id", "key AS vec_id", "place", "round(distance, 6) AS distance"


@query(f"""SELECT query_id, vec_id, place, round(d, 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id))::INTEGER AS place FROM (
  SELECT q.vec_id AS query_id, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % {EVERY} = 0))
WHERE place <= {K}""")
def exact_search_every_100th(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    rows = _keyed(df.withColumn("cluster_id", F.lit(0)))
    return exact_search_all(_of_queries(rows), rows, K, vector_dim(df, "embedding")).selectExpr(*_ALL)


@query()
def ivf_search_every_100th(spark, sf_dir):
    """Around every 100th row among all rows, with as many probes as find RECALL on a sample."""
    return _search_all(spark, sf_dir)[0].selectExpr(*_ALL)


@query()
def ivf_recall_every_100th(spark, sf_dir):
    """The recall of ivf_search_every_100th against brute force: of all searches, and the least."""
    found, truth, nprobe, clusters = _search_all(spark, sf_dir)
    return mean_recall(found, truth, "query_id", "key").withColumns({"nprobe": F.lit(nprobe), "clusters": F.lit(clusters)})


@query("SELECT vec_id, label FROM embeddings")
def ivf_index_table(spark, sf_dir):
    return _built(spark, sf_dir).table.select("vec_id", "label")


@query(f"SELECT vec_id, label FROM embeddings WHERE label >= 1 ORDER BY {_D}, vec_id LIMIT {K}")
def ivf_sql(spark, sf_dir):
    """The SQL route through the index, every cluster probed."""
    session = VectorSession(spark, VectorTopKOptions(nprobe=CLUSTERS))
    session.register("indexed_embeddings", _built(spark, sf_dir).path)
    _, q = vectors(spark, sf_dir)
    vector = ", ".join(f"{x!r}D" for x in q)
    found = session.query(f"SELECT vec_id, label FROM indexed_embeddings WHERE label >= 1 ORDER BY array_distance(embedding, array({vector})) LIMIT {K}")
    if not found.accelerated:
        raise AssertionError("the query should use the index")
    return found.df


@query(f"""SELECT n.vec_id, d.lang, d.n_chars FROM (SELECT vec_id FROM embeddings ORDER BY {_D}, vec_id LIMIT {K}) n JOIN documents d ON d.doc_id = n.vec_id""")
def join_with_topk(spark, sf_dir):
    df, q = vectors(spark, sf_dir)
    near = exact_topk(df, "embedding", q, K, ["vec_id"])
    return near.join(table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id")).select("vec_id", "lang", "n_chars")


@query(f"WITH {_C}, {_A} SELECT vec_id, cluster_id FROM a")
def stream_assign(spark, sf_dir):
    """Vectors of a stream, each assigned to its cluster of the index."""
    from .streaming import assign_stream

    index, out = _seeded(spark, sf_dir, "rows"), new_path(spark)
    source = table(spark, sf_dir, "embeddings")
    folder = new_path(spark)
    source.write.parquet(folder)
    stream = assign_stream(spark.readStream.schema(source.schema).parquet(folder), index).select("vec_id", "cluster_id")
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


@query("SELECT 'new' AS place, false AS before, true AS after UNION ALL SELECT 'in place', false, true")
def index_presence(spark, sf_dir):
    from .sources import has_vector_index

    df, out = table(spark, sf_dir, "embeddings"), []
    matrix = _centroids(df)[1]
    for place in ("new", "in place"):
        path, source = new_path(spark), new_path(spark)
        df.write.parquet(source)
        at = path if place == "new" else source
        before = has_vector_index(spark, at)
        builder = IndexBuilder(spark, source, "embedding").centroids(matrix)
        builder.build_new(path) if place == "new" else builder.build_inplace()
        out.append((place, before, has_vector_index(spark, at)))
    return spark.createDataFrame(out, "place string, before boolean, after boolean")


_WRONG = ("blank column", "no column", "no list", "no floats", "no iterations", "no clusters", "too many clusters", "other dimensions", "null vectors", "no rows")


@query("SELECT unnest([" + ", ".join(f"'{x}'" for x in _WRONG) + "]) AS setting, true AS refused")
def index_config_checks(spark, sf_dir):
    """What a builder refuses, and that it does."""
    source, path = f"{sf_dir}/embeddings.parquet", new_path(spark)
    df = spark.read.parquet(source)
    df.withColumn("embedding", F.when(F.col("vec_id") > 0, F.col("embedding"))).write.parquet(f"{path}/nulls")
    df.limit(0).write.parquet(f"{path}/none")
    df.select(F.array(F.lit("x")).alias("words"), "vec_id").write.parquet(f"{path}/words")
    build = lambda at, column="embedding": IndexBuilder(spark, at, column)
    tries = (
        lambda: build(source, " "), lambda: build(source, "nothing").build_new(path), lambda: build(source, "vec_id").build_new(path),
        lambda: build(f"{path}/words", "words").build_new(path), lambda: build(source).max_iters(0).build_new(path), lambda: build(source).n_clusters(0).build_new(path),
        lambda: build(source).n_clusters(10**9).build_new(path), lambda: build(source).centroids(np.zeros((2, 3))).build_new(path),
        lambda: build(f"{path}/nulls").build_new(path), lambda: build(f"{path}/none").build_new(path),
    )
    out = []
    for name, attempt in zip(_WRONG, tries, strict=True):
        try:
            attempt()
            out.append((name, False))
        except ValueError:
            out.append((name, True))
    return spark.createDataFrame(out, "setting string, refused boolean")


@query("SELECT 'embedding' AS vector_column, len(embedding)::INTEGER AS dim FROM embeddings LIMIT 1")
def vector_inference(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    name = vector_column(df)
    return spark.createDataFrame([(name, vector_dim(df, name))], "vector_column string, dim int")


@query("""SELECT n AS rows, ceil(sqrt(n))::BIGINT AS clusters, least(n, greatest(least(greatest(n // 20, 1), 100000), ceil(sqrt(n))::BIGINT)) AS sample
FROM (SELECT unnest([1, 2, 19, 100, 101, 4000, 250000, 3000000, 50000000])::BIGINT AS n)""")
def index_defaults(spark, sf_dir):
    """The default number of clusters and the least sample, by rows."""
    sizes = (1, 2, 19, 100, 101, 4000, 250_000, 3_000_000, 50_000_000)
    return spark.createDataFrame([(n, default_clusters(n), sample_size(n, default_clusters(n))) for n in sizes], "rows long, clusters long, sample long")


@query("SELECT 500::BIGINT AS n, 500::BIGINT AS ids, 16 AS dim, true AS in_range")
def generated_vectors(spark, sf_dir):
    made = generate(spark, 500, 16)
    inside = F.bool_and(F.forall("embedding", lambda x: (x >= 0) & (x < 1)))
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.max(F.size("embedding")).alias("dim"), inside.alias("in_range"))


@query(f"SELECT 'VectorTopK: k={K}, column=embedding, query_dim=' || len(embedding) || ', nprobe={NPROBE}' AS plan FROM embeddings WHERE vec_id = 0")
def ivf_explain(spark, sf_dir):
    session = VectorSession(spark, VectorTopKOptions(nprobe=NPROBE))
    session.register("explained_embeddings", _seeded(spark, sf_dir, "rows").path)
    _, q = vectors(spark, sf_dir)
    vector = ", ".join(f"{x!r}D" for x in q)
    found = session.query(f"SELECT vec_id FROM explained_embeddings ORDER BY array_distance(embedding, array({vector})) LIMIT {K}")
    return spark.createDataFrame([(found.explain().split("\n")[0],)], "plan string")


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_round_trip(spark, sf_dir):
    """A table of few rows through Arrow memory and back."""
    return spark.createDataFrame(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toArrow())


# -- SQL beside vector search: one query of each kind ------------------------------------


def _sql(name: str, text: str, *tables: str, oracle: str | None = None) -> None:
    def run(spark, sf_dir):
        views(spark, sf_dir, *tables)
        return spark.sql(text)

    run.__name__ = name
    _found[name] = (run, oracle or text)


_sql("sql_join_inner", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""", "orders", "customer", "nation")
_sql("sql_join_left", """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""", "orders", "customer")
_sql("sql_join_right", """SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey""", "orders", "customer")
_sql("sql_join_full", """SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(p_partkey, -1) AS p_partkey FROM (SELECT s_suppkey FROM supplier) s FULL OUTER JOIN (SELECT p_partkey FROM part WHERE p_size > 25) p
ON s_suppkey = p_partkey""", "supplier", "part")
_sql("sql_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", "customer", "orders")
_sql("sql_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "customer", "orders")
_sql("sql_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
_sql("sql_join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
_sql("sql_join_range", """SELECT b.lo, count(*) AS n FROM part JOIN (VALUES (1, 10), (11, 30), (31, 50)) AS b(lo, hi) ON p_size BETWEEN b.lo AND b.hi GROUP BY b.lo""", "part")
_sql("sql_aggregate", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "lineitem")
_sql("sql_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps FROM lineitem", "lineitem")
_sql("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_sql("sql_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
_sql("sql_statistics", """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r, median(l_quantity) AS med
FROM lineitem GROUP BY l_returnflag""", "lineitem")
_sql("sql_window_rank", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""", "orders", oracle="""SELECT o_orderkey, (row_number() OVER w)::INTEGER AS rn,
(rank() OVER w)::INTEGER AS rk, (dense_rank() OVER w)::INTEGER AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
_sql("sql_window_frame", """SELECT event_id, lag(value) OVER w AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS near
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", "events")
_sql("sql_window_first_last", """SELECT event_id, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS s, last_value(event_id) OVER w AS l
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", "events")
_sql("sql_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", "nation", "region")
_sql("sql_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45", "part", "lineitem")
_sql("sql_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql("sql_window_distribution", """SELECT o_orderkey, lead(o_totalprice, 2) OVER w AS further, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""", "orders",
oracle="""SELECT o_orderkey, lead(o_totalprice, 2) OVER w AS further, (ntile(4) OVER w)::INTEGER AS quarter, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd
FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""")
_sql("sql_window_range", """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM part""", "part")
_sql("sql_regex", """SELECT p_partkey, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) AS second, regexp_replace(p_brand, '[0-9]+', 'N') AS b, p_name RLIKE '^[a-m]' AS early FROM part""", "part",
oracle="""SELECT p_partkey, regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) AS second, regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS b, regexp_matches(p_name, '^[a-m]') AS early FROM part""")
_sql("sql_array_agg", """SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names, listagg(n_name, '/') WITHIN GROUP (ORDER BY n_nationkey) AS by_key, size(collect_set(n_regionkey)) AS one
FROM nation GROUP BY n_regionkey""", "nation", oracle="""SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names, string_agg(n_name, '/' ORDER BY n_nationkey) AS by_key,
len(list_distinct(array_agg(n_regionkey)))::INTEGER AS one FROM nation GROUP BY n_regionkey""")
_sql("sql_higher_order", """SELECT vec_id, size(filter(embedding, x -> x > 0)) AS positive, round(aggregate(transform(embedding, x -> double(x) * x), 0D, (s, x) -> s + x), 4) AS squares,
exists(embedding, x -> x > 1) AS any_big FROM embeddings""", "embeddings", oracle="""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive,
round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS squares, len(list_filter(embedding, lambda x: x > 1)) > 0 AS any_big FROM embeddings""")
_sql("sql_map_struct", """SELECT o_orderkey, element_at(m, 'status') AS status, size(map_keys(m)) AS n, s.price AS price, s.who.id AS id FROM (
SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) AS m, named_struct('price', o_totalprice, 'who', named_struct('id', o_custkey)) AS s FROM orders)""", "orders",
oracle="""SELECT o_orderkey, m['status'] AS status, len(map_keys(m))::INTEGER AS n, s.price AS price, s.who.id AS id FROM (
SELECT o_orderkey, MAP {'status': o_orderstatus, 'priority': o_orderpriority} AS m, {'price': o_totalprice, 'who': {'id': o_custkey}} AS s FROM orders)""")
_sql("sql_json", """SELECT c_custkey, get_json_object(j, '$.k') AS k, from_json(j, 'k BIGINT, seg STRING').seg AS seg, json_array_length('[1,2,3]') AS three FROM (
SELECT c_custkey, to_json(named_struct('k', c_custkey, 'seg', c_mktsegment)) AS j FROM customer)""", "customer",
oracle="""SELECT c_custkey, json_extract_string(j, '$.k') AS k, json_extract_string(j, '$.seg') AS seg, json_array_length('[1,2,3]')::INTEGER AS three FROM (
SELECT c_custkey, to_json({'k': c_custkey, 'seg': c_mktsegment}) AS j FROM customer)""")
# A sketch beside count(DISTINCT) in one aggregate is kept for each distinct value, and median() holds a group's values in one task; so
# sketches, distinct values and medians are aggregated apart. The sketch names a bracket of 0.1 % around the median, five times as wide
# as its error; values in the bracket are ranked, those below it only counted.
_APPROXIMATE = """sketch AS (SELECT l_returnflag, approx_count_distinct(l_partkey, 0.02) AS parts_near, percentile_approx(l_extendedprice, array(0.4995, 0.5, 0.5005), 10000) AS near,
  count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag),
counted AS (SELECT /*+ BROADCAST(s) */ l.l_returnflag, CASE WHEN l_extendedprice >= near[0] THEN l_extendedprice END AS x, count(l_extendedprice) AS c,
  first(parts_near) AS parts_near, first(near[1]) AS median_near, first(n) AS n
  FROM lineitem l JOIN sketch s ON l.l_returnflag <=> s.l_returnflag WHERE coalesce(l_extendedprice <= near[2], true) GROUP BY 1, 2),
ranked AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag ORDER BY x NULLS FIRST) AS upto FROM counted),
middle AS (SELECT l_returnflag, first(parts_near) AS parts_near, first(median_near) AS median_near, first(n) AS n,
  min(struct(x)) FILTER (WHERE upto >= (n + 1) div 2).x AS low, min(struct(x)) FILTER (WHERE upto >= n div 2 + 1).x AS high FROM ranked GROUP BY l_returnflag),
medians AS (SELECT l_returnflag, parts_near, median_near,
  CASE WHEN n > 0 AND (low IS NULL OR high IS NULL) THEN raise_error('the median is outside its bracket') WHEN low = high THEN low ELSE low * 0.5D + high * 0.5D END AS median FROM middle),
parts AS (SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag)"""
_sql("sql_approximate", f"""WITH {_APPROXIMATE} SELECT m.l_returnflag, abs(parts_near - parts) <= 0.1 * parts AS distinct_near, abs(median_near - median) <= 0.01 * median AS median_near
FROM medians m JOIN parts p ON m.l_returnflag <=> p.l_returnflag""", "lineitem",
     oracle="SELECT l_returnflag, true AS distinct_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
_sql("sql_pivot", """SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))""", "orders",
oracle="""SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o,
nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority""")
_sql("sql_aggregate_filter", """SELECT o_orderpriority, count(*) FILTER (WHERE o_totalprice > 150000) AS dear, max_by(o_orderkey, o_totalprice) AS dearest, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_orderpriority""", "orders")
_sql("sql_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
_sql("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE t > 500000 GROUP BY c_mktsegment", "orders", "customer")
_sql("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t")
_sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "orders")
_sql("sql_strings", """SELECT p_partkey, upper(p_name) AS u, length(p_name) AS n, substring(p_name, 1, 5) AS s, replace(p_brand, '#', '-') AS b, concat(p_brand, '/', p_type) AS c,
trim(concat(' ', p_name, ' ')) AS t, split_part(p_name, ' ', 1) AS w, translate(p_brand, 'Bd', 'xy') AS tr, levenshtein(p_brand, p_type) AS lv FROM part""", "part",
oracle="""SELECT p_partkey, upper(p_name) AS u, length(p_name)::INTEGER AS n, substring(p_name, 1, 5) AS s, replace(p_brand, '#', '-') AS b, concat(p_brand, '/', p_type) AS c,
trim(concat(' ', p_name, ' ')) AS t, split_part(p_name, ' ', 1) AS w, translate(p_brand, 'Bd', 'xy') AS tr, levenshtein(p_brand, p_type)::INTEGER AS lv FROM part""")
_sql("sql_arrays", "SELECT vec_id, size(embedding) AS n, round(element_at(embedding, 1), 5) AS x, size(slice(embedding, 1, 5)) AS five, array_contains(array(label, 3), 3) AS has FROM embeddings", "embeddings",
oracle="SELECT vec_id, len(embedding)::INTEGER AS n, round(embedding[1], 5) AS x, len(embedding[1:5])::INTEGER AS five, list_contains([label, 3], 3) AS has FROM embeddings")
_sql("sql_unnest", "SELECT label, count(*) AS n FROM (SELECT label, explode(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY label", "embeddings",
oracle="SELECT label, count(*) AS n FROM (SELECT label, unnest(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY label")
_sql("sql_dates", "SELECT date_trunc('MONTH', o_orderdate) AS m, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2", "orders",
oracle="SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1, 2")
_sql("sql_math", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, floor(o_totalprice) AS f, o_custkey div 7 AS d, o_custkey % 7 AS m, abs(-o_custkey) AS a FROM orders", "orders",
oracle="SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, floor(o_totalprice)::BIGINT AS f, o_custkey // 7 AS d, o_custkey % 7 AS m, abs(-o_custkey) AS a FROM orders")
_sql("sql_conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'O'), '-') AS st FROM orders", "orders")


@query("SELECT label, count(*) AS n, round(sum(x), 5) AS first, round(avg(x) * 2, 5) AS twice FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def user_functions(spark, sf_dir):
    """A scalar and an aggregate function of the user's, both over Arrow batches."""
    @F.pandas_udf("double")
    def doubled(x: pd.Series) -> pd.Series:
        return x * 2

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    df = table(spark, sf_dir, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x")).withColumn("y", doubled("x"))
    exact = df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("x"), 5).alias("first"))
    own = df.groupBy("label").agg(F.round(mean("y"), 5).alias("twice"))
    return exact.join(own, "label")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def user_table_function(spark, sf_dir):
    """A table function of the user's, joined laterally from SQL text."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="word: string")
    class Words:
        def eval(self, text: str):
            for word in text.split(" "):
                yield (word,)

    spark.udtf.register("words_of", Words)
    views(spark, sf_dir, "nation")
    return spark.sql("SELECT n_nationkey, word FROM nation, LATERAL words_of(n_name)")


@query("""SELECT k, n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 100 + s_nationkey, count(*) FROM supplier GROUP BY 1) WHERE k <> 3""")
def sql_ddl_dml(spark, sf_dir):
    """CREATE TABLE, INSERT, INSERT OVERWRITE and DROP, in a database of its own."""
    import uuid

    views(spark, sf_dir, "customer", "supplier")
    name, at = f"lodestone_{uuid.uuid4().hex[:8]}", new_path(spark)
    spark.sql(f"CREATE DATABASE {name} LOCATION '{at}'")
    try:
        spark.sql(f"CREATE TABLE {name}.t (k INT, n BIGINT) USING parquet")
        spark.sql(f"INSERT INTO {name}.t SELECT c_nationkey, count(*) FROM customer GROUP BY 1")
        spark.sql(f"INSERT INTO {name}.t SELECT 100 + s_nationkey, count(*) FROM supplier GROUP BY 1")
        spark.sql(f"CREATE TABLE {name}.u USING parquet AS SELECT * FROM {name}.t WHERE k <> 3")
        spark.sql(f"INSERT OVERWRITE {name}.t SELECT * FROM {name}.u")
        out = new_path(spark)
        spark.table(f"{name}.t").write.parquet(out)
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return spark.read.parquet(out)


@query("SELECT event_type, count(*) AS n FROM events WHERE props IS NOT NULL AND length(props) > 0 GROUP BY event_type")
def formats_round_trip(spark, sf_dir):
    """events written as CSV, JSON and ORC and read back, each a part of the columns."""
    src, at = table(spark, sf_dir, "events").select("event_id", "event_type", "props"), new_path(spark)
    src.select("event_id", "event_type").write.csv(f"{at}/csv", header=True)
    src.select("event_id", "props").write.json(f"{at}/json")
    src.select("event_id").write.orc(f"{at}/orc")
    types = spark.read.schema("event_id long, event_type string").csv(f"{at}/csv", header=True)
    props = spark.read.schema("event_id long, props string").json(f"{at}/json")
    ids = spark.read.orc(f"{at}/orc")
    both = ids.join(types, "event_id").join(props, "event_id").where("props IS NOT NULL AND length(props) > 0")
    return both.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT e.event_id, coalesce(max(p.event_id), -1) AS last_purchase FROM events e LEFT JOIN events p
ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id <= e.event_id))
AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase'
  AND (q.ts < e.ts OR (q.ts = e.ts AND q.event_id <= e.event_id)) AND (q.ts > p.ts OR (q.ts = p.ts AND q.event_id > p.event_id)))
GROUP BY e.event_id""")
def join_asof(spark, sf_dir):
    """Each event with the last purchase of its user so far: one window, no join."""
    e = table(spark, sf_dir, "events")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.coalesce(F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before), F.lit(-1)).alias("last_purchase"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}
