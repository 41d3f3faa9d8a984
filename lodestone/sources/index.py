"""An inverted-file index over one vector column, kept as Parquet.

``build_new(output)`` writes the rows anew, a folder for each cluster, so that a search
prunes partitions to the probed clusters.  ``build_inplace()`` leaves the data as it is and
writes postings beside it.  Either way a version folder is written whole before the
manifest points to it, so a failed build leaves the old index valid.

    <root>/_ivf/manifest.json            column, dim, clusters, seed, layout, version
    <root>/_ivf/<version>/centroids      cluster_id, centroid, n_rows
    <root>/_ivf/<version>/rows           _ivf_cluster=<id>/: the source's columns, _ivf_file, _ivf_row
    <root>/_ivf/<version>/postings       _ivf_cluster=<id>/: _ivf_file, _ivf_row
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validate import check_column, check_vectors
from ..operators.assign import assign
from ..operators.kmeans import SAMPLE_CAP, SAMPLE_FLOOR, default_clusters, sample_size, train, training_sample
from ..operators.probe import cap_round_robin, rank_clusters
from ..operators.topk import exact_topk
from .tables import identified

FORMAT = 1
FILES = 1000  # names of files with candidates that a scan is told
HIDDEN = ("_ivf_cluster", "_ivf_file", "_ivf_row")


@dataclass(frozen=True)
class Manifest:
    column: str
    dim: int
    clusters: int
    rows: int
    seed: int
    layout: str  # "rows" or "postings"
    version: str
    format: int = FORMAT


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _fs(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _root(spark: SparkSession, path: str) -> str:
    """Where a table's index lies: inside a folder, beside a file; readers skip the name."""
    at, fs = _fs(spark, path)
    single = fs.exists(at) and fs.getFileStatus(at).isFile()
    if single:
        parent, name = path.rstrip("/").rsplit("/", 1)
        return f"{parent}/_ivf_{name}"
    return f"{path.rstrip('/')}/_ivf"


def _manifest(spark: SparkSession, path: str) -> Manifest | None:
    text = _read_text(spark, f"{_root(spark, path)}/manifest.json")
    if text is None:
        return None
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise ValueError(f"index format {found.get('format')} of {path} is not supported")
    return Manifest(**found)


def has_vector_index(spark: SparkSession, path: str) -> bool:
    return _manifest(spark, path) is not None


@dataclass
class IvfIndex:
    """An index that was read; its tables are lazy."""

    spark: SparkSession
    path: str
    manifest: Manifest

    @property
    def folder(self) -> str:
        return f"{_root(self.spark, self.path)}/{self.manifest.version}"

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/centroids")

    @property
    def postings(self) -> DataFrame:
        """cluster_id, _ivf_file, _ivf_row for each row."""
        return self.spark.read.parquet(f"{self.folder}/{self.manifest.layout}").select(F.col("_ivf_cluster").alias("cluster_id"), "_ivf_file", "_ivf_row")

    @property
    def table(self) -> DataFrame:
        """The source's rows and columns."""
        if self.manifest.layout == "rows":
            return self.spark.read.parquet(f"{self.folder}/rows").drop(*HIDDEN)
        return self.spark.read.parquet(self.path)

    @property
    def assigned(self) -> DataFrame:
        """The source's rows and columns, and cluster_id."""
        if self.manifest.layout == "rows":
            return self.spark.read.parquet(f"{self.folder}/rows").withColumnRenamed("_ivf_cluster", "cluster_id").drop(*HIDDEN)
        return identified(self.spark, self.path).join(self.postings, ["_ivf_file", "_ivf_row"]).drop(*HIDDEN)

    def matrix(self) -> np.ndarray:
        """The centroids in the order of their ids: at most ceil(sqrt(rows)) by default."""
        return np.array([r["centroid"] for r in self.centroids.orderBy("cluster_id").collect()])

    def check_query(self, query: Sequence[float], column: str | None = None) -> list[float]:
        q = [float(x) for x in query]
        if len(q) != self.manifest.dim:
            raise ValueError(f"query has {len(q)} dimensions, the index {self.manifest.dim}")
        if column is not None and column != self.manifest.column:
            raise ValueError(f"the index is over {self.manifest.column}, not {column}")
        return q

    def probed(self, query: Sequence[float], nprobe: int) -> list[int]:
        """The ids of the probed clusters in order: nprobe numbers."""
        return [r["cluster_id"] for r in rank_clusters(self.centroids, self.check_query(query), nprobe).orderBy("probe_rank").collect()]

    def candidates(self, query: Sequence[float], nprobe: int, cap: int | None = None) -> DataFrame:
        """Rows of the probed clusters with all columns, _ivf_file, _ivf_row and probe_rank.

        The cluster ids are literals, so that the scan prunes partitions; the cap counts
        candidates before any filter.  Rows whose vector doesn't fit are no candidates.
        """
        ids = self.probed(query, nprobe)
        rank = F.array_position(F.array(*[F.lit(i) for i in ids]).cast("array<int>"), F.col("_ivf_cluster")) if ids else F.lit(0)
        postings = self.spark.read.parquet(f"{self.folder}/{self.manifest.layout}").where(F.col("_ivf_cluster").isin(ids)).withColumn("probe_rank", rank)
        if self.manifest.layout == "postings":
            postings = cap_round_robin(postings.select("_ivf_file", "_ivf_row", "probe_rank"), cap, "_ivf_file", "_ivf_row")
            rows = identified(self.spark, self.path)
            # Files without candidates are pruned, as long as their names are few.
            files = [r[0] for r in postings.select("_ivf_file").distinct().limit(FILES + 1).collect()]
            if len(files) <= FILES:
                rows = rows.where(F.col("_ivf_file").isin(files))
            return rows.join(postings, ["_ivf_file", "_ivf_row"])
        return cap_round_robin(postings, cap, "_ivf_file", "_ivf_row").drop("_ivf_cluster")

    def search(self, query: Sequence[float], k: int, nprobe: int, where: str | None = None, cap: int | None = None) -> DataFrame:
        """The ``k`` nearest candidates: all columns and distance.  A filter applies to
        candidates, so fewer than k rows may come back although more rows match."""
        found = self.candidates(query, nprobe, cap)
        found = found.where(where) if where else found
        return exact_topk(found, self.manifest.column, query, k, ["_ivf_file", "_ivf_row"])


def read_index(spark: SparkSession, path: str) -> IvfIndex:
    manifest = _manifest(spark, path)
    if manifest is None:
        raise ValueError(f"no vector index at {path}")
    index = IvfIndex(spark, path, manifest)
    for part in ("centroids", manifest.layout):
        at, fs = _fs(spark, f"{index.folder}/{part}")
        if not fs.exists(at):
            raise ValueError(f"the index at {path} is damaged: {part} of {manifest.version} is missing")
    if (n := index.centroids.count()) != manifest.clusters:
        raise ValueError(f"the index at {path} is damaged: {n} centroids of {manifest.clusters}")
    return index


class IndexBuilder:
    """Builds an index: ``IndexBuilder(spark, source, column).n_clusters(64).build_new(out)``.

    Defaults: ceil(sqrt(rows)) clusters, 20 iterations, seed 42.
    """

    def __init__(self, spark: SparkSession, source: str, column: str):
        self.spark, self.source, self.column = spark, source, check_column(column)
        self._clusters: int | None = None
        self._max_iters, self._seed = 20, 42
        self._options: dict[str, str] = {}
        self._given: np.ndarray | None = None

    def centroids(self, matrix: np.ndarray) -> IndexBuilder:
        """Given centroids instead of trained ones, a row each."""
        self._given = np.asarray(matrix, np.float64)
        return self

    def option(self, name: str, value: object) -> IndexBuilder:
        """A setting of the Parquet writer for the index's rows or postings, such as
        ``parquet.page.size``, ``parquet.block.size``, ``compression``, or one column's
        ``parquet.bloom.filter.enabled#title``."""
        self._options[name] = str(value)
        return self

    def n_clusters(self, n: int) -> IndexBuilder:
        self._clusters = n
        return self

    def max_iters(self, n: int) -> IndexBuilder:
        self._max_iters = n
        return self

    def seed(self, n: int) -> IndexBuilder:
        self._seed = n
        return self

    def _train(self) -> tuple[DataFrame, np.ndarray, int, int]:
        if self._max_iters < 1:
            raise ValueError("max_iters must be at least 1")
        if self._clusters is not None and self._clusters < 1:
            raise ValueError("n_clusters must be at least 1")
        rows = identified(self.spark, self.source)
        n, dim = check_vectors(rows, self.column)
        if self._given is not None:
            if self._given.ndim != 2 or self._given.shape[1] != dim or not len(self._given):
                raise ValueError(f"given centroids have not {dim} dimensions")
            return rows, self._given, n, dim
        clusters = self._clusters or default_clusters(n)
        if clusters > n:
            raise ValueError(f"{clusters} clusters for {n} vectors")
        size = min(n, max(sample_size(n, clusters), min(SAMPLE_FLOOR * clusters, SAMPLE_CAP)))
        sample = training_sample(rows, self.column, size, self._seed)
        return rows, train(sample, self.column, clusters, self._max_iters, self._seed), n, dim

    def _write(self, path: str, layout: str) -> IvfIndex:
        rows, centroids, n, dim = self._train()
        manifest = Manifest(self.column, dim, len(centroids), n, self._seed, layout, f"v-{uuid.uuid4().hex[:12]}")
        root = _root(self.spark, path)
        folder = f"{root}/{manifest.version}"
        assigned = assign(rows, self.column, centroids).withColumnRenamed("cluster_id", "_ivf_cluster")
        if layout == "postings":
            assigned = assigned.select("_ivf_cluster", "_ivf_file", "_ivf_row")
        # A cluster's rows come together in as many files as they need: the rebalance
        # splits large clusters, and no task writes to all folders.
        out = assigned.hint("rebalance", "_ivf_cluster").sortWithinPartitions("_ivf_cluster", "_ivf_file", "_ivf_row")
        out.write.options(**self._options).partitionBy("_ivf_cluster").parquet(f"{folder}/{layout}")
        sizes = self.spark.read.parquet(f"{folder}/{layout}").groupBy(F.col("_ivf_cluster").alias("cluster_id")).agg(F.count("*").alias("n_rows"))
        table = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster_id int, centroid array<double>")
        table.join(sizes, "cluster_id", "left").fillna(0, "n_rows").coalesce(1).write.parquet(f"{folder}/centroids")
        old = _manifest(self.spark, path)
        _write_text(self.spark, f"{root}/manifest.json", json.dumps(asdict(manifest)))
        if old is not None:
            at, fs = _fs(self.spark, f"{root}/{old.version}")
            fs.delete(at, True)
        return IvfIndex(self.spark, path, manifest)

    def build_new(self, output: str) -> IvfIndex:
        """Write rows and index to ``output``; the source stays as it is."""
        return self._write(output, "rows")

    def build_inplace(self) -> IvfIndex:
        """Write the index beside the source, whose files stay byte for byte."""
        return self._write(self.source, "postings")


def ensure_indexed(spark: SparkSession, source: str, output: str, column: str) -> IvfIndex:
    """The index at ``output``, built from ``source`` if there is none."""
    return read_index(spark, output) if has_vector_index(spark, output) else IndexBuilder(spark, source, column).build_new(output)


class TopkBuilder:
    """Direct search: ``TopkBuilder(spark, path, query).k(10).nprobe(8).search()``."""

    def __init__(self, spark: SparkSession, path: str, query: Sequence[float]):
        self.spark, self.path, self.query = spark, path, query
        self._k: int | None = None
        self._nprobe: int | None = None

    def k(self, k: int) -> TopkBuilder:
        if k < 1:
            raise ValueError("k must be at least 1")
        self._k = k
        return self

    def nprobe(self, nprobe: int) -> TopkBuilder:
        if nprobe < 1:
            raise ValueError("nprobe must be at least 1")
        self._nprobe = nprobe
        return self

    def search(self) -> DataFrame:
        """file, row_index and distance of the nearest rows, nearest first."""
        if self._k is None or self._nprobe is None:
            raise ValueError("k and nprobe must be set")
        index = read_index(self.spark, self.path)
        found = index.search(self.query, self._k, self._nprobe)
        return found.select(F.col("_ivf_file").alias("file"), F.col("_ivf_row").alias("row_index"), "distance")
