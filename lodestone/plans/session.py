"""Plain SQL on indexed tables: ORDER BY array_distance(column, vector) LIMIT k.

A query of that shape over one registered table is answered from the candidates of its
index; any other runs as it is, exactly.  The recogniser reads Spark's analysed plan; then
the same text is planned again with the table's name standing for the candidates, so
Catalyst plans everything else.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.distance import register, squared_l2_to
from ..sources.index import IvfIndex, has_vector_index, read_index


@dataclass(frozen=True)
class VectorTopKOptions:
    """nprobe 0 or max_candidates 0 give no candidates, and so no rows."""

    nprobe: int = 5
    max_candidates: int | None = None


@dataclass(frozen=True)
class _Match:
    name: str
    column: str
    query: list[float]
    k: int


class VectorQuery:
    """A planned query: ``df`` to go on with, whether it uses an index, and metrics."""

    def __init__(self, df: DataFrame, match: _Match | None, options: VectorTopKOptions, candidates: Observation | None, fetched: DataFrame | None, files: DataFrame | None):
        self.df, self.match, self.options = df, match, options
        self._candidates, self._fetched, self._files = candidates, fetched, files

    @property
    def accelerated(self) -> bool:
        return self.match is not None

    def metrics(self) -> dict[str, int]:
        """candidate_rows, embeddings_fetched and files_scanned; runs the query if it has not run."""
        if self.match is None:
            return {}
        self.df.write.format("noop").mode("overwrite").save()
        return dict(self._candidates.get) | {"embeddings_fetched": self._fetched.count(), "files_scanned": self._files.count()}

    def explain(self) -> str:
        if self.match is None:
            return "exact"
        m, o = self.match, self.options
        cap = "" if o.max_candidates is None else f", max_candidates={o.max_candidates}"
        return f"VectorTopK: k={m.k}, column={m.column}, query_dim={len(m.query)}, nprobe={o.nprobe}{cap}\n  VectorIndexScan: table={m.name}\n  TableScan: table={m.name}"


def _children(node) -> list:
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _strip_casts(expression):
    while expression.nodeName() in ("Cast", "TryCast"):
        expression = _children(expression)[0]
    return expression


class VectorSession:
    """A session that knows indexed tables by name."""

    def __init__(self, spark: SparkSession, options: VectorTopKOptions | None = None, strict: bool = False):
        self.spark, self.options, self.strict = spark, options or VectorTopKOptions(), strict
        self.indexes: dict[str, IvfIndex | None] = {}
        self._tables: dict[str, DataFrame] = {}
        self._lock = threading.RLock()
        register(spark)

    def register(self, name: str, path: str) -> None:
        """Make a Parquet table known by name; it may have an index or not."""
        found = read_index(self.spark, path) if has_vector_index(self.spark, path) else None
        with self._lock:
            self._tables[name.lower()] = found.table if found else self.spark.read.parquet(path)
            self._tables[name.lower()].createOrReplaceTempView(name)
            self.indexes[name.lower()] = found

    def sql(self, text: str, args=None) -> DataFrame:
        return self.query(text, args).df

    def query(self, text: str, args=None) -> VectorQuery:
        with self._lock:  # no other thread's rows stand under a table's name meanwhile
            plain = self.spark.sql(text, args) if args else self.spark.sql(text)
            match = self._match(plain)
        if match is None:
            return VectorQuery(plain, None, self.options, None, None, None)
        index = self.indexes[match.name]
        fits = squared_l2_to(F.col(match.column), match.query).isNotNull()
        if index is None:
            if self.strict:
                raise ValueError(f"table {match.name} has no vector index")
            # Vectors that don't fit have no distance and no place, here as with an index.
            exact = self._over(text, args, match.name, self._tables[match.name].where(fits))
            return VectorQuery(exact, None, self.options, None, None, None)
        index.check_query(match.query, match.column)
        found = index.candidates(match.query, self.options.nprobe, self.options.max_candidates)
        if self.options.nprobe < 1 or self.options.max_candidates == 0:
            found = found.limit(0)
        files = found.select("_ivf_file").distinct()
        candidates = Observation()
        found = found.observe(candidates, F.count(F.lit(1)).alias("candidate_rows")).select(*index.table.columns)
        df = self._over(text, args, match.name, found.where(fits))
        return VectorQuery(df, match, self.options, candidates, self._ranked(df), files)

    def _over(self, text: str, args, name: str, rows: DataFrame) -> DataFrame:
        """The query planned with ``rows`` standing under a table's name."""
        with self._lock:
            rows.createOrReplaceTempView(name)
            try:
                return self.spark.sql(text, args) if args else self.spark.sql(text)
            finally:
                self._tables[name].createOrReplaceTempView(name)

    def _ranked(self, df: DataFrame) -> DataFrame:
        """The rows that a query's sort ranks: candidates after its filters."""
        node = df._jdf.queryExecution().analyzed()
        while node.nodeName() != "Sort":
            node = _children(node)[0]
        rows = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, _children(node)[0])
        return DataFrame(rows, self.spark)

    def _match(self, df: DataFrame) -> _Match | None:
        plan = df._jdf.queryExecution().analyzed()
        if plan.collectLeaves().size() != 1:
            return None
        node, k = plan, None
        while node.nodeName() == "Project" and k is None:
            node = _children(node)[0]
        if node.nodeName() != "GlobalLimit" or not node.limitExpr().foldable():
            return None
        k = int(node.limitExpr().eval(None))
        node = _children(node)[0]
        if node.nodeName() == "LocalLimit":
            node = _children(node)[0]
        while node.nodeName() == "Project":
            node = _children(node)[0]
        if node.nodeName() != "Sort" or node.order().size() != 1:
            return None
        order = node.order().apply(0)
        if order.direction().sql() != "ASC":
            return None
        distance = _strip_casts(order.child())
        if distance.nodeName() != "PythonUDF" or distance.name() != "array_distance":
            return None
        a, b = map(_strip_casts, _children(distance))
        if a.foldable() == b.foldable():
            return None
        column, literal = (b, a) if a.foldable() else (a, b)
        if column.nodeName() != "AttributeReference":
            return None
        name = self._table(_children(node)[0])
        leaf = plan.collectLeaves().apply(0)
        if name is None or not leaf.outputSet().contains(column):
            return None
        query = self.spark.range(1).select(F.expr(literal.sql()).cast("array<double>")).first()[0]
        if not query or any(x is None for x in query):
            return None
        return _Match(name, column.name(), query, k)

    def _table(self, node) -> str | None:
        """The registered table under filters and projections; None if there is anything else."""
        name = None
        while True:
            kind = node.nodeName()
            if kind == "SubqueryAlias" and node.alias().lower() in self.indexes and name is None:
                name = node.alias().lower()
            elif kind not in ("SubqueryAlias", "Project", "Filter", "View"):
                return name if not _children(node) else None
            elif kind == "SubqueryAlias" and name is None and node.alias().lower() not in self.indexes:
                pass
            node = _children(node)[0]


def enable_vector_search(spark: SparkSession, options: VectorTopKOptions | None = None, strict: bool = False) -> VectorSession:
    return VectorSession(spark, options, strict)
