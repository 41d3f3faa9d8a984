"""Tables of vectors: rows with their place in a file, single vectors, made-up data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().getRawPath().rstrip("/")


def identified(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with _ivf_file and _ivf_row (0-based, in the file).

    A file is named by its path below the table's, as files of several folders may share a
    name; a table that is one file, by its file name.
    """
    df, root = spark.read.parquet(path), _qualified(spark, path)
    at = F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    below = F.substring(at, F.lit(len(root) + 2), F.length(at))
    name = F.when(F.startswith(at, F.lit(f"{root}/")), below).otherwise(F.col("_metadata.file_name"))
    return df.select("*", name.alias("_ivf_file"), F.col("_metadata.row_index").alias("_ivf_row"))


def embedding_at(df: DataFrame, column: str, key: str, value) -> list[float]:
    """The vector of the row with this key."""
    row = df.where(F.col(key) == F.lit(value)).select(F.col(column).cast("array<double>")).first()
    if row is None or row[0] is None:
        raise ValueError(f"no vector where {key} is {value}")
    return list(row[0])


def generate(spark: SparkSession, rows: int, dim: int, seed: int = 1234) -> DataFrame:
    """id int and embedding array<float>, uniform in [0, 1), for benches."""
    xs = [((F.xxhash64(F.col("id"), F.lit(i), F.lit(seed)).bitwiseAND(F.lit((1 << 24) - 1))) / float(1 << 24)).cast("float") for i in range(dim)]
    return spark.range(rows).select(F.col("id").cast("int").alias("id"), F.array(*xs).alias("embedding"))
