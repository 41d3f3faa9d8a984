"""Which columns are vectors, and whether a column can be indexed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_column(name: str) -> str:
    if not name or not name.strip():
        raise ValueError("embedding column name must not be blank")
    return name


def is_vector(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))


def vector_column(df: DataFrame) -> str:
    """The first column of float lists."""
    for field in df.schema.fields:
        if is_vector(field.dataType):
            return field.name
    raise ValueError("no vector column found")


def vector_dim(df: DataFrame, column: str) -> int:
    """The length of the first vector that is not null."""
    row = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    if row is None:
        raise ValueError(f"cannot infer the dimension of {column}: no rows with a vector")
    return row[0]


def vector_report(df: DataFrame, column: str) -> DataFrame:
    """One row: n_rows, n_null, n_null_elements (rows that hold some), min_dim, max_dim."""
    v = F.col(column)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(F.exists(v, lambda x: x.isNull())).alias("n_null_elements"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
    )


def check_vectors(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, dimension) of a column that can be indexed; ValueError says what is wrong."""
    check_column(column)
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise ValueError(f"column {column} is not a list")
    if not is_vector(kind):
        raise ValueError(f"column {column} does not hold floats")
    r = vector_report(df, column).first()
    if r["n_rows"] == 0:
        raise ValueError("no rows to index")
    if r["n_null"]:
        raise ValueError(f"column {column} has null rows")
    if r["n_null_elements"]:
        raise ValueError(f"column {column} has null values")
    if r["min_dim"] == 0:
        raise ValueError(f"column {column} has empty vectors")
    if r["min_dim"] != r["max_dim"]:
        raise ValueError(f"column {column} has vectors of different lengths")
    return r["n_rows"], r["max_dim"]
