"""What the operators share: input columns, words, blocks of documents."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The characters that separate words, as a Java and RE2 character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
POINTS = 16  # that find the ends of a block


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() alone would change other letters too."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_blocks(docs: DataFrame, block_bytes: int | Callable[[int], int]) -> tuple[DataFrame, int, int]:
    """``docs`` with an int column ``_block``, the number of blocks of ids, and of all blocks.

    Blocks are ranges of doc_id of about ``block_bytes`` of text each (a function gets all
    bytes): ids in a smaller block are smaller, and equal ids share a block.  Rows with a
    null id are dealt over the last blocks by their texts.
    """
    size, null = F.coalesce(F.octet_length("text"), F.lit(0)), F.col("doc_id").isNull()
    sums = docs.agg(F.sum(size).alias("all"), F.sum(F.when(null, size)).alias("null"), F.count_if(null).alias("nulls")).first()
    total, unnamed = sums["all"] or 0, sums["null"] or 0
    block_bytes = block_bytes if isinstance(block_bytes, int) else block_bytes(total)
    n, spare = max(1, math.ceil((total - unnamed) / block_bytes)), math.ceil((unnamed + 1) / block_bytes) if sums["nulls"] else 0
    cuts: list[float] = []
    if n > 1:
        # Quantiles of bytes, not rows: an id stands for each POINTS-th of a block that its text fills.
        share = size * F.lit(POINTS / block_bytes)
        chance = F.pmod(F.xxhash64("doc_id", size), F.lit(1 << 20)) / F.lit(float(1 << 20))
        points = docs.where(~null).select("doc_id", F.floor(share + chance).cast("int").alias("times")).where("times > 0")
        points = points.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("times"))))
        cuts = points.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    cuts = np.unique(np.array(cuts, np.float64))

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.float64, na_value=np.inf)).astype(np.int32))

    place = block(F.col("doc_id"))
    if spare:
        place = F.when(null, F.lit(n) + F.pmod(F.xxhash64("text"), F.lit(spare)).cast("int")).otherwise(place)
    return docs.withColumn("_block", place), n, n + spare


def texts_by_bytes(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the texts of their rows (null: empty), of ``most`` bytes each
    or of one row that has more."""
    texts = [t or b"" for t in batch.column("text").to_pylist()]
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > most:
            yield batch.slice(low, i - low), texts[low:i]
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield batch.slice(low), texts[low:]


def give_back() -> None:
    """Free memory of this process that allocators hold for later goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Clear what an operator remembers in a worker from one task to the next.
remembered: list[Callable[[], None]] = []


def forget() -> None:
    """What any operator remembers in this worker goes."""
    for clear in remembered:
        clear()


def lean(rows: Callable[..., Iterator], remembers: bool = False) -> Callable[..., Iterator]:
    """The generator function, giving memory back when a task's rows end: Spark's workers
    outlive their tasks, and what they hold is missing in the stages that follow.  The last
    batch is freed only after that, so the next task gives it back before it begins.  What
    a function that ``remembers`` kept for its next task goes when a task of any other begins."""

    @wraps(rows)
    def run(*args) -> Iterator:
        if not remembers:
            forget()
        give_back()
        try:
            yield from rows(*args)
        finally:
            give_back()

    return run


__all__ = ["SPACE", "WORD", "Scratch", "ascii_lower", "forget", "give_back", "id_blocks", "lean", "n_words", "read", "remembered", "texts_by_bytes"]
