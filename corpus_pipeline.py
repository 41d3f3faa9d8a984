"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from lodestone.llm._common import Scratch, read


def _carry(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and all others out of its way in one, so that it
    replaces none of them whatever they are called."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*rest, F.lit(0).alias("__none")).alias("__rest"))


def _all(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _unpack(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    return df.select(*(F.col(c) if c in needed else F.col(f"__rest.`{c}`").alias(c) for c in columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject, with all their columns.

    A null text scores as the empty one, equal texts alike, so repeated rows stay or go
    together; a null id is scored like any other.  An empty table stays empty.
    """
    scored = toxicity.toxicity(_carry(docs, "doc_id", "text"), read(spark, sf_dir, "labels"))
    return _unpack(scored.where("predicted = 0"), docs.columns, "doc_id", "text")


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that too many share; n_chars follows the text.

    No row goes, even if no line is left of it.  A null text stays null and has a null
    n_chars.  Rows of one id are one document; a null id counts as none and loses all its
    shared lines.
    """
    kept = _unpack(line_dedup.dedup_lines(_carry(docs, "doc_id", "text")), docs.columns, "doc_id", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*_all(docs)) if "n_chars" in docs.columns else kept


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 or more.

    The least id of a group stays.  Rows that share id and text are one document, and all
    of them stay or go; those that share the id alone are not.  Null and empty texts and
    null ids are in no group and stay.
    """
    told = docs.withColumn("__text", F.md5(F.col("text").cast("binary")))
    gone = minhash_dedup.near_duplicates(told.select("doc_id", "text", "__text"), tag="__text").where("NOT kept")
    gone = Scratch(spark).keep(gone.select("doc_id", F.col("tag").alias("__text")).distinct())
    return told.join(gone, ["doc_id", "__text"], "left_anti").select(*_all(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document is taken.

    A null source is a source, the last.  Empty and null texts have no words and are taken
    as their keys fall.  Rows with one id and size tie, and as many are taken as the budget
    holds.
    """
    taken = mixing.mix(_carry(docs, "doc_id", "source", "text")).where("copies > 0")
    return _unpack(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs.columns, "doc_id", "source", "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; every row is packed, a null or empty
    text as its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("minhash_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The toxicity classifier and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    scratch, docs = Scratch(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
