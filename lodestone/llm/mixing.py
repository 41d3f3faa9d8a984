"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the key -ln(u) / quality; a source takes its documents in the order
of their keys until their sizes reach its budget of words.  A source's budget is whole
epochs first; only the rest is selected by key.

Nothing sorts a whole source.  As in a radix selection, sizes are summed by the digits of
exp(-key), and only the digit in which a source's budget runs out is looked at again, so
a source with a third of all rows costs what the others cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, n_words

DIGITS = 256
LEVELS = 2
_NO_LETTERS = r"[^\p{L}]+"


def share_of_letters() -> Column:
    """0.25 + the share of letters, of any script, in the text: a weight to begin with."""
    letters = F.char_length(F.regexp_replace("text", _NO_LETTERS, "")) / F.char_length("text")
    return F.lit(0.25) + F.when(F.char_length("text") > 0, letters).otherwise(F.lit(0.0))


def size_and_quality(docs: DataFrame, quality: Column | str | None = None) -> DataFrame:
    """``docs`` with size (words of the text) and quality: the weight given, a column of
    ``docs`` or an expression over it, or share_of_letters().  A weight that is null or not
    above 0 counts as one in a million."""
    weight = share_of_letters() if quality is None else F.col(quality) if isinstance(quality, str) else quality
    least = F.lit(1e-6)
    return docs.withColumns({"size": n_words(F.col("text")), "quality": F.greatest(F.coalesce(weight.cast("double"), least), least)})


def _keys(docs: DataFrame) -> DataFrame:
    """The key of each row, from its id, so that reruns and other layouts agree."""
    name = F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    docs = docs.withColumn("__mix_key", -F.log(u) / F.col("quality"))
    return docs.withColumn("__mix_t", F.exp(-F.col("__mix_key")))


def _order() -> Column:
    return F.struct(F.col("__mix_key").alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """source, source_size, target for a row a source.

    Sources in the order of their names, null last, have ``weights`` over and over.  A
    target is min(max_epochs * source_size, level * weight) with the level at which
    targets sum up to all sizes: what resharing the excess again and again ends at.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("full_at", F.lit(float(max_epochs)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumns(
        {
            "capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(max_epochs)),
            "used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all_sizes": F.sum("source_size").over(everything),
            "all_weights": F.sum("weight").over(everything),
        }
    )
    level = (F.col("all_sizes") - F.col("capped")) / (F.col("all_weights") - F.col("used"))
    reached = F.min(F.when(level <= F.col("full_at"), F.struct("full_at", level.alias("level")))).over(everything)
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    return weighed.select("source", "source_size", F.coalesce(F.least(cap, reached["level"] * F.col("weight")), cap).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """A row a source: source, source_size, target, epochs, and of the documents taken once
    more the last one in order (cut) and how many rows equal to it are taken (cut_rows).

    ``docs`` has doc_id, source, size and quality.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    docs = _keys(docs)
    sizes = docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = scratch.keep(targets(sizes, weights, max_epochs).withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    left, rows = plan.select(F.col("source").alias("at_source"), "rest"), docs
    for level in range(1, LEVELS + 1):
        digit = F.floor(F.col("__mix_t") * float(DIGITS**level))
        rows = rows.join(left, F.col("source").eqNullSafe(F.col("at_source"))).drop("at_source").withColumn("__mix_digit", digit)
        summed = rows.groupBy("source", "rest", "__mix_digit").agg(F.sum("size").alias("words"))
        through = F.sum("words").over(Window.partitionBy("source").orderBy(F.col("__mix_digit").desc()))
        split = summed.withColumn("before", through - F.col("words")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
        left = scratch.keep(split.select(F.col("source").alias("at_source"), (F.col("rest") - F.col("before")).alias("rest"), F.col("__mix_digit").alias("at_digit")))
        rows = rows.drop("rest").join(left.select(F.col("at_source").alias("s"), "at_digit"), F.col("source").eqNullSafe(F.col("s")) & (F.col("__mix_digit") == F.col("at_digit"))).drop("s", "at_digit", "__mix_digit")
        left = left.drop("at_digit")

    # The one digit of each source that is split: its documents in order.
    rows = rows.join(left, F.col("source").eqNullSafe(F.col("at_source")))
    rows = rows.withColumn("before", F.sum("size").over(Window.partitionBy("source").orderBy("__mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # The document at the edge is in if that brings the source nearer to its target.
    inside = rows.where(F.col("rest") - F.col("before") >= F.col("size") / 2).select("source", _order().alias("o"))
    cut = inside.groupBy("source", "o").agg(F.count("*").alias("n")).groupBy(F.col("source").alias("cut_source")).agg(F.max(F.struct("o", "n")).alias("c"))
    # No document of the split digit may fit: then the cut lies before all of it.
    least = rows.groupBy(F.col("source").alias("least_source")).agg(F.min(_order()).alias("least"))
    plan = (
        plan.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .join(least, F.col("source").eqNullSafe(F.col("least_source")), "left")
    )
    return scratch.keep(
        plan.select(
            "source", "source_size", "target", "epochs",
            F.coalesce(F.col("c.o"), F.col("least")).alias("cut"),
            F.when(F.col("c").isNull(), F.lit(0)).otherwise(F.col("c.n")).alias("cut_rows"),
        )
    )


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with source_size, target, copies (times taken) and taken (words taken)."""
    clash = [c for c in ("source_size", "target", "copies", "taken") if c in docs.columns]
    per = plan.withColumnRenamed("source", "__mix_source")
    rows = _keys(docs.drop(*clash)).join(per, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("__mix_order", _order())
    at_cut = F.coalesce(F.col("__mix_order") == F.col("cut"), F.lit(False))
    sure = rows.where(~at_cut).withColumn("copies", F.col("epochs") + F.coalesce((F.col("__mix_order") < F.col("cut")).cast("long"), F.lit(0)))
    turn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    tied = rows.where(at_cut).withColumn("copies", F.col("epochs") + (turn <= F.col("cut_rows")).cast("long"))
    both = sure.unionByName(tied).withColumn("taken", F.col("copies") * F.col("size"))
    return both.drop("__mix_key", "__mix_t", "__mix_source", "__mix_order", "epochs", "cut", "cut_rows")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, quality: Column | str | None = None) -> DataFrame:
    """Mix the sources of ``docs`` to ``weights``; the budget is the size of all of it.

    ``quality`` weighs documents against each other within a source; see size_and_quality.
    Returns all rows and columns with size, quality, source_size, target, copies and taken
    (columns of these names are replaced).  A null or empty text has no size and is
    taken as its key falls; a null source is a source, the last; rows with the same id and
    size tie, and as many of them are taken as the budget holds.
    """
    docs = size_and_quality(docs, quality)
    plan = plan_mix(Scratch(docs.sparkSession).keep(docs.select("doc_id", "source", "size", "quality")), weights, max_epochs)
    return apply_mix(docs, plan)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         0.25::DOUBLE + CASE WHEN length(text) > 0
           THEN length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / length(text) ELSE 0 END AS quality
  FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE)
                / 4503599627370496.0::DOUBLE) / quality AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS full_at,
         3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS used,
         sum(source_size) OVER () AS all_sizes, sum(weight) OVER () AS all_weights
  FROM w WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT min(level) AS level FROM (
    SELECT (all_sizes - capped) / (all_weights - used) AS level, full_at FROM f
    WHERE (all_sizes - capped) / (all_weights - used) <= full_at ORDER BY full_at LIMIT 1)
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM l) * weight) AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN before < rest AND rest - before >= size / 2.0::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""
