"""Line deduplication: count documents for each hashed line, drop what too many share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, ascii_lower

COMMONEST = 10_000  # keys that are broadcast; any other stands in at most lines / COMMONEST lines
_BLANKS = "\x20\t\n\x0b\x0c\r"


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines whose key stands in at least ``min_docs`` documents, but for the largest
    doc_id that holds it.

    A key is the line stripped of ASCII blanks, with A-Z lower-cased; keys under
    ``min_chars`` code points always stay.  All columns of ``docs`` come back, text without
    the dropped lines, with n_lines (before) and n_dropped; columns of these names are
    replaced.  A null text is one empty line and stays null.  Rows of one id are one
    document; a null id counts as no document, and its shared lines all go.  A key is
    compared by 128 bits of hash.

    The COMMONEST keys go to the lines by broadcast, a fixed number of small rows; only the
    lines of others meet their keys in a shuffle, where none holds more than a fixed share
    of all lines, so a line that a third of all documents share crowds no task.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = docs.withColumn("__ld_row", F.xxhash64("text"))
    found = (
        docs.select("doc_id", "__ld_row", F.posexplode(lines).alias("at", "line"))
        .where(F.char_length("line") >= min_chars)
        .withColumn("line", F.trim("line", F.lit(_BLANKS)))
        .where(F.char_length("line") >= min_chars)
        .withColumn("line", ascii_lower(F.col("line")))
        .select("doc_id", "__ld_row", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    shared = found.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs)
    shared = Scratch(docs.sparkSession).keep(shared)
    common = shared.orderBy(F.desc("n"), "h1", "h2").limit(COMMONEST).select("h1", "h2", F.col("holder").alias("common_holder"))
    looked_up = found.join(F.broadcast(common), ["h1", "h2"], "left")
    by_broadcast = looked_up.where("common_holder IS NOT NULL").withColumnRenamed("common_holder", "holder")
    by_shuffle = looked_up.where("common_holder IS NULL").drop("common_holder").join(shared.select("h1", "h2", "holder"), ["h1", "h2"])
    dropped = (
        by_broadcast.unionByName(by_shuffle)
        .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("holder")))
        .groupBy(F.col("doc_id").alias("__ld_id"), F.col("__ld_row").alias("__ld_hash"))
        .agg(F.sort_array(F.collect_set("at")).alias("__ld_at"))
    )
    joined = docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("__ld_id")) & (F.col("__ld_row") == F.col("__ld_hash")), "left")

    def rest(bound):
        """The lines between dropped places, by slices: linear in the lines of a text."""
        lines, at = bound["lines"], bound["at"]
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.slice(lines, F.get(at, i - 1) + 2, F.get(at, i) - F.get(at, i - 1) - 1))), "\n")

    bound = F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), F.col("__ld_at"), F.array(F.size(lines))).alias("at"))
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size("__ld_at"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__ld_at").isNull(), F.col("text")).otherwise(F.transform(F.array(bound), rest)[0]),
        }
    ).drop("__ld_row", "__ld_id", "__ld_hash", "__ld_at")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS key FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))
), shared AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND l.doc_id < s.holder AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
