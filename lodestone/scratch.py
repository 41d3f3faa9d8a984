"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Only where it is unset and all runs in this machine's one process, as in tests, a
    temporary folder is made and set; a cluster without a shared folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner cleans up
        pass


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    ``drop_all_but()`` deletes early; all others go when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
        """``df`` written and read again.  ``batch_bytes`` bounds what a Python function in it
        gets at once, else 10,000 rows or 64 MB; a larger row comes alone."""
        path, conf = new_path(self.spark), self.spark.conf
        before = conf.get(_BATCH_BYTES, None)
        try:
            if batch_bytes:
                conf.set(_BATCH_BYTES, batch_bytes)
            df.write.parquet(path)
        finally:
            if batch_bytes:
                conf.unset(_BATCH_BYTES) if before is None else conf.set(_BATCH_BYTES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop_all_but(self, *needed: DataFrame) -> None:
        """Delete the tables that no result reads any more."""
        for table, path in self.tables:
            if not any(table is x for x in needed):
                _delete(self.spark, path)
        self.tables = [x for x in self.tables if any(x[0] is y for y in needed)]
