"""A drop folder as a stream: each new file is imported once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


LEDGER = "sha256 string, path string, batch long"


def taken(spark: SparkSession, ledger: str) -> DataFrame:
    """(sha256, path, batch) of all contents that were handed over."""
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], LEDGER)


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], pattern: str = "*", ledger: str | None = None) -> StreamingQuery:
    """Start a query that hands new contents (path, sha256, length, content) to ``handle`` and ends when none is left.

    The checkpoint names the files that were seen, the ``ledger`` (a table beside it) the contents that were handed over, so a
    content under a second name is left out in every later batch too, also after a restart; of equal contents in one batch the
    smallest path counts. A batch that is broken off is handed over again, with its number, as its own rows do not count.
    """
    held = ledger or f"{checkpoint.rstrip('/')}-contents"
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(folder)
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"), "length", "content")

    def take(df: DataFrame, n: int) -> None:
        known = taken(spark, held).where(F.col("batch") != n).select("sha256").distinct()
        chosen = df.select("sha256", "path").join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path"))
        chosen = chosen.withColumn("batch", F.lit(n).cast("long")).persist()
        handle(df.join(chosen.select("path"), "path"), n)
        if not taken(spark, held).where(F.col("batch") == n).limit(1).count():
            chosen.write.mode("append").parquet(held)
        chosen.unpersist()

    return hashed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
