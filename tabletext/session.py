"""Session builder and small helpers shared by the record operators."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tabletext", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and a UTC clock; ``conf`` overrides (dots as double underscores)."""
    n = str(cores or os.environ.get("BENCH_CPUS") or "*")
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # whole texts are long rows, and every task holds a batch or two
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); a local one only if the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"{tempfile.gettempdir()}/tabletext-files"
    return f"{path}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: what is expensive or not repeatable is done once, and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_sheets(rows: DataFrame, sheets: DataFrame, flag: str, plain: Callable[[DataFrame], DataFrame], ordered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of sheets without a flag by ``plain``, those of the others by ``ordered``, which may need windows over whole sheets.

    ``sheets`` is a stored table of one row a (file, sheet), whose columns join the rows; a step for which there is no sheet is left out.
    """
    ways = [(sheets.where(f"NOT {flag}"), plain), (sheets.where(flag), ordered)]
    taken = [(some, step) for some, step in ways if not some.isEmpty()] or ways[:1]
    return functools.reduce(DataFrame.unionByName, [step(rows.join(some, ["file", "sheet"])) for some, step in taken])


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults (10,000 rows, 64 MB).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits from their defaults: whole texts are long rows, and every task holds a batch or two."""
    prefix = "spark.sql.execution.arrow."
    if spark.conf.get(f"{prefix}maxRecordsPerBatch") == "10000":
        spark.conf.set(f"{prefix}maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set(f"{prefix}maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
