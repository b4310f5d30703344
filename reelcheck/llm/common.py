"""Shared helpers: the cluster's shared folder, cut lineage, table reading, shipping of kernels."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests), a temporary folder is used."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="reelcheck-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet (with options of its writer) into the shared folder and reads it again.

    It cuts the lineage, so nothing before it runs twice, and the rows outlive any executor.
    The folder is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def sent(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The side of a join that goes to all executors if it has at most so many rows; else Spark shuffles both sides.

    For narrow, kept tables (their rows are counted first)."""
    return F.broadcast(df) if df.count() <= rows else df


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    try:
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone at exit; the folder is the cluster's scratch space
        return


def fresh(name: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_rest(col: str | Column, by: int) -> Column:
    """crc32 of a number's decimal text, modulo ``by``; null where the number is null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(by)).cast("int")


#: Rows and bytes of an Arrow batch: texts can be long, so batches are smaller than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
BATCH_KEY, BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(*names: str) -> None:
    """Sends the named modules' functions to the executors by value, so that they need no path, and keeps Arrow batches small."""
    spark = SparkSession.getActiveSession()
    if spark is not None and int(spark.conf.get(BATCH_KEY, "10000")) in (0, 10_000):  # not set by the user
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))
    for name in names:
        cloudpickle.register_pickle_by_value(sys.modules[name])
