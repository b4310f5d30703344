"""Streaming operators run to the end of their input, with what a batch over the same rows gives in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import watch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="reelcheck-")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{base.rstrip('/')}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(watch.event_counts(events(spark, sf_dir)), "complete").select(F.expr("unix_seconds(start)").alias("start_s"), "event_type", "n")


def stream_black_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = events(spark, sf_dir).select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000").alias("ts"), F.lit(40).cast("long").alias("dur"), F.col("value").alias("mean"))
    return drained(watch.open_runs(frames, 20.0), "append")


QUERIES = {"stream_event_counts": stream_event_counts, "stream_black_runs": stream_black_runs}
#: Runs that are still open at the end of the input are not given.
ORACLES = {
    "stream_event_counts": "SELECT (epoch_us(ts) // 3600000000) * 3600 AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_black_runs": """WITH f AS (SELECT user_id AS asset_id, event_id AS seq, epoch_us(ts) // 1000 AS ts, value <= 20 AS holds FROM events), i AS (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id) AS last FROM f)
      SELECT asset_id, min(ts)::BIGINT AS "start", (max(ts) + 40)::BIGINT AS "end" FROM i WHERE holds AND island < last GROUP BY asset_id, island""",
}
