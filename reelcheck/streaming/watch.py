"""Streams: arriving measurement documents are checked batch by batch; runs of frames are tracked across batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.engine import check
from ..profiles.model import Profile
from ..schema import FIXTURE

ROUTES = {"pass": "pass", "warn": "warn", "inconclusive": "warn", "fail": "fail"}


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Measurement documents as they arrive in a folder; Spark's log of files takes each once, the oldest first."""
    rows = spark.readStream.schema(FIXTURE).option("multiLine", "true").option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").json(folder)
    return rows.select(F.col("asset.id").alias("asset_id"), "asset", "inspection")


def watch(stream: DataFrame, profile: Profile, out: str, checkpoint: str) -> DataStreamWriter:
    """Verdicts of each batch, appended under <out>/<route>/batch=<n>; a batch that runs again overwrites its own rows only."""

    def one(batch: DataFrame, n: int) -> None:
        verdicts = check(batch, profile).verdicts.withColumn("route", F.coalesce(*[F.when(F.col("verdict") == v, F.lit(r)) for v, r in ROUTES.items()]))
        verdicts.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "batch").parquet(out)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def track(threshold: float, close_after_ms: int | None):  # noqa: ANN201
    """State: start and end of the open run and the time of the last frame."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end = state.get if state.exists else (None, None)
        done = []
        if state.hasTimedOut:  # no frame for a while: the open run is closed
            if start is not None:
                done.append((start, end))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
            for ts, dur, mean in zip(rows["ts"], rows["dur"], rows["mean"], strict=True):
                if mean <= threshold:
                    start, end = (ts if start is None else start), max(ts + dur, end or 0)
                elif start is not None:
                    done.append((start, end))
                    start = end = None
            state.update((None if start is None else int(start), None if end is None else int(end)))
            if close_after_ms:
                state.setTimeoutDuration(close_after_ms)
        yield pd.DataFrame({"asset_id": [key[0]] * len(done), "start": [s for s, _ in done], "end": [e for _, e in done]}).astype({"asset_id": "int64", "start": "int64", "end": "int64"})

    return run


def open_runs(frames: DataFrame, threshold: float = 16.0, close_after_ms: int | None = None) -> DataFrame:
    """Frames of a stream (asset_id, seq, ts, dur, mean) -> closed runs at or below the threshold; constant state for each asset.

    ``close_after_ms``: a run is closed, too, when no frame of its asset has come for so long (of processing time)."""
    return frames.select("asset_id", "seq", "ts", "dur", "mean").groupBy("asset_id").applyInPandasWithState(track(threshold, close_after_ms), 'asset_id long, `start` long, `end` long', '`start` long, `end` long', "append", GroupStateTimeout.ProcessingTimeTimeout if close_after_ms else GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and means by type; rows later than the watermark are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of(assets: DataFrame, late: str = "1 day") -> DataFrame:
    """One row for each fingerprint within the watermark: an asset is its content, not its path."""
    return assets.withWatermark("at", late).dropDuplicatesWithinWatermark(["sha256"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
