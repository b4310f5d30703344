"""From media files to inspections: what the readers find, put together as the rules want it.

One projection per file for the container and its streams, window functions over samples for gaps and rates, one
pre-aggregated reduction of cues, one kernel per sound file.  The parts are joined by path; of a file's parts only
bounded lists (streams, the first gaps, cues' ranges) are ever gathered.

Defined results: a file without a known container is unreadable (an empty one isn't listed by Spark's file source); a file that is cut off is corrupt, with what was found before;
a stream without samples has no rate and no gaps; no files give no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .. import schema
from ..operators import cues as cue
from ..operators import pictures, signals
from . import containers, files

#: Gaps of a file that are kept, and the narrowest one that is told between two that overlap.
MOST_GAPS = 1000
SILENT_DB, SHORTEST_SILENCE_MS = -60.0, 100
#: Subtitle codecs whose payloads are text.
TEXT_CODECS = ("tx3g", "text", "webvtt", "subrip", "ass", "ssa", "s_text/utf8", "s_text/webvtt", "s_text/ass", "s_text/ssa", "timed text", "mov_text")
INSPECTOR = "reelcheck"


def record(ddl: str, **values: Column) -> Column:
    """A struct of the given layout; fields without a value are null."""
    layout = _parse_datatype_string(ddl)
    assert isinstance(layout, StructType)
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in layout])


def streams(found: DataFrame) -> DataFrame:
    """asset_id, index, native_id, kind, ticks, signal, stream: one row per stream of a file, in the container's order."""
    own = found.where("kind IS NOT NULL")
    stream = record(schema.STREAM, **{n: F.col(n) for n in ("index", "kind", "codec", "codec_profile", "width", "height", "field_order", "bitrate", "duration", "language", "channel_layout", "channels", "sample_rate", "bit_depth")}, time_base=F.when(F.col("ticks") > 0, F.concat(F.lit("1/"), F.col("ticks"))), metadata=F.create_map(F.lit("native_id"), F.col("native_id").cast("string")))
    signal = F.struct("primaries", "transfer", "matrix", "range", "max_cll", "max_fall", "field_order")
    return own.select("asset_id", "index", "native_id", "kind", "codec", "ticks", signal.alias("signal"), stream.alias("stream"))


def probed(media: DataFrame) -> DataFrame:
    """One row per stream (or one without a kind) of every file, from the reader of its container."""
    others = containers.probe_streams(media.where("container IS NOT NULL AND container <> 'wav'"))
    common = ["container", "corrupt", "refused", "problems", "duration_ms", "index", *containers.STREAM]
    rows = others.select(F.col("path").alias("asset_id"), *common)
    wav = files.wav_headers(media.where("container = 'wav'"))
    values = {"container": F.lit("wav"), "corrupt": F.col("corrupt"), "problems": F.col("malformed"), "duration_ms": F.col("duration_ms"), "index": F.lit(0), "native_id": F.lit(0), "kind": F.when(F.col("codec").isNotNull(), "audio"), "codec": F.col("codec"), "ticks": F.col("sample_rate"), "channels": F.col("channels"), "sample_rate": F.col("sample_rate"), "bit_depth": F.col("bit_depth")}
    types = dict(rows.dtypes)
    sound = wav.select(F.col("path").alias("asset_id"), *[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in common], "bitrate")
    rows = rows.withColumn("bitrate", F.lit(None).cast("long")).unionByName(sound)
    layout = files.layout(F.col("channels"))
    return rows.withColumn("channel_layout", F.when(F.col("kind") == "audio", layout)).withColumn("duration", F.coalesce("duration", "duration_ms") / 1000)


def timing(media: DataFrame, every: DataFrame) -> DataFrame:
    """asset_id, index, gaps (in ms, the first ones), rate: from samples or packets of streams with a clock."""
    clocks = every.where("ticks > 0").select("asset_id", "native_id", "index", "ticks", "kind")
    samples = containers.probe_samples(media.where("container <> 'wav'")).join(clocks, ["asset_id", "native_id"])
    samples = samples.join(media.select(F.col("path").alias("asset_id"), "container"), "asset_id").select(F.struct("asset_id", "index").alias("asset_id"), "container", "kind", "ticks", "seq", "ts")
    turning = signals.unwrap(samples.where("container = 'mpeg-ts'").withColumnRenamed("ts", "raw"))  # 33-bit counters
    samples = samples.join(turning, ["asset_id", "seq"], "left").withColumn("ts", F.floor(F.coalesce("position", "ts") * 1000 / F.col("ticks")).cast("long"))
    found = None
    for container, kind in (("iso-bmff", "iso"), ("matroska", "mkv"), ("mpeg-ts", "ts")):
        own = samples.where((F.col("container") == container) & F.col("kind").isin("video", "audio"))
        part = signals.gaps(signals.deltas(own), kind, most=MOST_GAPS)
        found = part if found is None else found.unionByName(part)
    gaps = found.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("start_ms"), F.col("end").alias("end_ms")))).alias("gaps"))
    rates = signals.observed_rate(samples.where("kind = 'video'")).select("asset_id", F.concat((F.col("num")).cast("string"), F.lit("/"), F.col("den").cast("string")).alias("rate"))
    counted = samples.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(gaps, "asset_id", "left").join(rates, "asset_id", "left").select("asset_id.asset_id", "asset_id.index", "n", "gaps", "rate")


def subtitles(media: DataFrame, every: DataFrame) -> DataFrame:
    """asset_id, index, measurement of every subtitle stream."""
    own = every.where("kind = 'subtitle'").select("asset_id", "native_id", "index", F.lower("codec").isin(*TEXT_CODECS).alias("is_text"))
    cues = containers.probe_cues(media.where("container <> 'wav'")).join(own.select("asset_id", "native_id", "index", "is_text"), ["asset_id", "native_id"])
    ranges = cue.cue_ranges(cues.select(F.struct("asset_id", "index").alias("asset_id"), "is_text", "start_ms", "end_ms", "payload"))
    measured = ranges.select("asset_id.asset_id", "asset_id.index", *[c for c in ranges.columns if c != "asset_id"])
    rows = own.drop("native_id").join(measured, ["asset_id", "index"], "left").withColumns({"cue_count": F.coalesce("cue_count", F.lit(0))})
    values = {c: F.col(c) for c in ("cue_count", "max_gap_ms", "max_line_chars", "max_lines_per_cue", "max_cue_duration_ms", "covered_until_ms")}
    values |= {c: F.coalesce(F.col(c), F.array().cast(schema.RANGES)) for c in ("invalid_durations", "overlaps", "malformed", "empty_cues")}
    return rows.select("asset_id", "index", record(schema.SUBTITLE, stream_idx=F.col("index"), text_decoded=F.col("is_text"), **values).alias("m"))


def sound_measures(x: np.ndarray, rate: int) -> dict:
    """All levels of a sound (frames x channels): what the audio rules read."""
    mono = np.abs(x).max(1)
    quiet = mono <= 10 ** (SILENT_DB / 20)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], quiet, [False]]).astype(np.int8)))
    runs = [(int(a) * 1000 // rate, int(b) * 1000 // rate) for a, b in edges.reshape(-1, 2) if (b - a) * 1000 >= SHORTEST_SILENCE_MS * rate]
    peak = float(mono.max())
    out = {"peak_db": 20 * np.log10(peak) if peak > 0 else -300.0, "clipping_events": int((np.abs(x) >= 1 - 2.0**-15).sum()), "dc_offset_percent": float(np.abs(x.mean(0)).max() * 100), "true_peak_db": max(pictures.peak_between(c) for c in x.T), "loudness_lufs": pictures.loudness(x.T, rate), "phase_correlation": None}
    if x.shape[1] == 2:
        energy = float(np.sqrt((x[:, 0] ** 2).sum() * (x[:, 1] ** 2).sum()))
        out["phase_correlation"] = float(np.clip((x[:, 0] * x[:, 1]).sum() / energy, -1, 1)) if energy else None
    return out | {"frames": len(x), "starts": [a for a, _ in runs], "ends": [b for _, b in runs]}


def sound(media: DataFrame) -> DataFrame:
    """asset_id, index, measurement of WAV files: one file's samples at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                x, rate = files.samples_of(bytes(content))
                if len(x) and rate:
                    yield pd.DataFrame([{"asset_id": path} | sound_measures(x, rate)])

    names = "asset_id string, peak_db double, clipping_events long, dc_offset_percent double, true_peak_db double, loudness_lufs double, phase_correlation double, frames long, starts array<long>, ends array<long>"
    rows = media.where("container = 'wav'").select("path", "content").mapInPandas(run, names)
    silence = F.transform(F.arrays_zip("starts", "ends"), lambda z: F.struct(z["starts"].alias("start_ms"), z["ends"].alias("end_ms")))
    values = {c: F.col(c) for c in ("peak_db", "clipping_events", "dc_offset_percent", "true_peak_db", "loudness_lufs", "phase_correlation")}
    return rows.select("asset_id", F.lit(0).cast("long").alias("index"), record(schema.AUDIO, stream_idx=F.lit(0), decoded_frame_count=F.col("frames"), decode_errors=F.lit(0), silence=silence, silence_truncated=F.lit(False), **values).alias("m"))


def voices(spark: SparkSession, folder: str, media: DataFrame) -> DataFrame:
    """asset_id and the transcript measurement of files with sidecars."""
    texts = files.transcripts(spark, folder, media.select("path")).where("hypothesis IS NOT NULL").select(F.col("path").alias("asset_id"), F.coalesce("expected", F.lit("")).alias("expected"), "hypothesis")
    numbered = texts.withColumn("n", F.xxhash64("asset_id"))
    pairs = numbered.select(F.col("n").alias("asset_id"), "expected", "hypothesis")
    errors, strange = cue.word_errors(pairs), cue.unexpected_words(pairs)
    known = numbered.select("asset_id", F.col("n"), (F.length("expected") > 0).alias("known")).join(errors.withColumnRenamed("asset_id", "n"), "n").join(strange.withColumnRenamed("asset_id", "n"), "n")
    only = lambda c: F.when(F.col("known"), F.col(c))
    transcript = record(schema.TRANSCRIPT, source=F.lit("sidecar"), hypothesis_words=F.lit(None), **{c: only(c) for c in ("expected_words", "substitutions", "deletions", "insertions", "wer", "unexpected_words", "unexpected_total")})
    return known.select("asset_id", F.array(record(schema.VOICE, stream_idx=F.lit(0), method=F.lit("sidecar"), speech_analysed=F.lit(False), transcript=transcript)).alias("voice"))


def inspections(spark: SparkSession, folder: str) -> DataFrame:
    """asset_id (the path), asset, inspection of every media file below a folder."""
    scanned = files.scan(spark, folder).withColumn("container", files.container())
    every = probed(scanned)
    rows = streams(every)
    by_index = lambda x, y: (x["index"] - y["index"]).cast("int")
    of = lambda name, df: df.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("index", "m")), by_index).alias(name)).withColumn(name, F.transform(name, lambda z: z["m"]))
    times = timing(scanned, rows)
    videos = rows.where("kind = 'video'").join(times, ["asset_id", "index"], "left")
    hdr = record(schema.HDR, **{c: F.col(f"signal.{c}") for c in ("transfer", "primaries", "matrix", "range", "max_cll", "max_fall")})
    none = F.array().cast(schema.RANGES)
    videos = videos.select("asset_id", "index", record(schema.VIDEO, stream_idx=F.col("index"), frame_rate_observed=F.col("rate"), black_frames=none, freeze_frames=none, duplicate_frames=none, field_order=F.col("signal.field_order"), hdr=F.when(F.coalesce("signal.transfer", "signal.primaries", "signal.matrix").isNotNull(), hdr)).alias("m"))
    audios = rows.where("kind = 'audio'").select("asset_id", "index", record(schema.AUDIO, stream_idx=F.col("index")).alias("plain")).join(sound(scanned), ["asset_id", "index"], "left").select("asset_id", "index", F.coalesce("m", "plain").alias("m"))
    gaps = times.groupBy("asset_id").agg(F.flatten(F.collect_list("gaps")).alias("gaps"), F.bool_or(F.col("n") > 1).alias("timed"))
    rated = rows.join(times.select("asset_id", "index", "rate"), ["asset_id", "index"], "left").withColumn("m", F.col("stream").withField("frame_rate", F.when(F.col("kind") == "video", F.col("rate"))))
    one = every.groupBy("asset_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("corrupt", "refused", "duration_ms")], F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("problems", F.array().cast("array<string>")))))).alias("problems"))
    base = scanned.select(F.col("path").alias("asset_id"), "length", "modificationTime", "container", files.refused().alias("told"), files.fingerprint().alias("sha"))
    for part in (one, gaps, of("streams", rated), of("video", videos), of("audio", audios), of("subtitle", subtitles(scanned, rows)), voices(spark, folder, scanned)):
        base = base.join(part, "asset_id", "left")
    said = lambda kind, why: F.concat(F.lit(f'{kind}: "'), why, F.lit('"'))
    unreadable = F.when(F.col("length") == 0, "the file is empty").when(F.col("container").isNull(), F.concat(F.lit("not a container that can be read"), F.coalesce(F.concat(F.lit(": "), "told"), F.lit("")))).when(F.col("refused").isNotNull(), F.col("refused"))
    validity = F.when(unreadable.isNotNull(), said("unreadable", unreadable)).when(F.col("corrupt").isNotNull(), said("corrupt", F.col("corrupt"))).otherwise("ok")
    w = F.array_sort(F.array_distinct(F.coalesce("gaps", none)))
    held = F.slice(F.filter(w, lambda g: g["end_ms"] > g["start_ms"]), 1, MOST_GAPS)
    bitrate = F.when(F.col("duration_ms") > 0, F.floor(F.col("length") * 8000 / F.col("duration_ms")))
    container = record(schema.CONTAINER, validity=validity, format=F.col("container"), bitrate_bps=bitrate, duration=F.col("duration_ms"), timestamps_contiguous=F.when(F.col("timed"), F.size(held) == 0), timestamp_gaps=held, malformed_metadata=F.coalesce("problems", F.array().cast("array<string>")), decode_errors=F.lit(0))
    empty = lambda name, ddl: F.coalesce(F.col(name), F.array().cast(f"array<{ddl}>"))
    inspection = record(schema.INSPECTION, streams=empty("streams", schema.STREAM), container=container, video=empty("video", schema.VIDEO), audio=empty("audio", schema.AUDIO), subtitle=empty("subtitle", schema.SUBTITLE), voice=empty("voice", schema.VOICE), diagnostics=F.create_map(F.lit("inspector"), F.lit(INSPECTOR)))
    asset = record(schema.ASSET, id=F.col("asset_id"), path=F.col("asset_id"), fingerprint=F.struct(F.col("sha").alias("sha256"), F.col("length").alias("size_bytes")), size_bytes=F.col("length"), modified_time=F.unix_timestamp("modificationTime"), duration=F.col("duration_ms"), streams=empty("streams", schema.STREAM))
    return base.select("asset_id", asset.alias("asset"), inspection.alias("inspection"))


# executors get these functions by value and need no path to this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
