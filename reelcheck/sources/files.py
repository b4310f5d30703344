"""Media files as DataFrames: directory scans, content sniffing, fingerprints, WAV headers and samples, sidecar transcripts, measurement documents."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bits_per_second
from ..schema import FIXTURE

#: Extensions that a directory scan takes, and what a file's first bytes say.
EXTENSIONS = ("mp4", "mov", "m4v", "mkv", "webm", "ts", "m2ts", "wav", "aif", "aiff", "aifc", "flac", "ogg", "oga", "opus")
LAYOUTS = {1: "mono", 2: "stereo", 6: "5.1", 8: "7.1"}
PREFIX = 16 << 20
WAV_SCHEMA = "codec string, channels int, sample_rate long, bit_depth int, data_bytes long, frames long, duration_ms long, malformed array<string>, corrupt string"
MOST_TRANSCRIPT = 8 << 20


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of media files below a folder; contents are read only where they are used."""
    glob = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def container(content: str = "content") -> Column:
    """The container by content, never by name; null if unknown."""
    c = F.col(content)
    at = lambda i, n: F.hex(F.substring(c, i, n))
    word = lambda s: s.encode().hex().upper()
    box = at(5, 4).isin(*[word(k) for k in ("ftyp", "moov", "mdat", "wide", "free", "skip", "styp")])
    size = F.conv(at(1, 4), 16, 10).cast("long")
    long_enough = F.octet_length(c) >= 12
    return (
        F.when(long_enough & (at(1, 4) == word("RIFF")) & (at(9, 4) == word("WAVE")), "wav")
        .when(long_enough & (at(1, 4) == word("FORM")) & at(9, 4).isin(word("AIFF"), word("AIFC")), "aiff")
        .when(at(1, 4) == word("fLaC"), "flac")
        .when(at(1, 4) == word("OggS"), "ogg")
        .when(at(1, 4) == "1A45DFA3", "matroska")
        .when(long_enough & box & ((size >= 8) | size.isin(0, 1)), "iso-bmff")
        .when((F.octet_length(c) > 188 * 3) & (at(1, 1) == "47") & (at(189, 1) == "47") & (at(377, 1) == "47"), "mpeg-ts")
    )


def refused(content: str = "content") -> Column:
    """A name for what can be told but not read."""
    head = F.hex(F.substring(F.col(content), 1, 4))
    return F.when(head == "060E2B34", "mxf").when(head == b"RIFF".hex().upper(), "avi").when(F.substring(head, 1, 6) == b"ID3".hex().upper(), "mp3").when(F.substring(head, 1, 6) == b"FLV".hex().upper(), "flv").when(F.substring(head, 1, 3) == "FFF", "adts or mp3")


def fingerprint(content: str = "content", length: str = "length", whole: bool = True) -> Column:
    """SHA-256 of the content; or of its first 16 MiB and the size as eight little-endian bytes."""
    if whole:
        return F.sha2(F.col(content), 256)
    size = F.unhex(F.lpad(F.hex(F.col(length)), 16, "0"))
    little = F.concat(*[F.substring(size, i, 1) for i in range(8, 0, -1)])
    return F.sha2(F.concat(F.substring(F.col(content), 1, PREFIX), little), 256)


def layout(channels: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in LAYOUTS.items():
        out = F.when(channels == n, name).otherwise(out)
    return out


def pcm_name(is_float: bool, bits: int) -> str:
    return f"pcm_f{bits}le" if is_float else "pcm_u8" if bits == 8 else f"pcm_s{bits}le"


def wav_header(data: bytes) -> dict:
    """The stream of a WAV file; what is cut off is described as far as it goes."""
    out: dict = {"codec": None, "channels": None, "sample_rate": None, "bit_depth": None, "data_bytes": None, "frames": None, "duration_ms": None, "malformed": [], "corrupt": None, "offset": None}
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return out | {"corrupt": "no RIFF WAVE header"}
    at, block = 12, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = at + 8
        if name == b"fmt " and body + 16 <= len(data):
            tag, channels, rate, _, block, bits = struct.unpack("<HHIIHH", data[body : body + 16])
            if tag == 0xFFFE and body + 26 <= len(data):
                tag = struct.unpack("<H", data[body + 24 : body + 26])[0]
            if tag not in (1, 3):
                return out | {"corrupt": f"format {tag} is not PCM"}
            out |= {"codec": pcm_name(tag == 3, bits), "channels": channels, "sample_rate": rate, "bit_depth": bits}
        elif name == b"data":
            rest = len(data) - body
            n = rest if size in (0, 0xFFFFFFFF) else min(size, rest)
            if size not in (0, 0xFFFFFFFF) and size > rest:
                out["corrupt"] = f"{size} bytes of samples declared, {rest} there"
            out |= {"data_bytes": n, "offset": body}
            break
        at = body + size + (size & 1)
    if out["codec"] is None or out["data_bytes"] is None:
        return out | {"corrupt": out["corrupt"] or "no format or no samples"}
    if block:
        out["frames"] = out["data_bytes"] // block
        if out["data_bytes"] % block:
            out["malformed"].append("the last sample frame is partial")
        if out["sample_rate"]:
            out["duration_ms"] = out["frames"] * 1000 // out["sample_rate"]
    return out


def wav_headers(files: DataFrame) -> DataFrame:
    """path, content -> path and the header's fields; all but the samples of one batch of files at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([{k: v for k, v in wav_header(bytes(c)).items() if k != "offset"} for c in b["content"]])
            rows.insert(0, "path", b["path"].to_numpy())
            yield rows.astype({c: "Int64" for c in ("channels", "sample_rate", "bit_depth", "data_bytes", "frames", "duration_ms")})

    out = files.select("path", "content").mapInPandas(run, "path string, " + WAV_SCHEMA)
    return out.withColumns({"channel_layout": layout(F.col("channels")), "bitrate": F.expr(bits_per_second("data_bytes", "duration_ms")).cast("long")})


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1) as frames x channels, and the sample rate."""
    h = wav_header(data)
    if h["offset"] is None or not h["frames"]:
        return np.zeros((0, 1)), h["sample_rate"] or 0
    bits, n = h["bit_depth"], h["frames"] * h["channels"]
    raw = data[h["offset"] : h["offset"] + n * bits // 8]
    if h["codec"].startswith("pcm_f"):
        x = np.frombuffer(raw, f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000) / float(1 << 23)
    else:
        x = np.frombuffer(raw, f"<i{bits // 8}") / float(1 << (bits - 1))
    return x.reshape(-1, h["channels"]), h["sample_rate"]


def pcm_blocks(files: DataFrame, block: int = 4096) -> DataFrame:
    """path, content -> path, block_no, sample_rate, channels, samples (interleaved) of blocks of 4096 frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                x, rate = samples_of(bytes(content))
                for i in range(0, len(x), block * 64):  # a bounded number of blocks at a time
                    parts = [x[j : j + block] for j in range(i, min(len(x), i + block * 64), block)]
                    yield pd.DataFrame({"path": path, "block_no": [i // block + j for j in range(len(parts))], "sample_rate": rate, "channels": x.shape[1], "samples": [p.ravel().astype(np.float32) for p in parts]})

    return files.select("path", "content").mapInPandas(run, "path string, block_no long, sample_rate int, channels int, samples array<float>")


def stem(path: str = "path") -> Column:
    return F.regexp_replace(F.col(path), r"\.(expected\.txt|transcript\.txt|transcript\.json|[^./\\]*)$", "")


def transcripts(spark: SparkSession, folder: str, media: DataFrame) -> DataFrame:
    """path of media -> expected and hypothesis from sidecars next to it; a text hypothesis goes before a JSON one."""
    side = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{expected.txt,transcript.txt,transcript.json}").load(folder).where(F.col("length") <= MOST_TRANSCRIPT)
    text = F.expr("try_to_binary(cast(content AS string), 'utf-8')").cast("string")
    parsed = F.from_json(text, "text string, segments array<struct<text:string>>")
    said = F.when(F.col("path").endswith(".json"), F.coalesce(parsed["text"], F.array_join(F.transform(parsed["segments"], lambda s: s["text"]), " "))).otherwise(text)
    rows = side.select(stem().alias("stem"), F.col("path").alias("side"), said.alias("said"))
    own = rows.groupBy("stem").agg(F.max(F.when(F.col("side").endswith(".expected.txt"), F.col("said"))).alias("expected"), F.max_by("said", F.when(F.col("side").endswith(".transcript.txt"), 1).when(F.col("side").endswith(".transcript.json"), 0)).alias("hypothesis"))
    return media.select("path", stem().alias("stem")).join(own, "stem", "left").drop("stem")


def measurement_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, {asset, inspection} -> asset_id, asset, inspection."""
    rows = spark.read.schema(FIXTURE).option("multiLine", "true").json(path)
    return rows.select(F.col("asset.id").alias("asset_id"), "asset", "inspection")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
