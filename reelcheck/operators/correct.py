"""Level correction: measuring, what to do, doing it to samples, writing them and measuring again."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pictures

LEAST_DC, LEAST_GAIN = 0.0005, 0.05


def plan(measured: DataFrame, target_lufs: float | None = -23.0, ceiling_db: float = -1.0, remove_dc: bool = True) -> DataFrame:
    """asset_id, loudness_lufs, true_peak_db, max_dc -> remove_dc, gain_db (none when on target or refused), refused."""
    gain = F.lit(target_lufs).cast("double") - F.col("loudness_lufs")
    unknown = F.col("loudness_lufs").isNull() | F.col("true_peak_db").isNull()
    asked, small = F.lit(target_lufs is not None), F.abs(gain) < LEAST_GAIN
    over = F.col("true_peak_db") + gain > ceiling_db
    return measured.select("asset_id", (F.lit(remove_dc) & (F.col("max_dc") >= LEAST_DC)).alias("remove_dc"), F.when(asked & ~unknown & ~small & ~over, gain).alias("gain_db"), F.when(asked & unknown, "unmeasured").when(asked & ~small & over, "over the ceiling").alias("refused"))


def applied(x: Column, dc: Column, gain_db: Column, bits: int) -> Column:
    """The corrected sample as an integer of so many bits: half away from zero, held within the range."""
    scale = 1 << (bits - 1)
    gain = F.pow(F.lit(10.0), F.coalesce(gain_db, F.lit(0.0)) / 20)
    return F.greatest(F.lit(-scale), F.least(F.lit(scale - 1), F.round((x - F.coalesce(dc, F.lit(0.0))) * gain * scale).cast("long")))


def levels(x: np.ndarray, rate: int) -> tuple[float | None, float, float]:
    """Loudness, true peak and the largest offset of a channel, of frames x channels."""
    if not len(x):
        return None, -300.0, 0.0
    return pictures.loudness(x.T, rate), max(pictures.peak_between(c) for c in x.T), float(np.abs(x.mean(0)).max())


def wav(x: np.ndarray, rate: int, bits: int) -> bytes:
    """A PCM file of integer samples (frames x channels): whole-byte depths up to 32."""
    size, channels = bits // 8, x.shape[1]
    if bits == 8:
        raw = (x + 128).astype(np.uint8).tobytes()
    elif bits == 24:
        raw = x.astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    else:
        raw = x.astype(f"<i{size}").tobytes()
    head = struct.pack("<4sIHHIIHH4sI", b"fmt ", 16, 1, channels, rate, rate * channels * size, channels * size, bits, b"data", len(raw))
    body = b"WAVE" + head + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def corrected(files: DataFrame, target_lufs: float | None = -23.0, ceiling_db: float = -1.0, remove_dc: bool = True) -> DataFrame:
    """path, content of WAV files -> path, before and after (loudness, true peak, offset), removed_dc, gain_db, refused, content.

    A file is measured, planned by the rules of ``plan``, changed and measured again, one at a time. ``content`` is null where nothing is to be
    done or the file can't be read; the source is never written to."""
    from ..sources import files as source

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                x, rate = source.samples_of(bytes(content))
                head = source.wav_header(bytes(content))
                loud, peak, dc = levels(x, rate)
                bits = 16 if (head["codec"] or "").startswith("pcm_f") else head["bit_depth"]
                gain, refused = None, None
                if not len(x):
                    refused = "unreadable"
                elif target_lufs is not None and loud is None:
                    refused = "unmeasured"
                elif target_lufs is not None and abs(target_lufs - loud) >= LEAST_GAIN:
                    gain = target_lufs - loud
                    if peak + gain > ceiling_db:
                        gain, refused = None, "over the ceiling"
                drop = remove_dc and dc >= LEAST_DC
                row = {"path": path, "loudness_before": loud, "true_peak_before": peak, "dc_before": dc, "removed_dc": bool(drop), "gain_db": gain, "refused": refused, "loudness_after": None, "true_peak_after": None, "dc_after": None, "content": None}
                if len(x) and (drop or gain is not None):
                    scale = 1 << (bits - 1)
                    y = (x - (x.mean(0) if drop else 0.0)) * 10 ** ((gain or 0.0) / 20) * scale
                    y = np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -scale, scale - 1).astype(np.int64)
                    row["loudness_after"], row["true_peak_after"], row["dc_after"] = levels(y / scale, rate)
                    row["content"] = wav(y, rate, bits)
                yield pd.DataFrame([row])

    names = ["loudness_before double", "true_peak_before double", "dc_before double", "removed_dc boolean", "gain_db double", "refused string", "loudness_after double", "true_peak_after double", "dc_after double", "content binary"]
    return files.select("path", "content").mapInPandas(run, "path string, " + ", ".join(names))


# executors get these functions by value and need no path to this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
