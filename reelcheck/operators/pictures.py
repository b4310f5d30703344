"""Kernels over pictures and sound that need numpy: one Arrow batch of frames, or one stream in chunks, at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE_SPREAD, NOISE_SAMPLES, DETAIL = 3, 64, 0.5
#: K-weighting: centre frequency, gain in dB and quality of the shelf; frequency and quality of the high pass.
SHELF, HIGH_PASS = (1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, 0.5003270373238773)


def blockiness(a: np.ndarray) -> float | None:
    """Mean step over 8-pixel boundaries by mean step in the middle of blocks, both axes; none for flat pictures."""
    edge, inner = [], []
    for m in (np.abs(np.diff(a, axis=1)), np.abs(np.diff(a, axis=0)).T):
        at = np.arange(1, m.shape[1] + 1)
        edge.append(m[:, at % 8 == 0].ravel())
        inner.append(m[:, at % 8 == 4].ravel())
    edge, inner = np.concatenate(edge), np.concatenate(inner)
    if not len(edge) or not len(inner) or inner.mean() < DETAIL:
        return None
    return float(edge.mean() / inner.mean())


def blur(a: np.ndarray) -> float | None:
    """Mean absolute Laplacian of the inner pixels, scaled to 0..1."""
    if min(a.shape) < 3:
        return None
    lap = 4 * a[1:-1, 1:-1] - a[1:-1, :-2] - a[1:-1, 2:] - a[:-2, 1:-1] - a[2:, 1:-1]
    return float(np.abs(lap).mean() / (4 * 255))


def box(a: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(a, (n, n)).mean((2, 3))


def noise(a: np.ndarray) -> float | None:
    """Root mean square of pixel minus 5 x 5 mean, where these means vary by no more than 3 around; none with too few such pixels."""
    if min(a.shape) < 7:
        return None
    smooth = box(a, 5)
    around = np.lib.stride_tricks.sliding_window_view(smooth, (3, 3))
    flat = around.max((2, 3)) - around.min((2, 3)) <= NOISE_SPREAD
    rest = (a[2:-2, 2:-2] - smooth)[1:-1, 1:-1][flat]
    return float(np.sqrt((rest**2).mean())) if len(rest) >= NOISE_SAMPLES else None


def reduced(a: np.ndarray, most: float = 2.5e6, least: int = 16) -> np.ndarray:
    """Means over squares, so that no more than so many pixels are left; what doesn't fill a square is cut off.

    The squares get no larger than leaves ``least`` pixels along either side."""
    n = min(4, max(1, int(np.ceil(np.sqrt(a.size / most)))), max(1, min(a.shape) // least))
    h, w = a.shape[0] // n * n, a.shape[1] // n * n
    return a if n == 1 else np.floor(a[:h, :w].reshape(h // n, n, w // n, n).mean((1, 3)))


def perceptual_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        pictures = [reduced(np.asarray(v, float).reshape(h, w)) for v, w, h in zip(b["luma"], b["width"], b["height"], strict=True)]
        yield pd.DataFrame({"asset_id": b["asset_id"], "frame": b["frame"], "blockiness": [blockiness(a) for a in pictures], "blur": [blur(a) for a in pictures], "noise": [noise(a) for a in pictures]}).astype({"blockiness": float, "blur": float, "noise": float})


def perceptual(frames: DataFrame) -> DataFrame:
    """asset_id, frame, width, height, luma (array) -> the three metrics of each frame; null where a frame has no evidence."""
    rows = frames.select("asset_id", "frame", "width", "height", "luma").mapInPandas(perceptual_rows, "asset_id long, frame long, blockiness double, blur double, noise double")
    return rows.withColumns({m: F.when(~F.isnan(m), F.col(m)) for m in ("blockiness", "blur", "noise")})


def fold_perceptual(metrics: DataFrame) -> DataFrame:
    """Means over the frames that had evidence."""
    return metrics.groupBy("asset_id").agg(F.count(F.lit(1)).alias("frames_sampled"), F.avg("blockiness").alias("blockiness"), F.max("blockiness").alias("blockiness_max"), F.count("blockiness").alias("blockiness_frames"), F.avg("blur").alias("blur"), F.avg("noise").alias("noise"), F.count("noise").alias("flat_frames"))


def dead_cells(frames: DataFrame, dead_at: int = 8, stuck_at: int = 247, bright: int = 200, dark: int = 55, least: int = 3, flicker: bool = True) -> DataFrame:
    """asset_id, x, y, kind: cells that stay dark in bright frames (dead), bright in dark ones (stuck), or reach both ends (flicker).

    A frame with both a bright and a dark cell counts as both. Per-cell extremes are pre-aggregated."""
    rows = frames.withColumns({"is_bright": F.array_max("luma") >= bright, "is_dark": F.array_min("luma") <= dark})
    n = rows.groupBy("asset_id").agg(F.count_if("is_bright").alias("n_bright"), F.count_if("is_dark").alias("n_dark"))
    cells = rows.select("asset_id", "width", "is_bright", "is_dark", F.posexplode("luma").alias("i", "v"))
    ends = cells.groupBy("asset_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y")).agg(F.max(F.when(F.col("is_bright"), F.col("v"))).alias("top"), F.min(F.when(F.col("is_dark"), F.col("v"))).alias("low"), F.bool_or(F.col("v") >= stuck_at).alias("white"), F.bool_or(F.col("v") <= dead_at).alias("black"))
    kind = F.when(F.col("top") <= dead_at, "dead").when(F.col("low") >= stuck_at, "stuck")
    if flicker:
        kind = F.when(F.col("white") & F.col("black"), "flicker").otherwise(kind)
    return ends.join(n.where(f"n_bright >= {least} AND n_dark >= {least}"), "asset_id").withColumn("kind", kind).where("kind IS NOT NULL").select("asset_id", "x", "y", "kind")


def cluster(rows: pd.DataFrame, most: int = 64) -> pd.DataFrame:
    """4-connected components of cells of one kind, the largest first."""
    out = []
    for kind, own in rows.groupby("kind"):
        left = set(zip(own["x"].tolist(), own["y"].tolist(), strict=True))
        while left:
            todo, found = [left.pop()], []
            while todo:
                x, y = todo.pop()
                found.append((x, y))
                for near in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if near in left:
                        left.remove(near)
                        todo.append(near)
            xs, ys = [q[0] for q in found], [q[1] for q in found]
            out.append((int(rows["asset_id"].iloc[0]), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(found), kind))
    out.sort(key=lambda c: (-c[5], c[2], c[1]))
    return pd.DataFrame(out[:most], columns=["asset_id", "x", "y", "width", "height", "cells", "kind"])


def clusters(cells: DataFrame) -> DataFrame:
    """At most 64 clusters of each asset. The cells of one asset's grid are the bound of a group."""
    return cells.groupBy("asset_id").applyInPandas(lambda rows: cluster(rows), "asset_id long, x long, y long, width long, height long, cells long, kind string")


#: Fixed values of the flash test: smallest swing of relative luminance and of the red measure, level that the darker side of
#: a swing must stay below, share of red that is saturated, part of the picture that must swing (a quarter of 341 x 256 of 1024 x 768),
#: the largest grid, sample points of a cell along an axis, and changes that are kept of a class.
SWING, RED_SWING, DARKER, SATURATED, AREA = 0.1, 20.0, 0.8, 0.8, 0.25 * (341.0 * 256.0) / (1024.0 * 768.0)
GRID, POINTS, MOST_CHANGES = (128, 96), 3, 200_000


class Swings:
    """What each cell of a grid has been doing: the end of its last swing, or how far it went on since, and which way."""

    def __init__(self, least: float, darker: float | None):
        self.least, self.darker = np.float32(least), None if darker is None else np.float32(darker)
        self.end: np.ndarray | None = None
        self.way: np.ndarray | None = None

    def step(self, now: np.ndarray) -> tuple[int, int]:
        """How many cells swung up and down in this frame. A cell that never swung is compared with its first value."""
        now = now.astype(np.float32)
        if self.end is None or len(self.end) != len(now):
            self.end, self.way = now, np.zeros(len(now), np.int8)
            return 0, 0
        up = (now - self.end >= self.least) & (self.way <= 0)
        down = (self.end - now >= self.least) & (self.way >= 0)
        counts = np.ones(len(now), bool) if self.darker is None else np.minimum(self.end, now) < self.darker
        further = (self.way > 0) & (now > self.end) | (self.way < 0) & (now < self.end)
        self.end = np.where(up | down | further, now, self.end)
        self.way = np.where(up, 1, np.where(down, -1, self.way)).astype(np.int8)
        return int((up & counts).sum()), int((down & counts).sum())


def transitions(levels: list[np.ndarray], least: float, darker: float | None, share: float = AREA) -> list[tuple[int, int]]:
    """(frame, direction) at which enough cells swung the same way; where both ways had enough, the one with more (up if equal).

    Changes in the direction of the one before go on with it. A frame whose grid has another size starts the cells anew."""
    cells, out, last = Swings(least, darker), [], 0
    size = None
    for i, now in enumerate(levels):
        if size != len(now):
            size, last = len(now), 0
        needed = max(1, int(np.ceil(share * len(now))))
        up, down = cells.step(now)
        way = 0
        if up >= needed or down >= needed:
            way = 1 if up >= needed and (down < needed or up >= down) else -1
        if way and way != last:
            last = way
            if len(out) < MOST_CHANGES:
                out.append((i, way))
    return out


def planes_to_grid(y: np.ndarray, cb: np.ndarray | None, cr: np.ndarray | None, sd: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Relative luminance and red measure of each cell of a grid, from planes of studio-range video in 8-bit scale.

    A cell is the mean of POINTS x POINTS places spread over it. Chroma planes may be smaller; without them the picture is grey."""
    h, w = y.shape
    places = []
    for n, size in ((min(GRID[1], h), h), (min(GRID[0], w), w)):
        first = np.arange(n) * size // n
        width = np.maximum((np.arange(n) + 1) * size // n, first + 1) - first
        places.append(np.minimum(first[:, None] + width[:, None] * (2 * np.arange(POINTS) + 1) // (2 * POINTS), size - 1).ravel())
    rows, cols = places
    luma = (y[np.ix_(rows, cols)] - 16.0) / 219.0
    if cb is None or cr is None:
        pb = pr = np.zeros_like(luma)
    else:
        at = np.ix_(rows // -(-h // cb.shape[0]), cols // -(-w // cb.shape[1]))
        pb, pr = (cb[at] - 128.0) / 224.0, (cr[at] - 128.0) / 224.0
    kr, kb = (0.299, 0.114) if sd else (0.2126, 0.0722)
    r, b = luma + 2 * (1 - kr) * pr, luma + 2 * (1 - kb) * pb
    g = (luma - kr * r - kb * b) / (1 - kr - kb)
    r, g, b = (np.clip(v, 0.0, 1.0) ** 2.2 for v in (r, g, b))
    total = r + g + b
    red = np.where((total > 0) & (r >= SATURATED * total), np.maximum(r - g - b, 0.0) * 320.0, 0.0)
    cell = lambda v: v.reshape(len(rows) // POINTS, POINTS, len(cols) // POINTS, POINTS).mean((1, 3)).ravel().astype(np.float32)
    return cell(0.2126 * r + 0.7152 * g + 0.0722 * b), cell(red)


def grid_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = []
        for y, cb, cr, w, h, cw in zip(b["luma"], b["cb"], b["cr"], b["width"], b["height"], b["chroma_width"], strict=True):
            chroma = [np.asarray(v, float).reshape(-1, int(cw)) if v is not None and len(v) else None for v in (cb, cr)]
            found.append(planes_to_grid(np.asarray(y, float).reshape(h, w), *chroma, sd=h <= 576))
        yield pd.DataFrame({"asset_id": b["asset_id"], "frame": b["frame"], "ts": b["ts"], "luminance": [f[0] for f in found], "red": [f[1] for f in found]})


def flash_grid(frames: DataFrame) -> DataFrame:
    """asset_id, frame, ts, width, height, luma[, cb, cr, chroma_width] -> grids of relative luminance and of the red measure, row by row."""
    more = {"cb": "array<int>", "cr": "array<int>", "chroma_width": "int"}
    rows = frames.select("asset_id", "frame", "ts", "width", "height", "luma", *[F.col(c) if c in frames.columns else F.lit(None).cast(t).alias(c) for c, t in more.items()])
    return rows.mapInPandas(grid_rows, "asset_id long, frame long, ts long, luminance array<float>, red array<float>")


def transition_rows(rows: pd.DataFrame, least: float, darker: float | None, share: float) -> pd.DataFrame:
    rows = rows.sort_values(["ts", "frame"])
    ts, out = rows["ts"].to_numpy(), []
    for kind, column, swing, limit in (("general", "luminance", least, darker), ("red", "red", RED_SWING, None)):
        out += [(int(rows["asset_id"].iloc[0]), kind, int(ts[i]), way) for i, way in transitions([np.asarray(v, np.float32) for v in rows[column]], swing, limit, share)]
    return pd.DataFrame(out, columns=["asset_id", "kind", "ts", "direction"])


def flash_transitions(grids: DataFrame, least: float = SWING, darker: float | None = DARKER, share: float = AREA) -> DataFrame:
    """asset_id, kind (general or red), ts, direction: changes of large parts of the picture, from grids in the order of time.

    The state of the cells runs along a stream, so one stream's grids (at most 128 x 96 cells a frame) are the bound of a group."""
    return grids.select("asset_id", "frame", "ts", "luminance", "red").groupBy("asset_id").applyInPandas(lambda r: transition_rows(r, least, darker, share), "asset_id long, kind string, ts long, direction int")


def frame_hash(frames: DataFrame) -> DataFrame:
    """The frames with the ``hash`` of their picture, by which duplicates are found."""
    return frames.withColumn("hash", F.xxhash64("width", "height", "luma"))


def biquads(rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two stages of K-weighting at a sample rate: a high shelf and a high pass."""
    f, gain, q = SHELF
    k, vh = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    vb, a0 = vh**0.4996667741545416, 1 + k / q + k * k
    shelf = (np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0, np.array([2 * (k * k - 1), 1 - k / q + k * k]) / a0)
    f, q = HIGH_PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([2 * (k * k - 1), 1 - k / q + k * k]) / a0)]


def filtered(x: np.ndarray, b: np.ndarray, a: np.ndarray, block: int = 256) -> np.ndarray:
    """A second-order recurrence over a signal, block by block.

    Within a block the answer is linear in its input and in the two outputs before it, so one matrix product gives all blocks'
    answers to their own input, and only the two carried outputs run on from block to block."""
    n = len(x)
    x = np.concatenate([np.zeros(2), x, np.zeros(-n % block)])
    fed = (b[0] * x[2:] + b[1] * x[1:-1] + b[2] * x[:-2]).reshape(-1, block)
    pulse = np.zeros(block + 2)  # answer of the recurrence alone to one pulse
    pulse[2] = 1.0
    for i in range(3, block + 2):
        pulse[i] = -a[0] * pulse[i - 1] - a[1] * pulse[i - 2]
    h = pulse[2:]
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    own = fed @ np.where(lag >= 0, h[np.maximum(lag, 0)], 0.0).T
    before = np.concatenate([[0.0], h[:-1]])
    by_last, by_second = -a[0] * h - a[1] * before, -a[1] * h  # answers to the output before the block, and to the one before that
    y1 = y2 = 0.0
    for k in range(len(own)):
        own[k] += by_last * y1 + by_second * y2
        y1, y2 = own[k, -1], own[k, -2]
    return own.ravel()[:n]


def k_weighted(x: np.ndarray, rate: float) -> np.ndarray:
    for b, a in biquads(rate):
        x = filtered(np.asarray(x, float), b, a)
    return x


def loudness(x: np.ndarray, rate: int, hop: int | None = None) -> float | None:
    """Integrated loudness of one channel or of channels (rows): 400 ms blocks every 100 ms, gated twice."""
    hop = hop or round(rate / 10)
    channels = np.atleast_2d(x)
    energy = sum(k_weighted(c, rate) ** 2 for c in channels)
    n = len(energy) // hop
    steps = energy[: n * hop].reshape(n, hop).sum(1)
    if n < 4:
        return None
    blocks = np.convolve(steps, np.ones(4), "valid") / (4 * hop)
    level = -0.691 + 10 * np.log10(np.maximum(blocks, 1e-30))
    loud = blocks[level > -70]
    if not len(loud):
        return None
    kept = loud[-0.691 + 10 * np.log10(loud) > -0.691 + 10 * np.log10(loud.mean()) - 10]
    return float(-0.691 + 10 * np.log10((kept if len(kept) else loud).mean()))


def kernel(taps: int = 12, phases: int = 4, beta: float = 8.6) -> np.ndarray:
    """Fractional delays by windowed sincs, a row for each quarter of a sample, each with unit gain."""
    late = np.arange(phases)[:, None] / phases + (taps - 1) / 2
    h = np.sinc(late - np.arange(taps)) * np.kaiser(taps, beta)
    return h / h.sum(1, keepdims=True)


def peak_between(x: np.ndarray) -> float:
    """The largest magnitude of the four times oversampled signal, in dB; one sample of silence follows the last."""
    if not len(x):
        return -300.0
    x = np.append(x, 0.0)
    top = max(float(np.abs(np.convolve(x, h)[: len(x)]).max()) for h in kernel())
    return 20 * np.log10(top) if top > 0 else -300.0


def per_stream(f, name: str, samples: DataFrame) -> DataFrame:  # noqa: ANN001
    """A recurrence runs along one stream, so one stream's samples are the bound of a group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(["ts", "seq"])["x"].to_numpy()
        return pd.DataFrame({"asset_id": [int(rows["asset_id"].iloc[0])], name: [f(x)]}).astype({name: float})

    return samples.select("asset_id", "ts", "seq", "x").groupBy("asset_id").applyInPandas(run, f"asset_id long, {name} double")


def true_peak(samples: DataFrame) -> DataFrame:
    return per_stream(peak_between, "true_peak_db", samples)


def weighted_loudness(samples: DataFrame, rate: int, hop: int | None = None) -> DataFrame:
    return per_stream(lambda x: loudness(x, rate, hop), "loudness_lufs", samples)


# executors get these functions by value and need no path to this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
