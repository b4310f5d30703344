"""Measurements over time-ordered samples of a stream: runs, gaps, rates, levels, loudness gates.

All are window functions or pre-aggregated sums keyed by stream; nothing is gathered per stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(rows: DataFrame, keys: list[str], order: list[str], holds: Column, start: Column, end: Column) -> DataFrame:
    """keys, start, end: consecutive rows for which the condition holds, from the first start to the largest end (if later)."""
    w = ordered(keys, order)
    marked = rows.select(*keys, *[c for c in order if c not in keys], F.coalesce(holds, F.lit(False)).alias("_holds"), start.alias("_start"), end.alias("_end"))
    island = F.sum((~F.col("_holds")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = marked.withColumn("_island", island).where("_holds").groupBy(*keys, "_island").agg(F.min("_start").alias("start"), F.max("_end").alias("end"))
    return out.where("end > start").select(*keys, "start", "end")


def black_segments(frames: DataFrame, threshold: float = 16.0, level: str = "max") -> DataFrame:
    """frames: asset_id, ts, seq, dur and a level; runs of frames at or below the threshold."""
    return runs(frames, ["asset_id"], ["ts", "seq"], F.col(level) <= threshold, F.col("ts"), F.col("ts") + F.col("dur"))


def freeze_segments(frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Runs of frames whose mean differs from the frame before by no more than the threshold; a run begins at that frame before."""
    w = ordered(["asset_id"], ["ts", "seq"])
    rows = frames.withColumn("before", F.lag("ts").over(w)).withColumn("delta", F.abs(F.col("mean") - F.lag("mean").over(w)))
    return runs(rows, ["asset_id"], ["ts", "seq"], F.col("delta") <= threshold, F.col("before"), F.col("ts") + F.col("dur"))


def duplicate_segments(frames: DataFrame) -> DataFrame:
    """Runs of frames whose picture is equal to the frame before; a run begins at its own first frame."""
    w = ordered(["asset_id"], ["ts", "seq"])
    rows = frames.withColumn("same", F.lag("hash").over(w) == F.col("hash"))
    return runs(rows, ["asset_id"], ["ts", "seq"], F.col("same"), F.col("ts"), F.col("ts") + F.col("dur"))


def silence_segments(samples: DataFrame, threshold: float, most: int = 65_536) -> DataFrame:
    """asset_id, start, end, truncated: runs of samples at or below the threshold, the first ``most`` of them, and whether there were more."""
    found = runs(samples, ["asset_id"], ["ts", "seq"], F.abs("x") <= threshold, F.col("ts"), F.col("ts") + F.col("dur"))
    n = F.row_number().over(ordered(["asset_id"], ["start"]))
    count = F.count(F.lit(1)).over(Window.partitionBy("asset_id"))
    return found.withColumn("n", n).withColumn("truncated", count > most).where(F.col("n") <= most).select("asset_id", "start", "end", "truncated")


def luma_stats(frames: DataFrame) -> DataFrame:
    """Extremes, mean and shares out of the legal range over all pixels of all frames (asset_id, luma).

    Each frame is folded within its row to counts and sums, which merge by one pre-aggregated sum; pixels are never rows."""
    n = lambda c: F.size(F.filter("luma", c)).cast("long")
    rows = frames.select("asset_id", F.size("luma").cast("long").alias("n"), F.array_min("luma").alias("lo"), F.array_max("luma").alias("hi"), F.expr("aggregate(luma, 0L, (a, v) -> a + v)").alias("total"), n(lambda v: v < 16).alias("below"), n(lambda v: v > 235).alias("above"), n(lambda v: v >= 255).alias("white")).where("n > 0")
    share = lambda c: (F.sum(c) / F.sum("n")).alias({"below": "below_legal", "above": "above_legal", "white": "clipped_white"}[c])
    return rows.groupBy("asset_id").agg(F.min("lo").alias("min"), F.max("hi").alias("max"), (F.sum("total") / F.sum("n")).alias("mean"), share("below"), share("above"), share("white"))


def observed_rate(frames: DataFrame) -> DataFrame:
    """Frames a second from first to last frame, as a rational in thousandths."""
    return frames.groupBy("asset_id").agg((1000 * (F.count(F.lit(1)) - 1)).alias("num"), (F.max("ts") - F.min("ts")).alias("den")).where("num > 0 AND den > 0")


def deltas(frames: DataFrame, by: str = "ts") -> DataFrame:
    """asset_id, ts, before, delta between neighbours."""
    w = ordered(["asset_id"], [by, "seq"])
    rows = frames.withColumn("before", F.lag(by).over(w))
    return rows.where("before IS NOT NULL").select("asset_id", "seq", F.col(by).alias("ts"), "before", (F.col(by) - F.col("before")).alias("delta"))


def delta_mode(steps: DataFrame) -> DataFrame:
    """The most frequent step, of several the smallest."""
    return steps.groupBy("asset_id", "delta").agg(F.count(F.lit(1)).alias("n")).groupBy("asset_id").agg(F.max_by("delta", F.struct("n", -F.col("delta"))).alias("mode"))


def delta_median(steps: DataFrame) -> DataFrame:
    """The lower median of the steps."""
    return steps.groupBy("asset_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY delta)").cast("long").alias("median"))


def gaps(steps: DataFrame, kind: str, least: int = 20, most: int = 1000) -> DataFrame:
    """Steps of more than 1.5 medians and ``least`` more than one; what is the range differs by container.

    iso: [before + median, ts]; mkv: the same, and backward jumps of more than a median; ts: [before, ts] for steps of ``least`` or more, and any backward jump."""
    rows = steps.join(delta_median(steps), "asset_id")
    d, m = F.col("delta"), F.col("median")
    wide = d * 2 > m * 3
    if kind == "ts":
        cases = F.when(wide & (d >= least), F.struct(F.col("before").alias("s"), F.col("ts").alias("e"))).when(d < 0, F.struct(F.col("ts").alias("s"), F.col("before").alias("e")))
    else:
        cases = F.when(wide & (d - m >= least), F.struct((F.col("before") + m).alias("s"), F.col("ts").alias("e")))
        if kind == "mkv":
            cases = cases.when(-d > m, F.struct(F.col("ts").alias("s"), F.col("before").alias("e")))
    found = rows.withColumn("g", cases).where("g IS NOT NULL").select("asset_id", "seq", F.col("g.s").alias("start"), F.col("g.e").alias("end"))
    return found.withColumn("n", F.row_number().over(ordered(["asset_id"], ["start", "end", "seq"]))).where(F.col("n") <= most).drop("n", "seq")


def unwrap(packets: DataFrame, bits: int = 33) -> DataFrame:
    """Raw counters that wrap at 2**bits -> running position: steps of more than half a turn go the other way round."""
    turn, w = 1 << bits, ordered(["asset_id"], ["seq"])
    d = F.col("raw") - F.lag("raw").over(w)
    step = F.when(d > turn // 2, d - turn).when(d < -(turn // 2), d + turn).otherwise(d)
    rows = packets.withColumn("step", F.coalesce(step, F.col("raw")))
    return rows.withColumn("position", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select("asset_id", "seq", "position")


def flash_windows(transitions: DataFrame, limit: float, span: int = 1000) -> DataFrame:
    """asset_id, start, end, flashes: windows shorter than ``span`` with more than ``limit`` pairs of transitions, overlapping ones merged."""
    w = Window.partitionBy("asset_id").orderBy("ts")
    n = F.row_number().over(Window.partitionBy("asset_id").orderBy("ts", "seq")) - F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, -span))
    rows = transitions.withColumn("flashes", n / 2).withColumn("since", F.min("ts").over(w.rangeBetween(1 - span, 0))).where(F.col("flashes") > limit)
    kept = Window.partitionBy("asset_id").orderBy("ts", "seq")
    rows = rows.withColumn("fresh", F.coalesce(F.col("since") > F.lag("ts").over(kept), F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(kept.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("asset_id", "island").agg(F.min("since").alias("start"), F.max("ts").alias("end"), F.max("flashes").alias("flashes")).drop("island")


def levels(samples: DataFrame) -> DataFrame:
    """Peak in dBFS, clipped samples and DC offset in per cent (of all channels together), from samples x in [-1, 1]."""
    peak = F.max(F.abs("x"))
    db = F.when(peak > 0, 20 * F.log10(peak)).otherwise(F.lit(-300.0))
    return samples.groupBy("asset_id").agg(db.alias("peak_db"), F.count_if(F.abs("x") >= 1.0).alias("clipping_events"), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.sum("x") / F.count(F.lit(1)) * 100)).alias("dc_offset_percent"))


def phase_correlation(pairs: DataFrame) -> DataFrame:
    """Sum of left times right over the root of the energies; no mean is removed."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    return pairs.groupBy("asset_id").agg(F.try_divide(s("l", "r"), F.nullif(F.sqrt(s("l", "l") * s("r", "r")), F.lit(0.0))).alias("c")).select("asset_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))).alias("phase_correlation"))


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, -0.691 + 10 * F.log10(energy)).otherwise(F.lit(float("-inf")))


def windows(steps: DataFrame, n: int) -> DataFrame:
    """Mean energy of every n consecutive steps; none before the first full window."""
    w = ordered(["asset_id"], ["step"]).rowsBetween(1 - n, 0)
    return steps.withColumn("full", F.count(F.lit(1)).over(w) == n).withColumn("energy", F.sum("energy").over(w) / n).where("full").select("asset_id", "step", "energy")


def integrated_loudness(blocks: DataFrame, absolute: float = -70.0, relative: float = -10.0) -> DataFrame:
    """Two gates: louder than the absolute one, then louder than the mean of those plus the relative one (or all of them, if none is)."""
    loud = blocks.withColumn("l", lufs(F.col("energy"))).where(F.col("l") > absolute)
    mean = loud.groupBy("asset_id").agg(F.avg("energy").alias("mean"))
    gated = loud.join(mean, "asset_id").withColumn("kept", F.col("l") > lufs(F.col("mean")) + relative)
    energy = F.coalesce(F.avg(F.when(F.col("kept"), F.col("energy"))), F.first("mean"))
    return gated.groupBy("asset_id").agg(lufs(energy).alias("loudness_lufs"))


def loudness_range(windows_: DataFrame, absolute: float = -70.0, relative: float = -20.0) -> DataFrame:
    """95th minus 10th percentile of gated short-term loudness; percentiles are picked at the rounded index."""
    loud = windows_.withColumn("l", lufs(F.col("energy"))).where(F.col("l") > absolute)
    mean = loud.groupBy("asset_id").agg(F.avg("energy").alias("mean"))
    kept = loud.join(mean, "asset_id").where(F.col("l") > lufs(F.col("mean")) + relative)
    all_ = Window.partitionBy("asset_id")
    ranked = kept.withColumn("i", F.row_number().over(all_.orderBy("l", "step")) - 1).withColumn("n", F.count(F.lit(1)).over(all_))
    at = lambda q: F.max(F.when(F.col("i") == F.round((F.col("n") - 1) * q), F.col("l")))
    return ranked.groupBy("asset_id").agg((at(0.95) - at(0.10)).alias("loudness_range_lu"))


def longest_gap(regions: DataFrame, length: DataFrame) -> DataFrame:
    """The longest stretch without a region, before the first and after the last included; the first of equally long ones.

    regions: asset_id, start, end; length: asset_id, total."""
    w = Window.partitionBy("asset_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    inner = regions.withColumn("cursor", F.coalesce(F.max("end").over(w), F.lit(0))).select("asset_id", F.col("cursor").alias("start"), F.col("start").alias("end"))
    last = length.join(regions.groupBy("asset_id").agg(F.max("end").alias("cursor")), "asset_id", "left").select("asset_id", F.coalesce("cursor", F.lit(0)).alias("start"), F.col("total").alias("end"))
    both = inner.unionByName(last).where("end > start")
    best = both.groupBy("asset_id").agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("g"))
    return best.select("asset_id", "g.start", "g.end")


def speaker_changes(turns: DataFrame) -> DataFrame:
    before = F.lag("speaker").over(ordered(["asset_id"], ["turn"]))
    return turns.withColumn("changed", before != F.col("speaker")).groupBy("asset_id").agg(F.count_if("changed").alias("speaker_changes"), F.count_distinct("speaker").alias("speaker_count"))


def expand_runs(table: DataFrame) -> DataFrame:
    """Run-length tables (asset_id, run, count, delta) -> samples with their start: explode and a running sum."""
    rows = table.where("count > 0").select("asset_id", "run", "delta", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("i"))
    w = ordered(["asset_id"], ["run", "i"])
    return rows.select("asset_id", (F.row_number().over(w) - 1).alias("sample"), (F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("delta")).alias("start"), F.col("delta").alias("duration"))


def last_run_before(points: DataFrame, table: DataFrame) -> DataFrame:
    """As-of join: each point (asset_id, at) gets the value of the last run (asset_id, first, value) at or before it.

    Both sides are united and the last value seen is carried on, so there is no inequality join."""
    both = table.select("asset_id", F.col("first").alias("at"), "value", F.lit(0).alias("side")).unionByName(points.select("asset_id", "at", F.lit(None).cast("long").alias("value"), F.lit(1).alias("side")))
    w = ordered(["asset_id"], ["at", "side"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("value", F.last("value", True).over(w)).where("side = 1").select("asset_id", "at", "value")
