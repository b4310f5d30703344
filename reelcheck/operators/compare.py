"""Comparing two inspections: streams of a kind pair by position, each field is equal, different or unmeasured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rational_value

CELL = "struct<scope:string,field:string,`left`:string,`right`:string,state:string,kind:string>"


@dataclass(frozen=True)
class Tolerances:
    duration_ms: float = 40.0
    frame_rate: float = 0.001
    loudness_lu: float = 0.5
    peak_db: float = 0.5
    bitrate_ratio: float = 0.1
    luma: float = 1.0


def cell(scope: str, field: str, left: str, right: str, same: str, kind: str) -> str:
    state = f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN 'unmeasured' WHEN {same} THEN 'same' ELSE 'different' END"
    return f"named_struct('scope', {scope}, 'field', '{field}', 'left', cast({left} AS string), 'right', cast({right} AS string), 'state', {state}, 'kind', '{kind}')"


def text(scope: str, field: str, get: str, kind: str, a: str = "a", b: str = "b") -> str:
    x, y = f"cast({get.format(a)} AS string)", f"cast({get.format(b)} AS string)"
    return cell(scope, field, x, y, f"lower({x}) = lower({y})", kind)


def number(scope: str, field: str, get: str, tolerance: float, kind: str, unit: str = "", a: str = "a", b: str = "b") -> str:
    x, y = f"cast({get.format(a)} AS double)", f"cast({get.format(b)} AS double)"
    shown = lambda v: f"CASE WHEN {v} IS NOT NULL THEN concat(printf('%.2f', {v}), '{unit}') END"
    return cell(scope, field, shown(x), shown(y), f"abs({x} - {y}) <= {tolerance}D", kind)


def pair_cells(kind: str, t: Tolerances) -> str:
    """Cells of the i-th pair of streams (p.s0, p.s1 with their measurements p.m0, p.m1)."""
    scope = f"concat('{kind} ', p.i)"
    s, m = ("p.s0", "p.s1"), ("p.m0", "p.m1")
    both = lambda f, field, get, *more, of=s: f(scope, field, get, *more, a=of[0], b=of[1])
    cells = [both(text, "codec", "{}.codec", "major")]
    if kind == "video":
        cells += [both(text, "resolution", "concat({0}.width, 'x', {0}.height)", "major"), both(number, "frame rate", rational_value("{0}.frame_rate"), t.frame_rate, "major", " fps"), both(text, "pixel format", "{}.pixel_format", "minor"), both(text, "scan order", "{}.field_order", "major"), both(text, "colour space", "{}.colorspace", "major", of=m)]
        n = "CASE WHEN p.m0.decoded_frame_count > 0 AND p.m1.decoded_frame_count > 0 THEN {} END"
        counts = [both(text, f"{w} segments", n.format(f"size({{0}}.{w}_frames)"), k, of=m) for w, k in (("black", "major"), ("freeze", "major"), ("duplicate", "minor"))]
        cells += [*counts, both(number, "mean luma", n.format("{0}.luma.mean"), t.luma, "minor", of=m)]
    elif kind == "audio":
        cells += [both(text, "sample rate", "{}.sample_rate", "major"), both(text, "channels", "{}.channels", "major"), both(text, "channel layout", "{}.channel_layout", "major"), both(text, "bit depth", "{}.bit_depth", "minor"), both(text, "language", "{}.language", "minor")]
        levels = [("integrated loudness", "loudness_lufs", t.loudness_lu, "major", " LUFS"), ("loudness range", "loudness_range_lu", t.loudness_lu, "minor", " LU"), ("true peak", "true_peak_db", t.peak_db, "major", " dBTP"), ("sample peak", "peak_db", t.peak_db, "minor", " dBFS"), ("clipping events", "clipping_events", 0.0, "major", "")]
        cells += [both(number, field, f"{{0}}.{name}", tol, k, unit, of=m) for field, name, tol, k, unit in levels] + [both(number, "silence segments", "CASE WHEN {0} IS NOT NULL THEN size({0}.silence) END", 0.0, "minor", of=m)]
    return f"array({', '.join(cells)})"


def arrays(pairs: DataFrame, tolerances: Tolerances = Tolerances(), key: str = "pair_id") -> DataFrame:
    """key, a, b (inspections with their streams) -> key and ``cells``, the array of all compared fields. No shuffle.

    A generator of one row keeps the cells' expressions from being copied into what follows."""
    t, c = tolerances, "'container'"
    bits = "cast({}.container.bitrate_bps AS double)"
    x, y = bits.format("a"), bits.format("b")
    cells = [text(c, "format", "{}.container.format", "minor"), number(c, "duration", "{}.container.duration", t.duration_ms, "major", " ms"), cell(c, "bitrate", x, y, f"coalesce(try_divide(abs({x} - {y}), greatest({x}, {y})), 0D) <= {t.bitrate_ratio}D", "minor"), text(c, "timecode", "{}.container.timecode_present", "minor")]
    found = [f"array({', '.join(cells)})"]
    for kind in ("video", "audio", "subtitle"):
        of = lambda v: f"filter({v}.streams, s -> s.kind = '{kind}')"  # noqa: B023, E731
        found.append(f"array({text(repr(kind), 'stream count', f'size({of("{0}")})', 'major')})")
        measured = f"get(filter({{0}}.{kind}, m -> m.stream_idx = s.index), 0)"
        side = lambda v: f"transform({of(v)}, s -> named_struct('s', s, 'm', {measured.format(v)}))"  # noqa: B023, E731
        zipped = f"transform(slice(arrays_zip({side('a')}, {side('b')}), 1, least(size({of('a')}), size({of('b')}))), (z, i) -> named_struct('i', i, 's0', z.`0`.s, 'm0', z.`0`.m, 's1', z.`1`.s, 'm1', z.`1`.m))"
        found.append(f"flatten(transform({zipped}, p -> {pair_cells(kind, t)}))")
    return pairs.select(key, F.inline(F.array(F.struct(F.expr(f"concat({', '.join(found)})").alias("cells")))))


def compare(pairs: DataFrame, tolerances: Tolerances = Tolerances(), key: str = "pair_id") -> DataFrame:
    """One row per field: key, scope, field, left, right, state, kind."""
    return arrays(pairs, tolerances, key).select(key, F.inline("cells"))


def row_summary(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """Differences, equal and unmeasured fields, and the worst kind of difference, counted within the row."""
    n = lambda state: F.expr(f"cast(size(filter(cells, c -> c.state = '{state}')) AS bigint)")
    worst = "CASE WHEN exists(cells, c -> c.state = 'different' AND c.kind = 'major') THEN 'major' WHEN exists(cells, c -> c.state = 'different') THEN 'minor' ELSE 'none' END"
    return rows.select(key, n("different").alias("n_different"), n("same").alias("n_same"), n("unmeasured").alias("n_unmeasured"), F.expr(worst).alias("worst"))


def summary(cells: DataFrame, key: str = "pair_id") -> DataFrame:
    """Differences, equal and unmeasured fields, and the worst kind of difference."""
    different = F.col("state") == "different"
    return cells.groupBy(key).agg(F.count_if(different).alias("n_different"), F.count_if(F.col("state") == "same").alias("n_same"), F.count_if(F.col("state") == "unmeasured").alias("n_unmeasured"), F.when(F.bool_or(different & (F.col("kind") == "major")), "major").when(F.bool_or(different), "minor").otherwise("none").alias("worst"))
