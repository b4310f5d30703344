"""One query for each built-in rule over the bound tables, and what each must give, in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..profiles import model
from ..rules.compiler import RULE_IDS, findings
from ..sources import bindings as b

PROFILE = "all-rules"


def only(profile: model.Profile, rule_id: str) -> model.Profile:
    return replace(profile, rules={rule_id: profile.rules[rule_id]}, custom=[], plugins=[])


def rule_query(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(b.inspections(spark, sf_dir), only(model.load(PROFILE), rule_id))
    return found.select("asset_id", "status", "stream_idx", F.col("time_range.start_ms").alias("start_ms"), F.col("time_range.end_ms").alias("end_ms"))


PRELUDE = f"""WITH flat AS ({b.FLAT}), streams AS ({b.STREAMS}),
pv AS (SELECT * FROM streams WHERE kind = 'video' QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY idx) = 1),
pa AS (SELECT * FROM streams WHERE kind = 'audio' QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY idx) = 1),
base AS (SELECT f.*, pv.idx AS pv, pv.width, pv.height, pv.pixel_format, pv.field_order, pv.frame_rate, pv.duration_s AS pv_s, pa.idx AS pa, pa.sample_rate, pa.bit_depth, pa.channels, pa.layout,
  f.validity <> 'not_scanned' AS scanned, f.has_vm AND pv.idx IS NOT NULL AS vm, f.has_am AND pa.idx IS NOT NULL AND coalesce(f.a_decoded, 0) > 0 AS am,
  (SELECT count(*) FROM streams s WHERE s.asset_id = f.asset_id) AS n_streams
  FROM flat f LEFT JOIN pv USING (asset_id) LEFT JOIN pa USING (asset_id)),
subs AS (SELECT s.*, base.scanned, base.pv_s, base.container_ms FROM streams s JOIN base USING (asset_id) WHERE kind = 'subtitle'),
voices AS (SELECT base.*, j AS v FROM base, range(2) t(j) WHERE j < n_voice)
"""
NO = "CAST(NULL AS BIGINT)"


def row(status: str, where: str, source: str = "base", stream: str = NO, start: str = NO, end: str = NO) -> str:
    return f"SELECT asset_id, {status} AS status, CAST({stream} AS BIGINT) AS stream_idx, CAST({start} AS BIGINT) AS start_ms, CAST({end} AS BIGINT) AS end_ms FROM {source} WHERE {where}"


def decided(*branches: tuple[str, str], fails_on: str = NO) -> str:
    """The first true condition gives the status; none: no row."""
    case = "CASE" + "".join(f" WHEN {c} THEN '{s}'" for c, s in branches) + " END"
    return row("status", "status IS NOT NULL", f"(SELECT *, {case} AS status FROM base)", f"CASE WHEN status = 'fail' THEN {fails_on} END")


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


I, X, OK = "inconclusive", "fail", "pass"
FRAMES = "coalesce(decoded, 0) = 0"


def spans(kind: str, n: str, most: int, allowed: str) -> str:
    start, length = b.SPANS[kind]
    return row("'fail'", f"j < {n} AND {length} > {most} AND {allowed}", "base, range(4) t(j)", start=start, end=f"{start} + {length}")


def segments(kind: str) -> str:
    start, length = b.SPANS[kind]
    bad = f"EXISTS (SELECT 1 FROM range(4) t(j) WHERE j < n_segments AND {length} > 500)"
    return union(spans(kind, "n_segments", 500, f"vm AND NOT ({FRAMES})"), decided(("NOT vm", I), (FRAMES, I), (bad, None or "skip"), ("v_errors > 0", I)).replace("status IS NOT NULL", "status = 'inconclusive'"))


def measured(value: str, bad: str, shows: bool = False, nullable: bool = True) -> str:
    return decided(("NOT am", I), *([(f"{value} IS NULL", I)] if nullable else []), (bad, X), ("a_errors > 0", I), *([("true", OK)] if shows else []), fails_on="pa")


def reported(field: str, wanted: str) -> str:
    return decided(("pa IS NULL", I), (f"{field} IS NULL", I), (f"{field} <> {wanted}", X), fails_on="pa")


def perceptual(*branches: tuple[str, str]) -> str:
    return decided(("NOT vm", I), ("NOT has_perceptual", I), ("p_frames = 0", I), *branches)


SEEN = "CASE WHEN vm THEN coalesce(rate_observed, frame_rate) ELSE frame_rate END"
RATE = f"CAST(split_part({SEEN}, '/', 1) AS DOUBLE) / CAST(split_part({SEEN}, '/', 2) AS DOUBLE)"
ORDER = "CASE WHEN vm THEN coalesce(vm_order, field_order) ELSE field_order END"
RANGE = "CASE WHEN lower(transfer) IN ('smpte2084', 'st2084', 'pq') THEN 'pq' WHEN lower(transfer) IN ('arib-std-b67', 'hlg') THEN 'hlg' ELSE 'sdr' END"
HDR_KNOWN = "vm AND has_hdr AND transfer IS NOT NULL"
HDR = [
    f"{RANGE} <> 'sdr'", f"{RANGE} <> 'sdr' AND NOT starts_with(lower(primaries), 'bt2020')", f"{RANGE} <> 'sdr' AND primaries IS NULL", f"{RANGE} <> 'sdr' AND NOT starts_with(lower(matrix), 'bt2020')",
    f"{RANGE} <> 'sdr' AND h_range <> 'tv'", f"{RANGE} <> 'sdr' AND NOT regexp_matches(pixel_format, '10|12|16')", f"{RANGE} = 'pq' AND NOT dolby AND NOT has_mastering",
    f"{RANGE} = 'pq' AND NOT dolby AND (max_cll IS NULL OR max_fall IS NULL)", "max_fall > max_cll", "has_mastering AND min_nits >= max_nits",
]
DURATIONS = "(SELECT asset_id, 0 AS i, container_ms AS ms FROM base WHERE container_ms IS NOT NULL UNION ALL SELECT asset_id, idx + 1, duration_s * 1000 FROM streams WHERE duration_s IS NOT NULL)"
TOTAL = "(CASE WHEN dark_cells IS NULL THEN 0 ELSE dark_cells END + bright_cells + flicker_cells)"
DEAD = "vm AND has_dead AND dead_frames > 0"
FLASHES = "(SELECT base.*, k * flash_step AS stamp, (SELECT count(*) FROM range(15) u(m) WHERE m < n_flash AND m <= k AND (k - m) * flash_step < 1000) AS n, (SELECT min(m) FROM range(15) u(m) WHERE m < n_flash AND (k - m) * flash_step < 1000 AND m <= k) * flash_step AS since FROM base, range(15) t(k) WHERE k < n_flash AND vm AND has_flash AND NOT (coalesce(decoded, 0) = 0))"
HAZARDS = f"(SELECT asset_id, min(since) AS s, max(stamp) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY asset_id ORDER BY stamp ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN since <= lag(stamp) OVER (PARTITION BY asset_id ORDER BY stamp) THEN 0 ELSE 1 END AS fresh FROM {FLASHES} WHERE n / 2.0 > 3)) GROUP BY asset_id, island)"
LANGUAGE = "CASE regexp_extract(lower(trim(language)), '^[^-_]*') WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fre' ELSE regexp_extract(lower(trim(language)), '^[^-_]*') END"
SPOKEN = "(SELECT * FROM voices WHERE spoken)"
NO_VOICE = row("'inconclusive'", "n_voice = 0 OR NOT spoken")


def without(source: str, condition: str) -> str:
    """Assets without any row of the source."""
    return row("'inconclusive'", f"{condition} AND NOT EXISTS (SELECT 1 FROM {source} x WHERE x.asset_id = base.asset_id)")


def many(n: str, most: int, where: str) -> str:
    """All ranges of a subtitle stream once there are more than allowed."""
    return row("'fail'", f"{where} AND {n} > {most} AND j < {n}", "subs, range(4) t(j)", start="j * 100", end="j * 100 + 50")


CUES, TEXTS = "(SELECT * FROM subs WHERE cue_count IS NOT NULL)", "(SELECT * FROM subs WHERE cue_count > 0 AND text_decoded)"
HAS_TEXT = f"EXISTS (SELECT 1 FROM {TEXTS} y WHERE y.asset_id = subs.asset_id)"
VIDEO_MS = "coalesce(pv_s * 1000, container_ms)"
SQL: dict[str, str] = {
    "container.readable": decided(("NOT scanned", I), ("validity <> 'ok'", X)),
    "container.container_validity": decided(("NOT scanned", I), ("validity LIKE '%corrupt%'", X)),
    "container.malformed_metadata": row("'fail'", "j < n_malformed", "base, range(3) t(j)"),
    "container.duration_consistency": union(row("'fail'", "x.i < y.i AND abs(x.ms - y.ms) > 100", f"{DURATIONS} x JOIN {DURATIONS} y USING (asset_id)"), row("CASE WHEN n = 0 THEN 'inconclusive' ELSE 'pass' END", "n = 0 OR hi - lo <= 100", f"(SELECT base.asset_id, count(d.ms) AS n, max(d.ms) AS hi, min(d.ms) AS lo FROM base LEFT JOIN {DURATIONS} d USING (asset_id) GROUP BY 1)")),
    "container.bitrate": decided(("NOT scanned", I), ("bitrate_bps IS NULL", I), ("bitrate_bps < 10000000", X), ("true", OK)),
    "container.timecode_present": decided(("timecode IS NULL", I), ("NOT timecode", X)),
    "container.timebase": union(row("CASE WHEN time_base IS NULL THEN 'inconclusive' ELSE 'fail' END", "kind = 'video' AND time_base IS DISTINCT FROM '1/12800'", "streams", "idx"), row("'pass'", "pv IS NOT NULL AND NOT EXISTS (SELECT 1 FROM streams s WHERE s.asset_id = base.asset_id AND kind = 'video' AND time_base IS DISTINCT FROM '1/12800')")),
    "container.timestamp_continuity": union(decided(("NOT scanned", I), ("n_gaps = 0", OK)), spans("gap", "n_gaps", 150, "scanned")),
    "container.unexpected_streams": union(row("'fail'", "kind = 'data'", "streams", "idx"), row("'pass'", "n_streams > 0 AND NOT EXISTS (SELECT 1 FROM streams s WHERE s.asset_id = base.asset_id AND kind = 'data')")),
    "container.stream_presence": union(row("'inconclusive'", "NOT scanned"), row("'fail'", "scanned AND pv IS NULL"), row("'fail'", "scanned AND pa IS NULL"), row("'fail'", "scanned AND n_streams > 32")),
    "video.resolution": decided(("pv IS NULL", I), ("width IS NULL OR height IS NULL", I), ("width <> 1920 OR height <> 1080", X)),
    "video.frame_rate": decided(("pv IS NULL", I), (f"{SEEN} IS NULL", I), (f"abs({RATE} - 25) > 0.001", X)),
    "video.aspect_ratio": decided(("pv IS NULL", I), ("width IS NULL OR height IS NULL", I), ("abs(CAST(width AS DOUBLE) / height - CAST(16 AS DOUBLE) / 9) / (CAST(16 AS DOUBLE) / 9) > 0.01", X)),
    "video.color_space": decided(("NOT vm", I), ("colorspace IS NULL", I), ("colorspace <> 'bt709'", X)),
    "video.scan_format": decided(("pv IS NULL", I), (f"{ORDER} IS NULL", I), (f"{ORDER} LIKE '%_field_first'", X), (f"{ORDER} = 'unknown'", I), ("true", OK)),
    "video.black_frames": segments("black"),
    "video.freeze_frames": segments("freeze"),
    "video.duplicate_frames": decided(("NOT vm", I), (FRAMES, I), ("n_segments > 2", X), ("v_errors > 0", I)),
    "video.corrupt_frames": decided(("NOT vm", I), (FRAMES, I), ("v_errors > 5", X)),
    "video.luma_range": decided(("NOT vm", I), ("NOT has_luma", I), ("below_legal + above_legal > CAST('0.02' AS DOUBLE)", X), ("true", OK)),
    "video.photosensitivity": union(row("'fail'", "true", HAZARDS, start="s", end="greatest(e, s + 1)"), decided(("NOT vm", I), (FRAMES, I), ("NOT has_flash", I), (f"asset_id IN (SELECT asset_id FROM {HAZARDS})", "skip"), ("v_errors > 0", I)).replace("status IS NOT NULL", "status = 'inconclusive'")),
    "video.hdr": union(row("'inconclusive'", f"NOT ({HDR_KNOWN})"), *[row("'fail'", f"{HDR_KNOWN} AND ({h})") for h in HDR]),
    "video.dead_pixels": union(row("'inconclusive'", f"NOT ({DEAD})"), row("'fail'", f"{DEAD} AND {TOTAL} > 0"), row("'fail'", f"{DEAD} AND n_clusters > 0"), row("'pass'", f"{DEAD} AND ({TOTAL} > 0 OR n_clusters > 0) AND n_clusters > 0")),
    "video.blockiness": union(perceptual(("block_frames / CAST(p_frames AS DOUBLE) < 0.5", I), ("blockiness IS NULL", I), ("blockiness > CAST('1.6' AS DOUBLE)", X)), row("'fail'", "vm AND has_perceptual AND p_frames > 0 AND block_frames / CAST(p_frames AS DOUBLE) >= 0.5 AND blockiness IS NOT NULL AND blockiness_max > 3")),
    "video.blur": perceptual(("blur IS NULL", I), ("blur < CAST('0.004' AS DOUBLE)", X)),
    "video.noise": perceptual(("flat_frames / CAST(p_frames AS DOUBLE) < 1", I), ("noise IS NULL", I), ("noise > 2", X)),
    "audio.sample_rate": reported("sample_rate", "48000"),
    "audio.bit_depth": reported("bit_depth", "24"),
    "audio.channel_layout": decided(("pa IS NULL", I), ("channels IS NULL", I), ("channels <> 2", X), ("layout <> 'stereo'", X)),
    "audio.silence": union(spans("silence", "n_segments", 4000, "am"), decided(("NOT am", I), (f"EXISTS (SELECT 1 FROM range(4) t(j) WHERE j < n_segments AND {b.SPANS['silence'][1]} > 4000)", "skip"), ("truncated", I), ("a_errors > 0", I)).replace("status IS NOT NULL", "status = 'inconclusive'")),
    "audio.clipping": measured("clips", "clips > 10", nullable=False),
    "audio.peak": measured("peak_db", "peak_db > -1", shows=True),
    "audio.true_peak": measured("true_peak_db", "true_peak_db > -1", shows=True),
    "audio.loudness": measured("lufs", "abs(lufs + 23) > 1", shows=True),
    "audio.phase": measured("phase", "phase < CAST('-0.5' AS DOUBLE)"),
    "audio.dc_offset": measured("dc_offset", "abs(dc_offset) > 1"),
    "subtitle.presence": union(row("'inconclusive'", "NOT scanned"), row("'fail'", "scanned AND asset_id NOT IN (SELECT asset_id FROM subs)")),
    "subtitle.language": union(row("'inconclusive'", "NOT scanned"), row("'fail'", f"scanned AND asset_id NOT IN (SELECT asset_id FROM subs WHERE {LANGUAGE} = 'eng')")),
    "subtitle.timing": union(many("n_bad", 0, "cue_count IS NOT NULL"), many("n_overlaps", 0, "cue_count IS NOT NULL"), row("'fail'", "max_gap_ms > 3000", CUES), row("'fail'", "max_cue_ms > 7000", CUES), without(CUES, "true")),
    "subtitle.content": union(many("n_malformed", 0, f"cue_count > 0 AND {HAS_TEXT}"), many("n_empty", 0, f"cue_count > 0 AND {HAS_TEXT}"), row("'fail'", "max_line > 42", TEXTS), row("'fail'", "max_lines > 2", TEXTS), without(TEXTS, "true")),
    "subtitle.duration_match": union(row("'inconclusive'", f"{VIDEO_MS} IS NULL"), row("'fail'", f"covered_ms + 1000 < {VIDEO_MS}", "subs"), without("(SELECT * FROM subs WHERE covered_ms IS NOT NULL)", f"{VIDEO_MS} IS NOT NULL")),
    "voice.speech": union(NO_VOICE, row("CASE WHEN analysed_ms = 0 THEN 'inconclusive' ELSE 'fail' END", "analysed_ms = 0 OR speech_ms / CAST(analysed_ms AS DOUBLE) < CAST('0.3' AS DOUBLE)", SPOKEN, "v")),
    "voice.silence": union(NO_VOICE, row("'fail'", "voice_gap > 10000", SPOKEN, "v", "10", "10 + voice_gap")),
    "voice.speakers": union(NO_VOICE, row("CASE WHEN speakers IS NULL THEN 'inconclusive' ELSE 'fail' END", "speakers IS NULL OR speakers < 1 OR speakers > 3", SPOKEN, "v")),
    "voice.speaker_changes": union(NO_VOICE, row("'fail'", "analysed_ms > 0 AND changes / (analysed_ms / CAST(60000 AS DOUBLE)) > 20", SPOKEN, "v")),
    "voice.transcript": union(row("'inconclusive'", "n_voice = 0"), row("'inconclusive'", "NOT has_transcript", "voices", "v"), row("'fail'", "has_transcript AND wer > CAST('0.1' AS DOUBLE)", "voices", "v"), row("'fail'", "has_transcript AND unexpected > 2", "voices", "v")),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{r.replace('.', '_')}": partial(rule_query, r) for r in RULE_IDS}
ORACLES: dict[str, str] = {f"rule_{r.replace('.', '_')}": PRELUDE + sql for r, sql in SQL.items()}
