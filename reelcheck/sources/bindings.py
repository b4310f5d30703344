"""Measurement-shaped rows from plain relational tables, for queries without media files.

``FLAT`` and ``STREAMS`` are portable SQL over ``orders`` and ``lineitem``: all values are arithmetic on keys, so that any
engine gets the same. ``inspections`` lays them out as nested asset and inspection columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema

K = "o_orderkey"


def pick(modulus: int, *values: str, key: str = K, otherwise: str = "NULL") -> str:
    return f"CASE {key} % {modulus}" + "".join(f" WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


def maybe(modulus: int, value: str, rest: int = 0) -> str:
    """Missing for one key in ``modulus``."""
    return f"CASE WHEN {K} % {modulus} = {rest} THEN NULL ELSE {value} END"


def dbl(sql: str, scale: str) -> str:
    return f"CAST({sql} AS DOUBLE) * CAST({scale} AS DOUBLE)"


COLUMNS = {
    "asset_id": K,
    "size_bytes": "CAST(round(o_totalprice * 100) AS BIGINT)",
    "duration_s": maybe(23, f"60 + {K} % 7200"),
    "fail_on": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'info' WHEN '2' THEN 'warning' WHEN '3' THEN 'error' ELSE 'critical' END",
    "validity": pick(11, "'not_scanned'", "'{\"corrupt\":\"bad box\"}'", "'{\"unreadable\":\"cut off\"}'", otherwise="'ok'"),
    "bitrate_bps": maybe(13, f"4000000 + ({K} * 7919) % 12000000"),
    "container_ms": maybe(17, f"120000 + ({K} % 7) * 40"),
    "timecode": pick(3, "NULL", "true", "false"),
    "n_malformed": f"CASE WHEN {K} % 4 = 3 THEN {K} % 3 ELSE 0 END",
    "n_gaps": f"{K} % 3",
    "has_vm": f"{K} % 19 <> 0",
    "rate_observed": pick(4, "NULL", "'25/1'", "'24000/1001'", "'50/2'"),
    "decoded": pick(5, "NULL", "0", otherwise="3000"),
    "v_errors": pick(6, "7", "2", otherwise="0"),
    "n_segments": f"{K} % 4",
    "has_luma": f"{K} % 7 <> 0",
    "below_legal": dbl(f"{K} % 4", "0.01"),
    "above_legal": dbl(f"{K} % 3", "0.01"),
    "colorspace": pick(4, "NULL", "'bt709'", "'BT709'", "'smpte170m'"),
    "vm_order": pick(5, "NULL", "'progressive'", "'top_field_first'", "'unknown'", "'bottom_field_first'"),
    "has_flash": f"{K} % 9 <> 0",
    "n_flash": f"({K} % 5) * 3",
    "flash_step": f"40 + ({K} % 4) * 60",
    "has_hdr": f"{K} % 10 <> 9",
    "transfer": pick(5, "NULL", "'bt709'", "'smpte2084'", "'arib-std-b67'", "'PQ'"),
    "primaries": pick(3, "NULL", "'bt2020'", "'bt709'"),
    "matrix": pick(4, "NULL", "'bt2020nc'", "'BT2020c'", "'bt709'"),
    "h_range": pick(3, "'tv'", "'pc'", "NULL"),
    "has_mastering": f"{K} % 2 = 0",
    "min_nits": dbl(f"{K} % 5", "0.5"),
    "max_nits": dbl(f"({K} % 3) + 1", "1.0"),
    "max_cll": maybe(7, f"500 + ({K} % 10) * 100"),
    "max_fall": maybe(11, f"300 + ({K} % 13) * 100"),
    "dolby": f"{K} % 6 = 0",
    "has_dead": f"{K} % 8 <> 0",
    "dead_frames": f"CASE WHEN {K} % 9 = 0 THEN 0 ELSE 100 END",
    "dark_cells": f"CASE WHEN {K} % 5 = 0 THEN {K} % 7 ELSE 0 END",
    "bright_cells": f"CASE WHEN {K} % 4 = 0 THEN {K} % 3 ELSE 0 END",
    "flicker_cells": f"CASE WHEN {K} % 6 = 0 THEN 2 ELSE 0 END",
    "n_clusters": f"CASE WHEN {K} % 5 = 0 THEN {K} % 3 ELSE 0 END",
    "has_perceptual": f"{K} % 12 <> 0",
    "p_frames": f"CASE WHEN {K} % 14 = 0 THEN 0 ELSE 40 END",
    "blockiness": maybe(15, dbl(f"{K} % 30", "0.1")),
    "blockiness_max": maybe(16, dbl(f"{K} % 50", "0.1"), 1),
    "block_frames": f"{K} % 41",
    "blur": maybe(18, dbl(f"{K} % 9", "0.001"), 1),
    "noise": maybe(20, dbl(f"{K} % 40", "0.1"), 1),
    "flat_frames": f"CASE WHEN {K} % 3 = 0 THEN 39 ELSE 40 END",
    "has_am": f"{K} % 19 <> 1",
    "a_decoded": pick(7, "NULL", "0", otherwise="48000"),
    "a_errors": pick(8, "1", otherwise="0"),
    "truncated": f"{K} % 10 = 0",
    "clips": f"({K} * 3) % 21",
    "peak_db": maybe(9, dbl(f"{K} % 20", "-0.25"), 1),
    "true_peak_db": maybe(9, dbl(f"{K} % 24", "-0.25"), 2),
    "lufs": maybe(9, dbl(f"{K} % 40", "-0.25") + " - CAST(18 AS DOUBLE)", 3),
    "phase": maybe(9, dbl(f"{K} % 21", "0.1") + " - CAST(1 AS DOUBLE)", 4),
    "dc_offset": maybe(9, dbl(f"{K} % 17", "0.25") + " - CAST(2 AS DOUBLE)", 5),
    "n_voice": f"CASE {K} % 5 WHEN 0 THEN 0 WHEN 4 THEN 2 ELSE 1 END",
    "spoken": f"{K} % 7 <> 3",
    "analysed_ms": f"CASE WHEN {K} % 8 = 5 THEN 0 ELSE 60000 END",
    "speech_ms": f"({K} * 997) % 60000",
    "voice_gap": maybe(6, f"({K} * 509) % 20000", 1),
    "speakers": maybe(7, f"{K} % 6", 1),
    "changes": f"{K} % 41",
    "has_transcript": f"{K} % 5 <> 2",
    "wer": dbl(f"{K} % 20", "0.01"),
    "unexpected": f"{K} % 6",
}
FLAT = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in COLUMNS.items()) + " FROM orders"
P, S = "l_partkey", "l_suppkey"
STREAM_COLUMNS = {
    "asset_id": "l_orderkey",
    "idx": "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1",
    "kind": f"CASE WHEN {P} % 23 = 0 THEN 'data' WHEN l_returnflag = 'A' THEN 'video' WHEN l_returnflag = 'N' THEN 'audio' ELSE 'subtitle' END",
    "codec": pick(4, "'av1'", "'vp9'", "'AV1'", "NULL", key=P),
    "width": pick(5, "NULL", "1280", otherwise="1920", key=P),
    "height": pick(7, "NULL", "720", otherwise="1080", key=P),
    "pixel_format": pick(3, "NULL", "'yuv420p'", "'yuv420p10le'", key=P),
    "field_order": pick(4, "NULL", "'progressive'", "'unknown'", "'top_field_first'", key=P),
    "frame_rate": pick(3, "NULL", "'25/1'", "'30000/1001'", key=P),
    "time_base": pick(3, "NULL", "'1/12800'", "'1/90000'", key=P),
    "bitrate": f"CAST(l_quantity AS BIGINT) * 100000",
    "duration_s": f"CASE WHEN {P} % 6 = 0 THEN NULL ELSE 119 + {P} % 3 END",
    "language": pick(6, "NULL", "'eng'", "'EN-us'", "'fre'", "'fr_CA'", "'und'", key=P),
    "layout": pick(4, "NULL", "'stereo'", "'Stereo'", "'mono'", key=P),
    "channels": pick(5, "NULL", "1", otherwise="2", key=P),
    "sample_rate": pick(6, "NULL", "44100", otherwise="48000", key=P),
    "bit_depth": pick(7, "NULL", "16", otherwise="24", key=P),
    "title": pick(3, "NULL", "'Main'", "'Extra'", key=P),
    "cue_count": pick(5, "NULL", "0", otherwise="200", key=S),
    "text_decoded": f"{S} % 3 <> 0",
    "n_bad": f"{S} % 4",
    "n_overlaps": f"{S} % 3",
    "n_malformed": f"CASE WHEN {S} % 7 = 0 THEN 2 ELSE 0 END",
    "n_empty": f"CASE WHEN {S} % 6 = 1 THEN 1 ELSE 0 END",
    "max_gap_ms": f"CASE WHEN {S} % 8 = 0 THEN NULL ELSE 2000 + ({S} % 5) * 500 END",
    "max_line": f"CASE WHEN {S} % 9 = 0 THEN NULL ELSE 36 + {S} % 12 END",
    "max_lines": f"1 + {S} % 4",
    "max_cue_ms": f"5000 + ({S} % 6) * 500",
    "covered_ms": f"CASE WHEN {S} % 10 = 0 THEN NULL ELSE 117000 + ({S} % 9) * 500 END",
}
STREAMS = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in STREAM_COLUMNS.items()) + " FROM lineitem"


def ranges(n: str, start: str, length: str) -> str:
    """n ranges j = 0, 1, ...: SQL over j."""
    return f"transform(slice(array(0L, 1L, 2L, 3L), 1, cast({n} AS int)), j -> named_struct('start_ms', {start}, 'end_ms', {start} + {length}))"


#: Start and length of the j-th range of each kind, over k (the asset) or the stream.
SPANS = {"gap": ("j * 1000", "(asset_id * 31 + j * 97) % 400"), "black": ("j * 10000 + asset_id % 100", "(asset_id * 13 + j * 211) % 900"), "freeze": ("j * 9000 + asset_id % 70", "(asset_id * 17 + j * 307) % 1100"), "silence": ("j * 20000", "(asset_id * 53 + j * 701) % 8000")}


def sorted_structs(struct: str) -> str:
    return f"array_sort(collect_list({struct}), (x, y) -> cast(x.index - y.index AS int))"


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, fail_on, asset, inspection: one row for each order, its lines as streams. One shuffle, by asset."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    flat = orders.selectExpr(*[f"{sql} AS {name}" for name, sql in COLUMNS.items()])
    rows = lines.selectExpr(*[f"{sql} AS {name}" for name, sql in STREAM_COLUMNS.items()])
    stream = "named_struct('index', cast(idx AS bigint), 'kind', kind, 'codec', codec, 'codec_profile', cast(NULL AS string), 'width', cast(width AS bigint), 'height', cast(height AS bigint), 'pixel_format', pixel_format, 'field_order', field_order, 'frame_rate', frame_rate, 'time_base', time_base, 'bitrate', bitrate, 'duration', cast(duration_s AS bigint), 'language', language, 'channel_layout', layout, 'channels', cast(channels AS bigint), 'sample_rate', cast(sample_rate AS bigint), 'bit_depth', cast(bit_depth AS bigint), 'metadata', CASE WHEN title IS NULL THEN map() ELSE map('Title', title) END)"
    two = lambda n: ranges(n, "j * 100", "50L")
    subtitle = f"CASE WHEN kind = 'subtitle' THEN named_struct('index', cast(idx AS bigint), 'm', named_struct('stream_idx', cast(idx AS bigint), 'cue_count', cast(cue_count AS bigint), 'text_decoded', text_decoded, 'invalid_durations', {two('n_bad')}, 'overlaps', {two('n_overlaps')}, 'malformed', {two('n_malformed')}, 'empty_cues', {two('n_empty')}, 'max_gap_ms', cast(max_gap_ms AS bigint), 'max_line_chars', cast(max_line AS bigint), 'max_lines_per_cue', cast(max_lines AS bigint), 'max_cue_duration_ms', cast(max_cue_ms AS bigint), 'covered_until_ms', cast(covered_ms AS bigint))) END"
    nested = rows.groupBy("asset_id").agg(spark_expr(sorted_structs(stream), "streams"), spark_expr(f"transform({sorted_structs(subtitle)}, x -> x.m)", "subtitles"))
    joined = flat.join(nested, "asset_id", "left")
    pv, pa = (f"get(filter(streams, s -> s.kind = '{k}'), 0).index" for k in ("video", "audio"))
    hdr = "CASE WHEN has_hdr THEN named_struct('transfer', transfer, 'primaries', primaries, 'matrix', matrix, 'range', h_range, 'mastering_display', CASE WHEN has_mastering THEN named_struct('min_luminance_nits', min_nits, 'max_luminance_nits', max_nits, 'primaries_xy', cast(NULL AS array<array<double>>), 'white_point_xy', cast(NULL AS array<double>)) END, 'max_cll', max_cll, 'max_fall', max_fall, 'dolby_vision', dolby) END"
    dead = "CASE WHEN has_dead THEN named_struct('frames_sampled', cast(dead_frames AS bigint), 'cells_examined', 1000L, 'resolution_limited', false, 'dark_cells', cast(dark_cells AS bigint), 'bright_cells', cast(bright_cells AS bigint), 'flicker_cells', cast(flicker_cells AS bigint), 'clusters', transform(slice(array(0L, 1L, 2L, 3L), 1, cast(n_clusters AS int)), j -> named_struct('x', j, 'y', j, 'width', 1L, 'height', 1L, 'cells', 3L - j, 'kind', 'dead'))) END"
    perceptual = "CASE WHEN has_perceptual THEN named_struct('frames_sampled', cast(p_frames AS bigint), 'blockiness', blockiness, 'blockiness_max', blockiness_max, 'blockiness_frames', block_frames, 'blur', blur, 'noise', noise, 'flat_frames', cast(flat_frames AS bigint), 'resolution_limited', false) END"
    flash = "CASE WHEN has_flash THEN named_struct('transitions_ms', array(transform(slice(sequence(0L, 20L), 1, cast(n_flash AS int)), j -> j * flash_step), cast(array() AS array<bigint>))) END"
    video = f"named_struct('stream_idx', {pv}, 'frame_rate_observed', rate_observed, 'decoded_frame_count', cast(decoded AS bigint), 'decode_errors', cast(v_errors AS bigint), 'black_frames', {ranges('n_segments', *SPANS['black'])}, 'freeze_frames', {ranges('n_segments', *SPANS['freeze'])}, 'duplicate_frames', {ranges('n_segments', 'j * 100', '40L')}, 'luma', CASE WHEN has_luma THEN named_struct('min', 16, 'max', 235, 'mean', 100D, 'below_legal', below_legal, 'above_legal', above_legal, 'clipped_white', 0D) END, 'colorspace', colorspace, 'field_order', vm_order, 'flash', {flash}, 'hdr', {hdr}, 'dead_pixels', {dead}, 'perceptual', {perceptual})"
    audio = f"named_struct('stream_idx', {pa}, 'decoded_frame_count', cast(a_decoded AS bigint), 'decode_errors', cast(a_errors AS bigint), 'silence', {ranges('n_segments', *SPANS['silence'])}, 'silence_truncated', truncated, 'clipping_events', clips, 'peak_db', peak_db, 'true_peak_db', true_peak_db, 'loudness_lufs', lufs, 'loudness_range_lu', cast(NULL AS double), 'phase_correlation', phase, 'dc_offset_percent', dc_offset)"
    voice = "named_struct('stream_idx', j, 'method', 'energy', 'analysed_ms', cast(analysed_ms AS bigint), 'speech_analysed', spoken, 'speech_regions', array(), 'speech_ms', speech_ms, 'longest_non_speech', CASE WHEN voice_gap IS NOT NULL THEN named_struct('start_ms', 10L, 'end_ms', 10L + voice_gap) END, 'speaker_turns', array(), 'speaker_count', speakers, 'speaker_changes', changes, 'transcript', CASE WHEN has_transcript THEN named_struct('source', 'txt', 'expected_words', 100L, 'hypothesis_words', 100L, 'substitutions', 0L, 'deletions', 0L, 'insertions', 0L, 'wer', wer, 'unexpected_words', array(), 'unexpected_total', unexpected) END)"
    asset = f"cast(named_struct('id', cast(asset_id AS string), 'path', concat('/media/', asset_id, '.mkv'), 'fingerprint', NULL, 'size_bytes', size_bytes, 'modified_time', NULL, 'duration', duration_s, 'streams', streams) AS {schema.ASSET})"
    container = f"named_struct('validity', validity, 'format', 'matroska', 'bitrate_bps', bitrate_bps, 'duration', container_ms, 'timestamps_contiguous', n_gaps = 0, 'timecode_present', timecode, 'timestamp_gaps', {ranges('n_gaps', *SPANS['gap'])}, 'malformed_metadata', slice(array('first', 'second', 'third'), 1, cast(n_malformed AS int)), 'decode_errors', 0L)"
    inspection = f"cast(named_struct('streams', streams, 'container', {container}, 'video', CASE WHEN has_vm AND {pv} IS NOT NULL THEN array({video}) ELSE array() END, 'audio', CASE WHEN has_am AND {pa} IS NOT NULL THEN array({audio}) ELSE array() END, 'subtitle', coalesce(subtitles, array()), 'voice', transform(slice(array(0L, 1L), 1, cast(n_voice AS int)), j -> {voice}), 'diagnostics', NULL) AS {schema.INSPECTION})"
    return joined.selectExpr("asset_id", "fail_on", f"{asset} AS asset", f"{inspection} AS inspection")


def spark_expr(sql: str, name: str):  # noqa: ANN201
    from pyspark.sql import functions as F

    return F.expr(sql).alias(name)
