"""Container rules."""

from __future__ import annotations

from ..functions.scalars import rational_text
from .base import Rule, cases, each, length, one, several, text

C = "container"
KIND = f"regexp_extract(coalesce({C}.validity, 'not_scanned'), '(not_scanned|unreadable|corrupt|ok)', 1)"
REASON = f"regexp_extract({C}.validity, ':\\\\s*\"(.*)\"', 1)"


def readable(c: dict) -> str:
    r = Rule("container.readable", c["severity"])
    return cases(("NOT scanned", one(r.unknown("'the container was not scanned'"))), (f"{KIND} IN ('unreadable', 'corrupt')", one(r.fail(f"concat('the container is ', {KIND}, ': ', {REASON})", measured=KIND))))


def container_validity(c: dict) -> str:
    r = Rule("container.container_validity", c["severity"])
    return cases(("NOT scanned", one(r.unknown("'the container was not scanned'"))), (f"{KIND} = 'corrupt'", one(r.fail(f"concat('the container is corrupt: ', {REASON})", measured=KIND))))


def malformed_metadata(c: dict) -> str:
    return each(f"{C}.malformed_metadata", "x", "true", Rule("container.malformed_metadata", c["severity"]).fail("concat('malformed metadata: ', x)", measured="x"))


def duration_consistency(c: dict) -> str:
    r = Rule("container.duration_consistency", c["severity"])
    tolerance = c["tolerance_ms"]
    known = f"filter(concat(array({C}.duration), transform(streams, s -> s.duration * 1000)), x -> x IS NOT NULL)"
    pairs = f"flatten(transform({known}, (a, i) -> transform(filter({known}, (b, j) -> j > i AND abs(a - b) > {tolerance}), b -> {r.fail("concat('durations differ by ', abs(a - b), ' ms')", measured='b', expected='a')})))"
    return cases((f"size({known}) = 0", one(r.unknown("'no duration was reported'"))), (f"size({pairs}) > 0", pairs), otherwise=one(r.info("'durations are consistent'")))


def bitrate(c: dict) -> str:
    r = Rule("container.bitrate", c["severity"])
    b = f"{C}.bitrate_bps"
    return cases(("NOT scanned", one(r.unknown("'the container was not scanned'"))), (f"{b} IS NULL", one(r.unknown("'no bitrate was reported'"))), (f"{b} < {c['min_bps']}", one(r.fail(f"concat('bitrate ', {b}, ' is below the minimum')", measured=b, expected=text(c["min_bps"])))), otherwise=one(r.info(f"concat('bitrate is ', {b})", measured=b)))


def timecode_present(c: dict) -> str:
    r = Rule("container.timecode_present", c["severity"])
    t = f"{C}.timecode_present"
    return cases((f"{t} IS NULL", one(r.unknown("'timecode was not looked for'"))), (f"NOT {t}", one(r.fail("'no timecode is present'", measured="'false'", expected="'true'"))))


def timebase(c: dict) -> str:
    r = Rule("container.timebase", c["severity"])
    videos = "filter(streams, s -> s.kind = 'video')"
    wanted = rational_text(c["value"])
    found = f"transform(filter({videos}, s -> s.time_base IS NULL OR s.time_base <> '{wanted}'), s -> CASE WHEN s.time_base IS NULL THEN {r.unknown("'the stream reported no time base'", stream='s.index')} ELSE {r.fail("concat('time base is ', s.time_base)", measured='s.time_base', expected=text(wanted), stream='s.index')} END)"
    return cases((f"size({found}) > 0", found), (f"size({videos}) > 0", one(r.info(f"'time base is {wanted}'"))))


def timestamp_continuity(c: dict) -> str:
    r = Rule("container.timestamp_continuity", c["severity"])
    gaps, most = f"coalesce({C}.timestamp_gaps, array())", c["max_gap_ms"]
    found = each(gaps, "g", f"{length('g')} > {most}", r.fail(f"concat('timestamp gap of ', {length('g')}, ' ms')", measured=length("g"), expected=text(most), start="g.start_ms", end="g.end_ms"))
    return cases(("NOT scanned", one(r.unknown("'the container was not scanned'"))), (f"size({gaps}) = 0", one(r.info("'timestamps are continuous'"))), otherwise=found)


def unexpected_streams(c: dict) -> str:
    r = Rule("container.unexpected_streams", c["severity"])
    found = each("streams", "s", "s.kind IN ('data', 'attachment', 'unknown')", r.fail("concat('unexpected ', s.kind, ' stream')", measured="s.kind", stream="s.index"))
    return cases((f"size({found}) > 0", found), ("size(streams) > 0", one(r.info("'only expected streams are present'"))))


def stream_presence(c: dict) -> str:
    r = Rule("container.stream_presence", c["severity"])
    n = lambda kind: f"size(filter(streams, s -> s.kind = '{kind}'))"
    found = several(*[(f"{n(k)} < {c[f'min_{k}']}", r.fail(f"concat({n(k)}, ' {k} stream(s), at least {c[f'min_{k}']} required')", measured=n(k), expected=text(c[f"min_{k}"]))) for k in ("video", "audio")], (f"size(streams) > {c['max_streams']}", r.fail("concat(size(streams), ' streams are too many')", measured="size(streams)", expected=text(c["max_streams"]))))
    return cases(("NOT scanned", one(r.unknown("'the container was not scanned'"))), otherwise=found)


BUILDERS = {"readable": readable, "container_validity": container_validity, "malformed_metadata": malformed_metadata, "duration_consistency": duration_consistency, "bitrate": bitrate, "timecode_present": timecode_present, "timebase": timebase, "timestamp_continuity": timestamp_continuity, "unexpected_streams": unexpected_streams, "stream_presence": stream_presence}
