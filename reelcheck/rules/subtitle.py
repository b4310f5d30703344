"""Subtitle rules, over all subtitle streams (``subs``: stream s and its measurement m)."""

from __future__ import annotations

from ..functions.scalars import language, language_of
from .base import Rule, cases, each, one, several, text

TAG = "coalesce(x.s.language, 'untagged')"
UNSCANNED = ("NOT scanned", "'the container was not scanned'")


def presence(c: dict) -> str:
    r = Rule("subtitle.presence", c["severity"])
    checks = [(UNSCANNED[0], one(r.unknown(UNSCANNED[1]))), (f"size(subs) < {c['min_subtitle']}", one(r.fail("concat(size(subs), ' subtitle tracks are too few')", measured="size(subs)", expected=text(c["min_subtitle"]))))]
    if c.get("max_subtitle") is not None:
        checks.append((f"size(subs) > {c['max_subtitle']}", one(r.fail("concat(size(subs), ' subtitle tracks are too many')", measured="size(subs)", expected=text(c["max_subtitle"])))))
    return cases(*checks)


def languages(c: dict) -> str:
    r = Rule("subtitle.language", c["severity"])
    n = lambda code: f"size(filter(subs, x -> {language('x.s.language')} = {text(language_of(code))}))"
    tags = "array_join(transform(filter(subs, x -> x.s.language IS NOT NULL), x -> x.s.language), ', ')"
    missing = several(*[(f"{n(code)} < {c['min_tracks']}", r.fail(f"concat('subtitle language {code} has ', {n(code)}, ' tracks (found: ', {tags}, ')')", measured=tags, expected=text(code))) for code in c["required"]])
    return cases((UNSCANNED[0], one(r.unknown(UNSCANNED[1]))), ("size(subs) = 0", one(r.fail("'no subtitle tracks to carry the required languages'", measured="0", expected=text(c["min_tracks"])))), otherwise=missing)


def over_tracks(condition: str, *parts: str) -> str:
    """All findings of the tracks for which the condition holds, track by track."""
    return f"flatten(transform(filter(subs, x -> {condition}), x -> concat({', '.join(parts)})))"


def all_or_none(r: Rule, field: str, most: int, message: str) -> str:
    """Every range of the list once there are more than allowed."""
    return f"CASE WHEN size(coalesce(x.m.{field}, array())) > {most} THEN {each(f'x.m.{field}', 'g', 'true', r.fail(f"concat('subtitle cue [', {TAG}, '] {message}')", start='g.start_ms', end='g.end_ms'))} ELSE array() END"


def limit(r: Rule, field: str, c: dict, key: str, message: str) -> list[str]:
    if c.get(key) is None:
        return []
    return [f"CASE WHEN x.m.{field} > {c[key]} THEN {one(r.fail(f"concat('subtitle track [', {TAG}, '] {message} ', x.m.{field})", measured=f'x.m.{field}', expected=text(c[key])))} ELSE array() END"]


def timing(c: dict) -> str:
    r = Rule("subtitle.timing", c["severity"])
    measured = "x.m.cue_count IS NOT NULL"
    found = over_tracks(measured, all_or_none(r, "invalid_durations", c["max_invalid_durations"], "is over before it begins"), all_or_none(r, "overlaps", c["max_overlaps"], "runs on into the cue that follows"), *limit(r, "max_gap_ms", c, "max_gap_ms", "leaves a gap of"), *limit(r, "max_cue_duration_ms", c, "max_cue_duration_ms", "shows a cue for"))
    return cases((f"NOT exists(subs, x -> {measured})", one(r.unknown("'cue timing was not measured'"))), otherwise=found)


def content(c: dict) -> str:
    """Without any track of decoded text the result is one inconclusive finding, whatever else was found."""
    r = Rule("subtitle.content", c["severity"])
    measured = "coalesce(x.m.cue_count, 0L) > 0"
    decoded = f"{measured} AND coalesce(x.m.text_decoded, false)"
    text_limits = [part.replace("CASE WHEN", "CASE WHEN coalesce(x.m.text_decoded, false) AND", 1) for part in (*limit(r, "max_line_chars", c, "max_chars_per_line", "has a line of"), *limit(r, "max_lines_per_cue", c, "max_lines_per_cue", "has lines in a cue:"))]
    found = over_tracks(measured, all_or_none(r, "malformed", c["max_malformed"], "holds bytes that are no text"), all_or_none(r, "empty_cues", c["max_empty"], "shows nothing"), *text_limits)
    return cases((f"NOT exists(subs, x -> {decoded})", one(r.unknown("'cue text was not decoded'"))), otherwise=found)


VIDEO_MS = "coalesce(pv.duration * 1000, container.duration)"


def duration_match(c: dict) -> str:
    r, slack, v = Rule("subtitle.duration_match", c["severity"]), c["tolerance_ms"], VIDEO_MS
    short = f"CASE WHEN x.m.covered_until_ms + {slack} < {v} THEN {one(r.fail(f"concat('subtitle track [', {TAG}, '] ends early')", measured='x.m.covered_until_ms', expected=v))} ELSE array() END"
    parts = [short]
    if not c["allow_longer"]:
        parts.append(f"CASE WHEN x.m.covered_until_ms > {v} + {slack} THEN {one(r.fail(f"concat('subtitle track [', {TAG}, '] runs past the video')", measured='x.m.covered_until_ms', expected=v))} ELSE array() END")
    measured = "x.m.covered_until_ms IS NOT NULL"
    return cases((f"{v} IS NULL", one(r.unknown("'there is no video length to compare with'"))), (f"NOT exists(subs, x -> {measured})", one(r.unknown("'cue timing was not measured'"))), otherwise=over_tracks(measured, *parts))


BUILDERS = {"presence": presence, "language": languages, "timing": timing, "content": content, "duration_match": duration_match}
