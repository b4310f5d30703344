"""Building blocks of rules: SQL texts that give arrays of findings.

A rule is one expression over the columns of ``CONTEXT``: an empty array is a pass.  Values of the profile get in as literals only.  Nothing here is a join or a shuffle.
"""

from __future__ import annotations

from ..schema import FINDINGS, RANGE

NONE = f"cast(array() AS {FINDINGS})"
#: Columns that rules share, in order of their definition.
CONTEXT = {
    "container": "inspection.container",
    "asset_duration": "asset.duration",
    "asset_size": "asset.size_bytes",
    "streams": "CASE WHEN size(inspection.streams) > 0 THEN inspection.streams ELSE coalesce(asset.streams, array()) END",
    "scanned": "coalesce(inspection.container.validity, 'not_scanned') <> 'not_scanned'",
    "pv": "get(filter(streams, s -> s.kind = 'video'), 0)",
    "pa": "get(filter(streams, s -> s.kind = 'audio'), 0)",
    "vm": "get(filter(inspection.video, m -> m.stream_idx = pv.index), 0)",
    # an audio measurement counts once something was decoded
    "am": "CASE WHEN get(filter(inspection.audio, m -> m.stream_idx = pa.index), 0).decoded_frame_count > 0 THEN get(filter(inspection.audio, m -> m.stream_idx = pa.index), 0) END",
    "subs": "transform(filter(streams, s -> s.kind = 'subtitle'), s -> struct(s AS s, get(filter(inspection.subtitle, m -> m.stream_idx = s.index), 0) AS m))",
    "voices": "coalesce(inspection.voice, array())",
}


def text(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def finding(rule: str, status: str, severity: str, message: str, measured: str = "NULL", expected: str = "NULL", stream: str = "NULL", start: str | None = None, end: str | None = None, evidence: str = "NULL") -> str:
    """One finding; message, measured, expected, stream, start, end and evidence are SQL."""
    span = f"named_struct('start_ms', {start}, 'end_ms', {end})" if start else f"cast(NULL AS {RANGE})"
    return f"named_struct('rule_id', '{rule}', 'status', '{status}', 'severity', '{severity}', 'message', cast({message} AS string), 'measured', cast({measured} AS string), 'expected', cast({expected} AS string), 'stream_idx', cast({stream} AS bigint), 'time_range', {span}, 'evidence', cast({evidence} AS string))"


class Rule:
    """Short forms for one rule id and severity."""

    def __init__(self, rule: str, severity: str):
        self.rule, self.severity = rule, severity

    def fail(self, message: str, **more: str) -> str:
        return finding(self.rule, "fail", self.severity, message, **more)

    def unknown(self, message: str, **more: str) -> str:
        return finding(self.rule, "inconclusive", self.severity, message, **more)

    def info(self, message: str, **more: str) -> str:
        return finding(self.rule, "pass", "info", message, **more)

    def say(self, message: str, **more: str) -> str:
        """A pass at the rule's own severity."""
        return finding(self.rule, "pass", self.severity, message, **more)


def one(found: str) -> str:
    return f"array({found})"


def cases(*pairs: tuple[str, str], otherwise: str = NONE) -> str:
    """The first condition that holds decides; each result is an array of findings."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {result}" for condition, result in pairs) + f" ELSE {otherwise} END"


def several(*found: tuple[str, str]) -> str:
    """All findings whose condition holds, in order."""
    return f"array_compact(array({', '.join(f'CASE WHEN {c} THEN {f} END' for c, f in found)}))"


def each(items: str, name: str, condition: str, found: str) -> str:
    """A finding for each item for which the condition holds."""
    return f"transform(filter(coalesce({items}, array()), {name} -> {condition}), {name} -> {found})"


def length(span: str) -> str:
    return f"greatest({span}.end_ms - {span}.start_ms, 0L)"
