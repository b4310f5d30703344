"""Declarative rules of a profile: a metric of the container or of streams, compared with a value."""

from __future__ import annotations

from ..functions.scalars import rational_value
from .base import Rule, cases, one, text

#: Aliases of comparison operators.
OPERATORS = {"=": "==", "eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "one_of": "in", "none_of": "not_in"} | {o: o for o in ("==", "!=", "<", "<=", ">", ">=", "in", "not_in")}
count = lambda kind: f"size(filter(streams, s -> s.kind = '{kind}'))"
CONTAINER = {"duration_seconds": "asset_duration", "size_bytes": "asset_size", "stream_count": "size(streams)"} | {f"{k}_stream_count": count(k) for k in ("video", "audio", "subtitle")}
NUMBERS = {"width": "s.width", "height": "s.height", "frame_rate": rational_value("s.frame_rate"), "bitrate": "s.bitrate", "duration_seconds": "s.duration", "channels": "s.channels", "sample_rate": "s.sample_rate", "bit_depth": "s.bit_depth"}
TEXTS = {"codec": "s.codec", "codec_profile": "s.codec_profile", "pixel_format": "s.pixel_format", "field_order": "s.field_order", "language": "s.language", "channel_layout": "s.channel_layout"}
LEAST_TOLERANCE = 1e-9


#: The metrics that each kind of stream offers, besides metadata.<key>.
COMMON = ("codec", "codec_profile", "language", "bitrate", "duration_seconds")
OFFERED = {"video": (*COMMON, "width", "height", "frame_rate", "pixel_format", "field_order"), "audio": (*COMMON, "channels", "channel_layout", "sample_rate", "bit_depth"), "subtitle": COMMON}


def metric(scope: str, name: str) -> tuple[str, bool]:
    """SQL of a metric and whether it is a number."""
    if scope == "container":
        if name not in CONTAINER:
            raise ValueError(f"unknown container metric {name!r}")
        return CONTAINER[name], True
    if name in NUMBERS and name in OFFERED[scope]:
        return NUMBERS[name], True
    if name in TEXTS and name in OFFERED[scope]:
        return TEXTS[name], False
    if name.startswith("metadata.") and len(name) > 9:
        key = text(name[9:].lower())
        return f"get(map_values(map_filter(s.metadata, (k, v) -> lower(k) = {key})), 0)", False
    raise ValueError(f"unknown {scope} metric {name!r}")


def holds(value: str, number: bool, op: str, wanted: object, tolerance: float) -> str:
    items = wanted if isinstance(wanted, list) else [wanted]
    if number:
        v = f"cast({value} AS double)"
        if op in ("<", "<=", ">", ">="):
            return f"{v} {op} {float(items[0])!r}D"
        near = " OR ".join(f"abs({v} - {float(w)!r}D) <= {max(tolerance, LEAST_TOLERANCE)!r}D" for w in items)
    else:
        near = f"lower({value}) IN ({', '.join(text(str(w).lower()) for w in items)})"
    return f"({near})" if op in ("==", "in") else f"NOT ({near})"


def build(c: dict) -> str:
    """Holds: nothing. Metric missing: inconclusive. Else a failure, with the rule's own message if it has one. Streams of the kind that aren't there pass."""
    r, op = Rule(c["id"], c["severity"]), OPERATORS[c["op"]]
    value, number = metric(c["scope"], c["metric"])
    good = holds(value, number, op, c["value"], c.get("tolerance") or 0.0)
    expected = text(f"{op} {c['value']}")
    says = f"concat({text(c['message'] + ' (' + c['metric'] + ': ')}, {value}, ')')" if c.get("message") else f"concat('{c['metric']} is ', {value})"
    if c["scope"] == "container":
        return cases((f"{value} IS NULL", one(r.unknown(f"'{c['metric']} was not measured'", expected=expected))), (f"NOT ({good})", one(r.fail(says, measured=value, expected=expected))))
    chosen = f"filter(streams, s -> s.kind = '{c['scope']}')"
    if c.get("streams", "all") == "primary":
        chosen = f"slice({chosen}, 1, 1)"
    found = f"CASE WHEN {value} IS NULL THEN {r.unknown(f"'{c['metric']} was not measured'", expected=expected, stream='s.index')} ELSE {r.fail(says, measured=value, expected=expected, stream='s.index')} END"
    return f"transform(filter({chosen}, s -> {value} IS NULL OR NOT ({good})), s -> {found})"
