"""Profiles: strict reading of YAML documents into plain dicts with defaults, and their hashes."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..functions.scalars import rational_parts, rational_text
from ..rules.custom import OPERATORS, metric

NEEDED = object()
SEVERITY_NAMES = {"info": "info", "information": "info", "warning": "warning", "warn": "warning", "error": "error", "fail": "error", "critical": "critical", "fatal": "critical"}
GROUPS = ("container", "video", "audio", "subtitle", "voice")
MOST_RULES = 256


class ProfileError(ValueError):
    """What is wrong, and where."""

    def __init__(self, where: str, what: str):
        super().__init__(f"{where}: {what}")


def severity(value: Any, where: str) -> str:
    name = SEVERITY_NAMES.get(str(value).strip().lower()) if isinstance(value, str) else None
    if name is None:
        raise ProfileError(where, f"unknown severity {value!r}")
    return name


def whole(v: Any, where: str) -> int:
    if isinstance(v, bool) or not isinstance(v, int) or v < 0:
        raise ProfileError(where, f"expected a whole number, got {v!r}")
    return v


def real(v: Any, where: str) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
        raise ProfileError(where, f"expected a number, got {v!r}")
    return float(v)


def words(v: Any, where: str) -> str:
    if not isinstance(v, str):
        raise ProfileError(where, f"expected a string, got {v!r}")
    return v


def flag(v: Any, where: str) -> bool:
    if not isinstance(v, bool):
        raise ProfileError(where, f"expected true or false, got {v!r}")
    return v


def ratio(v: Any, where: str) -> str:
    try:
        return rational_text(str(v).replace(":", "/"))
    except ValueError as e:
        raise ProfileError(where, f"expected a ratio, got {v!r}") from e


def codes(v: Any, where: str) -> list[str]:
    items = v if isinstance(v, list) else [v]
    if not items or any(not isinstance(x, str) or not x.strip() for x in items):
        raise ProfileError(where, f"expected language codes, got {v!r}")
    return items


def one_of(*names: str, **aliases: str):  # noqa: ANN201
    def read(v: Any, where: str) -> str:
        name = str(v).strip().lower()
        name = aliases.get(name, name)
        if name not in names:
            raise ProfileError(where, f"unknown value {v!r} (expected {', '.join(names)})")
        return name

    return read


#: Keys, readers and defaults of each rule; NEEDED has no default. The names of severity-only rules have their default severity.
SEVERITY_ONLY = {"container.readable": "error", "container.container_validity": "error", "container.malformed_metadata": "warning", "container.timecode_present": "info", "container.unexpected_streams": "warning"}
KEYS: dict[str, dict[str, tuple]] = {
    "container.duration_consistency": {"tolerance_ms": (whole, NEEDED)},
    "container.bitrate": {"min_bps": (whole, NEEDED)},
    "container.timebase": {"value": (ratio, NEEDED)},
    "container.timestamp_continuity": {"max_gap_ms": (whole, 150)},
    "container.stream_presence": {"min_video": (whole, 1), "min_audio": (whole, 0), "max_streams": (whole, 32)},
    "video.resolution": {"expected": (words, NEEDED)},
    "video.frame_rate": {"expected": (ratio, NEEDED), "tolerance": (real, 0.001)},
    "video.aspect_ratio": {"expected": (ratio, NEEDED), "tolerance": (real, 0.005)},
    "video.color_space": {"expected": (words, NEEDED)},
    "video.scan_format": {"scan": (one_of("progressive", "interlaced", "any"), "any"), "field_order": (one_of("any", "top_field_first", "bottom_field_first", tff="top_field_first", bff="bottom_field_first"), "any")},
    "video.black_frames": {"max_duration_ms": (whole, NEEDED)},
    "video.freeze_frames": {"max_duration_ms": (whole, NEEDED)},
    "video.duplicate_frames": {"max_events": (whole, NEEDED)},
    "video.corrupt_frames": {"max_events": (whole, NEEDED)},
    "video.luma_range": {"max_out_of_legal": (real, 0.01)},
    "video.photosensitivity": {"max_flashes_per_second": (real, 3.0)},
    "video.hdr": {"mode": (one_of("sdr", "hdr10", "hlg", "hdr", pq="hdr10", any_hdr="hdr"), NEEDED), "require_static_metadata": (flag, True), "max_cll_nits": (whole, None), "max_fall_nits": (whole, None)},
    "video.dead_pixels": {"max_pixels": (whole, 0), "max_clusters": (whole, 0), "include_flicker": (flag, True), "fail_on_limited_resolution": (flag, False)},
    "video.blockiness": {"max_ratio": (real, NEEDED), "max_frame_ratio": (real, None), "min_evidence_share": (real, 0.5)},
    "video.blur": {"min_sharpness": (real, NEEDED)},
    "video.noise": {"max_sigma": (real, NEEDED), "min_evidence_share": (real, 1.0)},
    "audio.sample_rate": {"expected": (whole, NEEDED)},
    "audio.bit_depth": {"expected": (whole, NEEDED)},
    "audio.channel_layout": {"channels": (whole, NEEDED), "layout": (words, None)},
    "audio.silence": {"max_duration_ms": (whole, NEEDED)},
    "audio.clipping": {"max_events": (whole, NEEDED)},
    "audio.peak": {"max_db": (real, NEEDED)},
    "audio.true_peak": {"max_db": (real, NEEDED)},
    "audio.loudness": {"standard": (one_of("ebu-r128", "atsc-a85", "bs1770", "custom", **{"ebu_r128": "ebu-r128", "atsc_a85": "atsc-a85"}), "ebu-r128"), "target_lufs": (real, -23.0), "tolerance_lu": (real, 1.0)},
    "audio.phase": {"min_correlation": (real, -0.5)},
    "audio.dc_offset": {"max_offset_percent": (real, 5.0)},
    "subtitle.presence": {"min_subtitle": (whole, 1), "max_subtitle": (whole, None)},
    "subtitle.language": {"required": (codes, NEEDED), "min_tracks": (whole, 1)},
    "subtitle.timing": {"max_overlaps": (whole, 0), "max_invalid_durations": (whole, 0), "max_gap_ms": (whole, None), "max_cue_duration_ms": (whole, None)},
    "subtitle.content": {"max_malformed": (whole, 0), "max_empty": (whole, 0), "max_chars_per_line": (whole, None), "max_lines_per_cue": (whole, None)},
    "subtitle.duration_match": {"tolerance_ms": (whole, 1000), "allow_longer": (flag, True)},
    "voice.speech": {"expect": (one_of("present", "absent"), "present"), "min_ratio": (real, 0.05)},
    "voice.silence": {"max_non_speech_ms": (whole, NEEDED)},
    "voice.speakers": {"min": (whole, None), "max": (whole, None)},
    "voice.speaker_changes": {"max_per_minute": (real, NEEDED)},
    "voice.transcript": {"max_wer": (real, NEEDED), "max_unexpected_words": (whole, 0)},
}
#: A rule may be given as the value of this key alone.
SHORT = {"container.timebase": "value", "video.resolution": "expected", "video.frame_rate": "expected", "video.aspect_ratio": "expected", "video.color_space": "expected", "audio.sample_rate": "expected", "audio.bit_depth": "expected"}
#: Rules that know all their keys; others let unknown ones pass.
STRICT = {"video.dead_pixels", "video.blockiness", "video.blur", "video.noise"}
RULE_IDS = [*SEVERITY_ONLY, *KEYS]


@dataclass(frozen=True)
class Profile:
    name: str
    version: int
    rules: dict[str, dict[str, Any]]  # by rule id
    custom: list[dict[str, Any]] = field(default_factory=list)
    plugins: list[dict[str, Any]] = field(default_factory=list)
    fail_on: str = "error"

    def digest(self) -> str:
        """Of everything that bears on results; descriptions and comments don't."""
        return sha256({"name": self.name, "version": self.version, "rules": self.rules, "custom": self.custom, "plugins": self.plugins, "fail_on": self.fail_on})

    def config_hash(self, rule_id: str) -> str | None:
        """Of one rule's settings; none for what isn't configured and for plug-ins, whose results are never cached."""
        if rule_id in self.rules:
            return sha256(self.rules[rule_id])
        return next((sha256(c) for c in self.custom if c["id"] == rule_id), None)


def sha256(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def mapping(value: Any, where: str) -> dict[str, Any]:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ProfileError(where, f"{value!r} is no table of names and values")
    return {str(k): v for k, v in value.items()}


def known(found: dict[str, Any], allowed: Any, where: str) -> None:
    for k in found:
        if k not in allowed:
            raise ProfileError(where, f"unknown key {k!r}")


def read_rule(rule_id: str, value: Any) -> dict[str, Any]:
    where = f"rules.{rule_id}"
    if rule_id in SEVERITY_ONLY:
        own = value.get("severity", SEVERITY_ONLY[rule_id]) if isinstance(value, dict) else value
        return {"severity": severity(own, where)}
    keys, out = KEYS[rule_id], {}
    if not isinstance(value, dict):
        if rule_id in SHORT:
            value = {SHORT[rule_id]: value}
        elif isinstance(value, str) and value.strip().lower() in SEVERITY_NAMES:
            value = {"severity": value}
        else:
            raise ProfileError(where, f"{value!r} is no table of names and values")
    if rule_id in STRICT or rule_id.split(".")[0] in ("subtitle", "voice"):
        known(value, {*keys, "severity"}, where)
    # an unknown severity in a mapping counts as none
    out["severity"] = SEVERITY_NAMES.get(str(value.get("severity", "")).strip().lower(), "warning")
    for name, (read, default) in keys.items():
        given = value.get(name)
        if given is None:
            if default is NEEDED:
                raise ProfileError(where, f"missing {name!r}")
            out[name] = default
        else:
            out[name] = read(given, f"{where}.{name}")
    if rule_id == "video.resolution":
        m = re.fullmatch(r"\s*(\d+)\s*[xX]\s*(\d+)\s*", out["expected"])
        if not m:
            raise ProfileError(where, f"expected WIDTHxHEIGHT, got {out['expected']!r}")
        out |= {"width": int(m[1]), "height": int(m[2])}
    if rule_id == "voice.speakers" and out["min"] is None and out["max"] is None:
        raise ProfileError(where, "min or max is needed")
    if rule_id in ("container.timebase", "video.frame_rate") and rational_parts(out.get("value") or out.get("expected"))[0] == 0:
        raise ProfileError(where, "zero is no rate")
    return out


def read_custom(value: Any, where: str) -> dict[str, Any]:
    m = mapping(value, where)
    known(m, ("id", "scope", "streams", "metric", "op", "value", "tolerance", "severity", "message"), where)
    for key in ("id", "scope", "metric", "op"):
        words(m.get(key), f"{where}.{key}")
    if not re.fullmatch(r"custom\.[a-z0-9_]+", m["id"]):
        raise ProfileError(f"{where}.id", f"{m['id']!r} must look like custom.snake_case_name")
    scope = one_of("container", "video", "audio", "subtitle")(m["scope"], f"{where}.scope")
    streams = one_of("all", "primary")(m.get("streams", "all"), f"{where}.streams")
    if scope == "container" and "streams" in m:
        raise ProfileError(f"{where}.streams", "is for rules about streams only")
    try:
        _, number = metric(scope, m["metric"])
    except ValueError as e:
        raise ProfileError(f"{where}.metric", str(e)) from e
    op = OPERATORS.get(m["op"].strip().lower())
    if op is None:
        raise ProfileError(f"{where}.op", f"unknown operator {m['op']!r}")
    if "value" not in m:
        raise ProfileError(where, "a rule without a value to compare with")
    values = m["value"] if isinstance(m["value"], list) else [m["value"]]
    values = [str(v).lower() if isinstance(v, bool) else v for v in values]
    if not values or (op not in ("in", "not_in") and len(values) != 1):
        raise ProfileError(f"{where}.value", "takes one value (in and not_in: one or more)")
    if op in ("<", "<=", ">", ">=") and not number:
        raise ProfileError(f"{where}.op", "orders numbers, and this metric is text")
    for v in values:
        if not isinstance(v, str | int | float) or isinstance(v, str) == number or (isinstance(v, float) and not math.isfinite(v)):
            raise ProfileError(f"{where}.value", f"{v!r} does not fit the metric")
    tolerance = real(m.get("tolerance", 0.0), f"{where}.tolerance")
    if tolerance < 0 or (tolerance > 0 and (not number or op not in ("==", "!="))):
        raise ProfileError(f"{where}.tolerance", "only applies to numeric == and !=")
    return {"id": m["id"], "scope": scope, "streams": streams, "metric": m["metric"], "op": op, "value": values, "tolerance": tolerance, "severity": severity(m.get("severity", "error"), f"{where}.severity"), "message": m.get("message")}


def read_plugin(value: Any, where: str) -> dict[str, Any]:
    m = mapping(value, where)
    known(m, ("rule", "severity", "config"), where)
    rule = words(m.get("rule"), f"{where}.rule")
    if not re.fullmatch(r"[a-z0-9_]+(\.[a-z0-9_]+)+", rule) or rule.split(".")[0] in (*GROUPS, "custom"):
        raise ProfileError(f"{where}.rule", f"{rule!r} is no plug-in rule id")
    return {"rule": rule, "severity": severity(m.get("severity", "error"), f"{where}.severity"), "config": m.get("config")}


def several(value: Any, read: Any, name: str, where: str) -> list[dict[str, Any]]:
    if value is None:
        return []
    if not isinstance(value, list) or len(value) > MOST_RULES:
        raise ProfileError(where, f"expected a list of at most {MOST_RULES} rules")
    out = [read(v, f"{where}[{i}]") for i, v in enumerate(value)]
    for i, r in enumerate(out):
        if r[name] in [x[name] for x in out[:i]]:
            raise ProfileError(f"{where}[{i}]", f"duplicate id {r[name]!r}")
    return out


def parse(text: str) -> Profile:
    try:
        root = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ProfileError("$", f"no YAML: {e}") from e
    if not isinstance(root, dict):
        raise ProfileError("$", "a profile is a table of names and values")
    known(root, ("name", "version", "rules", "policy", "description", "comment"), "$")
    if not isinstance(root.get("name"), str) or not root["name"].strip():
        raise ProfileError("name", "is needed")
    groups = mapping(root.get("rules"), "rules")
    known(groups, (*GROUPS, "custom", "plugins"), "rules")
    rules = {}
    for group in GROUPS:
        own = mapping(groups.get(group), f"rules.{group}")
        known(own, [r.split(".")[1] for r in RULE_IDS if r.startswith(group + ".")], f"rules.{group}")
        rules |= {f"{group}.{k}": read_rule(f"{group}.{k}", v) for k, v in own.items()}
    policy = mapping(root.get("policy"), "policy")
    return Profile(root["name"], whole(root.get("version", 1), "version"), rules, several(groups.get("custom"), read_custom, "id", "rules.custom"), several(groups.get("plugins"), read_plugin, "rule", "rules.plugins"), severity(policy.get("fail_on", "error"), "policy.fail_on"))


def bundled() -> dict[str, Path]:
    return {p.stem: p for p in sorted(Path(__file__).parent.glob("bundled/*.yaml"))}


def load(name_or_path: str) -> Profile:
    """A bundled profile by name, or a file."""
    path = bundled().get(name_or_path) or Path(name_or_path)
    return parse(path.read_text(encoding="utf-8"))
