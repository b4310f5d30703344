"""Audio rules, over the first audio stream."""

from __future__ import annotations

from .base import Rule, cases, each, length, one, text

UNMEASURED = "'audio was not measured'"
ERRORS = ("am.decode_errors > 0", "'decode had errors, so the result may be incomplete'")


def reported(rule: str, field: str, c: dict) -> str:
    r = Rule(rule, c["severity"])
    return cases(("pa IS NULL", one(r.unknown("'there is no audio stream'"))), (f"pa.{field} IS NULL", one(r.unknown(f"'the audio stream reported no {field}'"))), (f"pa.{field} <> {c['expected']}", one(r.fail(f"concat('{field} is ', pa.{field})", measured=f"pa.{field}", expected=text(c["expected"]), stream="pa.index"))))


def channel_layout(c: dict) -> str:
    r = Rule("audio.channel_layout", c["severity"])
    checks = [("pa IS NULL", one(r.unknown("'there is no audio stream'"))), ("pa.channels IS NULL", one(r.unknown("'the audio stream reported no channels'"))), (f"pa.channels <> {c['channels']}", one(r.fail("concat(pa.channels, ' channels')", measured="pa.channels", expected=text(c["channels"]))))]
    if c.get("layout") is not None:
        checks.append((f"pa.channel_layout <> {text(c['layout'])}", one(r.fail("concat('channel layout is ', pa.channel_layout)", measured="pa.channel_layout", expected=text(c["layout"])))))
    return cases(*checks)


def silence(c: dict) -> str:
    r, most = Rule("audio.silence", c["severity"]), c["max_duration_ms"]
    found = each("am.silence", "x", f"{length('x')} > {most}", r.fail(f"concat('silence of ', {length('x')}, ' ms')", measured=length("x"), expected=text(most), start="x.start_ms", end="x.end_ms"))
    return cases(("am IS NULL", one(r.unknown(UNMEASURED))), (f"size({found}) > 0", found), ("am.silence_truncated", one(r.unknown("'the list of silences was cut off'"))), (ERRORS[0], one(r.unknown(ERRORS[1]))))


def measured(rule: str, value: str, bad: str, c: dict, limit: object, shows: bool = False, nullable: bool = True, evidence: str = "NULL") -> str:
    """A measured value against a limit: missing, bad, errors, then a pass (with a word where it shows)."""
    r = Rule(rule, c["severity"])
    checks = [("am IS NULL", one(r.unknown(UNMEASURED)))]
    if nullable:
        checks.append((f"{value} IS NULL", one(r.unknown("'the value was not measured'", evidence=evidence))))
    checks.append((bad, one(r.fail(f"concat('measured ', {value})", measured=value, expected=text(limit), stream="pa.index", evidence=evidence))))
    checks.append((ERRORS[0], one(r.unknown(ERRORS[1], evidence=evidence))))
    if shows:
        return cases(*checks, otherwise=one(r.info(f"concat('measured ', {value})", measured=value, evidence=evidence)))
    return cases(*checks)


def clipping(c: dict) -> str:
    return measured("audio.clipping", "coalesce(am.clipping_events, 0L)", f"coalesce(am.clipping_events, 0L) > {c['max_events']}", c, c["max_events"], nullable=False)


def peak(c: dict) -> str:
    return measured("audio.peak", "am.peak_db", f"am.peak_db > {c['max_db']}D", c, c["max_db"], shows=True)


def true_peak(c: dict) -> str:
    return measured("audio.true_peak", "am.true_peak_db", f"am.true_peak_db > {c['max_db']}D", c, c["max_db"], shows=True)


def loudness(c: dict) -> str:
    evidence = f"to_json(named_struct('standard', {text(c['standard'])}, 'target_lufs', {c['target_lufs']}D, 'tolerance_lu', {c['tolerance_lu']}D))"
    return measured("audio.loudness", "am.loudness_lufs", f"abs(am.loudness_lufs - {c['target_lufs']}D) > {c['tolerance_lu']}D", c, c["target_lufs"], shows=True, evidence=evidence)


def phase(c: dict) -> str:
    return measured("audio.phase", "am.phase_correlation", f"am.phase_correlation < {c['min_correlation']}D", c, c["min_correlation"])


def dc_offset(c: dict) -> str:
    return measured("audio.dc_offset", "am.dc_offset_percent", f"abs(am.dc_offset_percent) > {c['max_offset_percent']}D", c, c["max_offset_percent"])


BUILDERS = {"sample_rate": lambda c: reported("audio.sample_rate", "sample_rate", c), "bit_depth": lambda c: reported("audio.bit_depth", "bit_depth", c), "channel_layout": channel_layout, "silence": silence, "clipping": clipping, "peak": peak, "true_peak": true_peak, "loudness": loudness, "phase": phase, "dc_offset": dc_offset}
