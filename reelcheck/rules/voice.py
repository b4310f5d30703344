"""Voice rules, over all voice measurements."""

from __future__ import annotations

from .base import Rule, cases, length, one, several, text

SPOKEN = "filter(voices, m -> coalesce(m.speech_analysed, false))"


def over(r: Rule, rows: str, *found: tuple[str, str]) -> str:
    return cases((f"size({rows}) = 0", one(r.unknown("'no voice measurement was available'"))), otherwise=f"flatten(transform({rows}, m -> {several(*found)}))")


def probably(message: str) -> str:
    return f"concat('[probabilistic] ', {message})"


def speech(c: dict) -> str:
    r, ratio = Rule("voice.speech", c["severity"]), "try_divide(cast(m.speech_ms AS double), nullif(m.analysed_ms, 0L))"
    bad = f"{ratio} < {c['min_ratio']}D" if c["expect"] == "present" else f"{ratio} >= {c['min_ratio']}D"
    return over(r, SPOKEN, (f"{ratio} IS NULL", r.unknown("'no audio was analysed'", stream="m.stream_idx")), (bad, r.fail(probably(f"concat('speech ratio is ', {ratio})"), measured=ratio, expected=text(f"{c['expect']} at {c['min_ratio']}"), stream="m.stream_idx")))


def silence(c: dict) -> str:
    r, gap = Rule("voice.silence", c["severity"]), "m.longest_non_speech"
    return over(r, SPOKEN, (f"{gap} IS NOT NULL AND {length(gap)} > {c['max_non_speech_ms']}", r.fail(probably(f"concat({length(gap)}, ' ms without speech')"), measured=length(gap), expected=text(c["max_non_speech_ms"]), stream="m.stream_idx", start=f"{gap}.start_ms", end=f"{gap}.end_ms")))


def speakers(c: dict) -> str:
    r, n = Rule("voice.speakers", c["severity"]), "m.speaker_count"
    bounds = [f"{n} < {c['min']}"] * (c.get("min") is not None) + [f"{n} > {c['max']}"] * (c.get("max") is not None)
    return over(r, SPOKEN, (f"{n} IS NULL", r.unknown("'speakers were not counted'", stream="m.stream_idx")), (" OR ".join(bounds), r.fail(probably(f"concat({n}, ' speakers')"), measured=n, expected=text(f"{c.get('min')}..{c.get('max')}"), stream="m.stream_idx")))


def speaker_changes(c: dict) -> str:
    r, rate = Rule("voice.speaker_changes", c["severity"]), "try_divide(cast(m.speaker_changes AS double), nullif(m.analysed_ms, 0L) / 60000D)"
    return over(r, SPOKEN, (f"{rate} > {c['max_per_minute']}D", r.fail(probably(f"concat({rate}, ' changes a minute')"), measured=rate, expected=text(c["max_per_minute"]), stream="m.stream_idx")))


def transcript(c: dict) -> str:
    r, t = Rule("voice.transcript", c["severity"]), "m.transcript"
    words = f"array_join(slice(coalesce({t}.unexpected_words, array()), 1, 10), ', ')"
    return over(r, "voices", (f"{t} IS NULL", r.unknown("'no transcript comparison'", stream="m.stream_idx")), (f"{t}.wer > {c['max_wer']}D", r.fail(f"concat('word error rate is ', {t}.wer)", measured=f"{t}.wer", expected=text(c["max_wer"]), stream="m.stream_idx")), (f"{t}.unexpected_total > {c['max_unexpected_words']}", r.fail(f"concat({t}.unexpected_total, ' unexpected words: ', {words})", measured=f"{t}.unexpected_total", expected=text(c["max_unexpected_words"]), stream="m.stream_idx")))


BUILDERS = {"speech": speech, "silence": silence, "speakers": speakers, "speaker_changes": speaker_changes, "transcript": transcript}
