"""Scalar functions as SQL texts: rationals, timecodes, languages, markup, numbers."""

from __future__ import annotations

from math import gcd

#: Two-letter codes and the three-letter codes that they match.
LANGUAGES = {"en": "eng", "fr": "fre", "de": "deu", "es": "spa", "it": "ita", "nl": "nld", "pt": "por", "sv": "swe", "da": "dan", "no": "nor", "fi": "fin", "pl": "pol", "cs": "ces", "ru": "rus", "ja": "jpn", "ko": "kor", "zh": "zho"}


def rational_parts(value: str) -> tuple[int, int]:
    """A reduced numerator and denominator from ``n/d`` or an integer."""
    num, _, den = str(value).strip().partition("/")
    n, d = int(num), int(den or 1)
    if d == 0 or n < 0 or d < 0:
        raise ValueError(f"not a rational: {value!r}")
    g = gcd(n, d) or 1
    return n // g, d // g


def rational_text(value: str) -> str:
    return "{}/{}".format(*rational_parts(value))


def numerator(column: str) -> str:
    return f"try_cast(split_part({column}, '/', 1) AS decimal(20,0))"


def denominator(column: str) -> str:
    return f"coalesce(try_cast(nullif(split_part({column}, '/', 2), '') AS decimal(20,0)), 1BD)"


def rational_value(column: str) -> str:
    """As a double; null for a zero denominator."""
    return f"try_divide(cast({numerator(column)} AS double), cast({denominator(column)} AS double))"


def rational_compare(a: str, b: str) -> str:
    """-1, 0 or 1 by exact cross-multiplication."""
    return f"cast(sign({numerator(a)} * {denominator(b)} - {numerator(b)} * {denominator(a)}) AS int)"


def language(column: str) -> str:
    """Trimmed, lower-cased, cut at the first - or _, two letters widened to three."""
    base = f"regexp_extract(lower(trim({column})), '^[^-_]*', 0)"
    return "CASE " + base + "".join(f" WHEN '{two}' THEN '{three}'" for two, three in LANGUAGES.items()) + f" ELSE {base} END"


def language_of(tag: str) -> str:
    base = tag.strip().lower().replace("_", "-").split("-")[0]
    return LANGUAGES.get(base, base)


def visible_text(column: str) -> str:
    """Cue text without cue settings and markup: what follows the last arrow, without {...} and <...>."""
    return f"trim(regexp_replace(trim(regexp_replace({column}, '^.*-->', '')), '(\\\\{{[^}}]*(\\\\}}|$))|(<[^>]*(>|$))', ''))"


def timecode(frames: str, rate: int, drop: int = 0) -> str:
    """SMPTE timecode of a frame count at a nominal rate; ``drop``: frame numbers dropped every minute but each tenth."""
    day = 24 * 3600 * rate - drop * (24 * 60 - 24 * 6)
    f = f"pmod({frames}, {day}L)"
    if drop:
        ten, one = 600 * rate - 9 * drop, 60 * rate - drop
        rest = f"pmod({f}, {ten}L)"
        f = f"({f} + {drop}L * (9 * ({f} div {ten}L) + CASE WHEN {rest} < {60 * rate}L THEN 0L ELSE ({rest} - {60 * rate}L) div {one}L + 1 END))"
    pad = lambda x: f"lpad(cast({x} AS string), 2, '0')"
    return f"concat({pad(f'{f} div {3600 * rate}L')}, ':', {pad(f'pmod({f} div {60 * rate}L, 60L)')}, ':', {pad(f'pmod({f} div {rate}L, 60L)')}, '{';' if drop else ':'}', {pad(f'pmod({f}, {rate}L)')})"


def decibels(column: str) -> str:
    """dBFS of an amplitude; -300 for silence."""
    return f"CASE WHEN {column} > 0D THEN 20D * log10({column}) ELSE -300D END"


def frame_ms(frame: str, rate: str) -> str:
    """Frame number to milliseconds, rounded half up in integers."""
    return f"(({frame} * 1000 + {rate} div 2) div {rate})"


def bits_per_second(n_bytes: str, ms: str) -> str:
    return f"(cast({n_bytes} AS decimal(38,0)) * 8000 div nullif({ms}, 0))"


def packed_letters(code: str) -> str:
    """Three letters of five bits each; null below 0x400 or for anything but letters."""
    letters = [f"(shiftright({code}, {s}) & 31)" for s in (10, 5, 0)]
    word = "concat(" + ", ".join(f"char(96 + {x})" for x in letters) + ")"
    return f"CASE WHEN {code} >= 1024 AND " + " AND ".join(f"{x} BETWEEN 1 AND 26" for x in letters) + f" THEN {word} END"


def packed_language(code: str) -> str:
    """The letters as a language; null for und, too."""
    return f"nullif({packed_letters(code)}, 'und')"
