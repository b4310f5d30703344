"""Video rules, over the first video stream."""

from __future__ import annotations

from ..functions.scalars import rational_text, rational_value
from .base import Rule, cases, each, length, one, several, text

FRAMES = "coalesce(vm.decoded_frame_count, 0L)"
NO_VIDEO = ("pv IS NULL", "'there is no video stream'")
NO_VM = ("vm IS NULL", "'video was not measured'")
NO_FRAMES = (f"{FRAMES} = 0", "'video decode produced no frames'")


def unknown(r: Rule, *checks: tuple[str, str]) -> list[tuple[str, str]]:
    return [(condition, one(r.unknown(message))) for condition, message in checks]


def resolution(c: dict) -> str:
    r = Rule("video.resolution", c["severity"])
    size = "concat(pv.width, 'x', pv.height)"
    return cases(*unknown(r, NO_VIDEO, ("pv.width IS NULL OR pv.height IS NULL", "'the stream reported no size'")), (f"pv.width <> {c['width']} OR pv.height <> {c['height']}", one(r.fail(f"concat('resolution is ', {size})", measured=size, expected=f"'{c['width']}x{c['height']}'"))))


def frame_rate(c: dict) -> str:
    r = Rule("video.frame_rate", c["severity"])
    seen = "coalesce(vm.frame_rate_observed, pv.frame_rate)"
    return cases(*unknown(r, NO_VIDEO, (f"{seen} IS NULL", "'no frame rate is known'")), (f"abs({rational_value(seen)} - {rational_value(text(rational_text(c['expected'])))}) > {c['tolerance']}D", one(r.fail(f"concat('frame rate is ', {seen})", measured=seen, expected=text(c["expected"])))))


def aspect_ratio(c: dict) -> str:
    r = Rule("video.aspect_ratio", c["severity"])
    wanted = rational_value(text(rational_text(c["expected"])))
    ratio = "try_divide(cast(pv.width AS double), pv.height)"
    off = f"CASE WHEN {wanted} = 0D THEN double('Infinity') ELSE abs({ratio} - {wanted}) / {wanted} END"
    return cases(*unknown(r, NO_VIDEO, ("pv.width IS NULL OR pv.height IS NULL", "'the stream reported no size'")), (f"coalesce({off}, double('Infinity')) > {c['tolerance']}D", one(r.fail(f"concat('aspect ratio is ', {ratio})", measured=ratio, expected=text(c["expected"])))))


def color_space(c: dict) -> str:
    r = Rule("video.color_space", c["severity"])
    return cases(*unknown(r, NO_VM, ("vm.colorspace IS NULL", "'no colour space was reported'")), (f"vm.colorspace <> {text(c['expected'])}", one(r.fail("concat('colour space is ', vm.colorspace)", measured="vm.colorspace", expected=text(c["expected"])))))


def scan_format(c: dict) -> str:
    """Scan structure first: an unsignalled order can't disprove progressive, but doesn't do for interlaced; then a pinned field order."""
    r, scan, order = Rule("video.scan_format", c["severity"]), c["scan"], c.get("field_order", "any")
    seen = "coalesce(vm.field_order, pv.field_order)"
    bad = lambda condition, message, expected: (condition, one(r.fail(message, measured=seen, expected=text(expected))))
    checks = unknown(r, NO_VIDEO, (f"{seen} IS NULL", "'the stream reported no scanning order'"))
    if scan == "progressive":
        checks.append(bad(f"{seen} IN ('top_field_first', 'bottom_field_first')", f"concat('scanning order is ', {seen})", "progressive"))
        checks += unknown(r, (f"{seen} = 'unknown'", "'field order not signalled; progressive scan is not confirmed'"))
    elif scan == "interlaced":
        checks.append(bad(f"{seen} IN ('progressive', 'unknown')", f"concat('scanning order is ', {seen})", "interlaced"))
    if order in ("top_field_first", "bottom_field_first"):
        checks.append(bad(f"{seen} <> '{order}'", f"concat('field order is ', {seen})", order))
    return cases(*checks, otherwise=one(r.info(f"concat('scanning order is ', {seen})", measured=seen)))


def long_segments(rule: str, field: str, c: dict) -> str:
    r, most = Rule(rule, c["severity"]), c["max_duration_ms"]
    found = each(f"vm.{field}", "x", f"{length('x')} > {most}", r.fail(f"concat('segment of ', {length('x')}, ' ms')", measured=length("x"), expected=text(most), start="x.start_ms", end="x.end_ms"))
    return cases(*unknown(r, NO_VM, NO_FRAMES), (f"size({found}) > 0", found), *unknown(r, ("vm.decode_errors > 0", "'decode had errors, so segments may be missing'")))


def counted(rule: str, value: str, c: dict, errors: bool) -> str:
    r, most = Rule(rule, c["severity"]), c["max_events"]
    checks = [*unknown(r, NO_VM, NO_FRAMES), (f"{value} > {most}", one(r.fail(f"concat({value}, ' events')", measured=value, expected=text(most))))]
    return cases(*checks, *(unknown(r, ("vm.decode_errors > 0", "'decode had errors, so segments may be missing'")) if errors else []))


def luma_range(c: dict) -> str:
    r = Rule("video.luma_range", c["severity"])
    share = "vm.luma.below_legal + vm.luma.above_legal"
    return cases(*unknown(r, NO_VM, ("vm.luma IS NULL", "'luma was not measured'")), (f"{share} > {c['max_out_of_legal']}D", one(r.fail(f"concat({share}, ' of samples are out of legal range')", measured=share, expected=text(c["max_out_of_legal"])))), otherwise=one(r.info(f"concat({share}, ' of samples are out of legal range')", measured=share)))


def hazards(times: str, limit: float, r: Rule, kind: str) -> str:
    """Windows of less than a second with more than the limit of flashes (pairs of transitions), overlapping ones merged.

    Over the sorted times t: the window that ends at t[i] starts at the first time that is less than a second before."""
    windows = f"filter(transform({times}, (t, i) -> named_struct('from', get(filter({times}, u -> t - u < 1000), 0), 'to', t, 'n', size(filter({times}, (u, j) -> j <= i AND t - u < 1000)) / 2D)), w -> w.n > {limit}D)"
    empty = "cast(array() AS array<struct<`from`:bigint,`to`:bigint,n:double>>)"
    merged = f"aggregate({windows}, {empty}, (acc, w) -> CASE WHEN size(acc) > 0 AND w.from <= try_element_at(acc, -1).to THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('from', try_element_at(acc, -1).from, 'to', greatest(w.to, try_element_at(acc, -1).to), 'n', greatest(w.n, try_element_at(acc, -1).n)))) ELSE concat(acc, array(named_struct('from', w.from, 'to', w.to, 'n', w.n))) END)"
    return f"transform({merged}, w -> {r.fail(f"concat(w.n, ' {kind} flashes in a second')", measured='w.n', expected=text(limit), start='w.from', end='greatest(w.to, w.from + 1)')})"


def photosensitivity(c: dict) -> str:
    r, limit = Rule("video.photosensitivity", c["severity"]), c["max_flashes_per_second"]
    times = lambda k: f"coalesce(get(vm.flash.transitions_ms, {k}), array())"
    found = f"concat({hazards(times(0), limit, r, 'general')}, {hazards(times(1), limit, r, 'red')})"
    return cases(*unknown(r, NO_VM, NO_FRAMES, ("vm.flash IS NULL", "'flash analysis did not run'")), (f"size({found}) > 0", found), *unknown(r, ("vm.decode_errors > 0", "'decode had errors, so flashes may be missing'")))


RANGE_OF = "CASE WHEN lower(vm.hdr.transfer) IN ('smpte2084', 'st2084', 'pq') THEN 'pq' WHEN lower(vm.hdr.transfer) IN ('arib-std-b67', 'hlg') THEN 'hlg' WHEN vm.hdr.transfer IS NOT NULL THEN 'sdr' END"
MODES = {"sdr": ("sdr",), "hdr10": ("pq",), "hlg": ("hlg",), "hdr": ("pq", "hlg")}


def hdr(c: dict) -> str:
    r, h, actual = Rule("video.hdr", c["severity"]), "vm.hdr", f"({RANGE_OF})"
    bad = lambda condition, message: (condition, r.fail(message, measured=f"coalesce({h}.transfer, 'unknown')", expected=text(c["mode"])))
    high, static = f"{actual} <> 'sdr'", text(bool(c["require_static_metadata"]))
    pq = f"{actual} = 'pq' AND {static} AND NOT coalesce({h}.dolby_vision, false)"
    problems = [
        bad(f"{actual} NOT IN ({', '.join(map(text, MODES[c['mode']]))})", f"concat('transfer is ', {h}.transfer)"),
        bad(f"{high} AND NOT startswith(lower({h}.primaries), 'bt2020')", f"concat('a high dynamic range needs bt2020 primaries, not ', {h}.primaries)"),
        bad(f"{high} AND {h}.primaries IS NULL", "'a high dynamic range needs bt2020 primaries, none are given'"),
        bad(f"{high} AND NOT startswith(lower({h}.matrix), 'bt2020')", f"concat('a high dynamic range needs a bt2020 matrix, not ', {h}.matrix)"),
        bad(f"{high} AND {h}.`range` <> 'tv'", f"concat('levels are in the range ', {h}.`range`, ' and not tv')"),
        bad(f"{high} AND NOT (pv.pixel_format LIKE '%10%' OR pv.pixel_format LIKE '%12%' OR pv.pixel_format LIKE '%16%')", "'samples have fewer than ten bits'"),
        bad(f"{pq} AND {h}.mastering_display IS NULL", "'nothing says on which display it was graded'"),
        bad(f"{pq} AND ({h}.max_cll IS NULL OR {h}.max_fall IS NULL)", "'brightest pixel and frame are not given'"),
        bad(f"{h}.max_fall > {h}.max_cll", f"concat('the brightest frame (', {h}.max_fall, ') is above the brightest pixel (', {h}.max_cll, ')')"),
    ]
    for key, field in (("max_cll_nits", "max_cll"), ("max_fall_nits", "max_fall")):
        if c.get(key) is not None:
            problems.append(bad(f"{h}.{field} > {c[key]}", f"concat('{field} ', {h}.{field}, ' is above what is allowed')"))
    problems.append(bad(f"{h}.mastering_display.min_luminance_nits >= {h}.mastering_display.max_luminance_nits", "'the grading display is as bright at its darkest as at its brightest'"))
    return cases(*unknown(r, (f"{actual} IS NULL", "'no transfer characteristic was reported'")), otherwise=several(*problems))


def dead_pixels(c: dict) -> str:
    r, d = Rule("video.dead_pixels", c["severity"]), "vm.dead_pixels"
    flicker = f"{d}.flicker_cells" if c["include_flicker"] else "0L"
    total = f"({d}.dark_cells + {d}.bright_cells + {flicker})"
    clusters = f"size(filter(coalesce({d}.clusters, array()), x -> {'true' if c['include_flicker'] else "x.kind <> 'flicker'"}))"
    many, wide = f"{total} > {c['max_pixels']}", f"{clusters} > {c['max_clusters']}"
    worst = f"get({d}.clusters, 0)"
    found = several((many, r.fail(f"concat({total}, ' stuck pixels')", measured=total, expected=text(c["max_pixels"]))), (wide, r.fail(f"concat({clusters}, ' clusters')", measured=clusters, expected=text(c["max_clusters"]))), (f"({many} OR {wide}) AND {worst} IS NOT NULL", r.say(f"concat('largest cluster: ', {worst}.cells, ' ', {worst}.kind, ' pixels at (', {worst}.x, ', ', {worst}.y, ')')", measured=f"{worst}.cells")))
    limited = [("coalesce(vm.dead_pixels.resolution_limited, false)", "'the picture was sampled coarsely'")] if c["fail_on_limited_resolution"] else []
    return cases(*unknown(r, NO_VM, (f"{d} IS NULL", "'dead-pixel analysis did not run'"), (f"{d}.frames_sampled = 0", "'dead-pixel analysis saw no frames'"), *limited), otherwise=found)


def perceptual(r: Rule) -> list[tuple[str, str]]:
    return unknown(r, NO_VM, ("vm.perceptual IS NULL", "'perceptual metrics did not run'"), ("vm.perceptual.frames_sampled = 0", "'no frames were measured'"))


def blockiness(c: dict) -> str:
    r, p = Rule("video.blockiness", c["severity"]), "vm.perceptual"
    found = [(f"{p}.blockiness > {c['max_ratio']}D", r.fail(f"concat('blockiness is ', {p}.blockiness)", measured=f"{p}.blockiness", expected=text(c["max_ratio"])))]
    if c.get("max_frame_ratio") is not None:
        found.append((f"{p}.blockiness_max > {c['max_frame_ratio']}D", r.fail(f"concat('worst frame shows ', {p}.blockiness_max)", measured=f"{p}.blockiness_max", expected=text(c["max_frame_ratio"]))))
    return cases(*perceptual(r), *unknown(r, (f"{p}.blockiness_frames / cast({p}.frames_sampled AS double) < {c['min_evidence_share']}D", "'too few frames had detail'"), (f"{p}.blockiness IS NULL", "'no frame had detail'")), otherwise=several(*found))


def blur(c: dict) -> str:
    r, v = Rule("video.blur", c["severity"]), "vm.perceptual.blur"
    return cases(*perceptual(r), *unknown(r, (f"{v} IS NULL", "'sharpness was not measured'")), (f"{v} < {c['min_sharpness']}D", one(r.fail(f"concat('sharpness is ', {v})", measured=v, expected=text(c["min_sharpness"])))))


def noise(c: dict) -> str:
    r, v = Rule("video.noise", c["severity"]), "vm.perceptual.noise"
    return cases(*perceptual(r), *unknown(r, (f"vm.perceptual.flat_frames / cast(vm.perceptual.frames_sampled AS double) < {c['min_evidence_share']}D", "'too few frames had flat areas'"), (f"{v} IS NULL", "'noise was not measured'")), (f"{v} > {c['max_sigma']}D", one(r.fail(f"concat('noise is ', {v})", measured=v, expected=text(c["max_sigma"])))))


BUILDERS = {
    "resolution": resolution, "frame_rate": frame_rate, "aspect_ratio": aspect_ratio, "color_space": color_space, "scan_format": scan_format,
    "black_frames": lambda c: long_segments("video.black_frames", "black_frames", c), "freeze_frames": lambda c: long_segments("video.freeze_frames", "freeze_frames", c),
    "duplicate_frames": lambda c: counted("video.duplicate_frames", "size(coalesce(vm.duplicate_frames, array()))", c, True), "corrupt_frames": lambda c: counted("video.corrupt_frames", "coalesce(vm.decode_errors, 0L)", c, False),
    "luma_range": luma_range, "photosensitivity": photosensitivity, "hdr": hdr, "dead_pixels": dead_pixels, "blockiness": blockiness, "blur": blur, "noise": noise,
}
