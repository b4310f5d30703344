"""Container readers: streams, sample times, cues and what is wrong, from the bytes of a file.

``probe`` reads one file; ``probe_streams``, ``probe_samples`` and ``probe_cues`` do so for DataFrames of files, in batches.
Times are ticks with their rate; gaps, modes, medians and rates over them are SQL (``operators.signals``).
"""

from __future__ import annotations

import struct
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of video signals (2 and others: unknown).
PRIMARIES = {1: "bt709", 4: "bt470m", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "film", 9: "bt2020", 10: "smpte428", 11: "smpte431", 12: "smpte432", 22: "ebu3213"}
TRANSFERS = {1: "bt709", 4: "gamma22", 5: "gamma28", 6: "smpte170m", 7: "smpte240m", 8: "linear", 11: "iec61966-2-4", 13: "iec61966-2-1", 14: "bt2020-10", 15: "bt2020-12", 16: "smpte2084", 17: "smpte428", 18: "arib-std-b67"}
MATRICES = {0: "gbr", 1: "bt709", 4: "fcc", 5: "bt470bg", 6: "smpte170m", 7: "smpte240m", 8: "ycgco", 9: "bt2020nc", 10: "bt2020c", 11: "smpte2085", 14: "ictcp"}
#: What is read, by container; other video and sound is refused, anything else listed only.
ISO = {(b"vide", b"av01"): "av1", (b"vide", b"vp09"): "vp9", (b"soun", b"Opus"): "opus", (b"soun", b"fLaC"): "flac", (b"text", b"wvtt"): "webvtt", (b"text", b"tx3g"): "tx3g"}
ISO_PCM = (b"ipcm", b"fpcm", b"sowt", b"twos", b"in24", b"in32", b"fl32", b"fl64", b"raw ", b"lpcm")
MKV = {"V_AV1": "av1", "V_VP9": "vp9", "A_OPUS": "opus", "A_VORBIS": "vorbis", "A_FLAC": "flac", "A_PCM/INT/LIT": "pcm", "A_PCM/INT/BIG": "pcm", "A_PCM/FLOAT/IEEE": "pcm", "S_TEXT/UTF8": "subrip", "S_TEXT/ASS": "ass", "S_TEXT/SSA": "ssa", "S_TEXT/WEBVTT": "webvtt"}
TS_REGISTERED = {b"AV01": ("video", "av1"), b"av01": ("video", "av1"), b"vp09": ("video", "vp9"), b"Opus": ("audio", "opus"), b"fLaC": ("audio", "flac")}
TS_VIDEO, TS_AUDIO = (0x01, 0x02, 0x10, 0x1B, 0x24, 0x42, 0xD1, 0xEA), (0x03, 0x04, 0x0F, 0x11, 0x81, 0x82, 0x83, 0x87, 0x8A)
KINDS = {1: "video", 2: "audio", 17: "subtitle"}
HANDLERS = {b"vide": "video", b"soun": "audio", b"text": "subtitle", b"sbtl": "subtitle", b"subt": "subtitle"}


@dataclass
class Probe:
    container: str | None = None
    streams: list[dict[str, Any]] = field(default_factory=list)
    samples: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # stream, seq, ts, duration, bytes
    cues: list[tuple[int, int, int, bytes]] = field(default_factory=list)  # stream, start ms, end ms, payload
    problems: list[str] = field(default_factory=list)
    corrupt: str | None = None
    refused: str | None = None
    duration_ms: int | None = None

    def stream(self, native: int, kind: str, codec: str, ticks: int, **more: Any) -> dict[str, Any]:
        s = {"native_id": native, "kind": kind, "codec": codec, "ticks": ticks} | more
        self.streams.append(s)
        return s


def language(code: int) -> str | None:
    letters = [(code >> n) & 31 for n in (10, 5, 0)]
    word = "".join(chr(96 + x) for x in letters)
    return word if code >= 0x400 and all(1 <= x <= 26 for x in letters) and word != "und" else None


# ISO base media


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the body, end) of the boxes in a range; a box that runs over its end is cut."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        stop = end if size == 0 else at + size
        if stop < body:
            return
        yield kind, body, min(stop, end)
        at = stop


def inside(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for name in path:
        found = next(((a, b) for k, a, b in boxes(data, at, end) if k == name), None)
        if found is None:
            return None
        at, end = found
    return at, end


def table(data: bytes, span: tuple[int, int] | None, form: str, skip: int = 4) -> list[tuple]:
    """Rows of a full box's table, as many as there are bytes for."""
    if span is None or span[0] + skip + 4 > span[1]:
        return []
    at = span[0] + skip
    n, width = struct.unpack_from(">I", data, at)[0], struct.calcsize(">" + form)
    n = min(n, (span[1] - at - 4) // width)
    return [struct.unpack_from(">" + form, data, at + 4 + i * width) for i in range(n)]


def iso(data: bytes) -> Probe:
    out = Probe("iso-bmff")
    moov = inside(data, 0, len(data), b"moov")
    if moov is None:
        out.corrupt = "no movie box"
        return out
    head = inside(data, *moov, b"mvhd")
    if head:
        wide = data[head[0]] == 1
        scale, length = struct.unpack_from(">IQ" if wide else ">II", data, head[0] + (20 if wide else 12))
        out.duration_ms = length * 1000 // scale if scale else None
    for n, (kind, a, b) in enumerate(x for x in boxes(data, *moov) if x[0] == b"trak"):
        iso_track(data, a, b, n, out)
    return out


def iso_track(data: bytes, a: int, b: int, native: int, out: Probe) -> None:
    mdhd, hdlr, stbl = inside(data, a, b, b"mdia", b"mdhd"), inside(data, a, b, b"mdia", b"hdlr"), inside(data, a, b, b"mdia", b"minf", b"stbl")
    if not mdhd or not hdlr or not stbl:
        out.problems.append(f"track {native} is incomplete")
        return
    wide = data[mdhd[0]] == 1
    scale, length, lang = struct.unpack_from(">IQH" if wide else ">IIH", data, mdhd[0] + (20 if wide else 12))
    handler = data[hdlr[0] + 8 : hdlr[0] + 12]
    entry = inside(data, *stbl, b"stsd")
    first = next(boxes(data, entry[0] + 8, entry[1]), None) if entry else None
    if first is None:
        out.problems.append(f"track {native} has no sample entry")
        return
    fourcc, start, stop = first
    kind, codec = HANDLERS.get(handler, "data"), fourcc.decode("latin-1").strip()
    more: dict[str, Any] = {"language": language(lang), "duration": length // scale if scale else None}
    if kind == "video":
        codec = ISO.get((handler, fourcc), codec)
        out.refused = out.refused or (None if (handler, fourcc) in ISO else f"{codec} video")
        more |= dict(zip(("width", "height"), struct.unpack_from(">HH", data, start + 24), strict=True))
        colour = inside(data, start + 78, stop, b"colr")
        if colour and data[colour[0] : colour[0] + 4] == b"nclx":
            p, t, m, full = struct.unpack_from(">HHHB", data, colour[0] + 4)
            more |= {"primaries": PRIMARIES.get(p), "transfer": TRANSFERS.get(t), "matrix": MATRICES.get(m), "range": "pc" if full & 0x80 else "tv"}
        av1 = inside(data, start + 78, stop, b"av1C")
        if av1 and av1[1] - av1[0] >= 3:
            flags = data[av1[0] + 2]
            more |= {"codec_profile": str(data[av1[0] + 1] >> 5), "bit_depth": 12 if flags & 0x20 else 10 if flags & 0x40 else 8}
    elif kind == "audio":
        known = fourcc in ISO_PCM or (handler, fourcc) in ISO
        codec = "pcm" if fourcc in ISO_PCM else ISO.get((handler, fourcc), codec)
        out.refused = out.refused or (None if known else f"{codec} audio")
        channels, bits, rate = struct.unpack_from(">HH4xI", data, start + 16)
        more |= {"channels": channels, "bit_depth": bits, "sample_rate": rate >> 16}
    elif kind == "subtitle":
        codec = ISO.get((b"text", fourcc), codec)
    out.stream(native, kind, codec, scale, **more)
    durations, sizes = table(data, inside(data, *stbl, b"stts"), "II"), inside(data, *stbl, b"stsz")
    same = struct.unpack_from(">I", data, sizes[0] + 4)[0] if sizes else 0
    each = [x for (x,) in table(data, sizes, "I", 8)] if sizes and not same else []
    n_sizes = struct.unpack_from(">I", data, sizes[0] + 8)[0] if sizes else 0
    if sum(n for n, _ in durations) != n_sizes:
        out.problems.append(f"track {native} has {sum(n for n, _ in durations)} times and {n_sizes} sizes")
    chunks = [x for (x,) in table(data, inside(data, *stbl, b"stco"), "I")] or [x for (x,) in table(data, inside(data, *stbl, b"co64"), "Q")]
    if any(x >= len(data) for x in chunks):
        out.corrupt = out.corrupt or f"samples of track {native} lie beyond the end of the file"
    ts = seq = 0
    # every sample has a size of its own in the file, or so many bytes of it: a table that declares more is broken, and told above or here
    most = len(data) // same if same else len(each)
    if sum(n for n, _ in durations) > most:
        out.problems.append(f"track {native} has times for more samples than the file can hold")
    places = iso_places(chunks, table(data, inside(data, *stbl, b"stsc"), "III"), each, same)
    for n, d in durations:
        for _ in range(min(n, most - seq)):
            size = each[seq] if seq < len(each) else same
            out.samples.append((native, seq, ts, d, size))
            if kind == "subtitle" and scale:
                at = next(places, None)
                if at is not None and at + size <= len(data):
                    out.cues += [(native, ts * 1000 // scale, (ts + d) * 1000 // scale, p) for p in iso_text(codec, data[at : at + size])]
            ts, seq = ts + d, seq + 1


def iso_places(chunks: list[int], runs: list[tuple], each: list[int], same: int) -> Iterator[int]:
    """Places of samples: the last run at or before a chunk says how many it has."""
    seq, r = 0, -1
    for n, at in enumerate(chunks, 1):
        while r + 1 < len(runs) and runs[r + 1][0] <= n:
            r += 1
        for _ in range(runs[r][1] if r >= 0 else 0):
            yield at
            at, seq = at + (each[seq] if seq < len(each) else same), seq + 1


def iso_text(codec: str, sample: bytes) -> list[bytes]:
    if codec == "tx3g":
        n = struct.unpack_from(">H", sample)[0] if len(sample) >= 2 else 0
        return [sample[2 : 2 + n]] if n else []
    return [sample[p[0] : p[1]] for k, a, b in boxes(sample, 0, len(sample)) if k == b"vttc" for p in [inside(sample, a, b, b"payl")] if p]


# Matroska

#: Elements that are walked into, and those that are read.
MASTERS = {0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x55B0, 0x55D0, 0x1F43B675, 0xA0}
UINTS = {0x2AD7B1: "scale", 0xD7: "number", 0x83: "type", 0x9A: "interlaced", 0x9D: "order", 0x23E383: "default_ns", 0xB0: "width", 0xBA: "height", 0x9F: "channels", 0x6264: "bit_depth", 0x55B1: "matrix", 0x55B9: "range", 0x55BA: "transfer", 0x55BB: "primaries", 0x55BC: "max_cll", 0x55BD: "max_fall", 0xE7: "cluster_ts", 0x9B: "block_duration"}
FLOATS = {0x4489: "duration", 0xB5: "sample_rate", 0x55D9: "max_nits", 0x55DA: "min_nits"}
STRINGS = {0x86: "codec_id", 0x22B59C: "language", 0x536E: "name", 0x4282: "doctype"}


def vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A number of variable length and where it ends; element ids keep their length marker."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError(f"no number at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if keep else value & ((1 << (7 * n)) - 1)), at + n


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        key, at = vint(data, at, True)
        size, body = vint(data, at, False)
        stop = end if size == (1 << (7 * (body - at))) - 1 else body + size
        yield key, body, min(stop, end)
        at = stop


def matroska(data: bytes) -> Probe:
    out = Probe("matroska")
    state: dict[str, Any] = {"scale": 1_000_000, "tracks": {}, "open": {}}
    try:
        mkv_walk(data, 0, len(data), out, state)
    except (ValueError, IndexError) as e:
        out.corrupt = out.corrupt or str(e)
    if "duration" in state:
        out.duration_ms = int(state["duration"] * state["scale"] / 1e6)
    for t in state["tracks"].values():
        mkv_stream(t, out, state["scale"])
    return out


def mkv_walk(data: bytes, at: int, end: int, out: Probe, state: dict[str, Any]) -> None:
    for key, a, b in elements(data, at, end):
        now = state["open"]
        if key in MASTERS:
            if key == 0xAE:
                state["open"] = {}
            if key == 0xA0:
                now.pop("block_duration", None)
                state["group"] = []
            mkv_walk(data, a, b, out, state)
            if key == 0xAE:
                state["tracks"][state["open"].get("number", len(state["tracks"]) + 1)] = state["open"]
            if key == 0xA0:
                for block in state.pop("group"):
                    mkv_block(data, *block, out, state, state["open"].get("block_duration"))
        elif key in UINTS:
            value = int.from_bytes(data[a:b], "big")
            (state if UINTS[key] in ("scale", "cluster_ts") else now)[UINTS[key]] = value
        elif key in FLOATS and b - a in (4, 8):
            value = struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0]
            (state if FLOATS[key] == "duration" else now)[FLOATS[key]] = value
        elif key in STRINGS:
            now[STRINGS[key]] = data[a:b].rstrip(b"\0").decode("utf-8", "replace")
        elif key == 0xA3:
            mkv_block(data, a, b, out, state, None)
        elif key == 0xA1:
            state["group"].append((a, b))


def laced(data: bytes, at: int, end: int, flags: int) -> list[bytes]:
    """The frames of a block: none, Xiph, fixed or EBML lacing."""
    kind = (flags >> 1) & 3
    if not kind:
        return [data[at:end]]
    n, at = data[at] + 1, at + 1
    if kind == 2:
        size = (end - at) // n
        return [data[at + i * size : at + (i + 1) * size] for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            start = at
            value, at = vint(data, at, False)
            sizes.append(value if not i else sizes[-1] + value - ((1 << (7 * (at - start) - 1)) - 1))
    frames = []
    for size in sizes:
        frames.append(data[at : at + size])
        at += size
    return [*frames, data[at:end]]


def mkv_block(data: bytes, a: int, b: int, out: Probe, state: dict[str, Any], duration: int | None) -> None:
    number, at = vint(data, a, False)
    ts = state.get("cluster_ts", 0) + struct.unpack_from(">h", data, at)[0]
    track = state["tracks"].setdefault(number, {"number": number})
    frames = laced(data, at + 3, b, data[at + 2])
    step = track.get("default_ns", 0) // state["scale"]
    for i, f in enumerate(frames):
        seq = track["seq"] = track.get("seq", -1) + 1
        out.samples.append((number, seq, ts + i * step, duration or step, len(f)))
        codec = MKV.get(track.get("codec_id", ""), "")
        if track.get("type") == 17 and codec:
            text = f.split(b",", 8)[-1] if codec in ("ass", "ssa") else f
            ms = ts * state["scale"] // 1_000_000
            out.cues.append((number, ms, ms + (duration or 0) * state["scale"] // 1_000_000, text))


def mkv_stream(t: dict[str, Any], out: Probe, scale: int) -> None:
    kind, codec_id = KINDS.get(t.get("type", 0), "data"), t.get("codec_id", "")
    if kind in ("video", "audio") and codec_id not in MKV:
        out.refused = out.refused or f"{kind} codec {codec_id!r}"
    order = {1: {0: "progressive", 1: "top_field_first", 6: "bottom_field_first", 9: "top_field_first", 14: "bottom_field_first"}.get(t.get("order", 2), "unknown"), 2: "progressive"}.get(t.get("interlaced", 0), "unknown") if kind == "video" else None
    known = {k: t.get(k) for k in ("width", "height", "channels", "bit_depth", "language", "max_cll", "max_fall")}
    colour = {"primaries": PRIMARIES.get(t.get("primaries", 2)), "transfer": TRANSFERS.get(t.get("transfer", 2)), "matrix": MATRICES.get(t.get("matrix", 2)), "range": {1: "tv", 2: "pc"}.get(t.get("range", 0))} if kind == "video" else {}
    out.stream(t["number"], kind, MKV.get(codec_id, codec_id), 1_000_000_000 // scale, field_order=order, sample_rate=int(t["sample_rate"]) if "sample_rate" in t else None, **known, **colour)


# MPEG transport streams


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def transport(data: bytes) -> Probe:
    out = Probe("mpeg-ts")
    sections: dict[int, bytes] = {}
    maps: set[int] = set()
    known: dict[int, dict[str, Any]] = {}
    last: dict[int, int] = {}
    seq: Counter[int] = Counter()
    broken: Counter[str] = Counter()
    at = 0
    while at + 188 <= len(data):
        if data[at] != 0x47:
            broken["sync losses"] += 1
            at = data.find(b"\x47", at + 1)
            if at < 0:
                break
            continue
        flags, control = struct.unpack_from(">HB", data, at + 1)
        pid, start, has_payload, body = flags & 0x1FFF, bool(flags & 0x4000), bool(control & 0x10), at + 4
        broken["transport errors"] += bool(flags & 0x8000)
        jump = False
        if control & 0x20:
            jump = data[body] > 0 and bool(data[body + 1] & 0x80)
            body += 1 + data[body]
        if has_payload and pid != 0x1FFF:
            count = control & 15
            if pid in last and not jump and count not in ((last[pid] + 1) & 15, last[pid]):
                broken[f"continuity errors on {pid}"] += 1
            last[pid] = count
            payload = data[body : at + 188] if body < at + 188 else b""
            if pid == 0 or pid in maps:
                sections[pid] = payload[1 + payload[0] :] if start and payload else sections.get(pid, b"") + payload
                section(sections[pid], pid, maps, known, out, broken)
            elif pid in known and start:
                pts = presentation(payload)
                if pts is not None:
                    out.samples.append((pid, seq[pid], pts, 0, len(payload)))
                    seq[pid] += 1
        at += 188
    if at < len(data) and data[at : at + 1] != b"\x47":
        broken["sync losses"] += 1
    out.problems += [f"{n} {what}" for what, n in broken.items() if n]
    return out


def section(s: bytes, pid: int, maps: set[int], known: dict[int, dict[str, Any]], out: Probe, broken: Counter[str]) -> None:
    """A program association or map, once it is whole and its checksum is right."""
    if len(s) < 3:
        return
    end = 3 + (struct.unpack_from(">H", s, 1)[0] & 0xFFF)
    if len(s) < end or end < 12:
        return
    if crc32_mpeg(s[:end]):
        broken["checksum errors"] += 1
        return
    if pid == 0 and s[0] == 0:
        for i in range(8, end - 4, 4):
            program, target = struct.unpack_from(">HH", s, i)
            if program:
                maps.add(target & 0x1FFF)
    elif s[0] == 2:
        i = 12 + (struct.unpack_from(">H", s, 10)[0] & 0xFFF)
        while i + 5 <= end - 4:
            kind, target, n = struct.unpack_from(">BHH", s, i)
            tags = descriptors(s[i + 5 : i + 5 + (n & 0xFFF)])
            if target & 0x1FFF not in known:
                known[target & 0x1FFF] = ts_stream(kind, target & 0x1FFF, tags, out)
            i += 5 + (n & 0xFFF)


def descriptors(d: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 2 <= len(d):
        out[d[at]] = d[at + 2 : at + 2 + d[at + 1]]
        at += 2 + d[at + 1]
    return out


def ts_stream(kind: int, pid: int, tags: dict[int, bytes], out: Probe) -> dict[str, Any]:
    mark = tags.get(0x05, b"")[:4]
    what, codec = "data", f"stream_type_0x{kind:02x}"
    if kind == 0x06 and mark in TS_REGISTERED or kind == 0x81 and mark == b"AV01":
        what, codec = TS_REGISTERED[mark]
    elif kind == 0x06 and tags.keys() & {0x56, 0x59}:
        what, codec = "subtitle", "dvb_subtitle"
    elif kind in TS_VIDEO or kind in TS_AUDIO or kind == 0x06 and tags.keys() & {0x6A, 0x7A, 0x7B, 0x7C}:
        what = "video" if kind in TS_VIDEO else "audio"
        out.refused = out.refused or f"{what} stream type 0x{kind:02X}"
    lang = tags.get(0x0A, b"")[:3].decode("latin-1") or None
    return out.stream(pid, what, codec, 90_000, language=lang, field_order="progressive" if what == "video" else None)


def presentation(p: bytes) -> int | None:
    if len(p) < 14 or p[:3] != b"\0\0\1" or not p[7] & 0x80:
        return None
    return (p[9] >> 1 & 7) << 30 | (struct.unpack_from(">H", p, 10)[0] >> 1) << 15 | struct.unpack_from(">H", p, 12)[0] >> 1


# Sound files


def aiff(data: bytes) -> Probe:
    out, at = Probe("aiff"), 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from(">4sI", data, at)
        if name == b"COMM" and at + 26 <= len(data):
            channels, frames, bits, exponent, mantissa = struct.unpack_from(">hIhHQ", data, at + 8)
            rate = int(mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63))
            kind = data[at + 26 : at + 30] if data[8:12] == b"AIFC" else b"NONE"
            codec = {b"NONE": f"pcm_s{bits}be", b"twos": f"pcm_s{bits}be", b"sowt": f"pcm_s{bits}le", b"fl32": "pcm_f32be", b"FL32": "pcm_f32be", b"fl64": "pcm_f64be", b"FL64": "pcm_f64be"}.get(kind)
            out.refused = None if codec else f"compression {kind!r}"
            out.stream(0, "audio", codec or kind.decode("latin-1"), rate, channels=channels, bit_depth=bits, sample_rate=rate)
            out.duration_ms = frames * 1000 // rate if rate else None
        at += 8 + size + (size & 1)
    if not out.streams:
        out.corrupt = "no common chunk"
    return out


def flac(data: bytes) -> Probe:
    out = Probe("flac")
    if len(data) < 26 or data[4] & 0x7F:
        out.corrupt = "no stream information"
        return out
    packed = int.from_bytes(data[18:26], "big")
    rate, channels, bits, frames = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
    out.stream(0, "audio", "flac", rate, channels=channels, bit_depth=bits, sample_rate=rate)
    out.duration_ms = frames * 1000 // rate if rate and frames else None
    return out


def ogg(data: bytes) -> Probe:
    out = Probe("ogg")
    head = data[27 + data[26] :] if len(data) > 27 else b""
    if head[:8] == b"OpusHead" and len(head) >= 16:
        out.stream(0, "audio", "opus", 48_000, channels=head[9], sample_rate=48_000)
    elif head[:7] == b"\x01vorbis" and len(head) >= 16:
        rate = struct.unpack_from("<I", head, 12)[0]
        out.stream(0, "audio", "vorbis", rate, channels=head[11], sample_rate=rate)
    else:
        out.refused = "unknown Ogg codec"
        return out
    tail, at, end = data[-65_536:], -1, None
    while (at := tail.find(b"OggS", at + 1)) >= 0:
        if at + 14 <= len(tail):
            granule = struct.unpack_from("<q", tail, at + 6)[0]
            end = granule if granule >= 0 else end
    rate = out.streams[0]["ticks"]
    out.duration_ms = end * 1000 // rate if end is not None and rate else None
    return out


READERS: dict[str, Callable[[bytes], Probe]] = {"iso-bmff": iso, "matroska": matroska, "mpeg-ts": transport, "aiff": aiff, "flac": flac, "ogg": ogg}


def probe(kind: str | None, data: bytes) -> Probe:
    """What a reader finds; whatever a broken file does to it is a corruption of that file."""
    if kind not in READERS:
        return Probe(kind, corrupt="unknown container")
    try:
        return READERS[kind](data)
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        return Probe(kind, corrupt=f"unreadable: {e}")


STREAM = {"native_id": "long", "kind": "string", "codec": "string", "ticks": "long", "codec_profile": "string", "width": "long", "height": "long", "field_order": "string", "channels": "long", "sample_rate": "long", "bit_depth": "long", "language": "string", "duration": "long", "primaries": "string", "transfer": "string", "matrix": "string", "range": "string", "max_cll": "long", "max_fall": "long"}


def mapped(files: DataFrame, rows: Callable[[str, Probe], list[tuple]], schema: str) -> DataFrame:
    """files: path, container, content. One file's rows at a time."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, kind, content in zip(b["path"], b["container"], b["content"], strict=True):
                found = rows(path, probe(kind, bytes(content)))
                if found:
                    yield pd.DataFrame(found, columns=names).convert_dtypes()

    return files.select("path", "container", "content").mapInPandas(run, schema)


def probe_streams(files: DataFrame) -> DataFrame:
    """One row per stream in the container's order, with what the file as a whole has."""
    schema = "path string, container string, corrupt string, refused string, problems array<string>, duration_ms long, index long, " + ", ".join(f"`{k}` {v}" for k, v in STREAM.items())
    return mapped(files, lambda path, p: [(path, p.container, p.corrupt, p.refused, p.problems, p.duration_ms, i, *[s.get(k) for k in STREAM]) for i, s in enumerate(p.streams or [{}])], schema)


def probe_samples(files: DataFrame) -> DataFrame:
    """asset_id (the path), native_id, seq, ts, dur, bytes: one row per sample or packet."""
    return mapped(files, lambda path, p: [(path, *s) for s in p.samples], "asset_id string, native_id long, seq long, ts long, dur long, bytes long")


def probe_cues(files: DataFrame) -> DataFrame:
    """asset_id, native_id, start_ms, end_ms, payload; null payloads aren't text."""
    rows = mapped(files, lambda path, p: [(path, *c) for c in p.cues], "asset_id string, native_id long, start_ms long, end_ms long, raw binary")
    return rows.select("asset_id", "native_id", "start_ms", "end_ms", F.try_validate_utf8(F.col("raw").cast("string")).alias("payload"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
