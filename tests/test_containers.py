"""Readers over files built byte by byte."""

from __future__ import annotations

import struct

import pytest

from reelcheck.operators import signals
from reelcheck.sources import containers as c


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def movie(handler=b"vide", fourcc=b"av01", deltas=((3, 1000), (1, 4000), (2, 1000)), n_sizes=6, offset=0, sample=b"x" * 10):
    media = box(b"ftyp", b"isom") + box(b"mdat", sample * 6)
    offset = offset or 12 + 8
    visual = b"\0" * 24 + struct.pack(">HH", 1920, 1080) + b"\0" * 50 + box(b"colr", b"nclx", struct.pack(">HHHB", 9, 16, 9, 0)) + box(b"av1C", bytes([0x81, 0x20, 0x40, 0]))
    sound = b"\0" * 16 + struct.pack(">HH4xI", 2, 16, 48000 << 16)
    entry = box(fourcc, visual if handler == b"vide" else sound if handler == b"soun" else b"\0" * 8)
    stbl = box(b"stbl", box(b"stsd", b"\0" * 4, struct.pack(">I", 1), entry), box(b"stts", b"\0" * 4, struct.pack(">I", len(deltas)), *[struct.pack(">II", *d) for d in deltas]), box(b"stsz", b"\0" * 4, struct.pack(">II", len(sample), n_sizes)), box(b"stsc", b"\0" * 4, struct.pack(">IIII", 1, 1, 6, 1)), box(b"stco", b"\0" * 4, struct.pack(">II", 1, offset)))
    mdia = box(b"mdia", box(b"mdhd", b"\0" * 12, struct.pack(">IIHH", 25000, 9000, 5575, 0)), box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", stbl))
    return media + box(b"moov", box(b"mvhd", b"\0" * 12, struct.pack(">II", 1000, 360)), box(b"trak", mdia))


def test_iso():
    p = c.probe("iso-bmff", movie())
    s = p.streams[0]
    assert (s["codec"], s["width"], s["height"], s["language"], s["primaries"], s["transfer"], s["bit_depth"], s["codec_profile"], p.duration_ms) == ("av1", 1920, 1080, "eng", "bt2020", "smpte2084", 10, "1", 360)
    assert [x[2] for x in p.samples] == [0, 1000, 2000, 3000, 7000, 8000] and not p.problems and not p.corrupt and not p.refused
    assert c.probe("iso-bmff", movie(n_sizes=5)).problems and c.probe("iso-bmff", movie(offset=10**6)).corrupt
    assert c.probe("iso-bmff", movie(fourcc=b"avc1")).refused == "avc1 video" and c.probe("iso-bmff", movie(b"soun", b"mp4a")).refused
    assert c.probe("iso-bmff", movie(b"soun", b"sowt")).streams[0]["sample_rate"] == 48000
    text = c.probe("iso-bmff", movie(b"text", b"tx3g", sample=struct.pack(">H", 5) + b"hello"))
    assert text.cues[1] == (0, 40, 80, b"hello") and len(text.cues) == 6


def element(key, body):
    size = len(body)
    return bytes.fromhex(key) + (bytes([0x80 | size]) if size < 127 else struct.pack(">I", 0x10000000 | size)) + body


def clip(blocks, codec=b"V_VP9", kind=1, more=b""):
    video = element("e0", element("b0", struct.pack(">H", 640)) + element("ba", struct.pack(">H", 360)) + element("9a", b"\x02"))
    track = element("ae", element("d7", b"\x01") + element("83", bytes([kind])) + element("86", codec) + element("23e383", struct.pack(">I", 40_000_000)) + (video if kind == 1 else b"") + element("22b59c", b"fre"))
    cluster = element("1f43b675", element("e7", b"\x64") + b"".join(blocks))
    segment = element("18538067", element("1549a966", element("2ad7b1", struct.pack(">I", 1_000_000)) + element("4489", struct.pack(">f", 500.0))) + element("1654ae6b", track) + cluster + more)
    return element("1a45dfa3", element("4282", b"webm")) + segment


def simple(ts, payload=b"abc", flags=0):
    return element("a3", b"\x81" + struct.pack(">hB", ts, flags) + payload)


def test_matroska():
    p = c.probe("matroska", clip([simple(0), simple(40), simple(200)]))
    s = p.streams[0]
    assert (s["codec"], s["width"], s["field_order"], s["language"], s["ticks"], p.duration_ms) == ("vp9", 640, "progressive", "fre", 1000, 500)
    assert [(x[2], x[4]) for x in p.samples] == [(100, 3), (140, 3), (300, 3)]
    assert c.probe("matroska", clip([simple(0)], b"V_MPEG4/ISO/AVC")).refused and c.probe("matroska", clip([simple(0)])[:-4]).streams
    group = element("a0", element("a1", b"\x81" + struct.pack(">hB", 5, 0) + b"1,0,Default,,0,0,0,,Hi, you") + element("9b", b"\x32"))
    assert c.probe("matroska", clip([group], b"S_TEXT/ASS", 17)).cues == [(1, 105, 155, b"Hi, you")]


@pytest.mark.parametrize(("flags", "payload"), [(0x02, bytes([2, 3, 2]) + b"aaabbc"), (0x04, bytes([2]) + b"aabbcc"), (0x06, bytes([2, 0x83, 0xBE]) + b"aaabbc")])
def test_lacing(flags, payload):
    want = {0x02: [b"aaa", b"bb", b"c"], 0x04: [b"aa", b"bb", b"cc"], 0x06: [b"aaa", b"bb", b"c"]}[flags]
    assert c.laced(payload, 0, len(payload), flags) == want


def packet(pid, count, payload, start=True):
    stuffing = 184 - len(payload)
    adapt = b"" if not stuffing else bytes([stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
    return b"\x47" + struct.pack(">HB", pid | (0x4000 if start else 0), (0x30 if stuffing else 0x10) | count & 15) + adapt + payload


def psi(body):
    return b"\0" + body + struct.pack(">I", c.crc32_mpeg(body))


def pes(pts):
    return b"\0\0\1\xbd\0\0\x80\x80\x05" + bytes([0x21 | (pts >> 29) & 0x0E]) + struct.pack(">HH", (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1) + b"x" * 20


def broadcast(times, kind=0x06, mark=b"AV01", counts=None):
    pat = psi(b"\0\xb0\x0d\0\1\xc1\0\0" + struct.pack(">HH", 1, 0xE000 | 0x100))
    info = b"\x05\x04" + mark + b"\x0a\x04deu\0"
    pmt = psi(b"\x02" + struct.pack(">H", 0xB000 | 18 + len(info)) + b"\0\1\xc1\0\0" + struct.pack(">HH", 0xE101, 0xF000) + struct.pack(">BHH", kind, 0xE101, 0xF000 | len(info)) + info)
    counts = counts or range(len(times))
    return packet(0, 0, pat) + packet(0x100, 0, pmt) + b"".join(packet(0x101, n, pes(t)) for n, t in zip(counts, times, strict=True))


def test_transport():
    top = 1 << 33
    p = c.probe("mpeg-ts", broadcast([top - 3600, 0, 3600, 7200]))
    assert [x[2] for x in p.samples] == [top - 3600, 0, 3600, 7200] and (p.streams[0]["codec"], p.streams[0]["language"]) == ("av1", "deu") and not p.problems
    assert c.probe("mpeg-ts", broadcast([0, 1, 2], counts=[0, 1, 3])).problems == ["1 continuity errors on 257"]
    assert c.probe("mpeg-ts", broadcast([0], 0x1B)).refused and "1 sync losses" in c.probe("mpeg-ts", broadcast([0]) + b"\0" + broadcast([5])).problems
    assert "1 checksum errors" in c.probe("mpeg-ts", broadcast([0]).replace(b"\0\1\xc1", b"\0\2\xc1", 1)).problems


def test_sound_files():
    rate = struct.pack(">HQ", 16383 + 15, 44100 << 48)
    a = c.probe("aiff", b"FORM\0\0\0\0AIFF" + b"COMM" + struct.pack(">IhIh", 18, 2, 44100, 16) + rate)
    assert (a.streams[0]["codec"], a.streams[0]["sample_rate"], a.duration_ms) == ("pcm_s16be", 44100, 1000)
    f = c.probe("flac", b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((48000 << 44) | (1 << 41) | (23 << 36) | 96000).to_bytes(8, "big") + b"\0" * 16)
    assert (f.streams[0]["channels"], f.streams[0]["bit_depth"], f.duration_ms) == (2, 24, 2000)
    page = lambda granule, body: b"OggS\0\0" + struct.pack("<q", granule) + b"\0" * 12 + b"\x01" + bytes([len(body)]) + body
    o = c.probe("ogg", page(0, b"OpusHead\x01\x02" + b"\0" * 9) + page(96000, b"data") + page(-1, b"x"))
    assert (o.streams[0]["codec"], o.streams[0]["channels"], o.duration_ms) == ("opus", 2, 2000)


def test_broken_files_are_findings():
    for kind, data in (("iso-bmff", movie()), ("matroska", clip([simple(0)])), ("mpeg-ts", broadcast([0, 1])), ("flac", b"fLaC"), ("ogg", b"OggS"), ("aiff", b"FORM\0\0\0\0AIFF")):
        for cut in range(0, len(data), 7):
            c.probe(kind, data[:cut])
            c.probe(kind, data[:cut] + b"\xff" * 9 + data[cut:])
    assert c.probe(None, b"").corrupt


def test_tables_and_their_statistics(spark):
    files = spark.createDataFrame([("a.mp4", "iso-bmff", movie()), ("b.ts", "mpeg-ts", broadcast([0, 3600, 7200, 36000, 39600])), ("c.mkv", "matroska", clip([simple(0), simple(40), simple(80), simple(400), simple(10)]))], "path string, container string, content binary")
    streams = {r.path: r for r in c.probe_streams(files).collect()}
    assert streams["a.mp4"].transfer == "smpte2084" and streams["b.ts"].ticks == 90000
    rows = c.probe_samples(files)
    steps = signals.deltas(rows.where("asset_id = 'a.mp4'"))
    assert signals.delta_mode(steps).first().mode == 1000 and signals.delta_median(steps).first()["median"] == 1000
    assert [(r.start, r.end) for r in signals.gaps(steps, "iso").collect()] == [(4000, 7000)]
    assert [(r.start, r.end) for r in signals.gaps(signals.deltas(rows.where("asset_id = 'b.ts'")), "ts").collect()] == [(7200, 36000)]
    assert c.probe_cues(files).count() == 0
