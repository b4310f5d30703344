"""From files to inspections and verdicts, corrections, and kernels against plain loops."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelcheck.operators import correct, cues, pictures, signals
from reelcheck.plans import engine
from reelcheck.profiles import model
from reelcheck.sources import assemble, files

from .test_containers import broadcast, clip, movie, simple
from .test_engine import tone


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    cases = {"a.wav": tone(1000, 0.5, 2), "cut.wav": tone(440, 0.5, 0.5)[:-1001], "b.mp4": movie(), "c.mkv": clip([simple(0), simple(40), simple(80), simple(400)]), "d.ts": broadcast([(1 << 33) - 3600, 0, 3600, 36000, 39600]), "odd.mp4": b"RIFF\0\0\0\0AVI LIST" + b"x" * 20}
    for name, content in cases.items():
        (root / name).write_bytes(content)
    (root / "a.expected.txt").write_text("Hello there you")
    (root / "a.transcript.txt").write_text("hello you two")
    return str(root)


def test_files_become_inspections(spark, folder):
    rows = {r.asset_id.split("/")[-1]: r for r in assemble.inspections(spark, folder).collect()}
    assert set(rows) == {"a.wav", "cut.wav", "b.mp4", "c.mkv", "d.ts", "odd.mp4"}
    a = rows["a.wav"].inspection
    assert (a.container.validity, a.container.format, a.container.duration, len(a.streams), len(a.audio), a.video) == ("ok", "wav", 2000, 1, 1, [])
    assert a.diagnostics["inspector"] and a.audio[0].stream_idx == 0 and a.audio[0].decoded_frame_count == 96000
    assert a.audio[0].peak_db == pytest.approx(-6.02, abs=0.01) and a.audio[0].loudness_lufs == pytest.approx(-6.0, abs=0.3) and a.audio[0].phase_correlation == pytest.approx(1)
    assert (a.streams[0].codec, a.streams[0].channel_layout, a.streams[0].duration) == ("pcm_s16le", "stereo", 2)
    t = a.voice[0].transcript
    assert (t.expected_words, t.deletions, t.insertions, t.unexpected_total) == (3, 0, 0, 1)
    assert rows["cut.wav"].inspection.container.validity.startswith('corrupt: "') and rows["cut.wav"].inspection.container.malformed_metadata
    assert all(rows[n].inspection.container.validity.startswith('unreadable: "') for n in ("odd.mp4",)) and "avi" in rows["odd.mp4"].inspection.container.validity
    b = rows["b.mp4"].inspection
    assert (b.streams[0].codec, b.video[0].hdr.transfer, b.video[0].stream_idx, b.container.duration) == ("av1", "smpte2084", 0, 360)
    assert [(g.start_ms, g.end_ms) for g in b.container.timestamp_gaps] == [(160, 280)] and b.container.timestamps_contiguous is False
    assert b.streams[0].frame_rate == "5000/320"
    assert [(g.start_ms, g.end_ms) for g in rows["c.mkv"].inspection.container.timestamp_gaps] == [(220, 500)]
    d = rows["d.ts"].inspection.container
    assert [g.end_ms - g.start_ms for g in d.timestamp_gaps] == [360]  # across the turn of the counter
    assert rows["b.mp4"].asset.size_bytes == len(movie()) and len(rows["b.mp4"].asset.fingerprint.sha256) == 64


def test_files_become_verdicts(spark, folder):
    run = engine.check_folder(spark, folder, model.load("all-rules"))
    verdicts = {r.asset_id.split("/")[-1]: r.verdict for r in run.verdicts.collect()}
    assert verdicts["cut.wav"] == verdicts["odd.mp4"] == "fail" and len(verdicts) == 6
    failed = {(r.asset_id.split("/")[-1], r.rule_id) for r in run.findings.where("status = 'fail'").collect()}
    assert {("cut.wav", "container.container_validity"), ("odd.mp4", "container.readable"), ("c.mkv", "container.timestamp_continuity")} <= failed
    assert engine.info(spark, folder).where("codec = 'vp9'").count() == 1
    assert assemble.inspections(spark, folder).where("asset_id LIKE '%.none'").count() == 0


def test_no_files_no_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no media")
    assert assemble.inspections(spark, str(tmp_path)).count() == 0


def test_corrections_are_measured_again(spark, tmp_path):
    for name, content in {"quiet.wav": tone(1000, 0.05, 2), "good.wav": tone(1000, 10 ** (-23 / 20) * 10 ** (0.0 / 20), 2), "silent.wav": tone(1000, 0.0, 2), "hot.wav": tone(1000, 0.05, 2)}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r.path.split("/")[-1]: r for r in engine.correct(spark, str(tmp_path)).collect()}
    quiet = rows["quiet.wav"]
    assert quiet.gain_db == pytest.approx(-23 - quiet.loudness_before) and quiet.loudness_after == pytest.approx(-23, abs=0.05) and quiet.refused is None
    x, rate = files.samples_of(bytes(quiet.content))
    assert rate == 48000 and pictures.loudness(x.T, rate) == pytest.approx(quiet.loudness_after, abs=1e-6)
    assert rows["silent.wav"].refused == "unmeasured" and rows["silent.wav"].content is None
    loud = {r.path.split("/")[-1]: r for r in engine.correct(spark, str(tmp_path), target_lufs=-3.0).collect()}
    assert loud["quiet.wav"].refused is None or loud["quiet.wav"].gain_db is None
    assert engine.correct(spark, str(tmp_path), target_lufs=3.0).where("refused = 'over the ceiling'").count() == 3
    for bits in (8, 16, 24, 32):
        y = np.array([[0, 5], [-(1 << (bits - 1)), (1 << (bits - 1)) - 1]])
        again, rate = files.samples_of(correct.wav(y, 44100, bits))
        assert (again * (1 << (bits - 1)) == y).all() and rate == 44100


def test_cue_ranges(spark):
    rows = [(1, True, 0, 1000, "a\nbb"), (1, True, 900, 2000, "<i></i>"), (1, True, 2000, 2000, None), (1, True, 5000, 5500, "x"), (2, False, 0, 10, None), (2, False, 20, 5, None)]
    got = {r.asset_id: r for r in cues.cue_ranges(spark.createDataFrame(rows, "asset_id long, is_text boolean, start_ms long, end_ms long, payload string")).collect()}
    spans = lambda x: [(s.start_ms, s.end_ms) for s in x]
    one, two = got[1], got[2]
    assert (spans(one.overlaps), spans(one.invalid_durations), spans(one.empty_cues), spans(one.malformed)) == ([(0, 900)], [(2000, 2000)], [(900, 2000)], [(2000, 2000)])
    assert (one.cue_count, one.max_gap_ms, one.max_line_chars, one.max_lines_per_cue, one.max_cue_duration_ms, one.covered_until_ms) == (4, 3000, 2, 2, 1100, 5500)
    assert (two.malformed, two.empty_cues, two.max_line_chars, spans(two.invalid_durations), two.max_gap_ms) == ([], [], None, [(20, 20)], 10)


def plain_machine(clips, least, limit, share):
    """The cells' rules, cell by cell: (frame, direction) of the changes of the picture."""
    cells, out, last = [], [], 0
    for i, frame in enumerate(clips):
        values = [np.float32(v) for v in frame]
        if len(cells) != len(values):
            cells, last = [[v, 0] for v in values], 0
            continue
        ups = downs = 0
        for cell, v in zip(cells, values, strict=True):
            level, way = cell
            if way >= 0 and level - v >= np.float32(least):
                new = -1
            elif way <= 0 and v - level >= np.float32(least):
                new = 1
            else:
                if way and (v - level) * way > 0:
                    cell[0] = v
                continue
            if limit is None or min(level, v) < np.float32(limit):
                ups, downs = ups + (new > 0), downs + (new < 0)
            cell[:] = [v, new]
        n = max(1, int(np.ceil(share * len(values))))
        new = (1 if ups >= downs else -1) if ups >= n and downs >= n else 1 if ups >= n else -1 if downs >= n else 0
        if new and new != last:
            last = new
            out.append((i, new))
    return out


def test_flashes_against_plain_loops():
    rng = np.random.default_rng(5)
    for k in range(500):
        n = int(rng.integers(1, 12))
        clips = [rng.random(n if k % 7 or i < 10 else n + 1).astype(np.float32) * (1 if k % 3 else 0.2) for i in range(20)]
        for least, limit, share in ((0.1, 0.8, 0.25), (0.1, None, 0.5), (0.05, 0.3, 0.01)):
            assert pictures.transitions(clips, least, limit, share) == plain_machine(clips, least, limit, share)


def test_flash_cases():
    flat = lambda v: np.full(1000, v, np.float32)
    run = lambda values, **more: len(pictures.transitions([flat(v) for v in values], pictures.SWING, more.get("limit", pictures.DARKER)))
    assert run([0.0, 0.6] * 5) == 9 and run([0.85, 1.0] * 5) == 0 and run([0.30, 0.38] * 5) == 0
    assert run(np.linspace(0, 1, 30)) == 1  # one way is one change
    part = lambda cells: [np.where(np.arange(1000) < cells, 0.6 * (i % 2), 0.0).astype(np.float32) for i in range(10)]
    need = int(np.ceil(pictures.AREA * 1000))
    assert pictures.transitions(part(need), 0.1, 0.8) and not pictures.transitions(part(need - 1), 0.1, 0.8)


def test_red_strobe_is_red_only(spark):
    grey = ([128] * 64, [128] * 64)
    red = ([102] * 64, [240] * 64)  # studio-range planes of a saturated red
    rows = []
    for i in range(10):
        cb, cr = red if i % 2 else grey
        rows.append((1, i, i * 40, 8, 8, [63] * 64, cb, cr, 8))
        rows.append((2, i, i * 40, 8, 8, [235 if i % 2 else 16] * 64, *grey, 8))
    frames = spark.createDataFrame(rows, "asset_id long, frame long, ts long, width int, height int, luma array<int>, cb array<int>, cr array<int>, chroma_width int")
    grids = pictures.flash_grid(frames)
    got = {(r.asset_id, r.kind): r.n for r in pictures.flash_transitions(grids).groupBy("asset_id", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got.get((1, "red")) == 9 and got.get((2, "general")) == 9 and (2, "red") not in got
    assert pictures.flash_transitions(grids.limit(0)).count() == 0
    assert pictures.flash_grid(frames.drop("cb", "cr", "chroma_width")).select(F.max(F.array_max("red"))).first()[0] == 0


def test_grids_against_plain_loops():
    rng = np.random.default_rng(3)
    y, cb, cr = rng.integers(16, 236, (100, 300)), rng.integers(16, 240, (50, 150)), rng.integers(16, 240, (50, 150))
    lum, red = pictures.planes_to_grid(y.astype(float), cb.astype(float), cr.astype(float))
    assert len(lum) == len(red) == 128 * 96
    for cell in rng.integers(0, 128 * 96, 40):
        gy, gx = divmod(int(cell), 128)
        y0, y1 = gy * 100 // 96, max((gy + 1) * 100 // 96, gy * 100 // 96 + 1)
        x0, x1 = gx * 300 // 128, max((gx + 1) * 300 // 128, gx * 300 // 128 + 1)
        sums = [0.0, 0.0]
        for a in (1, 3, 5):
            for b in (1, 3, 5):
                py, px = min(y0 + (y1 - y0) * a // 6, 99), min(x0 + (x1 - x0) * b // 6, 299)
                luma, pb, pr = (y[py, px] - 16) / 219, (cb[py // 2, px // 2] - 128) / 224, (cr[py // 2, px // 2] - 128) / 224
                r, bl = luma + 1.5748 * pr, luma + 1.8556 * pb
                g = (luma - 0.2126 * r - 0.0722 * bl) / 0.7152
                r, g, bl = (min(1.0, max(0.0, v)) ** 2.2 for v in (r, g, bl))
                sums[0] += 0.2126 * r + 0.7152 * g + 0.0722 * bl
                sums[1] += max(0.0, r - g - bl) * 320 if r + g + bl > 0 and r / (r + g + bl) >= 0.8 else 0.0
        assert lum[cell] == pytest.approx(sums[0] / 9, abs=1e-5) and red[cell] == pytest.approx(sums[1] / 9, abs=1e-3)


def test_luma_counts_pixels(spark):
    frames = spark.createDataFrame([(1, [0] * 32 + [255] * 32), (1, [100] * 64), (2, [16, 235]), (3, [])], "asset_id long, luma array<int>")
    got = {r.asset_id: r for r in signals.luma_stats(frames).collect()}
    one = got[1]
    assert (one.min, one.max, one.below_legal, one.above_legal, one.clipped_white) == (0, 255, 0.25, 0.25, 0.25) and one.mean == (32 * 255 + 6400) / 128
    assert (got[2].below_legal, got[2].above_legal) == (0, 0) and 3 not in got


def test_recurrence_against_plain_loop():
    rng = np.random.default_rng(8)
    for n in (1, 2, 255, 256, 257, 1500):
        x = rng.normal(size=n)
        for b, a in pictures.biquads(48000.0):
            y, hist = [], [0.0, 0.0, 0.0, 0.0]
            for v in x:
                out = b[0] * v + b[1] * hist[0] + b[2] * hist[1] - a[0] * hist[2] - a[1] * hist[3]
                hist = [v, hist[0], out, hist[2]]
                y.append(out)
            assert pictures.filtered(x, b, a) == pytest.approx(np.array(y), abs=1e-9)


def test_reduction_keeps_a_floor():
    assert pictures.reduced(np.ones((4000, 3000))).shape == (1333, 1000) and pictures.reduced(np.ones((2_000_000, 20))).shape[1] == 20


def test_custom_rules_say_their_message(spark):
    profile = model.parse("name: x\nrules:\n  custom:\n    - {id: custom.size, scope: container, metric: size_bytes, op: '<=', value: 10, message: too large for the client}\n")
    rows = spark.createDataFrame([(1,)], "asset_id long").select("asset_id", assemble.record(assemble.schema.ASSET, size_bytes=F.lit(99)).alias("asset"), assemble.record(assemble.schema.INSPECTION, container=assemble.record(assemble.schema.CONTAINER, validity=F.lit("ok"))).alias("inspection"))
    found = engine.check(rows, profile).findings.collect()
    assert [f.status for f in found] == ["fail"] and "too large for the client" in found[0].message and "99" in found[0].message


def test_samples_of_a_track_are_all_there(spark):
    media = movie(deltas=((70_000, 10),), n_sizes=70_000, sample=b"x")
    from reelcheck.sources import containers as c

    assert c.probe("iso-bmff", media).problems  # more samples than the file can hold
    rng = random.Random(1)
    sizes = [rng.randint(1, 3) for _ in range(5000)]
    table = struct.pack(">II", 0, len(sizes)) + struct.pack(f">{len(sizes)}I", *sizes)
    assert len(table) == 8 + 4 * len(sizes)
