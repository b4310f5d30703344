from __future__ import annotations

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelcheck.functions import scalars
from reelcheck.operators import compare as cmp
from reelcheck.operators import correct, cues, fold, pictures, signals, state
from reelcheck.plans import engine
from reelcheck.profiles import model
from reelcheck.reports import report
from reelcheck.rules import compiler, plugin
from reelcheck.sources import files
from reelcheck.streaming import watch

from .documents import EXPECTED, UNSCANNED_PASS, documents, spotless


@pytest.fixture(scope="module")
def inspected(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    for name, d in documents().items():
        (folder / f"{name}.json").write_text(json.dumps(d, indent=1))
    return files.measurement_documents(spark, str(folder))


@pytest.fixture(scope="module")
def run(inspected):
    return engine.check(inspected, model.load("all-rules"))


def test_documents_have_their_statuses_and_verdicts(run):
    statuses, verdicts = {}, {r.asset_id: r.verdict for r in run.verdicts.collect()}
    for r in run.statuses.collect():
        statuses.setdefault(r.asset_id, {})[r.rule_id] = r.status
    for name, (verdict, failed, unknown) in EXPECTED.items():
        want = {r: "fail" if r in failed else "inconclusive" if r in unknown else "pass" for r in compiler.RULE_IDS}
        assert statuses[name] == want, {k: (v, statuses[name][k]) for k, v in want.items() if statuses[name][k] != v}
        assert verdicts[name] == verdict
    assert {r for r, s in statuses["never-scanned"].items() if s == "pass"} == UNSCANNED_PASS
    assert sum(s == "inconclusive" for s in statuses["never-scanned"].values()) == 35 and verdicts["never-scanned"] == "warn"


def test_counts_and_exit_code(run):
    counts = {r.asset_id: r for r in run.counts.collect()}
    assert (counts["never-scanned"].n_pass, counts["never-scanned"].n_inconclusive) == (11, 35) and counts["spotless"].n_pass == 46
    assert fold.exit_code(run.verdicts).first().exit_code == 2 and fold.exit_code(run.verdicts, 1).first().exit_code == 3


def test_rules_survive_missing_everything(spark):
    rows = spark.createDataFrame([("x",)], "asset_id string").selectExpr("asset_id", "cast(NULL AS {}) AS asset".format(model_schema("ASSET")), "cast(NULL AS {}) AS inspection".format(model_schema("INSPECTION")))
    got = {(r.rule_id, r.status) for r in compiler.findings(rows, model.load("all-rules")).collect()}
    assert all(s != "fail" for _, s in got) and len({r for r, s in got if s == "inconclusive"}) >= 38


def model_schema(name):
    from reelcheck import schema

    return getattr(schema, name)


def test_profiles_are_strict():
    good = model.load("all-rules")
    assert good.digest() == model.parse((model.bundled()["all-rules"]).read_text().replace("Every built-in", "Each built-in")).digest()
    bad = ["[]", "rules: {}", "name: x\nrulez: {}", "name: x\nrules: {cinema: {}}", "name: x\nrules: {video: {sharpness: error}}", "name: x\nrules: {video: {blur: {min_sharpness: 1, extra: 2}}}", "name: x\nrules: {video: {resolution: {expected: big}}}", "name: x\nrules: {container: {bitrate: {severity: error}}}", "name: x\nrules: {container: {readable: loud}}", "name: x\nrules: {voice: {speakers: {severity: error}}}", "name: x\npolicy: {fail_on: never}", "name: x\nrules: {custom: [{id: bad id, scope: video, metric: width, op: '==', value: 1}]}", "name: x\nrules: {custom: [{id: custom.a, scope: video, metric: codec, op: '<', value: a}]}", "name: x\nrules: {custom: [{id: custom.a, scope: video, metric: width, op: '<', value: a}]}", "name: x\nrules: {custom: [{id: custom.a, scope: container, streams: all, metric: size_bytes, op: '<', value: 1}]}"]
    for text in bad:
        with pytest.raises(model.ProfileError):
            model.parse(text)
    lenient = model.parse("name: x\nrules: {container: {bitrate: {min_bps: 5, severity: loud, other: 1}, timebase: 1/25}}")
    assert lenient.rules["container.bitrate"]["severity"] == "warning" and lenient.rules["container.timebase"]["value"] == "1/25"
    one = model.parse("name: x\nrules: {audio: {peak: {max_db: -1}, clipping: {max_events: 1}}}")
    two = model.parse("name: x\nrules: {audio: {peak: {max_db: -2}, clipping: {max_events: 1}}}")
    assert one.config_hash("audio.peak") != two.config_hash("audio.peak") and one.config_hash("audio.clipping") == two.config_hash("audio.clipping") and one.config_hash("audio.phase") is None
    assert not engine.needs_decoding(model.parse("name: x\nrules: {video: {resolution: 1x1}}")) and engine.needs_decoding(one)


def test_plugins(inspected):
    registry = plugin.Registry()
    registry.add(plugin.Plugin("studio.slate", lambda a, i, c: [{"status": "fail", "message": f"no\nslate {c['n']}"}]))
    registry.add(plugin.Plugin("studio.broken", lambda a, i, c: 1 / 0))
    registry.add(plugin.Plugin("studio.data", lambda a, i, c: [{"status": "warn"}], needs=("data",)))
    profile = model.parse("name: x\nrules: {plugins: [{rule: studio.slate, config: {n: 3}}, {rule: studio.broken, severity: info}, {rule: studio.data}]}")
    got = {(r.asset_id, r.rule_id, r.status, r.severity, r.message) for r in engine.check(inspected, profile, registry).findings.collect()}
    assert ("never-scanned", "studio.slate", "fail", "error", "noslate 3") in got and ("never-scanned", "studio.broken", "inconclusive", "info", "the plug-in failed: division by zero") in got
    assert {a for a, r, *_ in got if r == "studio.data"} == {"broken-box"}
    with pytest.raises(LookupError):
        engine.check(inspected, profile, plugin.Registry())
    with pytest.raises(ValueError):
        registry.add(plugin.Plugin("studio.slate", lambda a, i, c: []))


def test_reports(inspected, run):
    profile = model.load("all-rules")
    rows = report.build(inspected, run.findings, run.verdicts, profile, "2026-01-01 00:00:00").cache()
    docs = {r.asset_id: json.loads(r.report) for r in report.json_rows(rows).collect()}
    assert docs["bad-picture"]["verdict"] == "fail" and docs["bad-picture"]["resolution"] == "1500x1075" and docs["spotless"]["integrity"]["profile_sha256"] == profile.digest()
    pages = {r.asset_id: r.html for r in report.html_rows(rows, "audit", True).collect()}
    assert "video.hdr" in pages["bad-picture"] and "profile_sha256" in pages["spotless"] and "video.hdr" not in {r.asset_id: r.html for r in report.html_rows(rows, "executive").collect()}["bad-picture"]
    pdfs = {r.asset_id: bytes(r.pdf) for r in report.pdf_rows(rows).collect()}
    assert all(p.startswith(b"%PDF-1.4") and p.rstrip().endswith(b"%%EOF") for p in pdfs.values())
    line = report.csv_rows(run.findings.where("rule_id = 'video.black_frames' AND asset_id = 'bad-picture'")).first()
    assert (line.start_ms, line.end_ms, line.measured, line.expected) == ("60", "561", "501", "500")
    assert "," not in "".join(v for r in report.csv_rows(run.findings).collect() for v in r)


def test_compare_documents(inspected):
    pair = lambda n, c: inspected.where(F.col("asset_id") == n).select(F.lit(1).alias("pair_id"), F.expr("named_struct('streams', asset.streams, 'container', inspection.container, 'video', inspection.video, 'audio', inspection.audio, 'subtitle', inspection.subtitle)").alias(c))
    cells = cmp.compare(pair("spotless", "a").join(pair("bad-picture", "b"), "pair_id"))
    different = {(r.scope, r.field, r.kind) for r in cells.where("state = 'different'").collect()}
    assert {("video 0", "resolution", "major"), ("video 0", "scan order", "major"), ("video 0", "black segments", "major"), ("video 0", "duplicate segments", "minor")} <= different
    assert ("video 0", "frame rate", "major") not in different and cmp.summary(cells).first().worst == "major"
    same = cmp.summary(cmp.compare(pair("spotless", "a").join(pair("spotless", "b"), "pair_id"))).first()
    assert same.n_different == 0 and same.worst == "none"
    both = pair("spotless", "a").join(pair("bad-picture", "b"), "pair_id")
    assert cmp.row_summary(cmp.arrays(both)).collect() == cmp.summary(cmp.compare(both)).collect()


def test_row_folds_agree_with_folds_of_rows(spark, inspected, run):
    rows, ids = compiler.arrays(inspected, model.load("all-rules")), compiler.RULE_IDS
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(fold.row_status(rows), fold.rule_status(inspected, run.findings, fold.rule_list(spark, ids)))
    assert same(fold.row_counts(rows), fold.status_counts(inspected, run.findings, len(ids)))
    assert same(fold.row_verdicts(rows, "error"), fold.verdicts(inspected, run.findings, "error")) and same(fold.row_rollup(rows), fold.rollup(run.findings))


def test_merge_inspections(spark, inspected):
    a, b = (inspected.where(F.col("asset_id") == n).select(F.lit(1).alias("k"), F.col("inspection").alias(c)) for n, c in (("spotless", "a"), ("bad-sound", "b")))
    out = state.merge_inspections(a.join(b, "k")).selectExpr("inspection.audio[0].peak_db AS p", "size(inspection.subtitle) AS s", "size(inspection.video) AS v").first()
    assert (out.p, out.s, out.v) == (-0.99, 1, 1)


def test_state_tables(spark):
    jobs = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "succeeded")], "job_id long, status string")
    got = lambda df: {r.job_id: r.status for r in df.collect()}
    assert got(state.cancel_jobs(jobs, jobs)) == {1: "cancelled", 2: "cancelled", 3: "succeeded"} and got(state.start_jobs(jobs, jobs)) == {1: "running", 2: "running", 3: "succeeded"}
    assert got(state.finish_jobs(jobs, jobs, False)) == {1: "queued", 2: "failed", 3: "succeeded"}
    key = dict(zip(state.CACHE_KEY, "abcde", strict=True))
    cache = spark.createDataFrame([{**key, "stored_at": 1, "result": "x"}])
    again = state.cache_put(cache, spark.createDataFrame([{**key, "stored_at": 2, "result": "y"}]).select(cache.columns))
    assert [r.result for r in again.collect()] == ["y"] and state.cache_clear(again, "other", "c").count() == 1 and state.cache_clear(again, "d", "c").count() == 0


def tone(freq, amplitude, seconds, rate=48000, channels=2, bits=16):
    x = np.round(amplitude * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate) * (1 << (bits - 1))).astype("<i2")
    data = np.repeat(x, channels).tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data


def test_wav_files(spark, tmp_path):
    whole = tone(440, 0.5, 0.5)
    cases = {"a.wav": whole, "cut.WAV": whole[:-1001], "no.wav": b"RIFF....WAVEjunk", "x.mkv": b"\x1a\x45\xdf\xa3" + b"\0" * 20, "t.ts": b"\x47" + (b"\0" * 187 + b"\x47") * 3 + b"\0" * 100, "m.mp4": struct.pack(">I", 24) + b"ftypisom" + b"\0" * 12, "skip.txt": b"x"}
    for n, c in cases.items():
        (tmp_path / n).write_bytes(c)
    (tmp_path / "a.expected.txt").write_text("Hello there")
    (tmp_path / "a.transcript.json").write_text('{"segments": [{"text": "hello"}, {"text": "you"}]}')
    found = files.scan(spark, str(tmp_path)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    assert {r.name: r.c for r in found.select("name", files.container().alias("c")).collect()} == {"a.wav": "wav", "cut.WAV": "wav", "no.wav": "wav", "x.mkv": "matroska", "t.ts": "mpeg-ts", "m.mp4": "iso-bmff"}
    heads = {r.path.split("/")[-1]: r for r in files.wav_headers(found.where("name LIKE '%.wav' OR name LIKE '%.WAV'")).collect()}
    assert (heads["a.wav"].codec, heads["a.wav"].frames, heads["a.wav"].duration_ms, heads["a.wav"].channel_layout, heads["a.wav"].bitrate) == ("pcm_s16le", 24000, 500, "stereo", 1536000)
    assert heads["cut.WAV"].corrupt and heads["cut.WAV"].malformed and heads["no.wav"].corrupt
    blocks = files.pcm_blocks(found.where("name = 'a.wav'")).orderBy("block_no").collect()
    assert len(blocks) == 6 and len(blocks[0].samples) == 8192 and max(blocks[1].samples) == pytest.approx(0.5, abs=1e-3)
    import hashlib

    sums = found.where("name = 'a.wav'").select(files.fingerprint().alias("a"), files.fingerprint(whole=False).alias("b")).first()
    assert sums.a == hashlib.sha256(whole).hexdigest() and sums.b == hashlib.sha256(whole + struct.pack("<Q", len(whole))).hexdigest()
    text = files.transcripts(spark, str(tmp_path), found.where("name = 'a.wav'").select("path")).first()
    assert (text.expected, text.hypothesis) == ("Hello there", "hello you")


def test_loudness_anchors():
    t = np.arange(48000 * 4) / 48000
    sine = lambda f, a: a * np.sin(2 * np.pi * f * t)
    stereo = pictures.loudness(np.stack([sine(1000, 0.5)] * 2), 48000)
    assert stereo == pytest.approx(-6.0, abs=0.3) and pictures.loudness(sine(1000, 0.5), 48000) == pytest.approx(-9.0, abs=0.3)
    assert pictures.loudness(np.zeros(48000), 48000) is None and pictures.loudness(sine(1000, 0.5)[:9600], 48000) is None
    assert pictures.peak_between(sine(1000, 0.5)) == pytest.approx(-6.02, abs=0.05) and pictures.peak_between(sine(8000, 0.5) * np.minimum(1, t)) == pytest.approx(-6.02, abs=0.12)
    assert 0 < pictures.peak_between(np.sign(np.sin(2 * np.pi * 12000 * t + 0.3))) < 4 and pictures.peak_between(np.zeros(10)) == -300.0


def test_picture_kernels():
    flat = np.full((32, 32), 100.0)
    assert pictures.blockiness(flat) is None and pictures.blur(flat) == 0 and pictures.noise(flat) == 0
    rng = np.random.default_rng(1)
    assert pictures.noise(flat + rng.normal(0, 1, flat.shape)) == pytest.approx(1, abs=0.25)
    blocks = np.kron(rng.integers(0, 255, (4, 4)), np.ones((8, 8))) + rng.integers(0, 3, (32, 32))
    assert pictures.blockiness(blocks.astype(float)) > 10 and pictures.reduced(np.ones((4000, 3000))).shape == (1333, 1000)
    levels = np.tile(np.array([0.0, 1.0] * 5)[:, None], (1, 100))
    assert [d for _, d in pictures.transitions(list(levels), 0.1, 0.8, 0.25)] == [1, -1] * 4 + [1] and pictures.transitions(list(np.zeros((5, 10))), 0.1, 0.8, 0.25) == []


def test_word_alignment():
    def cheapest(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 9))] for _ in range(2))
        s, d, i = cues.align(a, b)
        assert s + d + i == cheapest(a, b) and len(a) - d + i == len(b)


def test_transcripts(spark):
    rows = spark.createDataFrame([(1, "The cat’s mat, sat.", "the dog's mat sat sat"), (2, "", "x"), (3, "a b", None), (4, "Same words", "same WORDS!")], "asset_id long, expected string, hypothesis string")
    got = {r.asset_id: r for r in cues.word_errors(rows.where("hypothesis IS NOT NULL")).collect()}
    assert (got[1].substitutions, got[1].deletions, got[1].insertions, got[1].wer) == (1, 0, 1, 0.5) and got[2].wer is None and got[4].wer == 0.0
    words = {r.asset_id: r for r in cues.unexpected_words(rows).collect()}
    assert (words[1].unexpected_total, words[1].unexpected_words) == (1, ["dog's"])
    many = spark.createDataFrame([(1, "a", " ".join(f"w{99 - i:02d}" for i in range(70)))], "asset_id long, expected string, hypothesis string")
    assert cues.unexpected_words(many).first().unexpected_words == [f"w{i:02d}" for i in range(50, 100)]


def test_flash_rule_and_window_agree(spark):
    rng = random.Random(2)
    rows = [(k, i, t) for k in range(40) for i, t in enumerate(sorted(rng.randrange(0, 6000, 50) for _ in range(rng.randint(0, 40))))]
    got = {(r.asset_id, r.start, r.end, r.flashes) for r in signals.flash_windows(spark.createDataFrame(rows, "asset_id long, seq long, ts long"), 3.0).collect()}
    want = set()
    for k in range(40):
        ts, out, first = [t for a, _, t in rows if a == k], [], 0
        for last in range(len(ts)):
            while ts[last] - ts[first] >= 1000:
                first += 1
            n = (last - first + 1) / 2
            if n > 3.0:
                if out and ts[first] <= out[-1][1]:
                    out[-1] = (out[-1][0], ts[last], max(out[-1][2], n))
                else:
                    out.append((ts[first], ts[last], n))
        want |= {(k, *w) for w in out}
    assert got == want and want


@pytest.mark.parametrize(("frames", "rate", "drop", "want"), [(0, 30, 2, "00:00:00;00"), (1799, 30, 2, "00:00:59;29"), (1800, 30, 2, "00:01:00;02"), (17982, 30, 2, "00:10:00;00"), (2589408, 30, 2, "00:00:00;00"), (90000, 25, 0, "01:00:00:00"), (-1, 25, 0, "23:59:59:24")])
def test_timecodes(spark, frames, rate, drop, want):
    assert spark.range(1).selectExpr(f"{scalars.timecode(f'cast({frames} AS bigint)', rate, drop)} AS t").first().t == want


def test_timecodes_of_a_day_are_distinct(spark):
    n = 24 * 3600 * 30 - 2 * (24 * 60 - 24 * 6)
    assert spark.range(0, n, 7).selectExpr(f"{scalars.timecode('id', 30, 2)} AS t").distinct().count() == math.ceil(n / 7)


def test_scalars(spark):
    one = lambda sql: spark.range(1).selectExpr(f"{sql} AS v").first().v
    assert one(scalars.language("' EN-us '")) == "eng" and one(scalars.language("'fr_CA'")) == "fre" and one(scalars.language("'xx'")) == "xx"
    assert one(scalars.visible_text("'00:01 -->{b}Hi <i>you</i> <unclosed'")) == "Hi you"
    assert one(scalars.rational_compare("'30000/1001'", "'2997/100'")) == 1 and one(scalars.rational_value("'1/0'")) is None
    assert one(scalars.packed_language("5575L")) == "eng" and one(scalars.packed_language("21956L")) is None
    with pytest.raises(ValueError):
        scalars.rational_parts("1/0")


def test_correction(spark):
    rows = spark.createDataFrame([(1, -20.0, -3.0, 0.01), (2, -30.0, -3.0, 0.0), (3, None, None, 0.0), (4, -23.01, -3.0, 0.0)], "asset_id long, loudness_lufs double, true_peak_db double, max_dc double")
    got = {r.asset_id: (r.remove_dc, r.gain_db, r.refused) for r in correct.plan(rows).collect()}
    assert got == {1: (True, -3.0, None), 2: (False, None, "over the ceiling"), 3: (False, None, "unmeasured"), 4: (False, None, None)}
    x = spark.createDataFrame([(0.5, 0.1, 0.0), (1.5, 0.0, None), (-1.0, 0.0, 6.0)], "x double, dc double, g double").select(correct.applied(F.col("x"), F.col("dc"), F.col("g"), 16).alias("v"))
    assert [r.v for r in x.collect()] == [13107, 32767, -32768]


def test_watch_checks_arriving_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("spotless", "never-scanned"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(documents()[name]))
    go = lambda: watch.watch(watch.arriving(spark, str(tmp_path / "in")), model.load("all-rules"), str(tmp_path / "out"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    go()
    (tmp_path / "in" / "more.json").write_text(json.dumps(documents()["bad-picture"]))
    go()
    got = {(r.asset_id, r.verdict, r.route, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("spotless", "pass", "pass", 0), ("never-scanned", "warn", "warn", 0), ("bad-picture", "fail", "fail", 1)}


def test_bundled_profiles_parse():
    assert all(compiler.compile_rules(model.load(n)) for n in model.bundled()) and spotless()
