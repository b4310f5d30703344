"""Plug-ins as programs: manifests, the protocol, and what can go wrong."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark.sql import functions as F

from reelcheck.operators import fold
from reelcheck.rules import plugin

PROGRAM = """
import json, sys, time
r = json.load(sys.stdin)
mode = (r["config"] or {}).get("mode")
if mode == "late": time.sleep(30)
if mode == "dies": sys.exit("no luck")
if mode == "noise": print("x"); sys.exit()
if mode == "much": print("y" * (5 << 20)); sys.exit()
if mode == "old": print(json.dumps({"protocol": 0, "findings": []})); sys.exit()
print(json.dumps({"protocol": r["protocol"], "findings": [{"status": "fail", "message": "size\\n" + str(r["asset"]["size"]), "measured": 5, "expected": "4", "stream": 1, "time_range": {"start_ms": 1, "end_ms": 9}}]}))
"""


def folder(tmp_path, **change):
    own = tmp_path / "studio"
    own.mkdir(exist_ok=True)
    (own / "run.py").write_text(PROGRAM)
    m = {"schema": 1, "id": "studio", "name": "Studio", "version": "1", "protocol": 1, "command": sys.executable.rsplit("/", 1)[-1], "args": ["run.py"], "timeout_ms": 1500, "rules": [{"id": "studio.size", "streams": ["audio"]}]} | change
    (own / "plugin.json").write_text(json.dumps({k: v for k, v in m.items() if v is not None}))
    return own


def test_programs_answer_the_protocol(tmp_path):
    (p,) = plugin.manifest(folder(tmp_path))
    run = lambda mode, kinds=("audio",): plugin.run_one(p, {"config": {"mode": mode}}, {"size": 7}, {"streams": [{"kind": k} for k in kinds]})
    assert run("good") == [("fail", "size7", "5", "4", 1, {"start_ms": 1, "end_ms": 9}, None)] and run("good", ("video",)) == []
    for mode, why in (("late", "no answer in 1500 ms"), ("dies", "no luck"), ("noise", "failed"), ("much", "too large"), ("old", "none of this protocol")):
        (row,) = run(mode)
        assert row[0] == "inconclusive" and why in row[1], (mode, row)
    slow = plugin.Plugin("a.b", lambda a, i, c: __import__("time").sleep(9), timeout_ms=100)
    assert plugin.run_one(slow, {}, {}, {})[0][0] == "inconclusive"


@pytest.mark.parametrize("change", [{"schema": 2}, {"id": "video"}, {"id": "Bad id"}, {"command": None}, {"command": "../x"}, {"timeout_ms": 10**9}, {"rules": []}, {"rules": [{"id": "other.size"}]}, {"rules": [{"id": "studio.a"}, {"id": "studio.a"}]}, {"rules": [{"id": "studio.a", "streams": ["smell"]}]}, {"extra": 1}, {"args": ["x" * 300]}])
def test_manifests_are_checked(tmp_path, change):
    with pytest.raises(plugin.ManifestError):
        plugin.manifest(folder(tmp_path, **change))


def test_folders_of_plugins(tmp_path):
    folder(tmp_path)
    (tmp_path / "empty").mkdir()
    registry = plugin.Registry()
    registry.add_folder(str(tmp_path))
    assert list(registry.plugins) == ["studio.size"]
    with pytest.raises(plugin.ManifestError):
        plugin.manifest(tmp_path / "empty")


def test_dashboard_and_timeline(spark):
    jobs = spark.createDataFrame([(i, f"n{i}", v, "succeeded", 0, 1000 * (i + 1)) for i, v in enumerate(["pass", "warn", "inconclusive", "fail", "fail"])], "job_id long, name string, verdict string, status string, started_ms long, finished_ms long")
    board = fold.dashboard(jobs)
    c = board["counts"].first()
    assert (c.n, c.n_pass, c.n_warn, c.n_fail, c.mean_ms, c.per_hour) == (5, 1, 2, 2, 3000, 1200)
    assert [r.job_id for r in board["failed"].collect()] == [4, 3] and board["recent"].first().job_id == 4
    assert fold.dashboard(jobs.limit(0))["counts"].first().per_hour is None
    assert {r.verdict: r.n for r in fold.counts_by(jobs, "verdict").collect()}["fail"] == 2
    found = spark.createDataFrame([(1, "r", "fail", "error", (500, 600)), (1, "s", "fail", "error", (9999, 20000)), (1, "t", "fail", "error", None), (2, "u", "fail", "error", (0, 5))], "asset_id long, rule_id string, status string, severity string, time_range struct<start_ms:bigint,end_ms:bigint>")
    bars = {r.rule_id: (r.left_percent, r.width_percent) for r in fold.timeline(found, spark.createDataFrame([(1, 10_000), (2, 0)], "asset_id long, duration_ms long")).collect()}
    assert bars["r"] == (5.0, 1.0) and bars["s"][0] == pytest.approx(99.99) and bars["s"][1] == 0.35 and set(bars) == {"r", "s"}
    assert (fold.EXIT_ERROR, fold.EXIT_PATH, fold.EXIT_PROFILE) == (3, 4, 5) and jobs.select(F.lit(1)).count() == 5
