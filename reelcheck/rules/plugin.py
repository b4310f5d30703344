"""Plug-in rules: registered Python functions, or programs that get one request as JSON on their input and answer on their output.

A manifest (``plugin.json``) names a program and its rules.  Whatever a plug-in does - an error, a wrong answer, too much of it, or none in
time - is one inconclusive finding of its rule; the profile says what the rule is called and how severe it is.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RANGE

MOST_FINDINGS, MOST_MESSAGE, MOST_ANSWER, MOST_NOTE = 1000, 2000, 4 << 20, 4096
#: The protocol's version, the longest and the usual time of a rule in ms, and the bounds of a manifest.
PROTOCOL, LONGEST_MS, USUAL_MS, MOST_RULES, MOST_ARGS, MOST_ARG, MOST_MANIFEST = 1, 300_000, 10_000, 64, 32, 256, 256 << 10
PLUGIN_ID = re.compile(r"[a-z0-9][a-z0-9_-]*")
RESERVED = ("container", "video", "audio", "subtitle", "voice", "custom")
KINDS = ("video", "audio", "subtitle")
#: What a program sees of the environment.
PASSED_ON = ("PATH", "HOME", "LANG", "LC_ALL", "TMPDIR", "SYSTEMROOT")
STATUSES = ("pass", "warn", "fail", "inconclusive")
FIELDS = "status string, severity string, message string, measured string, expected string, stream_idx long, time_range " + RANGE + ", evidence string"
SCHEMA = "asset_id {}, rule_ord int, finding_ord int, rule_id string, " + FIELDS
NAMES = ["asset_id", "rule_ord", "finding_ord", "rule_id", "status", "severity", "message", "measured", "expected", "stream_idx", "time_range", "evidence"]


@dataclass
class Plugin:
    rule_id: str
    run: Callable[[dict, dict, object], list[dict]] | None = None
    needs: tuple[str, ...] = ()  # kinds of streams without which the rule passes unseen
    command: tuple[str, ...] = ()  # a program and its arguments, in place of a function
    folder: str | None = None  # where the program runs
    timeout_ms: int = USUAL_MS
    decoded: bool = False  # the rule reads what only decoding measures


class ManifestError(ValueError):
    """A manifest that can't be used, and why."""


def manifest(folder: str | Path) -> list[Plugin]:
    """The rules of ``plugin.json`` in a folder, all checked."""
    path = Path(folder) / "plugin.json"
    try:
        if path.stat().st_size > MOST_MANIFEST:
            raise ManifestError(f"{path} is too large")
        m = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ManifestError(f"{path} can't be read: {e}") from e
    known(m, {"schema", "id", "name", "version", "protocol", "command", "args", "timeout_ms", "rules"}, {"schema", "id", "name", "version", "protocol", "command", "rules"}, str(path))
    args, timeout = m.get("args") or [], m.get("timeout_ms") or USUAL_MS
    checks = [
        (m["schema"] == 1 and m["protocol"] == PROTOCOL, "another schema or protocol"),
        (isinstance(m["id"], str) and PLUGIN_ID.fullmatch(m["id"]) and m["id"] not in RESERVED, "an id that can't be a plug-in's"),
        (isinstance(m["command"], str) and m["command"] and "\0" not in m["command"], "no command"),
        (isinstance(args, list) and len(args) <= MOST_ARGS and all(isinstance(a, str) and len(a) <= MOST_ARG for a in args), "too many or too long arguments"),
        (isinstance(timeout, int) and 0 < timeout <= LONGEST_MS, "a time limit that is out of range"),
        (isinstance(m["rules"], list) and 0 < len(m["rules"]) <= MOST_RULES, "no rules, or too many"),
    ]
    for good, why in checks:
        if not good:
            raise ManifestError(f"{path} has {why}")
    program = m["command"]
    if "/" in program:  # a path is one inside the folder; a bare name is looked up
        inside = (path.parent / program).resolve()
        if path.parent.resolve() not in inside.parents:
            raise ManifestError(f"{path} has a command outside its folder")
        program = str(inside)
    out: list[Plugin] = []
    for r in m["rules"]:
        known(r, {"id", "description", "decode", "streams"}, {"id"}, f"{path}: a rule")
        if not re.fullmatch(re.escape(m["id"]) + r"\.[a-z0-9][a-z0-9_-]*", r["id"]) or r["id"] in [p.rule_id for p in out]:
            raise ManifestError(f"{path} has the rule id {r['id']!r}, which isn't its own or is there twice")
        if r.get("decode", "none") not in ("none", "stream") or any(k not in KINDS for k in r.get("streams", [])):
            raise ManifestError(f"{path}: {r['id']} asks for what there isn't")
        out.append(Plugin(r["id"], None, tuple(r.get("streams", [])), (program, *args), str(path.parent), timeout, r.get("decode") == "stream"))
    return out


def known(m: object, allowed: set[str], needed: set[str], where: str) -> None:
    if not isinstance(m, dict) or set(m) - allowed or needed - set(m):
        raise ManifestError(f"{where} has missing or unknown entries")


def answer(plugin: Plugin, config: dict, asset: dict, inspection: dict) -> list[dict]:
    """The findings as the plug-in gives them; raises whatever is wrong."""
    if plugin.run is not None:
        return in_time(plugin, lambda: list(plugin.run(asset, inspection, config.get("config"))))
    request = json.dumps({"protocol": PROTOCOL, "rule": plugin.rule_id, "config": config.get("config"), "asset": asset, "inspection": inspection}).encode()
    env = {k: os.environ[k] for k in PASSED_ON if k in os.environ} | {"REELCHECK_PLUGIN_PROTOCOL": str(PROTOCOL)}
    child = subprocess.Popen(plugin.command, cwd=plugin.folder, env=env, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    parts: dict[str, bytes] = {}

    def read(name: str, pipe, most: int) -> None:  # noqa: ANN001
        parts[name] = pipe.read(most + 1)
        while pipe.read(1 << 16):  # what is too much is thrown away, so that the program can end
            pass

    def write() -> None:
        try:
            child.stdin.write(request)
            child.stdin.close()
        except OSError:  # a program that doesn't read all is told by its answer
            pass

    jobs = [threading.Thread(target=write, daemon=True), threading.Thread(target=read, args=("out", child.stdout, MOST_ANSWER), daemon=True), threading.Thread(target=read, args=("err", child.stderr, MOST_NOTE), daemon=True)]
    for job in jobs:
        job.start()
    try:
        code = child.wait(plugin.timeout_ms / 1000)
    except subprocess.TimeoutExpired as e:
        child.kill()
        child.wait()
        raise TimeoutError(f"no answer in {plugin.timeout_ms} ms") from e
    for job in jobs[1:]:
        job.join(5)
    if code:
        raise ValueError(f"it ended with {code} {parts.get('err', b'').decode(errors='replace').strip()}")
    if len(parts.get("out", b"")) > MOST_ANSWER:
        raise ValueError("its answer is too large")
    found = json.loads(parts.get("out", b""))
    if not isinstance(found, dict) or found.get("protocol") != PROTOCOL or not isinstance(found.get("findings"), list):
        raise ValueError("its answer is none of this protocol")
    return found["findings"]


def in_time(plugin: Plugin, f: Callable[[], list[dict]]) -> list[dict]:
    """The result of a function; one that takes too long is left behind."""
    box: dict[str, object] = {}

    def run() -> None:
        try:
            box["found"] = f()
        except Exception as e:  # noqa: BLE001  whatever a plug-in does
            box["error"] = e

    job = threading.Thread(target=run, daemon=True)
    job.start()
    job.join(plugin.timeout_ms / 1000)
    if "error" in box:
        raise box["error"]
    if "found" not in box:
        raise TimeoutError(f"no answer in {plugin.timeout_ms} ms")
    return box["found"]


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def add(self, plugin: Plugin) -> None:
        if plugin.rule_id in self.plugins:
            raise ValueError(f"rule {plugin.rule_id} is there twice")
        self.plugins[plugin.rule_id] = plugin

    def add_folder(self, folder: str) -> None:
        """All plug-ins in the folders below this one that have a manifest."""
        for path in sorted(Path(folder).glob("*/plugin.json")):
            for plugin in manifest(path.parent):
                self.add(plugin)

    def require(self, wanted: list[dict]) -> None:
        """A profile that names rules that aren't installed is refused before anything runs."""
        missing = [w["rule"] for w in wanted if w["rule"] not in self.plugins]
        if missing:
            raise LookupError("plug-in rules that are not installed: " + ", ".join(sorted(missing)))


def clean(message: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", "", str(message))[:MOST_MESSAGE]


def shown(value: object) -> str | None:
    return None if value is None else clean(value if isinstance(value, str) else json.dumps(value))


def run_one(plugin: Plugin, config: dict, asset: dict, inspection: dict) -> list[tuple]:
    """(status, message, measured, expected, stream, range, evidence); any failure is one inconclusive finding."""
    streams = inspection.get("streams") or asset.get("streams") or []
    if any(all(s.get("kind") != kind for s in streams) for kind in plugin.needs):
        return []
    try:
        rows = []
        for f in answer(plugin, config, asset, inspection)[:MOST_FINDINGS]:
            if str(f["status"]) not in STATUSES:
                raise ValueError("unknown status")
            span, index = f.get("time_range"), f.get("stream", f.get("stream_idx"))
            span = None if span is None else {"start_ms": int(span["start_ms"]), "end_ms": int(span["end_ms"])}
            rows.append((str(f["status"]), clean(f.get("message", "")), shown(f.get("measured")), shown(f.get("expected")), None if index is None else int(index), span, shown(f.get("evidence"))))
        return rows
    except Exception as e:  # noqa: BLE001  whatever a plug-in does
        return [("inconclusive", clean(f"the plug-in failed: {e}"), None, None, None, None, None)]


def findings(inspections: DataFrame, wanted: list[dict], registry: Registry, first_ord: int = 1000, key: str = "asset_id") -> DataFrame:
    """Findings of the profile's plug-in rules; rule ids and severities are the profile's."""
    registry.require(wanted)
    rules = [(first_ord + i, w, registry.plugins[w["rule"]]) for i, w in enumerate(wanted)]
    rows = inspections.select(F.col(key).alias("k"), F.to_json("asset").alias("a"), F.to_json("inspection").alias("i"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, a, i in zip(b["k"], b["a"], b["i"], strict=True):
                asset, inspection = json.loads(a or "{}"), json.loads(i or "{}")
                for n, w, p in rules:
                    out += [(k, n, j, w["rule"], status, w["severity"], *more) for j, (status, *more) in enumerate(run_one(p, w, asset, inspection))]
            yield pd.DataFrame(out, columns=NAMES).astype({"stream_idx": "Int64"})

    return rows.mapInPandas(run, SCHEMA.format(dict(inspections.dtypes)[key]))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
