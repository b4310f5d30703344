"""Registered queries do the whole job: against brute force over small tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from reelcheck.plans import fold_queries, measure_queries
from reelcheck.plans import rule_queries as r
from reelcheck.rules.compiler import RULE_IDS

TABLES = "/root/testdata/sf0.001"
ORDER = ["pass", "warn", "inconclusive", "fail"]


@pytest.fixture(scope="module")
def by_rule():
    """(asset, rule) -> statuses of its findings, by the SQL of each rule; and each asset's fail_on."""
    db = duckdb.connect()
    for t in ("orders", "lineitem", "customer", "part", "supplier", "nation", "region"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    found: dict[tuple[int, str], list[str]] = {}
    for rule in RULE_IDS:
        for asset, status in db.execute(f"{r.PRELUDE} SELECT asset_id, status FROM ({r.SQL[rule]})").fetchall():
            found.setdefault((asset, rule), []).append(status)
    return found, dict(db.execute(f"{r.PRELUDE} SELECT asset_id, fail_on FROM flat").fetchall())


def test_folds_have_all_rules(spark, by_rule):
    found, fail_on = by_rule
    got = lambda name: fold_queries.QUERIES[name](spark, TABLES).collect()
    assert len(RULE_IDS) == 46 and any(rule == "video.black_frames" for _, rule in found)
    worst = {k: max(s, key=ORDER.index) for k, s in found.items()}
    assert {(x.asset_id, x.rule_id): (x.status, x.n_findings) for x in got("rule_status")} == {(a, i): (worst.get((a, i), "pass"), len(found.get((a, i), ()))) for a in fail_on for i in RULE_IDS}
    bad = {k: [s for s in own if s != "pass"] for k, own in found.items()}
    assert {(x.asset_id, x.rule_id): (x.status, x.n_findings) for x in got("rule_rollup")} == {k: (worst[k], len(s)) for k, s in bad.items() if s}
    assert {(x.asset_id, x.rule_id, x.status): x.n for x in got("template_summary")} == Counter((*k, s) for k, own in bad.items() for s in own)
    of_asset = {a: Counter({"pass": len(RULE_IDS)}) for a in fail_on}
    for (a, _), own in found.items():
        of_asset[a].update(own)
        of_asset[a]["pass"] -= 1
    assert {x.asset_id: (x.n_pass, x.n_warn, x.n_inconclusive, x.n_fail) for x in got("status_counts")} == {a: tuple(n[s] for s in ORDER) for a, n in of_asset.items()}
    want = {}
    for a, n in of_asset.items():
        at = fail_on[a] != "critical"  # findings that aren't passes are errors
        failed, below, unknown = n["fail"] * at, n["fail"] * (not at), n["inconclusive"] * at
        want[a] = (failed, below, unknown, "fail" if failed else "warn" if below + unknown else "pass")
    assert {x.asset_id: (x.failed, x.below, x.inconclusive, x.verdict) for x in got("verdict")} == want


def test_unexpected_words_keeps_pairs_with_long_lists(spark, tmp_path):
    many = [f"w{i * 7 % 71:02d}" for i in range(71)]
    turns = [(1, 0, "a b"), (1, 1, " ".join([*many, "w00", "a"])), (1, 2, "a new a new"), (1, 3, None), (2, 0, "x"), (2, 1, " ".join(many[:50]))]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for (c, t, x), (c2, _, y) in zip(turns, turns[1:], strict=False):
        if c == c2 and y is not None:
            strange = [w for w in y.split() if w not in x.split()]
            want[c * 1000 + t] = (len(strange), " ".join(sorted(list(dict.fromkeys(strange))[:50])))
    got = {r.asset_id: (r.unexpected_total, r.unexpected_words) for r in measure_queries.QUERIES["unexpected_words"](spark, str(tmp_path)).collect()}
    assert got == want and got[1000][0] == 72 and len(got[1000][1].split()) == 50


def test_packed_language_gives_what_its_sql_gives(spark, tmp_path):
    """All codes of 15 bits, und and null among them."""
    spark.range(32_769).selectExpr("id AS l_orderkey", "CASE WHEN id < 32768 THEN id END AS l_partkey").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = Counter(db.execute(measure_queries.ORACLES["packed_language"]).fetchall())
    assert Counter(map(tuple, measure_queries.QUERIES["packed_language"](spark, str(tmp_path)).collect())) == want and "und" in {w for _, _, w in want}
