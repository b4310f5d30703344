"""Queries over findings and over the tables that outlive a run, with what each must give in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import correct, fold, state
from ..profiles import model
from ..reports import report
from ..rules.compiler import RULE_IDS, arrays, findings
from ..sources import bindings as b
from . import rule_queries as r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


IDS = RULE_IDS
ALL = r.PRELUDE + ", found AS (" + " UNION ALL ".join(f"SELECT asset_id, '{i}' AS rule_id, status, CASE WHEN status = 'pass' THEN 'info' ELSE 'error' END AS severity FROM ({r.SQL[i]})" for i in IDS) + ")"
RANKED = ALL + ", best AS (SELECT asset_id, rule_id, max(CASE status WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 WHEN 'inconclusive' THEN 2 ELSE 3 END) AS rnk, count(*) AS n_findings FROM found GROUP BY 1, 2), rules AS (SELECT unnest([" + ", ".join(f"'{i}'" for i in IDS) + "]) AS rule_id)"
NAME = "CASE {} WHEN 3 THEN 'fail' WHEN 2 THEN 'inconclusive' WHEN 1 THEN 'warn' ELSE 'pass' END"


def found(spark, sf, *more):  # noqa: ANN001, ANN201
    return arrays(b.inspections(spark, sf), model.load(r.PROFILE), "asset_id", *more)


@query(f"{RANKED} SELECT flat.asset_id, rules.rule_id, {NAME.format('best.rnk')} AS status, coalesce(n_findings, 0) AS n_findings FROM flat CROSS JOIN rules LEFT JOIN best ON best.asset_id = flat.asset_id AND best.rule_id = rules.rule_id")
def rule_status(spark, sf):  # noqa: ANN001, ANN201
    return fold.row_status(found(spark, sf)).drop("rule_ord")


@query(f"{ALL} SELECT flat.asset_id, count(found.status) FILTER (status = 'pass') + {len(IDS)} - count(DISTINCT found.rule_id) AS n_pass, count(*) FILTER (status = 'warn') AS n_warn, count(*) FILTER (status = 'inconclusive') AS n_inconclusive, count(*) FILTER (status = 'fail') AS n_fail FROM flat LEFT JOIN found USING (asset_id) GROUP BY 1")
def status_counts(spark, sf):  # noqa: ANN001, ANN201
    return fold.row_counts(found(spark, sf))


@query(f"{ALL}, v AS (SELECT flat.asset_id, count(*) FILTER (status = 'fail' AND fail_on <> 'critical') AS failed, count(*) FILTER (status = 'fail' AND fail_on = 'critical') AS below, count(*) FILTER (status = 'inconclusive' AND fail_on <> 'critical') AS inconclusive FROM flat LEFT JOIN found USING (asset_id) GROUP BY 1) SELECT *, CASE WHEN failed > 0 THEN 'fail' WHEN below + inconclusive > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM v")
def verdict(spark, sf):  # noqa: ANN001, ANN201
    return fold.row_verdicts(found(spark, sf, "fail_on"), None)


@query(f"{RANKED} SELECT asset_id, rule_id, {NAME.format('rnk')} AS status, n.n AS n_findings FROM best JOIN (SELECT asset_id, rule_id, count(*) AS n FROM found WHERE status <> 'pass' GROUP BY 1, 2) n USING (asset_id, rule_id) WHERE rnk > 0")
def rule_rollup(spark, sf):  # noqa: ANN001, ANN201
    return fold.row_rollup(found(spark, sf)).select("asset_id", "rule_id", "status", "n_findings")


@query(f"{ALL} SELECT asset_id, rule_id, status, count(*) AS n FROM found WHERE status <> 'pass' GROUP BY ALL")
def template_summary(spark, sf):  # noqa: ANN001, ANN201
    return report.template(findings(b.inspections(spark, sf), model.load(r.PROFILE)), "summary").groupBy("asset_id", "rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"{r.PRELUDE} SELECT asset_id::VARCHAR AS asset, 'container.timestamp_continuity' AS rule, status, CASE status WHEN 'pass' THEN 'info' ELSE 'error' END AS severity, '' AS stream, coalesce(start_ms::VARCHAR, '') AS start_ms, coalesce(end_ms::VARCHAR, '') AS end_ms, coalesce((end_ms - start_ms)::VARCHAR, '') AS measured, CASE WHEN start_ms IS NOT NULL THEN '150' ELSE '' END AS expected, CASE status WHEN 'pass' THEN 'timestamps are continuous' WHEN 'fail' THEN 'timestamp gap of ' || (end_ms - start_ms) || ' ms' ELSE 'the container was not scanned' END AS message FROM ({r.SQL['container.timestamp_continuity']})")
def csv_findings(spark, sf):  # noqa: ANN001, ANN201
    return report.csv_rows(findings(b.inspections(spark, sf), r.only(model.load(r.PROFILE), "container.timestamp_continuity")))


@query("SELECT o_orderkey AS asset_id, '1.0.0' AS app_version, '1' AS ruleset_version, 'all-rules' AS profile_name, 1 AS profile_version, 64 AS hash_length FROM orders")
def report_integrity(spark, sf):  # noqa: ANN001, ANN201
    profile = r.only(model.load(r.PROFILE), "container.readable")
    rows = b.inspections(spark, sf)
    f = findings(rows, profile)
    out = report.build(rows, f, fold.verdicts(rows, f, profile.fail_on), profile, "2026-01-01 00:00:00")
    return out.select("asset_id", "integrity.app_version", "integrity.ruleset_version", "integrity.profile_name", "integrity.profile_version", F.length("integrity.profile_sha256").alias("hash_length"))


CUSTOM = """
name: custom
rules:
  custom:
    - {id: custom.size, scope: container, metric: size_bytes, op: "<=", value: 20000000, severity: warning}
    - {id: custom.duration, scope: container, metric: duration_seconds, op: "==", value: 3600, tolerance: 600}
    - {id: custom.bits, scope: audio, streams: primary, metric: bit_depth, op: in, value: [16, 24]}
    - {id: custom.rate, scope: video, metric: frame_rate, op: ">=", value: 29.5}
    - {id: custom.codec, scope: video, metric: codec, op: one_of, value: [av1, h264]}
    - {id: custom.title, scope: subtitle, metric: metadata.title, op: ne, value: main}
"""
NUMERIC = [r.row("'fail'", "size_bytes > 20000000"), r.row("CASE WHEN duration_s IS NULL THEN 'inconclusive' ELSE 'fail' END", "duration_s IS NULL OR abs(duration_s - 3600) > 600"), r.row("CASE WHEN bit_depth IS NULL THEN 'inconclusive' ELSE 'fail' END", "pa IS NOT NULL AND (bit_depth IS NULL OR bit_depth NOT IN (16, 24))", stream="pa"), r.row("CASE WHEN frame_rate IS NULL THEN 'inconclusive' ELSE 'fail' END", "kind = 'video' AND (frame_rate IS NULL OR frame_rate = '25/1')", "streams", "idx")]
TEXT = [r.row("CASE WHEN codec IS NULL THEN 'inconclusive' ELSE 'fail' END", "kind = 'video' AND (codec IS NULL OR lower(codec) <> 'av1')", "streams", "idx"), r.row("CASE WHEN title IS NULL THEN 'inconclusive' ELSE 'fail' END", "kind = 'subtitle' AND (title IS NULL OR title = 'Main')", "streams", "idx")]


def customs(spark, sf, ids: range):  # noqa: ANN001, ANN201
    full = model.parse(CUSTOM)
    part = model.Profile(full.name, full.version, {}, [full.custom[i] for i in ids])
    f = findings(b.inspections(spark, sf), part)
    return f.select("asset_id", "rule_id", "status", "stream_idx")


def custom_sql(parts: list[str], names: list[str]) -> str:
    return r.PRELUDE + " UNION ALL ".join(f"SELECT asset_id, 'custom.{n}' AS rule_id, status, stream_idx FROM ({p})" for p, n in zip(parts, names, strict=True))


@query(custom_sql(NUMERIC, ["size", "duration", "bits", "rate"]))
def custom_numeric(spark, sf):  # noqa: ANN001, ANN201
    return customs(spark, sf, range(4))


@query(custom_sql(TEXT, ["codec", "title"]))
def custom_text_set(spark, sf):  # noqa: ANN001, ANN201
    return customs(spark, sf, range(4, 6))


def paired(spark, sf):  # noqa: ANN001, ANN201
    """Every even asset with the next one."""
    rows = b.inspections(spark, sf).select("asset_id", "inspection").withColumn("pair_id", F.expr("asset_id div 2"))
    a, c = (rows.where(f"asset_id % 2 = {i}").select("pair_id", F.col("inspection").alias(n)) for i, n in ((0, "a"), (1, "b")))
    return a.join(c, "pair_id").where("a.streams IS NOT NULL AND b.streams IS NOT NULL")


ZIPPED = r.PRELUDE + ", z AS (SELECT s.*, asset_id // 2 AS pair_id, asset_id % 2 AS side, row_number() OVER (PARTITION BY asset_id, kind ORDER BY idx) - 1 AS i FROM streams s WHERE kind = 'subtitle'), has AS (SELECT DISTINCT asset_id FROM streams), pairs AS (SELECT x.asset_id // 2 AS pair_id FROM has x JOIN has y ON y.asset_id = x.asset_id + 1 WHERE x.asset_id % 2 = 0)"


@query(ZIPPED + ", n AS (SELECT pair_id, count(*) FILTER (asset_id % 2 = 0) AS a, count(*) FILTER (asset_id % 2 = 1) AS b FROM pairs LEFT JOIN (SELECT *, asset_id // 2 AS pair_id FROM streams WHERE kind = 'subtitle') USING (pair_id) GROUP BY 1) SELECT pair_id, 'subtitle ' || x.i AS scope, 'codec' AS field, CASE WHEN x.codec IS NULL OR y.codec IS NULL THEN 'unmeasured' WHEN lower(x.codec) = lower(y.codec) THEN 'same' ELSE 'different' END AS state FROM z x JOIN z y USING (pair_id, i) WHERE x.side = 0 AND y.side = 1 UNION ALL SELECT pair_id, 'subtitle', 'stream count', CASE WHEN a = b THEN 'same' ELSE 'different' END FROM n UNION ALL SELECT pair_id, 'container', 'duration', CASE WHEN x.container_ms IS NULL OR y.container_ms IS NULL THEN 'unmeasured' WHEN abs(x.container_ms - y.container_ms) <= 40 THEN 'same' ELSE 'different' END FROM pairs JOIN flat x ON x.asset_id = pair_id * 2 JOIN flat y ON y.asset_id = pair_id * 2 + 1")
def compare_pairs(spark, sf):  # noqa: ANN001, ANN201
    return cmp.compare(paired(spark, sf)).where("scope LIKE 'subtitle%' OR (scope = 'container' AND field = 'duration')").select("pair_id", "scope", "field", "state")


@query()
def compare_summary(spark, sf):  # noqa: ANN001, ANN201
    return cmp.row_summary(cmp.arrays(paired(spark, sf)))


@query("SELECT coalesce(o.o_custkey, c.c_custkey) AS asset_id, coalesce(o.n, c.c_nationkey)::BIGINT AS value FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o FULL JOIN customer c ON c.c_custkey = o.o_custkey")
def merge_inspections(spark, sf):  # noqa: ANN001, ANN201
    left = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS asset_id", "cast(c_nationkey AS bigint) AS value")
    right = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("asset_id")).agg(F.count(F.lit(1)).alias("value"))
    return state.merge(left, right, ["asset_id"])


CACHE_ROWS = "md5(concat(l_partkey % 50, '')) AS asset_sha, '1.0.0' AS app_version, '1' AS ruleset_version, concat('rule.', l_linenumber) AS rule_id, md5(concat(l_suppkey % 7, '')) AS config_hash"


@query(f"WITH k AS (SELECT l_orderkey, l_linenumber, {CACHE_ROWS} FROM lineitem), c AS (SELECT DISTINCT asset_sha, app_version, ruleset_version, rule_id, config_hash FROM k WHERE l_orderkey % 100 = 0) SELECT rule_id, count(*) FILTER (c.rule_id IS NOT NULL) AS hits, count(*) FILTER (c.rule_id IS NULL) AS misses FROM k LEFT JOIN c USING (asset_sha, app_version, ruleset_version, rule_id, config_hash) GROUP BY 1")
def cache_hits(spark, sf):  # noqa: ANN001, ANN201
    k = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "md5(cast(concat(l_partkey % 50, '') AS binary)) AS asset_sha", "'1.0.0' AS app_version", "'1' AS ruleset_version", "concat('rule.', l_linenumber) AS rule_id", "md5(cast(concat(l_suppkey % 7, '') AS binary)) AS config_hash")
    cache = k.where("l_orderkey % 100 = 0").select(*state.CACHE_KEY).distinct()
    hit, miss = state.cache_lookup(k, cache)
    both = hit.select("rule_id", F.lit(1).alias("h")).unionAll(miss.select("rule_id", F.lit(0)))
    return both.groupBy("rule_id").agg(F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("misses"))


@query("WITH a AS (SELECT o_custkey AS path, o_orderkey AS seen, o_orderstatus AS kind FROM orders) SELECT path, min(seen) AS first_seen, max(seen) AS last_seen, arg_max(kind, seen) AS kind FROM a GROUP BY 1")
def asset_upsert(spark, sf):  # noqa: ANN001, ANN201
    rows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_custkey AS path", "o_orderkey AS first_seen", "o_orderkey AS last_seen", "o_orderstatus AS kind")
    old = state.upsert(rows.where("first_seen % 3 <> 0"), rows.limit(0), ["path"], "last_seen", "first_seen")
    return state.upsert(old, rows.where("first_seen % 3 = 0"), ["path"], "last_seen", "first_seen")


@query("SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def jobs_latest(spark, sf):  # noqa: ANN001, ANN201
    return state.newest_jobs(spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS job_id", "o_orderdate AS created_at", "o_orderstatus AS status"), "F", 50)


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 1 AND o_orderstatus IN ('O', 'P') THEN 'cancelled' ELSE CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END END AS status FROM orders")
def jobs_cancel(spark, sf):  # noqa: ANN001, ANN201
    jobs = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS job_id", "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status")
    return state.cancel_jobs(jobs, jobs.where("job_id % 4 = 1"))


@query("SELECT l_suppkey AS name, l_orderkey AS version, l_partkey AS body FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_partkey DESC) = 1")
def profile_latest(spark, sf):  # noqa: ANN001, ANN201
    return state.latest(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey AS name", "l_orderkey AS version", "l_partkey AS body"), "name", "version", "body")


@query("SELECT DISTINCT concat('p.', l_suppkey % 300) AS rule_id FROM lineitem WHERE l_suppkey % 300 NOT IN (SELECT n_nationkey FROM nation)")
def plugin_missing(spark, sf):  # noqa: ANN001, ANN201
    return state.missing_plugins(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("concat('p.', l_suppkey % 300) AS rule_id"), spark.read.parquet(f"{sf}/nation.parquet").selectExpr("concat('p.', n_nationkey) AS rule_id"))


@query("WITH m AS (SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE -30 + (o_orderkey % 100) * 0.125::DOUBLE END AS l, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE -12 + (o_orderkey % 50) * 0.25::DOUBLE END AS t, (o_orderkey % 5) * 0.00025::DOUBLE AS dc FROM orders) SELECT asset_id, dc >= 0.0005::DOUBLE AS remove_dc, CASE WHEN abs(-23 - l) >= 0.05::DOUBLE AND t + (-23 - l) <= -1 THEN -23 - l END AS gain_db, CASE WHEN l IS NULL OR t IS NULL THEN 'unmeasured' WHEN abs(-23 - l) >= 0.05::DOUBLE AND t + (-23 - l) > -1 THEN 'over the ceiling' END AS refused FROM m")
def correction_plan(spark, sf):  # noqa: ANN001, ANN201
    m = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS asset_id", "CASE WHEN o_orderkey % 9 <> 0 THEN -30 + (o_orderkey % 100) * 0.125D END AS loudness_lufs", "CASE WHEN o_orderkey % 11 <> 0 THEN -12 + (o_orderkey % 50) * 0.25D END AS true_peak_db", "(o_orderkey % 5) * 0.00025D AS max_dc")
    return correct.plan(m)
