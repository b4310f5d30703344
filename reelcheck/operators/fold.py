"""Folding findings: status of each rule, counts, verdicts, rollups, exit codes.

The functions over ``arrays`` (one row per asset, see the rules' compiler) fold within the row: no shuffle and no join.  Those
over findings, one a row, are for findings from elsewhere, such as plug-ins or stored runs; they pre-aggregate by asset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import STATUSES, severity_rank, status_rank

EXIT_CODES = {"pass": 0, "warn": 1, "inconclusive": 1, "fail": 2}
#: An error while running, a path that isn't there, a profile that is none.
EXIT_ERROR, EXIT_PATH, EXIT_PROFILE = 3, 4, 5


def rule_list(spark: SparkSession, rule_ids: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rule_ids)), "rule_ord int, rule_id string")


def worst(found: str) -> str:
    """SQL: the name of the worst status in an array of findings; pass if it is empty."""
    ranks = " ".join(f"WHEN exists({found}, f -> f.status = '{s}') THEN '{s}'" for s in reversed(STATUSES[1:]))
    return f"CASE {ranks} ELSE 'pass' END"


def row_status(arrays: DataFrame, key: str = "asset_id") -> DataFrame:
    """Every asset and rule: the worst status of its findings and their number; (pass, 0) without any."""
    return arrays.select(key, F.inline(F.expr(f"transform(rules, r -> named_struct('rule_id', r.rule_id, 'rule_ord', r.rule_ord, 'status', {worst('r.found')}, 'n_findings', cast(size(r.found) AS bigint)))")))


def row_counts(arrays: DataFrame, key: str = "asset_id") -> DataFrame:
    """Findings by status, plus a pass for each rule without one."""
    n = lambda status: f"aggregate(rules, 0L, (n, r) -> n + size(filter(r.found, f -> f.status = '{status}')))"
    return arrays.select(key, F.expr(f"{n('pass')} + size(filter(rules, r -> size(r.found) = 0))").alias("n_pass"), *[F.expr(n(s)).alias(f"n_{s}") for s in STATUSES[1:]])


def row_verdicts(arrays: DataFrame, fail_on: str | None, key: str = "asset_id") -> DataFrame:
    """Failures at or above ``fail_on`` fail; other failures, and inconclusive findings at or above it, warn.

    With ``fail_on`` None, the arrays bring a column of that name."""
    limit = severity_rank(f"'{fail_on}'" if fail_on else "fail_on")
    n = lambda status, at: F.expr(f"aggregate(rules, 0L, (n, r) -> n + size(filter(r.found, f -> f.status = '{status}' AND {severity_rank('f.severity')} {at} {limit})))")
    rows = arrays.select(key, n("fail", ">=").alias("failed"), n("fail", "<").alias("below"), n("inconclusive", ">=").alias("inconclusive"))
    return rows.withColumn("verdict", named_verdict())


def row_rollup(arrays: DataFrame, key: str = "asset_id") -> DataFrame:
    """Rules that didn't pass: worst status, number of findings that aren't a pass, message of the first of the worst."""
    status = worst("r.found")
    bad = "filter(r.found, f -> f.status <> 'pass')"
    found = f"filter(transform(rules, r -> named_struct('rule_id', r.rule_id, 'status', {status}, 'n_findings', cast(size({bad}) AS bigint), 'message', get(filter(r.found, f -> f.status = {status}), 0).message, 'status_rank', {status_rank(status)}, 'rule_ord', r.rule_ord)), x -> x.status <> 'pass')"
    return arrays.select(key, F.inline(F.expr(found)))


def named_verdict() -> Column:
    return F.when(F.col("failed") > 0, "fail").when(F.col("below") + F.col("inconclusive") > 0, "warn").otherwise("pass")


def rule_status(assets: DataFrame, findings: DataFrame, rules: DataFrame, key: str = "asset_id") -> DataFrame:
    """Every asset and rule: the worst status of its findings and their number; (pass, 0) without any.

    Findings are pre-aggregated; the rule list is a handful of rows (a profile's rules)."""
    best = findings.groupBy(key, "rule_id").agg(F.max(F.expr(status_rank("status"))).alias("r"), F.count(F.lit(1)).alias("n_findings"))
    every = assets.select(key).join(F.broadcast(rules.select("rule_id", "rule_ord")), how="cross")
    names = F.array(*[F.lit(s) for s in STATUSES])
    return every.join(best, [key, "rule_id"], "left").select(key, "rule_id", "rule_ord", F.coalesce(F.get(names, F.col("r")), F.lit("pass")).alias("status"), F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"))


def status_counts(assets: DataFrame, findings: DataFrame, n_rules: int, key: str = "asset_id") -> DataFrame:
    """Findings by status, plus a pass for each rule without one."""
    own = findings.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES], F.count_distinct("rule_id").alias("with_findings"))
    rows = assets.select(key).join(own, key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(key, (n("n_pass") + F.lit(n_rules) - n("with_findings")).alias("n_pass"), *[n(f"n_{s}").alias(f"n_{s}") for s in STATUSES[1:]])


def verdicts(assets: DataFrame, findings: DataFrame, fail_on: str | None, key: str = "asset_id") -> DataFrame:
    """Failures at or above ``fail_on`` fail; other failures, and inconclusive findings at or above it, warn.

    With ``fail_on`` None, assets bring a column of that name."""
    limit = severity_rank(f"'{fail_on}'" if fail_on else "fail_on")
    rank = severity_rank("severity")
    if fail_on is None:
        findings = findings.join(assets.select(key, "fail_on"), key)
    at = F.expr(f"{rank} >= {limit}")
    failed = F.col("status") == "fail"
    own = findings.groupBy(key).agg(F.count_if(failed & at).alias("failed"), F.count_if(failed & ~at).alias("below"), F.count_if((F.col("status") == "inconclusive") & at).alias("inconclusive"))
    rows = assets.select(key).join(own, key, "left").na.fill(0, ["failed", "below", "inconclusive"])
    return rows.withColumn("verdict", named_verdict())


def rollup(findings: DataFrame, key: str = "asset_id") -> DataFrame:
    """Rules that didn't pass: worst status, number of findings, message of the first of the worst; worst rules first."""
    rows = findings.where("status <> 'pass'").withColumn("r", F.expr(status_rank("status")))
    out = rows.groupBy(key, "rule_id").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n_findings"), F.min_by("message", F.struct(-F.col("r"), "rule_ord", "finding_ord")).alias("message"), F.min("rule_ord").alias("rule_ord"))
    names = F.array(*[F.lit(s) for s in STATUSES])
    return out.select(key, "rule_id", F.get(names, F.col("r")).alias("status"), "n_findings", "message", F.col("r").alias("status_rank"), "rule_ord")


def exit_code(verdicts_: DataFrame, errors: int = 0) -> DataFrame:
    """The worst code of a batch; an error makes it 3 at least."""
    codes = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return verdicts_.agg(F.greatest(F.coalesce(F.max(codes[F.col("verdict")]), F.lit(0)), F.lit(3 if errors else 0)).alias("exit_code"))


def dashboard(jobs: DataFrame, most_failed: int = 5, most_recent: int = 8) -> dict[str, DataFrame]:
    """job_id, name, verdict, status, started_ms, finished_ms -> counts and speed of all runs, the rules' worst and the last ones.

    counts: n, n_pass, n_warn (inconclusive included), n_fail, mean_ms, per_hour; failed and recent: the newest jobs first."""
    took = F.col("finished_ms") - F.col("started_ms")
    n = lambda *v: F.count_if(F.col("verdict").isin(*v))
    counts = jobs.agg(F.count(F.lit(1)).alias("n"), n("pass").alias("n_pass"), n("warn", "inconclusive").alias("n_warn"), n("fail").alias("n_fail"), F.avg(took).alias("mean_ms"), F.try_divide(F.count(took) * 3_600_000, F.sum(took)).alias("per_hour"))
    newest = [F.desc_nulls_last("finished_ms"), F.desc("job_id")]
    return {"counts": counts, "failed": jobs.where("verdict = 'fail'").orderBy(*newest).limit(most_failed), "recent": jobs.orderBy(*newest).limit(most_recent)}


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """How many rows each project, job or other key has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def timeline(findings: DataFrame, lengths: DataFrame, key: str = "asset_id", least: float = 0.35) -> DataFrame:
    """Findings with a range, as place and width in per cent of the asset's length (key, duration_ms); none is narrower than ``least``."""
    rows = findings.where("time_range IS NOT NULL").join(lengths.where("duration_ms > 0"), key)
    percent = lambda ms: ms * 100.0 / F.col("duration_ms")
    left = F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent(F.col("time_range.start_ms"))))
    width = F.greatest(F.lit(least), percent(F.col("time_range.end_ms") - F.col("time_range.start_ms")))
    return rows.select(key, "rule_id", "status", "severity", left.alias("left_percent"), F.least(width, F.greatest(F.lit(least), 100.0 - left)).alias("width_percent"))
