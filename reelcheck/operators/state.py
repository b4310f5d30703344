"""Tables that outlive a run: merged inspections, rule cache, upserts, jobs, versions of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CACHE_KEY = ["asset_sha", "app_version", "ruleset_version", "rule_id", "config_hash"]
JOB_STATES = ["queued", "running", "succeeded", "failed", "cancelled"]


def merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join by key; the right side's values win where there are any."""
    values = [c for c in left.columns if c not in keys]
    both = left.alias("l").join(right.alias("r"), keys, "full")
    return both.select(*keys, *[F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}")).alias(c) for c in values])


def merge_measurements(field: str, a: str = "a", b: str = "b") -> str:
    """SQL: the measurements of two inspections by stream, b's before a's, in the order of streams."""
    return f"array_sort(concat({b}.{field}, filter({a}.{field}, m -> NOT exists({b}.{field}, n -> n.stream_idx = m.stream_idx))), (x, y) -> cast(x.stream_idx - y.stream_idx AS int))"


def merge_inspections(pairs: DataFrame) -> DataFrame:
    """a (metadata) and b (decoded) -> inspection: video, audio and voice by stream, subtitles of a, container of b, streams of b if it has any, diagnostics of both."""
    fields = ["'streams', CASE WHEN size(b.streams) > 0 THEN b.streams ELSE a.streams END", "'container', b.container", *[f"'{f}', {merge_measurements(f)}" for f in ("video", "audio")], "'subtitle', a.subtitle", f"'voice', {merge_measurements('voice')}", "'diagnostics', map_concat(map_filter(coalesce(a.diagnostics, map()), (k, v) -> NOT map_contains_key(coalesce(b.diagnostics, map()), k)), coalesce(b.diagnostics, map()))"]
    return pairs.withColumn("inspection", F.expr(f"named_struct({', '.join(fields)})"))


def cache_lookup(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a cached result, rows that must be computed). Plug-in rules have no config_hash and never hit."""
    return wanted.join(cache, CACHE_KEY), wanted.join(cache, CACHE_KEY, "left_anti")


def cache_put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return upsert(cache, fresh.where("config_hash IS NOT NULL"), CACHE_KEY, "stored_at")


def cache_clear(cache: DataFrame, rule_id: str, ruleset_version: str) -> DataFrame:
    """Without the rule and without what other versions of the rules have left."""
    return cache.where((F.col("rule_id") != rule_id) & (F.col("ruleset_version") == ruleset_version))


def upsert(table: DataFrame, news: DataFrame, keys: list[str], by: str, first: str | None = None) -> DataFrame:
    """One row per key: the latest by a column (the news win ties); ``first`` keeps the earliest value that it ever had."""
    both = table.withColumn("_new", F.lit(0)).unionByName(news.withColumn("_new", F.lit(1)))
    values = [c for c in table.columns if c not in keys]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(by, "_new")).alias("v"), *([F.min(first).alias("_first")] if first else []))
    return out.select(*keys, *[F.col("_first").alias(c) if c == first else F.col(f"v.{c}").alias(c) for c in values]).select(*table.columns)


def start_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return move_jobs(jobs, ids, "running", ["queued"])


def cancel_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return move_jobs(jobs, ids, "cancelled", ["queued", "running"])


def finish_jobs(jobs: DataFrame, ids: DataFrame, ok: bool = True) -> DataFrame:
    return move_jobs(jobs, ids, "succeeded" if ok else "failed", ["running"])


def move_jobs(jobs: DataFrame, ids: DataFrame, to: str, allowed: list[str]) -> DataFrame:
    """Jobs with these ids change their status if they are in an allowed one."""
    chosen = ids.select("job_id").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & F.col("status").isin(*allowed), F.lit(to)).otherwise(F.col("status"))
    return jobs.join(chosen, "job_id", "left").withColumn("status", status).drop("_hit")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is the last by the order."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_jobs(jobs: DataFrame, status: str | None, n: int) -> DataFrame:
    rows = jobs.where(F.col("status") == status) if status else jobs
    return rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def missing_plugins(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """Plug-in rules that a profile names and that no installed plug-in has."""
    return wanted.join(installed, "rule_id", "left_anti").distinct()
