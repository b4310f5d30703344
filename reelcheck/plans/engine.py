"""The facade: check, compare, correct, report and watch over DataFrames of assets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import correct as fix
from ..operators import fold
from ..profiles.model import Profile
from ..rules import compiler, plugin
from ..sources import assemble, files

#: Rules of these groups and names need decoded measurements; the others read metadata only.
DECODED = {"video": {"color_space", "black_frames", "freeze_frames", "duplicate_frames", "corrupt_frames", "luma_range", "photosensitivity", "dead_pixels", "blockiness", "blur", "noise"}, "audio": {"silence", "clipping", "peak", "true_peak", "loudness", "phase", "dc_offset"}}


def needs_decoding(profile: Profile) -> bool:
    """Whether measurements beyond the metadata are used at all; if not, they need not be made."""
    return any(name in DECODED.get(group, ()) for group, name in (r.split(".") for r in profile.rules)) or any(r.startswith("voice.") for r in profile.rules)


@dataclass
class Run:
    findings: DataFrame
    statuses: DataFrame
    counts: DataFrame
    verdicts: DataFrame


def rule_ids(profile: Profile) -> list[str]:
    return [r for r, _ in compiler.compile_rules(profile)] + [p["rule"] for p in profile.plugins]


def check(inspections: DataFrame, profile: Profile, registry: plugin.Registry | None = None) -> Run:
    """All rules over all assets (asset_id, asset, inspection): narrow passes for findings and folds; plug-ins' findings are folded by an aggregation."""
    found = compiler.findings(inspections, profile)
    if not profile.plugins:
        rows = compiler.arrays(inspections, profile)
        return Run(found, fold.row_status(rows), fold.row_counts(rows), fold.row_verdicts(rows, profile.fail_on))
    found = found.unionByName(plugin.findings(inspections, profile.plugins, registry or plugin.Registry()), allowMissingColumns=True)
    ids = rule_ids(profile)
    spark = inspections.sparkSession
    return Run(found, fold.rule_status(inspections, found, fold.rule_list(spark, ids)), fold.status_counts(inspections, found, len(ids)), fold.verdicts(inspections, found, profile.fail_on))


def check_many(inspections: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Verdicts under several profiles: profile_sha256, asset_id, ..."""
    out = None
    for p in profiles:
        rows = fold.row_verdicts(compiler.arrays(inspections, p), p.fail_on).withColumn("profile_sha256", F.lit(p.digest()))
        out = rows if out is None else out.unionByName(rows)
    return out


def compare(left: DataFrame, right: DataFrame, tolerances: cmp.Tolerances | None = None) -> DataFrame:
    """Inspections of both sides by pair_id -> fields."""
    pairs = left.select("pair_id", F.col("inspection").alias("a")).join(right.select("pair_id", F.col("inspection").alias("b")), "pair_id")
    return cmp.compare(pairs, tolerances or cmp.Tolerances())


def list_rules() -> list[str]:
    return list(compiler.RULE_IDS)


def check_folder(spark: SparkSession, folder: str, profile: Profile, registry: plugin.Registry | None = None) -> Run:
    """From media files to verdicts."""
    return check(assemble.inspections(spark, folder), profile, registry)


def info(spark: SparkSession, folder: str) -> DataFrame:
    """What the readers find in each file: container, duration, bit rate, validity and streams."""
    rows = assemble.inspections(spark, folder)
    return rows.select("asset_id", "asset.size_bytes", "inspection.container.format", "inspection.container.validity", "inspection.container.duration", "inspection.container.bitrate_bps", F.explode_outer("inspection.streams").alias("stream")).select("*", "stream.*").drop("stream")


def correct(spark: SparkSession, folder: str, **options) -> DataFrame:  # noqa: ANN003
    """Corrected copies of the WAV files below a folder, with levels before and after."""
    return fix.corrected(files.scan(spark, folder).withColumn("container", files.container()).where("container = 'wav'"), **options)
