"""From a profile to columns: one array of findings for each rule, in the order of evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profiles.model import Profile
from ..schema import FINDINGS
from . import audio, container, custom, subtitle, video, voice
from .base import CONTEXT

GROUPS: dict[str, dict[str, Callable[[dict], str]]] = {"container": container.BUILDERS, "video": video.BUILDERS, "audio": audio.BUILDERS, "subtitle": subtitle.BUILDERS, "voice": voice.BUILDERS}
RULE_IDS = [f"{group}.{name}" for group, rules in GROUPS.items() for name in rules]


def compile_rules(profile: Profile) -> list[tuple[str, str]]:
    """(rule id, SQL of its findings): built-in rules by group, then custom ones. Plug-ins run elsewhere."""
    out = [(f"{g}.{n}", build(profile.rules[f"{g}.{n}"])) for g, rules in GROUPS.items() for n, build in rules.items() if f"{g}.{n}" in profile.rules]
    return out + [(c["id"], custom.build(c)) for c in profile.custom]


def with_context(inspections: DataFrame, key: str, used: str, *more: str) -> DataFrame:
    """The columns of the context that some rules' SQL uses, worked out once for all of them.

    They go through a generator of one row: the optimizer then can't copy their expressions (or those that made the
    inspections) into every place where a rule uses them. What no rule uses isn't read."""
    rows = inspections.select(key, *more, "asset", "inspection")
    for name, sql in CONTEXT.items():
        rows = rows.withColumn(name, F.expr(sql))
    names = [n for n in CONTEXT if re.search(rf"\b{n}\b", used)] or ["scanned"]
    return rows.select(key, *more, F.inline(F.array(F.struct(*names))))


def arrays(inspections: DataFrame, profile: Profile, key: str = "asset_id", *more: str) -> DataFrame:
    """key, more columns of the inspections, and ``rules``: for each rule its place, its id and the array of its findings.

    One row per asset, so folds work within the row. Rules are laid out in one column per group, so that no generated
    method gets too large; a generator of one row then keeps their expressions from being copied into what follows."""
    rules = compile_rules(profile)
    rows, groups = with_context(inspections, key, " ".join(sql for _, sql in rules), *more), {}
    for i, (rule_id, sql) in enumerate(rules):
        groups.setdefault(rule_id.split(".")[0], []).append(f"named_struct('rule_ord', {i}, 'rule_id', '{rule_id}', 'found', {sql})")
    names = []
    for group, own in groups.items():
        rows = rows.withColumn(f"found_{group}", F.expr(f"array({', '.join(own)})"))
        names.append(f"found_{group}")
    every = F.concat(*names) if len(names) > 1 else F.col(names[0]) if names else F.expr(f"cast(array() AS array<struct<rule_ord:int,rule_id:string,found:{FINDINGS}>>)")
    return rows.select(key, *more, F.inline(F.array(F.struct(every.alias("rules")))))


def findings(inspections: DataFrame, profile: Profile, key: str = "asset_id") -> DataFrame:
    """key, rule_ord, finding_ord and the finding's fields. A narrow projection: no shuffle, whatever the number of rules."""
    # one entry per rule, so never empty: explode_outer, or else a filter works all rules out a second time
    every = arrays(inspections, profile, key).select(key, F.explode_outer("rules").alias("r"))
    return every.select(key, F.col("r.rule_ord").alias("rule_ord"), F.posexplode("r.found").alias("finding_ord", "f")).select(key, "rule_ord", "finding_ord", "f.*")
