"""Subtitle cues and transcripts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_WORDS, MOST_UNEXPECTED, MOST_CUES = 20_000, 50, 100_000


def cue_rows(cues: DataFrame) -> DataFrame:
    """asset_id, start_ms, end_ms, payload -> rows in order with the next cue's start, and what is wrong with each."""
    w = Window.partitionBy("asset_id").orderBy("start_ms", "end_ms", "payload")
    rows = cues.withColumn("n", F.row_number().over(w)).where(F.col("n") <= MOST_CUES).withColumn("next", F.lead("start_ms").over(w))
    lines = F.filter(F.transform(F.split("payload", "\n"), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, "^.*-->", "")), r"(\{[^}]*(\}|$))|(<[^>]*(>|$))", ""))), lambda x: x != "")
    return rows.withColumn("lines", lines)


def cue_timing(cues: DataFrame) -> DataFrame:
    """Per asset: cues, invalid ones, overlaps with the next, widest gap, longest cue, end of cover."""
    rows = cue_rows(cues)
    gap = F.when(F.col("end_ms") <= F.col("next"), F.col("next") - F.col("end_ms"))
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("cue_count"), F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("n_invalid"), F.count_if(F.col("end_ms") > F.col("next")).alias("n_overlaps"), F.max(gap).alias("max_gap_ms"), F.max(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("max_cue_duration_ms"), F.max("end_ms").alias("covered_until_ms"))


def cue_content(cues: DataFrame) -> DataFrame:
    """Per asset: longest line and most lines of a cue, without markup, and cues without visible text."""
    rows = cue_rows(cues)
    longest = F.array_max(F.transform("lines", F.length))
    return rows.groupBy("asset_id").agg(F.max(longest).alias("max_line_chars"), F.max(F.size("lines")).alias("max_lines_per_cue"), F.count_if(F.size("lines") == 0).alias("n_empty"))


def cue_ranges(cues: DataFrame) -> DataFrame:
    """asset_id, is_text, start_ms, end_ms, payload -> all that the subtitle rules read of a stream, ranges included.

    Null payloads of text streams are malformed. Lists are as long as the cues that are wrong, of the first 100,000."""
    rows = cue_rows(cues)
    span = lambda a, b: F.struct(F.col(a).cast("long").alias("start_ms"), b.cast("long").alias("end_ms"))
    end, nxt, text = F.col("end_ms"), F.col("next"), F.col("is_text")
    collect = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
    shown = F.size("lines")
    return rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("cue_count"),
        collect(end <= F.col("start_ms"), span("start_ms", F.col("start_ms"))).alias("invalid_durations"),
        collect(end > nxt, span("start_ms", F.least(end, nxt))).alias("overlaps"),
        collect(text & F.col("payload").isNull(), span("start_ms", end)).alias("malformed"),
        collect(text & F.col("payload").isNotNull() & (shown == 0), span("start_ms", end)).alias("empty_cues"),
        F.max(F.when(end <= nxt, nxt - end)).alias("max_gap_ms"),
        F.max(F.when(text, F.coalesce(F.array_max(F.transform("lines", F.length)), F.when(F.col("payload").isNotNull(), 0)))).alias("max_line_chars"),
        F.max(F.when(text & F.col("payload").isNotNull(), shown)).alias("max_lines_per_cue"),
        F.max(F.greatest(end - F.col("start_ms"), F.lit(0))).alias("max_cue_duration_ms"),
        F.max("end_ms").alias("covered_until_ms"),
    )


def tokens(text: Column) -> Column:
    """Lower-case words without the marks around them."""
    bare = F.transform(F.split(F.regexp_replace(text, "’", "'"), r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(bare, lambda w: w != "")


def unexpected_words(pairs: DataFrame) -> DataFrame:
    """asset_id, expected, hypothesis -> words of the hypothesis that the expected text hasn't: total and the first 50 distinct, sorted."""
    rows = pairs.select("asset_id", tokens(F.col("expected")).alias("e"), tokens(F.col("hypothesis")).alias("h"))
    strange = F.filter("h", lambda w: ~F.array_contains("e", w))
    return rows.select("asset_id", F.size(strange).cast("long").alias("unexpected_total"), F.array_sort(F.slice(F.array_distinct(strange), 1, MOST_UNEXPECTED)).alias("unexpected_words"))


def align(expected: list[str], hypothesis: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest alignment; ties prefer the diagonal, then a deletion."""
    n, m = len(expected), len(hypothesis)
    cost = [list(range(m + 1))]
    for i in range(1, n + 1):
        row, above, word = [i], cost[-1], expected[i - 1]
        for j in range(1, m + 1):
            row.append(min(above[j - 1] + (word != hypothesis[j - 1]), above[j] + 1, row[j - 1] + 1))
        cost.append(row)
    s = d = ins = 0
    i, j = n, m
    while i or j:
        differs = i and j and expected[i - 1] != hypothesis[j - 1]
        if i and j and cost[i][j] == cost[i - 1][j - 1] + bool(differs):
            s, i, j = s + bool(differs), i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return s, d, ins


def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [align(list(e), list(h)) if 0 < len(e) <= MOST_WORDS and len(h) <= MOST_WORDS else (None, None, None) for e, h in zip(b["e"], b["h"], strict=True)]
        out = pd.DataFrame(found, columns=["substitutions", "deletions", "insertions"]).astype("Int64")
        out.insert(0, "asset_id", b["asset_id"].to_numpy())
        out.insert(1, "expected_words", [len(e) for e in b["e"]])
        yield out


def word_errors(pairs: DataFrame) -> DataFrame:
    """Word error rate and its parts; null without expected words or beyond 20,000 of them."""
    rows = pairs.select("asset_id", tokens(F.col("expected")).alias("e"), tokens(F.col("hypothesis")).alias("h"))
    found = rows.mapInPandas(aligned, "asset_id long, expected_words long, substitutions long, deletions long, insertions long")
    return found.withColumn("wer", F.try_divide((F.col("substitutions") + F.col("deletions") + F.col("insertions")).cast("double"), F.col("expected_words")))


# executors get these functions by value and need no path to this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
