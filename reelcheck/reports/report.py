"""Reports from runs: rows with their integrity fields, CSV, JSON, HTML and PDF."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

APP_VERSION, RULESET_VERSION = "1.0.0", "1"
#: What a template shows: passes, findings at all, integrity fields.
TEMPLATES = {"detailed": (True, True, False), "summary": (False, True, False), "executive": (False, False, False), "audit": (True, True, True)}
COLUMNS = ["asset", "rule", "status", "severity", "stream", "start_ms", "end_ms", "measured", "expected", "message"]


def template(findings: DataFrame, name: str) -> DataFrame:
    passes, listed, _ = TEMPLATES[name]
    if not listed:
        return findings.limit(0)
    return findings if passes else findings.where("status <> 'pass'")


def plain(column: str, breaks: bool = False) -> Column:
    """A CSV cell: no commas, and in messages no line breaks."""
    cell = F.replace(F.col(column), F.lit(","), F.lit(" "))
    return F.regexp_replace(cell, r"[\r\n]+", " ") if breaks else cell


def csv_rows(findings: DataFrame) -> DataFrame:
    """asset_id and the finding's fields -> the ten columns of the CSV report, without quoting."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = findings.select(F.col("asset_id").cast("string").alias("asset"), F.col("rule_id").alias("rule"), "status", "severity", text("stream_idx").alias("stream"), text("time_range.start_ms").alias("start_ms"), text("time_range.end_ms").alias("end_ms"), text("measured").alias("measured"), text("expected").alias("expected"), text("message").alias("message"))
    return rows.select(*[plain(c, c == "message").alias(c) for c in COLUMNS])


def build(inspections: DataFrame, findings: DataFrame, verdicts: DataFrame, profile, created_at: str) -> DataFrame:  # noqa: ANN001
    """One immutable row per asset: verdict, counts, findings in order, and what the result rests on."""
    fields = F.struct("rule_ord", "finding_ord", "rule_id", "status", "severity", "message", "measured", "expected", "stream_idx", "time_range", "evidence")
    own = findings.groupBy("asset_id").agg(F.array_sort(F.collect_list(fields)).alias("findings"))
    video = F.expr("get(filter(CASE WHEN size(inspection.streams) > 0 THEN inspection.streams ELSE asset.streams END, s -> s.kind = 'video' AND s.width IS NOT NULL AND s.height IS NOT NULL), 0)")
    rows = inspections.withColumn("v", video).join(verdicts, "asset_id").join(own, "asset_id", "left")
    integrity = F.struct(F.lit(APP_VERSION).alias("app_version"), F.lit(RULESET_VERSION).alias("ruleset_version"), F.lit(profile.digest()).alias("profile_sha256"), F.lit(profile.name).alias("profile_name"), F.lit(profile.version).alias("profile_version"))
    n = lambda s: F.size(F.filter("findings", lambda f: f["status"] == s))
    return rows.select("asset_id", F.lit(created_at).cast("timestamp").alias("created_at"), "verdict", F.when(F.col("v").isNotNull(), F.concat(F.col("v.width"), F.lit("x"), F.col("v.height"))).alias("resolution"), F.col("asset.duration").alias("duration_s"), F.struct(*[F.coalesce(n(s), F.lit(0)).alias(s) for s in ("pass", "warn", "inconclusive", "fail")]).alias("counts"), integrity.alias("integrity"), F.coalesce("findings", F.array()).alias("findings"))


def json_rows(reports: DataFrame) -> DataFrame:
    return reports.select("asset_id", F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(reports: DataFrame, name: str = "detailed", embed_json: bool = False) -> DataFrame:
    """asset_id and a page that stands by itself."""
    passes, listed, audit = TEMPLATES[name]
    cells = ("rule_id", "status", "severity", "measured", "expected", "message")
    row = lambda f: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.coalesce(f[c].cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    shown = F.col("findings") if passes else F.filter("findings", lambda f: f["status"] != "pass")
    table = F.concat(F.lit("<table><tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr>"), F.array_join(F.transform(shown, row), ""), F.lit("</table>")) if listed else F.lit("")
    proof = F.concat(F.lit("<pre>"), escaped(F.to_json("integrity")), F.lit("</pre>")) if audit else F.lit("")
    data = F.concat(F.lit('<script type="application/json">'), F.replace(F.to_json(F.struct("*")), F.lit("</"), F.lit("<\\/")), F.lit("</script>")) if embed_json else F.lit("")
    page = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), escaped(F.col("asset_id").cast("string")), F.lit("</title><h1>"), escaped(F.col("asset_id").cast("string")), F.lit("</h1><p>"), F.upper("verdict"), F.lit("</p>"), table, proof, data)
    return reports.select("asset_id", page.alias("html"))


def pdf(title: str, lines: list[str], width: int = 95, per_page: int = 60) -> bytes:
    """A4 pages of fixed-width text in a standard font."""
    flat = [part for line in lines for part in ([line[i : i + width] for i in range(0, len(line), width)] or [""])]
    pages = [flat[i : i + per_page] for i in range(0, len(flat), per_page)] or [[]]
    clean = lambda s: s.encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"]
    for i, page in enumerate(pages):
        text = "BT /F1 9 Tf 11 TL 50 800 Td " + " ".join(f"({clean(x)}) Tj T*" for x in [title, "", *page]) + " ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(text.encode('latin-1'))} >>\nstream\n{text}\nendstream")
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += f"{i} 0 obj\n{o}\nendobj\n".encode("latin-1")
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{a:010d} 00000 n \n".encode() for a in at)
    return out + f"trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode()


def pdf_rows(reports: DataFrame) -> DataFrame:
    """asset_id and the report as PDF; one batch of assets at a time."""
    lines = F.transform("findings", lambda f: F.concat_ws("  ", f["status"], f["rule_id"], f["message"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"asset_id": b["asset_id"], "pdf": [pdf(f"{a}: {v}", list(x)) for a, v, x in zip(b["asset_id"], b["verdict"], b["lines"], strict=True)]})

    return reports.select(F.col("asset_id").cast("string").alias("asset_id"), "verdict", lines.alias("lines")).mapInPandas(run, "asset_id string, pdf binary")


def report_file(path_column: str) -> Column:
    """<stem>.json of a path."""
    return F.concat(F.regexp_replace(F.regexp_extract(path_column, r"([^/\\]*)$", 1), r"\.[^.]*$", ""), F.lit(".json"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
