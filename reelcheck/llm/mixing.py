"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the mix takes ``share`` times all words.  Each source gets its part by weight, but no more
than ``cap`` times its own words; what is over goes to the others by weight until none is above
(water filling, solved in closed form over the one-row-per-source table).

Sampling: every document of a source is expected ``target / source_size`` times.  The expected
copies are prefix-summed within the source, one offset in [0, 1) is added, and a document is emitted
once for each integer boundary that its interval crosses.  So a document is taken either
floor(rate) or ceil(rate) times, at most ``cap``.

The prefix sum is two-level, so that no source is ever one task: documents are dealt to buckets by
a hash of their id, per-bucket counts are summed up before the bucket, and only within a bucket of a
few thousand rows are rows numbered (by size, which spreads the sizes evenly over the sample).

The offset is drawn from ``draws`` seeded candidates: the one whose words come nearest to the
source's target (one extra pre-aggregated pass); draws=1 is plain systematic sampling.

Defined results: a null text has size 0; a null source is a source of its own, the last; a null
doc_id is dealt like an empty one; repeated rows are documents of their own; a source without words
has target 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

WORD = r"[^\x20\x09-\x0D]+"
#: Words with this sign in front are the sources' keys, so that null has one, too, and sorts last.
KEY = "CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END"


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """skey, source_size -> with rate and target. One row per source; weights repeat by rank of skey."""
    every = Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight)
    t = t.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(every))
    # where all sources before are at their most, the first that is not sets the level; it is the largest of its kind
    before = Window.orderBy(F.col("most") / F.col("weight"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.max(F.when(F.col("most") / F.col("weight") > F.col("level"), F.col("level"))).over(every))
    t = t.withColumn("target", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most")))
    return t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).select("skey", "source_size", "target", "rate")


def unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def copies(rate: Column, rank: Column, offset: Column) -> Column:
    """The integers that the interval of this rank, moved by the offset, crosses."""
    return (F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)).cast("long")


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", draws: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    base = keep(docs.select("doc_id", "source", F.expr(KEY).alias("skey"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    buckets = max(256, -(-base.count() // bucket_rows))
    deal = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    base = base.withColumn("bucket", F.pmod(deal, F.lit(buckets)))
    cells = keep(base.groupBy("skey", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keep(cells.select("skey", "bucket", start.alias("start")))
    sources = keep(targets(cells.groupBy("skey").agg(F.sum("words").alias("source_size")), list(weights), share, cap))
    row = F.row_number().over(Window.partitionBy("skey", "bucket").orderBy("size", "doc_id"))
    ranked = base.withColumn("row", row).join(starts, ["skey", "bucket"]).withColumn("rank", F.col("start") + F.col("row"))
    ranked = keep(ranked.join(sources, "skey").select("doc_id", "source", "skey", "size", "source_size", "target", "rate", "rank"))
    key = lambda k: unit(F.concat(F.lit(f"{seed}|{k}|"), F.col("skey")))
    tried = ranked.groupBy("skey").agg(F.first("target").alias("target"), *[F.sum(copies(F.col("rate"), F.col("rank"), key(k)) * F.col("size")).alias(f"took{k}") for k in range(draws)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"took{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), key(k).alias("offset")) for k in range(draws)]))
    chosen = keep(tried.select("skey", best["offset"].alias("offset")))
    n = copies(F.col("rate"), F.col("rank"), F.col("offset"))
    return ranked.join(chosen, "skey").select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), "source", n.alias("copies"))


SQL = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS deal
  FROM documents),
b AS (SELECT *, deal % (SELECT greatest(256, (count(*) + 4095) // 4096) FROM base) AS bucket FROM base),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM b GROUP BY skey),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM s),
s2 AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(most) OVER w, 0) AS cm, coalesce(sum(weight) OVER w, 0) AS cw
       FROM s1 WINDOW w AS (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (total - cm) / (all_weight - cw) AS lv FROM s2),
s4 AS (SELECT *, max(CASE WHEN most / weight > lv THEN lv END) OVER () AS level FROM s3),
s5 AS (SELECT skey, source_size, coalesce(least(most, level * weight), most) AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM s5),
r AS (SELECT b.*, s6.source_size, s6.target, s6.rate,
        row_number() OVER (PARTITION BY skey ORDER BY bucket, size, doc_id) AS rank FROM b JOIN s6 USING (skey)),
k AS (SELECT skey, i, ('0x' || substr(md5('mix|' || i || '|' || skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM s, range(16) t(i)),
tried AS (SELECT k.skey, k.i, k.off, abs(sum((floor(rate * rank + off) - floor(rate * (rank - 1) + off)) * size) - any_value(target)) AS miss
          FROM r JOIN k USING (skey) GROUP BY 1, 2, 3),
best AS (SELECT skey, off FROM tried QUALIFY row_number() OVER (PARTITION BY skey ORDER BY miss, i) = 1)
SELECT doc_id, size, source_size, target, (floor(rate * rank + off) - floor(rate * (rank - 1) + off))::BIGINT * size AS taken,
       source, (floor(rate * rank + off) - floor(rate * (rank - 1) + off))::BIGINT AS copies
FROM r JOIN best USING (skey)
"""
