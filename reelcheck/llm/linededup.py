"""Line deduplication: repeated runs of lines are found by distributed prefix doubling, later copies deleted.

All lines with a word, in the order of documents and lines, are one long sequence of line ids.  A run of
lines of one document that occurs at an earlier place too is deleted, if it has ``min_words`` words or more; the
first copy of everything stays.  Places may overlap: of a line said 900 times in a row one stays.

1. Lines that occur once can't be in a repeated run; they are left out and end runs.
2. Prefix doubling names the block of 1, 2, 4, ... lines at every place by the first place that has the same block,
   from the names of its halves: suffixes whose blocks have one name are an interval of the suffix array with
   that longest common prefix or a longer one.
3. A repeated run of enough words is the union of its shortest blocks of enough words, from each line onwards and
   from each line backwards.  Such a block of r lines is named by the two blocks of 2^floor(log2 r) lines at its start and
   end.  It has at most min_words lines, so log2(min_words) doublings are all that is ever needed.
4. Blocks whose name has an earlier first place are deleted; overlapping ones join to maximal runs.

Names are pre-aggregated minima and go back by equi-joins (whose hot keys Spark can split), shifted blocks
meet by their unique place: no line, however frequent, is gathered in one task.  DataFrame functions only.

Defined results: a null text stays null, an empty one empty; lines without words are never deleted; a line is equal to
another if all its characters are; rows with equal id and text are one document, and get one result; rows with equal
ids and different texts are ordered by a hash of the text; documents with a null id come first; an empty table
gives an empty result; extra columns stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep, sent

#: Up to so many documents' deleted line numbers go to all executors instead of the texts around.
BROADCAST_DOCS = 300_000
WORD = r"[^\x20\x09-\x0D]+"


def lines(docs: DataFrame) -> DataFrame:
    """pos, start, doc_id, key, line, id, id2, words: all lines with a word; pos follows the order of documents and lines."""
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id"), F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    rows = rows.select("doc_id", "key", "line", F.xxhash64("t").alias("id"), F.hash("t").alias("id2"), F.regexp_count("t", F.lit(WORD)).alias("words")).where("words > 0").dropDuplicates(["doc_id", "key", "line"])
    rows = rows.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "line")
    return keep(rows.withColumn("pos", F.monotonically_increasing_id()))


def repeated(every: DataFrame) -> DataFrame:
    """Those lines that occur more than once, and the first place of each: the names of blocks of one line."""
    first = every.groupBy("id", "id2").agg(F.min("pos").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keep(every.join(first, ["id", "id2"]).select("pos", "doc_id", "key", "line", "words", "name"))


def shortest_blocks(some: DataFrame, min_words: int) -> DataFrame:
    """pos, r: for each line the shortest block of enough words from it onwards, and backwards, where all its lines are repeated."""
    doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    total = some.withColumn("total", F.sum("words").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    seen = F.struct("pos", "total", "words")
    near = total.withColumn("after", F.collect_list(seen).over(doc.rowsBetween(Window.currentRow, min_words - 1))).withColumn("before", F.collect_list(seen).over(doc.rowsBetween(1 - min_words, Window.currentRow)))
    ahead = F.expr(f"get(filter(after, x -> x.total - total + words >= {min_words}), 0).pos - pos + 1")
    enough = F.expr(f"filter(before, x -> total - x.total + x.words >= {min_words})")
    back = F.expr("pos - try_element_at(enough, -1).pos + 1")
    blocks = near.withColumn("enough", enough).select("pos", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("shift"), ahead.alias("r")), F.struct((back - 1).alias("shift"), back.alias("r")))).alias("b"))
    return keep(blocks.select((F.col("pos") - F.col("b.shift")).alias("pos"), F.col("b.r").alias("r")).where(f"r IS NOT NULL AND r <= {min_words}").distinct())


def double(names: DataFrame, step: int) -> DataFrame:
    """Names of blocks of twice ``step`` lines from those of its halves. Blocks that occur once are left out."""
    second = names.select((F.col("pos") - step).alias("pos"), F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("name").alias("then"))
    pairs = keep(names.join(second, "pos").where("doc_id <=> d AND key = k").select("pos", "doc_id", "key", "name", "then"))
    first = pairs.groupBy("name", "then").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keep(pairs.join(first, ["name", "then"]).select("pos", "doc_id", "key", F.col("first").alias("name")))


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, key (hash of the text), line: the lines to be deleted."""
    some = repeated(lines(docs.select("doc_id", "text")))
    blocks = shortest_blocks(some, min_words)
    names, step, spans = some.select("pos", "doc_id", "key", "name"), 1, []
    while True:
        ours = blocks.where(F.col("r").between(step, 2 * step - 1))
        ends = names.select("pos", "doc_id", "key", F.col("name").alias("then"))
        found = ours.join(names, "pos").withColumn("at", F.col("pos") + F.col("r") - step)
        found = found.join(ends.toDF("at", "d", "k", "then"), "at").where("doc_id <=> d AND key = k").select("pos", "r", "name", "then")
        first = found.groupBy("r", "name", "then").agg(F.min("pos").alias("first"))
        again = found.join(first, ["r", "name", "then"]).where("first < pos").select("pos", (F.col("pos") + F.col("r") - 1).alias("until"))
        spans.append(keep(again))  # a plan over all rounds would be planned anew in the driver whenever one of its stages ends
        if 2 * step > min_words or blocks.where(F.col("r") >= 2 * step).isEmpty():
            break
        names, step = double(names, step), 2 * step
    reach = reduce(DataFrame.unionAll, spans).groupBy("pos").agg(F.max("until").alias("until"))
    doc = Window.partitionBy("doc_id", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = some.join(reach, "pos", "left").withColumn("until", F.max("until").over(doc))
    return covered.where("until >= pos").select("doc_id", "key", "line")


def deduplicated(docs: DataFrame, min_words: int = 50, count: str = "n_deleted") -> DataFrame:
    """docs with the later copies of repeated runs deleted from the text, and one more column: how many lines were."""
    of, key, numbers = (fresh(n, docs) for n in ("_doc", "_key", "_lines"))
    gone = later_copies(docs, min_words).groupBy("doc_id", "key").agg(F.collect_list("line").alias("numbers"))
    gone = keep(gone.toDF(of, key, numbers))
    rows = docs.join(sent(gone, BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(key)), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda t, i: ~F.array_contains(numbers, i))
    changed = rows.withColumns({count: F.coalesce(F.size(numbers), F.lit(0)), "text": F.when(F.col(numbers).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))})
    return changed.select(*[c for c in docs.columns if c != count], count)


def clean(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents without later copies, all columns otherwise as they were; those of which nothing is left go."""
    n = fresh("_n_deleted", docs)
    left = deduplicated(docs, min_words, n)
    return left.where((F.col(n) == 0) | F.col("text").rlike(WORD)).drop(n)


#: An independent form of the same result: all pairs of equal lines, joined to runs along their diagonals.
SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM w WHERE words > 0),
p AS (SELECT a.doc_id AS da, a.k AS ka, b.doc_id AS db, b.k AS kb, b.line AS lb, b.words
      FROM n a JOIN n b ON a.t = b.t AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))),
r AS (SELECT *, kb - row_number() OVER (PARTITION BY da, db, kb - ka ORDER BY kb) AS run FROM p),
s AS (SELECT *, sum(words) OVER (PARTITION BY da, db, kb - ka, run) AS total FROM r),
gone AS (SELECT DISTINCT db AS doc_id, lb AS line FROM s WHERE total >= 50),
kept AS (SELECT l.doc_id, string_agg(l.t, chr(10) ORDER BY l.line) FILTER (gone.line IS NULL) AS text, count(gone.line) AS n_deleted
         FROM l LEFT JOIN gone USING (doc_id, line) GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(kept.n_deleted, 0)::INT AS n_deleted
FROM documents d LEFT JOIN kept USING (doc_id)
"""
