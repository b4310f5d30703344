"""Near-duplicates by bottom-k sketches of one hash function.

1. A document is the set of the hashes of its word shingles; its sketch is the k smallest. Documents with
   equal sets are one node from here on (groups of copies cost one row each).
2. Inverted lists hold the sketches' values.  Two sets as similar as wanted share far more than ``share`` of their
   sketches (the chance that they don't is below 1e-6 at the default), so of each sketch only the rarest values
   need a place in a list: with so many left out, two sketches with that overlap still meet.  That is
   what keeps values of very common passages out of the lists, without a cap.  Nodes alone in their lists are done.
3. The nodes that are left get full sets and the same lists once more, now exactly: of a set of n only the rarest
   n - ceil(similarity * n) + 1 values need a place for all links to meet.
4. What hangs together by these lists is a bundle; all links are inside bundles.  A bundle is compared
   in blocks: its nodes are dealt to chunks of bounded size, and each pair of chunks is a task of its own that hands on no
   more than a spanning forest of the links that it finds.  In a block, pairs are estimated by the union of
   their sketches (with a margin of some five standard deviations) and confirmed by the exact Jaccard similarity of the full sets;
   large blocks get all intersections from one matrix product instead.
5. Components of the confirmed links, by contraction rounds in Spark.

Defined results: documents without words have size 0 and are linked with nothing; with fewer words than a shingle the
whole sequence is the one shingle; ties and repeated rows are linked as equal sets; a null doc_id never is a
component's id unless nothing else is in it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, keep, sent, ship
from .graph import components
from .textbytes import MULTIPLIER, WordHasher, mixed, runs

#: Texts that are hashed at once.
ROWS = 256


def shingles(h: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes (63 bits), sorted."""
    out = mixed(h + np.uint64(MULTIPLIER))
    full = out.copy()
    for i in range(1, size):
        full[: len(h) - i] = mixed(full[: len(h) - i] * np.uint64(MULTIPLIER) + h[i:]) if len(h) > i else full[:0]
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= size:
            yield np.unique(full[a : b - size + 1] >> np.uint64(1))
        elif b > a:
            x = out[a]
            for i in range(a + 1, b):
                x = mixed(x * np.uint64(MULTIPLIER) + h[i])
            yield np.array([mixed(x + np.uint64(b - a)) >> np.uint64(1)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> int:
    """63 bits of a set."""
    return int(mixed(mixed(s).sum(dtype=np.uint64) + np.bitwise_xor.reduce(mixed(s + np.uint64(1))) * np.uint64(MULTIPLIER) + np.uint64(len(s))) >> np.uint64(1)) if len(s) else 0


def sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    hasher = WordHasher("space")
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, rows = hasher.column(part.column(1))
                yield part, list(shingles(h, runs(rows, part.num_rows), size))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)))


def sketch_rows(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[pa.RecordBatch]:
    for part, own in sets(batches, size):
        with np.errstate(over="ignore"):
            prints = [fingerprint(s) for s in own]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array([len(s) for s in own], pa.int64()), pa.array(prints, pa.int64()), lists([s[:k] for s in own])], names=["doc_id", "copy", "n", "node", "sketch"])


def set_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for _, own in sets(batches, size):
        with np.errstate(over="ignore"):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in own], pa.int64()), lists(own)], names=["node", "items"])


def arrays(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def alike(x: np.ndarray, y: np.ndarray, k: int, num: int, den: int, margin: float) -> bool:
    """Whether two sorted sets are linked: first by the union of their sketches, then exactly."""
    values, n = np.unique(np.concatenate([x[:k], y[:k]]), return_counts=True)
    n = n[:k]
    if (n == 2).sum() < (num / den - margin) * len(n):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def intersections(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 16_384) -> np.ndarray:
    """Sizes of all intersections, as matrix products over slices of the values that occur twice or more."""
    values, column, n = np.unique(np.concatenate([*xs, *ys]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in (*xs, *ys)])
    shared = n[column] > 1
    column, row = (np.cumsum(n > 1) - 1)[column[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(xs), len(ys)), np.float32)
    for at in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(xs) + len(ys), width), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        total += m[: len(xs)] @ m[len(xs) :].T
    return total


def forest(edges: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of the edges that connect something new."""
    above: dict[int, int] = {}

    def top(v: int) -> int:
        while v in above:
            v = above[v]
        return v

    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            above[x] = y
            yield a, b


def block_links(block: pa.Table, k: int, num: int, den: int, margin: float, pairwise: int = 2000) -> pa.Table:
    """One pair of chunks of a bundle (bundle, i, j, part, node, items) -> links a, b."""
    i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
    part = block.column("part").to_numpy()
    nodes, sets = block.column("node").to_numpy(), arrays(block.column("items").combine_chunks())
    left = np.flatnonzero(part == i)
    right = left if i == j else np.flatnonzero(part == j)
    n = np.array([len(s) for s in sets])
    fits = den * np.minimum(n[left][:, None], n[right]) >= num * np.maximum(n[left][:, None], n[right])
    if i == j:
        fits = np.triu(fits, 1)
    if fits.sum() > pairwise:
        both = intersections([sets[x] for x in left], [sets[y] for y in right])
        x, y = np.nonzero(fits & (den * both >= num * (n[left][:, None] + n[right] - both)))
        found = forest(zip(nodes[left[x]].tolist(), nodes[right[y]].tolist(), strict=True))
    else:
        found = forest((int(nodes[left[x]]), int(nodes[right[y]])) for x, y in zip(*np.nonzero(fits), strict=True) if alike(sets[left[x]], sets[right[y]], k, num, den, margin))
    links = list(found)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def rarest(values: DataFrame, share: float) -> DataFrame:
    """node, s (its values), v -> node, v: of each node its rarest values, as many as two that share ``share`` of theirs need to meet.

    Values that only one node has take the first places, but no row."""
    df = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("node")
    places = F.col("s") - F.ceil(F.col("s") * F.lit(share)) + 1 - (F.col("s") - F.count(F.lit(1)).over(own))
    ranked = values.join(df, "v").withColumn("places", places).withColumn("r", F.row_number().over(own.orderBy("df", "v")))
    return ranked.where("r <= places").select("node", "v")


class Finder:
    def __init__(self, docs: DataFrame, shingle: int, num: int, den: int, k: int, share: float, margin: float, chunk: int):
        ship(__name__, WordHasher.__module__)
        self.texts, self.shingle, self.num, self.den, self.k, self.share, self.margin, self.chunk = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("copy")), shingle, num, den, k, share, margin, chunk
        self.base = keep(self.texts.mapInArrow(lambda it: sketch_rows(it, shingle, k), "doc_id long, copy long, n long, node long, sketch array<long>"))
        self.nodes = keep(self.base.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def candidates(self) -> DataFrame:
        """Full sets of the nodes that share a list of the sketches' rarest values with another."""
        shingle = self.shingle
        posts = keep(rarest(self.nodes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("v")), self.share))
        lists_ = posts.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("v")
        met = posts.join(lists_, "v", "left_semi").select("node").distinct()
        ids = keep(met.join(self.nodes.select("node", "doc_id"), "node").select(F.col("doc_id").alias("_id")).distinct())
        texts = self.texts.join(sent(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return keep(texts.mapInArrow(lambda it: set_rows(it, shingle), "node long, items array<long>").where("size(items) > 0").dropDuplicates(["node"]))

    def links(self) -> DataFrame:
        """Confirmed links between nodes, enough of them to connect all that is connected."""
        k, num, den, margin = self.k, self.num, self.den, self.margin
        full = self.candidates()
        posts = keep(rarest(full.select("node", F.size("items").alias("s"), F.explode("items").alias("v")), self.num / self.den))
        hubs = posts.groupBy("v").agg(F.min("node").alias("hub"))
        bundles = components(posts.join(hubs, "v").select(F.col("hub").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "bundle")
        sizes = bundles.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / self.chunk).cast("int").alias("chunks"))
        dealt = bundles.join(sizes, "bundle").withColumn("part", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
        tasks = dealt.select("bundle", "node", "part", other).select("bundle", "node", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        blocks = tasks.join(full, "node")
        found = blocks.groupBy("bundle", "i", "j").applyInArrow(lambda t: block_links(t, k, num, den, margin), "a long, b long")
        return keep(found)


#: Five words and a similarity of 0.8. At that similarity two sketches of 64 share 51 of their union's 64 smallest values on average, with a
#: standard deviation of 3.2; lists and estimate pass what shares half of them, six deviations below.
DEFAULTS = {"shingle": 5, "num": 80, "den": 100, "k": 64, "share": 0.5, "margin": 0.3, "chunk": 512}


def near_duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """doc_id, n_shingles, component_id, kept: one row per document. Options: those of DEFAULTS."""
    f = Finder(docs, **(DEFAULTS | options))
    found = components(f.links())
    named = keep(f.nodes.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.join(smallest, "root").select("node", "component_id")
    rows = f.base.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(classes, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def clean(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """One row of each group, all columns as they were: the one with the smallest id (null ids last), then by a hash of its text and row.

    Rows are told apart by id and text, so that rows that share an id, or have none, are judged one by one."""
    f = Finder(docs, **(DEFAULTS | options))
    found = components(f.links())
    rows = f.base.where("n > 0").join(found, "node", "left").select(F.col("doc_id").alias("id"), "copy", F.coalesce("root", "node").alias("root"))
    order = lambda: F.struct(F.col("id").isNull().alias("x"), "id", "copy")
    rows = keep(rows.groupBy("root", "id", "copy").agg(F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("root").agg(F.min(order()).alias("best"))
    marked = keep(rows.join(best, "root").select("id", "copy", "n", (order() == F.col("best")).alias("stays")))
    ours = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("copy"))
    left = docs.join(sent(marked.where("NOT stays").select("id", "copy")), ours, "left_anti")
    twice = marked.where("stays AND n > 1").select("id", "copy")
    if twice.isEmpty():
        return left
    one = fresh("_row", docs)
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    repeated = left.join(sent(twice), ours, "left_semi").withColumn(one, F.row_number().over(same)).where(F.col(one) == 1).drop(one)
    return left.join(sent(twice), ours, "left_anti").unionByName(repeated)
