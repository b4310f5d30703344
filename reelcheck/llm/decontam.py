"""Benchmark decontamination with training suffix arrays.

The training texts are worked on in shards (what a task has read, a few MB at a time).  Of a shard a
suffix array is built over its word sequence; every suffix of every benchmark item is binary-searched in
it (equal ones once), which finds all places where a window of it occurs.  Windows that follow each other
on the same diagonal (same item, same distance of the places) are one match, so the longest verbatim
matches and their places in the item and in the text come out whole, though the array is only ordered to the depth
of a window.  Words that no item has can't be in a match, so suffixes that meet one before a window is full are
left out of the array; that is exact and keeps arrays small.

The items go out in blocks of at most ``block_words`` words, each block in a pass of its own over the texts, and
the driver holds one block at a time.  Where there is one block (up to some 400,000 words) nothing is shuffled; with more of
them the texts are written once with a number for each row, and the passes' hits are merged by it.

Defined results: a null or empty text, or one with no word, has no hit; an item without words is
ignored; an item with fewer words than a window is one window; equal items all count; repeated rows and rows with a
null id are documents of their own; empty tables give empty or clean results; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ship
from .textbytes import WordHasher, distinct, runs

#: Texts of a shard.
SHARD_ROWS = 256
#: Pairs of a window in an item and a place in a text that are joined to matches at once.
PAIRS = 2_000_000
MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("words", pa.int32())])
SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(SPAN)), ("matches", pa.list_(MATCH))])
SCHEMA = "doc_id long, n_words long, item_ids array<string>, spans array<struct<s:int,e:int>>, matches array<struct<item_id:string,item_start:int,start:int,words:int>>"
Item = tuple[str, list[int]]


class Windows:
    """The distinct windows of a block of items, by length, and the places in items that have each."""

    def __init__(self, items: list[Item], window: int):
        """items: id and word hashes. Items with equal words are searched once."""
        names: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            names.setdefault(tuple(words), []).append(name)
        self.names = [sorted(own) for own in names.values()]
        self.vocabulary = distinct(np.array([h for words in names for h in words], np.uint64))
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, words in enumerate(names):
            ids = tuple((np.searchsorted(self.vocabulary, np.array(words, np.uint64)) + 1).tolist())
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(ids[i : i + window], []).append((item, i))
        self.depth = window
        keys = list(found)
        self.length = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), window), np.int32)
        for i, k in enumerate(keys):
            self.words[i, : len(k)] = k
        self.first = np.cumsum([0, *(len(found[k]) for k in keys)])
        places = np.array([x for k in keys for x in found[k]], np.int64).reshape(-1, 2)
        self.item, self.offset = places[:, 0], places[:, 1]
        self.shortest = int(self.length.min()) if keys else 0

    def matches(self, window: np.ndarray, place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
        """Occurrences (window, place in the shard, its text) -> maximal matches: text, item, place in the item, place in the shard, words."""
        order = np.lexsort((place, row))
        window, place, row = window[order], place[order], row[order]
        n = (self.first[1:] - self.first[:-1])[window]
        ends, at, parts = np.cumsum(n), 0, []
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            if to < len(n):  # a text's pairs stay together
                first, last = np.searchsorted(row, [row[to], row[to] + 1])
                to = int(first) if first > at else int(last)
            m = n[at:to]
            step = np.repeat(self.first[window[at:to]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            item, offset, here = self.item[step], self.offset[step], np.repeat(place[at:to], m)
            text, words = np.repeat(row[at:to], m), np.repeat(self.length[window[at:to]], m)
            order = np.lexsort((here, here - offset, item, text))
            item, offset, here, text, words = item[order], offset[order], here[order], text[order], words[order]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (here[1:] != here[:-1] + 1) | (offset[1:] != offset[:-1] + 1)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(item)) - 1
            parts.append((text[begin], item[begin], offset[begin], here[begin], here[end] + words[end] - here[begin]))
            at = to
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5


def suffix_array(ids: np.ndarray, reach: np.ndarray, depth: int, shortest: int) -> np.ndarray:
    """Places whose suffix has ``shortest`` known words or more, ordered by their first ``depth`` words.

    Prefix doubling: ranks by 1, 2, 4, ... words until the depth is covered. Beyond its reach
    (end of the text or unknown word) a suffix has rank 0."""
    places = np.flatnonzero(reach >= shortest)
    rank = ids.astype(np.int64)
    known, k = np.flatnonzero(ids > 0), 1
    while k < depth:
        step = min(k, depth - k)
        follow = np.where(reach[known] > step, rank[np.minimum(known + step, len(ids) - 1)], 0)
        key = rank[known] * np.int64(len(ids) + ids.max() + 2) + follow
        new = np.zeros_like(rank)
        new[known] = np.unique(key, return_inverse=True)[1] + 1
        rank, k = new, k + step
    return places[np.argsort(rank[places], kind="stable")]


def bounds(ids: np.ndarray, reach: np.ndarray, array: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """For each window the range of the suffix array that begins with it: two binary searches for all at once."""

    def search(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(windows.length), np.int64), np.full(len(windows.length), len(array), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            at = array[mid]
            order = np.zeros(len(open_), np.int8)
            for j in range(windows.depth):
                todo = np.flatnonzero((order == 0) & (j < windows.length[open_]))
                if not len(todo):
                    break
                place = at[todo] + j
                word = np.where(reach[at[todo]] > j, ids[np.minimum(place, len(ids) - 1)], 0)
                order[todo] = np.sign(word - windows.words[open_[todo], j])
            right = (order <= 0) if upper else (order < 0)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    return search(False), search(True)


def shard_hits(ids: np.ndarray, rows: np.ndarray, n: int, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence in a shard: ids are its words (0: no item has it), rows their texts."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not windows.shortest:
        return none, none
    stops = np.concatenate([np.flatnonzero(ids == 0), runs(rows, n)])
    stops.sort()
    reach = stops[np.searchsorted(stops, np.arange(len(ids)), "right")] - np.arange(len(ids))
    reach[ids == 0] = 0
    array = suffix_array(ids, reach, windows.depth, windows.shortest)
    low, high = bounds(ids, reach, array, windows)
    hit = np.flatnonzero(high > low)
    n_of = (high - low)[hit]
    window = np.repeat(hit, n_of)
    offset = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    return window, array[np.repeat(low[hit], n_of) + offset]


def known_words(h: np.ndarray, windows: Windows) -> np.ndarray:
    """Each word's number among the items' words, from 1, or 0."""
    if not len(windows.vocabulary):
        return np.zeros(len(h), np.int32)
    place = np.minimum(np.searchsorted(windows.vocabulary, h), len(windows.vocabulary) - 1)
    return np.where(windows.vocabulary[place] == h, place + 1, 0).astype(np.int32)


def parts_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, their words' hashes and the text of each."""
    hasher = WordHasher("alnum")
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_ROWS):
            part = batch.slice(at, SHARD_ROWS)
            yield part, *hasher.column(part.column(column))


def find(batches: Iterator[pa.RecordBatch], items: list[Item], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> for each text its words, the items that have a window in it, the spans of hit words and the longest matches."""
    windows = Windows(items, window)
    for part, h, rows in parts_of(batches, 1):
        n, offsets = part.num_rows, runs(rows, part.num_rows)
        found, where = shard_hits(known_words(h, windows), rows, n, windows)
        mark = np.zeros(len(h) + 1, np.int64)
        np.add.at(mark, where, 1)
        np.add.at(mark, where + windows.length[found], -1)
        hit = np.cumsum(mark)[:-1] > 0
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1]
        starts = offsets[:-1][offsets[:-1] < len(h)]
        first[starts] = hit[starts]
        last[:-1] &= ~hit[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = hit[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        base = offsets[rows[start]]
        spans = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (start, end + 1)], fields=list(SPAN))
        text, item, offset, here, words = windows.matches(found, where, rows[where])
        matches: list[list[dict]] = [[] for _ in range(n)]
        for t, i, o, x, w in zip(text.tolist(), item.tolist(), offset.tolist(), (here - offsets[text]).tolist(), words.tolist(), strict=True):
            matches[t] += [{"item_id": name, "item_start": o, "start": x, "words": w} for name in windows.names[i]]
        names = [sorted({m["item_id"] for m in own}) for own in matches]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(names, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(runs(rows[start], n), pa.int32()), spans), pa.array(matches, pa.list_(MATCH))], schema=OUT)


def without_hits(batches: Iterator[pa.RecordBatch], items: list[Item], window: int, column: int) -> Iterator[pa.RecordBatch]:
    """The rows, all columns as they are, whose text has no window of the items."""
    windows = Windows(items, window)
    for part, h, rows in parts_of(batches, column):
        _, where = shard_hits(known_words(h, windows), rows, part.num_rows, windows)
        clean_ = np.ones(part.num_rows, bool)
        clean_[rows[where]] = False
        yield part.filter(pa.array(clean_))


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[Item]]:
    """The items in blocks of bounded size, one partition of them at the driver at a time."""
    hasher, block, words = WordHasher("alnum"), [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("text")).toLocalIterator():
        h = hasher.column(pa.array([row.text], pa.string()))[0].tolist()
        if h:
            block.append((row.i if row.i is not None else "", h))
            words += len(h)
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


#: Sorted spans of several passes, overlapping or touching ones joined.
MERGED = """aggregate(array_sort(spans), cast(array() AS array<struct<s:int,e:int>>),
      (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).e >= x.s
        THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s AS s, greatest(element_at(a, -1).e, x.e) AS e)))
        ELSE concat(a, array(x)) END)"""


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, longest_match (words of its longest verbatim match with an item),
    item_ids (sorted), spans of hit words, matches (item, its place in the item and in the text, words), contaminated."""
    ship(__name__, WordHasher.__module__)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    todo = blocks(benchmark, block_words)
    block, more = next(todo, []), next(todo, None)
    if more is None:
        found = texts.mapInArrow(lambda it: find(it, block, window), SCHEMA)
    else:
        numbered = keep(texts.withColumn("row", F.monotonically_increasing_id()))
        rows = numbered.select(F.col("row").alias("doc_id"), "text")
        passes = keep(rows.mapInArrow(lambda it, b=block: find(it, b, window), SCHEMA))
        hits = passes.where("size(spans) > 0").drop("n_words")
        while more is not None:
            hits = hits.unionAll(keep(rows.mapInArrow(lambda it, b=more: find(it, b, window), SCHEMA).where("size(spans) > 0").drop("n_words")))
            more = next(todo, None)
        merged = hits.groupBy("doc_id").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "spans", "matches")]).withColumns({"spans": F.expr(MERGED), "item_ids": F.array_sort(F.array_distinct("item_ids"))})
        merged = merged.withColumnRenamed("doc_id", "row")
        own = passes.select(F.col("doc_id").alias("row"), "n_words")
        found = numbered.select("row", "doc_id").join(own, "row").join(merged, "row", "left")
        found = found.select("doc_id", "n_words", *[F.coalesce(c, F.expr(f"cast(array() AS {t})")).alias(c) for c, t in (x.split(" ", 1) for x in SCHEMA.split(", ")[2:])])
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)")
    longest = F.coalesce(F.array_max(F.expr("transform(matches, x -> x.words)")), F.lit(0)).cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), longest.alias("longest_match"), "item_ids", "spans", "matches", (F.size("spans") > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest_match")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 400_000) -> DataFrame:
    """The documents without any hit, all columns as they were: each row is judged by its own text, whatever its id.

    With more than one block of items, what each pass keeps is written and the next one reads it."""
    ship(__name__, WordHasher.__module__)
    column, todo = [c.lower() for c in docs.columns].index("text"), blocks(benchmark, block_words)
    block, more = next(todo, []), next(todo, None)
    while more is not None:
        docs = keep(docs.mapInArrow(lambda it, b=block: without_hits(it, b, window, column), docs.schema))
        block, more = more, next(todo, None)
    return docs.mapInArrow(lambda it: without_hits(it, block, window, column), docs.schema)
