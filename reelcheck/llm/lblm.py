"""Language-model scores from a log-bilinear model, trained in numpy with noise-contrastive estimation.

Words are predicted in two steps.  The most frequent ones are classes of their own (the first is the end of a text); every
other word belongs to one of ``buckets`` classes by its first two bytes.  A log-bilinear model gives the probability of a
word's class from the two tokens before it: the context vectors of either position are added, and a class's score is
the product with its vector, plus its bias.  Within a bucket a second log-bilinear model, with vectors for each word as target and as
context, tells the bucket's own words apart; there are half as many of these as the square root of the number of training tokens
(up to ``most_words``), so the vocabulary that context tells apart grows with the corpus.  What is rarer shares one member of
its bucket, and a word has its share (c + 1) of that member's counts, unknown words together one more.  So the probabilities of all
known words and of an unknown one in each bucket sum to one.

Counting covers all training texts: counts are pre-aggregated per batch in numpy, then summed by Spark.
Training covers all tokens of the training texts.  Texts are dealt by a hash of their content to shards of some
``shard_tokens`` tokens (at most ``trainers`` shards); a copy of the model is trained on each shard in the order of the hash,
copies are averaged by their tokens, slice by slice, and the next round goes on from the average (a short first
round brings the copies in line).  So the model depends on the texts alone, not on files, partitions or tasks.
A score is the sum of a part of either context, so sums over classes or members are products of the parts' exponentials: for all
pairs of classes they are one matrix product, for members the exponentials are worked out once for a batch's distinct contexts.

The counts of the ``known`` most frequent words go to all tasks (a bounded table); those of rarer words never
leave Spark: texts' rare words are joined with them.

Defined results: a null or empty text is its end token alone; repeated rows are documents of their own; without any
training text the model is uniform over its classes and N and V are 0; an empty table gives an empty result;
a null doc_id is a training text; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, ship
from .textbytes import Lookup, WordHasher, mixed, runs, trim

#: Texts that are worked on at once, and cells of the model that are averaged at once.
ROWS, SLICE = 512, 1 << 16
#: Members of a bucket that are worked on at once (for ROWS tokens their cells fit in a core's cache).
COLUMNS = 256
#: Exponentials of numbers up to this one, and their products, are far from single precision's limits.
SAFE = 40.0
END = 0


@dataclass
class Words:
    """What tasks need of the counts. Hashes are signed as in Spark."""

    short: np.ndarray  # hashes of the words that are classes; class i + 1
    own: np.ndarray  # hashes of the words that are members of their bucket, by member
    member: np.ndarray  # their members: those of bucket b are from first[b] on, the first one is of all rarer words
    first: np.ndarray
    known: np.ndarray  # hashes and counts of frequent words
    counts: np.ndarray
    end_count: int
    buckets: int
    log_rest: np.ndarray  # log10 of the mass of each bucket's rarer words
    noise: np.ndarray  # probability of each class among training tokens
    inner: np.ndarray  # probability of each member in its bucket

    @property
    def classes(self) -> int:
        return 1 + len(self.short) + self.buckets


@dataclass
class Model:
    first: np.ndarray  # context vectors of the class before
    second: np.ndarray  # and of the one before that
    word: np.ndarray
    bias: np.ndarray
    first_in: np.ndarray  # the same for members, with vectors of words (classes, then members) as context
    second_in: np.ndarray
    member: np.ndarray
    bias_in: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.first, self.second, self.word, self.bias, self.first_in, self.second_in, self.member, self.bias_in]

    def copy(self) -> Model:
        return Model(*[a.copy() for a in self.arrays()])

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def like(self, flat: np.ndarray) -> Model:
        ends = np.cumsum([a.size for a in self.arrays()])[:-1]
        return Model(*[x.reshape(a.shape).astype(np.float32) for x, a in zip(np.split(flat, ends), self.arrays(), strict=True)])

    @staticmethod
    def start(words: Words, dim: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        make = lambda n: rng.normal(0, 0.1, (n, dim)).astype(np.float32)
        c, m = len(words.noise), len(words.inner)
        contexts = c - words.buckets + m
        return Model(make(c), make(c), make(c), np.log(words.noise).astype(np.float32), make(contexts), make(contexts), make(m), np.log(words.inner).astype(np.float32))

    def log_probabilities(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray, table: np.ndarray | None = None, block: int = 32_768) -> np.ndarray:
        """Normalised log10 probabilities; ``table``: normalisers()."""
        table, out = self.normalisers() if table is None else table, np.empty(len(target))
        for i in range(0, len(target), block):
            a, b, t = before[i : i + block], before2[i : i + block], target[i : i + block]
            out[i : i + block] = np.einsum("ij,ij->i", self.first[a] + self.second[b], self.word[t]) + self.bias[t] - table[a, b]
        return out / math.log(10)

    def normalisers(self) -> np.ndarray:
        """The logarithm of the sum over all classes for every pair of contexts.

        A score is a sum of a part of either context, so the sums of all pairs are one matrix product of the parts' exponentials."""
        word = self.word.astype(np.float64).T
        one, two = self.first @ word, self.second @ word + self.bias
        top, top2 = one.max(1), two.max(1)
        total = np.exp(one - top[:, None]) @ np.exp(two - top2[:, None]).T
        with np.errstate(divide="ignore"):
            table = np.log(total) + top[:, None] + top2
        lost = total < 1e-250  # parts so far apart that their product is too small
        for i in np.flatnonzero(lost.any(1)):
            s = one[i] + two[lost[i]]
            top = s.max(1)
            table[i, lost[i]] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return table.astype(np.float32)

    def log_members(self, before: np.ndarray, before2: np.ndarray, member: np.ndarray, bucket_: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of members in their buckets.

        Exponentials are worked out once for each distinct context and member; a token's sum is the product of its contexts' rows."""
        own, total = np.empty(len(member), np.float32), np.zeros(len(member), np.float32)
        for i in range(0, len(member), ROWS):
            at = slice(i, i + ROWS)
            own[at] = np.einsum("ij,ij->i", self.first_in[before[at]] + self.second_in[before2[at]], self.member[member[at]]) + self.bias_in[member[at]]
        order = np.argsort(bucket_, kind="stable")
        of = np.searchsorted(bucket_[order], np.arange(len(first)))
        longest = [float(np.sqrt(np.einsum("ij,ij->i", a, a).max(initial=0))) for a in (self.first_in, self.second_in)]
        cells = np.empty((2, ROWS * COLUMNS), np.float32)
        for b in np.flatnonzero(of[1:] > of[:-1]):
            at, lo, hi = order[of[b] : of[b + 1]], first[b], first[b + 1]
            vectors, bias = self.member[lo:hi], self.bias_in[lo:hi]
            vector, middle = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())), (bias.max() + bias.min()) / 2
            if max(longest[0] * vector, longest[1] * vector + bias.max() - middle) > SAFE:  # products could be lost
                total[at] = self.log_sums(before[at], before2[at], vectors, bias)
                continue
            (one, i), (two, j) = places(before[at], len(self.first_in)), places(before2[at], len(self.second_in))
            one, two, sums = self.first_in[one], self.second_in[two], np.zeros(len(at), np.float32)
            for k in range(0, hi - lo, COLUMNS):
                w = vectors[k : k + COLUMNS].T
                e, f = one @ w, two @ w
                f += bias[k : k + COLUMNS] - middle
                np.exp(e, out=e)
                np.exp(f, out=f)
                for r in range(0, len(at), ROWS):
                    x, y = (c[: len(i[r : r + ROWS]) * w.shape[1]].reshape(-1, w.shape[1]) for c in cells)
                    np.take(e, i[r : r + ROWS], axis=0, out=x, mode="clip")
                    np.take(f, j[r : r + ROWS], axis=0, out=y, mode="clip")
                    sums[r : r + ROWS] += np.einsum("ij,ij->i", x, y)
            total[at] = np.log(sums) + middle
        return (own - total).astype(np.float64) / math.log(10)

    def log_sums(self, before: np.ndarray, before2: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Logarithms of the sums of exponentials over some members, whatever their size."""
        out, step = np.empty(len(before)), max(1, ROWS * COLUMNS // len(bias))
        for i in range(0, len(before), step):
            s = (self.first_in[before[i : i + step]] + self.second_in[before2[i : i + step]]).astype(np.float64) @ vectors.T + bias
            top = s.max(1)
            out[i : i + step] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return out


def places(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers (below n) in order, and the place of each among them."""
    there = np.zeros(n, bool)
    there[x] = True
    own = np.flatnonzero(there)
    place = np.empty(n, np.int64)
    place[own] = np.arange(len(own))
    return own, place[x]


class Trainer:
    """Adagrad on the noise-contrastive objective; the classes' noise is shared within a batch, the members' is drawn in their bucket."""

    def __init__(self, model: Model, words: Words, rate: float, samples: int, ratio: int, inner_ratio: int, seed: tuple[int, int]):
        self.m, self.rate, self.samples, self.ratio, self.inner_ratio = model.copy(), rate, samples, ratio, inner_ratio
        self.noise, self.log_noise = np.cumsum(words.noise), np.log(words.noise * ratio).astype(np.float32)
        self.first, self.log_inner = words.first, np.log(words.inner * inner_ratio).astype(np.float32)
        total = np.cumsum(words.inner)
        before = np.concatenate([[0.0], total])[self.first[:-1]]
        self.inner = total - np.repeat(before, np.diff(self.first)) + np.repeat(np.arange(words.buckets), np.diff(self.first))  # bucket b's end at b + 1
        self.rng = np.random.default_rng(seed)
        self.squares = [np.full_like(a, 1e-6) for a in self.m.arrays()]

    def step(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray) -> None:
        m, n, c = self.m, len(target), len(self.m.bias)
        q = m.first[before] + m.second[before2]
        drawn = np.minimum(np.searchsorted(self.noise, self.rng.random(self.samples)), c - 1)
        rw = m.word[target]
        true = 1 / (1 + np.exp(-(np.einsum("ij,ij->i", q, rw) + m.bias[target] - self.log_noise[target]))) - 1
        wn = m.word[drawn]
        false = q @ wn.T
        false += m.bias[drawn] - self.log_noise[drawn]
        false = (self.ratio / self.samples) / (1 + np.exp(-false))
        gq = true[:, None] * rw + false @ wn
        gw = spread(target, true[:, None] * q, c)
        np.add.at(gw, drawn, false.T @ q)
        gb = np.bincount(target, true, c)
        np.add.at(gb, drawn, false.sum(0))
        for a, g, s in zip(m.arrays()[:4], (spread(before, gq, c), spread(before2, gq, c), gw, gb), self.squares, strict=False):
            g = (g / n).astype(np.float32)
            s += g * g
            a -= self.rate * g / np.sqrt(s)

    def step_in(self, before: np.ndarray, before2: np.ndarray, member: np.ndarray, bucket_: np.ndarray) -> None:
        m, n, k = self.m, len(member), self.inner_ratio
        if not n:
            return
        q = m.first_in[before] + m.second_in[before2]
        drawn = np.searchsorted(self.inner, self.rng.random((n, k)) + bucket_[:, None])
        drawn = np.clip(drawn, self.first[bucket_][:, None], self.first[bucket_ + 1][:, None] - 1)
        every = np.concatenate([member[:, None], drawn], axis=1)
        vectors = m.member[every]
        s = np.einsum("ij,ikj->ik", q, vectors) + m.bias_in[every] - self.log_inner[every]
        s = 1 / (1 + np.exp(-s))
        s[:, 0] -= 1
        gq = np.einsum("ik,ikj->ij", s, vectors)
        self.rows(4, before, gq, n)
        self.rows(5, before2, gq, n)
        self.rows(6, every.ravel(), (s[:, :, None] * q[:, None, :]).reshape(-1, q.shape[1]), n)
        self.rows(7, every.ravel(), s.reshape(-1, 1), n)

    def rows(self, part: int, rows: np.ndarray, values: np.ndarray, n: int) -> None:
        """Adagrad on those rows of a table that have a gradient."""
        a, s = (x if x.ndim > 1 else x[:, None] for x in (self.m.arrays()[part], self.squares[part]))
        there = np.zeros(len(a), bool)
        there[rows] = True
        own = np.flatnonzero(there)
        place = np.empty(len(a), np.int64)
        place[own] = np.arange(len(own))
        g = (spread(place[rows], values, len(own)) / n).astype(np.float32)
        square = s[own] + g * g
        s[own] = square
        a[own] -= self.rate * g / np.sqrt(square)


def spread(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values by row."""
    return np.stack([np.bincount(rows, values[:, j], n) for j in range(values.shape[1])], axis=1)


def bucket(lead: np.ndarray, n: int) -> np.ndarray:
    return (mixed(lead.astype(np.uint64) + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def tokens(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """A part of a batch, its words' hashes (signed) and leads, and each text's first word."""
    hasher = WordHasher("space")
    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                h, rows, lead = hasher.words(part.column(text))
                yield part, h, lead, runs(rows, part.num_rows)
            trim()


def count_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for _, h, lead, offsets in tokens(batches, 0):
        words, first, n = np.unique(h, return_index=True, return_counts=True)
        b = bucket(lead[first], buckets)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array([len(offsets) - 1] + [0] * (len(words) - 1) if len(words) else [], pa.int64())], names=["word", "bucket", "n", "texts"])


@dataclass
class Sequence:
    """All tokens of some texts, every text's end included."""

    target: np.ndarray  # class
    before: np.ndarray
    before2: np.ndarray
    context: np.ndarray  # the words before as contexts of members
    context2: np.ndarray
    member: np.ndarray  # in its bucket, or -1 for a class of its own
    ends: np.ndarray

    def inner(self, at: np.ndarray, n_short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts, members and buckets of those tokens that are in buckets."""
        at = at[self.member[at] >= 0]
        return self.context[at], self.context2[at], self.member[at], self.target[at] - n_short


class Reader:
    """From words' hashes to classes and members."""

    def __init__(self, words: Words):
        self.words, self.n_short = words, 1 + len(words.short)
        self.short, self.class_of = Lookup(words.short.view(np.uint64)), np.argsort(words.short.view(np.uint64)) + 1
        self.own, self.member_of = Lookup(words.own.view(np.uint64)), words.member[np.argsort(words.own.view(np.uint64))]

    def sequence(self, h: np.ndarray, lead: np.ndarray, offsets: np.ndarray) -> Sequence:
        n_texts = len(offsets) - 1
        place = self.short.find(h)
        own, member = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        own[place >= 0] = self.class_of[place[place >= 0]]
        rare = np.flatnonzero(place < 0)
        b = bucket(lead[rare], self.words.buckets)
        own[rare] = self.n_short + b
        inside = self.own.find(h[rare])
        member[rare] = self.words.first[b]
        member[rare[inside >= 0]] = self.member_of[inside[inside >= 0]]
        at = np.arange(len(h)) + np.repeat(np.arange(n_texts), np.diff(offsets))
        target, all_member = np.zeros(len(h) + n_texts, np.int64), np.full(len(h) + n_texts, -1, np.int64)
        target[at], all_member[at] = own, member
        context = np.where(all_member >= 0, self.n_short + all_member, target)
        begin, ends = offsets[:-1] + np.arange(n_texts), offsets[1:] + np.arange(n_texts)
        return Sequence(target, *earlier(target, begin), *earlier(context, begin), all_member, ends)


def earlier(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each in its text, or the end of a text."""
    one, two = np.concatenate([[END], x[:-1]]), np.concatenate([[END, END], x[:-2]])[: len(x)]
    if len(x):
        one[begin] = two[begin] = END
        later = begin + 1
        two[later[later < len(x)]] = END
    return one[: len(x)], two


def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, bool]]:
    """shard, text in the order of shards -> pieces of ROWS texts of one shard, and whether a piece is its last one.

    Pieces don't depend on how Spark cuts batches."""
    shard, texts = None, []

    def taken(n: int) -> pa.Array:
        nonlocal texts
        whole = pa.concat_arrays(texts)
        texts = [whole.slice(n)] if len(whole) > n else []
        return whole.slice(0, n)

    for batch in batches:
        of = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if shard is not None and of[a] != shard:
                yield shard, taken(ROWS), True
            shard = int(of[a])
            texts.append(batch.column(1).slice(a, b - a))
            while sum(map(len, texts)) > ROWS:
                yield shard, taken(ROWS), False
    if shard is not None:
        yield shard, taken(ROWS), True


def train_rows(batches: Iterator[pa.RecordBatch], words: Words, model: Model, rate: float, batch_tokens: int = 8192) -> Iterator[pa.RecordBatch]:
    """For each shard the trained model in slices, and the number of its tokens."""
    reader, hasher, t, done = Reader(words), WordHasher("space"), None, 0
    for shard, texts, last in in_shards(batches):
        if t is None:
            t, done = Trainer(model, words, rate, samples=64, ratio=16, inner_ratio=3, seed=(11, shard)), 0
        with np.errstate(over="ignore"):
            h, rows, lead = hasher.words(texts)
        s = reader.sequence(h, lead, runs(rows, len(texts)))
        mix, i = t.rng.permutation(len(s.target)), 0
        while i < len(mix):
            j = mix[i : i + (batch_tokens if done > 64 * 1024 else 1024)]  # small steps at first
            t.step(s.before[j], s.before2[j], s.target[j])
            t.step_in(*s.inner(j, reader.n_short))
            i, done = i + len(j), done + len(j)
        trim()
        if last:
            flat = t.m.flat().astype(np.float32)
            for k in range(0, len(flat), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([k // SLICE], pa.int32()), pa.array([flat[k : k + SLICE].tobytes()], pa.binary()), pa.array([done], pa.int64())], names=["shard", "slice", "cells", "tokens"])
            t = None


def averaged(rows: pd.DataFrame) -> pd.DataFrame:
    """The mean of one slice of all shards' models (at most as many as there are trainers), in the order of shards."""
    rows = rows.sort_values("shard")
    total = sum(np.frombuffer(c, np.float32).astype(np.float64) * n for c, n in zip(rows["cells"], rows["tokens"], strict=True))
    return pd.DataFrame({"slice": [int(rows["slice"].iloc[0])], "cells": [(total / rows["tokens"].sum()).astype(np.float32).tobytes()]})


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double, rare array<long>"


def score_rows(batches: Iterator[pa.RecordBatch], words: Words, model: Model) -> Iterator[pa.RecordBatch]:
    reader, known, table = Reader(words), Lookup(words.known.view(np.uint64)), model.normalisers()
    log_known = np.log10(words.counts[np.argsort(words.known.view(np.uint64))] + 1.0)
    for part, h, lead, offsets in tokens(batches, 2):
        n = part.num_rows
        s = reader.sequence(h, lead, offsets)
        log_p = model.log_probabilities(s.before, s.before2, s.target, table)
        inside = np.flatnonzero(s.member >= 0)
        context, context2, member, of = s.inner(inside, reader.n_short)
        log_p[inside] += model.log_members(context, context2, member, of, words.first)
        rest = np.zeros(len(s.target), bool)
        rest[inside] = member == words.first[of]
        log_p[rest] -= words.log_rest[s.target[rest] - reader.n_short]
        place = known.find(h)
        log_c = np.where(place >= 0, log_known[place], 0.0) if len(log_known) else np.zeros(len(h))
        of_text = np.repeat(np.arange(n), np.diff(offsets))
        word_rest = np.delete(rest, s.ends)
        log_model = np.bincount(np.repeat(np.arange(n), np.diff(offsets) + 1), log_p, n) + np.bincount(of_text[word_rest], log_c[word_rest], n)
        log_counts = np.bincount(of_text, log_c, n) + math.log10(words.end_count + 1)
        n_known = np.bincount(of_text, place >= 0, n).astype(np.int64) + int(words.end_count > 0)
        left = np.flatnonzero(place < 0)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_text[left], np.arange(n + 1)).astype(np.int32)), pa.array(h[left].view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(np.diff(offsets) + 1), pa.array(n_known), pa.array(log_counts), pa.array(log_model), lists], names=["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_model", "rare"])


def most_frequent(counts: DataFrame, known: int) -> pd.DataFrame:
    """The words from a count upwards, as many counts as give no more than ``known`` words; most frequent first.

    The count is found in the table of counts of counts, so no more than these words come to the driver."""
    total, least = 0, None
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        total += r.words
        if total > known:
            break
        least = r.n
    rows = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    return rows.toPandas().sort_values(["n", "word"], ascending=[False, True])


def upto(counts: DataFrame, chosen: pd.DataFrame) -> Column:
    """Whether a word is one of the chosen (the most frequent ones, in order)."""
    if not len(chosen):
        return F.lit(False)
    least = chosen.iloc[-1]
    return (F.col("n") > int(least["n"])) | ((F.col("n") == int(least["n"])) & (F.col("word") <= int(least["word"])))


def vocabulary(counts: DataFrame, n_texts: int, n_words: int, classes: int, buckets: int, known: int, most_words: int) -> Words:
    frequent = most_frequent(counts, known)
    short = frequent.head(classes - 1)
    own = frequent.iloc[len(short) : len(short) + min(most_words, math.isqrt(max(0, n_words)) // 2)].sort_values("bucket", kind="stable")
    mass = {r.bucket: (r.n, r.v) for r in counts.where(~upto(counts, frequent.head(len(short) + len(own)))).groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    rest = np.array([mass.get(b, (0, 0)) for b in range(buckets)], np.float64)
    of, n = own["bucket"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
    sizes = np.bincount(of, minlength=buckets) + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    member = np.arange(len(own)) + of + 1  # behind the rest of each bucket up to its own
    weight = np.empty(first[-1])
    weight[first[:-1]], weight[member] = rest[:, 0] + 1.0, n + 1.0
    in_bucket = np.add.reduceat(weight, first[:-1])
    outer = np.concatenate([[n_texts + 1.0], short["n"].to_numpy(np.float64) + 1.0, in_bucket])
    return Words(short["word"].to_numpy(np.int64), own["word"].to_numpy(np.int64), member, first, frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.float64), n_texts, buckets, np.log10(rest.sum(1) + 1), outer / outer.sum(), weight / np.repeat(in_bucket, sizes))


def own_partitions(df: DataFrame, n: int) -> list[int]:
    """n numbers that Spark's hash deals to n partitions, one to each."""
    rows = df.sparkSession.range(0, 32 * n + 64, 1, 1).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p")).agg(F.min("v").alias("v")).collect()
    found = {r.p: r.v for r in rows}
    return [found.get(p, 32 * n + 64 + p) for p in range(n)]


def trained(texts: DataFrame, words: Words, n_tokens: int, dim: int, rounds: tuple[tuple[float, int], ...], shard_tokens: int, trainers: int) -> Model:
    """The model after all rounds of training on the texts."""
    model, n = Model.start(words, dim), max(1, min(trainers, -(-n_tokens // shard_tokens)))
    dealt = texts.select(F.xxhash64("text", "doc_id").alias("order"), "text")
    for rate, every in rounds:
        shards = max(1, n // every)
        labels = own_partitions(texts, shards)
        chosen = dealt.where(F.pmod("order", F.lit(every)) == 0).withColumn("shard", F.element_at(F.array(*map(F.lit, labels)), F.pmod(F.xxhash64("order"), F.lit(shards)).cast("int") + 1))
        chosen = chosen.repartition(shards, "shard").sortWithinPartitions("shard", "order").select("shard", "text")
        copies = chosen.mapInArrow(lambda it, m=model, r=rate: train_rows(it, words, m, r), "shard int, slice int, cells binary, tokens long")
        found = copies.groupBy("slice").applyInPandas(averaged, "slice int, cells binary").toPandas().sort_values("slice")
        if len(found):
            model = model.like(np.frombuffer(b"".join(found["cells"]), np.float32))
    return model


def scores(docs: DataFrame, held_out: Column, classes: int = 512, buckets: int = 256, known: int = 300_000, dim: int = 16, rounds: tuple[tuple[float, int], ...] = ((0.1, 16), (0.05, 1)), most_words: int = 65_536, shard_tokens: int = 4_000_000, trainers: int = 1024) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of the whole texts.

    ``rounds``: for each round of training the learning rate, and of how many texts one is trained on (the last round takes all)."""
    ship(__name__, WordHasher.__module__)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where(~F.col("held_out")).select("doc_id", "text")
    partial = train.select("text").mapInArrow(lambda it: count_rows(it, buckets), "word long, bucket int, n long, texts long")
    counts = keep(partial.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")))
    n_texts = train.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, v = total.n + n_texts, total.v + (1 if n_texts else 0)
    words = vocabulary(counts, n_texts, total.n, classes, buckets, known, most_words)
    model = trained(train, words, n_all, dim, rounds, shard_tokens, trainers)
    found = rows.mapInArrow(lambda it: score_rows(it, words, model), SCORED).withColumn("row", F.monotonically_increasing_id())
    found = keep(found)
    rare = found.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("log_rare"))
    both = found.drop("rare").join(rare, "row", "left").withColumn("log_rare", F.coalesce("log_rare", F.lit(0.0)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("log_counts") + F.col("log_rare") - F.col("n_tokens") * F.lit(math.log10(n_all + 1.0 * (v + 1)))).alias("base_score"), (F.col("log_model") + F.col("log_rare")).alias("score"))
