"""Exact BM25 top-k search: a stored inverted index in shards, searched list by list for batches of queries, exact merge.

score(q, d) = sum over the distinct words t of q of idf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean length)),
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)), with N, df and the mean length of all documents, so that scores of all
shards compare and their local top k merge to the exact one.

1. The index is built once and written to the shared folder: a row for each shard of some thousand documents has the lists of its
   words (hashes, in order), places of documents and counts. Documents with like words (k-means on the shard's most frequent ones)
   stand together, so that the lists of a language's words are dense where its documents are. List lengths, which Spark sums, are the document frequencies.
2. Queries are worked on in blocks of at most ``query_block`` (fewer if they are long), each with a pass over the index; words and frequencies of
   a block are one row that Spark broadcasts, so neither driver nor tasks ever hold two.
3. The search itself (``KERNEL``, Java that the driver compiles) takes a shard and a block: query by query it adds the impacts of the query's lists in the shard
   to a row of scores that stays in the core's cache. The most frequent words' lists are left out as long as their highest impacts stay below a share of the floor;
   only documents that the other lists bring within that reach of the floor look them up, as bytes rounded up. The share adapts to the shard and changes no result.
   A query whose words' highest impacts in the shard don't come to its k-th best score so far has no hit there and is passed over.
   Sums are in single precision with a margin beyond their rounding; what may be among the k best and reaches the k-th best so far is scored in double precision.
4. Documents are searched in tiers, the longest first, since most of the best hits are among them: one document in 256, one in 16,
   the rest.  The k-th best scores so far are what a hit of the next tier must reach, and no shard hands on more than k hits a query.
5. The shards' k best are merged by one ranking.

The clusters, the order of documents, their shards and their tiers don't change any result, whatever they come to.

Defined results: a query without words has no row; documents that share no word with a query are no hits, so a
query may have fewer than k; ties go to the smaller id, null ids last; a document finds itself; rows of one query
id are one query with the words of all; repeated documents are hits of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvm
from .common import keep, setting, ship
from .textbytes import WordHasher, distinct, runs, text_bytes, trim

#: Documents and postings of a shard (its places are two bytes each, a row of its scores fits in a core's first cache).
SHARD, POSTINGS = 4096, 2_000_000
#: Documents whose words are hashed at once; shards of fewer documents are not clustered.
SLICE, LEAST_CLUSTERED = 512, 512
#: Words of a block's queries, on average.
BLOCK_WORDS = 2_000_000
#: Hits that wait for a merge.
WAITING = 300_000
#: Scores are compared and returned to this precision.
DIGITS = 9
LAST = np.iinfo(np.int64).max
#: Documents of a task in the last tier (a quarter of it in those before).
TASK_DOCS = 16_384
#: The index's rows are wide, so its row groups and the readers' batches are small.
SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: docs and lengths by place; words (sorted hashes), where their lists start, the lists' places and counts.
INDEX = "n long, total long, docs binary, lengths binary, words binary, starts binary, places binary, counts binary"
BLOCK = "ids binary, from binary, own binary, hashes binary, code binary, idf binary, floor binary, settings binary"


@dataclass
class Queries:
    """A block of queries. Its words are told by codes, the most frequent first, so that what is looked up most stands together."""

    ids: np.ndarray
    starts: np.ndarray  # where each query's words begin in own
    own: np.ndarray  # codes
    words: np.ndarray  # sorted hashes (signed) of all words of the queries
    code: np.ndarray  # of each
    idf: np.ndarray  # of each
    mean_length: float
    floor: np.ndarray  # what a hit must reach


# The index


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Up to SLICE rows at a time, and fewer where they hold more than 64 MB."""
    _, of = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = min(at + SLICE, max(at + 1, int(np.searchsorted(of, of[at] + (64 << 20), "right")) - 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def index_rows(batches: Iterator[pa.RecordBatch], clusters: int) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> a row for each shard."""
    hasher = WordHasher("alnum")
    with np.errstate(over="ignore"):
        waiting, n_docs, n_postings = [], 0, 0
        for batch in batches:
            for part in slices(batch, 1):
                h, rows = hasher.column(part.column(1))
                of = runs(rows, part.num_rows)
                words, counts, ends = counted(h, of)
                waiting.append((part.column(0).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False), np.diff(of), np.diff(ends), words, counts))
                n_docs, n_postings = n_docs + part.num_rows, n_postings + len(words)
                if n_docs + SLICE > SHARD or n_postings >= POSTINGS:
                    yield shard_row(waiting, clusters)
                    waiting, n_docs, n_postings = [], 0, 0
            trim()
        if n_docs:
            yield shard_row(waiting, clusters)


def shard_row(waiting: list[tuple[np.ndarray, ...]], clusters: int) -> pa.RecordBatch:
    ids, lengths, sizes, h, counts = (np.concatenate(x) for x in zip(*waiting, strict=True))
    n, d = len(ids), np.repeat(np.arange(len(ids)), sizes)
    words, t = np.unique(h.view(np.int64), return_inverse=True)
    df = np.bincount(t, minlength=len(words))
    order = np.lexsort((-lengths, alike(t, d, n, np.log(1 + (n - df + 0.5) / (df + 0.5)), df, clusters)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    key = t * n + place[d]
    by_word = np.argsort(key)
    columns = ids[order], lengths[order].astype(np.int64), words, np.append(0, np.cumsum(df)).astype(np.int32), (key[by_word] % n).astype(np.uint16), counts[by_word].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([lengths.sum()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=INDEX.replace(" long", "").replace(" binary", "").split(", "))


def alike(t: np.ndarray, who: np.ndarray, n: int, idf: np.ndarray, work: np.ndarray, clusters: int, features: int = 256, rounds: int = 6) -> np.ndarray:
    """Clusters of documents with like words (t: words, who: their documents): spherical k-means on the words of most work, from the farthest points on, always the same."""
    most = np.argsort(-work, kind="stable")[:features]
    column = np.full(len(work), -1)
    column[most] = np.arange(len(most))
    x = np.zeros((n, max(1, len(most))), np.float32)
    c = column[t]
    x[who[c >= 0], c[c >= 0]] = idf[t[c >= 0]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    if n <= LEAST_CLUSTERED:
        return np.zeros(n, np.int64)
    filled = np.count_nonzero(x, axis=1)
    some = np.flatnonzero(filled >= np.median(filled))  # short documents are far from all
    centres = [x[some[0]]]
    for _ in range(clusters - 1):
        centres.append(x[some[np.argmin(np.max(x[some] @ np.stack(centres).T, axis=1))]])
    centre = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([x[own == a].sum(0) if (own == a).any() else centre[a] for a in range(clusters)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return np.argmax(x @ centre.T, axis=1)


def counted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each document, in order, how often each is there, and the documents' offsets."""
    h = h.copy()
    for a, b in zip(of[:-1], of[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[of[:-1][of[:-1] < len(h)]] = True
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))).astype(np.int32), np.searchsorted(at, of)


def df_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n, total, words, starts -> the shards' frequencies as rows (word, df); word null: documents and words."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, starts = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in ((2, np.int64), (3, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)], names=["word", "df", "total"])
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.diff(starts).astype(np.int64)), pa.array(np.zeros(len(words), np.int64))], names=["word", "df", "total"])


# Queries


def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher("alnum")
    with np.errstate(over="ignore"):
        for batch in batches:
            for part in slices(batch, 1):
                h, rows = hasher.column(part.column(1))
                words, _, ends = counted(h, runs(rows, part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.view(np.int64)))], names=["id", "words"])


def prepared(rows: pa.Table, df: pa.Table, n: int, mean_length: float) -> Queries:
    """The block of queries (id, words) as the search needs it, with the document frequencies of its words (word, df)."""
    ids, place = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    h, count = df.column("word").to_numpy(), df.column("df").to_numpy().astype(np.float64)
    order = np.argsort(h)
    h, count = h[order], count[order]
    code = np.empty(len(h), np.int64)
    code[np.argsort(-count, kind="stable")] = np.arange(len(h))
    words = rows.column("words").combine_chunks()
    sizes, own = np.diff(words.offsets.to_numpy()), words.values.to_numpy()
    at = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
    there = h[at] == own if len(h) else np.zeros(len(own), bool)  # words that no document has can't add to a score
    pairs = distinct(np.repeat(place, sizes)[there] * np.int64(len(h) + 1) + code[at[there]])
    who, own = pairs // np.int64(len(h) + 1), pairs % np.int64(len(h) + 1)
    return Queries(ids, runs(who, len(ids)).astype(np.int32), own.astype(np.int32), h, code.astype(np.int32), np.log(1 + (n - count + 0.5) / (count + 0.5)), max(mean_length, 1e-9), np.zeros(len(ids)))


# The search


#: A shard's columns (from docs on) and a block's -> hits: query id, document id and score, 8 bytes each.
KERNEL = r"""
import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;
import org.apache.spark.sql.api.java.UDF14;

/** The k best hits in a shard for every query of a block: (query id, document id, score) after one another. */
public class Bm25Shard implements UDF14 {
  private static final double DIGITS = 1e9, SPARE = 0.8;
  private static final int SHARD = 4096, COMMON = 16;

  private static ByteBuffer of(Object x) { return ByteBuffer.wrap((byte[]) x).order(ByteOrder.LITTLE_ENDIAN); }
  private static int[] ints(Object x) { int[] y = new int[((byte[]) x).length / 4]; of(x).asIntBuffer().get(y); return y; }
  private static char[] chars(Object x) { char[] y = new char[((byte[]) x).length / 2]; of(x).asCharBuffer().get(y); return y; }
  private static long[] longs(Object x) { long[] y = new long[((byte[]) x).length / 8]; of(x).asLongBuffer().get(y); return y; }
  private static double[] doubles(Object x) { double[] y = new double[((byte[]) x).length / 8]; of(x).asDoubleBuffer().get(y); return y; }

  /** Adds the impacts of a list: a posting is the upper bits of a float and, in the lower 12, the document's place. */
  private static void addList(float[] s, int[] postings, int from, int to) {
    for (int p = from; p < to; p++) {
      int x = postings[p];
      s[x & (s.length - 1)] += Float.intBitsToFloat(x & -4096);
    }
  }

  /** Those that reach lim. */
  private static int reaching(float[] s, int n, float lim, int[] near) {
    int found = 0;
    for (int d = 0; d < n; d++) if (s[d] >= lim) near[found++] = d;
    return found;
  }

  /** The heap's length-th highest of some scores. */
  private static float kth(float[] s, int[] near, int some, float[] heap) {
    Arrays.fill(heap, 0f);
    for (int f = 0; f < some; f++) {
      float x = s[near[f]];
      if (x <= heap[0]) continue;
      int at = 0;
      for (int c = 1; c < heap.length; c = 2 * at + 1) {
        if (c + 1 < heap.length && heap[c + 1] < heap[c]) c++;
        if (heap[c] >= x) break;
        heap[at] = heap[c];
        at = c;
      }
      heap[at] = x;
    }
    return heap[0];
  }

  /** What a row of the table can add. */
  private static float atMost(byte[] table, int row, int[] columns, float[] units, int n) {
    float x = 0;
    for (int a = 0; a < n; a++) x += units[a] * (table[row + columns[a]] & 255);
    return x;
  }

  /** The score of a document whose words are word[from] and on, for the query that has marked its words. */
  private static double exact(int[] word, int[] count, int from, int to, int[] mark, int own, double[] weight, double norm) {
    double score = 0;
    for (int p = from; p < to; p++) {
      int j = word[p];
      if (mark[j] == own) score += weight[j] * (count[p] / (count[p] + norm));
    }
    return score;
  }

  private static void addAll(float[] s, int[] postings, int[] starts, int[] mine, int from, int to) {
    for (int a = from; a < to; a++) addList(s, postings, starts[mine[a]], starts[mine[a] + 1]);
  }

  public Object call(Object docs_, Object lengths_, Object words_, Object starts_, Object places_, Object counts_, Object ids_, Object from_, Object own_, Object hashes_, Object code_, Object idf_, Object floor_, Object settings_) {
    long[] docs = longs(docs_), lengths = longs(lengths_), words = longs(words_), ids = longs(ids_), hashes = longs(hashes_);
    int[] starts = ints(starts_), counts = ints(counts_), from = ints(from_), own = ints(own_), code = ints(code_);
    char[] place = chars(places_);
    double[] idf = doubles(idf_), floor = doubles(floor_), settings = doubles(settings_);
    double mean = settings[0], k1 = settings[1], b = settings[2];
    int k = (int) settings[3], frequent = (int) settings[4], n = docs.length;
    double[] norm = new double[n];
    for (int d = 0; d < n; d++) norm[d] = k1 * (1 - b + b * lengths[d] / mean);

    // lists of the block's words that the shard has: by code, the place of its list or -1
    int[] list = new int[code.length];
    Arrays.fill(list, -1);
    int[] postings = new int[counts.length], column = new int[words.length];
    float[] top = new float[words.length];
    double[] weight = new double[words.length], byCode = new double[code.length];
    int[] codeOf = new int[words.length];
    int[] sizes = new int[words.length];
    for (int j = 0; j < words.length; j++) sizes[j] = starts[j + 1] - starts[j];
    Arrays.sort(sizes);
    int wide = 0, common = Math.max(n / COMMON, words.length > frequent ? sizes[words.length - 1 - frequent] : 0);
    for (int i = 0, j = 0; i < hashes.length && j < words.length; ) {
      if (hashes[i] != words[j]) {
        if (hashes[i] < words[j]) i++;
        else j++;
        continue;
      }
      list[code[i]] = j;
      weight[j] = byCode[code[i]] = idf[i] * (k1 + 1);
      codeOf[j] = code[i];
      float most = 0;
      for (int p = starts[j]; p < starts[j + 1]; p++) {
        float x = (float) (weight[j] * (counts[p] / (counts[p] + norm[place[p]])));
        postings[p] = Float.floatToRawIntBits(x) & -4096 | place[p];
        most = Math.max(most, x);
      }
      top[j] = most * 1.0001f;
      column[j] = starts[j + 1] - starts[j] > common ? wide++ : -1;
      i++;
      j++;
    }
    // document x frequent word: impacts in 255ths of the word's highest, rounded up
    byte[] table = new byte[n * wide];
    float[] unit = new float[wide];
    for (int j = 0; j < words.length; j++) {
      if (weight[j] == 0 || column[j] < 0) continue;
      unit[column[j]] = top[j] / 255 * 1.0001f;
      for (int p = starts[j]; p < starts[j + 1]; p++) {
        double x = weight[j] * (counts[p] / (counts[p] + norm[place[p]]));
        table[place[p] * wide + column[j]] = (byte) Math.min(255, (int) Math.ceil(x / unit[column[j]]));
      }
    }

    // the documents' words
    int[] ofDoc = new int[n + 2];
    for (int j = 0; j < words.length; j++) {
      if (weight[j] != 0) for (int p = starts[j]; p < starts[j + 1]; p++) ofDoc[place[p] + 2]++;
    }
    for (int d = 0; d < n; d++) ofDoc[d + 2] += ofDoc[d + 1];
    int[] word = new int[ofDoc[n + 1]], count = new int[ofDoc[n + 1]];
    for (int j = 0; j < words.length; j++) {
      if (weight[j] == 0) continue;
      for (int p = starts[j]; p < starts[j + 1]; p++) {
        int at = ofDoc[place[p] + 1]++;
        word[at] = codeOf[j];
        count[at] = counts[p];
      }
    }

    // whatever the share comes to, the hits are the same
    double share = SPARE / 2;
    int marked = -1;
    int[] mark = new int[code.length];
    float[] s = new float[SHARD];
    float[] heap = new float[k];
    int[] mine = new int[1024];
    int[] near = new int[SHARD];
    int[] columns = new int[wide];
    float[] units = new float[wide];
    long[] bestDoc = new long[k];
    double[] best = new double[k];
    ByteBuffer out = ByteBuffer.allocate(1 << 16).order(ByteOrder.LITTLE_ENDIAN);
    for (int q = 0; q < ids.length; q++) {
      int m = 0;
      double bound = 0;
      if (mine.length < from[q + 1] - from[q]) mine = new int[from[q + 1] - from[q]];
      for (int p = from[q]; p < from[q + 1]; p++) {
        int j = list[own[p]];
        if (j >= 0) { mine[m++] = j; bound += top[j]; }
      }
      // postings have lost less than 2^-11 of their impact; a sum of m of them is off by less than this share of it
      double margin = 5e-4 + (m + 8) * 1.2e-7;
      double least = floor[q] - 2 / DIGITS;
      if (m == 0 || bound * (1 + margin) < least) continue;
      // the first lists, of the most frequent words, are looked at only for those that the others bring near the floor
      int rest = 0;
      double spare = 0;
      while (rest < m && column[mine[rest]] >= 0 && spare + top[mine[rest]] <= share * least) {
        units[rest] = unit[column[mine[rest]]];
        columns[rest] = column[mine[rest]];
        spare += top[mine[rest++]];
      }
      Arrays.fill(s, 0f);
      addAll(s, postings, starts, mine, rest, m);
      int held = 0, some = reaching(s, n, (float) Math.max((least - spare) * (1 - margin) - 1e-12, Float.MIN_VALUE), near);
      if (rest > 0 || share == 0) share = Math.min(SPARE, Math.max(0, share + (some > n / 100 ? -0.05 : 0.01)));
      double lim = least;
      if (some > 4 * k && rest == 0) {  // the k-th best here
        float kth = kth(s, near, some, heap);
        lim = Math.max(lim, kth * (1 - margin) - 2 / DIGITS);
      }
      for (int f = 0; f < some; f++) {
        int d = near[f];
        double x = s[d] * (1 + margin);
        if (x + spare < lim) continue;
        x += atMost(table, d * wide, columns, units, rest);
        if (x * (1 + margin) < lim) continue;
        if (marked != q) {
          for (int p = from[q]; p < from[q + 1]; p++) mark[own[p]] = q + 1;
          marked = q;
        }
        double score = exact(word, count, ofDoc[d], ofDoc[d + 1], mark, q + 1, byCode, norm[d]);
        if (score <= 0) continue;
        score = Math.rint(score * DIGITS) / DIGITS;
        if (score < floor[q]) continue;
        if (held == k && (score < best[k - 1] || score == best[k - 1] && docs[d] >= bestDoc[k - 1])) continue;
        int at = held < k ? held++ : k - 1;
        while (at > 0 && (best[at - 1] < score || best[at - 1] == score && bestDoc[at - 1] > docs[d])) { best[at] = best[at - 1]; bestDoc[at] = bestDoc[at - 1]; at--; }
        best[at] = score;
        bestDoc[at] = docs[d];
        if (held == k) lim = Math.max(lim, best[k - 1] - 2 / DIGITS);
      }
      if (out.remaining() < 24 * held) out = ByteBuffer.allocate(2 * out.capacity() + 24 * k).order(ByteOrder.LITTLE_ENDIAN).put(out.array(), 0, out.position());
      for (int a = 0; a < held; a++) out.putLong(ids[q]).putLong(bestDoc[a]).putDouble(best[a]);
    }
    return Arrays.copyOf(out.array(), out.position());
  }
}
"""


def found_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of the kernel's hits in a task's shards, as rows."""
    hits = np.zeros(0, [("query_id", "<i8"), ("doc_id", "<i8"), ("score", "<f8")])
    waiting, n = [hits], 0
    for batch in batches:
        for i in range(batch.num_rows):
            waiting.append(np.frombuffer(batch.column(0)[i].as_buffer(), hits.dtype).copy())
            n += len(waiting[-1])
            if n >= WAITING:
                waiting, n = [best_of(np.concatenate(waiting), k)], 0
    hits = best_of(np.concatenate(waiting), k)
    doc = np.ascontiguousarray(hits["doc_id"])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hits["query_id"])), pa.array(doc, mask=doc == LAST), pa.array(np.ascontiguousarray(hits["score"]))], names=["query_id", "doc_id", "score"])


def best_of(hits: np.ndarray, k: int) -> np.ndarray:
    hits = hits[np.lexsort((hits["doc_id"], -hits["score"], hits["query_id"]))]
    q = hits["query_id"]
    return hits[np.arange(len(q)) - np.searchsorted(q, q) < k]


def search_block(index: DataFrame, q: Queries, k: int, k1: float, b: float, frequent: int, so_far: DataFrame | None) -> DataFrame:
    """query_id, rank, doc_id, score of a block of queries in some shards and those found so far, in the shared folder."""
    spark = index.sparkSession
    columns = q.ids, q.starts, q.own, q.words, q.code, q.idf, q.floor, np.array([q.mean_length, k1, b, k, frequent], np.float64)
    names = BLOCK.replace(" binary", "").split(", ")
    # the arrays' own memory, not a copy
    block = spark.createDataFrame(pa.table({name: pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)]) for name, x in zip(names, columns, strict=True)}))
    kernel = jvm.register(spark, "Bm25Shard", KERNEL)
    pairs = index.select("docs", "lengths", "words", "starts", "places", "counts").crossJoin(F.broadcast(block))
    packed = pairs.select(F.call_function(kernel, "docs", "lengths", "words", "starts", "places", "counts", *names).alias("hits"))

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from found_rows(batches, k)

    hits = packed.mapInArrow(pass_, "query_id long, doc_id long, score double")
    return keep(ranked(hits if so_far is None else hits.unionAll(so_far.drop("rank")), k))


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, query_block: int = 16_384, frequent: int = 1024, clusters: int = 6, tiers: tuple[int, ...] = (256, 16)) -> DataFrame:
    """docs (doc_id, text), queries (id, text) -> query_id, rank, doc_id, score.

    frequent: words of a shard that can be left to the end, at most; clusters: groups of like documents in a shard."""
    ship(__name__, WordHasher.__module__)
    spark = docs.sparkSession
    with setting(spark, READER_ROWS, "256"):
        parts = index_of(docs, clusters, tiers)
        own = keep(queries.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL").mapInArrow(query_rows, "id long, words array<long>"))
    with setting(spark, READER_ROWS, "4"):
        return found_in_tiers(spark, parts, own, k, k1, b, query_block, frequent)


def found_in_tiers(spark: SparkSession, parts: list[DataFrame], own: DataFrame, k: int, k1: float, b: float, query_block: int, frequent: int) -> DataFrame:
    found = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    if not parts:
        return found
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionAll(part)
    frequencies = keep(lists.select("n", "total", "words", "starts").mapInArrow(df_rows, "word long, df long, total long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("total").alias("total")))
    stats = frequencies.where("word IS NULL").first()
    n_queries, n_words = own.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    n_blocks = max(-(-n_queries // query_block), -(-(n_words or 0) // BLOCK_WORDS))
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    known = keep(own.select("block", F.explode("words").alias("word")).distinct().join(frequencies, "word").select("block", "word", "df"))
    for block in range(n_blocks):
        mine = F.col("block") == block
        q = prepared(own.where(mine).select("id", "words").toArrow(), known.where(mine).select("word", "df").toArrow(), stats.df, stats.total / max(1, stats.df))
        best = None
        for part in parts:
            if best is not None:
                kth = best.where(F.col("rank") == k).select("query_id", "score").toArrow()
                at = np.searchsorted(q.ids, kth.column("query_id").to_numpy())
                q.floor[at] = np.maximum(q.floor[at], kth.column("score").to_numpy() - 10.0**-DIGITS)
            best = search_block(part, q, k, k1, b, frequent, best)
        found = found.unionAll(best)
    return found


def index_of(docs: DataFrame, clusters: int, tiers: tuple[int, ...]) -> list[DataFrame]:
    """The index in parts, in the shared folder, the longest documents first: one in ``tiers[0]``, one in ``tiers[1]``, ..., the rest.

    Documents of equal length are dealt by a hash of their ids. The small first parts are shuffled. A task has some thousand documents, however
    the files are cut, so that shards are whole and tasks hand on few hits that others have better."""

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from index_rows(batches, clusters)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(65_536)), F.lit(0)) / 65_536
    n, at = texts.agg(F.count(F.lit(1)), F.percentile_approx(weight, [1 - 1 / t for t in tiers], 100_000)).first()
    if not n:
        return []
    parts, above = [], None
    for t, least in zip(tiers, at, strict=True):
        own = (weight >= least) & (F.lit(True) if above is None else weight < above)
        tasks = max(1, n // t // (TASK_DOCS // 4))
        parts.append((texts.where(own).repartition(tasks, F.monotonically_increasing_id()), tasks))
        above = least
    parts.append((texts.where(weight < above) if above is not None else texts, max(1, n // TASK_DOCS)))
    return [keep(part.coalesce(tasks).mapInArrow(pass_, INDEX), **SMALL_GROUPS).coalesce(tasks) for part, tasks in parts]
