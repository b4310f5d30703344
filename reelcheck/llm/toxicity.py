"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding: case, compatibility forms and accents (from Unicode's own decompositions), letters of other
scripts that look like Latin ones, digits and signs used as letters, invisible characters.  All that is
no letter or digit then is a space.  The automaton holds whole words (``" word "``), stems
(``" stem"``) and exception phrases; a hit inside an exception phrase doesn't count.

The lexicon is a fixed list plus words and stems learned from labelled documents: those whose share among
toxic documents is far above their share among others.  Weights are log odds.  The score is a logistic
function of the summed weights and of that sum normalised by the text's length, fitted to the same rows.

Learning reads a bounded sample of labelled rows (``sample_rows`` of either class, by hash of
the id), and never a held-out row.  With no usable labels the fixed list and fixed coefficients hold.
Everything else covers all documents, whole texts, in one pass without a shuffle.

Defined results: null and empty texts have no hit and get the base score; repeated rows are
documents of their own; labels that are null or contradict each other count as given; an empty table
gives an empty result; extra columns are handed through by ``scored`` and otherwise ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_rest, keep, ship

#: Insults with a prior weight of 4.
INSULTS = ["idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "vermin", "scumbag", "filth", "degenerate"]
#: Phrases in which such a word is harmless.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash", "circus clown", "clown fish", "class clown", "pathetic fallacy", "loser bracket", "sore loser rule", "village idiot play", "idiot proof", "idiot light", "degenerate case", "degenerate matter"]
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһӏԛԝьвкмнтαορνικτυεηωγßøłđıſ", "aeopcyxijsdhlqwbbkmhtaopvikryenwyboldis", strict=False))
#: Digits that stand for letters, and signs that do so in front of a letter or digit.
DIGITS = dict(zip("01345789", "oieastbg", strict=True))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
SIGN = re.compile(r"(?<=\w)[@$!|€](?=\w)|(?<![\w@$!|€])[@$!€](?=\w)")
#: Where labels can't tell: intercept, then one for each feature.
DEFAULT = (-3.0, 0.5, 0.5, 0.5)


class Folding(dict):
    """A table for str.translate that is filled as characters are met (at most one entry for each code point)."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)).lower()
        plain = "".join(LOOKALIKES.get(c, DIGITS.get(c, c)) for c in plain)
        if unicodedata.category(ch) == "Cf":
            plain = ""
        elif not plain.isalnum() and not (unicodedata.combining(ch) and not plain):
            plain = " "
        self[code] = plain
        return plain


def fold(text: str | None, table: Folding) -> str:
    if not text:
        return "  "
    if any(s in text for s in SIGNS):
        text = SIGN.sub(lambda m: SIGNS[m.group()], text)
    return f" {text.translate(table)} "


@dataclass
class Lexicon:
    weights: dict[str, float]  # "word" or "stem*"
    exceptions: list[str] = field(default_factory=lambda: EXCEPTIONS)
    coefficients: tuple[float, ...] = DEFAULT

    def automaton(self) -> ahocorasick.Automaton:
        auto, table, rows = ahocorasick.Automaton(), Folding(), {}
        for term, w in self.weights.items():
            key = " " + fold(term.rstrip("*"), table).strip() + ("" if term.endswith("*") else " ")
            rows[key] = (len(key), max(w, rows.get(key, (0, 0.0))[1]), False)
        for phrase in self.exceptions:
            key = fold(phrase, table)
            rows[key] = (len(key), 0.0, True)
        for key, row in rows.items():
            auto.add_word(key, row)
        auto.make_automaton()
        return auto


def hits(folded: str, auto: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """(place, weight) of the words hit: the heaviest entry of each word, without those in exception phrases."""
    found: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight, exception) in auto.iter(folded):
        start = end - length + 1
        if exception:
            spared.append((start, end))
        elif weight > found.get(start, 0.0):
            found[start] = weight
    return [(s, w) for s, w in sorted(found.items()) if not any(a <= s < b for a, b in spared)] if found else []


def features(text: str | None, auto: ahocorasick.Automaton, table: Folding) -> tuple[int, float, float, float]:
    """Hits, summed weight (its logarithm), summed weight normalised by length (the square root of the words), heaviest weight."""
    folded = fold(text, table)
    own = hits(folded, auto)
    if not own:
        return 0, 0.0, 0.0, 0.0
    total = sum(w for _, w in own)
    return len(own), math.log1p(total), total / math.sqrt(folded.count(" ") + 1), max(w for _, w in own)


def score(x: tuple[float, ...], coefficients: tuple[float, ...]) -> float:
    z = coefficients[0] + sum(c * v for c, v in zip(coefficients[1:], x[1:], strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def judge(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """The rows with two more columns: score and hits."""
    auto, table = lexicon.automaton(), Folding()
    for batch in batches:
        found = [features(t.as_py(), auto, table) for t in batch.column(text)]
        scores = pa.array([score(x, lexicon.coefficients) for x in found], pa.float64())
        columns = [c.cast(f.type) for c, f in zip(batch.columns, schema, strict=False)]
        yield pa.RecordBatch.from_arrays([*columns, scores, pa.array([x[0] for x in found], pa.int32())], schema=schema)


def scored(docs: DataFrame, lexicon: Lexicon, score_column: str = "score", hits_column: str = "n_hits") -> DataFrame:
    """All columns of docs and the two new ones; map-only."""
    ship(__name__)
    schema = StructType([*docs.schema.fields, StructField(score_column, DoubleType()), StructField(hits_column, IntegerType())])
    arrow, text = to_arrow_schema(schema), docs.columns.index("text")
    return docs.mapInArrow(lambda it: judge(it, lexicon, arrow, text), schema)


def terms(batches: Iterator[pa.RecordBatch], stems: tuple[int, ...], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """toxic, text -> (term, documents with it that are toxic, and that are not), summed up as far as memory is bounded."""
    table, counts = Folding(), (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list({**counts[0], **counts[1]})
        batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in (counts[1], counts[0])]], names=["term", "pos", "neg"])
        for c in counts:
            c.clear()
        return batch

    for batch in batches:
        for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
            words = set(fold(text.as_py(), table).split())
            words |= {w[:n] + "*" for w in words for n in stems if len(w) > n}
            counts[int(toxic.as_py() == 1)].update(words)
            if len(counts[0]) + len(counts[1]) > most:
                yield out()
    if counts[0] or counts[1]:
        yield out()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * len(x) * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, most_terms: int = 4000, min_docs: int = 4, min_odds: float = 2.2, min_z: float = 5.0, stems: tuple[int, ...] = (4, 5, 6, 7, 8)) -> Lexicon:
    """The lexicon and its coefficients from labelled documents (doc_id, toxic); held-out ids are never read.

    ``sample_rows``: at most so many labelled rows of either class are learned from.
    ``most_terms``: at most so many learned entries, the best supported first."""
    ship(__name__)
    allowed = labels.where((crc_rest("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = None
    for kind in (0, 1):
        part = allowed.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    shares = {r.toxic: r.n for r in allowed.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = {w: 4.0 for w in INSULTS}
    if len(shares) < 2:
        return Lexicon(weights)
    texts = docs.select("doc_id", "text")
    # bounded by sample_rows, so the ids go to the texts, and not the texts to the ids
    texts = keep(texts.join(F.broadcast(keep(chosen).withColumnRenamed("doc_id", "_id")), texts["doc_id"] == F.col("_id")).select("toxic", "text"))
    n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon(weights)
    once = texts.dropDuplicates(["text"])  # copies are one witness
    counts = once.mapInArrow(lambda it: terms(it, stems), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 0.5) / (n[1] + 1.0), (F.col("neg") + 0.5) / (n[0] + 1.0)
    pooled = (F.col("pos") + F.col("neg") + 1.0) / (n[0] + n[1] + 2.0)
    z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1.0 / n[0] + 1.0 / n[1]))
    best = counts.where(F.col("pos") >= min_docs).withColumns({"odds": F.log(p) - F.log(q), "z": z}).where((F.col("odds") >= min_odds) & (F.col("z") >= min_z)).orderBy(F.desc("z"), "term").limit(most_terms).collect()
    weights |= {r.term: float(r.odds) for r in best}
    lexicon = Lexicon(weights)
    # bounded by sample_rows: four numbers for each row that is learned from
    rows = texts.mapInArrow(lambda it: measured(it, lexicon), "toxic int, a double, b double, c double").collect()
    y = np.array([float(r.toxic) for r in rows])
    lexicon.coefficients = logistic(np.array([(r.a, r.b, r.c) for r in rows]), y, np.where(y == 1, shares[1] / n[1], shares[0] / n[0]) * len(y) / sum(shares.values()))
    return lexicon


def measured(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    auto, table = lexicon.automaton(), Folding()
    for batch in batches:
        found = [features(t.as_py(), auto, table) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *[pa.array([x[i] for x in found], pa.float64()) for i in (1, 2, 3)]], names=["toxic", "a", "b", "c"])


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), learn(docs, labels))
    return found.select("doc_id", F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    return scored(docs, learn(docs, labels), "_toxicity", "_hits").where(F.col("_toxicity") < threshold).drop("_toxicity", "_hits")
