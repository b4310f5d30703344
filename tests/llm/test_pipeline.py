"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
from reelcheck.llm.common import keep

from .test_operators import ALNUM, SPACE, brute_components, brute_lines, low

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULT = "scumbag"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage, item = line(60), line(14)
    rows = []
    for i in range(160):
        text = "\n".join(line(rng.randint(5, 30)) for _ in range(rng.randint(1, 4)))
        if i % 9 == 0:
            text += f"\n{passage}"
        if i % 13 == 0:
            text += f"\n{line(3)} {item} {line(2)}"
        if i % 11 == 0:
            text = " ".join(f"{INSULT} {w}" if k % 5 == 0 else w for k, w in enumerate(text.split(" ")))
        if i % 10 == 7 and rows:  # a near copy of a document of two long lines
            source = rows[-1][1].split()
            source[rng.randrange(len(source))] = word()
            text = " ".join(source)
            rows[-1] = (i - 1, " ".join(rows[-1][1].split()), "en", "s0", 0)
        if i % 10 == 3 and rows:
            text = rows[-1][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return rows + [(900, None, "en", None, None), (901, "", "en", "s1", 0)], [(1, item), (2, line(20))]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(INSULT in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "mixing" else before  # noqa: F821
        out = keep(stage(spark, docs, sf))
        if name != "mixing":
            assert out.columns == docs.columns
        seen[name], docs = (before, out.collect()), out

    before, after = seen["toxicity"]
    assert {r.doc_id for r in after} == {d for d, t in before.items() if INSULT not in (t or "")}

    before, after = seen["line_dedup"]
    gone = brute_lines(list(before.items()), 50)
    want = {}
    for d, t in before.items():
        kept = [ln for i, ln in enumerate(t.split("\n")) if (d, i) not in gone] if t is not None else None
        if t is None or len(kept) == len(t.split("\n")):
            want[d] = t
        elif any(SPACE.findall(ln) for ln in kept):
            want[d] = "\n".join(kept)
    assert {r.doc_id: r.text for r in after} == want and gone

    before, after = seen["near_duplicates"]
    groups = brute_components([(d, t) for d, t in before.items()], 5, 80, 100)
    assert {r.doc_id for r in after} == {d for d, n, c in groups if d == c or not n} and len(after) < len(before)

    before, after = seen["decontamination"]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [ALNUM.findall(low(t))] for i in range(len(w) - 9)}
    dirty = {d for d, t in before.items() for w in [ALNUM.findall(low(t))] if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    assert {r.doc_id for r in after} == set(before) - dirty and dirty

    mixed = seen["mixing"][1]
    assert {r.doc_id for r in mixed} == {r.doc_id for r in after} and all(r.taken == r.copies * r.size <= 2 * r.size for r in mixed)
    key = lambda rs: sorted((r.doc_id, r.taken) for r in rs)
    assert key(corpus_pipeline.run(spark, sf).collect()) == key(mixed)
