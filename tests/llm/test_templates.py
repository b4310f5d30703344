"""Template nodes are counted over all pages of a host."""

from __future__ import annotations

from reelcheck.llm import extract


def page(i, words, layout="a"):
    body = f"<article><p>{words}</p><p>Written by the staff of layout {layout}</p></article>"
    return f"<html><body><div class='top-{layout}'>Top</div>{body}</body></html>"


def texts_of(spark, rows):
    return {r.page_id: r.text for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_nodes_are_counted_over_all_pages(spark):
    own = [f"Story {'abcdefghijklmnopqrstuvwxyz'[i]} of its own" for i in range(26)]
    url = lambda h: f"http://{h}.example/x"
    rows = [(i, url("plain"), page(i, own[i])) for i in range(12)] + [(100 + i, url("plain"), f"plain text {i}") for i in range(2)]
    rows += [(200 + i, url("two"), page(i, own[i], "a" if i % 2 else "b")) for i in range(12)]
    rows += [(300 + i, url("copies"), page(0, own[0])) for i in range(40)] + [(400 + i, url("copies"), None) for i in range(40)] + [(500 + i, url("copies"), page(i, own[i])) for i in range(1, 4)]
    got = texts_of(spark, rows)
    assert all(got[i] == own[i] for i in range(12)) and got[100] == "plain text 0"
    assert all(got[200 + i] == own[i] for i in range(12))
    assert all(got[300 + i] == own[0] for i in range(40)) and got[400] == "" and [got[500 + i] for i in range(1, 4)] == own[1:4]


def test_slots_are_summed_over_all_pages(spark):
    """Eight pages of 80, those with the least hashes, have nearly all of their text in another path."""
    words = lambda i, n: " ".join(f"word{i}x{j}" for j in range(n))
    two = lambda i, n, m: f"<body><div class='story'><p>{words(i, n)}</p></div><div class='box'><p>{words(-i, m)}</p></div></body>"
    hashed = spark.createDataFrame([(i, two(i, 2, 60) if i % 2 else two(i, 200, 1)) for i in range(400)], "page_id long, html string").selectExpr("*", "xxhash64(html) AS h").collect()
    odd = sorted((r for r in hashed if r.page_id % 2), key=lambda r: r.h)[:8]
    even = sorted((r for r in hashed if r.page_id % 2 == 0), key=lambda r: -r.h)[:72]
    assert max(r.h for r in odd) < min(r.h for r in even)
    got = texts_of(spark, [(r.page_id, "http://h.example/x", r.html) for r in odd + even])
    assert all(got[r.page_id] == words(r.page_id, 200) for r in even) and all(got[r.page_id] == words(r.page_id, 2) for r in odd)
    constant, slots = extract.induce([r.html for r in even + odd])
    assert not constant and [s.rsplit("/", 1)[1] for s in slots] == ["div.story"]


def test_shapes_seen_before_do_not_change_an_alignment():
    trees = [extract.parse(f"<body>{'<div><p>same</p></div>' * (i % 3)}<ul>{'<li>a</li>' * i}<li><b>{i}</b></li></ul><p>end</p></body>") for i in range(1, 9)]
    for most in (200_000, 1):
        aligned = extract.Aligned(trees[0], most)
        got = [sum(t.text() == "end" for t in trees[0].nodes()[0].nodes() + tree.nodes()[0].nodes() if id(t) in aligned.equal(tree)) for tree in trees[1:]]
        assert got == [1] * 7
