"""Ranked lexical search against a plain loop over whole texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(x):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))


def plain(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    bags = [b for b in bags if b[2]]
    n_docs, words = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for doc, bag, n in bags:
            m = 25 + (75 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                    for t in terms(text) if bag[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    g = np.random.default_rng(seed)
    words = ["w%d" % i for i in range(60)] + ["É", "ñandú", "X1"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(g.choice(words, int(g.integers(1, 40)), p=p / p.sum()))) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # ties beyond k
    return rows + [(None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1]), (900, None), (901, ""), (902, "--- !"), (903, " ".join(words) * 200)]


@pytest.mark.parametrize("chunk", [lexical.CHUNK, 400])
def test_equals_plain_loop(spark, monkeypatch, chunk):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    docs = corpus(1)
    g = np.random.default_rng(2)
    items = [(i, " ".join(g.choice(["w%d" % j for j in range(60)], 8))) for i in range(20)]
    items += [(3, "w1 W1 w1, w40"), (50, None), (51, "?"), (52, "ÉÉ unknown"), (53, docs[3][1]), (None, "w2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as doc", "'y' as score", "'z' as rank").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as mark", "2 as copy")
    got = sorted(map(tuple, lexical.ranked_search(d, b, 10).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 10)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    docs, items = corpus(3, 60), [(i, f"w{i} w{i + 1} w2") for i in range(10)]
    got = lexical.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(4, 5), "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_intervals_are_pruned():
    """Far fewer documents are scored than the chunk holds, with the same result as a full scan."""
    g = np.random.default_rng(5)
    n = g.integers(20, 200, 4000)
    per = g.integers(5, 15, 4000)
    term = np.concatenate([np.sort(g.choice(200, x, replace=False)) for x in per]).astype(np.int64)
    count = g.geometric(0.5, len(term))
    ix = lexical.Index(n, np.append(0, np.cumsum(per)), term, count, 200, 4000, int(n.sum()))
    best, q = lexical.Best(10), np.array([3, 17, 60])
    seen = lexical.search_chunk(ix, q, np.array([900, 700, 40]), best, np.arange(4000), np.zeros(4000, bool))
    assert seen < 1000 and len(best.doc) == 10


def test_length_norms_beyond_64_bits():
    n = np.array([10**7, 5], np.int64)
    assert lexical.length_norms(n, 10**13, 10**15).tolist() == [25 + 75 * 10**7 * 10**13 // 10**15, 25 + 75 * 5 * 10**13 // 10**15]
