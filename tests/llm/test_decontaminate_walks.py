"""Op 7: recall of the walks against the exact search, items in parts, clashing columns."""

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import decontaminate as D


def words(seed, n):
    g = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in g.integers(0, 26, 5)) for _ in range(n)]


@pytest.mark.parametrize("m", [1, 5, 20, 40, 41, 60, 100, 160, 200, 400])
def test_walks_find_runs_at_the_edit_limit(m):
    g = np.random.default_rng(m)
    item = words(m, m)
    index = D.Items([0], [" ".join(item)])
    for kind in ("delete", "insert", "replace", "mixed"):
        texts = []
        for k in range(100):
            run = list(item)
            for p in sorted(g.choice(m, int(D.edit_limit(m)), replace=False), reverse=True):
                how = int(g.integers(0, 3)) if kind == "mixed" else ("delete", "insert", "replace").index(kind)
                run[p:p + 1] = [[], ["new", run[p]], ["zzz"]][how]
            texts.append(" ".join(words(10**6 + k, 30) + run + words(2 * 10**6 + k, 30)))
        exact = D.find(index, pa.array(texts), walks=False)[0]
        assert exact.tolist() == list(range(100))
        found = D.find(index, pa.array(texts))[0]
        assert set(found.tolist()) <= set(exact.tolist())
        assert len(found) >= 99


def test_walks_alone_decide_among_windows():
    # words of the item in another order share grams but no walk's samples, or fail the edit check
    item = words(1, 40)
    index = D.Items([0], [" ".join(item)])
    mixed = " ".join(item[20:] + words(2, 200) + item[:20])
    assert len(D.find(index, pa.array([mixed, "", None]))[0]) == 0
    one = index.agree(index.words[0], np.array([0]), np.array([40]), np.array([0]), np.array([0]))
    assert one.tolist() == [True]
    other, _ = D.words_of(pa.array([" ".join(words(3, 40))]))
    assert not index.agree(other, np.array([0]), np.array([40]), np.array([0]), np.array([0])).any()


def test_items_in_parts_equal_items_at_once(spark):
    items = [(i, " ".join(words(i, 12))) for i in range(30)] + [(3, None), (None, " ".join(words(90, 12))), (5, ""), (7, " ".join(words(8, 12)))]
    docs = [(k, " ".join(words(100 + k, 9) + words(k % 30, 12) + words((k * 7) % 30, 12)), k) for k in range(60)]
    docs += [(60, " ".join(words(90, 12)), 1), (61, None, 2), (None, " ".join(words(4, 12)), 3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, Items long")
    rows = lambda x: sorted((str(r.doc_id), r.n_items, list(r["items"]), r.contaminated) for r in x.collect())
    once = rows(D.contamination(d, b))
    assert rows(D.contamination(d, b, max_bytes=600)) == once
    got = {r[0]: r[1:] for r in once}
    assert got["8"] == (3, [7, 8, 26], True) and got["60"] == (0, [], True) and got["61"] == (0, [], False)
    assert got["None"][1] == [4]
    assert D.contamination(d, b).columns == ["doc_id", "text", "n_items", "items", "contaminated"]
