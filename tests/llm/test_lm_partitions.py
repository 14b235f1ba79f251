"""Scores of the language model do not follow the partitioning of its input."""

import numpy as np

from tallyframe.llm import lm_scores


def test_scores_after_repartition(spark, monkeypatch):
    monkeypatch.setattr(lm_scores, "REPLICA_TOKENS", 6000)
    g = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    rows = [(i, " ".join(g.choice(words, int(g.integers(1, 120)), p=p / p.sum()))) for i in range(300)] + [(5, None), (None, "a b"), (7, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    a, b = (sorted(lm_scores.lm_scores(d.repartition(n)).collect(), key=key) for n in (2, 7))
    assert [r[:5] for r in a] == [r[:5] for r in b]
    assert np.allclose([r.base_score for r in a], [r.base_score for r in b], rtol=1e-12)  # order of sums
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=1e-4)
    assert np.isfinite([r.score for r in a]).all()
