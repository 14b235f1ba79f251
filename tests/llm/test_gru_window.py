"""A window of the recurrent network: its states, its gradients, and what it costs."""

import tracemalloc
import warnings

import numpy as np
import pytest

from tallyframe.llm import gru

H = gru.HIDDEN


def _window(seed, steps, width):
    g = np.random.default_rng(seed)
    fresh = g.random((steps, width)) < 0.2
    fresh[0] = True
    return (g.integers(0, gru.VOCAB, (steps, width)), g.integers(0, gru.VOCAB, (steps, width)),
            np.where(g.random((steps, width)) < 0.2, -1, 0), fresh)


def _plain(p, given, fresh):
    """States of all steps in float64, by the formulas of the network."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    h, out = np.zeros((given.shape[1], H)), []
    for ids, new in zip(given, fresh):
        h = np.where(new[:, None], 0, h)
        x, s = p["emb"][ids] @ p["wx"] + p["b"], h @ p["wh"]
        r, z = ((1 + np.tanh((x + s)[:, i * H:i * H + H] / 2)) / 2 for i in (0, 1))
        n = np.tanh(x[:, 2 * H:] + r * s[:, 2 * H:])
        h = (1 - z) * n + z * h
        out.append(h)
    return np.stack(out)


def _loss(p, given, target, doc, fresh):
    hs = _plain(p, given, fresh)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    c, w = target // gru.WIDTH, target % gru.WIDTH
    lc, lw = hs @ p["wc"] + p["bc"], np.einsum("twh,twkh->twk", hs, p["wo"][c]) + p["bo"][c]
    logp = sum(np.take_along_axis(x, i[..., None], 2)[..., 0] - np.log(np.exp(x).sum(axis=2)) for x, i in ((lc, c), (lw, w)))
    return -logp[doc >= 0].sum()


@pytest.mark.parametrize("size", [1, 400])
def test_states_by_the_formulas(size):
    """Also with gates so large that they are 0 or 1 in float32."""
    given, _, _, fresh = _window(1, 40, 7)
    p = gru.start(np.ones(gru.VOCAB))
    p["wx"][:, :2 * H] *= size
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for keep in (False, True):
            hs, last, _ = gru._run(p, given, fresh, np.zeros((H, 7), np.float32), keep)
            want = _plain(p, given, fresh)
            assert np.allclose(hs.reshape(want.shape), want, atol=2e-4 if size > 1 else 2e-6)
            assert np.allclose(last.T, want[-1], atol=2e-4 if size > 1 else 2e-6)


@pytest.mark.parametrize("width", [3, 90])  # few of the classes, all of them
def test_gradients_of_a_window(width):
    given, target, doc, fresh = _window(2, 9, width)
    p = gru.start(np.random.default_rng(3).integers(1, 900, gru.VOCAB))
    got = {}

    class Keeping(gru.Trainer):
        def _step(self, k, g, rows=None):
            got[k] = np.zeros(self.p[k].shape)
            got[k][slice(None) if rows is None else rows] = g

    Keeping(p)._window(given, target, doc, fresh, np.zeros((H, width), np.float32))
    got["wo"], got["bo"] = got["wob"][:, :, :H], got["wob"][:, :, H]
    scale = 32 / (doc >= 0).sum()
    t = int(target[doc >= 0][0])
    for k, at in (("emb", (int(given[1, 0]), 3)), ("wx", (2, 5)), ("wx", (2, H + 5)), ("wx", (2, 2 * H + 5)), ("wh", (1, 4)), ("wh", (1, H + 4)),
                  ("wh", (1, 2 * H + 4)), ("b", (1,)), ("b", (H + 1,)), ("b", (2 * H + 1,)), ("wc", (3, 4)), ("bc", (5,)),
                  ("wo", (t // gru.WIDTH, t % gru.WIDTH, 6)), ("bo", (t // gru.WIDTH, 7))):
        f = []
        for by in (1e-4, -1e-4):
            q = {x: y.astype(np.float64) for x, y in p.items()}
            q[k][at] += by
            f.append(_loss(q, given, target, doc, fresh))
        want = np.clip((f[0] - f[1]) / 2e-4 * scale, -5, 5)
        assert got[k][at] == pytest.approx(want, rel=2e-3, abs=2e-4), (k, at)


def test_a_window_does_not_copy_the_embedding():
    """A step's cost follows the window: before, every window copied the whole embedding."""
    given, _, _, fresh = _window(4, 2, 2)
    p, h = gru.start(np.ones(gru.VOCAB)), np.zeros((H, 2), np.float32)
    gru._run(p, given, fresh, h, False)
    tracemalloc.start()
    try:
        gru._run(p, given, fresh, h, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < p["emb"].nbytes / 4
