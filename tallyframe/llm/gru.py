"""A gated recurrent language model in numpy with a class-factored output.

Token ids are cut into ``CLASSES`` classes of ``WIDTH`` ids; P(token) is P(class) times
P(token in class), both from the hidden state, so a step costs two small softmaxes.
Documents are packed into parallel lanes; a lane holds documents one after another, the
state is set to zero where a document starts and carried over every window in between.
"""

from __future__ import annotations

import numpy as np

CLASSES, WIDTH = 64, 64
VOCAB = CLASSES * WIDTH
DIM, HIDDEN = 16, 16
UNKNOWN, END = 0, 1
LANES, WINDOW, SCORE_WINDOW = 512, 32, 64
RATE = 0.08
SHAPES = {"emb": (VOCAB, DIM), "wx": (DIM, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
          "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (CLASSES, WIDTH, HIDDEN), "bo": (CLASSES, WIDTH)}


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Initial parameters: output biases give the relative frequencies of ``counts`` (one
    per id); the rest is random with a fixed seed."""
    g = np.random.Generator(np.random.PCG64(5))
    p = {k: (g.standard_normal(s) * (0.3 if k in ("emb", "wx", "wh") else 0.02)).astype(np.float32) for k, s in SHAPES.items()}
    c = (np.asarray(counts, np.float64) + 0.5).reshape(CLASSES, WIDTH)
    p["b"][:] = 0
    p["bc"][:] = np.log(c.sum(axis=1) / c.sum())
    p["bo"][:] = np.log(c / c.sum(axis=1, keepdims=True))
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = np.ascontiguousarray(v[at:at + n].reshape(s), dtype=np.float32)
        at += n
    return out


def lanes(ids: np.ndarray, bounds: np.ndarray, most: int = LANES):
    """(inputs, targets, document, fresh) matrices of steps x lanes; document is -1 on
    padding; fresh marks first steps of documents."""
    lens = np.diff(bounds)
    total, longest = int(lens.sum()), int(lens.max(initial=1))
    width = max(1, min(most, total // longest + 1, len(lens)))
    load, place = np.zeros(width, np.int64), np.zeros((len(lens), 2), np.int64)
    import heapq
    heap = [(0, i) for i in range(width)]
    for d in np.argsort(-lens, kind="stable").tolist():
        at, i = heapq.heappop(heap)
        place[d] = at, i
        heapq.heappush(heap, (at + int(lens[d]), i))
        load[i] = at + lens[d]
    steps = int(load.max(initial=0))
    where = np.repeat(place[:, 0] - bounds[:-1], lens) + np.arange(total)
    lane = np.repeat(place[:, 1], lens)
    target = np.full((steps, width), END, np.int64)
    doc = np.full((steps, width), -1, np.int64)
    fresh = np.zeros((steps, width), bool)
    target[where, lane] = ids
    doc[where, lane] = np.repeat(np.arange(len(lens)), lens)
    fresh[place[:, 0], place[:, 1]] = True
    given = np.full((steps, width), END, np.int64)
    given[1:] = target[:-1]
    given[fresh] = END
    return given, target, doc, fresh


def _run(p, given, fresh, h, keep):
    """Hidden states of a window, one row per step and lane, and the last state; with ``keep``
    also what the way back needs. Inside, features come before lanes, so that the gates of a
    step are whole blocks of memory. The reset and update gates come from one tanh:
    1 / (1 + exp(-x)) = (1 + tanh(x / 2)) / 2; their weights are halved beforehand."""
    steps, width = given.shape
    two, one, half = 2 * HIDDEN, np.array(1, np.float32), np.array(0.5, np.float32)
    scale = np.repeat(np.array([0.5, 1], np.float32), [two, HIDDEN])[:, None]
    x = p["emb"].take(given, axis=0).transpose(0, 2, 1)
    gates = np.matmul(p["wx"].T * scale, x)
    gates += p["b"][:, None] * scale
    wht = p["wh"].T * scale
    out = np.empty((steps, HIDDEN, width), np.float32)
    hg = np.empty((steps if keep else 1, 3 * HIDDEN, width), np.float32)
    resets, first = fresh.any(axis=1).tolist(), h
    for t, (rz, r, z, n, o) in enumerate(zip(gates[:, :two], gates[:, :HIDDEN], gates[:, HIDDEN:two], gates[:, two:], out)):
        if resets[t]:
            h = np.where(fresh[t], np.float32(0), h)
        g = hg[t if keep else 0]
        np.dot(wht, h, out=g)
        rz += g[:two]
        np.tanh(rz, out=rz)
        rz += one
        rz *= half
        n += r * g[two:]
        np.tanh(n, out=n)
        h = np.subtract(h, n, out=o)
        h *= z
        h += n
    saved = None
    if keep:
        before = np.concatenate([first[None], out[:-1]])
        before.transpose(0, 2, 1)[fresh] = 0
        saved = x, before, gates, hg[:, two:]
    return out.transpose(0, 2, 1).reshape(-1, HIDDEN), h, saved


def _exp_sum(a):
    """exp(a) in place and its row sums. Logits are log frequencies and a bounded sum of
    states in (-1, 1), far from overflow; should one grow, rows are shifted."""
    if a.size and a.max() > 60:
        a -= a.max(axis=1, keepdims=True)
    np.exp(a, out=a)
    return a @ np.ones(a.shape[1], np.float32)


def _output(p, hs, target, grad):
    """Log probabilities of targets; with ``grad`` also gradients of their negative sum."""
    n = len(target)
    # everything in order of class: one slice for each class; a last column of ones carries the biases
    order = np.argsort((target // WIDTH).astype(np.uint8), kind="stable")
    hs_o, target_o = np.ones((n, HIDDEN + 1), np.float32), target.take(order)
    hs_o[:, :HIDDEN] = hs.take(order, axis=0)
    wo = p["wob"] if "wob" in p else np.concatenate([p["wo"], p["bo"][:, :, None]], axis=2)
    cls = target_o // WIDTH
    sizes = np.bincount(cls, minlength=CLASSES)
    ends = np.cumsum(sizes).tolist()
    here = [(c, ends[c] - k, ends[c]) for c, k in enumerate(sizes.tolist()) if k]
    at_cls, at_word = np.arange(0, n * CLASSES, CLASSES) + cls, np.arange(0, n * WIDTH, WIDTH) + target_o % WIDTH
    pc = hs_o @ np.concatenate([p["wc"], p["bc"][None, :]])
    total = _exp_sum(pc)
    logp = np.log(pc.ravel().take(at_cls) / total)
    lw = np.empty((n, WIDTH), np.float32)
    for c, a, b in here:
        np.dot(hs_o[a:b], wo[c].T, out=lw[a:b])
    total_w = _exp_sum(lw)
    p_word = lw.ravel().take(at_word) / total_w
    logp += np.log(p_word)
    back = np.empty_like(logp)
    back[order] = logp
    if not grad:
        return back, None, None
    g_wo, dh_w = np.zeros((CLASSES, WIDTH, HIDDEN + 1), np.float32), np.empty((n, HIDDEN + 1), np.float32)
    lw *= (1 / total_w)[:, None]
    lw.ravel()[at_word] = p_word - 1
    pc *= (1 / total)[:, None]
    pc.ravel()[at_cls] -= 1
    for c, a, b in here:
        q = lw[a:b]
        np.dot(q.T, hs_o[a:b], out=g_wo[c])
        np.dot(q, wo[c], out=dh_w[a:b])
    dh_w = dh_w[:, :HIDDEN] + pc @ p["wc"].T
    dh = np.empty((n, HIDDEN), np.float32)
    dh[order] = dh_w
    g_wc = hs_o.T @ pc
    g = {"wc": g_wc[:HIDDEN], "bc": g_wc[HIDDEN]}
    if "wob" in p:
        return back, dh, g | {"wob": g_wo, "classes": [c for c, _, _ in here]}
    return back, dh, g | {"wo": g_wo[:, :, :HIDDEN], "bo": g_wo[:, :, HIDDEN]}


def log10_probs(p, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log10 probability of each whole document."""
    out = np.zeros(len(bounds) - 1)
    if len(ids) == 0:
        return out
    p = p | {"wob": np.concatenate([p["wo"], p["bo"][:, :, None]], axis=2)}
    given, target, doc, fresh = lanes(ids, bounds)
    h = np.zeros((HIDDEN, given.shape[1]), np.float32)
    for t in range(0, len(given), SCORE_WINDOW):
        w = slice(t, t + SCORE_WINDOW)
        hs, h, _ = _run(p, given[w], fresh[w], h, False)
        d = doc[w].ravel()
        use = np.flatnonzero(d >= 0)
        logp, _, _ = _output(p, hs.take(use, axis=0), target[w].ravel().take(use), False)
        out += np.bincount(d[use], weights=logp, minlength=len(out))
        if len(use) * 4 < len(d):  # most lanes are done: go on with the others
            left = (doc[t + SCORE_WINDOW:] >= 0).any(axis=0)
            given, target, doc, fresh, h = given[:, left], target[:, left], doc[:, left], fresh[:, left], h[:, left]
            if not left.any():
                break
    return out / np.log(10)


class Trainer:
    """Truncated back-propagation over windows with Adagrad steps."""

    def __init__(self, p):
        # output weights and biases are one array here: each class is a whole block of memory, and
        # ``wo`` and ``bo`` are parts of it
        self.p = {k: v.copy() for k, v in p.items()}
        wob = self.p["wob"] = np.concatenate([p["wo"], p["bo"][:, :, None]], axis=2)
        self.p["wo"], self.p["bo"] = wob[:, :, :HIDDEN], wob[:, :, HIDDEN]
        self.sq = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items() if k not in ("wo", "bo")}
        self.tokens = 0

    def _step(self, k, g, rows=None):
        if rows is None:
            self.sq[k] += g * g
            g *= RATE
            g /= np.sqrt(self.sq[k])
            self.p[k] -= g
        else:
            sq = self.sq[k].take(rows, axis=0)
            sq += g * g
            self.sq[k][rows] = sq
            g *= RATE
            g /= np.sqrt(sq, out=sq)
            self.p[k][rows] = self.p[k].take(rows, axis=0) - g

    def learn(self, ids: np.ndarray, bounds: np.ndarray) -> None:
        if len(ids) == 0:
            return
        given, target, doc, fresh = lanes(ids, bounds)
        self.tokens += len(ids)
        h = np.zeros((HIDDEN, given.shape[1]), np.float32)
        for t in range(0, len(given), WINDOW):
            w = slice(t, t + WINDOW)
            if (doc[w] >= 0).sum() * 4 < doc[w].size:
                left = (doc[t:] >= 0).any(axis=0)
                if not left.any():
                    break
                given, target, doc, fresh, h = given[:, left], target[:, left], doc[:, left], fresh[:, left], h[:, left]
            h = self._window(given[w], target[w], doc[w], fresh[w], h)

    def _window(self, given, target, doc, fresh, h):
        p = self.p
        steps, width = given.shape
        hs, last, (x, before, gates, hn) = _run(p, given, fresh, h, True)
        use = np.flatnonzero(doc.ravel() >= 0)
        scale = np.float32(1 / max(1, len(use)) * 32)
        if len(use) == len(hs):
            _, dh_all, g = _output(p, hs, target.ravel(), True)
        else:
            dh_all = np.zeros((steps * width, HIDDEN), np.float32)
            _, dh_all[use], g = _output(p, hs.take(use, axis=0), target.ravel().take(use), True)
        dh_all = np.ascontiguousarray(dh_all.reshape(steps, width, HIDDEN).transpose(0, 2, 1))
        two = 2 * HIDDEN
        # slopes of all steps at once: of the candidate state, and of both gates
        rz, n = gates[:, :two], gates[:, two:]
        n_slope = 1 - n * n
        rz_slope = rz - rz * rz
        # by a step's gradient: update gate, state before; by its candidate's: reset gate, the part from the state
        by_d, by_n = (np.empty((steps, 2, HIDDEN, width), np.float32) for _ in range(2))
        np.multiply(rz_slope[:, HIDDEN:], before - n, out=by_d[:, 0])
        np.multiply(rz_slope[:, :HIDDEN], hn, out=by_n[:, 0])
        by_d[:, 1], by_n[:, 1] = rz[:, HIDDEN:], rz[:, :HIDDEN]
        parts = np.empty((steps, 4, HIDDEN, width), np.float32)  # reset, update, part from the state, state before
        dg, dx = parts.reshape(steps, -1, width)[:, :3 * HIDDEN], np.empty_like(gates)
        back, wh, resets = np.zeros((HIDDEN, width), np.float32), p["wh"], fresh.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            d, dn, part = dh_all[t], dx[t, two:], parts[t]
            d += back
            np.multiply(d, by_d[t], out=part[1::2])
            np.subtract(d, part[3], out=dn)
            dn *= n_slope[t]
            np.multiply(dn, by_n[t], out=part[:3:2])
            back = np.dot(wh, dg[t])
            back += part[3]
            if resets[t]:
                back[:, fresh[t]] = 0
        dx[:, :two] = dg[:, :two]
        g["wx"] = np.matmul(x, dx.transpose(0, 2, 1)).sum(axis=0)
        g["wh"] = np.matmul(before, dg.transpose(0, 2, 1)).sum(axis=0)
        g["b"] = dx.sum(axis=(0, 2))
        demb = np.matmul(p["wx"], dx).transpose(0, 2, 1).reshape(-1, DIM)
        classes = g.pop("classes")
        if len(classes) * 4 < CLASSES * 3:  # the others have no gradient: an Adagrad step leaves them as they are
            g["wob"] = g["wob"].take(classes, axis=0)
        else:
            classes = None
        for k in ("wx", "wh", "b", "wc", "bc", "wob"):
            d = g[k] * scale
            self._step(k, np.clip(d, -5, 5, out=d), classes if k == "wob" else None)
        flat_ids = given.ravel().astype(np.uint16)
        order = np.argsort(flat_ids, kind="stable")
        s = flat_ids.take(order)
        begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        self._step("emb", np.clip(np.add.reduceat(demb.take(order, axis=0), begin) * scale, -5, 5), s[begin])
        return last
