"""Op 7. Benchmark decontamination: edit-distance search through Hamming space.

A document is contaminated by an item if some run of its words is within ``EDITS`` (a
share of the item's words) insertions, deletions or substitutions of words of the item.

1. Windows. Walks of a CGK embedding drift apart with the edits passed, so an item of more
   than ``BLOCK`` words is cut into even blocks, and windows have a block's size (an item's,
   if it has one block). A run within d edits holds one of b blocks with d / b edits or
   fewer. Such a block of m words with e edits shares m - q + 1 - q * e of its word q-grams
   with the run at least (q is 3, or less for short blocks, so this is always above 0), and
   they lie on e + 1 neighbouring diagonals (a diagonal is a q-gram's place in the document
   less its place in the block; each insertion or deletion moves it by one). Every diagonal
   of such a stretch lays one window; no other window can matter.
2. CGK embedding. A window's words walk into a string of symbols: at step j the current
   word is copied and the pointer moves on or stays by a random bit of (j, word). Words at
   edit distance e end at Hamming distance O(e^2) with constant probability.
3. Bit-sampling LSH. ``TABLES`` walks, each with ``SAMPLES`` sampled places; a window and
   a block that agree on all samples of a walk are candidates. Windows that agreed leave,
   the others take the next walks.
4. Verification. The exact least edit distance of the whole item to any part of the region
   around the window decides (dynamic programming over many regions at once); candidates
   close to each other share one region.

Longer items have more blocks and so more chances: runs planted at the edit limit (20 to 400
words; deletions, insertions, mixed) are found with a share of 0.99 or more at each length,
held against the exact search of all windows (``walks=False``).

Items are a bounded table (a benchmark), broadcast in parts of ``MAX_ITEM_BYTES``; the
documents pass the parts one after another, are never shuffled, and every word of them is
looked at. Words are lower-cased runs of letters, digits and non-ASCII characters.

Defined results: null and empty texts hold no passage; items without words match nothing;
several items with one id, or one text, match each on its own; an item with a null id sets
``contaminated`` and is in neither ``items`` nor ``n_items``; null ids pass through; empty
tables give results with zero counts or no rows; other columns stay (a column that bears an
output name, in upper or lower case, is replaced).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

EDITS = 0.2
#: Most words of a window.
BLOCK = 40
#: Walks of the embedding, and places sampled from each.
TABLES, SAMPLES = 64, 2
#: Walks done at once.
WALKS = 8
#: Most bytes of benchmark text in one broadcast part.
MAX_ITEM_BYTES = 256 << 20
#: Cells of a row of the edit tables that are worked on at once.
CELLS = 1 << 19
_ITEMS: dict = {}  # a worker embeds the items once
OUT = {"n_items": T.LongType(), "items": T.ArrayType(T.LongType()), "contaminated": T.BooleanType()}


def words_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and one past the last)."""
    data, off = X.doc_bytes(texts)
    data = X.WORD_FOLD[data]
    s, e, wo = X.spans(data, off, data != 32)
    return X.span_hash(data, s, e), wo


def edit_limit(m: np.ndarray | int):
    return np.floor(EDITS * np.asarray(m) + 1e-9).astype(np.int64)


def gram_length(m: int, e: int) -> int:
    """The longest q-gram, 3 at most, that m words and a run within e edits must share."""
    return next(q for q in (3, 2, 1) if m - q + 1 - q * e > 0)


class Items:
    """Benchmark items, their embedded blocks and the q-grams that lead to them."""

    def __init__(self, ids: list, texts: list):
        h, wo = words_of(pa.array(texts, pa.string()))
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(wo[:-1], wo[1:])]
        self.m = np.diff(wo)
        item, start, size, edits = [], [], [], []
        for i, m in enumerate(self.m.tolist()):
            b = -(-m // BLOCK)
            for k in range(b):
                item.append(i), start.append(k * m // b), size.append((k + 1) * m // b - k * m // b)
                edits.append(int(edit_limit(m)) // b)
        self.item, self.start, self.size, self.edits = (np.array(x, np.int64) for x in (item, start, size, edits))
        self.q = np.array([gram_length(m, e) for m, e in zip(size, edits)], np.int64)
        #: q-grams that a run and its best block share at least
        self.shared = self.size - self.q + 1 - self.q * self.edits
        # q-grams of every block: hash -> (block, place), sorted by hash
        g, block, place = [], [], []
        for i in range(len(self.item)):
            x = X.gram_hash(self.block_words(i), int(self.q[i]))
            g.append(x ^ np.uint64(self.q[i])), block.append(np.full(len(x), i)), place.append(np.arange(len(x)))
        cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
        g, block, place = cat(g, np.uint64), cat(block, np.int64), cat(place, np.int64)
        order = np.argsort(g)
        self.gram, self.block, self.place = g[order], block[order], place[order]
        keys, self.first, self.count = np.unique(self.gram, return_index=True, return_counts=True)
        keys = np.where(keys == 0, np.uint64(1), keys)
        self.table = X.HashTable(max(8, 4 * len(keys)))
        if len(keys):
            self.table.put(keys, np.arange(len(keys), dtype=np.int32))
        rng = np.random.Generator(np.random.PCG64(7))
        self.salt = rng.integers(1, 2**63, (2 * BLOCK, TABLES), dtype=np.uint64) | np.uint64(1)
        self.picks = rng.random((TABLES, SAMPLES))
        self.keys = np.zeros((len(self.item), TABLES), np.uint64)
        for c in range(0, len(self.item), 4096):
            some = np.arange(c, min(c + 4096, len(self.item)))
            win = np.zeros((len(some), int(self.size[some].max())), np.uint64)
            for i in some:
                win[i - c, :self.size[i]] = self.block_words(i)
            for t in range(0, TABLES, WALKS):
                self.keys[some, t:t + WALKS] = self.walk_keys(win, self.size[some], t)

    def block_words(self, i: int) -> np.ndarray:
        return self.words[self.item[i]][self.start[i]:self.start[i] + self.size[i]]

    def walk_keys(self, win: np.ndarray, size: np.ndarray, first: int) -> np.ndarray:
        """Keys of the ``WALKS`` walks from ``first`` on, one row per window: the symbols at the
        walk's sampled places. ``win`` holds word hashes, zeros beyond a window's size."""
        tables = slice(first, first + WALKS)
        want = np.floor(self.picks[None, tables] * (2 * size)[:, None, None]).astype(np.int64)
        took = np.zeros(want.shape, np.uint64)
        at = np.zeros(want.shape[:2], np.int64)
        rows, end = np.arange(len(win))[:, None], size[:, None]
        win = np.concatenate([win, np.zeros((len(win), 1), np.uint64)], axis=1)  # a walk past the end copies zeros
        with np.errstate(over="ignore"):
            for j in range(int(want.max(initial=-1)) + 1):
                sym = win[rows, np.minimum(at, end)]
                for k in range(SAMPLES):
                    np.copyto(took[:, :, k], sym, where=want[:, :, k] == j)
                at += ((sym * self.salt[j, tables]) >> np.uint64(63)).astype(np.int64)
            key = np.zeros(want.shape[:2], np.uint64)
            for k in range(SAMPLES):
                key ^= X.mix(took[:, :, k] + np.uint64(k + 1) * X._BASE)
        return key

    def agree(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Whether the window of the block's size at each place of the words ``h`` (inside its
        document, ``lo`` to ``hi``) and the block agree on the samples of some walk."""
        out = np.zeros(len(at), bool)
        for c in range(0, len(at), 8192):
            left = np.arange(c, min(c + 8192, len(at)))
            b = block[left]
            width = np.arange(int(self.size[b].max()))
            idx = at[left][:, None] + width
            inside = (idx >= lo[left][:, None]) & (idx < hi[left][:, None]) & (width < self.size[b][:, None])
            win = np.where(inside, h[np.clip(idx, 0, len(h) - 1)], np.uint64(0))
            for t in range(0, TABLES, WALKS):
                hit = (self.walk_keys(win, self.size[b], t) == self.keys[b, t:t + WALKS]).any(axis=1)
                out[left[hit]] = True
                left, b, win = left[~hit], b[~hit], win[~hit]
                if not len(left):
                    break
        return out


def least_edits(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """For each pair the least word edits that turn the item into some part of the region."""
    n = len(items)
    out = np.zeros(n, np.int64)
    order = np.argsort([len(r) for r in regions])
    c = 0
    while c < n:
        k = 512
        while k > 1 and k * len(regions[order[min(c + k, n) - 1]]) > CELLS:
            k //= 2
        pick = order[c:c + k]
        c += k
        a, r = [items[i] for i in pick], [regions[i] for i in pick]
        la, lr = np.array([len(x) for x in a]), np.array([len(x) for x in r])
        A, R = np.zeros((len(pick), la.max(initial=0)), np.uint64), np.zeros((len(pick), lr.max(initial=0)), np.uint64)
        for i, (x, y) in enumerate(zip(a, r)):
            A[i, :len(x)], R[i, :len(y)] = x, y
        beyond = np.arange(R.shape[1] + 1)[None, :] > lr[:, None]
        ramp = np.arange(R.shape[1] + 1)
        row = np.zeros((len(pick), R.shape[1] + 1), np.int64)  # the part may start anywhere
        best = np.where(la == 0, 0, 10**9)
        for i in range(A.shape[1]):
            step = np.empty_like(row)
            step[:, 0] = i + 1
            step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (A[:, i:i + 1] != R))
            row = np.minimum.accumulate(step - ramp, axis=1) + ramp  # skipped words of the region
            done = la == i + 1
            if done.any():
                best[done] = np.where(beyond[done], 10**9, row[done]).min(axis=1)
        out[pick] = best
    return out


def find(items: Items, texts, walks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of every passage found in a string array, each pair once. Without
    ``walks`` every window is a candidate: the exact search."""
    h, wo = words_of(texts)
    none = np.zeros(0, np.int64)
    doc_of = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    docs, diags, blocks = [none], [none], [none]
    for q in np.unique(items.q).tolist():
        if len(h) < q:
            continue
        g = X.gram_hash(h, q) ^ np.uint64(q)
        g[g == 0] = 1
        at = items.table.get(g)
        pos = np.flatnonzero((at >= 0) & (doc_of[:len(g)] == doc_of[q - 1:]))
        many = items.count[at[pos]]
        entry = np.repeat(items.first[at[pos]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pos = np.repeat(pos, many)
        docs.append(doc_of[pos]), diags.append(pos - items.place[entry]), blocks.append(items.block[entry])
    doc, diag, block = np.concatenate(docs), np.concatenate(diags), np.concatenate(blocks)
    if not len(doc):
        return none, none
    # that many q-grams of the block lie in the document, or it has no such run
    _, of, count = np.unique(doc * len(items.item) + block, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[of] >= items.shared[block])
    order = keep[np.lexsort((diag[keep], of[keep]))]
    doc, diag, block, of = doc[order], diag[order], block[order], of[order]
    # and on e + 1 neighbouring diagonals: every diagonal of such a stretch lays a window
    most = int(items.size.max())
    key = of * (len(h) + 2 * most + 1) + diag + most
    last = np.searchsorted(key, key + items.edits[block], "right")
    near = np.flatnonzero(last - np.arange(len(key)) >= items.shared[block])
    cover = np.zeros(len(key) + 1, np.int64)
    np.add.at(cover, near, 1), np.add.at(cover, last[near], -1)
    once = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & np.append(True, key[1:] != key[:-1])[:len(key)])
    # the first of a run of equal diagonals is covered if any of them is: stretches start at one
    doc, diag, block = doc[once], diag[once], block[once]
    if walks:
        agreed = items.agree(h, wo[doc], wo[doc + 1], diag, block)
        doc, diag, block = doc[agreed], diag[agreed], block[agreed]
    # one region for the candidates of each stretch of m + 2 * d words
    item = items.item[block]
    diag = diag - items.start[block]
    m, d = items.m[item], edit_limit(items.m[item])
    order = np.lexsort((diag, item, doc))
    doc, diag, item, m, d = (x[order] for x in (doc, diag, item, m, d))
    pair, stretch = doc * len(items.m) + item, diag // (m + 2 * d)
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (stretch[1:] != stretch[:-1]))[:len(pair)])
    last = np.append(first[1:], len(pair))[:len(first)] - 1
    doc, item, m, d = doc[first], item[first], m[first], d[first]
    a = np.maximum(diag[first] - d, wo[doc])
    b = np.minimum(diag[last] + m + d, wo[doc + 1])
    found_doc, found_item = [none], [none]
    for c in range(0, len(doc), 8192):
        pick = slice(c, c + 8192)
        edits = least_edits([items.words[i] for i in item[pick]], [h[x:y] for x, y in zip(a[pick], b[pick])])
        good = edits <= d[pick]
        found_doc.append(doc[pick][good]), found_item.append(item[pick][good])
    pairs = np.unique(np.stack([np.concatenate(found_doc), np.concatenate(found_item)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", max_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``docs`` with n_items, items (sorted item ids) and contaminated."""
    b = (benchmark.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text"))
         .where(F.octet_length("text") > 0).distinct())
    bytes_ = b.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-2 * bytes_ // max_bytes) if bytes_ > max_bytes else 1
    names = {c: f"__in{i}" for i, c in enumerate(c for c in docs.columns if c.lower() not in OUT)}
    text_col = next(n for c, n in names.items() if c.lower() == text_col.lower())
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])  # mapInArrow takes no names with dots
    out = out.withColumns({"n_items": F.lit(0).cast("bigint"), "items": F.array().cast("array<bigint>"),
                           "contaminated": F.lit(False)})
    for p in range(max(parts, 1)):
        # a part's size is bounded: rows go to parts by hash
        rows = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect() if parts > 1 else b.collect()
        out = _add_part(out, [r.id for r in rows], [r.text for r in rows], text_col)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *OUT)


def _add_part(docs: DataFrame, ids: list, texts: list, text_col: str) -> DataFrame:
    """The hits of one part of the items joined to those that ``docs`` carries."""
    shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
    token = uuid.uuid4().hex
    kept = [c for c in docs.columns if c not in OUT]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields,
                           *[T.StructField(k, t) for k, t in OUT.items()]])

    def run(batches):
        items = _ITEMS.get(token)
        if items is None:
            _ITEMS.clear()
            items = _ITEMS[token] = Items(*shared.value)
        for batch in batches:
            for part in X.slices(batch, text_col):
                doc, item = find(items, part.column(part.schema.get_field_index(text_col)))
                lists = part.column(part.schema.get_field_index("items")).to_pylist()
                for x, i in zip(doc.tolist(), item.tolist()):
                    if items.ids[i] is not None:
                        lists[x].append(items.ids[i])
                lists = [sorted(set(x)) for x in lists]
                n = np.array([len(x) for x in lists], np.int64)
                hit = np.array(part.column(part.schema.get_field_index("contaminated")).to_pylist(), bool)
                hit[doc] = True
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(kept))], pa.array(n), pa.array(lists, pa.list_(pa.int64())),
                     pa.array(hit)], [*kept, *OUT])
    return docs.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, columns unchanged."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = contamination(docs.toDF(*names.values()), benchmark, names[text_col], **how).where(~F.col("contaminated"))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
