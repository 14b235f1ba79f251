"""Op 11. Ranked lexical search: best-first intervals over range-maximum tables.

Documents are ranked for each query by the sum, over the query's terms (repeats included), of
w * ((1000000000 * tf) div (1000 * tf + 8 * m)), with w = floor(1000 * ln((2N+2) / (2df+1)))
and m = 25 + ((75 * n * N) div L): n terms of the document, N documents with a term, L terms
of all documents, df documents with the term, tf its count in the document.

1. Postings. One pass over the texts finds every document's length and the counts of the
   terms that some query has; N, L and df are sums over that table, for all documents.
2. Index. A task cuts its rows into chunks of bounded size. In a chunk the posting lists stand
   one after the other, by term and document; a sparse table over them holds, for every start
   and power of two, the posting of greatest impact, so the greatest impact of any part of a
   list is one comparison.
3. Search. An interval of documents is bounded by the sum of its lists' greatest impacts. The
   intervals of greatest bound are taken first (some at a time, for whole-array work): each is
   split at the document of its greatest weighted impact, that document is scored in full, and
   the two halves are bounded anew. Intervals whose bound is below the k-th best score so far
   are dropped; equal bounds are not, so ties are exact. A task's best scores carry over from
   chunk to chunk. The k best of every task meet in one ranking per query.

Queries are a stated set against all documents: those with equal texts are searched once, in
blocks of bounded bytes, so a broadcast never grows with either table. Terms are compared by
64-bit hashes.

Defined results: null or empty texts have no term, rank nowhere and do not count in N; a query
without terms has no rows; queries that repeat an id are ranked each on its own; documents that
repeat an id rank each on their own, null ids last among equal scores; empty tables give an
empty result; only the named columns are read, so no other column can clash.
"""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import stored

#: Bytes and number of query texts searched at once.
BLOCK_BYTES, BLOCK_QUERIES = 4 << 20, 20_000
#: Postings of a chunk, and intervals split at once.
CHUNK, STEP = 400_000, 96
_CACHE: dict = {}  # what a worker has built from a broadcast, by a name of its own

POSTINGS = "doc bigint, n bigint, terms array<int>, counts array<int>"


def terms_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(term hashes, first term of each text and one past the last)."""
    data, off = X.doc_bytes(texts)
    data = X.WORD_FOLD[data]
    s, e, bounds = X.spans(data, off, data != 32)
    h = X.span_hash(data, s, e)
    h[h == 0] = 1
    return h, bounds


class Queries:
    """The distinct terms of some query texts, and each query as (terms, repeats)."""

    def __init__(self, texts: list):
        h, bounds = terms_of(pa.array(texts, pa.string()))
        self.terms, code = np.unique(h, return_inverse=True)
        self.table = X.HashTable(max(8, 4 * len(self.terms)))
        if len(self.terms):
            self.table.put(self.terms, np.arange(len(self.terms), dtype=np.int32))
        self.each = [np.unique(code[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]


def _once(token: str, make):
    """``make()``, kept by this worker until another query set comes."""
    if token not in _CACHE:
        _CACHE.clear()
        _CACHE[token] = make()
    return _CACHE[token]


def postings(docs: DataFrame, shared, token: str, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term; terms are those of the queries."""
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        q = _once(token, lambda: Queries(shared.value))
        v = max(1, len(q.terms))
        for batch in batches:
            for part in X.slices(batch, "text"):
                h, bounds = terms_of(part.column(1))
                n = np.diff(bounds)
                term = q.table.get(h)
                known = np.flatnonzero(term >= 0)
                key, count = np.unique(np.repeat(np.arange(len(n)), n)[known] * v + term[known], return_counts=True)
                rows = np.flatnonzero(n > 0)
                off = pa.array(np.searchsorted(key // v, np.append(rows, len(n))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (key % v, count)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(n[rows]), *lists],
                                                 ["doc", "n", "terms", "counts"])
    return d.mapInArrow(run, POSTINGS)


def _frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; the result is bounded by the terms of a block of queries."""
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["term", "df"])
    rows = found.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


def length_norms(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of ``n`` terms, exactly, whatever the size of the corpus."""
    if len(n) and 75 * int(n.max()) * docs >= 1 << 62:
        return np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)
    return 25 + 75 * n.astype(np.int64) * docs // words


class Index:
    """Posting lists of a chunk of documents with a sparse table of their greatest impacts."""

    def __init__(self, n, off, term, count, size: int, docs: int, words: int):
        per = np.diff(off)
        owner = np.repeat(np.arange(len(n)), per)
        # documents alike stand together (by commonest term, then length): whole intervals of
        # them fall below the bound at once
        top = np.full(len(n), -1)
        by = np.lexsort((term, -count, owner))
        has = np.flatnonzero(per)
        top[has] = term[by[off[has]]]
        self.order = np.lexsort((n, top))
        place = np.empty(len(n), np.int64)
        place[self.order] = np.arange(len(n))
        self.n_docs = len(n)
        key = term.astype(np.int64) * self.n_docs + place[owner]
        by = np.argsort(key, kind="stable")
        self.key = key[by]
        self.at = place[owner][by]
        self.first = np.searchsorted(self.key, np.arange(size + 1) * self.n_docs)
        tf = count[by].astype(np.int64)
        self.impact = np.append(1_000_000_000 * tf // (1000 * tf + 8 * length_norms(n[owner[by]], docs, words)), 0)
        self.key = np.append(self.key, -1)
        longest = int(np.diff(self.first).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for j in range(1, longest.bit_length()):
            self.log[1 << j:] = j
        level = np.arange(len(tf) + 1, dtype=np.int32)
        self.best = [level]
        for j in range(1, longest.bit_length()):
            half = 1 << (j - 1)
            a, b = level[:-half], level[half:]
            level = np.append(np.where(self.impact[a] >= self.impact[b], a, b), level[-half:])
            self.best.append(level)
        self.best = np.stack(self.best)

    def bounds(self, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray):
        """(bound, document to split at) of intervals, given as ranges of every list."""
        size = hi - lo
        j = self.log[size]
        a, b = self.best[j, lo], self.best[j, np.maximum(hi - (1 << j), 0)]
        pick = np.where(self.impact[a] >= self.impact[b], a, b)
        most = np.where(size > 0, self.impact[pick], 0) * weight
        row, col = np.arange(len(lo)), most.argmax(axis=1)
        return most.sum(axis=1), self.at[np.minimum(pick[row, col], len(self.at) - 1)]


class Best:
    """The k best (score, document) of a query; null ids after all others."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score below this one cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score, doc, null) -> None:
        keep = score >= self.least()
        if keep.any():
            s, d, z = (np.concatenate(x) for x in ((self.score, score[keep]), (self.doc, doc[keep]), (self.null, null[keep])))
            by = np.lexsort((d, z, -s))[:self.k]
            self.score, self.doc, self.null = s[by], d[by], z[by]


def search_chunk(ix: Index, terms: np.ndarray, weight: np.ndarray, best: Best, doc: np.ndarray, null: np.ndarray) -> int:
    """Bring the chunk's best documents for a query into ``best``; returns the documents scored."""
    live = (weight > 0) & (ix.first[terms + 1] > ix.first[terms])
    terms, weight = terms[live], weight[live]
    if not len(terms):
        return 0
    base = terms * ix.n_docs
    room = 1024
    LO, HI, SPLIT = np.empty((room, len(terms)), np.int64), np.empty((room, len(terms)), np.int64), np.empty(room, np.int64)
    LO[0], HI[0] = ix.first[terms], ix.first[terms + 1]
    bound, split = ix.bounds(LO[:1], HI[:1], weight)
    SPLIT[0] = split[0]
    heap, used, step, seen = [(-int(bound[0]), 0)], 1, 1, 0
    while heap and -heap[0][0] >= best.least():
        floor, pick = best.least(), []
        while heap and len(pick) < step and -heap[0][0] >= floor:
            pick.append(heapq.heappop(heap)[1])
        step = min(STEP, 2 * step)
        lo, hi, d = LO[pick], HI[pick], SPLIT[pick]
        want = base + d[:, None]
        p = np.searchsorted(ix.key[:-1], want)
        here = ix.key[p] == want
        seen += len(pick)
        at = ix.order[d]
        best.add((np.where(here, ix.impact[p], 0) * weight).sum(axis=1), doc[at], null[at])
        lo, hi = np.concatenate([lo, p + here]), np.concatenate([p, hi])
        bound, split = ix.bounds(lo, hi, weight)
        keep = np.flatnonzero(bound >= best.least())
        if used + len(keep) > room:
            room = 2 * (room + len(keep))
            LO, HI, SPLIT = (np.concatenate([x[:used], np.empty((room - used, *x.shape[1:]), np.int64)]) for x in (LO, HI, SPLIT))
        at = slice(used, used + len(keep))
        LO[at], HI[at], SPLIT[at] = lo[keep], hi[keep], split[keep]
        for i, b in enumerate(bound[keep].tolist(), used):
            heapq.heappush(heap, (-b, i))
        used += len(keep)
    return seen


def _chunks(batches):
    """Batches of postings, joined or cut to about ``CHUNK`` postings."""
    wait, size = [], 0
    for batch in batches:
        off = batch.column(2).offsets.to_numpy()
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
            wait.append(batch.slice(i, j - i))
            size += int(off[min(j, batch.num_rows)] - off[i])
            i = j
            if size >= CHUNK:
                yield pa.Table.from_batches(wait).combine_chunks()
                wait, size = [], 0
    if wait:
        yield pa.Table.from_batches(wait).combine_chunks()


def _search_block(docs: DataFrame, texts: list, marks: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(mark, doc, score) of the k best of every text of one block."""
    spark = docs.sparkSession
    shared, token = spark.sparkContext.broadcast(texts), uuid.uuid4().hex
    found = stored(postings(docs, shared, token, id_col, text_col), "postings")
    n_docs, words = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(Queries(texts).terms)
    df = _frequencies(found, size)
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    weights = spark.sparkContext.broadcast((w, marks))

    def run(batches):
        q = _once(token, lambda: Queries(shared.value))
        w, marks = weights.value
        best = [Best(k) for _ in q.each]
        for t in _chunks(batches):
            doc, n, terms, counts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns)
            null = doc.is_null().to_numpy(zero_copy_only=False)
            ids = doc.fill_null(0).to_numpy()
            off = terms.offsets.to_numpy().astype(np.int64)
            ix = Index(n.to_numpy(), off - off[0], terms.flatten().to_numpy(), counts.flatten().to_numpy(), size, n_docs, words)
            for (term, times), b in zip(q.each, best):
                search_chunk(ix, term, w[term] * times, b, ids, null)
        rows = [(m, b) for m, b in zip(marks, best) if len(b.score)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([m for m, b in rows for _ in b.score]),
                 pa.array(np.concatenate([b.doc for _, b in rows]), mask=np.concatenate([b.null for _, b in rows])),
                 pa.array(np.concatenate([b.score for _, b in rows]))], ["mark", "doc", "score"])
    return found.mapInArrow(run, "mark string, doc bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item."""
    spark = docs.sparkSession
    own = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text")) \
        .where(F.octet_length("text") > 0).withColumn("mark", F.md5(F.col("text").cast("binary"))) \
        .withColumn("copy", F.monotonically_increasing_id())
    own = stored(own, "items")  # read in parts; the copies of an id keep their numbers
    texts = own.groupBy("mark").agg(F.min("text").alias("text"))
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // BLOCK_BYTES), -(-rows // BLOCK_QUERIES))
    out = None
    for i in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("mark"), F.lit(blocks)) == i).orderBy("mark").collect()  # about BLOCK_BYTES
        some = _search_block(docs, [r.text for r in part], [r.mark for r in part], k, id_col, text_col)
        out = some if out is None else out.union(some)
    order = Window.partitionBy("mark").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return own.join(top, "mark").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
