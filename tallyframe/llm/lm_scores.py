"""Op 5. Language-model scores of whole documents.

1. Counts. Every training document's tokens (lower-cased words, then an end token) are
   counted: per task first, then by one shuffle on the 64-bit word hash.
2. Coding. The most frequent words (all with at least some count, ``COMMON`` of them at
   most) are broadcast with their counts. One pass over the texts turns tokens into ids of
   the model's vocabulary (the ``VOCAB`` most frequent; others are one unknown id) and adds
   up what the common counts give; the rest of the words stay as (hash, times) and meet
   their counts in a join, so every count of the corpus is used, however rare.
3. Training. A gated recurrent network (``gru``) learns from every training document once,
   in ``ROUNDS`` parts: in each, replicas start from the same parameters, each trains on its
   documents, and their parameters are averaged by tokens. Part, replica and order of a document
   follow from a hash of its id and text, the number of replicas from the corpus' tokens, so
   the model does not depend on how the input is partitioned or on the session's cores.
4. Scoring. Each document is scored as a whole, its state carried from window to window.
   An unknown word adds its probability among unknown words, (c + 1) / (N' + V' + 1) with
   the counts outside the vocabulary, so scores are probabilities over all words.

Training documents: crc32 of the id as text modulo ``FOLDS`` is not ``HELD``.

Defined results: a null or empty text is one end token; a null id counts as the empty
string for the fold; rows that repeat an id are scored row by row (and counted each); with
no training row all counts are 0 and the network stays at its start; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from . import gru
from ._store import stored

FOLDS, HELD = 7, 2
COMMON = 1 << 20
#: Tokens that a replica should learn from in all rounds, and the most replicas.
REPLICA_TOKENS = 6_000_000
ROUNDS, REPLICAS = 2, 1024
END_HASH = np.uint64(1)
#: Tokens learnt from at once, and scored at once: a chunk takes as many steps as its longest
#: document, so larger chunks have wider steps (about 40 bytes of memory a token).
CHUNK_TOKENS, SCORE_TOKENS = 1 << 19, 1 << 21
BLOCK = 1 << 13


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    data, off = X.doc_bytes(texts)
    data = X.LOWER[data]
    s, e, wo = X.spans(data, off, ~X.SPACE[data])
    h = X.span_hash(data, s, e)
    h[h <= END_HASH] = 2
    return h, wo


def _merged(parts):
    h, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(inv, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(h, c) of the tokens of ``docs`` (text)."""
    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for part in X.slices(batch, "text", 2_000_000):
                h, _ = word_hashes(part.column(0))
                u, c = np.unique(h, return_counts=True)
                parts.append((np.append(u, END_HASH), np.append(c, part.num_rows)))
                held += len(u)
                if held > 1_500_000:  # a task's words in bounded pieces
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "c"])
                        parts, held = [], 0
        if parts:
            u, c = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])
    return docs.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Broadcast arrays: common hashes with counts, most frequent first."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        self.table = X.HashTable(max(8, len(h)))
        if len(h):
            self.table.put(h, np.arange(len(h), dtype=np.int32))
        self.log = np.log10(np.append(c, 0) + 1.0)
        # ids: 0 unknown, 1 end, then words by count
        is_end = h == END_HASH
        rank = np.cumsum(~is_end) + 1
        self.id = np.append(np.where(is_end, gru.END, np.where(rank < gru.VOCAB, rank, gru.UNKNOWN)), gru.UNKNOWN).astype(np.uint16)


_HELD: dict = {}


def _kept(key, make):
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def code(docs: DataFrame, common) -> DataFrame:
    """Tokens as ids and sums (see the module's text): one row per document, with its own
    ``row`` and a ``key`` from its id and text."""
    token = uuid.uuid4().hex
    schema = ("row bigint, id bigint, key bigint, held_out boolean, n_tokens bigint, n_common bigint, log_common double, "
              "n_oov bigint, log_oov double, ids binary, rare_h array<bigint>, rare_n array<bigint>")

    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        v = _kept(token, lambda: Vocabulary(*common.value))
        for batch in batches:
            for part in X.slices(batch, "text", 2_000_000):
                h, wo = word_hashes(part.column(3))
                n = part.num_rows
                at = v.table.get(np.append(h, END_HASH))
                end_at, at = at[-1], at[:-1]
                known = at >= 0
                log, wid = v.log[at], v.id[at]
                end_log = v.log[end_at]
                oov = wid == gru.UNKNOWN
                log_sum = np.concatenate([[0.0], np.cumsum(np.where(known, log, 0))])
                oov_sum = np.concatenate([[0.0], np.cumsum(np.where(oov & known, log, 0))])
                lens = np.diff(wo)
                ids = np.full(len(wid) + n, gru.END, "<u2")
                ids[np.arange(len(wid)) + np.repeat(np.arange(n), lens)] = wid
                cuts = wo + np.arange(n + 1)
                raw = ids.tobytes()
                rare = np.flatnonzero(~known)
                rdoc = np.searchsorted(wo, rare, "right") - 1
                order = np.lexsort((h[rare], rdoc))
                rh, rd = h[rare][order], rdoc[order]
                new = np.concatenate([[True], (rh[1:] != rh[:-1]) | (rd[1:] != rd[:-1])]) if len(rh) else np.zeros(0, bool)
                begin = np.flatnonzero(new)
                times = np.diff(np.append(begin, len(rh)))
                offs = pa.array(np.searchsorted(rd[begin], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), part.column(0), part.column(1), part.column(2), pa.array(lens + 1),
                    pa.array(X.per_doc(known, wo) + int(end_at >= 0)), pa.array(log_sum[wo[1:]] - log_sum[wo[:-1]] + end_log),
                    pa.array(X.per_doc(oov, wo)), pa.array(oov_sum[wo[1:]] - oov_sum[wo[:-1]]),
                    pa.array([raw[2 * a:2 * b] for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                    pa.ListArray.from_arrays(offs, pa.array(rh[begin].view(np.int64))),
                    pa.ListArray.from_arrays(offs, pa.array(times))],
                    ["row", "id", "key", "held_out", "n_tokens", "n_common", "log_common", "n_oov", "log_oov", "ids", "rare_h", "rare_n"])
                row += n
    return docs.select("id", F.xxhash64("id", "text").alias("key"), "held_out", "text").mapInArrow(run, schema)


def _documents(column):
    """(ids of all rows, bounds) of a binary column."""
    lens = np.array([len(x.as_buffer()) // 2 for x in column], np.int64)
    ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for x in column]) if len(column) else np.zeros(0, np.uint16)
    return ids.astype(np.int64), np.concatenate([[0], np.cumsum(lens)])


def _chunks(batches, column: int):
    """Rows in runs of about SCORE_TOKENS tokens."""
    for batch in batches:
        lens = np.array([len(x.as_buffer()) // 2 for x in batch.column(column)], np.int64)
        ends, i = np.cumsum(lens), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SCORE_TOKENS, "right")))
            yield batch.slice(i, j - i)
            i = j


def _by_replica(batches):
    """(replica, binary array of about CHUNK_TOKENS tokens) of rows that come sorted by replica,
    cut alike whatever the batches are."""
    now, held, size = None, [], 0
    for batch in batches:
        for replica, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            n = len(ids.as_buffer()) // 2
            if held and (replica != now or size + n > CHUNK_TOKENS):
                yield now, held
                held, size = [], 0
            now = replica
            held.append(ids)
            size += n
    if held:
        yield now, held


def train(coded: DataFrame, params: np.ndarray, tokens: int) -> np.ndarray:
    """Parameters after every training row was learnt from once."""
    spark = coded.sparkSession
    size = len(params)
    replicas = max(1, min(REPLICAS, -(-tokens // REPLICA_TOKENS)))
    for part in range(ROUNDS):
        now = spark.sparkContext.broadcast(params)

        def run(batches, now=now):
            def out():
                v = gru.flat(t.p)
                cut = range(0, size, BLOCK)
                return pa.RecordBatch.from_arrays([
                    pa.array(range(len(cut)), pa.int32()), pa.array([replica] * len(cut), pa.int32()), pa.array([t.tokens] * len(cut), pa.int64()),
                    pa.array([v[i:i + BLOCK].tobytes() for i in cut], pa.binary())], ["block", "replica", "tokens", "v"])

            replica, t = None, None
            for own, chunk in _by_replica(batches):
                if own != replica:
                    if t is not None:
                        yield out()
                    replica, t = own, gru.Trainer(gru.shaped(now.value))
                t.learn(*_documents(chunk))
            if t is not None:
                yield out()

        def mean(table: pa.Table) -> pa.Table:  # a block of each replica: REPLICAS x 32 KB at most
            table = table.sort_by("replica")
            w = np.array(table.column("tokens").to_pylist(), np.float64)
            v = np.stack([np.frombuffer(x, np.float32) for x in table.column("v").to_pylist()])
            out = ((v * w[:, None]).sum(axis=0) / w.sum()).astype(np.float32)
            return pa.table({"block": table.column("block")[:1], "v": pa.array([out.tobytes()], pa.binary())})

        mark = F.xxhash64("key")
        rows = coded.where((~F.col("held_out")) & (F.pmod(mark, F.lit(ROUNDS)) == part)) \
            .select(F.pmod(F.shiftright(mark, 8), F.lit(replicas)).cast("int").alias("replica"), "key", "ids")
        got = rows.repartition(replicas, "replica").sortWithinPartitions("replica", "key").select("replica", "ids") \
            .mapInArrow(run, "block int, replica int, tokens bigint, v binary") \
            .groupBy("block").applyInArrow(mean, "block int, v binary").collect()  # one model's size
        if got:
            params = np.concatenate([np.frombuffer(r.v, np.float32) for r in sorted(got, key=lambda r: r.block)])
    return params


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                    (F.pmod(F.crc32(key.cast("binary")), F.lit(FOLDS)) == HELD).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    counts = stored(count_words(d.where(~F.col("held_out"))), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the least count so that at most COMMON words reach it
    hist = counts.groupBy("c").count().withColumn("above", F.sum("count").over(
        _by_falling_count())).where(F.col("above") <= COMMON).agg(F.min("c")).first()[0]
    least = hist if hist is not None else n + 1
    top = counts.where(F.col("c") >= least).toArrow()  # COMMON rows of 16 bytes at most
    h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    common = spark.sparkContext.broadcast((h, c))
    vocab = Vocabulary(h, c)
    inside = vocab.id[:-1] != gru.UNKNOWN
    freq = np.zeros(gru.VOCAB)
    freq[vocab.id[:-1][inside]] = c[inside]
    freq[gru.UNKNOWN] = n - c[inside].sum()
    log_oov = float(np.log10(n - c[inside].sum() + v - inside.sum() + 1))

    coded = stored(code(d, common), "coded")
    params = train(coded, gru.flat(gru.start(freq)), n)
    model = spark.sparkContext.broadcast(params)

    def score(batches):
        p = gru.shaped(model.value)
        for chunk in _chunks(batches, 1):
            s = gru.log10_probs(p, *_documents(chunk.column(1)))
            yield pa.RecordBatch.from_arrays([chunk.column(0), *chunk.columns[2:], pa.array(s)], names)
    names = ["row", "id", "held_out", "n_tokens", "n_common", "log_common", "n_oov", "log_oov", "lm"]
    scored = coded.select("row", "ids", *names[1:-1]).mapInArrow(
        score, "row bigint, id bigint, held_out boolean, n_tokens bigint, n_common bigint, log_common double, n_oov bigint, "
               "log_oov double, lm double")
    pairs = coded.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("x")).select("row", "x.rare_h", "x.rare_n")
    rare = counts.where(F.col("c") < least)
    seen = pairs.join(rare, pairs["rare_h"] == rare["h"]).groupBy("row").agg(
        F.sum("rare_n").alias("n_rare"), F.sum(F.col("rare_n") * F.log10(F.col("c") + 1)).alias("log_rare"))
    out = scored.join(seen.withColumnRenamed("row", "row2"), F.col("row") == F.col("row2"), "left")
    n_rare, log_rare = F.coalesce("n_rare", F.lit(0)), F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_common") + n_rare).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("log_common") + log_rare - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("lm") + F.col("log_oov") + log_rare - F.col("n_oov") * log_oov).alias("score"))


def _by_falling_count():
    from pyspark.sql import Window
    # as many rows as there are different counts, a few thousand
    return Window.orderBy(F.col("c").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
