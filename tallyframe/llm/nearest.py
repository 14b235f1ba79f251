"""Op 12. Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` hash tables turns a unit vector by a pseudo-random rotation (three rounds of
random signs and a fast Hadamard transform) and names the signed axis nearest to it; several
such names, the more the larger the collection, make the code of a bucket.

1. Distinct vectors. Equal vectors become one row with their smallest ids, one more than a
   result holds: no other of them can be among the nearest, the querying row itself left out.
2. Probes. A query looks into the ``P`` buckets of each table that cost least, the cost of an
   axis being the square of what it lacks to the nearest one. ``P`` is fitted: for a sample of
   ``SAMPLE`` queries the true neighbours are found by one pass over all vectors, and ``P`` is
   the least that finds ``TARGET`` of them. The sample bounds the fit only; every vector is in
   every table.
3. Buckets. Vectors and probing queries of a bucket meet in one task; buckets beyond ``BLOCK``
   vectors or queries are split into blocks, every pair of blocks being a task of its own. Only
   the best of every block leave it.
4. Reranking. Distances are the exact Euclidean ones of the original vectors, in doubles; the
   least over all tables, ties to the smaller id, are the result.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id; vectors of different length never meet; a row repeated with
its id and vector counts once; an id with several vectors queries with each of them, and never
finds itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

TABLES = 8
#: Vectors that a bucket should hold, and the most of them or of queries that meet in one task.
BUCKET, BLOCK = 1024, 8192
#: Queries that fit the number of probes, and the share of true neighbours to find for them.
SAMPLE, TARGET = 64, 0.96
SEED = 20260711


def matrix(lists) -> np.ndarray:
    """Rows of a list array whose lists have one length, in doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (a power of two long)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Polytopes:
    """The hash functions for vectors of one length: ``tables`` x ``depth`` rotations."""

    def __init__(self, dim: int, tables: int, depth: int):
        self.dim, self.tables, self.depth = dim, tables, depth
        self.size = 1 << (dim - 1).bit_length()
        self.signs = np.random.Generator(np.random.PCG64([SEED, dim])).choice([-1.0, 1.0], (tables, depth, 3, self.size))

    def axes(self, v: np.ndarray, t: int) -> np.ndarray:
        """(row, function, signed axis): components of the turned unit vectors, then their negatives."""
        unit = v / np.abs(v).max(axis=1, keepdims=True)
        unit = np.pad(unit / np.linalg.norm(unit, axis=1, keepdims=True), ((0, 0), (0, self.size - self.dim)))
        out = []
        for f in range(self.depth):
            x = unit
            for s in self.signs[t, f]:
                x = hadamard(x * s)
            out.append(np.concatenate([x, -x], axis=1))
        return np.stack(out, axis=1)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(row, table): the bucket of each vector."""
        weights = (2 * self.size) ** np.arange(self.depth)
        return np.stack([self.axes(v, t).argmax(axis=2) @ weights for t in range(self.tables)], axis=1).astype(np.int64)

    def probes(self, v: np.ndarray, n: int) -> np.ndarray:
        """(row, table, n): the buckets that cost least, the cheapest first (-1: there are no more)."""
        out = np.full((len(v), self.tables, n), -1, np.int64)
        for t in range(self.tables):
            y = self.axes(v, t)
            cost = (y.max(axis=2, keepdims=True) - y) ** 2
            total, code = np.zeros((len(v), 1)), np.zeros((len(v), 1), np.int64)
            for f in range(self.depth):
                near = np.argsort(cost[:, f], axis=1, kind="stable")[:, :n]
                total = (total[:, :, None] + np.take_along_axis(cost[:, f], near, 1)[:, None, :]).reshape(len(v), -1)
                code = (code[:, :, None] + near[:, None, :] * (2 * self.size) ** f).reshape(len(v), -1)
                by = np.argsort(total, axis=1, kind="stable")[:, :n]
                total, code = np.take_along_axis(total, by, 1), np.take_along_axis(code, by, 1)
            out[:, t, :code.shape[1]] = code
        return out

    def place(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """(pair, table): how many buckets a query would probe before that of a vector."""
        out = np.zeros((len(q), self.tables), np.int64)
        for t in range(self.tables):
            y, home = self.axes(q, t), self.axes(v, t).argmax(axis=2)
            cost = (y.max(axis=2, keepdims=True) - y) ** 2
            for i in range(len(q)):
                own = sum(cost[i, f, home[i, f]] for f in range(self.depth))
                some = np.zeros(1)
                for f in range(self.depth - 1):
                    some = np.add.outer(some, cost[i, f]).ravel()
                out[i, t] = np.searchsorted(np.sort(cost[i, -1]), own - some, "left").sum()
        return out


def usable(vec: Column) -> Column:
    """No null or non-finite component, and not all of them zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _by_length(lists):
    """(rows, matrix) for each length of the lists."""
    sizes = lists.value_lengths().to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield rows, matrix(lists.take(pa.array(rows)))


def _coded(df: DataFrame, tables: int, depth: int) -> DataFrame:
    """``df`` (vec, ...) with codes, one per table."""
    def run(batches):
        made = {}
        for batch in batches:
            at = batch.schema.get_field_index("vec")
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for rows, v in _by_length(batch.column(at)):
                if v.shape[1] not in made:
                    made[v.shape[1]] = Polytopes(v.shape[1], tables, depth)
                codes[rows] = made[v.shape[1]].codes(v)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])
    return df.mapInArrow(run, df.limit(0).withColumn("codes", F.array(F.lit(0).cast("bigint"))).schema)


def _probed(df: DataFrame, tables: int, depth: int, n: int) -> DataFrame:
    """(qk, vec, t, code): a row for each bucket that a query looks into."""
    def run(batches):
        made = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for rows, v in _by_length(part.column(1)):
                    if v.shape[1] not in made:
                        made[v.shape[1]] = Polytopes(v.shape[1], tables, depth)
                    codes = made[v.shape[1]].probes(v, n)
                    row, t, p = np.nonzero(codes >= 0)
                    some = part.take(pa.array(rows[row]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(t.astype(np.int32)), pa.array(codes[row, t, p])],
                                                     ["qk", "vec", "t", "code"])
    kind = df.schema["vec"].dataType.simpleString()
    return df.select("qk", "vec").mapInArrow(run, f"qk bigint, vec {kind}, t int, code bigint")


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((c - q) ** 2).sum(axis=1))


def nearest_rows(q: np.ndarray, c: np.ndarray, k: int):
    """For each row of ``q`` (rows of ``c``, exact distances) of its ``k`` nearest and all ties.
    A product of matrices leaves few rows to measure exactly."""
    size = (c * c).sum(axis=1)
    for at in range(0, len(q), 128):
        part = q[at:at + 128]
        with np.errstate(over="ignore", invalid="ignore"):
            own = (part * part).sum(axis=1)
            rough = own[:, None] + size[None, :] - 2 * part @ c.T
            slack = 1e-9 * (own[:, None] + size.max(initial=0))
        for i, x in enumerate(part):
            if len(c) <= k or not np.isfinite(rough[i]).all():
                pick = np.arange(len(c))
            else:
                pick = np.flatnonzero(rough[i] <= np.partition(rough[i], k - 1)[k - 1] + slack[i])
            yield pick, _distances(x, c[pick])


def fitted_probes(vectors: DataFrame, queries: DataFrame, tables: int, depth: int, k: int, sample: int = SAMPLE,
                  target: float = TARGET) -> int:
    """The least number of probes a table that finds ``target`` of the true neighbours of
    ``sample`` queries, chosen by a hash of the vector."""
    some = queries.orderBy(F.xxhash64("vec"), "qk").limit(sample).select("vec").toArrow().column(0).combine_chunks()
    if not len(some):
        return 1
    groups = [matrix(some.take(pa.array(rows))) for rows, _ in _by_length(some)]

    def run(batches):
        best = [[(np.zeros(0), np.zeros((0, g.shape[1])))] * len(g) for g in groups]
        for batch in batches:
            for rows, v in _by_length(batch.column(0)):
                for g, kept in zip(groups, best):
                    if g.shape[1] == v.shape[1]:
                        for i, (pick, d) in enumerate(nearest_rows(g, v, k + 1)):
                            pick, d = pick[d > 0], d[d > 0]
                            d, w = np.concatenate([kept[i][0], d]), np.concatenate([kept[i][1], v[pick]])
                            by = np.argsort(d, kind="stable")[:k]
                            kept[i] = (d[by], w[by])
        out = [(a, i, float(d), w.tolist()) for a, kept in enumerate(best) for i, (ds, ws) in enumerate(kept) for d, w in zip(ds, ws)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["a", "i", "d", "near"])
    found = vectors.select("vec").mapInArrow(run, "a int, i int, d double, near array<double>")
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("a", "i").orderBy("d"))).where(F.col("r") <= k).collect()
    if not near:
        return 1
    places = []
    for a, g in enumerate(groups):
        own = [r for r in near if r.a == a]
        if own:
            places.append(Polytopes(g.shape[1], tables, depth).place(g[[r.i for r in own]], np.array([r.near for r in own])).min(axis=1))
    places = np.sort(np.concatenate(places))
    return int(places[max(0, int(np.ceil(target * len(places))) - 1)]) + 1


def _best_of_block(k: int):
    def run(cand: pa.Table, probing: pa.Table) -> pa.Table:
        ids, vec = cand.column("ids").combine_chunks(), matrix(cand.column("vec").combine_chunks())
        off, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        qk, score, near = [], [], []
        for key, (pick, d) in zip(probing.column("qk").to_pylist(), nearest_rows(matrix(probing.column("vec").combine_chunks()), vec, k)):
            n = off[pick + 1] - off[pick]
            i = np.concatenate([flat[off[p]:off[p + 1]] for p in pick])
            d = np.repeat(d, n)
            by = np.lexsort((i, d))[:k]
            qk.append(np.full(len(by), key)), score.append(d[by]), near.append(i[by])
        cat = [np.concatenate(x) if x else np.zeros(0) for x in (qk, score, near)]
        return pa.table({"qk": cat[0].astype(np.int64), "score": cat[1].astype(np.float64), "vec_id": cat[2].astype(np.int64)})
    return run


def nearest_neighbours(df: DataFrame, query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES,
                       probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row where ``query``
    (a condition on ``id``) holds."""
    vec = F.col(f"`{vec_col}`")
    if df.schema[vec_col].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))  # -0.0 is 0.0
    rows = rows.groupBy("vec", "id").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    vectors = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = stored(vectors, "vectors")
    asked = rows.where(query).select(F.col("id").alias("query_id"), "vec")
    queries = stored(asked.select("vec").distinct().withColumn("qk", F.monotonically_increasing_id()), "queries")
    asked = asked.join(queries, "vec").select("query_id", "qk")

    n = vectors.count()
    dim = vectors.agg(F.max(F.size("vec"))).first()[0] or 1
    axes = 2 << (dim - 1).bit_length()
    depth = min(3, max(1, round(np.log(max(n, 1) / BUCKET) / np.log(axes))))
    probes = probes or fitted_probes(vectors, queries, tables, depth, k)

    coded = stored(_coded(vectors, tables, depth), "codes")
    cand = coded.select("vec", "ids", F.size("vec").alias("dim"), F.posexplode("codes").alias("t", "code"))
    probing = stored(_probed(queries, tables, depth, probes), "probes").withColumn("dim", F.size("vec"))
    bucket = ["dim", "t", "code"]
    sizes = coded.select(F.size("vec").alias("dim"), F.posexplode("codes").alias("t", "code")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")) \
        .join(probing.groupBy(*bucket).agg(F.count(F.lit(1)).alias("q")), bucket) \
        .select(*bucket, F.ceil(F.col("c") / block).cast("int").alias("cs"), F.ceil(F.col("q") / block).cast("int").alias("qs"))
    sizes = stored(sizes, "sizes")
    cand = cand.join(sizes, bucket).withColumn("cb", F.pmod(F.xxhash64("vec"), "cs").cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select(*bucket, "cb", "qb", "vec", "ids")
    probing = probing.join(sizes, bucket).withColumn("qb", F.pmod(F.xxhash64("qk"), "qs").cast("int")) \
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))).select(*bucket, "cb", "qb", "vec", "qk")
    keys = [*bucket, "cb", "qb"]
    found = cand.groupBy(*keys).cogroup(probing.groupBy(*keys)).applyInArrow(_best_of_block(k + 1), "qk bigint, score double, vec_id bigint")
    # a vector is found in several tables, and is measured alike in each
    found = found.groupBy("qk", "score", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("qk").orderBy("score", "vec_id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1) \
        .groupBy("qk").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    out = asked.join(best, "qk")
    out = out.withColumn("near", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return out.select("query_id", F.posexplode("near").alias("__at", "x")).select(
        "query_id", (F.col("__at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
