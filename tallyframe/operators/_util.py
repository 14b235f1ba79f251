"""Shared building blocks for the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, (str, Column)) else list(x)


def with_group_agg(df: DataFrame, keys, how: str = "window", **aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    ``window`` (default) computes them with an unordered window: one shuffle on the
    keys and a single pass over ``df``. The operators call it on tables that are
    already aggregated to one row per (group, other key) -- e.g. (sample, feature)
    after summing reads -- so a group holds at most as many rows as there are
    distinct other keys, not a share of the raw rows.

    ``join`` computes a grouped aggregate (combined map-side) and joins it back; AQE
    broadcasts the small per-group table and splits hot groups with its skew-join
    handling. Use it on raw, unaggregated rows; it evaluates ``df`` twice.
    Group keys must be non-null for ``join``.
    """
    keys = as_list(keys)
    if how == "join":
        g = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
        return df.join(g, keys)
    w = Window.partitionBy(*keys)
    return df.withColumns({n: e.over(w) for n, e in aggs.items()})


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(dfs))


def round_half_away(c, digits: int = 6):
    """Round as ``round(x * 10^d) / 10^d`` in double arithmetic (half away from zero),
    the same rule SQL engines such as DuckDB use for doubles, so printed results agree."""
    p = float(10 ** digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") * p, 0) / p


def round_cols(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: round_half_away(c, digits) for c in as_list(cols)})


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. Counted on the executors with an
    early stop (``limit``); no rows come to the driver."""
    return df.limit(max_rows + 1).count() <= max_rows


#: Rows up to which a list of keys or group totals is broadcast.
SMALL_ROWS = 200_000


def small_list(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` evaluated once into the checkpoint folder, to be broadcast when it is small: the
    table it meets is then not shuffled."""
    from ..session import stored
    t = stored(df, "list")
    return F.broadcast(t) if is_small(t, max_rows) else t


def with_group_total(df: DataFrame, keys, to: DataFrame | None = None, max_rows: int = SMALL_ROWS, **aggs: Column) -> DataFrame:
    """``with_group_agg`` for few large groups (samples): the aggregates are formed first, combined
    map-side, and broadcast, so ``df`` is neither shuffled nor sorted; it is evaluated twice. More
    than ``max_rows`` groups take the window, or a join where the aggregates go ``to`` another
    table of the same keys. Null keys are a group, as in a window."""
    from ..session import stored
    keys = as_list(keys)
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    g = stored(df.groupBy(*[F.col(k).alias(c) for k, c in named.items()]).agg(*[e.alias(n) for n, e in aggs.items()]), "totals")
    small = is_small(g, max_rows)
    if not small and to is None:
        return with_group_agg(df, keys, **aggs)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(c)) for k, c in named.items()])
    return (df if to is None else to).join(F.broadcast(g) if small else g, same).drop(*named.values())


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to as many tasks as the session shuffles to, before work that makes many
    rows of one (a small table is read by a task or two)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def prefix_sum(df: DataFrame, keys, order, value: str, out: str = "prefix",
               partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` in ``order``, without
    putting a whole key into one task.

    Rows are range-partitioned on (keys, order) -- equal sort keys land in the same
    partition -- and sorted within partitions; each partition computes local running
    sums (Arrow batches, in order), and every (partition, key) is shifted by the
    totals of the earlier partitions of the same key (a table of partitions x keys).
    """
    import pandas as pd
    from pyspark.sql import types as T

    from ..session import ensure_checkpoint_dir
    keys, order = as_list(keys), as_list(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType(list(df.schema.fields) + [T.StructField("__pid", T.IntegerType()),
                                                    T.StructField("__local", T.DoubleType())])

    def local(it):
        import numpy as np
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last_key, last_total = None, 0.0   # rows of one key are contiguous (sorted)
        for pdf in it:
            if len(pdf) == 0:
                continue
            v = pdf[value].astype(float).fillna(0.0)
            if keys:
                grp = [pdf[k] for k in keys]
                incl = v.groupby(grp, sort=False, dropna=False).cumsum().to_numpy()
                same = np.ones(len(pdf), bool)
                if last_key is None:
                    same[:] = False
                else:
                    for k, lv in zip(keys, last_key):
                        col = pdf[k]
                        same &= (col == lv).to_numpy() | (col.isna().to_numpy() & (lv is None))
                tail = tuple(None if pd.isna(pdf[k].iloc[-1]) else pdf[k].iloc[-1] for k in keys)
            else:
                incl = v.cumsum().to_numpy()
                same = np.full(len(pdf), last_key is not None)
                tail = ()
            start = np.where(same, last_total, 0.0)
            pdf["__pid"] = pid
            pdf["__local"] = start + incl - v.to_numpy()
            last_total = float(start[-1] + incl[-1])
            last_key = tail
            yield pdf

    # Two reads follow (totals and rows). The range bounds are sampled anew whenever the plan
    # runs again, so the numbered rows are written once and both read the same copy.
    ensure_checkpoint_dir(spark)
    loc = r.mapInPandas(local, schema).checkpoint()
    tot = loc.groupBy("__pid", *keys).agg(F.sum(value).cast("double").alias("__t"))
    # partitions x keys rows; with no keys this is one row per partition
    w = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("__off", F.coalesce(F.sum("__t").over(w), F.lit(0.0))).drop("__t")
    j = loc.join(off, ["__pid", *keys], "left")
    return j.withColumn(out, F.col("__local") + F.coalesce(F.col("__off"), F.lit(0.0))) \
        .drop("__pid", "__local", "__off")


#: Most tasks that the pieces of a product are dealt to.
MAX_PIECE_TASKS = 2000


def dealt_pieces(a: DataFrame, b: DataFrame, by, rows_a, rows_b: int) -> tuple[DataFrame, DataFrame, list]:
    """Both sides of a product in pieces of about ``rows_a`` times ``rows_b``, and the columns that
    name a piece: each side is cut into blocks by a hash of its rows and goes to the blocks of the
    other. ``rows_a`` may follow from the number of rows of ``a`` that have a partner. The number
    of tasks follows the pieces: both sides are few bytes, and partitions made by their size would
    put all pieces into one. Both sides are read twice (sizes, rows)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(a.sparkSession)
    count = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    size = count(a, "__na").join(count(b, "__nb"), by).checkpoint()
    if callable(rows_a):
        rows_a = rows_a(size.agg(F.sum("__na")).first()[0] or 0)
    blocks = lambda name, rows: F.ceil(F.col(name) / rows).cast("int").alias(name)
    size = size.select(*by, blocks("__na", rows_a), blocks("__nb", rows_b))
    total = size.agg(F.sum(F.col("__na").cast("bigint") * F.col("__nb"))).first()[0] or 1
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * total, MAX_PIECE_TASKS))
    own = lambda d, n, name: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in d.columns]), F.col(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    x = a.join(size, by).select(*a.columns, own(a, "__na", "__x"), every("__nb", "__y"))
    y = b.join(size, by).select(*b.columns, own(b, "__nb", "__y"), every("__na", "__x"))
    keys = [*by, "__x", "__y"]
    return x.repartition(tasks, *keys), y.repartition(tasks, *keys), keys


def product_by(a: DataFrame, b: DataFrame, by, rows: int = 1000, laid_out: bool = True):
    """Every row of ``a`` with every row of ``b`` of the same ``by``, in pieces of about ``rows``
    times ``rows``, so a few large keys make many even tasks. Null keys match nothing. Without
    ``laid_out`` the result is a ``Product``, whose pairs never become rows."""
    by = as_list(by)
    if not laid_out:
        from .product import Product
        return Product(a, b, by)
    x, y, keys = dealt_pieces(a, b, by, rows, rows)
    return x.join(y, keys).drop("__x", "__y")
