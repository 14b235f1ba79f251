"""Pairs of two tables whose values are formed and summed as matrices, piece by piece: the rows of
the product, by far more than those of both sides, are never laid out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import Texts
from ._util import as_list, dealt_pieces

#: Rows of both sides that a piece has at most, and rows of the first that it has at least.
PIECE_A, PIECE_B, LEAST_A = 20_000, 4_000, 500
#: Pairs that a task works on at once, and sums that it returns at once.
PAIRS, OUT_ROWS = 2**19, 100_000


class _Side:
    """Columns of one side of a piece, numbers as a column or a row of the matrix of pairs."""

    def __init__(self, rows: pa.StructArray, shape: tuple):
        self.rows, self.shape, self._found = rows, shape, {}

    def __getitem__(self, name: str):
        if name not in self._found:
            col = self.rows.field(name)
            self._found[name] = Texts.of(col) if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) \
                else col.to_numpy(zero_copy_only=False).astype(float).reshape(self.shape)
        return self._found[name]


@dataclass
class Product:
    """Every row of ``a`` with every row of ``b`` of the same ``by`` and the ``values`` of a pair, in
    turn: a name and a function of both sides' columns and the values so far, all of a piece at once
    (rows of a by rows of b). Null numbers are NaN there, texts are bytes without nulls."""

    a: DataFrame
    b: DataFrame
    by: list
    values: tuple = ()

    def with_value(self, name: str, run: Callable, a: dict[str, Column] | None = None, b: dict[str, Column] | None = None) -> "Product":
        """One more value of each pair; ``a`` and ``b`` are columns that it needs on the sides."""
        return replace(self, a=self.a.withColumns(a or {}), b=self.b.withColumns(b or {}), values=(*self.values, (name, run)))

    def sums(self, points, group: str, value: str) -> DataFrame:
        """Sums of ``value`` over the pairs of a point of ``b`` (its columns ``points``) and a
        ``group`` of ``a``, by piece: several rows a point and group, to be summed again. Pairs
        without the value count for nothing; a sum of such alone is null."""
        points = as_list(points)
        workers = int(self.a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x, y, keys = dealt_pieces(self.a, self.b, self.by, lambda n: min(max(-(-n // (4 * workers)), LEAST_A), PIECE_A), PIECE_B)
        packed = lambda d, own, name: d.groupBy(*keys).agg(F.collect_list(F.struct(*own)).alias(name))
        plain = lambda d: [F.col(f"`{c}`").cast("double").alias(c) if isinstance(d.schema[c].dataType, T.NumericType) and c not in (group, *points)
                           else F.col(f"`{c}`") for c in d.columns if c not in keys]
        pieces = packed(x, [*plain(x), F.col(f"`{group}`").alias("__group")], "__a").join(
            packed(y, [*plain(y), *[F.col(f"`{c}`").alias(f"__point{i}") for i, c in enumerate(points)]], "__b"), keys)
        schema = T.StructType([*[T.StructField(f"__point{i}", self.b.schema[c].dataType) for i, c in enumerate(points)],
                               T.StructField("__group", self.a.schema[group].dataType), T.StructField("__sum", T.DoubleType())])
        out = pieces.select("__a", "__b").mapInArrow(_sums_of_pieces(self.values, value, len(points)), schema)
        names = [*points, group, value]
        return out.select(*[F.col(c).alias(n) for c, n in zip(schema.names, names, strict=True)])


def _sums_of_pieces(values: tuple, value: str, n_points: int):
    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("__a"), batch.column("__b"), strict=True):
                yield from _sums(a.values, b.values, values, value, n_points)
    return run


def _sums(a: pa.StructArray, b: pa.StructArray, values: tuple, value: str, n_points: int) -> Iterator[pa.RecordBatch]:
    """The sums of a piece, a group after the other: what a task holds does not grow with them."""
    code = a.field("__group").dictionary_encode(null_encoding="encode")
    groups, code = code.dictionary, code.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    a, code = a.take(pa.array(order)), code[order]
    right = _Side(b, (1, len(b)))
    points = [b.field(f"__point{i}") for i in range(n_points)]
    names = [*(f"__point{i}" for i in range(n_points)), "__group", "__sum"]

    def batch(found, sums):
        every, n = np.tile(np.arange(len(b)), len(found)), len(found)
        at = [p.take(pa.array(every)) for p in points]
        total, has = np.array(sums).reshape(2 * n, -1)[0::2].ravel(), np.array(sums).reshape(2 * n, -1)[1::2].ravel()
        return pa.RecordBatch.from_arrays([*at, groups.take(pa.array(np.repeat(found, len(b)))), pa.array(total, mask=has == 0)], names)

    found, sums = [], []
    step = max(1, PAIRS // len(b))
    for lo in range(0, len(a), step):
        part = code[lo:lo + step]
        left, got = _Side(a.slice(lo, step), (len(part), 1)), {}
        for name, form in values:
            got[name] = form(left, right, got)
        m = np.broadcast_to(got[value], (len(part), len(b)))
        none = np.isnan(m)
        some = none.any()
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        total = np.add.reduceat(np.where(none, 0.0, m) if some else m, starts, axis=0)
        has = np.add.reduceat(~none, starts, axis=0, dtype=np.int64) if some else np.repeat(np.diff(starts, append=len(part))[:, None], len(b), axis=1)
        for i, g in enumerate(part[starts]):
            if found and found[-1] == g:
                sums[-1][0] += total[i]
                sums[-1][1] += has[i]
                continue
            if len(found) * len(b) >= OUT_ROWS:
                yield batch(found, sums)
                found, sums = [], []
            found.append(g)
            sums.append([total[i].copy(), has[i].copy()])
    if found:
        yield batch(found, sums)
