"""A matrix of two key lists with an implicit zero: counts, codes and statistics come from the
rows that are there and from the lists; the product of the lists is only formed as a result."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ._util import MAX_PIECE_TASKS, as_list, prefix_sum

#: Row keys packed in one array.
PACK = 4096
#: Columns that one piece of the product takes.
COLUMNS = 256


@dataclass
class SparseTable:
    """``cells`` (row, col, value) without zeros; ``rows`` and ``cols`` list the keys of both
    sides, each with any columns of its own. Null keys are no part of the matrix."""

    cells: DataFrame
    rows: DataFrame
    cols: DataFrame
    row: str
    col: str
    value: str

    @staticmethod
    def of(df: DataFrame, row: str, col: str, value: str, row_attrs=(), zeros: bool = False) -> "SparseTable":
        """From a long table, which is read once. Cells are its rows above zero, or with
        ``zeros`` all its rows; the lists have every key, also those without cells."""
        ensure_checkpoint_dir(df.sparkSession)
        x = df.select(row, *as_list(row_attrs), col, value).where(F.col(row).isNotNull() & F.col(col).isNotNull()).checkpoint()
        cells = x if zeros else x.where(F.col(value) > 0)
        return SparseTable(cells.select(row, col, value), x.select(row, *as_list(row_attrs)).distinct(), x.select(col).distinct(), row, col, value)

    def presence(self, name: str = "presence") -> "SparseTable":
        """The same matrix with 1 in its cells."""
        return replace(self, cells=self.cells.select(self.row, self.col).distinct().withColumn(name, F.lit(1)), value=name)

    def keep_cols(self, cols: DataFrame) -> "SparseTable":
        return replace(self, cols=cols, cells=self.cells.join(cols.select(self.col), self.col, "left_semi"))

    def keep_rows(self, rows: DataFrame) -> "SparseTable":
        return replace(self, rows=rows, cells=self.cells.join(rows.select(self.row), self.row, "left_semi"))

    def prevalent(self, lo: int, hi: int) -> "SparseTable":
        """Columns present in strictly more than ``lo`` and fewer than ``hi`` rows, from the cells."""
        n = self.cells.groupBy(self.col).agg(F.count_distinct(self.row).alias("__n"))
        n = self.cols.join(n, self.col, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
        return self.keep_cols(n.where((F.col("__n") > lo) & (F.col("__n") < hi)).drop("__n").checkpoint())

    def coded(self, row_code: str, col_code: str) -> "SparseTable":
        """Both lists with integer codes 1..k in key order."""
        return replace(self, rows=_coded(self.rows, self.row, row_code), cols=_coded(self.cols, self.col, col_code))

    def dense(self, default=0) -> DataFrame:
        """Every (row, col) with both lists' columns and the value, ``default`` where there is no
        cell. The row keys are packed in blocks; a column's missing keys of a block are the
        block less the keys of its cells there, so no cell is compared with the product. The
        blocks are dealt to tasks by their number: their bytes say nothing of the rows to come."""
        spark = self.rows.sparkSession
        ensure_checkpoint_dir(spark)
        rows, cols = self.rows.checkpoint(), self.cols.checkpoint()
        n = max(1, math.ceil(rows.count() / PACK))
        m = max(1, math.ceil(cols.count() / COLUMNS))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4 * n * m, MAX_PIECE_TASKS))
        r, c = [x for x in rows.columns if x != self.row], [x for x in cols.columns if x != self.col]
        blk = F.pmod(F.xxhash64(self.row), F.lit(n)).alias("__blk")
        own = F.struct(self.row, *r)
        there = self.cells.join(rows, self.row).join(cols, self.col)
        packed = rows.select(blk, own.alias("__r")).groupBy("__blk").agg(F.collect_list("__r").alias("__all")) \
            .withColumn("__cb", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).repartition(tasks, "__cb", "__blk")
        every = cols.withColumn("__cb", F.pmod(F.xxhash64(self.col), F.lit(m)).cast("int")) \
            .withColumn("__blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        has = there.select(self.col, blk, own.alias("__r")).groupBy(self.col, "__blk").agg(F.collect_set("__r").alias("__has"))
        # a column's cells of a block first, then the block: the packed keys are not shuffled again
        every = every.join(has, [self.col, "__blk"], "left").repartition(tasks, "__cb", "__blk").join(packed, ["__cb", "__blk"])
        none = F.coalesce(F.array_except("__all", "__has"), F.col("__all"))
        zero = every.select(self.col, *c, F.explode(none).alias("__r")).select("__r.*", self.col, *c, F.lit(default).alias(self.value))
        names = [self.row, *r, self.col, *c, self.value]
        kind = there.schema[self.value].dataType
        return there.select(*names).unionByName(zero.select(*names[:-1], F.col(self.value).cast(kind).alias(self.value)))


def _coded(keys: DataFrame, key: str, code: str) -> DataFrame:
    p = prefix_sum(keys.select(key).distinct().withColumn("__one", F.lit(1)), [], [key], "__one", "__p")
    return keys.join(p.select(key, (F.col("__p") + 1).cast("int").alias(code)), key)
