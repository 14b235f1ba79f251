"""Op 2. Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand in key
order; their running word count decides how often each is taken: a source whose budget is
``k`` full epochs and a rest takes every document ``k`` times and, in key order, once more
until the rest is used up (the last one in part). Key ranges (the top bits of the key)
split a source into pieces; a small table of (source, range) totals gives each piece the
words before it, so no task ever holds a whole source and a source with a third of all
rows is spread like any other.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share ``share``
of all words; no target exceeds ``most`` times its source's size, the excess going to the
others by weight (closed form: sources in order of cap / weight are capped as long as the
common level reaches them).

Defined results: a null text has size 0 and is never taken; a null source is a source of
its own; a null id has a fixed key; rows that repeat an id stand side by side in key order
(then by size and text hash); an empty table gives an empty result; columns that already
bear an output name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
RANGE_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"
OUT = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_key(key: Column) -> Column:
    """60 bits of an md5 digest: the same in every engine, whatever the partitioning."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("__w", w).withColumn("__cap", F.col("source_size").cast("double") * most)
    t = t.withColumn("__ratio", F.col("__cap") / F.col("__w")) \
        .withColumn("__all", F.sum("source_size").over(every).cast("double") * share)
    order = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("__capped", (F.col("__all") - before) / rest >= F.col("__ratio"))
    used = F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(every)
    return t.withColumn("__used", used).withColumn("__open", open_w).select(
        "source", "source_size",
        F.when(F.col("__capped"), F.col("__cap"))
         .otherwise((F.col("__all") - F.col("__used")) / F.col("__open") * F.col("__w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=WEIGHTS, share: float = 1.5, most: int = 2, range_bits: int = RANGE_BITS) -> DataFrame:
    """``docs`` with size, source_size, target (the source's) and taken (words)."""
    kept = [c for c in docs.columns if c.lower() not in OUT]
    names = {c: f"__in{i}" for i, c in enumerate(kept)}  # no clash with columns of the mix
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    at = {c.lower(): n for c, n in names.items()}
    id_col, text_col, source_col = (at[c.lower()] for c in (id_col, text_col, source_col))
    d = d.withColumn("size", word_count(F.col(f"`{text_col}`"))) \
        .withColumn("__key", hash_key(F.col(f"`{id_col}`"))) \
        .withColumn("__range", F.shiftright("__key", 60 - range_bits)) \
        .withColumn("__tie", F.xxhash64(F.col(f"`{text_col}`")))
    src = F.col(f"`{source_col}`")
    pieces = d.groupBy(src.alias("__src"), F.col("__range").alias("__piece")).agg(F.sum("size").alias("__words"))
    targets = source_targets(pieces.groupBy(F.col("__src").alias("source")).agg(F.sum("__words").alias("source_size")),
                             weights, share, most)
    earlier = Window.partitionBy("__src").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__before", F.coalesce(F.sum("__words").over(earlier), F.lit(0))).drop("__words")
    pieces = pieces.join(targets, pieces["__src"].eqNullSafe(targets["source"])).drop("source")
    within = Window.partitionBy(src, "__range").orderBy("__key", id_col, "size", "__tie") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__upto", F.sum("size").over(within))
    d = d.join(pieces, src.eqNullSafe(F.col("__src")) & (F.col("__range") == F.col("__piece")))
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    d = d.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint"))
    rest = budget - F.col("__epochs") * F.col("source_size")
    first = F.col("__before") + F.col("__upto") - F.col("size")
    once = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - first))
    return d.select(*[F.col(n).alias(c) for c, n in names.items()], "size", "source_size", "target",
                    (F.col("__epochs") * F.col("size") + once).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **how) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as whole copies of it are taken (a
    document taken in part counts when half of it or more is taken)."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}  # no clash with columns of the mix
    m = mix_sources(docs.toDF(*names.values()), names[id_col], names[text_col], names[source_col], **how)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return m.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))) \
        .select(*[F.col(n).alias(c) for c, n in names.items()])
