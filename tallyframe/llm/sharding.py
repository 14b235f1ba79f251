"""Op 6. Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a
step from a hash of its name). Shards take turns: each claims the first slot of its
permutation that is still free, until the table is full, so shares differ by a slot at
most and adding or removing one shard moves few slots. A row's slot is a hash of its key
modulo the table size; the table, whose size is a parameter, is broadcast, so placing a
row is one lookup and needs no shuffle.

Defined results: a null key counts as the empty string and has one fixed slot; repeated
rows get equal places; an empty table gives an empty result; columns that already bear
the output names are replaced, other columns stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; a hundred slots a shard keep shares within one percent for up to 655 shards.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 2_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def claim_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot. ``size``: a prime, at most
    ``MAX_TABLE_SIZE``, no less than the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and not empty")
    if not len(shards) <= size <= MAX_TABLE_SIZE or any(size % k == 0 for k in range(2, int(size ** 0.5) + 1)):
        raise ValueError("size must be a prime between the number of shards and MAX_TABLE_SIZE")
    at = [_number(f"offset {s}") % size for s in shards]
    step = [_number(f"skip {s}") % (size - 1) + 1 if size > 1 else 1 for s in shards]
    owner = [-1] * size
    free, turn = size, 0
    while free:
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % size
        owner[at[i]] = i
        free -= 1
        turn += 1
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(size).cast("bigint")).cast("int")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
                  slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of every row."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(claim_table(shards, size))],
                                  f"`{slot_col}` int, `{shard_col}` string")
    slot = slot_of(F.col(f"`{key}`"), size)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    # the table has ``size`` rows whatever the data: a broadcast of a proven bound
    return df.select(*kept, slot.alias(slot_col)).join(F.broadcast(table), slot_col)
