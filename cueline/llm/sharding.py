"""Consistent sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, derived
from two digests of its name. The shards take turns and claim their next free slot
until the table is full. A row's key digest picks a slot, so placement is one
broadcast hash-join probe per row, without a shuffle; adding or losing a shard moves
few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.common import private, without

SHARDS = 32
TABLE_SIZE = 4099
#: The table is broadcast; this bounds it to a few MB whatever the data's size.
MAX_TABLE_SIZE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def slot_of(key: Column, table_size: int) -> Column:
    """Slot of a key: 60 bits of its MD5, modulo the table size. Null keys hash as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(table_size)


def fill_table(spark: SparkSession, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table: (slot, shard), one row for each of ``table_size`` slots.

    Turns are sequential by definition; the table has a fixed size that doesn't depend
    on the data, so its at most ``MAX_TABLE_SIZE`` claims are made here once.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need to be distinct names, one at least")
    if not _is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError(f"table_size has to be a prime from the number of shards to {MAX_TABLE_SIZE}")
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "turn int, name string")
    starts = names.select(
        "turn",
        slot_of(F.concat(F.lit("offset:"), "name"), table_size).alias("offset"),
        (slot_of(F.concat(F.lit("skip:"), "name"), table_size - 1) + 1).alias("skip"),
    ).orderBy("turn").collect()
    owner = [-1] * table_size
    at = [r.offset for r in starts]
    free, turn = table_size, 0
    while free:
        slot, skip = at[turn], starts[turn].skip
        while owner[slot] >= 0:
            slot = (slot + skip) % table_size
        owner[slot] = turn
        at[turn] = (slot + skip) % table_size
        free -= 1
        turn = (turn + 1) % len(shards)
    rows = [(slot, shards[i]) for slot, i in enumerate(owner)]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def assign_shards(df: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """Append ``slot`` and ``shard`` to every row of ``df``, by its ``key``.

    Null keys go where the empty text goes; equal keys go to one shard, so give a key
    that is near unique (a document id) where one value may hold many rows. Input
    columns named slot or shard are replaced. An empty table stays empty.
    """
    table = fill_table(df.sparkSession, shards, table_size)
    own = private(df)
    rows = without(df.withColumn(own, slot_of(F.col(f"`{key}`"), table_size)), ["slot", "shard"])
    kept = [f"`{c}`" for c in rows.columns if c != own]
    slots = rows.select(*kept, F.col(own).alias("slot"))
    return slots.join(F.broadcast(table), "slot", "left").select(*kept, "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]
