"""Operator 2: consistent placement of rows on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Slots per shard at least: loads then differ by about a hundredth.
SLOTS_PER_SHARD = 100
# The table is broadcast; this bounds it to a few megabytes.
MOST_SLOTS = 200_003


def _prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], slots: int | None = None) -> list[int]:
    """The shard (by its place in ``shards``) that owns each slot.

    Every shard prefers the slots in an order of its own, ``offset + j * skip``
    modulo a prime, so in a permutation of all slots. The shards take turns, and
    each claims the first slot of its order that is still free, until none is.
    Sizes differ by one slot at most, and a shard more or less moves few slots.
    The work is that of the table, whatever the data.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    slots = _prime_from(slots or SLOTS_PER_SHARD * len(shards))
    if slots > MOST_SLOTS:
        raise ValueError(f"{slots} slots are more than the {MOST_SLOTS} that may be broadcast")
    place = [_number(f"offset|{s}") % slots for s in shards]
    skip = [_number(f"skip|{s}") % (slots - 1) + 1 for s in shards]
    owners, claimed = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            while owners[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            owners[place[shard]] = shard
            claimed += 1
            if claimed == slots:
                return owners


def lookup_frame(spark: SparkSession, shards: Sequence[str], slots: int | None = None) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*(F.lit(s) for s in shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), names[F.col("owner").cast("int")].alias("shard"))


def slot_of(keys: Sequence[Column], slots: int) -> Column:
    """The slot of a row: its keys' hash modulo the table's size. NULL counts as the empty text."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, shards: Sequence[str], *keys: str, slots: int | None = None) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row; columns of these names are replaced.

    Equal keys go to one shard, so choose a key that no value dominates (an id, or
    an id and a chunk number): repeated rows with one key stay together. NULL keys
    are placed like empty text. An empty table gives an empty result.

    One broadcast join with a table whose size is bounded; no shuffle, no Python.
    """
    table = lookup_frame(rows.sparkSession, shards, slots)
    count = _prime_from(slots or SLOTS_PER_SHARD * len(shards))
    plain = rows.drop("slot", "shard")
    return plain.withColumn("slot", slot_of([plain[k] for k in keys], count)).join(F.broadcast(table), "slot")


def shard_loads(placed: DataFrame, size: str | None = None) -> DataFrame:
    """Rows (and the sum of a size) per shard; combined before the shuffle."""
    sums = [F.sum(size).alias("total_size")] if size else []
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *sums)
