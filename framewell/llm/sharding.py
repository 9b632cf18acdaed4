"""Rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

Every shard draws a number from (key, shard name); the largest weighted draw owns the
record. A draw doesn't depend on the other shards, so one more shard takes records only
into itself and no record moves between two old ones.

Slots number a shard's records from 0 without gaps. Equal records are counted before the
shuffle, so a record repeated a billion times is one row until the slots are laid out;
places within a shard come from running sums over fixed hash buckets, never from a
window over a whole shard.

Defined results: a null key is a key of its own; null text has size 1 and the checksum of
nothing; equal rows get different, adjacent slots; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a shard whose totals are summed in one small table.
BUCKETS = 1024
#: Slots of a repeated row that are laid out by one array.
RUN = 65_536


def draw(key: Column, shard: str, weight: float = 1.0) -> Column:
    """The weighted draw of one shard: -w / ln(u), u in (0, 1) from md5 of key and shard."""
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("\x00")), F.lit(f"\x1f{shard}"))), 1, 13), 16, 10).cast("double")
    return -weight / F.log((h + 0.5) / float(1 << 52))


def owner(key: Column, shards: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Place in ``shards`` of the key's owner; the earlier of equal draws."""
    w = list(weights or [1.0] * len(shards))
    if len(w) != len(shards) or not shards or min(w) <= 0 or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names and a positive weight each")
    best = F.array_max(F.array(*[F.struct(draw(key, s, x).alias("d"), F.lit(-i).alias("i")) for i, (s, x) in enumerate(zip(shards, w, strict=True))]))
    return -best["i"]


def slots(df: DataFrame, shard_col: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: the place of each row in its shard, 0, 1, 2 and on.

    Rows equal in ``shard_col`` and ``order`` are counted first; other columns are dropped.
    """
    rows = df.groupBy(shard_col, *order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    totals = rows.groupBy(shard_col, "_b").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(shard_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(shard_col).alias("_s"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(shard_col, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    # at most shards x BUCKETS rows
    joined = placed.join(F.broadcast(base), (F.col(shard_col).eqNullSafe(F.col("_s"))) & (F.col("_b") == F.col("_bb")))
    first = F.col("_base") + F.col("_in")
    # runs first, then the slots of a run, so that no array grows with the copies of a row
    runs = joined.select(shard_col, *order, "_n", first.alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN))).alias("_run"))
    lo = F.col("_run") * RUN
    return runs.withColumn("slot", F.explode(F.sequence(F.col("_first") + lo, F.col("_first") + F.least(lo + RUN, "_n") - 1))).select(shard_col, *order, "slot")


def shard(docs: DataFrame, count: int = 8, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; law is always ``key``."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    names = [f"shard-{i}" for i in range(count + 1)]
    w = list(weights or [1.0] * count)
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), owner(F.col(id_col), names[:count], w).cast("int").alias("shard"))
    out = slots(rows, "shard", [id_col, "size", "text_crc32"])
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), owner(F.col(id_col), names, [*w, sum(w) / count]).cast("int").alias("grown_shard"))
