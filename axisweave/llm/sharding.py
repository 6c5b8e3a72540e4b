"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

The published generator is a 64-bit linear congruential step. Spark's ANSI arithmetic raises on overflow, so
the state is held in three limbs of 21, 21 and 22 bits, whose products stay below 2^63.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axisweave.llm.common import store

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
LOW, HIGH = (1 << 21) - 1, (1 << 22) - 1
M0, M1, M2 = MULTIPLIER & LOW, MULTIPLIER >> 21 & LOW, MULTIPLIER >> 42


def _jump(state: Column) -> Column:
    """One jump: state is (k0, k1, k2, b, j); where j is still a valid shard it becomes b and the next j is drawn."""
    k0, k1, k2 = state["k0"], state["k1"], state["k2"]
    p0 = k0 * F.lit(M0) + F.lit(1)
    p1 = k0 * F.lit(M1) + k1 * F.lit(M0) + F.shiftright(p0, 21)
    top_bit = (k1 * F.lit(M2) + k2 * F.lit(M1)).bitwiseAND(F.lit(1)) * F.lit(1 << 21)  # of the products at 2^63
    p2 = k0 * F.lit(M2) + k1 * F.lit(M1) + k2 * F.lit(M0) + F.shiftright(p1, 21) + top_bit
    n0, n1, n2 = p0.bitwiseAND(F.lit(LOW)), p1.bitwiseAND(F.lit(LOW)), p2.bitwiseAND(F.lit(HIGH))
    top = n2 * F.lit(512) + F.shiftright(n1, 12)
    j = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (top + F.lit(1)).cast("double")))
    return F.struct(n0.alias("k0"), n1.alias("k1"), n2.alias("k2"), state["j"].alias("b"), j.cast("long").alias("j"))


def _jumps(steps: int, n_shards: int):
    """A lambda for up to ``steps`` jumps, evaluated only for a state still jumping."""
    valid = lambda s: s["j"] < F.lit(n_shards)
    many = lambda s: F.aggregate(F.array_repeat(F.lit(0), steps), s, lambda t, _: F.when(valid(t), _jump(t)).otherwise(t))
    return lambda s: F.when(valid(s), many(s)).otherwise(s)


def jump_hash(key: Column, n_shards: int) -> Column:
    """The shard (0 .. n_shards-1) of a 64-bit key; the key's bits are read as unsigned.

    Each jump ends above where it began, so n_shards jumps suffice; about ln(n_shards) happen. They stand in blocks that
    double, each evaluated only for rows still jumping, so the cost follows the jumps, not n_shards. A null key counts as 0.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = F.struct(
        k.bitwiseAND(F.lit(LOW)).alias("k0"), F.shiftright(k, 21).bitwiseAND(F.lit(LOW)).alias("k1"), F.shiftrightunsigned(k, 42).alias("k2"),
        F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
    )
    done, block = 0, 16
    while done < n_shards:
        state = F.transform(F.array(state), _jumps(min(block, n_shards - done), n_shards))[0]
        done, block = done + block, block * 2
    return state["b"].cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", slot_blocks: int = 1024) -> DataFrame:
    """Law ``key``: shard = jump_hash(key, n_shards); grown_shard = the same with one more shard, which differs only for rows that move into it.

    Returns (key, size, text_crc32, law, shard, slot, grown_shard); size = UTF-8 bytes + 1. Slots are 0 .. n-1 in each shard:
    equal (key, size, crc) rows are counted before the shuffle, numbered in hashed blocks of a shard, and a block's first
    slot comes from a table of n_shards x slot_blocks counts. Raise slot_blocks with the rows a shard holds.

    Null text: size 1, crc 0 (as the empty text). Null keys: treated as key 0 for the shard. Repeated keys: same shard,
    separate slots. Other columns of docs are ignored; join them back by key.
    """
    bytes_ = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), (bytes_ + F.lit(1)).alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"))
    same = store(rows.groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")))  # read twice below: texts are hashed once
    same = same.withColumn("shard", jump_hash(F.col("_key"), n_shards)).withColumn("grown_shard", jump_hash(F.col("_key"), n_shards + 1))
    same = same.withColumn("_block", F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(slot_blocks)).cast("int"))
    counts = same.groupBy("shard", "_block").agg(F.sum("_n").alias("_n")).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_block", "_n"))).alias("_counts"))
    ahead = lambda i: F.aggregate(F.slice("_counts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
    starts = counts.select("shard", F.inline(F.transform("_counts", lambda x, i: F.struct(x["_block"].alias("_block"), ahead(i).alias("_first")))))
    order = Window.partitionBy("shard", "_block").orderBy("_key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0).cast("long")))
    placed = placed.join(F.broadcast(starts), ["shard", "_block"])  # n_shards x slot_blocks rows at most
    first = F.col("_first") + F.col("_before")
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("_n") - F.lit(1))).alias("slot"), "grown_shard",
    )
