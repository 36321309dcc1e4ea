"""References to records that do not exist.

A blocked Bloom filter of the parent keys, built and probed with built-in expressions, proves most broken references at
once; only references that pass it are joined exactly with the parents' periods of validity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotloom.functions.keys import clean_key

#: A block has 64 words of 64 bits; each key sets PROBES bits of one block.
BLOCK_BITS = 4096
PROBES = 5
BITS_PER_KEY = 12
#: Blocks up to which the filter is broadcast: 32,768 of 4,096 bits are 16 MB. A larger one is as sparse, but stays
#: distributed by block, and references meet their block by a join.
MAX_BLOCKS = 32_768
#: Parents of at most so many rows are broadcast to the exact join (some 4 MB); others are joined by shuffle.
BROADCAST_ROWS = 20_000

#: Fixed value: a key that says that there is no target.
NO_TARGET = "undetermined"


def bloom_blocks(n_keys: int) -> int:
    return max(1, math.ceil(n_keys * BITS_PER_KEY / BLOCK_BITS))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, probe: int) -> Column:
    """The place, 0 to 4095, of a key's bit: twelve bits of a second hash."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit("bloom")), 12 * probe).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block INT, words ARRAY<BIGINT>) over the distinct non-null keys; at most ``blocks`` rows of 512 bytes, built where the keys are."""
    k = F.col(key)
    bits = keys.where(k.isNotNull()).select(
        _block(k, blocks).alias("block"), F.explode(F.array(*[_bit(k, i) for i in range(PROBES)])).alias("bit")
    )
    words = bits.groupBy("block", F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit & 63)")).alias("mask")
    )
    by_word = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("m"))
    return by_word.select("block", F.expr("transform(sequence(0, 63), i -> coalesce(try_element_at(m, i), 0L))").alias("words"))


def might_contain(words: Column, key: Column) -> Column:
    """False proves that the key was not among the filter's; null words (no such block) give false."""
    hit = F.lit(True)
    for i in range(PROBES):
        b = _bit(key, i)
        word = F.get(words, F.shiftright(b, 6))
        hit = hit & (F.getbit(word, b.bitwiseAND(F.lit(63))) == 1)
    return F.coalesce(hit, F.lit(False))


def validity_periods(parents: DataFrame) -> DataFrame:
    """(key, since, until) of the given rows, overlapping and touching periods of a key merged; an open end is null.

    Repeated rows collapse before the shuffle by key. Rows without key or start are never valid and are left out, as are
    periods that end before they begin.
    """
    p = parents.where("key is not null and since is not null and (until is null or until > since)").distinct()
    w = Window.partitionBy("key").orderBy("since", F.col("until").desc_nulls_first())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    p = p.withColumn("end", F.coalesce("until", far)).withColumn("reach", F.max("end").over(before))
    p = p.withColumn("part", F.sum(F.when(F.col("reach").isNull() | (F.col("since") > F.col("reach")), 1).otherwise(0)).over(w))
    merged = p.groupBy("key", "part").agg(F.min("since").alias("since"), F.max("end").alias("end"))
    return merged.select("key", "since", F.when(F.col("end") < far, F.col("end")).alias("until"))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a valid target at their own time, as (ref_table, ref_row, at, reason).

    ``refs``: (ref_table STRING, ref_row BIGINT, key STRING, at TIMESTAMP_NTZ); ``parents``: (key, since, until), valid
    from ``since`` to before ``until``. Keys are compared without surrounding white space and letter case. A null key
    and ``UNDETERMINED`` are no references; an empty or blank key is one, and is missing unless a parent has it. A null
    time has no valid target: ``deleted`` if the key exists. With no parents every reference is ``missing``. Reasons:
    ``missing`` (no row with the key), ``late`` (all its rows begin after the reference), else ``deleted``.
    """
    refs = refs.select("ref_table", "ref_row", clean_key(F.col("key")).alias("key"), "at").where(F.col("key").isNotNull() & (F.col("key") != NO_TARGET))
    parents = parents.select(clean_key(F.col("key")).alias("key"), "since", "until").where(F.col("key").isNotNull())
    n = parents.count()
    blocks = bloom_blocks(n)
    bloom = bloom_filter(parents.select("key"), "key", blocks)
    probed = refs.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom) if blocks <= MAX_BLOCKS else bloom, "block", "left")
    probed = probed.withColumn("maybe", might_contain(F.col("words"), F.col("key"))).drop("block", "words")

    known = (F.col("r.key") == F.col("p.key")) & F.col("r.maybe")
    valid = (F.col("p.since") <= F.col("r.at")) & (F.col("p.until").isNull() | (F.col("r.at") < F.col("p.until")))
    periods = validity_periods(parents)
    firsts = parents.groupBy("key").agg(F.min("since").alias("first"), F.count(F.lit(1)).alias("rows"))
    reason = F.when(F.col("rows").isNull(), "missing").when(F.col("first") > F.col("at"), "late").otherwise("deleted").alias("reason")
    out = ["ref_table", "ref_row", "at", reason]
    if n <= BROADCAST_ROWS:
        # one pass over the references, no shuffle of them; those the filter denies are not looked up any more
        invalid = probed.alias("r").join(F.broadcast(periods).alias("p"), known & valid, "left_anti")
        return invalid.alias("r").join(F.broadcast(firsts).alias("p"), known, "left").select(*out)
    # only references that pass the filter are shuffled
    proven = probed.where(~F.col("maybe")).select("ref_table", "ref_row", "at", F.lit("missing").alias("reason"))
    invalid = probed.where("maybe").alias("r").join(periods.alias("p"), known & valid, "left_anti")
    return proven.unionByName(invalid.join(firsts, "key", "left").select(*out))


def orphans_per_period(orphans: DataFrame, unit: str = "day") -> DataFrame:
    """Counts of broken references by table, period and reason; a null time gives a null period."""
    return orphans.groupBy("ref_table", F.date_trunc(unit, "at").cast("date").alias("period"), "reason").agg(F.count(F.lit(1)).alias("n"))
