"""Samples, seeded orders and batches; the order is a hash of (seed, key), the same on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nordlys.operators.corpus import running_total


def stride_sample(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """``n`` rows at even steps through the order (all, if there are no more)."""
    placed = running_total(rows, F.lit(1), *order, name="_k")
    size = rows.count()
    if size <= n:
        return placed.drop("_k")
    # Row k is taken where the step function floor(k * n / size) moves on.
    here, before = F.floor(F.col("_k") * n / size), F.floor((F.col("_k") - 1) * n / size)
    return placed.filter((F.col("_k") == 0) | (here != before)).drop("_k")


def seeded_key(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def seeded_order(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in a seeded pseudorandom order (a range-partitioned sort)."""
    return rows.orderBy(seeded_key(seed, *keys), *keys)


def interleave(gold: DataFrame, silver: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Both sets in one seeded order, with their origin."""
    both = gold.withColumn("origin", F.lit("gold")).unionByName(silver.withColumn("origin", F.lit("silver")))
    return seeded_order(both, seed, "origin", *keys)


def length_batches(rows: DataFrame, length: Column, size: int, *keys: str) -> DataFrame:
    """Batch numbers of rows sorted by length, ``size`` a batch; the keys restore the order."""
    return running_total(rows.withColumn("_length", length), F.lit(1), "_length", *keys, name="_k").withColumn("batch", F.floor(F.col("_k") / size).cast("bigint")).drop("_k", "_length")
