"""Corpus building: first-seen deduplication, decontamination, manifests, budgets, shards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from nordlys.functions.text import fingerprint
from nordlys.session import input_bytes, materialize, small

#: Bytes of the scans behind a range of a total order.
RANGE_BYTES = 32 << 20


def with_fingerprint(sentences: DataFrame, tokens: str = "tokens") -> DataFrame:
    return sentences.withColumn("fingerprint", fingerprint(F.col(tokens)))


def first_seen(sentences: DataFrame, *order: str, key: str = "fingerprint") -> DataFrame:
    """Keeps of each key the row that comes first in the given order (nulls first), with all its columns.

    One aggregation with partial results carries the row along, so the input is
    read once, its survivors alone are shuffled, and a key that a third of the
    rows share is no single task.  Of rows equal in key and order one counts.
    Rows without a key are kept.
    """
    columns = sentences.columns
    # Rows without a key stand each for itself: their key is their whole order and a number of their own.
    alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    firsts = sentences.groupBy(F.col(key).alias("_key"), alone.alias("_alone")).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return firsts.select(*[F.col("_row")[c].alias(c) for c in columns])


def gold_fingerprints(*splits: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct fingerprints of all gold splits together (train, dev and test of every profile)."""
    keys = [with_fingerprint(s.filter(F.col(tokens).isNotNull()), tokens).select("fingerprint") for s in splits]
    return reduce(DataFrame.unionByName, keys).distinct()


def decontaminate(sentences: DataFrame, gold: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Without the rows whose key the gold data has; its keys are broadcast if few."""
    return sentences.join(small(gold.select(key).filter(F.col(key).isNotNull()).distinct(), derived=True), key, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Keys both corpora have."""
    return a.select(key).intersect(b.select(key)).filter(F.col(key).isNotNull())


def reindexed(sentences: DataFrame, document: str, *order: str, name: str = "sentence_index") -> DataFrame:
    """Numbers the surviving sentences of each document anew, from 0.

    The place in the whole order is taken less that of the document's first
    sentence, so a document that holds a third of all rows is no single task.
    """
    placed = running_total(sentences, F.lit(1), document, *order, name="_place")
    first = placed.groupBy(F.col(document).alias("_document")).agg(F.min("_place").alias("_first"))
    joined = placed.join(small(first, derived=True), F.col(document).eqNullSafe(F.col("_document")))
    return joined.withColumn(name, (F.col("_place") - F.col("_first")).cast("int")).drop("_place", "_first", "_document")


def manifest(sentences: DataFrame, *by: str) -> DataFrame:
    """Sentences, tokens and distinct documents, of all rows or by group."""
    return sentences.groupBy(*by).agg(
        F.count("*").alias("sentences"), F.coalesce(F.sum(F.when(F.col("tokens").isNotNull(), F.size("tokens"))), F.lit(0)).cast("bigint").alias("tokens"), F.countDistinct("document_id").alias("documents")
    )


def validate(sentences: DataFrame, expected: dict[str, int]) -> None:
    """Raises unless a recount equals the manifest."""
    got = manifest(sentences).first().asDict()
    wrong = {k: (v, got[k]) for k, v in expected.items() if got[k] != v}
    if wrong:
        raise ValueError(f"manifest and corpus differ: {wrong}")


@F.pandas_udf(LongType())
def _sum_before(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Running sum of the values before each row of a task, which is called once and carries it from batch to batch."""
    total = 0
    for v in parts:
        run = v.fillna(0).astype("int64").cumsum()
        yield run - v.fillna(0).astype("int64") + total
        total += int(run.iloc[-1]) if len(run) else 0


_sum_before = _sum_before.asNondeterministic()  # it reads the rows' order, so nothing may be moved past it


def running_total(rows: DataFrame, value: Column, *order: str, name: str = "before") -> DataFrame:
    """Sum of ``value`` (whole numbers, null as 0) over all rows before each one in the given total order.

    Rows are range-partitioned and sorted once; the running sum is made in that
    order within each range and written with the range's number, and the ranges'
    totals, one row each, move the sums on: one shuffle of the rows.  The
    number of ranges follows the input's bytes.
    """
    tasks = int(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200_000, input_bytes(rows) // RANGE_BYTES)))
    sorted_ = rows.withColumn("_v", value.cast("bigint")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ranged = materialize(sorted_.withColumn("_w", _sum_before("_v")).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_p").agg(F.sum("_v").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_offset")
    return ranged.join(small(offsets, derived=True), "_p").withColumn(name, F.col("_offset") + F.col("_w")).drop("_v", "_p", "_offset", "_w")


def within_budget(sentences: DataFrame, budget: int, size: Column, *order: str) -> DataFrame:
    """Sentences in order up to the one that crosses the token budget, which still counts."""
    return running_total(sentences, size, *order, name="_before").filter(F.col("_before") < budget).drop("_before")


def shards(sentences: DataFrame, size: int, *order: str) -> DataFrame:
    """Shard number of each row: ``size`` rows a shard in the given order."""
    return running_total(sentences, F.lit(1), *order, name="_place").withColumn("shard", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")
