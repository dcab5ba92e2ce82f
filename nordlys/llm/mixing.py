"""Problem 7: sources mixed to target weights, small ones repeated up to a cap.

Method: each source's records are laid end to end, in an order fixed by a hash,
and cut into blocks of ``BLOCK`` tokens.  The number of blocks of the mixture is
the largest that no cap forbids; an output shard's blocks are drawn among the
sources by multinomials (conditioned on what is left of each source's quota, so
the shares come out exactly), and the slots of a source are mapped to its
blocks by a pseudorandom permutation a pass.  Slots and records meet in a join
on (source, block), whose keys are as many as blocks: no source is ever one task.

Defined results
---------------
* source names are compared trimmed and in lower case; records of null or
  unlisted sources are not mixed; null and empty texts have no tokens.
* a source with a target but no tokens gives nothing, and the others share its
  weight; null or non-positive weights and repeats count as 0.
* a source's last block may be shorter.  No token, so no record, is used more
  often than ``max_repeats``; ``uses`` of a record is the most any of its tokens
  is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nordlys.llm import bpe
from nordlys.operators.corpus import running_total
from nordlys.session import materialize, small

#: Tokens a block; blocks an output shard holds, and the bounds of the shards' number; slots made from one row.
BLOCK, SHARD_BLOCKS, SHARDS, MOST_SHARDS, SLOT_CHUNK = 128, 1 << 16, 64, 10_000, 100_000
SEED = 20240601


def source_name() -> Column:
    return F.lower(F.trim("source"))


def laid_out(docs: DataFrame, targets: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, begin): each record's place in its source's token stream.

    The running sum goes over all sources in one range-partitioned order, so a
    source that holds a third of all rows spans a third of the ranges; what lies
    before a source's first record is taken off.
    """
    wanted = targets.select(source_name().alias("source")).filter("source is not null").distinct()
    sized = bpe.count_tokens(docs.select("doc_id", source_name().alias("source"), "text").join(small(wanted), "source").filter("text <> ''"), "doc_id", "source", path=path)
    sized = materialize(sized.withColumn("_h", F.xxhash64("doc_id", F.lit(SEED))))
    placed = running_total(sized, F.col("n_tokens"), "source", "_h", "doc_id", name="_all")
    base = placed.groupBy("source").agg(F.min("_all").alias("_base"))
    return materialize(placed.join(small(base, derived=True), "source").select("doc_id", "source", "n_tokens", (F.col("_all") - F.col("_base")).cast("bigint").alias("begin")))


def block_records(placed: DataFrame, size: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, n_tokens, from_token, to_token): the part of each record in each block."""
    first, last = F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("n_tokens") - 1) / size)
    return (
        placed.filter("n_tokens > 0").withColumn("block", F.explode(F.sequence(first, last)))
        .select(
            "source", F.col("block").cast("bigint").alias("block"), "doc_id", "n_tokens",
            F.greatest(F.lit(0), F.col("block") * size - F.col("begin")).cast("bigint").alias("from_token"),
            F.least("n_tokens", (F.col("block") + 1) * size - F.col("begin")).cast("bigint").alias("to_token"),
        )
    )


def quotas(totals: dict[str, int], weights: dict[str, float], repeats: dict[str, int], size: int = BLOCK) -> dict[str, tuple[int, int]]:
    """(blocks the source has, blocks the mixture takes) of each source; the largest mixture the caps allow.

    >>> quotas({"a": 1280, "b": 128}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3})
    {'a': (10, 3), 'b': (1, 3)}
    """
    usable = {s: -(-n // size) for s, n in totals.items() if n > 0 and weights.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not usable:
        return {}
    scale = sum(weights[s] for s in usable)
    # In tokens, since a last block is shorter; the cap holds for every block.
    most = min(totals[s] * repeats[s] / (weights[s] / scale) for s in usable)
    out = {}
    for s, blocks in sorted(usable.items()):
        average = totals[s] / blocks
        out[s] = (blocks, min(blocks * repeats[s], round(most * weights[s] / scale / average)))
    return out


def shard_number(quota: dict[str, tuple[int, int]]) -> int:
    """Output shards of a mixture, by its size."""
    return max(SHARDS, min(MOST_SHARDS, sum(n for _, n in quota.values()) // SHARD_BLOCKS))


def draw(quota: dict[str, tuple[int, int]], shards: int = SHARDS, seed: int = SEED) -> list[tuple[int, str, int, int, int]]:
    """(shard, source, first slot, slots, blocks of the source): multinomial counts for each shard,
    conditioned on the quotas; shards times sources rows, whatever the corpus."""
    rng = np.random.default_rng(seed)
    names = sorted(quota)
    left = np.array([quota[s][1] for s in names], dtype=np.int64)
    used = np.zeros(len(names), dtype=np.int64)
    out = []
    for shard in range(shards):
        n = int(left.sum() // (shards - shard))
        if not n:
            continue
        if shard == shards - 1:
            counts = left.copy()
        else:
            counts = np.minimum(rng.multinomial(n, left / left.sum()), left)
            short = n - int(counts.sum())
            for k in np.argsort(counts - left):
                more = min(short, int(left[k] - counts[k]))
                counts[k] += more
                short -= more
        for k, c in enumerate(counts):
            if c:
                out.append((shard, names[k], int(used[k]), int(c), quota[names[k]][0]))
        left -= counts
        used += counts
    return out


def permuted(slots: np.ndarray, blocks: int, key: int) -> np.ndarray:
    """Slot -> block: pass p is the pseudorandom permutation number p of the blocks (a Feistel
    network over the next power of four, walked until it falls inside)."""
    bits = max(1, (max(blocks - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    rounds = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF) for r in range(4)]
    turn = (slots // blocks).astype(np.uint64)
    out = (slots % blocks).astype(np.uint64)
    todo = np.arange(len(slots))
    with np.errstate(over="ignore"):
        while len(todo):
            x, t = out[todo], turn[todo]
            left, right = x >> np.uint64(bits), x & mask
            for k in rounds:
                f = (right ^ k ^ (t * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
                f ^= f >> np.uint64(33)
                f *= np.uint64(0xC4CEB9FE1A85EC53)
                f ^= f >> np.uint64(29)
                left, right = right, (left ^ f) & mask
            out[todo] = (left << np.uint64(bits)) | right
            todo = todo[out[todo] >= np.uint64(blocks)]
    return out.astype(np.int64)


_SLOTS = "shard int, slot bigint, source string, block bigint"


def slot_table(docs: DataFrame, plan: list[tuple[int, str, int, int, int]]) -> DataFrame:
    """One row a slot of the mixture, made in chunks spread over the tasks; the plan has a row a shard and source."""
    spark = docs.sparkSession
    whole = spark.createDataFrame(plan, "shard int, source string, begin bigint, slots bigint, blocks bigint")
    rows = whole.withColumn("first", F.explode(F.sequence("begin", F.col("begin") + F.col("slots") - 1, F.lit(SLOT_CHUNK)))).select(
        "shard", "source", "first", F.least(F.lit(SLOT_CHUNK), F.col("begin") + F.col("slots") - F.col("first")).alias("n"), "blocks"
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh32_intdigest

        for frame in frames:
            for r in frame.itertuples(index=False):
                slots = np.arange(r.first, r.first + r.n, dtype=np.int64)
                yield pd.DataFrame({"shard": r.shard, "slot": slots, "source": r.source, "block": permuted(slots, int(r.blocks), xxh32_intdigest(r.source) ^ SEED)})

    return rows.repartition(spark.sparkContext.defaultParallelism * 2, "shard", "source", "first").mapInPandas(run, _SLOTS)


def mix(docs: DataFrame, targets: DataFrame, path: str = bpe.VOCABULARY, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mixture's spans (shard, slot, source, block, doc_id, n_tokens, from_token, to_token) and the targets used."""
    placed = laid_out(docs, targets, path)
    goal = targets.select(source_name().alias("source"), "target_weight", "max_repeats").filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    # One row a listed source.
    totals = placed.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(small(goal), "source").collect()
    quota = quotas({r["source"]: r["n"] for r in totals}, {r["source"]: r["target_weight"] or 0 for r in totals}, {r["source"]: r["max_repeats"] or 0 for r in totals}, size)
    slots = slot_table(docs, draw(quota, shard_number(quota)))
    # Spark takes the slots for as small as the rows they are made from, and would send them all to the driver as a broadcast.
    return slots.hint("merge").join(block_records(placed, size), ["source", "block"]), goal


def shares(spans: DataFrame, goal: DataFrame) -> DataFrame:
    """Per target source: weight asked for, tokens and share reached, the most a record is used."""
    used = spans.groupBy("source", "doc_id", "block").agg(F.count("*").alias("uses"), F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
    per = used.groupBy("source").agg(F.sum("t").alias("tokens"), F.countDistinct("doc_id").alias("records"), F.max("uses").alias("most_uses"))
    whole = Window.partitionBy()
    return (
        goal.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("share", F.col("tokens") / F.sum("tokens").over(whole))
        .select("source", "target_weight", "share", "tokens", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
    )


def selection(spans: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, uses, used_tokens) of every record of the mixture."""
    per_block = spans.groupBy("source", "doc_id", "n_tokens", "block").agg(F.count("*").alias("uses"), F.sum(F.col("to_token") - F.col("from_token")).alias("t"))
    return per_block.groupBy("doc_id", "source", "n_tokens").agg(F.max("uses").alias("uses"), F.sum("t").alias("used_tokens"))
