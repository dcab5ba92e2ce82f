"""Problem 5: a score cutoff per source that keeps a target share of its records.

Method: mergeable quantile sketches.  Each task summarises its scores of each
source in a deterministic sketch whose rank error is tracked exactly; sketches
merge in two rounds, so no task sees more than a bounded number of them.  The
merged sketch brackets the k-th highest score; a second pass counts the rows
above the bracket and the distinct scores within it, which gives the exact
cutoff, the kept rows and the ties.

Defined results
---------------
* per (document_id, sentence_index) the record with the latest ``labeled_at``
  counts, once; a null time is the earliest; among equals the highest score.
* a record has no score if either kind of probabilities is null or empty, or
  any inner array is null or empty or holds a null or NaN; such a latest record
  removes its key (it is neither counted nor kept).
* a document without a source, or a source without a target share, keeps nothing.
* ties at the cutoff are all kept; a share of 0 keeps nothing; an empty table
  gives empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nordlys.session import materialize, small

#: Entries of a sketch; its rank error is at most about n * log2(n / SKETCH) / SKETCH.
SKETCH = 2048
#: Least number of salts of hot documents, where their works are too many to broadcast.
SALTS = 16


def _least_peak(arrays: str) -> Column:
    """Least over the tokens of the highest probability; null if any token has none."""
    peaks = F.transform(F.col(arrays), lambda a: F.when(F.exists(a, lambda x: x.isNull() | F.isnan(x)), None).otherwise(F.array_max(a)))
    return F.when(F.exists(peaks, lambda p: p.isNull()), None).otherwise(F.array_min(peaks))


def score(upos: str = "upos_probabilities", lemma: str = "lemma_rule_probabilities") -> Column:
    """Float score of a record, null where it has none (all on the JVM side)."""
    u, r = _least_peak(upos), _least_peak(lemma)
    return F.when(u.isNull() | r.isNull(), None).otherwise(F.least(u, r)).cast("float")


def latest_scores(labels: DataFrame) -> DataFrame:
    """(document_id, sentence_index, score): one row a key, with partial aggregation before the shuffle."""
    return (
        labels.select("document_id", "sentence_index", "labeled_at", score().alias("score"))
        .groupBy("document_id", "sentence_index")
        .agg(F.max(F.struct("labeled_at", "score")).alias("last"))
        .select("document_id", "sentence_index", F.col("last.score").alias("score"))
        .filter("score is not null")
    )


def with_source(scored: DataFrame, works: DataFrame) -> DataFrame:
    """Adds the source.  The works are broadcast if they are few; else a document that holds many rows is spread over salts, as many as the cluster has cores."""
    side = materialize(works.filter("document_id is not null").groupBy("document_id").agg(F.max("corpus_id").alias("source")).filter("source is not null"))
    few = small(side)
    if few is not side:
        return scored.join(few, "document_id")
    salts = max(SALTS, scored.sparkSession.sparkContext.defaultParallelism)
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("sentence_index"), F.lit(salts)).cast("int"))
    return salted.join(side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["document_id", "_salt"]).drop("_salt")


class Sketch:
    """Sorted levels of weight 2**level; ``low``/``high`` bound every value's true rank.

    Compaction keeps every other value of a full level, alternating odd and even
    ones, and adds the level's weight to the error, so the bound is certain.
    """

    def __init__(self, size: int = SKETCH) -> None:
        self.size, self.n, self.error, self.flip = size, 0, 0, 0
        self.levels: list[list[float]] = [[]]

    def add(self, values: list[float]) -> None:
        for i in range(0, len(values), self.size):
            part = values[i : i + self.size]
            self.n += len(part)
            self.levels[0] += part
            self._shrink()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.error += other.error
        while len(self.levels) < len(other.levels):
            self.levels.append([])
        for mine, theirs in zip(self.levels, other.levels):
            mine += theirs
        self._shrink()

    def _shrink(self) -> None:
        for h, level in enumerate(self.levels):
            if len(level) >= 2 * self.size:
                level.sort()
                odd = [level.pop()] if len(level) % 2 else []
                if h + 1 == len(self.levels):
                    self.levels.append([])
                self.flip ^= 1
                self.levels[h + 1] += level[self.flip :: 2]
                self.levels[h] = odd
                self.error += 1 << h

    def bracket(self, k: int) -> tuple[float, float]:
        """Scores between which the k-th highest certainly lies."""
        items = heapq.merge(*([(-v, 1 << h) for v in sorted(level, reverse=True)] for h, level in enumerate(self.levels)))
        seen, high, low = 0, math.inf, -math.inf
        for negative, weight in items:
            if seen + weight + self.error < k:
                high = -negative  # fewer than k values are above it
            seen += weight
            if seen - self.error >= k:
                low = -negative
                break
        return low, high

    def dump(self) -> bytes:
        import pickle

        return pickle.dumps((self.size, self.n, self.error, self.flip, self.levels))

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        import pickle

        s = cls()
        s.size, s.n, s.error, s.flip, s.levels = pickle.loads(data)
        return s


_SKETCHES = "source string, part int, sketch binary"


def sketch_sources(scored: DataFrame, size: int = SKETCH) -> DataFrame:
    """(source, sketch): partial sketches in place, then two rounds of merging."""
    fan = max(1, math.isqrt(scored.rdd.getNumPartitions()))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: dict[str, Sketch] = {}
        for frame in frames:
            for source, group in frame.groupby("source", sort=False):
                mine.setdefault(source, Sketch(size)).add(group["score"].tolist())
        part = TaskContext.get().partitionId() % fan  # the same if the task runs again
        yield pd.DataFrame([(s, part, k.dump()) for s, k in sorted(mine.items())], columns=["source", "part", "sketch"])

    def merged(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Sketch(size)
        for frame in frames:
            for data in frame["sketch"]:
                total.merge(Sketch.load(data))
        yield pd.DataFrame([(key[0], 0, total.dump())], columns=["source", "part", "sketch"])

    parts = scored.select("source", "score").mapInPandas(partial, _SKETCHES)
    halfway = parts.groupBy("source", "part").applyInPandas(merged, _SKETCHES)
    return halfway.groupBy("source").applyInPandas(merged, _SKETCHES).select("source", "sketch")


def cutoffs(scored: DataFrame, targets: DataFrame, size: int = SKETCH) -> DataFrame:
    """(source, keep_permille, n_scored, k, cutoff, kept, ties, sketch_error), exact.

    ``scored`` has (source, score) and is read twice: pass a materialized table.
    """
    shares = targets.filter("source is not null").groupBy("source").agg(F.max("keep_permille").alias("keep_permille")).filter("keep_permille > 0")

    def query(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, data, permille in zip(frame["source"], frame["sketch"], frame["keep_permille"]):
                s = Sketch.load(data)
                k = min(s.n, -(-s.n * int(permille) // 1000))
                rows.append((source, int(permille), s.n, k, *s.bracket(k), s.error))
            yield pd.DataFrame(rows, columns=["source", "keep_permille", "n_scored", "k", "low", "high", "sketch_error"])

    brackets = sketch_sources(scored, size).join(small(shares), "source").mapInPandas(
        query, "source string, keep_permille int, n_scored bigint, k bigint, low double, high double, sketch_error bigint"
    )
    brackets = small(materialize(brackets))
    at = Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    # Above the bracket one row a source; within it one row a distinct score.
    counted = (
        scored.select("source", "score").join(brackets, "source").filter("score >= low")
        .withColumn("score", F.when(F.col("score") > F.col("high"), F.lit(float("inf"))).otherwise(F.col("score").cast("double")))
        .groupBy("source", "score", "keep_permille", "n_scored", "k", "sketch_error").agg(F.count("*").alias("ties"))
        .withColumn("kept", F.sum("ties").over(at))
        .filter("kept >= k")
    )
    first = Window.partitionBy("source").orderBy(F.desc("score"))
    return (
        counted.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
        .select("source", "keep_permille", "n_scored", "k", F.col("score").cast("float").alias("cutoff"), "kept", "ties", "sketch_error")
    )


def keep_share(labels: DataFrame, works: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept records with source and score, and the cutoff report."""
    scored = materialize(with_source(latest_scores(labels), works))
    report = materialize(cutoffs(scored, targets))
    kept = scored.join(small(report.select("source", "cutoff")), "source").filter("score >= cutoff")
    return kept.select("document_id", "sentence_index", "source", "score"), report
