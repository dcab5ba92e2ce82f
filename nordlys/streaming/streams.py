"""Structured Streaming forms of the single-pass generators (extensions of the batch operators).

Each takes a streaming DataFrame and gives one; the caller chooses sink, trigger
and checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nordlys.functions.text import nfc_key
from nordlys.operators.corpus import decontaminate, with_fingerprint


def stream_dedup(sentences: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Drops sentences whose fingerprint was seen within the watermark (bounded state)."""
    return with_fingerprint(sentences).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def stream_decontaminate(sentences: DataFrame, gold: DataFrame) -> DataFrame:
    """Stream-static anti join against the gold fingerprints."""
    return decontaminate(with_fingerprint(sentences), gold)


def stream_profile(tokens: DataFrame, event_time: str, window: str = "1 hour", delay: str = "2 hours", column: str = "form") -> DataFrame:
    """Token frequencies in event-time windows, late rows counted until the watermark passes."""
    return tokens.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("window"), nfc_key(F.col(column)).alias("form")).agg(F.count("*").alias("cnt"))


def corpus_appender(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends each batch under its own folder, so a repeated batch replaces itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return append
