"""Problem 1: oversized token sequences become pieces cut at natural boundaries.

Method: content-defined chunking.  A rolling hash over the last tokens marks
landmarks; the first landmark between the minimum and the maximum size is
snapped to the nearest natural boundary inside that window, where the end of a
sentence or clause counts as nearer than it is (REACH).  Cuts depend on
nearby content only, so an edit changes the pieces around it and later cuts
fall back into step.

Defined results
---------------
* null or non-positive maximum, null or unknown policy: 128; null or negative
  overlap: 0; an overlap of the maximum or more is lowered so that each piece
  brings at least one new token.
* null or empty ``tokens``: no pieces.  Null tokens are ordinary tokens.
* rows that repeat (sentence_id, document_id, sentence_index) count once: the
  longest token list wins, then the latest ``loaded_at``.
* other columns of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nordlys.session import small

DEFAULT_MAXIMUM = 128
#: Tokens the rolling hash looks back over, and one landmark per so many tokens.
HASH_WINDOW, LANDMARK_EVERY = 4, 16
#: Tokens by which a boundary of each strength (comma, clause, sentence) may lie farther from the landmark than a bare one.
REACH = (0, 0, 8, 32)
_BASE, _MASK = 0x100000001B3, (1 << 61) - 1

# Tokens that end a sentence, that may close one, and that end a clause.
SENTENCE_END = frozenset({".", "!", "?", "…", "...", "?!", "!?", "。", "！", "？", "।", "؟", "॥"})
CLOSERS = frozenset({"»", "”", "“", '"', "’", "'", ")", "]", "」", "』"})
CLAUSE_END = frozenset({";", ":", "；", "：", "؛", "–", "—"})
COMMA = frozenset({",", "，", "、", "،"})

PIECES = "sentence_id bigint, document_id string, sentence_index int, piece int, start int, end int, tokens array<string>"


def boundary_strength(tokens: Sequence[str | None]) -> list[int]:
    """How natural a cut *before* position i is: 3 sentence, 2 clause, 1 comma, 0 none."""
    out = [0] * (len(tokens) + 1)
    level = 0
    for i, tok in enumerate(tokens):
        if tok in SENTENCE_END:
            level = 3
        elif tok in CLAUSE_END:
            level = 2
        elif tok in COMMA:
            level = 1
        elif not (level == 3 and tok in CLOSERS):
            level = 0
        out[i + 1] = level
        if level == 3 and i + 1 < len(tokens) and tokens[i + 1] in CLOSERS:
            out[i + 1] = 0  # the closing mark still belongs to the sentence
    return out


def landmarks(tokens: Sequence[str | None]) -> list[bool]:
    """True at i where the rolling hash of the HASH_WINDOW tokens before i hits."""
    from xxhash import xxh64_intdigest

    drop = pow(_BASE, HASH_WINDOW, _MASK)
    values = [xxh64_intdigest(("\0" if t is None else t).encode("utf-8", "surrogatepass")) for t in tokens]
    out, h = [False] * (len(tokens) + 1), 0
    for i, v in enumerate(values):
        h = (h * _BASE + v) % _MASK
        if i >= HASH_WINDOW:
            h = (h - values[i - HASH_WINDOW] * drop) % _MASK
        out[i + 1] = i + 1 >= HASH_WINDOW and (h >> 7) % LANDMARK_EVERY == 0
    return out


def cut(tokens: Sequence[str | None], maximum: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open token ranges, each of at most ``maximum`` tokens, covering everything.

    >>> cut(["a"] * 5, 8, 2)
    [(0, 5)]
    """
    n = len(tokens)
    if n <= maximum:
        return [(0, n)] if n else []
    overlap = min(overlap, maximum - 1)
    strength, marks = boundary_strength(tokens), landmarks(tokens)
    pieces, fresh = [], 0
    while True:
        begin = max(0, fresh - overlap)
        last = begin + maximum
        if last >= n:
            pieces.append((begin, n))
            return pieces
        first = fresh + max(1, (last - fresh) // 2)
        aim = next((i for i in range(first, last + 1) if marks[i]), last)
        natural = [i for i in range(first, last + 1) if strength[i]]
        end = min(natural, key=lambda i: (abs(i - aim) - REACH[strength[i]], -strength[i], i)) if natural else aim
        pieces.append((begin, end))
        fresh = end


def limits_of(policies: DataFrame) -> DataFrame:
    """(_policy, _max, _overlap): one row a policy."""
    return policies.filter("policy_id is not null").groupBy(F.col("policy_id").alias("_policy")).agg(
        F.max(F.when(F.col("maximum_token_count") > 0, F.col("maximum_token_count"))).alias("_max"),
        F.max("overlap_token_count").alias("_overlap"),
    )


def split_oversized(sentences: DataFrame, policies: DataFrame) -> DataFrame:
    """One row per piece of every sentence that exceeds its policy's maximum.

    The size test runs on the JVM side, so only oversized rows reach Python.
    ``policies`` is broadcast after its rows were counted.
    """
    limits = limits_of(policies)
    over = (
        sentences.select("sentence_id", "document_id", "sentence_index", "policy_id", "tokens", "loaded_at")
        .join(small(limits), F.col("policy_id") == F.col("_policy"), "left")
        .withColumn("_max", F.coalesce("_max", F.lit(DEFAULT_MAXIMUM)))
        .filter(F.size("tokens") > F.col("_max"))
        .groupBy("sentence_id", "document_id", "sentence_index")
        .agg(F.max(F.struct(F.size("tokens").alias("n"), "loaded_at", "_max", "_overlap", "tokens")).alias("s"))
        .select("sentence_id", "document_id", "sentence_index", "s.tokens", "s._max", F.greatest(F.coalesce("s._overlap", F.lit(0)), F.lit(0)).alias("_overlap"))
    )
    return over.mapInArrow(_pieces, PIECES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("sentence_id", pa.int64()), ("document_id", pa.string()), ("sentence_index", pa.int32()), ("piece", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.list_(pa.string()))])
    for batch in batches:
        rows = []
        for sid, doc, idx, tokens, most, shared in zip(*(c.to_pylist() for c in batch.columns)):
            rows += [(sid, doc, idx, k, a, b, tokens[a:b]) for k, (a, b) in enumerate(cut(tokens, most, shared))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
