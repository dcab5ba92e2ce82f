"""Sub-word ids of pre-split words and the spans they take, by a public tokenizer file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def _tokenizer(definition: str):
    """Built once a worker from the file's own text, which the driver reads and broadcasts."""
    if definition not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED.clear()
        t = _LOADED[definition] = Tokenizer.from_str(definition)
        t.encode_special_tokens = True
    return _LOADED[definition]


def encode_words(sentences: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, ids, word_ids): each word (with its leading blank) encoded alone, ids in order.

    ``sentences`` has ``words``; null or empty lists give empty results.
    """
    definition = sentences.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    slim = sentences.select(*keys, "words")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]) + ", ids array<int>, word_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(definition.value)
        for b in batches:
            ids, owners = [], []
            for words in b.column(len(keys)).to_pylist():
                encoded = t.encode_batch([w or "" for w in words or []], add_special_tokens=False)
                ids.append([i for e in encoded for i in e.ids])
                owners.append([k for k, e in enumerate(encoded) for _ in e.ids])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32())), pa.array(owners, pa.list_(pa.int32()))], [*keys, "ids", "word_ids"])

    return slim.mapInArrow(run, schema)


def word_spans(word_ids: Column, words: Column) -> Column:
    """Half-open sub-word span of each word (null word ids are special tokens); null unless every
    word has one contiguous span."""
    spans = F.transform(
        F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0))),
        lambda w: F.struct(
            (F.array_position(word_ids, w.cast("int")) - 1).cast("int").alias("start"),
            (F.array_position(word_ids, w.cast("int")) - 1 + F.size(F.filter(word_ids, lambda x: x == w))).cast("int").alias("end"),
        ),
    )
    fine = F.forall(spans, lambda s: (s["end"] > s["start"]) & (F.size(F.array_distinct(F.slice(word_ids, s["start"] + 1, s["end"] - s["start"]))) == 1))
    return F.when((words > 0) & fine, spans)


def parity_fixture(sentences: DataFrame, key: str, path: str, policy: str = "") -> DataFrame:
    """(key, json) of sentences with ``words``: ids, sub-words of each word and the policy's version, to compare tokenizers by."""
    encoded = encode_words(sentences.withColumn("_n", F.size("words")), [key, "_n"], path)
    counts = F.transform(word_spans(F.col("word_ids"), F.col("_n")), lambda s: s["end"] - s["start"])
    return encoded.select(key, F.to_json(F.struct(F.col(key), F.lit(policy).alias("policy"), "ids", counts.alias("counts")), {"ignoreNullFields": "false"}).alias("json"))
