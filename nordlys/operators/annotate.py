"""Tagging: sentences are scored by a pluggable scorer and decoded by column expressions.

A scorer takes the token lists of a batch and gives, for each token, its UPOS
probabilities, its probabilities of each feature and the ids and probabilities
of its lemma rules.  It is built once a Python worker by a factory; batches are
scored sorted by length and put back in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions import vectors as V
from nordlys.functions.text import apply_rule
from nordlys.operators.segmentation import Policy, segment


class Scorer(Protocol):
    def __call__(self, sentences: list[list[str]]) -> list[list[tuple[list[float], dict[str, list[float]], list[int], list[float]]]]: ...


@dataclass(frozen=True)
class Labels:
    """Dimension data of a model: UPOS labels, feature values (multi-valued or not), lemma rules by id."""

    upos: tuple[str, ...]
    features: dict[str, tuple[tuple[str, ...], bool]]
    rules: tuple[tuple[int, int, str, str], ...]


#: Sentences whose scores are held together.
TOGETHER = 2048

SCORED = "array<struct<u:array<double>,m:map<string,array<double>>,li:array<int>,lp:array<double>>>"


def score_sentences(sentences: DataFrame, keys: list[str], factory: Callable[[], Scorer], batch: int = 64) -> DataFrame:
    """Adds ``scores`` (one struct a token) to rows of ``keys`` and tokens."""
    slim = sentences.select(*keys, "tokens", "has_space_before")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields) + f", scores {SCORED}"
    place = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for b in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            tokens = b.column(place).to_pylist()
            order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
            out: list = [None] * len(tokens)
            for k in range(0, len(order), batch):
                some = order[k : k + batch]
                for i, scored in zip(some, scorer([tokens[i] for i in some]), strict=True):
                    if len(scored) != len(tokens[i]):
                        raise ValueError("a scorer must give one score a token")
                    out[i] = scored
            yield pa.RecordBatch.from_arrays([*b.columns, _score_array(out)], [*b.schema.names, "scores"])

    return slim.mapInArrow(run, schema)


def _lists(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(lengths)], pa.int32()), values)


def _score_array(scored: list[list[tuple]]) -> pa.ListArray:
    """The scores of sentences as one nested array, put together from flat columns."""
    flat = [t for sentence in scored for t in sentence]
    floats = lambda parts: _lists([len(p) for p in parts], pa.array([x for p in parts for x in p], pa.float64()))
    names = [n for _, m, _, _ in flat for n in m]
    features = pa.MapArray.from_arrays(pa.array([0, *accumulate(len(m) for _, m, _, _ in flat)], pa.int32()), pa.array(names, pa.string()), floats([p for _, m, _, _ in flat for p in m.values()]))
    rules = _lists([len(li) for _, _, li, _ in flat], pa.array([x for _, _, li, _ in flat for x in li], pa.int32()))
    fields = [floats([u for u, _, _, _ in flat]), features, rules, floats([lp for _, _, _, lp in flat])]
    return _lists([len(s) for s in scored], pa.StructArray.from_arrays(fields, ["u", "m", "li", "lp"]))


def top_rules(score: Column, k: int) -> Column:
    """The likeliest lemma rules of a token's score: (id, p), likeliest first."""
    return V.top_k(score["li"], score["lp"], k)


def by_feature(scores: Column) -> Column:
    """Of a sentence's scores the features' probabilities: {feature: one array a token}."""
    names = F.array_sort(F.map_keys(F.get(scores, 0)["m"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(scores, lambda s: F.element_at(s["m"], n).cast("array<float>"))))


def choices(scores: Column) -> list[Column]:
    """What a second teacher would choose: UPOS ids and lemma rules of the tokens."""
    return [
        F.transform(scores, lambda s: V.argmax(s["u"])).alias("agreement_upos_ids"),
        F.transform(scores, lambda s: F.get(s["li"], V.argmax(s["lp"]))).alias("agreement_lemma_rule_ids"),
    ]


def label_tables(spark: SparkSession, labels: Labels) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The labels as dimension tables: (upos_id, upos), (feature, value_id, value, multi), (rule_id, pr, sr, pa, sa)."""
    values = [(f, i, v, multi) for f, (names, multi) in sorted(labels.features.items()) for i, v in enumerate(names)]
    return (
        spark.createDataFrame(list(enumerate(labels.upos)), "upos_id int, upos string"),
        spark.createDataFrame(values, "feature string, value_id int, value string, multi boolean"),
        spark.createDataFrame([(i, *r) for i, r in enumerate(labels.rules)], "rule_id int, pr int, sr int, pa string, sa string"),
    )


def decode_tokens(scored: DataFrame, keys: list[str], labels: Labels) -> DataFrame:
    """One row a token: UPOS with its distribution, features and lemma with confidences.

    A lemma rule that takes more than the token has leaves the token as its lemma.
    """
    x = F.col("x")
    upos = F.array(*[F.lit(u) for u in labels.upos])
    rules = F.array(*[F.struct(F.lit(a).alias("pr"), F.lit(b).alias("sr"), F.lit(c).alias("pa"), F.lit(d).alias("sa")) for a, b, c, d in labels.rules])
    rows = scored.select(*keys, F.posexplode(F.arrays_zip(F.col("tokens").alias("form"), F.col("has_space_before").alias("space"), F.col("scores").alias("s"))).alias("tok_idx", "x"))
    found = {name: V.tagged_values(F.element_at(x["s"]["m"], name), F.array(*[F.lit(v) for v in values]), multi) for name, (values, multi) in sorted(labels.features.items())}
    rule = F.get(rules, F.get(x["s"]["li"], V.argmax(x["s"]["lp"])))
    named = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("v")) for n, c in found.items()]), lambda e: F.size(e["v"]["values"]) > 0)
    # Staged, since later columns read each of these more than once.
    staged = rows.select(*keys, "tok_idx", x["form"].alias("form"), x["space"].alias("has_space_before"), x["s"]["u"].alias("_u"), x["s"]["lp"].alias("_lp"), named.alias("_f"), rule.alias("_rule"))
    return staged.select(
        *keys, "tok_idx", "form", "has_space_before", F.get(upos, V.argmax(F.col("_u"))).alias("upos"), F.array_max("_u").alias("upos_confidence"),
        F.transform(V.top_k(upos, F.col("_u"), len(labels.upos)), lambda e: F.struct(e["id"].alias("upos"), e["p"].alias("probability"))).alias("upos_distribution"),
        F.map_from_entries(F.transform("_f", lambda e: F.struct(e["key"], e["v"]["values"]))).alias("features"),
        F.map_from_entries(F.transform("_f", lambda e: F.struct(e["key"], e["v"]["confidence"]))).alias("feature_confidences"),
        F.coalesce(apply_rule(F.col("form"), F.col("_rule")), F.col("form")).alias("lemma"), F.array_max("_lp").alias("lemma_confidence"),
    )


def annotate_pretokenized(sentences: DataFrame, keys: list[str], labels: Labels, factory: Callable[[], Scorer]) -> DataFrame:
    """Tags token lists; empty sentences are skipped, missing space flags mean a space before each word."""
    flags = F.coalesce("has_space_before", F.transform("tokens", lambda _, i: i > 0)) if "has_space_before" in sentences.columns else F.transform("tokens", lambda _, i: i > 0)
    ready = sentences.filter("size(tokens) > 0").withColumn("has_space_before", flags)
    return decode_tokens(score_sentences(ready, keys, factory), keys, labels)


def annotate(docs: DataFrame, policy: Policy, labels: Labels, factory: Callable[[], Scorer], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Raw text to tagged tokens keyed by (document, sentence, token); one Python stage, no shuffle."""
    return annotate_pretokenized(segment(docs, policy, key, text=text), [key, "sentence_index"], labels, factory)


#: A small model-free label set and scorer, for tests and examples.
SHAPE_LABELS = Labels(upos=("NOUN", "NUM", "PROPN", "PUNCT"), features={"Number": (("Plur", "Sing"), False), "Shape": (("Cap", "Digit"), True)}, rules=((0, 0, "", ""), (0, 1, "", ""), (0, 2, "", "")))


def shape_scorer() -> Scorer:
    """Deterministic probabilities from a token's characters."""

    def score(sentences: list[list[str]]):
        out = []
        for s in sentences:
            row = []
            for w in s:
                digit, cap = w[:1].isdigit(), w[:1].isupper()
                best = 1 if digit else 2 if cap else 0 if any(c.isalnum() for c in w) else 3
                u = [0.91 if i == best else 0.03 for i in range(4)]
                plural = w.endswith(("er", "ene"))
                row.append((u, {"Number": [0.1, 0.7, 0.2] if plural else [0.2, 0.1, 0.7], "Shape": [0.9 if cap else 0.1, 0.8 if digit else 0.2]}, [0, 1, 2], [0.2, 0.1, 0.7] if plural else [0.8, 0.1, 0.1]))
            out.append(row)
        return out

    return score
