"""Offline entry points: a corpus from a source, and labels for a corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nordlys.operators import annotate, corpus
from nordlys.operators.segmentation import Policy, extract
from nordlys.sources import sinks


def silver_sentences(documents: DataFrame, policy: Policy, gold: list[DataFrame], key: str = "document_id", text: str = "text") -> DataFrame:
    """Clean sentences of documents: extracted, without gold sentences, each once (first seen), numbered anew in their document.

    ``documents`` has one row a document or paragraph, whose place in its document is ``order`` if it has that column.
    """
    order = ["order"] if "order" in documents.columns else []
    found = extract(documents, policy, key, *order, text=text)
    kept = corpus.decontaminate(corpus.with_fingerprint(found), corpus.gold_fingerprints(*gold)) if gold else corpus.with_fingerprint(found)
    once = corpus.first_seen(kept, key, *order, "place")
    numbered = corpus.reindexed(once, key, *order, "place")
    return numbered.select(F.col(key).cast("string").alias("document_id"), "sentence_index", "tokens", "has_space_before")


def prepare_silver_corpus(documents: DataFrame, policy: Policy, gold: list[DataFrame], path: str, about: dict, **columns: str) -> dict:
    """Writes such a corpus with its manifest, and gives the manifest."""
    return sinks.write_corpus(silver_sentences(documents, policy, gold, **columns), path, about, "json")


def label_silver_corpus(sentences: DataFrame, teacher: Callable[[], annotate.Scorer], path: str, budget: int, about: dict, second: Callable[[], annotate.Scorer] | None = None, top: int = 8, shard: int = 20_000) -> dict:
    """Labels of the corpus's first sentences up to a token budget, in shards with a manifest.

    Raw probabilities are stored, the ``top`` lemma rules with theirs; a second teacher adds what it would
    choose.  The filter is applied when the labels are read.
    """
    keys = ["document_id", "sentence_index"]
    chosen = corpus.within_budget(sentences, budget, F.size("tokens"), *keys)
    scored = annotate.score_sentences(chosen, keys, teacher)
    best = F.transform("scores", lambda s: annotate.top_rules(s, top))
    labels = scored.select(
        *keys, F.transform("scores", lambda s: s["u"].cast("array<float>")).alias("upos_probabilities"),
        annotate.by_feature(F.col("scores")).alias("morphology_probabilities"),
        F.transform(best, lambda b: F.transform(b, lambda x: x["id"])).alias("lemma_rule_ids"), F.transform(best, lambda b: F.transform(b, lambda x: x["p"].cast("float"))).alias("lemma_rule_probabilities"),
    )
    if second is not None:
        other = annotate.score_sentences(chosen, keys, second)
        labels = labels.join(other.select(*keys, *annotate.choices(F.col("scores"))), keys)
    return sinks.write_label_shards(labels, path, shard, about)
