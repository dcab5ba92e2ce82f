"""Silver labels and calibration: filters, agreement, expected calibration error, temperatures, ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nordlys.functions import vectors as V
from nordlys.operators.evaluation import ratio
from nordlys.session import small


def token_labels(labels: DataFrame, features: dict[str, bool] | None = None) -> DataFrame:
    """One row a token of the label table: choices and confidences of all three tasks, agreement ids.

    ``features`` names the morphology features and whether each may have several values (default: Number, one).
    Tokens whose probabilities are null, empty or not numbers have null choices; a token's morphology is as sure
    as its least sure feature, and null where a feature lacks.  ``agreement_morphology`` (feature to booleans a
    token), if the table has it, gives morphology_agrees, else that is null.
    """
    features = {"Number": False} if features is None else features
    # A null array is an empty one here: zipping with null would lose the others' tokens.
    part = lambda c, kind, name: F.coalesce(c, F.array().cast(kind)).alias(name)
    names = {"upos_probabilities": "u", "lemma_rule_ids": "li", "lemma_rule_probabilities": "lp", "agreement_upos_ids": "au", "agreement_lemma_rule_ids": "al"}
    parts = [part(F.col(c), labels.schema[c].dataType, n) for c, n in names.items()]
    parts += [part(F.try_element_at("morphology_probabilities", F.lit(f)), "array<array<float>>", f"m{k}") for k, f in enumerate(features)]
    agreed = "agreement_morphology" in labels.columns
    if agreed:
        parts += [part(F.try_element_at("agreement_morphology", F.lit(f)), "array<array<boolean>>", f"a{k}") for k, f in enumerate(features)]
    rows = labels.select("document_id", "sentence_index", F.posexplode(F.arrays_zip(*parts)).alias("tok_idx", "x"))
    sound = lambda a: (F.size(a) > 0) & ~F.exists(a, lambda p: p.isNull() | F.isnan(p))
    u, lp = F.col("x.u"), F.col("x.lp")
    chosen = [F.when(sound(F.col(f"x.m{k}")), V.silver_choice(F.col(f"x.m{k}"), multi)) for k, multi in enumerate(features.values())]
    staged = rows.select("*", *[c.alias(f"_c{k}") for k, c in enumerate(chosen)])
    every = F.lit(True)
    for k in range(len(features)):
        every = every & F.col(f"_c{k}").isNotNull()
    sure = F.array(*[F.col(f"_c{k}.confidence") for k in range(len(features))])
    same = F.lit(None).cast("boolean")
    if agreed:
        same = F.lit(True)
        for k in range(len(features)):
            same = same & F.coalesce(F.col(f"_c{k}.active") == F.col(f"x.a{k}"), F.lit(False))
    return staged.select(
        "document_id", "sentence_index", "tok_idx",
        F.when(sound(u), V.argmax(u)).alias("upos_id"), F.when(sound(u), F.array_max(u).cast("double")).alias("upos_confidence"),
        F.when(sound(lp), F.get("x.li", V.argmax(lp))).alias("rule_id"), F.when(sound(lp), F.array_max(lp).cast("double")).alias("lemma_confidence"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f"_c{k}.active") for k in range(len(features))])).alias("morphology"),
        F.when(every, F.array_min(sure)).alias("morphology_confidence"),
        F.col("x.au").alias("agreed_upos_id"), F.col("x.al").alias("agreed_rule_id"), same.alias("morphology_agrees"),
    )


TASKS = ("upos", "morphology", "lemma")


def silver_filter(tokens: DataFrame, confidence: float = 0.9, most_masked: float = 0.3) -> DataFrame:
    """Sentences worth training on: a task's token is kept where both teachers agree and the first is sure;
    a sentence goes when more than ``most_masked`` of its tokens have any task masked.

    Without agreement (null) only the confidence decides; a token without sound probabilities is masked.
    """
    agrees = {
        "upos": F.col("agreed_upos_id").isNull() | (F.col("upos_id") == F.col("agreed_upos_id")),
        "morphology": F.coalesce("morphology_agrees", F.lit(True)),
        "lemma": F.col("agreed_rule_id").isNull() | (F.col("rule_id") == F.col("agreed_rule_id")),
    }
    kept = {t: F.coalesce(agrees[t] & (F.col(f"{t}_confidence") >= confidence), F.lit(False)) for t in TASKS}
    masked = tokens.withColumns({f"{t}_kept": c for t, c in kept.items()})
    any_masked = ~(F.col("upos_kept") & F.col("morphology_kept") & F.col("lemma_kept"))
    per = masked.groupBy("document_id", "sentence_index").agg(F.count("*").alias("tokens"), *[F.count_if(f"{t}_kept").alias(f"{t}_kept") for t in TASKS], F.count_if(any_masked).alias("masked"))
    return per.withColumn("masked_ratio", ratio(F.col("masked"), F.col("tokens"))).withColumn("keep", F.col("masked_ratio") <= most_masked)


def silver_report(filtered: DataFrame) -> DataFrame:
    """Sentences kept and, over their tokens, the shares each task masks; null shares where none is kept."""
    n = lambda c: F.sum(F.when(F.col("keep"), F.col(c)))
    return filtered.agg(
        F.count("*").alias("sentences"), F.count_if("keep").alias("kept_sentences"), n("tokens").alias("kept_tokens"),
        *[(1 - ratio(n(f"{t}_kept"), n("tokens"))).alias(f"{t}_masked_ratio") for t in TASKS],
    )


def align_labels(sentences: DataFrame, labels: DataFrame, strict: bool = True) -> DataFrame:
    """Labels beside the sentences they belong to, by (document_id, sentence_index): columns of both and ``status``.

    ``status`` is aligned, misaligned (other token count), missing (no such sentence) or gap (a sentence before
    it in its document has no label: labels must be a prefix).  Strict: anything but aligned is an error.
    """
    keys = ["document_id", "sentence_index"]
    size = F.greatest(*[F.coalesce(F.size(c), F.lit(0)) for c in ("upos_probabilities", "lemma_rule_ids")])
    side = sentences.filter("tokens is not null").select(*keys, "tokens").withColumn("_there", F.lit(True))
    joined = labels.withColumn("_labelled", F.lit(True)).join(side, keys, "full_outer")
    # The first sentence without a label of each document: one row a document.
    gaps = joined.filter("_labelled is null").groupBy("document_id").agg(F.min("sentence_index").alias("_gap"))
    rows = joined.filter("_labelled").join(small(gaps, derived=True), "document_id", "left")
    status = (
        F.when(F.col("_there").isNull(), "missing").when(size != F.size("tokens"), "misaligned")
        .when(F.col("_gap") < F.col("sentence_index"), "gap").otherwise("aligned")
    )
    if strict:
        place = F.concat_ws(" #", "document_id", F.col("sentence_index").cast("string"))
        status = F.when(status == "aligned", status).otherwise(F.raise_error(F.concat(F.lit("labels do not align with the corpus at "), place)).cast("string"))
    return rows.withColumn("status", status).drop("_labelled", "_there", "_gap")


def calibration_bins(rows: DataFrame, *by: str, bins: int = 15) -> DataFrame:
    """Counts by confidence bin ``(lo, hi]``; a confidence of 0 lies in none.  Columns: confidence, correct."""
    edges = [F.when(F.col("confidence") > k / bins, k) for k in range(bins - 1, -1, -1)]
    return rows.withColumn("bin", F.coalesce(*edges)).filter("bin is not null").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def calibration_error(binned: DataFrame, total: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error; ``total`` has n_all (rows in no bin count too)."""
    gap = F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy")))
    joined = binned.join(total, list(by)) if by else binned.crossJoin(total)  # one row
    return joined.groupBy(*by).agg((gap / F.max("n_all")).alias("ece"))


def grid(low: float, high: float, n: int) -> list[float]:
    """Temperatures evenly spaced in their logarithm."""
    return [10 ** (low + (high - low) * k / (n - 1)) for k in range(n)]


def nll_grid(scored: DataFrame, temperatures: list[float], *by: str) -> DataFrame:
    """Mean negative log likelihood of (z, label) at each temperature, all in one pass over the rows."""
    losses = F.array(*[F.struct(F.lit(t).alias("temperature"), V.cross_entropy(F.col("z"), F.col("label"), t).alias("loss")) for t in temperatures])
    return scored.select(*by, F.inline(losses)).groupBy(*by, "temperature").agg(F.avg("loss").alias("nll"))


def fit_temperature(scored: DataFrame, coarse: tuple[float, float, int] = (-1.5, 1.5, 31), fine: int = 41) -> tuple[float, float]:
    """(temperature, nll) of least loss: a coarse grid, then a fine one between its best point's neighbours."""
    points = grid(*coarse)
    least = lambda t: min((r["nll"], r["temperature"]) for r in nll_grid(scored, t).collect())  # noqa: E731  (a grid's rows)
    _, best = least(points)
    k = points.index(best)
    low, high = math.log10(points[max(0, k - 1)]), math.log10(points[min(len(points) - 1, k + 1)])
    nll, t = least(grid(low, high, fine))
    return t, nll


def class_weights(rows: DataFrame, label: str, cap: float = 10.0) -> DataFrame:
    """``min(cap, sqrt(max(1, negatives / positives)))`` of each label, 1 without positives."""
    counts = rows.groupBy(label).agg(F.count("*").alias("pos"))
    neg = F.sum("pos").over(Window.partitionBy()) - F.col("pos")  # one row a label
    return counts.withColumn("weight", F.when(F.col("pos") > 0, F.least(F.lit(cap), F.sqrt(F.greatest(F.lit(1.0), ratio(neg, F.col("pos")))))).otherwise(1.0))


def rank_audit(rows: DataFrame, *by: str) -> DataFrame:
    """Top-1, 2, 5, mean rank and mean reciprocal rank of the gold label's rank (column ``rank``)."""
    r = F.col("rank")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((r <= k).cast("double")).alias(f"top_{k}") for k in (1, 2, 5)], F.avg(r.cast("double")).alias("mean_rank"), F.avg(1.0 / r).alias("mrr"))


def rule_frequency_group(count: Column) -> Column:
    return F.when(count <= 1, "1").when(count <= 5, "2-5").when(count <= 20, "6-20").otherwise("21+")


def bundle_error_kind(gold_in_candidates: Column, first_is_gold: Column, final_is_gold: Column) -> Column:
    """Where a wrong bundle went wrong: not a candidate, ranked lower, or spoiled by refinement."""
    return F.when(final_is_gold, None).when(~gold_in_candidates, "uncovered").when(~first_is_gold, "ranking").otherwise("refinement")
