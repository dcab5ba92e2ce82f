"""Frequency classes, aligned comparison of annotations, and metrics with slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nordlys.functions.text import apply_rule, feature_bundle, nfc_key, restore_marker, universal_subset
from nordlys.session import small

KEYS = ("sent_id", "tok_idx")


def frequency_profile(forms: DataFrame, column: str = "form", *by: str) -> DataFrame:
    """(form, cnt): composed and case-folded forms, counted."""
    return forms.select(*by, nfc_key(F.col(column)).alias("form")).filter("form is not null").groupBy(*by, "form").agg(F.count("*").alias("cnt"))


def frequency_class(count: Column, rare: int = 5) -> Column:
    return F.when(count == 0, "oov").when(count <= rare, "rare").otherwise("frequent")


def with_frequency_class(tokens: DataFrame, profile: DataFrame, rare: int = 5, column: str = "form") -> DataFrame:
    """Left lookup of the training count; the profile is broadcast only if it is small."""
    side = small(profile.select(F.col("form").alias("_form"), "cnt"), derived=True)
    return tokens.join(side, nfc_key(F.col(column)) == F.col("_form"), "left").withColumn("freq_class", frequency_class(F.coalesce("cnt", F.lit(0)), rare)).drop("_form", "cnt")


def aligned(gold: DataFrame, system: DataFrame, form: str = "form") -> DataFrame:
    """Gold and system tokens by position, as columns g and s; a lone or differing form is an error."""
    g = gold.select(*KEYS, F.struct(*[c for c in gold.columns if c not in KEYS]).alias("g"))
    s = system.select(*KEYS, F.struct(*[c for c in system.columns if c not in KEYS]).alias("s"))
    both = g.join(s, list(KEYS), "full_outer")
    fits = F.col(f"g.{form}").eqNullSafe(F.col(f"s.{form}")) & F.col("g").isNotNull() & F.col("s").isNotNull()
    return both.withColumn("g", F.when(fits, F.col("g")).otherwise(F.raise_error(F.lit("gold and system tokens are not aligned")).cast(both.schema["g"].dataType)))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


#: The lemma of a rule that takes more than the token has.
INVALID = "<INVALID>"


def decode_lemmas(pairs: DataFrame, rule: Column) -> DataFrame:
    """Pairs whose system lemma is what its rule makes of the form; a rule that can't be applied gives ``INVALID``."""
    fits = (rule["pr"] >= 0) & (rule["sr"] >= 0)
    return pairs.withColumn("s", F.col("s").withField("lemma", F.coalesce(F.when(fits, apply_rule(F.col("s.form"), rule)), F.lit(INVALID))))


def marker_forms(training: DataFrame) -> DataFrame:
    """(form): the forms that carried a ``$`` lemma in training."""
    return training.filter(F.col("lemma").startswith("$")).select("form").distinct()


def restore_markers(tokens: DataFrame, forms: DataFrame) -> DataFrame:
    """Tokens whose lemmas have their ``$`` again where the form is one of the marked (a broadcast semi join, if they are few)."""
    marked = small(forms.select(F.col("form").alias("_form"), F.lit(True).alias("_marked")), derived=True)
    return tokens.join(marked, F.col("form") == F.col("_form"), "left").withColumn("lemma", restore_marker(F.col("lemma"), F.col("_marked"))).drop("_form", "_marked")


def ud_metrics(pairs: DataFrame, *by: str, invalid: bool = False) -> DataFrame:
    """Correct UPOS, universal features and lemmas and their F1 (equal to the accuracy of aligned tokens).

    A gold lemma of ``_`` always counts as right.  With ``invalid`` also how many rules could not be applied.
    """
    upos = F.col("g.upos") == F.col("s.upos")
    feats = feature_bundle(universal_subset(F.col("g.features"))) == feature_bundle(universal_subset(F.col("s.features")))
    lemma = (F.col("g.lemma") == "_") | (F.col("g.lemma") == F.col("s.lemma"))
    n = F.count("*")
    return pairs.groupBy(*by).agg(
        n.alias("tokens"), F.count_if(upos).alias("upos_correct"), F.count_if(feats).alias("ufeats_correct"), F.count_if(lemma).alias("lemma_correct"),
        ratio(F.count_if(upos), n).alias("upos_f1"), ratio(F.count_if(feats), n).alias("ufeats_f1"), ratio(F.count_if(lemma), n).alias("lemma_f1"),
        *([F.count_if(F.col("s.lemma") == INVALID).alias("invalid_rules")] if invalid else []),
    )


def ud_metrics_with_slices(pairs: DataFrame, slice_column: str) -> DataFrame:
    """Overall and by slice in one pass (GROUPING SETS); the overall row's slice is ``all``."""
    rows = pairs.withColumn("slice", F.explode(F.array(F.lit("all"), F.col(slice_column))))
    return ud_metrics(rows, "slice")


def policy_audit(tokens: DataFrame, gold: Column, start: Column, steps: list[tuple[str, Column]]) -> DataFrame:
    """Of each policy step (name, bundle after it): how many bundles it changed, mended and spoiled."""
    rows, before = [], start
    for k, (name, after) in enumerate(steps):
        rows.append(F.struct(F.lit(k).alias("step_no"), F.lit(name).alias("step"), (before != after).alias("changed"), ((before != gold) & (after == gold)).alias("improved"), ((before == gold) & (after != gold)).alias("regressed")))
        before = after
    return tokens.select(F.inline(F.array(*rows))).groupBy("step_no", "step").agg(F.count_if("changed").alias("changed"), F.count_if("improved").alias("improved"), F.count_if("regressed").alias("regressed"))


def feature_counts(pairs: DataFrame) -> DataFrame:
    """Per feature and value: true and false positives and false negatives, values of a token apart."""

    def values(side: str) -> Column:
        return F.flatten(F.transform(F.map_entries(f"{side}.features"), lambda e: F.transform(F.split(e["value"], ","), lambda v: F.struct(e["key"].alias("feature"), v.alias("value")))))

    g, s = values("g"), values("s")
    marked = F.concat(
        F.transform(F.array_intersect(g, s), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), F.lit("tp").alias("kind"))),
        F.transform(F.array_except(s, g), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), F.lit("fp").alias("kind"))),
        F.transform(F.array_except(g, s), lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), F.lit("fn").alias("kind"))),
    )
    return pairs.select(F.inline(marked)).groupBy("feature", "value").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def classification(counts: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of tp, fp, fn columns; 0 on empty denominators."""
    p = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.withColumns({"support": F.col("tp") + F.col("fn"), "precision": p, "recall": r, "f1": f})


def micro_average(counts: DataFrame, *by: str, none: str = "<NONE>") -> DataFrame:
    """Micro precision, recall and F1 without the empty label."""
    summed = counts.filter(F.col("value") != none).groupBy(*by).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return classification(summed)


def task_metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """Token-task ratios; null on empty denominators.  A null gold rule id is a rule outside the schema."""
    known = F.col("g.rule_id").isNotNull()
    annotated = F.col("g.lemma") != "_"
    right = known & (F.col("g.rule_id") == F.col("s.rule_id"))
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("tokens"), F.count_if(F.col("g.upos") == F.col("s.upos")).alias("upos_correct"),
        F.count_if(feature_bundle(F.col("g.features")) == feature_bundle(F.col("s.features"))).alias("bundle_correct"),
        F.count_if(annotated).alias("lemma_annotated"), F.count_if(annotated & known).alias("lemma_targets"), F.count_if(annotated & right).alias("lemma_correct"),
    )
    return counts.withColumns({
        "upos_accuracy": ratio(F.col("upos_correct"), F.col("tokens")), "bundle_accuracy": ratio(F.col("bundle_correct"), F.col("tokens")),
        "lemma_accuracy": ratio(F.col("lemma_correct"), F.col("lemma_targets")), "lemma_coverage": ratio(F.col("lemma_targets"), F.col("lemma_annotated")),
        "lemma_end_to_end": ratio(F.col("lemma_correct"), F.col("lemma_annotated")),
    })


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """Average precision of (score, target): counts at the end of each group of tied scores; null without positives.

    Scores are aggregated before the window, which then holds distinct scores only.
    """
    ties = scored.groupBy(*by, "score").agg(F.count_if("target").alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = ties.withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum("n").over(w))
    return run.groupBy(*by).agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision"), F.sum("pos").alias("positives"))


def corpus_counters(tokens: DataFrame) -> DataFrame:
    """Tokens, annotated lemmas, and annotated lemmas whose rule the schema lacks."""
    annotated = F.col("lemma") != "_"
    return tokens.agg(F.count("*").alias("tokens"), F.count_if(annotated).alias("lemma_annotated"), F.count_if(annotated & F.col("rule_id").isNull()).alias("unknown_rules"))


def weighted_means(batches: DataFrame, losses: dict[str, str]) -> DataFrame:
    """Epoch means of batch losses, each weighted by its own count."""
    return batches.agg(*[ratio(F.sum(F.col(loss) * F.col(n)), F.sum(n)).alias(loss) for loss, n in losses.items()])


def latency(rows: DataFrame, seconds: str, tokens: str, *by: str) -> DataFrame:
    """Mean, median and 95th percentile of the time, and tokens a second.

    Percentiles are exact: equal times are counted before they meet, so a hot group is as many rows as it has
    distinct times (of a clock's resolution).
    """
    rows = rows.groupBy(*by, seconds).agg(F.sum(tokens).alias("_t"), F.count("*").alias("_n"))
    n = F.sum("_n")
    return rows.groupBy(*by).agg(ratio(F.sum(F.col(seconds) * F.col("_n")), n).alias("mean"), F.percentile(seconds, F.lit(0.5), F.col("_n")).alias("p50"), F.percentile(seconds, F.lit(0.95), F.col("_n")).alias("p95"), ratio(F.sum("_t"), F.sum(F.col(seconds) * F.col("_n"))).alias("tokens_per_second"))


def max_difference(a: Column, b: Column) -> Column:
    """Largest absolute difference of two arrays; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def error_shares(counts: DataFrame, errors: str = "errors") -> DataFrame:
    """Ranks rows by errors, then name, with their share of all errors."""
    whole = Window.partitionBy()
    return counts.withColumn("share", ratio(F.col(errors), F.sum(errors).over(whole)))
