"""Morphology bundles: inventory, coverage of an oracle, candidates, errors of one feature, two systems compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nordlys.functions.text import feature_bundle
from nordlys.operators.corpus import reindexed
from nordlys.session import materialize, small


def bundle_inventory(tokens: DataFrame) -> DataFrame:
    """(upos, bundle, cnt, rank): bundles of each UPOS by falling count, then name."""
    counted = tokens.select("upos", feature_bundle(F.col("features")).alias("bundle")).groupBy("upos", "bundle").agg(F.count("*").alias("cnt"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("upos").orderBy(F.desc("cnt"), "bundle")))


def bundle_candidates(inventory: DataFrame, most: int) -> DataFrame:
    """The first ``most`` bundles of each UPOS with ids in (upos, rank) order."""
    top = inventory.filter(F.col("rank") <= most)
    return top.withColumn("candidate_id", (F.row_number().over(Window.partitionBy().orderBy("upos", "rank")) - 1).cast("int")).select("candidate_id", "upos", "bundle", "cnt", "rank")


def bundle_oracle(tokens: DataFrame, inventory: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """How many tokens' bundles were seen at all, with their UPOS, and within its first k; all and annotated tokens."""
    inventory = materialize(inventory)  # read for two joins
    rows = tokens.select("upos", feature_bundle(F.col("features")).alias("bundle"))
    # Counted before the join, so that a bundle which most tokens have is one row.
    rows = rows.groupBy("upos", "bundle").agg(F.count("*").alias("n"))
    seen = small(inventory.select("bundle").distinct().withColumn("_any", F.lit(True)))
    pairs = small(inventory.select("upos", "bundle", "rank"))
    joined = rows.join(seen, "bundle", "left").join(pairs, ["upos", "bundle"], "left").withColumn("slice", F.explode(F.when(F.col("bundle") != "_", F.array(F.lit("all"), F.lit("annotated"))).otherwise(F.array(F.lit("all")))))
    n = F.col("n")
    return joined.groupBy("slice").agg(
        F.sum("n").alias("tokens"), F.sum(F.when(F.col("_any"), n).otherwise(0)).alias("seen"), F.sum(F.when(F.col("rank").isNotNull(), n).otherwise(0)).alias("seen_with_upos"),
        *[F.sum(F.when(F.col("rank") <= k, n).otherwise(0)).alias(f"top_{k}") for k in ks],
    )


def inventory_summary(inventory: DataFrame) -> DataFrame:
    per = inventory.groupBy("upos").agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt"))
    distinct = inventory.select("bundle").distinct().agg(F.count("*").alias("bundles"))
    return per.agg(F.sum("cnt").alias("examples"), F.sum("n").alias("pairs"), F.max("n").alias("max_per_upos")).crossJoin(distinct)  # one row each


def feature_errors(pairs: DataFrame, feature: str) -> DataFrame:
    """Tokens whose value of one feature is wrong, with their neighbours' gold UPOS (``<BOS>``, ``<EOS>``)."""
    w = Window.partitionBy("sent_id").orderBy("tok_idx")
    value = lambda side: F.coalesce(F.try_element_at(F.col(f"{side}.features"), F.lit(feature)), F.lit("<NONE>"))
    rows = pairs.withColumns({"previous_upos": F.coalesce(F.lag("g.upos").over(w), F.lit("<BOS>")), "next_upos": F.coalesce(F.lead("g.upos").over(w), F.lit("<EOS>")), "gold_value": value("g"), "predicted_value": value("s")})
    return rows.filter("gold_value <> predicted_value").select(
        "sent_id", "tok_idx", F.col("g.form").alias("form"), F.col("g.upos").alias("gold_upos"), F.col("s.upos").alias("predicted_upos"), "previous_upos", "next_upos", "gold_value", "predicted_value",
        *(["freq_class"] if "freq_class" in pairs.columns else []),
    )


def error_audit(errors: DataFrame) -> DataFrame:
    """(dimension, key, n): one pass over the errors counts every dimension of the audit."""
    dims: dict[str, Column] = {
        "gold_upos": F.col("gold_upos"), "predicted_upos": F.col("predicted_upos"), "form": F.col("form"),
        "confusion": F.concat_ws(" > ", "gold_value", "predicted_value"), "context": F.concat_ws(" ", "previous_upos", "gold_upos", "next_upos"),
    }
    if "freq_class" in errors.columns:
        dims["freq_class"] = F.col("freq_class")
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), c.alias("key")) for k, c in dims.items()])
    return errors.select(F.inline(rows)).groupBy("dimension", "key").agg(F.count("*").alias("n"))


def ranked_counts(audit: DataFrame) -> DataFrame:
    """The audit's counts with their place in their dimension: most first, then by key (no dimension is one task)."""
    placed = reindexed(audit.withColumn("_fewest", -F.col("n")), "dimension", "_fewest", "key", name="rank")
    return placed.withColumn("rank", F.col("rank") + 1).drop("_fewest")


def compare_systems(triples: DataFrame, systems: tuple[str, str], features: tuple[str, ...]) -> DataFrame:
    """(system, feature, slice): annotated and correct tokens of two systems against gold, overall and by frequency class.

    ``triples`` has gold ``g``, the systems' annotation structs and ``freq_class``.
    """
    value = lambda side, f: F.coalesce(F.try_element_at(F.col(f"{side}.features"), F.lit(f)), F.lit("<NONE>"))
    # What each token says of every system and feature, so that a slice is counted in one pass without a row for each.
    gold = feature_bundle(F.col("g.features"))
    facts = [value("g", f).alias(f"g_{f}") for f in features] + [(gold == feature_bundle(F.col(f"{s}.features"))).alias(f"b_{s}") for s in systems]
    facts += [(value("g", f) == value(s, f)).alias(f"r_{s}_{f}") for s in systems for f in features]
    long = triples.select(F.explode(F.array(F.lit("all"), F.col("freq_class"))).alias("slice"), *facts)
    counts = []
    for s in systems:
        for f in features:
            right, annotated, bundle = F.col(f"r_{s}_{f}"), F.col(f"g_{f}") != "<NONE>", F.col(f"b_{s}")
            counts.append(F.struct(
                F.lit(s).alias("system"), F.lit(f).alias("feature"), F.count("*").alias("tokens"), F.count_if(right).alias("correct"), F.count_if(annotated).alias("annotated"),
                F.count_if(annotated & right).alias("annotated_correct"), F.count_if(~right & ~bundle).alias("wrong_bundle_and_feature"), F.count_if(right & ~bundle).alias("wrong_bundle_only"),
            ))
    return long.groupBy("slice").agg(F.array(*counts).alias("_c")).select("slice", F.inline("_c"))


def compare_values(triples: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """(system, feature, value, tp, fp, fn): each system's values of every feature against gold."""
    from nordlys.operators.evaluation import feature_counts

    each = [feature_counts(triples.select("g", F.col(s).alias("s"))).withColumn("system", F.lit(s)) for s in systems]
    return reduce(DataFrame.unionByName, each)


def score_candidates(tokens: DataFrame, candidates: DataFrame, upos: DataFrame, labels: dict[str, tuple[str, ...]], most: int = 4096) -> DataFrame:
    """Adds ``candidates``: of every token the evidence of every candidate bundle, log p(upos) plus the sum of log p(label).

    ``tokens`` has u (probabilities by UPOS id) and m (by feature, over its labels, the first of which is none).
    The candidates are a label schema (some UPOS times a few bundles, at most ``most``, or an error), so they come
    as one broadcast array and no pairs of rows are made.
    """
    pairs = F.expr("transform(filter(split(bundle, '[|]'), x -> x <> '_'), x -> struct(substring_index(x, '=', 1) as key, substring(x, instr(x, '=') + 1) as value))")
    parsed = candidates.join(small(upos, derived=True), "upos").select("candidate_id", "upos_id", F.map_from_entries(pairs).alias("f"))
    places = [F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.try_element_at("f", F.lit(name))) - 1, F.lit(0)).cast("int").alias(name) for name, values in labels.items()]
    one = parsed.select(F.struct("candidate_id", "upos_id", *places).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("_c"))
    one = one.select(F.when(F.size("_c") <= most, F.col("_c")).otherwise(F.raise_error(F.lit("more candidates than a label schema has")).cast(one.schema["_c"].dataType)).alias("_c"))
    logs = F.transform_values("m", lambda _, p: F.transform(p, lambda x: F.log(x)))
    staged = tokens.crossJoin(F.broadcast(one)).withColumns({"_u": F.transform("u", lambda x: F.log(x)), "_m": logs})  # one row

    def score(c: Column) -> Column:
        total = F.get("_u", c["upos_id"])
        for name in labels:
            total = total + F.get(F.element_at("_m", name), c[name])
        return F.struct(c["candidate_id"].alias("candidate_id"), total.alias("score"), *[c[name].alias(name) for name in labels])

    return staged.withColumn("candidates", F.transform("_c", score)).drop("_c", "_u", "_m")


def best_candidate(candidates: str) -> Column:
    """The candidate of most evidence, the first of equals."""
    return F.reduce(candidates, F.get(candidates, 0), lambda best, c: F.when(c["score"] > best["score"], c).otherwise(best))


def label_marginals(candidates: str, feature: str, labels: tuple[str, ...]) -> Column:
    """Map of each label some candidate has to its probability: the softmax of the candidates summed by label."""
    top = F.array_max(F.transform(candidates, lambda c: c["score"]))
    weight = lambda c: F.exp(c["score"] - top)
    total = F.aggregate(candidates, F.lit(0.0), lambda s, c: s + weight(c))

    def share(k: int, label: str) -> Column:
        own = F.filter(candidates, lambda c: c[feature] == k)
        return F.struct(F.lit(label).alias("key"), (F.aggregate(own, F.lit(0.0), lambda s, c: s + weight(c)) / total).alias("value"), (F.size(own) > 0).alias("held"))

    each = [share(k, label) for k, label in enumerate(labels)]
    return F.map_from_entries(F.transform(F.filter(F.array(*each), lambda e: e["held"]), lambda e: F.struct(e["key"], e["value"])))
