"""Label schemas built from training data, and the encoding of annotations with them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nordlys.functions.text import FIRST_LITERAL, nfc
from nordlys.session import small

NONE = "<NONE>"


def numbered(df: DataFrame, *order: str, name: str, start: int = 0) -> DataFrame:
    """Ids in sort order; schemas are small by nature (distinct labels), so one window may hold them."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy().orderBy(*order)) - 1 + start).cast("int"))


def upos_schema(tokens: DataFrame) -> DataFrame:
    """(upos_id, upos): distinct labels, sorted."""
    return numbered(tokens.select("upos").filter("upos is not null").distinct(), "upos", name="upos_id").select("upos_id", "upos")


def feature_rows(tokens: DataFrame, *keep: str) -> DataFrame:
    """One row per feature of a token: feature and value as written."""
    return tokens.select(*keep, F.explode("features").alias("feature", "value"))


def morphology_schema(tokens: DataFrame) -> DataFrame:
    """(feature, value_id, value, multi): values sorted; ``multi`` if any token had several at once."""
    rows = feature_rows(tokens).groupBy("feature", "value").count()
    multi = rows.groupBy("feature").agg(F.max(F.contains(F.col("value"), F.lit(","))).alias("multi"))
    single = rows.select("feature", F.explode(F.split("value", ",")).alias("value")).distinct()
    place = Window.partitionBy("feature").orderBy("value")
    return single.withColumn("value_id", F.row_number().over(place) - 1).join(small(multi), "feature").select("feature", "value_id", "value", "multi")


def feature_histogram(tokens: DataFrame) -> DataFrame:
    """Counts by feature and value with the features' totals, by ROLLUP (value null: the feature, both null: all)."""
    return feature_rows(tokens).rollup("feature", "value").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def lemma_rule_schema(rules: DataFrame) -> DataFrame:
    """(rule_id, pr, sr, pa, sa): distinct rules, sorted, numbered."""
    return numbered(rules.select("pr", "sr", "pa", "sa").distinct(), "pr", "sr", "pa", "sa", name="rule_id").select("rule_id", "pr", "sr", "pa", "sa")


def with_rule_id(rules: DataFrame, schema: DataFrame) -> DataFrame:
    """Left lookup: a rule the schema lacks has a null id."""
    return rules.join(small(schema, derived=True), ["pr", "sr", "pa", "sa"], "left")


def character_vocabulary(forms: DataFrame, least: int = 1, column: str = "form") -> DataFrame:
    """(char_id, char): composed characters that occur often enough, sorted, after the reserved ids."""
    chars = forms.select(F.explode(F.filter(F.split(nfc(F.col(column)), ""), lambda c: c != "")).alias("char"))
    return numbered(chars.groupBy("char").count().filter(F.col("count") >= least), "char", name="char_id", start=FIRST_LITERAL).select("char_id", "char", F.col("count").alias("n"))


def assert_known(tokens: DataFrame, schema: DataFrame, column: str) -> DataFrame:
    """The tokens, but an unknown label ends the query with an error that names it."""
    known = small(schema.select(F.col(column).alias("_known")).distinct(), derived=True)
    joined = tokens.join(known, F.col(column) == F.col("_known"), "left")
    checked = F.when(F.col(column).isNull() | F.col("_known").isNotNull(), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column))))
    return joined.withColumn(column, checked.cast("string")).drop("_known")


def encode_feature(value: Column, values: list[str], multi: bool) -> Column:
    """Booleans over (none, values...); null for a value the feature lacks or several where one is allowed."""
    parts = F.split(value, ",")
    labels = F.array(*[F.lit(v) for v in values])
    fine = (F.size(F.array_except(parts, labels)) == 0) & (F.lit(multi) | (F.size(parts) == 1))
    none = F.concat(F.array(F.lit(True)), F.transform(labels, lambda _: F.lit(False)))
    some = F.concat(F.array(F.lit(False)), F.transform(labels, lambda v: F.array_contains(parts, v)))
    return F.when(value.isNull(), none).when(fine, some)


def decode_feature(active: Column, values: list[str]) -> Column:
    """The value as written; null where the first label (none) is active."""
    labels = F.array(*[F.lit(v) for v in values])
    chosen = F.filter(labels, lambda v: F.get(active, F.array_position(labels, v).cast("int")))
    return F.when(~F.get(active, 0), F.array_join(chosen, ","))


def schema_json(upos: DataFrame, morphology: DataFrame, rules: DataFrame, characters: DataFrame | None = None) -> str:
    """The label schemas as one JSON text (they are dimension tables; what is collected is one row a label)."""
    features: dict[str, dict] = {}
    for r in morphology.orderBy("feature", "value_id").collect():
        features.setdefault(r["feature"], {"values": [], "allows_multiple_values": r["multi"]})["values"].append(r["value"])
    out = {
        "format_version": 1, "upos": [r["upos"] for r in upos.orderBy("upos_id").collect()], "morphology": features,
        "lemma_rules": [[r["pr"], r["sr"], r["pa"], r["sa"]] for r in rules.orderBy("rule_id").collect()],
    }
    if characters is not None:
        out["characters"] = [r["char"] for r in characters.orderBy("char_id").collect()]
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


def schema_of_json(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(upos, morphology, lemma rule) schemas of such a text; another format version is an error."""
    read = json.loads(text)
    if read.get("format_version") != 1:
        raise ValueError(f"unknown format of a label schema: {read.get('format_version')}")
    upos = spark.createDataFrame(list(enumerate(read["upos"])), "upos_id int, upos string")
    values = [(f, i, v, x["allows_multiple_values"]) for f, x in sorted(read["morphology"].items()) for i, v in enumerate(x["values"])]
    morphology = spark.createDataFrame(values, "feature string, value_id int, value string, multi boolean")
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(read["lemma_rules"])], "rule_id int, pr int, sr int, pa string, sa string")
    return upos, morphology, rules
