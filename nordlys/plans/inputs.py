"""Derived inputs of the queries over the driver's tables.

The tables hold no treebank, so operators on annotations run on annotations
made from the tokens by rules that SQL can state as well: part of speech by the
characters, lemma by cutting an ending, features by ending and length; the
"system" differs from them at fixed places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.operators import segmentation as seg
from nordlys.session import enough_tasks, table


def abbreviations(spark: SparkSession, sf: str) -> list[str]:
    """All policies' abbreviations: a configuration table, whose distinct entries are few by kind."""
    rows = table(spark, sf, "segmentation_policy").select(F.explode("abbreviation_tokens").alias("a")).distinct().collect()
    return [r["a"] for r in rows]


def policy(spark: SparkSession, sf: str, **limits) -> seg.Policy:
    return seg.policy_of(abbreviations(spark, sf), **limits)


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """silver_sentence with each sentence_id once (its repeats are exact)."""
    s = table(spark, sf, "silver_sentence").filter("sentence_id is not null")
    return s.groupBy("sentence_id").agg(F.min("document_id").alias("document_id"), F.min("sentence_index").alias("sentence_index"), F.first("tokens", ignorenulls=True).alias("tokens"), F.min("loaded_at").alias("loaded_at"))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """silver_label with the latest record of each key."""
    rows = table(spark, sf, "silver_label")
    rest = [c for c in rows.columns if c not in ("document_id", "sentence_index")]
    return rows.groupBy("document_id", "sentence_index").agg(F.max_by(F.struct(*rest), F.coalesce("labeled_at", F.lit("1970-01-01").cast("timestamp"))).alias("r")).select("document_id", "sentence_index", "r.*")


_UPOS = r"""CASE WHEN NOT {m}(form, {r}'[\p{{L}}\p{{N}}]') THEN 'PUNCT' WHEN {m}(form, {r}'^\p{{N}}') THEN 'NUM'
  WHEN tok_idx > 0 AND {m}(form, {r}'^\p{{Lu}}') THEN 'PROPN' WHEN length(form) <= 3 THEN 'ADP' ELSE 'NOUN' END"""
_PARTS = r"""tok_idx, sent_id, form, upos,
  CASE WHEN upos = 'PUNCT' THEN '_' WHEN {m}(lower(form), {r}'^.+(ene|en|et|er)$') THEN regexp_replace(lower(form), {r}'(ene|en|et|er)$', '') ELSE lower(form) END AS lemma,
  CASE WHEN upos IN ('NOUN', 'PROPN') THEN CASE WHEN {m}(form, {r}'(er|ene|s)$') THEN 'Plur' ELSE 'Sing' END END AS number,
  CASE WHEN upos = 'NOUN' THEN CASE WHEN {m}(form, {r}'(en|et|ene)$') THEN 'Def' ELSE 'Ind' END END AS definite,
  CASE WHEN upos = 'NOUN' THEN CASE length(form) % 3 WHEN 0 THEN 'Fem,Masc' WHEN 1 THEN 'Neut' ELSE 'Masc' END END AS gender,
  (sent_id * 31 + tok_idx * 7) % 13 AS k"""
_SYSTEM = """tok_idx, sent_id, form, CASE WHEN k = 0 THEN 'X' ELSE upos END AS upos, CASE WHEN k = 3 THEN lower(form) ELSE lemma END AS lemma,
  CASE WHEN k = 1 THEN CASE number WHEN 'Sing' THEN 'Plur' WHEN 'Plur' THEN 'Sing' END ELSE number END AS number, definite,
  CASE WHEN k = 2 AND gender IS NOT NULL THEN 'Neut' ELSE gender END AS gender"""

#: Case folding of a composed string {x}, as far as DuckDB's ``lower`` leaves it undone in these tables.
SQL_FOLD = "lower({x})"
for _from, _to in (("ß", "ss"), ("ς", "σ"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ſ", "s")):
    SQL_FOLD = f"replace({SQL_FOLD}, '{_from}', '{_to}')"

#: The same inputs as DuckDB common table expressions: tok, gold, system.
SQL_TOKENS = (
    "sent AS (SELECT sentence_id, min(document_id) AS document_id, min(sentence_index) AS sentence_index, first(tokens) AS tokens FROM silver_sentence WHERE sentence_id IS NOT NULL GROUP BY 1), "
    "tok AS (SELECT * FROM (SELECT sentence_id AS sent_id, unnest(tokens) AS form, generate_subscripts(tokens, 1) - 1 AS tok_idx FROM sent) WHERE form <> ''), "
    "u AS (SELECT *, " + _UPOS.format(m="regexp_matches", r="") + " AS upos FROM tok), "
    "gold AS (SELECT " + _PARTS.format(m="regexp_matches", r="") + " FROM u), "
    "system AS (SELECT " + _SYSTEM + " FROM gold)"
)
#: The evaluation items' tokens and annotations: itok, igold.
SQL_ITEMS = (
    "itok AS (SELECT * FROM (SELECT item_id AS sent_id, unnest(tokens) AS form, generate_subscripts(tokens, 1) - 1 AS tok_idx FROM evaluation_item) WHERE form <> ''), "
    "iu AS (SELECT *, " + _UPOS.format(m="regexp_matches", r="") + " AS upos FROM itok), "
    "igold AS (SELECT " + _PARTS.format(m="regexp_matches", r="") + " FROM iu)"
)
#: A feature bundle of the columns number, definite, gender in SQL.
SQL_BUNDLE = "coalesce(nullif(concat_ws('|', 'Definite=' || {p}definite, 'Gender=' || {p}gender, 'Number=' || {p}number), ''), '_')"


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(sent_id, tok_idx, form) of the silver sentences, null and empty tokens left out."""
    s = enough_tasks(sentences(spark, sf).select("sentence_id", "tokens"), "sentence_id")
    return s.select(F.col("sentence_id").alias("sent_id"), F.posexplode("tokens").alias("tok_idx", "form")).filter("form <> ''")


def _features() -> Column:
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in (("Number", "number"), ("Definite", "definite"), ("Gender", "gender"))])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def item_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(sent_id, tok_idx, form) of the evaluation items."""
    items = enough_tasks(table(spark, sf, "evaluation_item").select("item_id", "tokens"), "item_id")
    return items.select(F.col("item_id").alias("sent_id"), F.posexplode("tokens").alias("tok_idx", "form")).filter("form <> ''")


def item_gold(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(item_tokens(spark, sf))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return annotated(tokens(spark, sf))


def annotated(rows: DataFrame) -> DataFrame:
    with_upos = rows.select("*", F.expr(_UPOS.format(m="regexp_like", r="r")).alias("upos"))
    return _select(with_upos, _PARTS.format(m="regexp_like", r="r")).withColumn("features", _features())


def system(spark: SparkSession, sf: str) -> DataFrame:
    return _select(gold(spark, sf).drop("features"), _SYSTEM).withColumn("features", _features())


def _select(df: DataFrame, columns: str) -> DataFrame:
    return df.sparkSession.sql(f"SELECT {columns} FROM {{df}}", df=df)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Gold and system side by side (columns g, s), made in one pass: both come from the same tokens."""
    g = gold(spark, sf)
    s = _select(g.drop("features"), _SYSTEM + ", upos AS g_upos, lemma AS g_lemma, number AS g_number, definite AS g_definite, gender AS g_gender")

    def features(p: str):
        items = F.array(*[F.struct(F.lit(n).alias("key"), F.col(p + c).alias("value")) for n, c in (("Number", "number"), ("Definite", "definite"), ("Gender", "gender"))])
        return F.map_from_entries(F.filter(items, lambda x: x["value"].isNotNull()))

    return s.select("sent_id", "tok_idx", F.struct("form", F.col("g_upos").alias("upos"), F.col("g_lemma").alias("lemma"), features("g_").alias("features")).alias("g"), F.struct("form", "upos", "lemma", features("").alias("features")).alias("s"))
