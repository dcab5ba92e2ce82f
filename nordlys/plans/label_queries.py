"""Queries on annotations, labels and scores, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.functions import vectors as V
from nordlys.operators import annotate, bundles, evaluation, probability, ranges, schema, subword
from nordlys.operators import segmentation as seg
from nordlys.plans import inputs
from nordlys.plans.inputs import SQL_BUNDLE, SQL_FOLD, SQL_ITEMS, SQL_TOKENS
from nordlys.session import enough_tasks, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


_T = "WITH " + SQL_TOKENS
_GB, _SB = SQL_BUNDLE.format(p="g."), SQL_BUNDLE.format(p="s.")
_UNI_G = _GB  # all three features are universal ones
_PAIRS = _T + f", pr AS (SELECT g.sent_id, g.tok_idx, g.form, g.upos AS gu, s.upos AS su, g.lemma AS gl, s.lemma AS sl, g.number AS gn, s.number AS sn, g.gender AS gg, s.gender AS sg, g.definite AS gd, s.definite AS sd, {_GB} AS gb, {_SB} AS sb FROM gold g JOIN system s USING (sent_id, tok_idx))"


# --- schemas


@query(_T + " SELECT (row_number() OVER (ORDER BY upos) - 1)::INT AS upos_id, upos FROM (SELECT DISTINCT upos FROM gold)")
def upos_schema(spark: SparkSession, sf: str) -> DataFrame:
    return schema.upos_schema(inputs.gold(spark, sf))


_LONG = ", f AS (SELECT 'Number' AS feature, number AS value FROM gold UNION ALL SELECT 'Definite', definite FROM gold UNION ALL SELECT 'Gender', gender FROM gold), fv AS (SELECT * FROM f WHERE value IS NOT NULL)"


@query(_T + _LONG + """, m AS (SELECT feature, bool_or(contains(value, ',')) AS multi FROM fv GROUP BY 1), v AS (SELECT DISTINCT feature, unnest(string_split(value, ',')) AS value FROM fv)
SELECT v.feature, (row_number() OVER (PARTITION BY v.feature ORDER BY value) - 1)::INT AS value_id, value, multi FROM v JOIN m USING (feature)""")
def morph_schema(spark: SparkSession, sf: str) -> DataFrame:
    return schema.morphology_schema(inputs.gold(spark, sf))


@query(_T + _LONG + " SELECT feature, value, count(*) AS n, grouping(feature, value)::INT AS level FROM fv GROUP BY ROLLUP (feature, value)")
def morph_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return schema.feature_histogram(inputs.gold(spark, sf))


@query(_T + """ SELECT CASE WHEN gender IS NULL THEN 'TFFF' ELSE 'F' || CASE WHEN list_contains(string_split(gender, ','), 'Fem') THEN 'T' ELSE 'F' END || CASE WHEN list_contains(string_split(gender, ','), 'Masc') THEN 'T' ELSE 'F' END
  || CASE WHEN gender = 'Neut' THEN 'T' ELSE 'F' END END AS encoded, gender AS decoded, count(*) AS n FROM gold GROUP BY 1, 2""")
def morph_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Gender as booleans over (none, Fem, Masc, Neut), and back."""
    values = ["Fem", "Masc", "Neut"]
    e = inputs.gold(spark, sf).select(schema.encode_feature(F.col("gender"), values, True).alias("e"))
    flat = e.select(F.array_join(F.transform("e", lambda b: F.when(b, "T").otherwise("F")), "").alias("encoded"), schema.decode_feature(F.col("e"), values).alias("decoded"))
    return flat.groupBy("encoded", "decoded").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_ITEMS} SELECT upos, count(*) AS n FROM igold GROUP BY 1")
def known_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation items' labels counted behind the assertion that the silver corpus's schema knows them."""
    known = schema.upos_schema(inputs.gold(spark, sf))
    return schema.assert_known(inputs.item_gold(spark, sf).select("upos"), known, "upos").groupBy("upos").agg(F.count("*").alias("n"))


# --- evaluation


@query(_PAIRS + """ SELECT slice, count(*) AS tokens, count(*) FILTER (gu = su) AS upos_correct, count(*) FILTER (gb = sb) AS ufeats_correct, count(*) FILTER (gl = '_' OR gl = sl) AS lemma_correct,
  round(count(*) FILTER (gu = su) / count(*), 6) AS upos_f1, round(count(*) FILTER (gb = sb) / count(*), 6) AS ufeats_f1, round(count(*) FILTER (gl = '_' OR gl = sl) / count(*), 6) AS lemma_f1
  FROM (SELECT *, unnest(['all', gu]) AS slice FROM pr) GROUP BY 1""")
def ud_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Overall and by gold UPOS."""
    m = evaluation.ud_metrics_with_slices(inputs.pairs(spark, sf).withColumn("gu", F.col("g.upos")), "gu")
    return m.select("slice", "tokens", "upos_correct", "ufeats_correct", "lemma_correct", *[r6(F.col(c)).alias(c) for c in ("upos_f1", "ufeats_f1", "lemma_f1")])


@query(_PAIRS + """, st0 AS (SELECT gb, sb, CASE WHEN su = 'NOUN' THEN regexp_replace(sb, 'Gender=Fem,Masc', 'Gender=Com') ELSE sb END AS b1 FROM pr), st AS (SELECT gb, sb AS b0, b1, regexp_replace(b1, '(\\|Number=Sing|Number=Sing)$', '') AS b2x FROM st0),
s2 AS (SELECT gb, b0, b1, CASE WHEN b2x = '' THEN '_' ELSE b2x END AS b2 FROM st), l AS (SELECT 0 AS step_no, 'common gender' AS step, gb, b0 AS a, b1 AS b FROM s2 UNION ALL SELECT 1, 'no singular', gb, b1, b2 FROM s2)
SELECT step_no::INT AS step_no, step, count(*) FILTER (a <> b) AS changed, count(*) FILTER (a <> gb AND b = gb) AS improved, count(*) FILTER (a = gb AND b <> gb) AS regressed FROM l GROUP BY 1, 2""")
def ud_policy_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Two policy steps on the system's features: common gender, then singular dropped."""
    p = inputs.pairs(spark, sf)
    gold, start = X.feature_bundle(F.col("g.features")), F.col("s.features")
    first = X.common_gender(F.when(F.col("s.upos") == "NOUN", "ADJ").otherwise(F.col("s.upos")), start)  # nouns, which have gender here, stand for adjectives
    second = X.drop_value(first, "Number", "Sing")
    staged = p.select(gold.alias("gb"), X.feature_bundle(start).alias("b0"), X.feature_bundle(first).alias("b1"), X.feature_bundle(second).alias("b2"))
    return evaluation.policy_audit(staged, F.col("gb"), F.col("b0"), [("common gender", F.col("b1")), ("no singular", F.col("b2"))])


_FC = _PAIRS + """, lg AS (SELECT 'Number' AS feature, gn AS g, sn AS s FROM pr UNION ALL SELECT 'Gender', gg, sg FROM pr UNION ALL SELECT 'Definite', gd, sd FROM pr),
ls AS (SELECT feature, coalesce(string_split(g, ','), []) AS g, coalesce(string_split(s, ','), []) AS s FROM lg),
k AS (SELECT feature, unnest(list_filter(g, lambda x: list_contains(s, x))) AS value, 'tp' AS kind FROM ls UNION ALL SELECT feature, unnest(list_filter(s, lambda x: NOT list_contains(g, x))), 'fp' FROM ls UNION ALL SELECT feature, unnest(list_filter(g, lambda x: NOT list_contains(s, x))), 'fn' FROM ls),
fc AS (SELECT feature, value, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM k GROUP BY 1, 2)"""
_PRF = "tp, fp, fn, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


def _prf(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "fn", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query(_FC + f" SELECT feature, value, {_PRF} FROM fc")
def classification_by_value(spark: SparkSession, sf: str) -> DataFrame:
    return _prf(evaluation.classification(evaluation.feature_counts(inputs.pairs(spark, sf))), "feature", "value")


@query(_FC + f" SELECT feature, {_PRF} FROM (SELECT feature, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM fc GROUP BY 1)")
def micro_prf(spark: SparkSession, sf: str) -> DataFrame:
    return _prf(evaluation.micro_average(evaluation.feature_counts(inputs.pairs(spark, sf)), "feature"), "feature")


@query(_PAIRS + """, r AS (SELECT *, CASE WHEN length(form) < 12 THEN length(gl) END AS gr, length(sl) AS sr FROM pr), c AS (SELECT gu AS upos, count(*) AS tokens, count(*) FILTER (gu = su) AS upos_correct, count(*) FILTER (gb = sb) AS bundle_correct,
  count(*) FILTER (gl <> '_') AS lemma_annotated, count(*) FILTER (gl <> '_' AND gr IS NOT NULL) AS lemma_targets, count(*) FILTER (gl <> '_' AND gr = sr) AS lemma_correct FROM r GROUP BY 1)
SELECT upos, tokens, upos_correct, bundle_correct, lemma_annotated, lemma_targets, lemma_correct, round(upos_correct / tokens, 6) AS upos_accuracy, round(bundle_correct / tokens, 6) AS bundle_accuracy,
  round(lemma_correct / nullif(lemma_targets, 0), 6) AS lemma_accuracy, round(lemma_targets / nullif(lemma_annotated, 0), 6) AS lemma_coverage, round(lemma_correct / nullif(lemma_annotated, 0), 6) AS lemma_end_to_end FROM c""")
def task_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token-task counts and ratios by UPOS; the lemma's length stands for its rule, unknown for long forms."""
    p = inputs.pairs(spark, sf)
    g = F.col("g").withField("rule_id", F.when(F.length("g.form") < 12, F.length("g.lemma")))
    m = evaluation.task_metrics(p.select(g.alias("g"), F.col("s").withField("rule_id", F.length("s.lemma")).alias("s"), F.col("g.upos").alias("upos")), "upos")
    ratios = ("upos_accuracy", "bundle_accuracy", "lemma_accuracy", "lemma_coverage", "lemma_end_to_end")
    return m.select(*[c for c in m.columns if c not in ratios], *[r6(F.col(c)).alias(c) for c in ratios])


_DECODED = """lt AS (SELECT document_id, sentence_index, unnest(u) AS u, unnest(li) AS li, unnest(lp) AS lp, unnest(au) AS au, unnest(al) AS al, unnest(nu) AS nu, unnest(range(0, len(u))) AS tok_idx FROM
  (SELECT document_id, sentence_index, upos_probabilities AS u, list_resize(coalesce(lemma_rule_ids, []), n) AS li, list_resize(coalesce(lemma_rule_probabilities, []), n) AS lp, list_resize(coalesce(agreement_upos_ids, []), n) AS au, list_resize(coalesce(agreement_lemma_rule_ids, []), n) AS al, list_resize(coalesce(number, []), n) AS nu
   FROM (SELECT document_id, sentence_index, list_resize(coalesce(upos_probabilities, []), n) AS upos_probabilities, lemma_rule_ids, lemma_rule_probabilities, agreement_upos_ids, agreement_lemma_rule_ids, number, n FROM lab) x)),
ok AS (SELECT *, coalesce(len(u) > 0 AND len(list_filter(u, lambda x: x IS NULL OR isnan(x))) = 0, false) AS us, coalesce(len(lp) > 0 AND len(list_filter(lp, lambda x: x IS NULL OR isnan(x))) = 0, false) AS ls, coalesce(len(nu) > 0 AND len(list_filter(nu, lambda x: x IS NULL OR isnan(x))) = 0, false) AS ns FROM lt),
tl AS (SELECT document_id, sentence_index, tok_idx, CASE WHEN us THEN list_position(u, list_max(u)) - 1 END AS upos_id, CASE WHEN us THEN list_max(u)::DOUBLE END AS uc, CASE WHEN ls THEN li[list_position(lp, list_max(lp))] END AS rule_id, CASE WHEN ls THEN list_max(lp)::DOUBLE END AS lc, CASE WHEN ns THEN list_position(nu, list_max(nu)) - 1 END AS number_id, CASE WHEN ns THEN list_max(nu)::DOUBLE END AS mc, au, al FROM ok)"""
_LAB = """WITH lab0 AS (SELECT *, row_number() OVER (PARTITION BY document_id, sentence_index ORDER BY labeled_at DESC NULLS LAST) AS rn FROM silver_label),
lab AS (SELECT *, greatest(coalesce(len(upos_probabilities), 0), coalesce(len(lemma_rule_ids), 0), coalesce(len(lemma_rule_probabilities), 0), coalesce(len(agreement_upos_ids), 0), coalesce(len(agreement_lemma_rule_ids), 0), coalesce(len(number), 0)) AS n FROM (SELECT *, morphology_probabilities['Number'] AS number FROM lab0) WHERE rn = 1), """ + _DECODED


def _token_labels(spark: SparkSession, sf: str) -> DataFrame:
    return probability.token_labels(inputs.labels(spark, sf))


@query(_LAB + """, s AS (SELECT uc AS score, (upos_id = au) AS target FROM tl WHERE uc IS NOT NULL AND au IS NOT NULL), t AS (SELECT score, count(*) FILTER (target) AS pos, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM t) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision, sum(pos)::BIGINT AS positives FROM w""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Of the UPOS confidence as a predictor of agreement."""
    s = _token_labels(spark, sf).filter("upos_confidence is not null and agreed_upos_id is not null").select(F.col("upos_confidence").alias("score"), (F.col("upos_id") == F.col("agreed_upos_id")).alias("target"))
    return evaluation.average_precision(s).select(r6(F.col("average_precision")).alias("average_precision"), "positives")


@query(_T + """, c AS (SELECT *, CASE WHEN length(form) < 12 THEN 1 END AS rid FROM gold) SELECT count(*) AS tokens, count(*) FILTER (lemma <> '_') AS lemma_annotated, count(*) FILTER (lemma <> '_' AND rid IS NULL) AS unknown_rules FROM c""")
def corpus_counters(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.corpus_counters(inputs.gold(spark, sf).withColumn("rule_id", F.when(F.length("form") < 12, 1)))


@query("SELECT round(sum(value * user_id) / sum(user_id), 6) AS upos_loss, round(sum(value * (event_id % 7)) / sum(event_id % 7), 6) AS lemma_loss FROM events")
def epoch_loss_means(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("value").alias("upos_loss"), F.col("value").alias("lemma_loss"), F.col("user_id").alias("n"), (F.col("event_id") % 7).alias("k"))
    m = evaluation.weighted_means(e, {"upos_loss": "n", "lemma_loss": "k"})
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(user_id) / sum(value), 6) AS tokens_per_second FROM events GROUP BY 1")
def speed_statistics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluation.latency(table(spark, sf, "events"), "value", "user_id", "event_type")
    return m.select("event_type", *[r6(F.col(c)).alias(c) for c in m.columns[1:]])


@query("SELECT vec_id, round(list_max(list_transform(embedding[1:8], lambda x, i: abs(x::DOUBLE - embedding[i + 8]::DOUBLE))), 6) AS difference FROM embeddings")
def parity_max_diff(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", r6(evaluation.max_difference(F.slice("embedding", 1, 8), F.slice("embedding", 9, 8))).alias("difference"))


# --- bundles and audits


_INV = _T + f", inv AS (SELECT upos, b AS bundle, count(*) AS cnt, row_number() OVER (PARTITION BY upos ORDER BY count(*) DESC, b) AS rank FROM (SELECT upos, {SQL_BUNDLE.format(p='')} AS b FROM gold) GROUP BY 1, 2)"


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.bundle_inventory(inputs.gold(spark, sf))


@query(_INV + " SELECT upos, bundle, cnt, rank::INT AS rank FROM inv")
def bundle_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _inventory(spark, sf)


@query(_INV + " SELECT (row_number() OVER (ORDER BY upos, rank) - 1)::INT AS candidate_id, upos, bundle, cnt, rank::INT AS rank FROM inv WHERE rank <= 4")
def bundle_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.bundle_candidates(_inventory(spark, sf), 4)


@query(_INV + f""", {SQL_ITEMS}, d AS (SELECT upos, {SQL_BUNDLE.format(p='')} AS bundle FROM igold), j AS (SELECT d.*, inv.rank, d.bundle IN (SELECT bundle FROM inv) AS known FROM d LEFT JOIN inv USING (upos, bundle)),
s AS (SELECT *, unnest(CASE WHEN bundle <> '_' THEN ['all', 'annotated'] ELSE ['all'] END) AS slice FROM j)
SELECT slice, count(*) AS tokens, count(*) FILTER (known) AS seen, count(*) FILTER (rank IS NOT NULL) AS seen_with_upos, count(*) FILTER (rank <= 1) AS top_1, count(*) FILTER (rank <= 2) AS top_2, count(*) FILTER (rank <= 4) AS top_4, count(*) FILTER (rank <= 8) AS top_8, count(*) FILTER (rank <= 16) AS top_16, count(*) FILTER (rank <= 32) AS top_32 FROM s GROUP BY 1""")
def bundle_oracle(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.bundle_oracle(inputs.item_gold(spark, sf), _inventory(spark, sf))


@query(_INV + " SELECT sum(cnt)::BIGINT AS examples, sum(n)::BIGINT AS pairs, max(n) AS max_per_upos, (SELECT count(DISTINCT bundle) FROM inv) AS bundles FROM (SELECT upos, count(*) AS n, sum(cnt) AS cnt FROM inv GROUP BY 1)")
def bundle_summary(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.inventory_summary(_inventory(spark, sf))


_ERR = _PAIRS + f", {SQL_ITEMS}, pc AS (SELECT {SQL_FOLD.format(x='nfc_normalize(form)')} AS f," + """ count(*) AS cnt FROM itok GROUP BY 1),
ctx AS (SELECT pr.*, coalesce(lag(gu) OVER w, '<BOS>') AS pu, coalesce(lead(gu) OVER w, '<EOS>') AS nu, CASE WHEN coalesce(cnt, 0) = 0 THEN 'oov' WHEN cnt <= 5 THEN 'rare' ELSE 'frequent' END AS fc
  FROM pr LEFT JOIN pc ON """ + SQL_FOLD.format(x="nfc_normalize(pr.form)") + """ = pc.f WINDOW w AS (PARTITION BY sent_id ORDER BY tok_idx)),
er AS (SELECT *, coalesce(gn, '<NONE>') AS gv, coalesce(sn, '<NONE>') AS sv FROM ctx WHERE coalesce(gn, '<NONE>') <> coalesce(sn, '<NONE>'))"""


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    p = inputs.pairs(spark, sf)
    profile = evaluation.frequency_profile(inputs.item_tokens(spark, sf))
    return evaluation.with_frequency_class(p.withColumn("form", F.col("g.form")), profile)


@query(_ERR + """ SELECT dimension, key, count(*) AS n, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, key)::INT AS rank FROM (SELECT unnest(['gold_upos', 'predicted_upos', 'form', 'confusion', 'context', 'freq_class']) AS dimension, unnest([gu, su, form, gv || ' > ' || sv, pu || ' ' || gu || ' ' || nu, fc]) AS key FROM er) GROUP BY 1, 2""")
def error_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of one feature (Number) by every dimension, in one pass."""
    return bundles.ranked_counts(bundles.error_audit(bundles.feature_errors(_classed(spark, sf), "Number")))


@query(_ERR + """, t AS (SELECT gv || ' > ' || sv AS name, count(*) AS errors FROM er GROUP BY 1) SELECT name, errors, round(errors / sum(errors) OVER (), 6) AS share FROM t""")
def error_shares(spark: SparkSession, sf: str) -> DataFrame:
    e = bundles.feature_errors(inputs.pairs(spark, sf), "Number").groupBy(F.concat_ws(" > ", "gold_value", "predicted_value").alias("name")).agg(F.count("*").alias("errors"))
    return evaluation.error_shares(e).select("name", "errors", r6(F.col("share")).alias("share"))


@query(_ERR + """, l AS (SELECT unnest(['all', fc]) AS slice, gn, sn, gg, sg, gb, sb FROM ctx),
v AS (SELECT slice, 'system' AS system, 'Number' AS feature, coalesce(gn, '<NONE>') AS g, coalesce(sn, '<NONE>') AS f, gb = sb AS br FROM l UNION ALL SELECT slice, 'system', 'Gender', coalesce(gg, '<NONE>'), coalesce(sg, '<NONE>'), gb = sb FROM l
  UNION ALL SELECT slice, 'plain', 'Number', coalesce(gn, '<NONE>'), '<NONE>', gb = '_' FROM l UNION ALL SELECT slice, 'plain', 'Gender', coalesce(gg, '<NONE>'), '<NONE>', gb = '_' FROM l)
SELECT system, feature, slice, count(*) AS tokens, count(*) FILTER (g = f) AS correct, count(*) FILTER (g <> '<NONE>') AS annotated, count(*) FILTER (g <> '<NONE>' AND g = f) AS annotated_correct, count(*) FILTER (g <> f AND NOT br) AS wrong_bundle_and_feature, count(*) FILTER (g = f AND NOT br) AS wrong_bundle_only FROM v GROUP BY 1, 2, 3""")
def feature_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The system against one that gives no features."""
    t = _classed(spark, sf).withColumn("system", F.col("s")).withColumn("plain", F.col("s").withField("features", F.create_map().cast("map<string,string>")))
    return bundles.compare_systems(t, ("system", "plain"), ("Number", "Gender"))


@query(_FC + """, pk AS (SELECT feature, unnest(g) AS value FROM ls), pl AS (SELECT feature, value, 0 AS tp, 0 AS fp, count(*) AS fn FROM pk GROUP BY 1, 2)
SELECT 'system' AS system, feature, value, tp, fp, fn FROM fc UNION ALL SELECT 'plain', feature, value, tp, fp, fn FROM pl""")
def feature_values(spark: SparkSession, sf: str) -> DataFrame:
    """Both systems' true and false positives and false negatives by value."""
    t = inputs.pairs(spark, sf).withColumn("system", F.col("s")).withColumn("plain", F.col("s").withField("features", F.create_map().cast("map<string,string>")))
    return bundles.compare_values(t, ("system", "plain")).select("system", "feature", "value", "tp", "fp", "fn")


# --- scores (embeddings as logits)

_Z = "WITH z AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * 10) AS z, list_transform(embedding[9:16], lambda x: x::DOUBLE * 10) AS t, (vec_id % 8)::INT AS label FROM embeddings), e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ez, list_transform(t, lambda x: exp(x - list_max(t))) AS et FROM z), p AS (SELECT *, list_transform(ez, lambda x: x / list_sum(ez)) AS p, list_transform(et, lambda x: x / list_sum(et)) AS q FROM e)"


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    scale = lambda a, b: F.transform(F.slice("embedding", a, b), lambda x: x.cast("double") * 10)
    return enough_tasks(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id").select("vec_id", scale(1, 8).alias("z"), scale(9, 8).alias("t"), (F.col("vec_id") % 8).cast("int").alias("label"))


def _text6(a: Column) -> Column:
    return F.transform(a, lambda x: F.round(x, 6))


@query(_Z + " SELECT vec_id, (list_position(z, list_max(z)) - 1)::INT AS best, round(list_max(p), 6) AS confidence, unnest(range(0, 8))::INT AS label_no, round(unnest(p), 6) AS score FROM p")
def softmax_decode(spark: SparkSession, sf: str) -> DataFrame:
    return _logits(spark, sf).select("vec_id", V.argmax(F.col("z")).alias("best"), r6(F.array_max(V.softmax(F.col("z")))).alias("confidence"), F.posexplode(_text6(V.softmax(F.col("z")))).alias("label_no", "score"))


@query(_Z + ", s AS (SELECT vec_id, z, list_transform(z, lambda x: 1 / (1 + exp(-x))) AS s FROM z) SELECT vec_id, unnest(range(0, 9))::INT AS label_no, round(unnest(list_concat([list_product(list_transform(s, lambda x: 1 - x))], s)), 6) AS score, unnest(list_concat([len(list_filter(z, lambda x: x > 0)) = 0], list_transform(z, lambda x: x > 0))) AS active FROM s")
def sigmoid_multi(spark: SparkSession, sf: str) -> DataFrame:
    both = F.arrays_zip(_text6(V.label_scores(F.col("z"), True)).alias("score"), V.hard_decode(F.col("z"), True).alias("active"))
    return _logits(spark, sf).select("vec_id", F.posexplode(both).alias("label_no", "x")).select("vec_id", "label_no", "x.score", "x.active")


@query(_Z + " SELECT vec_id, unnest(range(0, 8))::INT AS label_no, round(unnest(list_transform(z, lambda x, i: x - 0.25 * ln(i + 1))), 6) AS corrected FROM z")
def logit_correction(spark: SparkSession, sf: str) -> DataFrame:
    weights = F.array(*[F.lit(float(i + 2)) for i in range(8)])
    return _logits(spark, sf).select("vec_id", F.posexplode(_text6(V.logit_correction(F.col("z"), weights, 0.25))).alias("label_no", "corrected"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * 10 / 1.7) AS z FROM embeddings), e AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z), p AS (SELECT vec_id, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p, unnest(range(0, 8)) AS id FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, id) AS rank FROM p) SELECT vec_id, rank::INT AS rank, id::INT AS id, round(p, 6) AS p FROM r WHERE rank <= 3""")
def calibrated_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three likeliest labels at temperature 1.7."""
    ids = F.array(*[F.lit(i) for i in range(8)])
    top = _logits(spark, sf).select("vec_id", F.posexplode(V.top_k(ids, V.softmax(F.col("z"), 1.7), 3)).alias("k", "x"))
    return top.select("vec_id", (F.col("k") + 1).alias("rank"), F.col("x.id").alias("id"), r6(F.col("x.p")).alias("p"))


@query(_Z + """ SELECT vec_id, round(-ln(p[label + 1]), 6) AS cross_entropy, round(list_sum(list_transform(z, lambda x, i: greatest(x, 0) - CASE WHEN i - 1 = label THEN x ELSE 0 END + ln(1 + exp(-abs(x))))) / 8, 6) AS binary, round(-list_sum(list_transform(q, lambda x, i: x * ln(p[i]))), 6) AS soft FROM p""")
def losses(spark: SparkSession, sf: str) -> DataFrame:
    z = _logits(spark, sf)
    one = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i == F.col("label"))
    return z.select("vec_id", r6(V.cross_entropy(F.col("z"), F.col("label"))).alias("cross_entropy"), r6(V.binary_cross_entropy(F.col("z"), one)).alias("binary"), r6(V.soft_cross_entropy(F.col("z"), V.softmax(F.col("t")))).alias("soft"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE * 10 / 2) AS z, list_transform(embedding[9:16], lambda x: x::DOUBLE * 10 / 2) AS t, (vec_id % 8 + 1) AS y FROM embeddings), e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS ez, list_transform(t, lambda x: exp(x - list_max(t))) AS et FROM z),
p AS (SELECT vec_id, y, list_transform(ez, lambda x: x / list_sum(ez)) AS q, list_transform(et, lambda x: x / list_sum(et)) AS p FROM e), d AS (SELECT *, p[y] AS pt, q[y] AS qt FROM p)
SELECT vec_id, round(4 * list_sum(list_transform(p, lambda x, i: x * ln(x / q[i]))), 6) AS kl,
  round(4 * (1.0 * (pt * ln(pt / qt) + (1 - pt) * ln((1 - pt) / (1 - qt))) + 2.0 * list_sum(list_transform(p, lambda x, i: CASE WHEN i = y THEN 0 ELSE x / (1 - pt) * ln(x / (1 - pt) * (1 - qt) / q[i]) END))), 6) AS decoupled FROM d""")
def kd_losses(spark: SparkSession, sf: str) -> DataFrame:
    z = _logits(spark, sf)
    return z.select("vec_id", r6(V.kl_divergence(F.col("z"), F.col("t"), 2.0)).alias("kl"), r6(V.decoupled_kl(F.col("z"), F.col("t"), F.col("label"), 1.0, 2.0, 2.0)).alias("decoupled"))


@query(_Z + ", r AS (SELECT label, 1 + len(list_filter(z, lambda x: x > z[label + 1])) AS rank FROM z) SELECT label, count(*) AS n, round(avg((rank <= 1)::INT), 6) AS top_1, round(avg((rank <= 2)::INT), 6) AS top_2, round(avg((rank <= 5)::INT), 6) AS top_5, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr FROM r GROUP BY 1")
def rank_audit(spark: SparkSession, sf: str) -> DataFrame:
    m = probability.rank_audit(_logits(spark, sf).select("label", V.rank_of(F.col("z"), F.col("label")).alias("rank")), "label")
    return m.select("label", "n", *[r6(F.col(c)).alias(c) for c in ("top_1", "top_2", "top_5", "mean_rank", "mrr")])


@query(_Z + ", g AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]) AS temperature), l AS (SELECT temperature, ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / temperature)))) - (z[label + 1] - list_max(z)) / temperature AS loss FROM z, g) SELECT temperature::DOUBLE AS temperature, round(avg(loss), 6) AS nll FROM l GROUP BY 1")
def nll_grid(spark: SparkSession, sf: str) -> DataFrame:
    return probability.nll_grid(_logits(spark, sf), [0.5, 1.0, 2.0, 4.0]).select("temperature", r6(F.col("nll")).alias("nll"))


@query()
def temperature_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Two-stage grid search; tested against synthetic logits of a known scale."""
    t, nll = probability.fit_temperature(_logits(spark, sf))
    return spark.createDataFrame([(round(t, 6), round(nll, 6))], "temperature double, nll double")


@query(_Z + " SELECT vec_id, unnest(range(0, 8))::INT AS label_no, round(unnest(list_transform(z, lambda x, i: x + 1 / (1 + exp(-0.5)) * ln(least(greatest(q[i], 1e-6), 1 - 1e-6)))), 6) AS refined FROM p")
def bundle_refinement(spark: SparkSession, sf: str) -> DataFrame:
    return _logits(spark, sf).select("vec_id", F.posexplode(_text6(V.gated_refinement(F.col("z"), V.softmax(F.col("t")), 0.5, False))).alias("label_no", "refined"))


@query("WITH c AS (SELECT event_type AS label, count(*) AS pos FROM events GROUP BY 1) SELECT label, pos, round(least(10, sqrt(greatest(1, (sum(pos) OVER () - pos) / pos))), 6) AS weight FROM c")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return probability.class_weights(table(spark, sf, "events").select(F.col("event_type").alias("label")), "label").select("label", "pos", r6(F.col("weight")).alias("weight"))


@query("SELECT event_id, round(CASE WHEN event_id % 100 < 10 THEN (event_id % 100) / 10 ELSE greatest(0, (100 - event_id % 100) / 90) END, 6) AS factor FROM events")
def learning_rates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", r6(V.learning_rate(F.col("event_id") % 100, 10, 100)).alias("factor"))


# --- silver labels


@query(_LAB + " SELECT document_id, sentence_index, tok_idx::INT AS tok_idx, upos_id::INT AS upos_id, round(uc, 6) AS upos_confidence, rule_id, round(lc, 6) AS lemma_confidence, number_id::INT AS number_id, round(mc, 6) AS morphology_confidence FROM tl")
def silver_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Choices and confidences of every labelled token."""
    return _token_labels(spark, sf).select("document_id", "sentence_index", "tok_idx", "upos_id", r6(F.col("upos_confidence")).alias("upos_confidence"), "rule_id", r6(F.col("lemma_confidence")).alias("lemma_confidence"),
        (F.array_position(F.element_at("morphology", "Number"), True) - 1).cast("int").alias("number_id"), r6(F.col("morphology_confidence")).alias("morphology_confidence"))


_FILTER = _LAB + """, k AS (SELECT *, coalesce((au IS NULL OR upos_id = au) AND uc >= 0.9, false) AS uk, coalesce((al IS NULL OR rule_id = al) AND lc >= 0.9, false) AS lk, coalesce(mc >= 0.9, false) AS mk FROM tl),
s AS (SELECT document_id, sentence_index, count(*) AS tokens, count(*) FILTER (uk) AS upos_kept, count(*) FILTER (lk) AS lemma_kept, count(*) FILTER (mk) AS morphology_kept, count(*) FILTER (NOT uk OR NOT lk OR NOT mk) AS masked FROM k GROUP BY 1, 2)"""


@query(_FILTER + " SELECT document_id, sentence_index, tokens, upos_kept, morphology_kept, lemma_kept, masked, round(masked / tokens, 6) AS masked_ratio, masked / tokens <= 0.3 AS keep FROM s")
def silver_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = probability.silver_filter(_token_labels(spark, sf))
    return f.select("document_id", "sentence_index", "tokens", "upos_kept", "morphology_kept", "lemma_kept", "masked", r6(F.col("masked_ratio")).alias("masked_ratio"), "keep")


@query(_FILTER + """ SELECT count(*) AS sentences, count(*) FILTER (masked / tokens <= 0.3) AS kept_sentences, (sum(tokens) FILTER (masked / tokens <= 0.3))::BIGINT AS kept_tokens,
  round(1 - (sum(upos_kept) FILTER (masked / tokens <= 0.3)) / (sum(tokens) FILTER (masked / tokens <= 0.3)), 6) AS upos_masked_ratio, round(1 - (sum(morphology_kept) FILTER (masked / tokens <= 0.3)) / (sum(tokens) FILTER (masked / tokens <= 0.3)), 6) AS morphology_masked_ratio,
  round(1 - (sum(lemma_kept) FILTER (masked / tokens <= 0.3)) / (sum(tokens) FILTER (masked / tokens <= 0.3)), 6) AS lemma_masked_ratio FROM s""")
def silver_report(spark: SparkSession, sf: str) -> DataFrame:
    r = probability.silver_report(probability.silver_filter(_token_labels(spark, sf)))
    return r.select("sentences", "kept_sentences", "kept_tokens", *[r6(F.col(f"{t}_masked_ratio")).alias(f"{t}_masked_ratio") for t in probability.TASKS])


@query("""WITH l0 AS (SELECT *, row_number() OVER (PARTITION BY document_id, sentence_index ORDER BY labeled_at DESC NULLS LAST) AS rn FROM silver_label),
l AS (SELECT document_id, sentence_index, greatest(coalesce(len(upos_probabilities), 0), coalesce(len(lemma_rule_ids), 0)) AS n FROM l0 WHERE rn = 1),
s AS (SELECT document_id, sentence_index, max(len(tokens)) AS t FROM silver_sentence WHERE tokens IS NOT NULL GROUP BY 1, 2),
g AS (SELECT document_id, min(s.sentence_index) AS gap FROM s ANTI JOIN l USING (document_id, sentence_index) GROUP BY 1)
SELECT CASE WHEN t IS NULL THEN 'missing' WHEN n <> t THEN 'misaligned' WHEN gap < sentence_index THEN 'gap' ELSE 'aligned' END AS status, count(*) AS n FROM l LEFT JOIN s USING (document_id, sentence_index) LEFT JOIN g USING (document_id) GROUP BY 1""")
def silver_align(spark: SparkSession, sf: str) -> DataFrame:
    """How the labels lie beside the sentences they were made for."""
    s = table(spark, sf, "silver_sentence").filter("tokens is not null").groupBy("document_id", "sentence_index").agg(F.max_by("tokens", F.size("tokens")).alias("tokens"))
    return probability.align_labels(s, inputs.labels(spark, sf), strict=False).groupBy("status").agg(F.count("*").alias("n"))


_BINS = _LAB + ", c AS (SELECT uc, (upos_id = au) AS ok FROM tl WHERE uc IS NOT NULL AND au IS NOT NULL), b AS (SELECT CASE " + " ".join(f"WHEN uc > {k}::DOUBLE / 15 THEN {k}" for k in range(14, -1, -1)) + " END AS bin, uc, ok FROM c)"


@query(_BINS + ", g AS (SELECT bin, count(*) AS n, avg(uc) AS m, avg(ok::INT) AS a FROM b WHERE bin IS NOT NULL GROUP BY 1) SELECT bin::INT AS bin, n, round(m, 6) AS mean_confidence, round(a, 6) AS accuracy FROM g")
def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = probability.calibration_bins(_agreement(spark, sf))
    return b.select("bin", "n", r6(F.col("mean_confidence")).alias("mean_confidence"), r6(F.col("accuracy")).alias("accuracy"))


@query(_BINS + ", g AS (SELECT bin, count(*) AS n, avg(uc) AS m, avg(ok::INT) AS a FROM b WHERE bin IS NOT NULL GROUP BY 1) SELECT round(sum(n * abs(m - a)) / (SELECT count(*) FROM c), 6) AS ece FROM g")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    rows = _agreement(spark, sf)
    return probability.calibration_error(probability.calibration_bins(rows), rows.agg(F.count("*").alias("n_all"))).select(r6(F.col("ece")).alias("ece"))


def _agreement(spark: SparkSession, sf: str) -> DataFrame:
    t = _token_labels(spark, sf).filter("upos_confidence is not null and agreed_upos_id is not null")
    return t.select(F.col("upos_confidence").alias("confidence"), (F.col("upos_id") == F.col("agreed_upos_id")).alias("correct"))


@query(_LAB + ", d AS (SELECT document_id, sentence_index, tok_idx, unnest(u) AS p, unnest(range(0, len(u))) AS id FROM ok WHERE us), r AS (SELECT *, row_number() OVER (PARTITION BY document_id, sentence_index, tok_idx ORDER BY p DESC, id) AS rank FROM d) SELECT document_id, sentence_index, tok_idx::INT AS tok_idx, rank::INT AS rank, id::INT AS upos_id, round(p::DOUBLE, 6) AS p FROM r WHERE rank <= 3")
def upos_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """The three likeliest UPOS ids of each token, likeliest first."""
    l = inputs.labels(spark, sf).select("document_id", "sentence_index", F.posexplode("upos_probabilities").alias("tok_idx", "u")).filter("size(u) > 0 and not exists(u, x -> x is null or isnan(x))")
    top = l.select("document_id", "sentence_index", "tok_idx", F.posexplode(V.top_k(F.sequence(F.lit(0), F.size("u") - 1), F.col("u"), 3)).alias("k", "x"))
    return top.select("document_id", "sentence_index", "tok_idx", (F.col("k") + 1).alias("rank"), F.col("x.id").alias("upos_id"), r6(F.col("x.p")).alias("p"))


# --- operators SQL cannot express; tested on fixtures


@query()
def segment_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Runtime segmentation with byte ranges."""
    return ranges.segment_with_ranges(table(spark, sf, "documents"), inputs.policy(spark, sf))


@query()
def annotate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tagging path with the model-free scorer."""
    return annotate.annotate(table(spark, sf, "documents"), inputs.policy(spark, sf), annotate.SHAPE_LABELS, annotate.shape_scorer)


@query()
def subword_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-word spans of all silver sentences' words by a public byte-level tokenizer."""
    s = inputs.sentences(spark, sf).filter("size(tokens) > 0")
    words = s.select("sentence_id", F.size("tokens").alias("n"), X.spaced_words(F.col("tokens"), F.transform("tokens", lambda _, i: i > 0)).alias("words"))
    e = subword.encode_words(words, ["sentence_id", "n"], "/opt/tokenizers/byte_bpe_50k.json")
    return e.select("sentence_id", F.size("ids").alias("n_ids"), subword.word_spans(F.col("word_ids"), F.col("n")).alias("spans"))


@query()
def byte_pretokens(spark: SparkSession, sf: str) -> DataFrame:
    """Pre-split words by two public schemes, counted by document."""
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").filter("text is not null")
    return d.select("doc_id", F.size(X.pretokenize_bytes(F.col("text"))).alias("n_bytes"), F.size(X.pretokenize_cased(X.compatibility_fold(F.col("text")))).alias("n_cased"))


__all__ = ["ORACLES", "QUERIES", "seg"]
