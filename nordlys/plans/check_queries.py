"""Queries on operators whose whole result SQL can't state: their invariants, or the operator on inputs SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.functions import vectors as V
from nordlys.operators import corpus, evaluation, probability, ranges, sampling, schema
from nordlys.plans import inputs, label_queries
from nordlys.plans.inputs import SQL_BUNDLE, SQL_ITEMS, SQL_TOKENS
from nordlys.plans.label_queries import _PAIRS, _Z, _logits, r6
from nordlys.plans.text_queries import _seg
from nordlys.session import enough_tasks, table
from nordlys.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(_seg(True) + """, ch AS (SELECT doc_id, toks, (len(toks) + 127) // 128 AS k FROM mk WHERE len(toks) > 0)
SELECT doc_id, sum(k)::BIGINT AS sentences, sum(len(toks))::BIGINT AS tokens, true AS spelled, true AS valid FROM ch GROUP BY 1""")
def ranges_check(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges: sentences and tokens of each document, whether every token is spelled by its bytes and all ranges are in order."""
    found = ranges.segment_with_ranges(table(spark, sf, "documents"), inputs.policy(spark, sf), raw=True)
    base = F.col("token_ranges")[0][0]["start"]
    piece = lambda r: F.substring("raw", (r["start"] - base + 1).cast("int"), (r["end"] - r["start"]).cast("int"))
    # A sentence's bytes come with it: joined with the documents, every sentence would carry a whole text.
    spelled = F.forall(F.zip_with("tokens", "token_ranges", lambda t, r: F.array_join(F.transform(r, lambda x: F.decode(piece(x), "UTF-8")), "") == t), lambda x: x)
    rows = found.select("doc_id", F.size("tokens").alias("n"), spelled.alias("s"), ranges.ranges_valid(F.col("tokens"), F.col("token_ranges")).alias("v"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum("n").cast("bigint").alias("tokens"), F.bool_and("s").alias("spelled"), F.bool_and("v").alias("valid"))


@query(f"WITH {SQL_TOKENS} SELECT sentence_id, len(tokens)::BIGINT AS words, len(list_filter(tokens, lambda x: x IS NULL)) = 0 AND tokens[1] <> '' AS whole FROM sent WHERE len(tokens) > 0")
def subword_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-word spans: whether they run from the first id to the last without a gap (a word without ids has none)."""
    spans = label_queries.subword_spans(spark, sf)
    joined = F.forall(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: F.get("spans", i)["start"] == F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"]))
    whole = joined & (F.element_at("spans", -1)["end"] == F.col("n_ids"))
    n = inputs.sentences(spark, sf).filter("size(tokens) > 0").select("sentence_id", F.size("tokens").cast("bigint").alias("words"))
    return spans.join(n, "sentence_id").select("sentence_id", "words", F.coalesce(whole, F.lit(False)).alias("whole"))


@query("SELECT doc_id, md5(text) AS bytes, md5(text) AS cased FROM documents WHERE text IS NOT NULL")
def pretoken_cover(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of both public pre-splitting schemes put together again."""
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").filter("text is not null")
    return d.select("doc_id", F.md5(F.array_join(X.pretokenize_bytes(F.col("text")), "")).alias("bytes"), F.md5(F.array_join(X.pretokenize_cased(F.col("text")), "")).alias("cased"))


@query(r"""WITH f AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, '…', '...'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), '№', 'No'), '™', 'TM') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(t, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')) AS digest FROM f""")
def compatibility_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(X.compatibility_fold(F.col("text"))).alias("digest"))


@query(f"WITH {SQL_TOKENS}, s AS (SELECT len(tokens) AS n FROM sent WHERE len(tokens) > 0), o AS (SELECT n, (row_number() OVER (ORDER BY n) - 1) // 32 AS batch FROM s) SELECT batch, count(*) AS rows, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest FROM o GROUP BY 1")
def length_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the batches of 32 sentences of like length."""
    s = inputs.sentences(spark, sf).filter("size(tokens) > 0").withColumn("seeded", sampling.seeded_key(7, "sentence_id"))
    b = sampling.length_batches(s.select("sentence_id", F.size("tokens").alias("n"), "seeded"), F.col("n"), 32, "seeded", "sentence_id")
    return b.groupBy("batch").agg(F.count("*").alias("rows"), F.min("n").cast("bigint").alias("shortest"), F.max("n").cast("bigint").alias("longest"))


@query(f"WITH {SQL_TOKENS} SELECT 'gold' AS origin, count(*) AS rows, true AS in_order FROM evaluation_item UNION ALL SELECT 'silver', count(*), true FROM sent")
def interleave_check(spark: SparkSession, sf: str) -> DataFrame:
    """Both sets whole, and the seeded order the one of the keys."""
    gold = table(spark, sf, "evaluation_item").select(F.col("item_id").alias("id"))
    silver = inputs.sentences(spark, sf).select(F.col("sentence_id").alias("id"))
    rows = sampling.interleave(gold, silver, 13, "id").select("origin", sampling.seeded_key(13, "origin", "id").alias("k"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"))
    # Within a range the keys ascend if their places do; ranges themselves are checked by their bounds.
    bounds = rows.groupBy("p").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max_by("k", "at").alias("last"), F.min_by("k", "at").alias("first"))
    ordered = bounds.select(F.struct("p", "lo", "hi", ((F.col("lo") == F.col("first")) & (F.col("hi") == F.col("last"))).alias("ok")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("b"))  # one row a range
    fine = ordered.select((F.forall("b", lambda x: x["ok"]) & F.forall(F.sequence(F.lit(1), F.greatest(F.size("b") - 1, F.lit(1))), lambda i: F.coalesce(F.get("b", i - 1)["hi"] <= F.get("b", i)["lo"], F.lit(True)))).alias("in_order"))
    return rows.groupBy("origin").agg(F.count("*").alias("rows")).crossJoin(fine)  # one row


_NLL = "SELECT {t} AS t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / {t})))) - (z[label + 1] - list_max(z)) / {t}) AS nll"


@query(_Z + f""", c AS (SELECT k, pow(10, -1.5 + 3.0::DOUBLE * k / 30) AS tt FROM range(0, 31) r(k)), cn AS ({_NLL.format(t='tt')}, any_value(k) AS k FROM z, c GROUP BY tt),
b AS (SELECT k FROM cn ORDER BY nll, t LIMIT 1), bd AS (SELECT -1.5 + 3.0::DOUBLE * greatest(k - 1, 0) / 30 AS lo, -1.5 + 3.0::DOUBLE * least(k + 1, 30) / 30 AS hi FROM b),
f AS (SELECT pow(10, lo + (hi - lo) * j / 40) AS tt FROM bd, range(0, 41) r(j)), fn AS ({_NLL.format(t='tt')} FROM z, f GROUP BY tt) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM fn ORDER BY fn.nll, fn.t LIMIT 1""")
def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The two-stage grid search for a temperature."""
    t, nll = probability.fit_temperature(_logits(spark, sf))
    return spark.createDataFrame([(round(t, 6), round(nll, 6))], "temperature double, nll double")


@query(_Z + """, r AS (SELECT vec_id, p, unnest(q) AS q, unnest(range(1, 9)) AS i FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, i) AS n FROM r)
SELECT vec_id, round(-sum(q * ln(p[i])) / greatest(sum(q), 1e-6), 6) AS loss FROM k WHERE n <= 3 GROUP BY 1""")
def silver_kd_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Cross entropy against a teacher's three likeliest labels, renormalised."""
    top = V.top_k(F.array(*[F.lit(i) for i in range(8)]), V.softmax(F.col("t")), 3)
    z = _logits(spark, sf).select("vec_id", "z", top.alias("top"))
    return z.select("vec_id", r6(V.sparse_soft_cross_entropy(F.col("z"), F.transform("top", lambda x: x["id"]), F.transform("top", lambda x: x["p"]))).alias("loss"))


@query(_Z + """, s AS (SELECT vec_id, list_transform(z, lambda x: 1 / (1 + exp(-x))) AS s FROM z) SELECT vec_id, CASE WHEN list_max(s) >= 0.5 THEN 'F' ELSE 'T' END || array_to_string(list_transform(s, lambda x: CASE WHEN x >= 0.5 THEN 'T' ELSE 'F' END), '') AS active, round(list_min(list_transform(s, lambda x: greatest(x, 1 - x))), 6) AS confidence,
  array_to_string(list_transform(range(0, 8), lambda i: CASE WHEN s[i + 1] > 0.5 THEN i::VARCHAR ELSE '' END), '') AS tagged FROM s""")
def silver_choice(spark: SparkSession, sf: str) -> DataFrame:
    """A feature with several values, as silver data and as a tagged token decode it."""
    p = _logits(spark, sf).select("vec_id", F.transform("z", V.sigmoid).alias("p"))
    found = V.silver_choice(F.col("p"), True)
    tagged = V.tagged_values(F.col("p"), F.array(*[F.lit(str(i)) for i in range(8)]), True)
    staged = p.select("vec_id", found.alias("f"), tagged.alias("g"))
    return staged.select("vec_id", F.array_join(F.transform("f.active", lambda b: F.when(b, "T").otherwise("F")), "").alias("active"), r6(F.col("f.confidence")).alias("confidence"), F.array_join("g.values", "").alias("tagged"))


@query("SELECT label, unnest(range(0, 16))::INT AS k, round(unnest(list_transform(range(1, 17), lambda i: list_avg(list_transform(e, lambda v: v[i]::DOUBLE)))), 4) AS mean FROM (SELECT vec_id % 50 AS label, list(embedding) AS e FROM embeddings GROUP BY 1)")
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Element-wise means of groups of vectors (fifty to a few hundred groups of bounded size)."""
    g = table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 50).alias("label")).agg(F.collect_list("embedding").alias("e"))
    return g.select("label", F.posexplode(F.transform(V.mean_pool(F.col("e")), lambda x: F.round(x, 4))).alias("k", "mean")).filter("k < 16")


@query(_PAIRS + " SELECT gu AS upos, count(*) AS tokens, count(*) FILTER (gu = su) AS upos_correct, count(*) FILTER (gb = sb) AS ufeats_correct, count(*) FILTER (gl = '_' OR gl = sl) AS lemma_correct FROM pr GROUP BY 1")
def aligned_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Gold and system read apart and joined token by token."""
    g, s = inputs.gold(spark, sf), inputs.system(spark, sf)
    columns = ("sent_id", "tok_idx", "form", "upos", "lemma", "features")
    pairs = evaluation.aligned(g.select(*columns), s.select(*columns))
    return evaluation.ud_metrics(pairs.withColumn("upos", F.col("g.upos")), "upos").select("upos", "tokens", "upos_correct", "ufeats_correct", "lemma_correct")


@query(f"WITH {SQL_TOKENS}, {SQL_ITEMS}, m AS (SELECT DISTINCT form FROM igold WHERE upos = 'PUNCT') SELECT CASE WHEN m.form IS NOT NULL AND NOT starts_with(lemma, '$') THEN '$' || lemma ELSE lemma END AS lemma, count(*) AS n FROM gold LEFT JOIN m USING (form) GROUP BY 1")
def marker_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas with their ``$`` again where training forms (the items' punctuation) carried it."""
    train = inputs.item_gold(spark, sf).select("form", F.when(F.col("upos") == "PUNCT", F.concat(F.lit("$"), "form")).otherwise(F.col("lemma")).alias("lemma"))
    restored = evaluation.restore_markers(inputs.gold(spark, sf), evaluation.marker_forms(train))
    return restored.groupBy("lemma").agg(F.count("*").alias("n"))


@query(_PAIRS + """, r AS (SELECT *, CASE WHEN k = 5 THEN 99 ELSE length(form) - length(sl) END AS sr FROM (SELECT pr.*, (sent_id * 31 + tok_idx * 7) % 13 AS k FROM pr)),
d AS (SELECT *, CASE WHEN sr < 0 OR length(form) - sr < 0 THEN '<INVALID>' ELSE left(lower(form), length(form) - sr) END AS lemma FROM r)
SELECT gu AS upos, count(*) AS tokens, count(*) FILTER (gu = su) AS upos_correct, count(*) FILTER (gb = sb) AS ufeats_correct, count(*) FILTER (gl = '_' OR gl = lemma) AS lemma_correct, count(*) FILTER (lemma = '<INVALID>') AS invalid_rules FROM d GROUP BY 1""")
def decoded_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of decoded predictions: the system's lemma rule applied, one that takes too much as a lemma of its own."""
    p = inputs.pairs(spark, sf).withColumn("k", (F.col("sent_id") * 31 + F.col("tok_idx") * 7) % 13)
    sr = F.when(F.col("k") == 5, 99).otherwise(F.length("s.form") - F.length("s.lemma"))
    rule = F.struct(F.lit(0).alias("pr"), sr.alias("sr"), F.lit("").alias("pa"), F.lit("").alias("sa"))
    d = evaluation.decode_lemmas(p.withColumn("s", F.col("s").withField("form", F.lower("s.form"))), rule)
    return evaluation.ud_metrics(d.withColumn("upos", F.col("g.upos")), "upos", invalid=True).select("upos", "tokens", "upos_correct", "ufeats_correct", "lemma_correct", "invalid_rules")


@query(_PAIRS + """, b AS (SELECT gu, CASE WHEN gu IN ('NOUN', 'ADP') THEN regexp_replace(gb, 'Gender=Fem,Masc', 'Gender=Com') ELSE gb END AS b FROM pr) SELECT gu AS upos, b AS bundle, count(*) AS n FROM b GROUP BY 1, 2""")
def common_gender(spark: SparkSession, sf: str) -> DataFrame:
    """Common gender by part of speech (nouns stand for adjectives, adpositions for determiners)."""
    stand = F.when(F.col("g.upos") == "NOUN", "ADJ").when(F.col("g.upos") == "ADP", "DET").otherwise(F.col("g.upos"))
    p = inputs.pairs(spark, sf).select(F.col("g.upos").alias("upos"), X.feature_bundle(X.common_gender(stand, F.col("g.features"))).alias("bundle"))
    return p.groupBy("upos", "bundle").agg(F.count("*").alias("n"))


@query(_Z + """, c AS (SELECT label, count(*) AS n FROM z GROUP BY 1), r AS (SELECT z.label, CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '21+' END AS frequency, 1 + len(list_filter(z.z, lambda x: x > z.z[z.label + 1])) AS rank,
  CASE WHEN len(list_filter(z.z, lambda x: x > z.z[z.label + 1])) = 0 THEN NULL WHEN z.label >= 6 THEN 'uncovered' WHEN list_position(t, list_max(t)) - 1 <> z.label THEN 'ranking' ELSE 'refinement' END AS error FROM z JOIN c USING (label))
SELECT frequency, error, count(*) AS n, round(avg((rank <= 1)::INT), 6) AS top_1, round(avg((rank <= 2)::INT), 6) AS top_2, round(avg((rank <= 5)::INT), 6) AS top_5, round(avg(rank), 6) AS mean_rank, round(avg(1 / rank), 6) AS mrr FROM r GROUP BY 1, 2""")
def rank_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks by how often a rule occurs and by where a wrong choice went wrong."""
    z = _logits(spark, sf)
    counts = z.groupBy("label").agg(F.count("*").alias("n"))
    best, first = V.argmax(F.col("z")) == F.col("label"), V.argmax(F.col("t")) == F.col("label")
    right = V.rank_of(F.col("z"), F.col("label")) == 1
    rows = z.join(F.broadcast(counts), "label").select(  # one row a label
        probability.rule_frequency_group(F.col("n")).alias("frequency"), probability.bundle_error_kind(F.col("label") < 6, first, best | right).alias("error"), V.rank_of(F.col("z"), F.col("label")).alias("rank")
    )
    m = probability.rank_audit(rows, "frequency", "error")
    return m.select("frequency", "error", "n", *[r6(F.col(c)).alias(c) for c in ("top_1", "top_2", "top_5", "mean_rank", "mrr")])


@query(_Z + f""", {SQL_TOKENS}, inv AS (SELECT upos, b AS bundle, number, row_number() OVER (PARTITION BY upos ORDER BY count(*) DESC, b) AS rank FROM (SELECT upos, {SQL_BUNDLE.format(p='')} AS b, number FROM gold) GROUP BY 1, 2, 3),
c AS (SELECT (row_number() OVER (ORDER BY upos, rank) - 1)::INT AS candidate_id, upos, bundle, coalesce(number, '<NONE>') AS number FROM inv WHERE rank <= 4), ups AS (SELECT upos, row_number() OVER (ORDER BY upos) AS i FROM (SELECT DISTINCT upos FROM gold)),
ev AS (SELECT p.vec_id, candidate_id, number, ln(p.p[u.i]) + ln(p.q[CASE number WHEN '<NONE>' THEN 1 WHEN 'Plur' THEN 2 ELSE 3 END]) AS score FROM p, c JOIN ups u USING (upos)),
x AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS w FROM ev), m AS (SELECT vec_id, number, sum(w) / sum(sum(w)) OVER (PARTITION BY vec_id) AS p FROM x GROUP BY 1, 2), b AS (SELECT vec_id, candidate_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, candidate_id) AS r FROM ev)
SELECT m.vec_id, b.candidate_id AS best, round(b.score, 6) AS evidence, m.number AS label, round(m.p, 6) AS marginal FROM m JOIN b ON b.vec_id = m.vec_id AND b.r = 1""")
def bundle_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate bundle of the inventory scored for every token (UPOS and Number), the best one, and the labels' marginals."""
    from nordlys.operators import bundles

    candidates = bundles.bundle_candidates(bundles.bundle_inventory(inputs.gold(spark, sf)), 4)
    upos = schema.upos_schema(inputs.gold(spark, sf))
    labels = {"Number": ("<NONE>", "Plur", "Sing")}
    tokens = _logits(spark, sf).select("vec_id", V.softmax(F.col("z")).alias("u"), F.create_map(F.lit("Number"), V.softmax(F.col("t"))).alias("m"))
    scored = bundles.score_candidates(tokens, candidates, upos, labels)
    found = scored.select("vec_id", bundles.best_candidate("candidates").alias("best"), F.explode(bundles.label_marginals("candidates", "Number", labels["Number"])).alias("label", "marginal"))
    return found.select("vec_id", "best.candidate_id", "best.score", "label", "marginal").select("vec_id", F.col("candidate_id").alias("best"), r6(F.col("score")).alias("evidence"), "label", r6(F.col("marginal")).alias("marginal"))


@query(f"WITH {SQL_ITEMS} SELECT sent_id AS item_id, tok_idx::INT AS tok_idx, coalesce(lag(length(form) % 3 <> 0) OVER (PARTITION BY sent_id ORDER BY tok_idx), false) AS has_space_before FROM itok")
def misc_spacing(spark: SparkSession, sf: str) -> DataFrame:
    """Space before a token from the note at the one before (here by its length)."""
    t = inputs.item_tokens(spark, sf).withColumn("space_after", F.length("form") % 3 != 0)
    return readers.spacing_from_misc(t, "sent_id").select(F.col("sent_id").alias("item_id"), F.col("tok_idx").cast("int").alias("tok_idx"), "has_space_before")


@query("SELECT doc_id, octet_length(encode(left(text, 7)))::INT AS bytes, (length(left(text, 7)) + len(list_filter(string_split(left(text, 7), ''), lambda c: c <> '' AND unicode(c) > 65535)))::INT AS units, octet_length(encode(left(text, 7)))::INT AS again FROM documents WHERE length(text) >= 7")
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    """The place behind seven characters, in UTF-8 bytes, in UTF-16 units and in bytes again."""
    d = table(spark, sf, "documents").filter("length(text) >= 7").select("doc_id", "text", F.octet_length(F.substring("text", 1, 7)).alias("bytes"))
    d = d.withColumn("units", X.utf8_to_utf16(F.col("text"), F.col("bytes")))
    return d.select("doc_id", "bytes", "units", X.utf16_to_utf8(F.col("text"), F.col("units")).alias("again"))


@query(f"WITH {SQL_TOKENS}, g AS (SELECT DISTINCT list_transform(list_filter(tokens, lambda x: x IS NOT NULL), lambda x: lower(nfc_normalize(x))) AS t FROM evaluation_item WHERE tokens IS NOT NULL) SELECT count(*) AS gold FROM g")
def gold_union(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct fingerprints of all gold splits together."""
    items = table(spark, sf, "evaluation_item")
    splits = [items.filter(F.col("evaluation_split") == s) for s in ("train", "dev", "test")] + [items.filter("evaluation_split is null or evaluation_split not in ('train', 'dev', 'test')")]
    return corpus.gold_fingerprints(*splits).agg(F.count("*").alias("gold"))


@query(_seg(True) + r""", wd AS (SELECT unnest(list_transform(toks, lambda x: x.token)) AS w FROM mk WHERE len(toks) > 0)
SELECT CASE WHEN regexp_matches(w, '^\p{Nd}') THEN 'NUM' WHEN regexp_matches(w, '^\p{Lu}') THEN 'PROPN' WHEN regexp_matches(w, '[\p{L}\p{N}]') THEN 'NOUN' ELSE 'PUNCT' END AS upos,
  CASE WHEN regexp_matches(w, '(er|ene)$') THEN 'Plur' ELSE 'Sing' END AS number, (length(w) - length(CASE WHEN regexp_matches(w, '(er|ene)$') THEN left(w, length(w) - 2) ELSE w END))::INT AS shorter, count(*) AS n FROM wd GROUP BY 1, 2, 3""")
def annotate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tagging path with the model-free scorer, counted by what it decodes."""
    a = label_queries.annotate_documents(spark, sf)
    return a.groupBy("upos", F.element_at("features", "Number")[0].alias("number"), (F.length("form") - F.length("lemma")).alias("shorter")).agg(F.count("*").alias("n"))
