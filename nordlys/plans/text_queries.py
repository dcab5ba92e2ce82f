"""Queries on raw text and sentences, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.functions.text import SPACE, TOKEN
from nordlys.operators import corpus, evaluation, sampling, schema
from nordlys.operators import segmentation as seg
from nordlys.plans import inputs
from nordlys.plans.inputs import SQL_FOLD, SQL_ITEMS, SQL_TOKENS
from nordlys.session import enough_tasks, table
from nordlys.sources import markup, readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_Q = TOKEN.replace("'", "''")
_WS = SPACE.replace("'", "''")
_FOLD = SQL_FOLD
_OPEN = "«\"''(\\[„“"
_SEG = r"""
ab AS (SELECT list(DISTINCT rtrim(lower(trim(a)), '.') || '.') AS abbr FROM (SELECT unnest(abbreviation_tokens) AS a FROM segmentation_policy)),
fixed AS (SELECT doc_id, {fix} AS t FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM fixed),
tidy AS (SELECT doc_id, line_no, trim(regexp_replace(l, '{ws}+', ' ', 'g')) AS line FROM lines),
c AS (SELECT *, coalesce(prev <> '' AND NOT regexp_matches(prev, '[.!?…:]$') AND regexp_matches(line, '^\p{{Ll}}'), false) AS cont
  FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM tidy)),
pl AS (SELECT *, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS para, coalesce(lead(cont) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS next_cont FROM c),
paras AS (SELECT doc_id, para, trim(string_agg(CASE WHEN next_cont AND line LIKE '%-' THEN left(line, length(line) - 1) WHEN next_cont THEN line || ' ' ELSE line END, '' ORDER BY line_no)) AS txt FROM pl WHERE line <> '' GROUP BY 1, 2),
w AS (SELECT doc_id, para, unnest(string_split(txt, ' ')) AS w, generate_subscripts(string_split(txt, ' '), 1) AS i FROM paras WHERE txt <> ''),
e AS (SELECT *, coalesce(nxt IS NOT NULL AND regexp_matches(w, '[.!?…]$') AND regexp_matches(nxt, '^[\p{{Lu}}{open}]') AND NOT regexp_matches(w, '^\p{{Nd}}{{1,3}}\.$') AND NOT list_contains(abbr, lower(w)), false) AS is_end
  FROM (SELECT *, lead(w) OVER (PARTITION BY doc_id, para ORDER BY i) AS nxt FROM w), ab),
n AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id, para ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM e),
sents AS (SELECT doc_id, para, sent, string_agg(w, ' ' ORDER BY i) AS sentence FROM n GROUP BY 1, 2, 3),
raw AS (SELECT *, regexp_extract_all(sentence, '\s*(?:{tok})') AS r FROM sents, ab),
mk AS (SELECT doc_id, para, sent, sentence, list_filter(list_transform(r, lambda t, i: struct_pack(
    token := CASE WHEN coalesce(r[i + 1] = '.' AND ((regexp_matches(ltrim(t), '^\p{{Nd}}{{1,3}}$') AND i + 1 < len(r)) OR list_contains(abbr, lower(ltrim(t)) || '.')), false) THEN ltrim(t) || '.' ELSE ltrim(t) END,
    space := i > 1 AND t LIKE ' %',
    taken := i > 1 AND t = '.' AND coalesce((regexp_matches(ltrim(r[i - 1]), '^\p{{Nd}}{{1,3}}$') AND i < len(r)) OR list_contains(abbr, lower(ltrim(r[i - 1])) || '.'), false))), lambda x: NOT x.taken) AS toks FROM raw)
"""


def _seg(restore: bool) -> str:
    fix = rf"regexp_replace(text, '([a-zæøå])([.!?…])([A-ZÆØÅ{_OPEN}])', '\1\2 \3', 'g')" if restore else "text"
    return "WITH " + _SEG.format(fix=fix, ws=_WS, open=_OPEN, tok=_Q)


@query(f"""WITH d AS (SELECT lang, unnest(regexp_extract_all(text, '{_Q}')) AS form FROM documents)
SELECT coalesce(lang, '') AS lang, {_FOLD.format(x="nfc_normalize(form)")} AS form, count(*) AS cnt FROM d GROUP BY 1, 2""")
def freq_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Token frequencies by language label."""
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    t = d.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(X.token_list(F.col("text"))).alias("form"))
    # Counted as written first, so that only distinct forms are normalised.
    t = t.groupBy("lang", "form").agg(F.count("*").alias("n"))
    return t.select("lang", X.nfc_key(F.col("form")).alias("form"), "n").groupBy("lang", "form").agg(F.sum("n").alias("cnt"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_Q}'))::BIGINT AS n_tokens, md5(array_to_string(regexp_extract_all(text, '{_Q}'), chr(1))) AS digest FROM documents WHERE text IS NOT NULL")
def tok_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").filter("text is not null").select("doc_id", X.token_list(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "\x01")).alias("digest"))


@query(rf"SELECT doc_id, regexp_replace(text, '([a-zæøå])([.!?…])([A-ZÆØÅ{_OPEN}])', '\1\2 \3', 'g') AS text FROM documents WHERE text IS NOT NULL")
def seg_restore_space(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", seg.restore_spaces(F.col("text")).alias("text"))


@query(_seg(False) + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS paragraph, txt AS text FROM paras WHERE txt <> ''")
def seg_merge_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.posexplode(seg.merge_lines(F.col("text"))).alias("paragraph", "text"))


@query(_seg(True) + """, ch AS (SELECT doc_id, para, sent, toks, unnest(range(0, (len(toks) + 127) // 128)) AS k FROM mk WHERE len(toks) > 0),
cut AS (SELECT doc_id, para, sent, k, toks[k * 128 + 1 : k * 128 + 128] AS part FROM ch)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent, k) - 1 AS sentence_index, len(part)::BIGINT AS n_tokens,
  array_to_string(list_transform(part, lambda x, i: CASE WHEN i > 1 AND x.space THEN ' ' ELSE '' END || x.token), chr(1)) AS tokens FROM cut""")
def seg_runtime(spark: SparkSession, sf: str) -> DataFrame:
    """Runtime segmentation with chunks of 128 tokens."""
    s = seg.segment(table(spark, sf, "documents"), inputs.policy(spark, sf), "doc_id")
    return s.select("doc_id", "sentence_index", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join(X.spaced_words(F.col("tokens"), F.col("has_space_before")), "\x01").alias("tokens"))


_FLAGS = rf""", q AS (SELECT doc_id, sentence, len(toks) AS n, regexp_replace(sentence, '^[{_OPEN}]+', '') AS b, regexp_replace(sentence, '[»"'')\]”]+$', '') AS f,
  len(list_filter(toks, lambda x: regexp_matches(x.token, '\p{{L}}'))) AS letters, array_to_string(list_transform(toks, lambda x: x.token), chr(1)) AS tokens FROM mk WHERE len(toks) > 0),
fl AS (SELECT doc_id, sentence, tokens, n BETWEEN 4 AND 128 AS length_ok, NOT contains(sentence, chr(65533)) AS readable, regexp_matches(b, '^\p{{Lu}}') AS starts_upper, regexp_matches(f, '[.!?…]$') AS ends_terminal,
  length(regexp_extract(f, '(\.*)$', 1)) <> 2 AND length(regexp_extract(f, '(\.*)$', 1)) < 4 AS no_leaders, regexp_matches(sentence, '\p{{Ll}}') AS has_lower, letters / n >= 0.5 AS enough_letters FROM q)
"""


@query(_seg(False) + _FLAGS + "SELECT length_ok, readable, starts_upper, ends_terminal, no_leaders, has_lower, enough_letters, count(*) AS n FROM fl GROUP BY ALL")
def silver_quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = seg.extract(table(spark, sf, "documents"), inputs.policy(spark, sf), "doc_id", flags=True)
    names = [c for c in f.columns if c not in ("doc_id", "place", "sentence")]
    return f.groupBy(*names).agg(F.count("*").alias("n"))


@query(_seg(False) + _FLAGS + "SELECT doc_id, sentence, tokens FROM fl WHERE length_ok AND readable AND starts_upper AND ends_terminal AND no_leaders AND has_lower AND enough_letters")
def silver_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = seg.extract(table(spark, sf, "documents"), inputs.policy(spark, sf), "doc_id")
    return e.select("doc_id", "sentence", F.array_join("tokens", "\x01").alias("tokens"))


_FP = "sha256(array_to_string(list_transform({t}, lambda t: " + _FOLD.format(x="nfc_normalize(t)") + " || chr(0)), ''))"


@query(f"WITH {SQL_TOKENS} SELECT sentence_id, CASE WHEN tokens IS NOT NULL THEN {_FP.format(t='list_filter(tokens, lambda x: x IS NOT NULL)')} END AS fingerprint FROM sent")
def fp_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.with_fingerprint(inputs.sentences(spark, sf)).select("sentence_id", "fingerprint")


_FPS = f"WITH {SQL_TOKENS}, f AS (SELECT *, CASE WHEN tokens IS NOT NULL THEN {_FP.format(t='list_filter(tokens, lambda x: x IS NOT NULL)')} END AS fingerprint FROM sent), g AS (SELECT DISTINCT {_FP.format(t='list_filter(tokens, lambda x: x IS NOT NULL)')} AS fingerprint FROM evaluation_item WHERE tokens IS NOT NULL)"


@query(_FPS + " SELECT document_id, sentence_id, row_number() OVER (PARTITION BY document_id ORDER BY sentence_index, sentence_id) - 1 AS new_index FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY document_id, sentence_index, sentence_id) AS r FROM f) WHERE r = 1 OR fingerprint IS NULL")
def fp_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen deduplication, then the index of the survivors anew."""
    kept = corpus.first_seen(corpus.with_fingerprint(inputs.sentences(spark, sf)), "document_id", "sentence_index", "sentence_id")
    return corpus.reindexed(kept, "document_id", "sentence_index", "sentence_id", name="new_index").select("document_id", "sentence_id", "new_index")


@query(_FPS + " SELECT sentence_id FROM f WHERE fingerprint IS NULL OR fingerprint NOT IN (SELECT fingerprint FROM g)")
def fp_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    gold = corpus.with_fingerprint(table(spark, sf, "evaluation_item").filter("tokens is not null"))
    return corpus.decontaminate(corpus.with_fingerprint(inputs.sentences(spark, sf)), gold).select("sentence_id")


@query(_FPS + " SELECT fingerprint FROM f INTERSECT SELECT fingerprint FROM g")
def fp_cross_overlap(spark: SparkSession, sf: str) -> DataFrame:
    gold = corpus.with_fingerprint(table(spark, sf, "evaluation_item").filter("tokens is not null"))
    return corpus.overlap(corpus.with_fingerprint(inputs.sentences(spark, sf)), gold)


@query("SELECT coalesce(language_tag, '') AS language_tag, count(*) AS sentences, coalesce(sum(len(tokens)), 0)::BIGINT AS tokens, count(DISTINCT document_id) AS documents FROM silver_sentence GROUP BY 1")
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.manifest(table(spark, sf, "silver_sentence").withColumn("language_tag", F.coalesce("language_tag", F.lit(""))), "language_tag")


@query(f"WITH {SQL_TOKENS}, r AS (SELECT sentence_id, coalesce(sum(coalesce(len(tokens), 0)) OVER (ORDER BY document_id, sentence_index, sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sent) SELECT sentence_id FROM r WHERE b < 20000")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.within_budget(inputs.sentences(spark, sf), 20_000, F.coalesce(F.when(F.col("tokens").isNotNull(), F.size("tokens")), F.lit(0)), "document_id", "sentence_index", "sentence_id").select("sentence_id")


@query(f"WITH {SQL_TOKENS} SELECT sentence_id, (row_number() OVER (ORDER BY document_id, sentence_index, sentence_id) - 1) // 500 AS shard FROM sent")
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shards(inputs.sentences(spark, sf), 500, "document_id", "sentence_index", "sentence_id").select("sentence_id", "shard")


_PROFILE = f"prof AS (SELECT {_FOLD.format(x='nfc_normalize(form)')} AS form, count(*) AS cnt FROM tok GROUP BY 1)"


@query(f"WITH {SQL_TOKENS}, {SQL_ITEMS}, {_PROFILE} SELECT CASE WHEN coalesce(cnt, 0) = 0 THEN 'oov' WHEN cnt <= 5 THEN 'rare' ELSE 'frequent' END AS freq_class, count(*) AS tokens, count(DISTINCT t.form) AS forms FROM itok t LEFT JOIN prof p ON {_FOLD.format(x='nfc_normalize(t.form)')} = p.form GROUP BY 1")
def freq_class_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency classes of the evaluation items' tokens against the silver corpus's profile."""
    classed = evaluation.with_frequency_class(inputs.item_tokens(spark, sf), evaluation.frequency_profile(inputs.tokens(spark, sf)))
    return classed.groupBy("freq_class").agg(F.count("*").alias("tokens"), F.countDistinct("form").alias("forms"))


@query(f"WITH {SQL_TOKENS} SELECT (row_number() OVER (ORDER BY encode(c)) + 4)::INT AS char_id, c AS char, n FROM (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(nfc_normalize(form), '(?s).')) AS c FROM tok) GROUP BY 1 HAVING count(*) >= 2)")
def char_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return schema.character_vocabulary(inputs.tokens(spark, sf), 2)


_CHARS = "ids AS (SELECT c, row_number() OVER (ORDER BY encode(c)) + 4 AS id FROM (SELECT c FROM (SELECT unnest(regexp_extract_all(nfc_normalize(form), '(?s).')) AS c FROM tok) GROUP BY 1 HAVING count(*) >= 2))"


@query(f"""WITH {SQL_TOKENS}, {_CHARS}, forms AS (SELECT DISTINCT form FROM tok), ch AS (SELECT form, unnest(regexp_extract_all(nfc_normalize(form), '(?s).')) AS c, generate_subscripts(regexp_extract_all(nfc_normalize(form), '(?s).'), 1) AS i FROM forms),
m AS (SELECT form, list(coalesce(id, 1) ORDER BY i) AS l FROM ch LEFT JOIN ids USING (c) GROUP BY 1)
SELECT form, array_to_string(list_concat([2], CASE WHEN len(l) <= 10 THEN l ELSE list_concat(l[1:5], [4], l[len(l) - 3:]) END, [3]), ' ') AS ids FROM m""")
def char_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Character ids of each distinct form, at most 12 long.  The vocabulary (a script's characters) is one small row."""
    t = inputs.tokens(spark, sf)
    ids = schema.character_vocabulary(t, 2).agg(F.map_from_entries(F.collect_list(F.struct("char", "char_id"))).alias("ids"))
    forms = t.select("form").distinct().join(F.broadcast(ids))
    return forms.select("form", F.array_join(X.encode_characters(F.col("form"), F.col("ids"), 12), " ").alias("ids"))


@query("""SELECT p.document_id, p.page::INT AS page, count(*) AS scans, max(length(text))::BIGINT AS longest FROM scan_page p WHERE language_tag = 'nb' AND ocr_confidence >= 0.9 GROUP BY 1, 2""")
def page_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one language with enough confidence, by document and page number."""
    p = table(spark, sf, "scan_page").filter("language_tag = 'nb' and ocr_confidence >= 0.9")
    return p.groupBy("document_id", F.col("page").cast("int").alias("page")).agg(F.count("*").alias("scans"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query(r"""WITH b AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS b FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, regexp_replace(regexp_replace(b, 'WS*[\r\n]+WS*', ' ', 'g'), '^WS+|WS+$', '', 'g') AS p FROM b)
SELECT doc_id, p AS paragraph FROM p WHERE p <> '' AND NOT regexp_matches(p, '^[_*=]') AND NOT (regexp_matches(p, '\p{L}') AND NOT regexp_matches(p, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]'))""".replace("WS", _WS))
def book_reflow(spark: SparkSession, sf: str) -> DataFrame:
    d = enough_tasks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.explode(markup.reflow(F.col("text"))).alias("paragraph"))


@query("""WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM evaluation_item)
SELECT item_id FROM o WHERE k = 0 OR (k * 50) // n <> ((k - 1) * 50) // n""")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty items at even steps."""
    return sampling.stride_sample(table(spark, sf, "evaluation_item").select("item_id"), 50, "item_id")


@query()
def seeded_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of 32 sentences of like length, in a seeded order of equals."""
    s = inputs.sentences(spark, sf).filter("size(tokens) > 0").withColumn("seeded", sampling.seeded_key(7, "sentence_id"))
    return sampling.length_batches(s.select("sentence_id", "tokens", "seeded"), F.size("tokens"), 32, "seeded", "sentence_id").select("sentence_id", "batch")


@query()
def interleaved(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items (gold) and silver sentences in one seeded order."""
    gold = table(spark, sf, "evaluation_item").select(F.col("item_id").alias("id"), "tokens")
    silver = inputs.sentences(spark, sf).select(F.col("sentence_id").alias("id"), "tokens")
    return sampling.interleave(gold, silver, 13, "id").select("origin", "id", F.size("tokens").alias("n_tokens"))


@query("""WITH t AS (SELECT item_id, unnest(tokens) AS form, generate_subscripts(tokens, 1) AS i FROM evaluation_item WHERE tokens IS NOT NULL)
SELECT item_id, (i - 1)::INT AS tok_idx, form, lower(form) AS lemma, CASE WHEN length(form) > 4 THEN 'Number=Sing' ELSE '_' END AS features, true AS space_after FROM t""")
def conllu_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Items rendered as CoNLL-U blocks and parsed again."""
    return _conllu(table(spark, sf, "evaluation_item"), "item_id")


@query()
def conllu_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """All silver sentences rendered as CoNLL-U blocks and parsed again."""
    return _conllu(inputs.sentences(spark, sf), "sentence_id")


def _conllu(rows: DataFrame, key: str) -> DataFrame:
    line = F.transform("tokens", lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), t, F.lower(t), F.lit("X"), F.lit("_"), F.when(F.length(t) > 4, F.lit("Number=Sing")).otherwise(F.lit("_")), F.lit("0"), F.lit("_"), F.lit("_"), F.lit("_")))
    blocks = rows.filter("tokens is not null").select(key, F.concat(F.lit("# text\n"), F.array_join(line, "\n")).alias("value"))
    return readers.parse_blocks(blocks, key).select(key, "tok_idx", "form", "lemma", X.feature_bundle(F.col("features")).alias("features"), "space_after")


_RULES_OF = f"""p AS (SELECT DISTINCT form AS token, lemma FROM {{gold}} WHERE upos <> 'PUNCT'),
st AS (SELECT token, lemma, unnest(range(1, length(token) + 1)) AS a FROM p), s2 AS (SELECT *, unnest(range(1, length(token) - a + 2)) AS n FROM st),
m AS (SELECT token, lemma, a, n, instr(lemma, substr(token, a, n)) AS b FROM s2 WHERE contains(lemma, substr(token, a, n))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token, lemma ORDER BY n DESC, a, b) AS r FROM m) WHERE r = 1),
rules AS (SELECT p.token, p.lemma, coalesce(a - 1, 0)::INT AS pr, (CASE WHEN n IS NULL THEN length(p.token) ELSE length(p.token) - (a - 1) - n END)::INT AS sr,
  CASE WHEN n IS NULL THEN '' ELSE substr(p.lemma, 1, b - 1) END AS pa, CASE WHEN n IS NULL THEN p.lemma ELSE substr(p.lemma, b + n) END AS sa FROM p LEFT JOIN best USING (token, lemma))"""


_RULE_SQL = f"WITH {SQL_TOKENS}, " + _RULES_OF.format(gold="gold")


def _rules(spark: SparkSession, sf: str, items: bool = False) -> DataFrame:
    p = (inputs.item_gold if items else inputs.gold)(spark, sf).filter("upos <> 'PUNCT'").select(F.col("form").alias("token"), "lemma").distinct()
    return p.withColumn("_r", X.derive_rule(F.col("token"), F.col("lemma"))).select("token", "lemma", "_r.*")


@query(_RULE_SQL + " SELECT token, lemma, pr, sr, pa, sa FROM rules")
def lemma_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _rules(spark, sf)


@query(_RULE_SQL + " SELECT (row_number() OVER (ORDER BY pr, sr, encode(pa), encode(sa)) - 1)::INT AS rule_id, pr, sr, pa, sa FROM (SELECT DISTINCT pr, sr, pa, sa FROM rules)")
def lemma_rule_schema(spark: SparkSession, sf: str) -> DataFrame:
    return schema.lemma_rule_schema(_rules(spark, sf))


@query(_RULE_SQL + """, sch AS (SELECT (row_number() OVER (ORDER BY pr, sr, encode(pa), encode(sa)) - 1)::INT AS rule_id, pr, sr, pa, sa FROM (SELECT DISTINCT pr, sr, pa, sa FROM rules))
SELECT rule_id, count(*) AS n FROM rules JOIN sch USING (pr, sr, pa, sa) GROUP BY 1""")
def lemma_rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = _rules(spark, sf)
    return schema.with_rule_id(r, schema.lemma_rule_schema(r)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(_RULE_SQL + " SELECT token, lemma, lemma AS restored FROM rules")
def lemma_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Each derived rule applied again gives the lemma."""
    return _rules(spark, sf).select("token", "lemma", X.apply_rule(F.col("token"), F.struct("pr", "sr", "pa", "sa")).alias("restored"))


@query(f"WITH {SQL_ITEMS}, itr AS MATERIALIZED (WITH " + _RULES_OF.format(gold="igold") + f" SELECT DISTINCT pr, sr, pa, sa FROM rules), {SQL_TOKENS}, " + _RULES_OF.format(gold="gold") + """
SELECT count(*) AS tokens, count(*) FILTER (itr.pr IS NULL) AS unknown_rules FROM rules LEFT JOIN itr USING (pr, sr, pa, sa)""")
def lemma_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """The silver forms' rules looked up in the schema of the evaluation items."""
    known = schema.lemma_rule_schema(_rules(spark, sf, items=True))
    return schema.with_rule_id(_rules(spark, sf), known).agg(F.count("*").alias("tokens"), F.count_if(F.col("rule_id").isNull()).alias("unknown_rules"))
