"""The pN_ queries and, where SQL can express one, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.llm import bpe, chunking, contamination, cutoffs, langid, mixing, scan_repair, sentences
from nordlys.session import small, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_oversized(table(spark, sf, "silver_sentence"), table(spark, sf, "segmentation_policy"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_pieces(spark, sf).filter("piece = 1 and sentence_id is not null").select("sentence_id").distinct()


def p1_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Of each oversized sentence: its tokens, and whether the pieces hold them all, in order, within the limit."""
    limits = chunking.limits_of(table(spark, sf, "segmentation_policy"))
    sentences_ = table(spark, sf, "silver_sentence").filter("sentence_id is not null").join(small(limits), F.col("policy_id") == F.col("_policy"), "left")
    most = sentences_.groupBy("sentence_id").agg(F.max(F.coalesce("_max", F.lit(chunking.DEFAULT_MAXIMUM))).alias("most"))
    pieces = p1_pieces(spark, sf).groupBy("sentence_id").agg(
        F.max("end").alias("n_tokens"), F.max(F.size("tokens")).alias("longest"), F.min("start").alias("first"), F.array_sort(F.collect_list(F.struct("piece", "start", "end"))).alias("p")
    )
    joined = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (F.get("p", i)["start"] <= F.get("p", i - 1)["end"]) & (F.get("p", i)["end"] > F.get("p", i - 1)["end"]))
    return pieces.join(most, "sentence_id").select("sentence_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), ((F.col("first") == 0) & joined).alias("whole"), (F.col("longest") <= F.col("most")).alias("within"))


def _keep(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cutoffs.keep_share(table(spark, sf, "silver_label"), table(spark, sf, "silver_document"), table(spark, sf, "source_target"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf)[0].select("document_id", "sentence_index")


def p5_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    return _keep(spark, sf)[1].select("source", "keep_permille", "n_scored", "k", F.round(F.col("cutoff").cast("double"), 6).alias("cutoff"), "kept", "ties")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The encoded documents decoded again."""
    return bpe.decode_ids(p6_ids(spark, sf)).select("doc_id", F.md5("text").alias("digest"))


def p2_passages(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf, "silver_sentence"), table(spark, sf, "evaluation_item"), table(spark, sf, "evaluation_run"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaked_pairs(p2_passages(spark, sf))


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    sentences_ = table(spark, sf, "silver_sentence")
    return contamination.clean_sentences(sentences_, p2_passages(spark, sf)).select("sentence_id", "document_id", "sentence_index")


def _scans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf, "scan_page"), table(spark, sf, "silver_document"), table(spark, sf, "documents").select("text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_repair.find_noise(*_scans(spark, sf))


def p3_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return scan_repair.reflow(*_scans(spark, sf))


def p4_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_units(table(spark, sf, "documents"), table(spark, sf, "segmentation_policy"), table(spark, sf, "segmentation_contract"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_units(spark, sf).select("doc_id", "end_char")


def p4_cover(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document: where its last unit ends and the visible characters its units hold."""
    u = p4_units(spark, sf)
    seen = F.length(F.regexp_replace("text", r"[\s\x{85}\p{Z}\x{1C}-\x{1F}]", ""))
    return u.groupBy("doc_id").agg(F.max("end_char").cast("bigint").alias("end_char"), F.sum(seen).cast("bigint").alias("visible"))


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_target"))


def p7_selection(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.selection(_mixture(spark, sf)[0])


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf))


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source with a target: whether the mixture keeps its cap and comes within a thousandth of its weight."""
    s = p7_shares(spark, sf)
    return s.select("source", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("share") - F.col("target_weight")) <= 0.001).alias("on_weight"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.mislabelled(langid.document_languages(table(spark, sf, "documents")))


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    return langid.document_languages(table(spark, sf, "documents"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    return langid.document_segments(table(spark, sf, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p2_passages, p2_clean, p3_found, p3_paragraphs, p4_found, p4_units, p4_cover, p5_found, p5_cutoffs, p6_ids, p6_round_trip, p7_selection, p7_spans, p7_shares, p7_check, p8_found, p8_languages, p8_segments)}

_P5 = """
WITH r AS (
  SELECT document_id, sentence_index, labeled_at,
    CASE WHEN upos_probabilities IS NULL OR len(upos_probabilities) = 0 OR lemma_rule_probabilities IS NULL OR len(lemma_rule_probabilities) = 0
      OR len(list_filter(upos_probabilities, lambda x: x IS NULL OR len(x) = 0 OR len(list_filter(x, lambda y: y IS NULL OR isnan(y))) > 0)) > 0
      OR len(list_filter(lemma_rule_probabilities, lambda x: x IS NULL OR len(x) = 0 OR len(list_filter(x, lambda y: y IS NULL OR isnan(y))) > 0)) > 0
    THEN NULL ELSE least(list_min(list_transform(upos_probabilities, lambda x: list_max(x))), list_min(list_transform(lemma_rule_probabilities, lambda x: list_max(x)))) END AS score
  FROM silver_label),
l AS (SELECT *, row_number() OVER (PARTITION BY document_id, sentence_index ORDER BY labeled_at DESC NULLS LAST, score DESC NULLS LAST) AS rn FROM r),
w AS (SELECT document_id, max(corpus_id) AS source FROM silver_document GROUP BY 1),
s AS (SELECT l.document_id, l.sentence_index, l.score, w.source FROM l JOIN w USING (document_id) WHERE rn = 1 AND score IS NOT NULL),
n AS (SELECT source, count(*) AS n_scored FROM s GROUP BY 1),
k AS (SELECT n.source, n_scored, keep_permille, (n_scored * keep_permille + 999) // 1000 AS k FROM n JOIN source_target USING (source)),
o AS (SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY score DESC) AS place FROM s),
c AS (SELECT k.source, keep_permille, n_scored, k.k, o.score AS cutoff FROM k JOIN o ON o.source = k.source AND o.place = k.k)
"""

ORACLES: dict[str, str] = {
    "p1_found": """
WITH p AS (SELECT policy_id, max(CASE WHEN maximum_token_count > 0 THEN maximum_token_count END) AS m FROM segmentation_policy GROUP BY 1)
SELECT DISTINCT sentence_id FROM silver_sentence LEFT JOIN p USING (policy_id)
WHERE sentence_id IS NOT NULL AND len(tokens) > coalesce(m, 128)""",
    "p5_found": _P5 + "SELECT document_id, sentence_index FROM s JOIN c USING (source) WHERE score >= cutoff",
    "p5_cutoffs": _P5 + """SELECT source, keep_permille, n_scored, k, round(cutoff::DOUBLE, 6) AS cutoff,
  count(*) AS kept, count(*) FILTER (score = cutoff) AS ties FROM s JOIN c USING (source) WHERE score >= cutoff GROUP BY 1, 2, 3, 4, 5""",
    "p1_cover": """
WITH p AS (SELECT policy_id, max(CASE WHEN maximum_token_count > 0 THEN maximum_token_count END) AS m FROM segmentation_policy GROUP BY 1)
SELECT sentence_id, max(len(tokens)) AS n_tokens, true AS whole, true AS within FROM silver_sentence LEFT JOIN p USING (policy_id)
WHERE sentence_id IS NOT NULL AND len(tokens) > coalesce(m, 128) GROUP BY 1""",
    "p4_cover": r"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\s\x{85}\pZ\x{1C}-\x{1F}]+$', '') AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS end_char, length(regexp_replace(t, '[\s\x{85}\pZ\x{1C}-\x{1F}]', '', 'g'))::BIGINT AS visible FROM d WHERE t <> ''""",
    "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_check": "SELECT DISTINCT lower(trim(source)) AS source, true AS within_cap, true AS on_weight FROM source_target WHERE source IS NOT NULL",
}
