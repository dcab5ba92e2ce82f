"""Queries that write the tables in the formats of the sources, and read them back, with their SQL twins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.operators import corpus
from nordlys.plans import inputs
from nordlys.plans.inputs import SQL_TOKENS
from nordlys.session import shared_path, table
from nordlys.sources import markup, readers, sinks

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _bare(text: Column) -> Column:
    """Without white space and control characters, which formats change."""
    return F.regexp_replace(text, r"[\s\p{Z}\p{Cc}\x{FFFE}\x{FFFF}]", "")


_BARE = r"regexp_replace({x}, '[\s\pZ\p{{Cc}}\x{{FFFE}}\x{{FFFF}}]', '', 'g')"


@query(f"WITH {SQL_TOKENS}, t AS (SELECT sent_id, {_BARE.format(x='form')} AS form FROM tok) SELECT CASE WHEN length(form) > 4 THEN 'Number=Sing' ELSE '_' END AS features, count(*) AS tokens, count(DISTINCT sent_id) AS sentences, (SELECT count(DISTINCT sent_id) FROM t WHERE form <> '') AS ordinals FROM t WHERE form <> '' GROUP BY 1")
def src_conllu(spark: SparkSession, sf: str) -> DataFrame:
    """All silver sentences written as CoNLL-U files and read again; ordinals: the sum of the files' last sentence numbers."""
    tokens = F.filter(F.transform("tokens", lambda t: _bare(F.coalesce(t, F.lit("")))), lambda t: t != "")
    s = inputs.sentences(spark, sf).select("sentence_id", tokens.alias("t")).filter("size(t) > 0")
    line = F.transform("t", lambda t, i: F.concat_ws("\t", (i + 1).cast("string"), t, F.lower(t), F.lit("X"), F.lit("_"), F.when(F.length(t) > 4, F.lit("Number=Sing")).otherwise(F.lit("_")), F.lit("0"), F.lit("_"), F.lit("_"), F.lit("_")))
    path = shared_path(spark, "conllu-")
    s.select(F.concat(F.lit("# text\n"), F.array_join(line, "\n")).alias("value")).write.option("lineSep", "\n\n").text(path)
    read = readers.read_conllu(spark, path)
    ordinals = read.groupBy("file").agg((F.max("sent_id") + 1).alias("n")).agg(F.sum("n").alias("ordinals"))
    return read.groupBy(X.feature_bundle(F.col("features")).alias("features")).agg(F.count("*").alias("tokens"), F.countDistinct("file", "sent_id").alias("sentences")).crossJoin(ordinals)  # one row


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's pages within its root element."""
    line = lambda x: pa.RecordBatch.from_arrays([pa.array([x])], ["value"])
    yield line("<mediawiki>")
    yield from batches
    yield line("</mediawiki>")


@query(f"SELECT doc_id, md5({_BARE.format(x='text')}) AS digest FROM documents WHERE {_BARE.format(x='text')} <> '' AND doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def src_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as an encyclopedia's dump (every third a talk page, every seventh a redirect) and its articles read again."""
    d = table(spark, sf, "documents").filter("text is not null and trim(text) <> ''")
    safe = F.regexp_replace(F.regexp_replace("text", r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", ""), "&", "&amp;")
    safe = F.replace(F.replace(safe, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    ns, redirect = F.when(F.col("doc_id") % 3 == 0, "1").otherwise("0"), F.when(F.col("doc_id") % 7 == 0, '<redirect title="x"/>').otherwise("")
    page = F.concat(F.lit("<page><title>t</title><ns>"), ns, F.lit("</ns><id>"), F.col("doc_id").cast("string"), F.lit("</id>"), redirect, F.lit("<revision><id>1</id><text>"), safe, F.lit("</text></revision></page>"))
    path = shared_path(spark, "dump-")
    d.select(page.alias("value")).mapInArrow(_rooted, "value string").write.text(path)
    read = readers.read_dump(spark, path)
    return read.select(F.col("page_id").alias("doc_id"), F.md5(_bare(F.col("text"))).alias("digest")).filter(_bare(F.col("text")) != "")


@query(r"""WITH b AS (SELECT item_id, list_filter(list_transform(tokens, lambda t: regexp_replace(coalesce(t, ''), '[\s\pZ\p{Cc}]', '', 'g')), lambda t: t <> '') AS t FROM evaluation_item),
p AS (SELECT item_id, 0 AS part, t[1:4] AS t FROM b UNION ALL SELECT item_id, 1, t[5:] FROM b)
SELECT 'digibok_' || item_id AS document_id, part::INT AS sentence_index, array_to_string(t, chr(1)) AS tokens, array_to_string(list_transform(t, lambda x, i: CASE WHEN i > 1 AND NOT contains('.,;:!?…)]}»', x[1]) THEN 'T' ELSE 'F' END), '') AS spaces FROM p WHERE item_id % 100 >= 50 AND len(t) BETWEEN 1 AND 128""")
def src_books(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items as word-annotated books (scanned with more or less confidence, a sentence ending after four words)."""
    tokens = F.filter(F.transform("tokens", lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[\s\p{Z}\p{Cc}]", "")), lambda t: t != "")
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    words = F.transform("t", lambda t, i: F.concat(F.when(i == 3, F.lit('<w c="&lt;&lt;&lt;">')).otherwise(F.lit("<w>")), esc(t), F.lit("</w><w> </w>")))
    books = table(spark, sf, "evaluation_item").select("item_id", tokens.alias("t")).select(
        F.concat(F.lit("lager/digibok_"), F.col("item_id").cast("string"), F.lit("-1901-nob-"), F.lpad((900 + F.col("item_id") % 100).cast("string"), 3, "0"), F.lit("--Ei_bok.txt.xml")).alias("name"),
        F.concat(F.lit("<doc>"), F.array_join(words, "\n"), F.lit("</doc>")).alias("xml"),
    )
    s = readers.book_sentences(books)
    return s.select("document_id", F.col("sentence_index").cast("int").alias("sentence_index"), F.array_join("tokens", "\x01").alias("tokens"), F.array_join(F.transform("has_space_before", lambda b: F.when(b, "T").otherwise("F")), "").alias("spaces"))


@query("""WITH p AS (SELECT document_id, try_cast(page AS INT) AS page, page_id, coalesce(text, '') AS text FROM (SELECT DISTINCT document_id, page, page_id, language_tag, text FROM scan_page) WHERE document_id IS NOT NULL AND language_tag = 'nb' AND regexp_matches(page, '^[0-9]+$'))
SELECT document_id, page, md5(text) AS digest, row_number() OVER (PARTITION BY document_id ORDER BY page, md5(text)) - 1 AS place FROM p""")
def src_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Scanned pages as objects of page triples, read again, one language kept, in page order."""
    p = table(spark, sf, "scan_page").select("document_id", "page", "page_id", "language_tag", "text").distinct().filter("document_id is not null and page rlike '^[0-9]+$'")
    triple = F.array(F.array("page", F.coalesce("language_tag", F.lit("")), F.coalesce("text", F.lit(""))))
    objects = p.select(F.to_json(F.create_map("document_id", triple)).alias("value"))
    pages = readers.pages_of(objects).filter("language = 'nb'").select("document_id", "page", F.md5("text").alias("digest"))
    return corpus.reindexed(pages, "document_id", "page", "digest", name="place").select("document_id", "page", "digest", F.col("place").cast("bigint").alias("place"))


@query("SELECT doc_id::VARCHAR AS document_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND NOT starts_with(text, chr(65279))")
def src_library(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as plain files in UTF-8 with or without a mark, or in Latin-1 where that is no UTF-8, decoded again."""
    d = table(spark, sf, "documents").filter("text is not null").filter(~F.col("text").startswith("﻿"))
    latin = F.col("text").rlike(r"^[\x{0}-\x{7F}\x{A0}-\x{FF}]*$") & (F.col("doc_id") % 2 == 1) & ~F.is_valid_utf8(F.encode("text", "ISO-8859-1").cast("string"))
    marked = F.encode(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("﻿")).otherwise(F.lit("")), F.col("text")), "UTF-8")
    files = d.select(F.concat(F.lit("file:/lager/a.b/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(marked).alias("content"))
    return readers.library_texts(files).select("document_id", F.md5("text").alias("digest"))


@query(f"WITH {SQL_TOKENS} SELECT 1::BIGINT AS format_version, 'silver' AS corpus_id, count(*) AS sentences, sum(len(tokens))::BIGINT AS tokens, count(DISTINCT document_id) AS documents, (sum(hash_sum) % 1)::BIGINT AS missing FROM (SELECT *, 0 AS hash_sum FROM sent WHERE len(tokens) > 0 AND document_id IS NOT NULL)")
def src_silver_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The silver corpus written as JSON lines with its manifest, both read again and compared."""
    s = inputs.sentences(spark, sf).filter("size(tokens) > 0 and document_id is not null").select("document_id", "sentence_index", "tokens", F.transform("tokens", lambda _, i: i > 0).alias("has_space_before"))
    path = shared_path(spark, "corpus-")
    sinks.write_corpus(s, path, {"corpus_id": "silver"}, "json")
    about = readers.read_manifest(spark, f"{path}/manifest")
    read = readers.read_silver(spark, f"{path}/data")
    corpus.validate(read, {k: about[k] for k in ("sentences", "tokens", "documents")})
    missing = s.exceptAll(read).agg(F.count("*").alias("missing"))
    fixed = spark.createDataFrame([(about["format_version"], about["corpus_id"])], "format_version bigint, corpus_id string")
    return fixed.crossJoin(corpus.manifest(read)).crossJoin(missing)  # one row each


@query("""WITH l AS (SELECT DISTINCT document_id, sentence_index FROM silver_label), n AS (SELECT (row_number() OVER (ORDER BY document_id, sentence_index) - 1) // 300 AS shard FROM l) SELECT shard, count(*) AS records, true AS hashed FROM n GROUP BY 1""")
def src_label_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Labels written in shards of 300 records with hashes and provenance, read again against the manifest."""
    path = shared_path(spark, "labels-")
    m = sinks.write_label_shards(inputs.labels(spark, sf).select("document_id", "sentence_index", "lemma_rule_ids"), path, 300, {"corpus_id": "silver"})
    read = readers.read_label_shards(spark, f"{path}/data", m, check_hashes=True)
    kept = spark.createDataFrame([(x["shard"], len(x["sha256"]) == 64) for x in m["shards"]], "shard bigint, hashed boolean")
    return read.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count("*").alias("records")).join(kept, "shard")


@query("SELECT item_id::INT AS id FROM evaluation_item WHERE item_id % 2 = 0 AND item_id % 5 <> 0")
def src_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """A book catalogue in CSV, with quotes and line breaks in its titles: the texts of one language."""
    rows = table(spark, sf, "evaluation_item").select(
        F.col("item_id").cast("string").alias("Text#"), F.when(F.col("item_id") % 5 == 0, "Sound").otherwise("Text").alias("Type"),
        F.concat(F.lit('A "title",\nand '), F.col("item_id").cast("string")).alias("Title"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("no").alias("Language"),
    )
    path = shared_path(spark, "catalogue-")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_catalog(spark, path)


@query("""SELECT '{"language_tag":"' || coalesce(language_tag, '') || '","sentences":' || count(*) || ',"tokens":' || coalesce(sum(len(tokens)), 0)::BIGINT || ',"documents":' || count(DISTINCT document_id) || '}' AS json FROM silver_sentence GROUP BY coalesce(language_tag, '')""")
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_json(corpus.manifest(table(spark, sf, "silver_sentence").withColumn("language_tag", F.coalesce("language_tag", F.lit(""))), "language_tag"))


@query("""WITH c AS (SELECT event_type AS name, count(*) AS errors FROM events GROUP BY 1) SELECT rpad(name, 24, ' ') || lpad(printf('%.4f', errors::DOUBLE), 12, ' ') || lpad(printf('%.4f', errors / sum(errors) OVER ()), 12, ' ') AS line, row_number() OVER (ORDER BY errors DESC, name)::INT AS rank FROM c""")
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned lines by falling errors, then name."""
    r = sinks.ranked(table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("errors")))
    return _numbered(sinks.report_text(r, "name", "errors", "share"))


def _numbered(lines: DataFrame) -> DataFrame:
    """The report's lines (a handful) with their place."""
    return lines.coalesce(1).select("line", (F.monotonically_increasing_id() + 1).cast("int").alias("rank"))


_PROSE = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[{}\[\]|<>&_]', '', 'g'), chr(39) || chr(39) || '+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM c), s AS (SELECT doc_id, i, regexp_replace(l, '^WS+|WS+$', '', 'g') AS l FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph, l AS text FROM s WHERE l <> '' AND NOT contains('=*#:;|!{_', l[1]) AND NOT contains(l, '://') AND NOT contains(l, 'www.')"""


@query(_PROSE.replace("WS", r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\pZ]"))
def wikitext_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dressed as wiki text (templates, tables, links within links, references, comments, tags) and stripped to what they were."""
    d = table(spark, sf, "documents").select("doc_id", "text").filter("text is not null")
    clean = F.regexp_replace(F.regexp_replace("text", r"[{}\[\]|<>&_]", ""), "''+", "")
    dressed = F.regexp_replace(clean, r"(\p{Lu}\p{Ll}+)", "[[Side|$1]]")
    dressed = F.regexp_replace(dressed, r"(\p{Nd}+)", "'''$1'''<ref name=\"a\">Sjå {{kjelde|[[x]]}}.</ref><!-- {| -->")
    whole = F.concat(F.lit("{{Info\n|x={{y|z}}\n}}\n== Head ==\n{| class=\"w\"\n| a || [[b]]\n{|\n| c\n|}\n|} rest\n[[Fil:a.jpg|thumb|Utsyn frå [[Hytta]].]]\n"), dressed, F.lit("\n* [https://a.no punkt]\n__NOTOC__\n"))
    return d.select("doc_id", F.posexplode(markup.wikitext_paragraphs(whole)).alias("paragraph", "text")).select("doc_id", F.col("paragraph").cast("bigint").alias("paragraph"), "text")


@query(r"SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def book_body(spark: SparkSession, sf: str) -> DataFrame:
    """Documents between a public-domain book's marks, and the body taken out again."""
    # The marks.
    begin, end = "Header\n*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***\nFooter"
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(markup.strip_boilerplate(F.concat(F.lit(begin), "text", F.lit(end)))).alias("digest"))
