"""Readers: treebanks, encyclopedia dumps, word-annotated books, page files, plain books, silver corpora.

Each gives a DataFrame with an explicit schema; files are listed and split by
Spark.  Order is data: sentence, page and token numbers are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nordlys.functions.text import NO_SPACE_BEFORE
from nordlys.operators.corpus import reindexed

TOKEN_SCHEMA = "file string, sent_id bigint, tok_idx int, form string, lemma string, upos string, features map<string,string>, space_after boolean"
SILVER_SCHEMA = "document_id string, sentence_index int, tokens array<string>, has_space_before array<boolean>"
PAGE_SCHEMA = "ns bigint, id bigint, redirect struct<_title:string>, revision struct<text:string>"


def parse_token_line(line: Column) -> Column:
    """A CoNLL-U token line as a struct; features split at their first ``=``, ``_`` is none."""
    col = lambda i: F.get(F.split(line, "\t"), F.lit(i))
    pairs = F.transform(F.split(col(5), r"\|"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    return F.struct(
        col(1).alias("form"), col(2).alias("lemma"), col(3).alias("upos"),
        F.when(col(5) == "_", F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(pairs)).alias("features"),
        (~F.array_contains(F.split(F.coalesce(col(9), F.lit("_")), r"\|"), "SpaceAfter=No")).alias("space_after"),
    )


def parse_blocks(blocks: DataFrame, *keys: str, drop_multiword: bool = False) -> DataFrame:
    """Tokens of sentence blocks (column ``value``): comment lines skipped, all other lines kept.

    With ``drop_multiword`` ranges (``3-4``) and empty nodes (``3.1``) go too.
    """
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda l: (F.trim(l) != "") & ~l.startswith("#"))
    if drop_multiword:
        lines = F.filter(lines, lambda l: ~F.substring_index(l, "\t", 1).rlike("[-.]"))
    rows = blocks.select(*keys, F.posexplode(lines).alias("tok_idx", "_line"))
    return rows.select(*keys, "tok_idx", parse_token_line(F.col("_line")).alias("_t")).select(*keys, "tok_idx", "_t.*")


def read_conllu(spark: SparkSession, path: str, drop_multiword: bool = False) -> DataFrame:
    """Tokens of CoNLL-U files keyed (file, sent_id, tok_idx); a missing last blank line is fine.

    Blocks are cut by the reader at blank lines (a file with CRLF line ends is
    read whole and cut then); ``sent_id`` is the sentence's ordinal in its file,
    from 0, made over the splits' order without holding a file in one task.
    """
    raw = spark.read.option("lineSep", "\n\n").text(path)
    at = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    cut = at.select("file", "_start", "_row", F.posexplode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("_part", "value"))
    numbered = reindexed(cut.filter(F.col("value").rlike(r"(?m)^[^#\s]")), "file", "_start", "_row", "_part", name="sent_id")
    return parse_blocks(numbered.withColumn("sent_id", F.col("sent_id").cast("bigint")), "file", "sent_id", drop_multiword=drop_multiword)


def first_sentence(tokens: DataFrame) -> DataFrame:
    """The tokens of each file's first sentence."""
    first = tokens.groupBy("file").agg(F.min("sent_id").alias("sent_id"))
    return tokens.join(first, ["file", "sent_id"], "left_semi")


def spacing_from_misc(tokens: DataFrame, *sentence: str) -> DataFrame:
    """has_space_before from the previous token's space_after; False for the first."""
    from pyspark.sql import Window

    w = Window.partitionBy(*sentence).orderBy("tok_idx")
    return tokens.withColumn("has_space_before", F.coalesce(F.lag("space_after").over(w), F.lit(False)))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, text) of an encyclopedia's XML dump: articles, no redirects, not empty; a page without
    namespace or id is an error.  Compressed dumps are read by the codec."""
    raw = spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)
    return dump_articles(raw)


def dump_articles(raw: DataFrame) -> DataFrame:
    # The error is part of the one condition, so no pushed filter can hide it.
    bad = F.col("ns").isNull() | F.col("id").isNull()
    wanted = (F.col("ns") == 0) & F.col("redirect").isNull() & (F.trim("revision.text") != "")
    checked = F.when(bad, F.raise_error(F.lit("a page has no namespace or id")).cast("boolean")).otherwise(wanted)
    return raw.filter(checked).select(F.col("id").alias("page_id"), F.col("revision.text").alias("text"))


def book_name(name: Column) -> Column:
    """Metadata of a digitised book's file name; null where the name has another form."""
    pattern = r"^(digibok_[^-]+)-([0-9]{4})-([a-z]{3})-([0-9]{3})--(.+)\.txt\.xml$"
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    part = lambda i: F.regexp_extract(base, pattern, i)
    fields = F.struct(part(1).alias("document_id"), part(2).cast("int").alias("year"), part(3).alias("language"), (part(4).cast("double") / 1000).alias("ocr_confidence"), F.replace(part(5), F.lit("_"), F.lit(" ")).alias("title"))
    return F.when(base.rlike(pattern), fields)


def attached_spacing(tokens: Column) -> Column:
    """Space before each token but the first and those that start with closing punctuation."""
    return F.transform(tokens, lambda t, i: (i > 0) & ~F.substring(t, 1, 1).isin(*NO_SPACE_BEFORE))


def word_sentences(words: Column, most: int = 128) -> Column:
    """Sentences of (text, c) word structs: stripped, empty words ignored, a ``<<<`` in c ends a sentence.

    Sentences above ``most`` tokens are dropped but keep their number.
    """
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))

    def step(state: Column, w: Column) -> Column:
        grown = F.when(F.trim(F.coalesce(w["text"], F.lit(""))) != "", F.concat(state["open"], F.array(F.trim(w["text"])))).otherwise(state["open"])
        ends = F.coalesce(w["c"], F.lit("")).contains("<<<") & (F.size(grown) > 0)
        return F.struct(F.when(ends, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"), F.when(ends, F.array().cast("array<string>")).otherwise(grown).alias("open"))

    all_ = F.aggregate(words, empty, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return F.filter(F.transform(all_, lambda t, i: F.struct(i.alias("sentence_index"), t.alias("tokens"))), lambda x: F.size(x["tokens"]) <= most)


def book_sentences(books: DataFrame, language: str = "nob", confidence: float = 0.95, most: int = 128) -> DataFrame:
    """Sentences of word-annotated books (name, xml): language and confidence are tested on the name,
    before any markup is parsed; unreadable names are skipped."""
    chosen = books.withColumn("_m", book_name(F.col("name"))).filter((F.col("_m.language") == language) & (F.col("_m.ocr_confidence") >= confidence))
    flat = F.regexp_extract_all("xml", F.lit(r"(?s)<w\b[^>]*>[^<]*</w>|<w\b[^>]*/>"), F.lit(0))
    unescape = lambda t: F.replace(F.replace(F.replace(F.replace(F.replace(t, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    words = F.transform(flat, lambda w: F.struct(unescape(F.regexp_extract(w, r"(?s)>([^<]*)</w>", 1)).alias("text"), unescape(F.regexp_extract(w, r"\bc=[\"']([^\"']*)", 1)).alias("c")))
    staged = chosen.select("_m.document_id", words.alias("_w"))
    return staged.select("document_id", F.inline(word_sentences(F.col("_w"), most))).withColumn("has_space_before", attached_spacing(F.col("tokens")))


def read_pages_json(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page, language, text) of files holding one object of documents with page triples."""
    raw = spark.read.option("wholetext", True).text(path)
    return pages_of(raw)


def pages_of(raw: DataFrame) -> DataFrame:
    """Page rows of JSON objects in column ``value``; anything but an object of triples is an error."""
    parsed = F.from_json("value", "map<string,array<array<string>>>", {"mode": "FAILFAST"})
    docs = raw.select(F.when(F.trim("value").startswith("{"), parsed).otherwise(F.raise_error(F.lit("not an object of documents")).cast("map<string,array<array<string>>>")).alias("m"))
    entries = docs.select(F.explode("m").alias("document_id", "entries")).select("document_id", F.explode("entries").alias("e"))
    checked = F.when((F.size("e") == 3) & ~F.exists("e", lambda x: x.isNull()), F.col("e")).otherwise(F.raise_error(F.lit("a page entry is not three strings")).cast("array<string>"))
    return entries.select("document_id", checked.alias("e")).select("document_id", F.get("e", F.lit(0)).cast("int").alias("page"), F.get("e", F.lit(1)).alias("language"), F.get("e", F.lit(2)).alias("text"))


def ordered_pages(pages: DataFrame, language: str | None = None) -> DataFrame:
    """(document_id, pages): texts of a document's pages of one language in page order.

    Page lists are what a document's text is made of; use it where documents are bounded.
    """
    rows = pages.filter(F.col("language") == language) if language else pages
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p")).select("document_id", F.transform("p", lambda x: x["text"]).alias("pages"))


def read_plain_library(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) of plain text files: the id is the stem, UTF-8 with or without a mark, else Latin-1."""
    return library_texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path))


def library_texts(files: DataFrame) -> DataFrame:
    """(document_id, text) of files given as path and content."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("document_id"), F.regexp_replace(text, "^﻿", "").alias("text"))


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    """A silver corpus of JSON lines; a malformed record is an error."""
    return spark.read.schema(SILVER_SCHEMA).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return spark.read.option("multiLine", True).json(path).first().asDict(recursive=True)


def files_sha256(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_label_shards(spark: SparkSession, path: str, manifest: dict | None = None, check_hashes: bool = False) -> DataFrame:
    """Label shards in manifest order (column shard); with a manifest the shards and their record counts must
    agree, and with ``check_hashes`` the files' contents too."""
    rows = spark.read.parquet(path)
    if manifest:
        found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
        if found != {x["shard"]: x["record_count"] for x in manifest["shards"]}:
            raise ValueError("label shards and manifest differ in their records")
        if check_hashes and shard_hashes(spark, path) != {x["shard"]: x["sha256"] for x in manifest["shards"]}:
            raise ValueError("label shards and manifest differ in their contents")
    return rows


def shard_hashes(spark: SparkSession, path: str) -> dict[int, str]:
    """Of each shard the hash of its files' hashes, in the files' order."""
    files = files_sha256(spark, path, "*.parquet").withColumn("shard", F.regexp_extract("path", "shard=([0-9]+)", 1).cast("bigint"))
    whole = files.groupBy("shard").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), ""), 256).alias("sha256"))
    return {r["shard"]: r["sha256"] for r in whole.collect()}


def read_catalog(spark: SparkSession, path: str, kind: str = "Text", language: str = "en") -> DataFrame:
    """Ids of a book catalogue's texts of one language, sorted."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.filter((F.col("Type") == kind) & (F.col("Language") == language)).select(F.col("Text#").try_cast("int").alias("id")).filter("id is not null").orderBy("id")
