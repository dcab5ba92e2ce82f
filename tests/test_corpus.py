"""Corpus operators, artifacts, schemas as JSON, offline entry points and session helpers."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from nordlys import pipeline, session
from nordlys.operators import annotate, corpus, probability, schema, subword
from nordlys.operators.segmentation import Policy
from nordlys.sources import archive, artifact, markup
from nordlys.streaming import streams


def test_first_seen_with_null_places_and_keys(spark):
    rows = [(None, 0, "k"), ("a", 1, "k"), ("b", 2, "m"), ("c", 3, None), ("c", 3, None), ("b", 2, "m")]
    d = spark.createDataFrame(rows, "d string, i int, fingerprint string")
    got = sorted(corpus.first_seen(d, "d", "i").collect(), key=str)
    assert sorted((str(r["d"]), r["i"], str(r["fingerprint"])) for r in got) == [("None", 0, "k"), ("b", 2, "m"), ("c", 3, "None"), ("c", 3, "None")]
    assert corpus.first_seen(d.limit(0), "d", "i").count() == 0


def test_running_total_over_a_hot_key(spark):
    d = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id", F.lit("x").alias("before"))
    got = corpus.running_total(d, F.when(F.col("id") != 7, F.col("id")), "k", "id", name="total").orderBy("k", "id").collect()
    total = 0
    for r in got:
        assert r["total"] == total
        total += r["id"] if r["id"] != 7 else 0
    assert corpus.running_total(d.limit(0), F.col("id"), "id").count() == 0


def test_decontamination_in_any_unicode_form(spark):
    d = corpus.with_fingerprint(spark.createDataFrame([(1, ["Blå", "hus"]), (2, ["blå", "HUS"]), (3, ["rødt"]), (4, None)], "id int, tokens array<string>"))
    gold = [spark.createDataFrame([(["BLÅ", "hus"],), (None,)], "tokens array<string>"), spark.createDataFrame([(["x"],)], "tokens array<string>")]
    keys = corpus.gold_fingerprints(*gold)
    assert keys.count() == 2
    assert {r["id"] for r in corpus.decontaminate(d, keys).collect()} == {3, 4}
    assert {r["id"] for r in corpus.first_seen(d, "id").collect()} == {1, 3, 4}


def test_labels_align_with_their_corpus(spark):
    s = spark.createDataFrame([("a", 0, ["x", "y"]), ("a", 1, ["z"]), ("a", 2, ["w"]), ("b", 0, ["v"])], "document_id string, sentence_index int, tokens array<string>")
    kind = "document_id string, sentence_index int, upos_probabilities array<array<float>>, lemma_rule_ids array<array<int>>"
    one = [[1.0]]
    labels = spark.createDataFrame([("a", 0, one * 2, None), ("b", 0, one * 3, None), ("a", 2, one, None), ("c", 0, one, None)], kind)
    got = {(r["document_id"], r["sentence_index"]): r["status"] for r in probability.align_labels(s, labels, strict=False).collect()}
    assert got == {("a", 0): "aligned", ("b", 0): "misaligned", ("a", 2): "gap", ("c", 0): "missing"}
    assert probability.align_labels(s, labels.filter("document_id = 'a' and sentence_index = 0")).count() == 1
    with pytest.raises(Exception, match="do not align"):
        probability.align_labels(s, labels).collect()


def test_morphology_masks_tokens(spark):
    kind = "document_id string, sentence_index int, upos_probabilities array<array<float>>, morphology_probabilities map<string,array<array<float>>>, lemma_rule_ids array<array<int>>, lemma_rule_probabilities array<array<float>>, agreement_upos_ids array<int>, agreement_lemma_rule_ids array<int>, agreement_morphology map<string,array<array<boolean>>>"
    sure, unsure = [0.0, 0.95, 0.05], [0.4, 0.6, 0.0]
    row = lambda i, m, a: ("d", i, [[1.0, 0.0]] * 2, {"Number": m}, [[3, 1]] * 2, [[1.0, 0.0]] * 2, [0, 0], [3, 3], {"Number": a})
    agrees, differs = [False, True, False], [True, False, False]
    rows = [row(0, [sure, sure], [agrees, agrees]), row(1, [sure, unsure], [agrees, agrees]), row(2, [sure, sure], [agrees, differs]), row(3, [sure], [agrees, agrees])]
    rows.append(("d", 4, None, None, None, None, None, None, None))
    f = probability.silver_filter(probability.token_labels(spark.createDataFrame(rows, kind)))
    assert {r["sentence_index"]: (r["morphology_kept"], r["keep"]) for r in f.collect()} == {0: (2, True), 1: (1, False), 2: (1, False), 3: (1, False)}
    several = probability.token_labels(spark.createDataFrame(rows[:1], kind), {"Number": True}).first()
    assert several["morphology"]["Number"] == [False, False, True, False] and abs(several["morphology_confidence"] - 0.95) < 1e-6


def test_schemas_as_json(spark):
    tokens = spark.createDataFrame([("NOUN", {"Gender": "Fem,Masc"}), ("VERB", {"Number": "Plur"})], "upos string, features map<string,string>")
    rules = schema.lemma_rule_schema(spark.createDataFrame([(0, 1, "", "å"), (0, 0, "", "")], "pr int, sr int, pa string, sa string"))
    tables = schema.upos_schema(tokens), schema.morphology_schema(tokens), rules
    text = schema.schema_json(*tables)
    for got, want in zip(schema.schema_of_json(spark, text), tables):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    with pytest.raises(ValueError):
        schema.schema_of_json(spark, '{"format_version": 2}')


def test_artifact(spark, tmp_path):
    about = {"artifact_name": "x", "artifact_version": "1", "language_tags": ["nb"], "segmentation": {"abbreviations": ["f.eks."]}, "programs": [{"backend": "xnnpack", "subwords": 128, "tokens": 64, "file": "b"}, {"backend": "xnnpack", "subwords": 64, "tokens": 32, "file": "a"}, {"backend": "other", "subwords": 1, "tokens": 1, "file": "c"}]}
    (tmp_path / "a.json").write_text(json.dumps(about))
    a = artifact.read_artifact(spark, str(tmp_path / "a.json"))
    assert [p.file for p in a.programs] == ["a", "b"] and a.program_for(65, 3).file == "b" and a.policy().abbreviations == {"f.eks."}
    with pytest.raises(ValueError):
        a.program_for(500, 1)
    (tmp_path / "b.json").write_text(json.dumps({**about, "artifact_version": None}))
    with pytest.raises(ValueError):
        artifact.read_artifact(spark, str(tmp_path / "b.json"))


def test_parity_fixture(spark):
    d = spark.createDataFrame([(1, ["Hei", " verden", "!"])], "id bigint, words array<string>")
    got = json.loads(subword.parity_fixture(d, "id", "/opt/tokenizers/byte_bpe_50k.json", "v1").first()["json"])
    assert got["policy"] == "v1" and sum(got["counts"]) == len(got["ids"]) and len(got["counts"]) == 3


def test_offline_entry_points(spark, tmp_path):
    text = "Kommunestyret godkjente ikke budsjettet for neste år. Han ventet lenge på den gamle losen. Dette er en gylden setning."
    docs = spark.createDataFrame([("a", text), ("b", text + " Noe nytt sto i avisen den dagen."), ("c", None)], "document_id string, text string")
    gold = [spark.createDataFrame([("Dette er en gylden setning .".split(),)], "tokens array<string>")]
    path = f"file://{tmp_path}/corpus"
    m = pipeline.prepare_silver_corpus(docs, Policy(), gold, path, {"corpus_id": "x"})
    rows = sorted((r["document_id"], r["sentence_index"]) for r in spark.read.json(f"{path}/data").collect())
    assert rows == [("a", 0), ("a", 1), ("b", 0)] and m["sentences"] == 3
    sentences = pipeline.silver_sentences(docs, Policy(), gold)
    made = pipeline.label_silver_corpus(sentences, annotate.shape_scorer, f"file://{tmp_path}/labels", 10, {"teacher": "shape"}, second=annotate.shape_scorer, shard=1)
    assert made["record_count"] == 2 and made["teacher"] == "shape"  # the sentence that crosses the budget counts
    labels = spark.read.parquet(f"file://{tmp_path}/labels/data").drop("shard")
    f = probability.silver_filter(probability.token_labels(labels), 0.6)
    assert f.count() == 2 and all(r["upos_kept"] == r["tokens"] for r in f.collect())
    assert [t.count() for t in annotate.label_tables(spark, annotate.SHAPE_LABELS)] == [4, 4, 3]


def test_archives_by_uri(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("x/2.txt", "blå".encode("latin-1")), ("x/1.txt", "﻿rød".encode()), ("x/3.xml", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    archive.register(spark)
    for path in (str(tmp_path / "a.tar.gz"), f"file://{tmp_path}/*.tar.gz"):
        got = {r["name"]: r["text"] for r in spark.read.format("tartext").option("suffix", ".txt").load(path).collect()}
        assert got == {"x/1.txt": "rød", "x/2.txt": "blå"}
    pages = {"a": [["2", "nob", 'med "hermetegn" og \\ strek [x]'], ["1", "nno", "{å}"]], "b\n": []}
    for size in (1, 3, 7, 1000):
        assert dict(archive.object_items(io.StringIO(json.dumps(pages)), size)) == pages
        for bad in ("[]", '{"a": [["1"', '{"a" 1}', '{3: []}', "{"):
            with pytest.raises(ValueError):
                list(archive.object_items(io.StringIO(bad), size))


def test_wikitext_constructs():
    read = markup.prose_paragraphs
    assert read("'''Byen''' er [[Land|stor]].<ref name=\"a\">{{x}} [[y]]</ref> Ja.") == ["Byen er stor. Ja."]
    assert read("[[Fil:a.jpg|thumb|Utsyn frå [[Hytta]].]]\nTekst[[Kategori:Fjell]] her [[Lom#Sør]].") == ["Tekst her Lom."]
    assert read("{|\n|a\n{|\n|b\n|}\n|} etter\nProsa {{mal\n|x={{y}}\n}}slutt.") == ["Prosa slutt."]
    assert read("Sjå [https://a.no kartet] no.\nEin [https://a.no] til") == ["Sjå kartet no.", "Ein  til"]
    assert read("Open {{mal\nEin ]] rest\nwww.x.no\n* liste\n&lt;b&gt;\n") == []
    assert read("{|\nnever ends\nx") == [] and read(None) == [] and read("a<br/>b <math>x") == ["a b  x"]


def test_streams_of_profiles_and_gold(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", ["Å", "b"]), ("2024-01-01 00:30:00", ["å"]), ("2024-01-01 02:00:00", ["c"])]
    spark.createDataFrame(rows, "ts string, tokens array<string>").selectExpr("cast(ts as timestamp) ts", "tokens").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, tokens array<string>").parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(90)
        return spark.table(name)

    counts = run(streams.stream_profile(read().select("ts", F.explode("tokens").alias("form")), "ts"), "complete", "profile")
    assert {(r["form"], r["cnt"]) for r in counts.collect()} == {("å", 2), ("b", 1), ("c", 1)}
    gold = corpus.with_fingerprint(spark.createDataFrame([(["Å"],)], "tokens array<string>"))
    assert [r["tokens"] for r in run(streams.stream_decontaminate(read(), gold), "append", "clean").orderBy("ts").collect()] == [["Å", "b"], ["c"]]


def test_broadcast_is_checked_by_rows_and_bytes(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    few = spark.range(100).withColumn("x", F.repeat(F.lit("y"), 10))
    assert hinted(session.small(few, derived=True))
    assert not hinted(session.small(few, rows=50, derived=True))
    assert not hinted(session.small(few, width=500, derived=True))


def test_well_split_scans_are_not_shuffled(spark, tmp_path):
    spark.range(1000).repartition(16).write.parquet(str(tmp_path / "many"))
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    exchanged = lambda p: "Exchange" in session.spread(spark.read.parquet(str(tmp_path / p)), "id")._jdf.queryExecution().executedPlan().toString()
    assert not exchanged("many") or spark.read.parquet(str(tmp_path / "many")).rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    assert exchanged("one")
