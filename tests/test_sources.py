import json
import tarfile

import pytest
from pyspark.sql import functions as F

from nordlys.sources import archive, markup, readers, sinks
from nordlys.streaming import streams


def test_conllu(spark, tmp_path):
    line = "1\tLam\tlam\tNOUN\t_\tDefinite=Ind|Gender=Neut|Odd=a=b\t0\troot\t_\t_"
    (tmp_path / "a.conllu").write_text(f"# text\n{line}\n3-4\tx\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No\n\n{line}\n")
    t = readers.read_conllu(spark, str(tmp_path / "a.conllu"))
    rows = t.orderBy("sent_id", "tok_idx").collect()
    assert [r["form"] for r in rows] == ["Lam", "x", "Lam"] and rows[0]["features"] == {"Definite": "Ind", "Gender": "Neut", "Odd": "a=b"}
    assert [r["space_after"] for r in rows] == [True, False, True] and rows[1]["features"] == {}
    assert readers.first_sentence(t).count() == 2
    assert readers.read_conllu(spark, str(tmp_path / "a.conllu"), drop_multiword=True).count() == 2
    assert [r["has_space_before"] for r in readers.spacing_from_misc(t, "file", "sent_id").orderBy("sent_id", "tok_idx").collect()] == [False, True, False]


def test_dump(spark, tmp_path):
    page = lambda ns, i, extra, text: f"<page><ns>{ns}</ns><id>{i}</id>{extra}<revision><text>{text}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page(0, 11, "", "En artikkel.") + page(0, 12, '<redirect title="x"/>', "y") + page(1, 13, "", "prat") + page(0, 14, "", " ") + "</mediawiki>")
    assert [tuple(r) for r in readers.read_dump(spark, str(tmp_path / "d.xml")).collect()] == [(11, "En artikkel.")]
    (tmp_path / "e.xml").write_text("<mediawiki><page><id>1</id><revision><text>x</text></revision></page></mediawiki>")
    with pytest.raises(Exception, match="no namespace"):
        readers.read_dump(spark, str(tmp_path / "e.xml")).collect()


def test_wikitext():
    text = "{{Infoboks|a={{b}}}}\n'''Fjell''' er [[Stein (berg)|stein]].<ref name=x>kilde</ref>\n== Historie ==\n{|\n| tabell\n{|\n|}\n|}\n* liste\n[[Fil:x.jpg|bilde]]Se [https://a.b lenken] her.\nwww.x.no\nRest {{ubalansert\n__TOC__\nEt &amp; tegn.<br/>"
    assert markup.prose_paragraphs(text) == ["Fjell er stein.", "Se lenken her.", "Et & tegn."]
    assert markup.prose_paragraphs(None) == []


def test_books(spark, tmp_path):
    xml = '<d><w c="x">Hei</w><w> . </w><w c="&lt;&lt;&lt;"></w><w>Ny</w><w>setning</w><w>!</w></d>'
    b = spark.createDataFrame([("a/digibok_2006-1905-nob-975--En_bok.txt.xml", xml), ("digibok_2-1905-nob-800--x.txt.xml", xml), ("other.xml", xml)], "name string, xml string")
    rows = readers.book_sentences(b).orderBy("sentence_index").collect()
    assert [(r["document_id"], r["tokens"], r["has_space_before"]) for r in rows] == [("digibok_2006", ["Hei", "."], [False, False]), ("digibok_2006", ["Ny", "setning", "!"], [False, True, False])]
    m = b.select(readers.book_name(F.col("name")).alias("m")).first()["m"]
    assert m["title"] == "En bok" and m["year"] == 1905 and m["ocr_confidence"] == 0.975
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        (tmp_path / "x.txt.xml").write_text(xml)
        t.add(tmp_path / "x.txt.xml", "b/x.txt.xml")
        t.add(tmp_path / "x.txt.xml", "a/y.log")
    archive.register(spark)
    assert [r["name"] for r in spark.read.format("tartext").option("suffix", ".xml").load(str(tmp_path / "a.tar")).collect()] == ["b/x.txt.xml"]
    few = readers.book_sentences(b, most=2).collect()
    assert [r["sentence_index"] for r in few] == [0]


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"1": [["2", "nno", "b"], ["1", "nno", "a"], ["3", "nob", "c"]], "2": []}))
    p = readers.read_pages_json(spark, str(tmp_path / "p.json"))
    assert [tuple(r) for r in readers.ordered_pages(p, "nno").collect()] == [("1", ["a", "b"])]
    for bad in ("[]", '{"1": [["1", "x"]]}', '{"1": '):
        with pytest.raises(Exception):
            readers.pages_of(spark.createDataFrame([(bad,)], "value string")).collect()


@pytest.mark.parametrize("size", [1, 7, 64, 1024])
def test_giant_object_in_chunks(size):
    import io

    data = {"a": [["2", "nno", "tekst \"æøå\" 🙂"], ["1", "nob", "}{"]], "b": [], "ø": [["3", "nno", ""]]}
    assert dict(archive.object_items(io.StringIO(json.dumps(data, indent=1, ensure_ascii=False)), size)) == data
    for bad in ("[]", '{"a": [', '{"a" [1]}', '{1: []}', '{"a": [] "b": []}', ""):
        with pytest.raises(ValueError):
            list(archive.object_items(io.StringIO(bad), size))


def test_pages_source(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"1": [["2", "nno", "b"], ["1", "nno", "a"]]}))
    archive.register(spark)
    rows = spark.read.format("pagesjson").option("chunk", "5").load(str(tmp_path / "p.json")).orderBy("page").collect()
    assert [tuple(r) for r in rows] == [("1", 1, "nno", "a"), ("1", 2, "nno", "b")]


def test_plain_library_and_book(spark, tmp_path):
    head = "Title\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nCHAPTER I\n\nIt was\nlate. ___\n\n* * *\n\nEnd.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nfooter"
    (tmp_path / "pg1.txt").write_bytes(b"\xef\xbb\xbf" + head.encode())
    (tmp_path / "pg2.txt").write_bytes("blå".encode("latin-1"))
    d = readers.read_plain_library(spark, str(tmp_path)).orderBy("document_id")
    assert d.collect()[1]["text"] == "blå"
    assert d.select(markup.reflow(markup.strip_boilerplate(F.col("text")))).first()[0] == ["It was late. ___", "End."]


def test_silver_files(spark, tmp_path):
    rows = [("d", 0, ["a", "b"], [False, True]), ("d", 1, ["c"], [False])]
    s = spark.createDataFrame(rows, readers.SILVER_SCHEMA)
    full = sinks.write_corpus(s, str(tmp_path / "c"), {"corpus_id": "x"}, "json")
    assert (full["sentences"], full["tokens"], full["documents"]) == (2, 3, 1)
    assert readers.read_silver(spark, str(tmp_path / "c/data")).count() == 2
    assert readers.read_manifest(spark, str(tmp_path / "c/manifest"))["corpus_id"] == "x"
    with pytest.raises(ValueError):
        sinks.write_corpus(s.limit(0), str(tmp_path / "e"), {})
    with pytest.raises(FileExistsError):
        sinks.write_corpus(s, str(tmp_path / "c"), {"corpus_id": "y"}, "json")
    m = sinks.write_label_shards(s, str(tmp_path / "l"), 1, {"teacher": "t"})
    assert m["shard_count"] == 2 and m["teacher"] == "t" and readers.read_label_shards(spark, str(tmp_path / "l/data"), m, check_hashes=True).count() == 2
    changed = {**m, "shards": [{**x, "sha256": "0" * 64} for x in m["shards"]]}
    for wrong, hashes in (({**m, "shards": m["shards"][:1]}, False), (changed, True)):
        with pytest.raises(ValueError):
            readers.read_label_shards(spark, str(tmp_path / "l/data"), wrong, hashes)
    (tmp_path / "bad.json").write_text('{"document_id": 3, "tokens": "x"}\n')
    with pytest.raises(Exception):
        readers.read_silver(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "cat.csv").write_text('Text#,Type,Title,Language\n2,Text,"a,\nb",en\n1,Text,x,en\n3,Sound,x,en\nz,Text,x,en\n')
    assert [r["id"] for r in readers.read_catalog(spark, str(tmp_path / "cat.csv")).collect()] == [1, 2]
    assert json.loads(sinks.report_json(s).first()[0])["document_id"] == "d"
    assert sinks.report_text(spark.createDataFrame([("a", 0.5, None)], "name string, x double, y double"), "name", "x", "y").first()[0].split() == ["a", "0.5000", "-"]


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", ["a"]), ("2024-01-01 00:01:00", ["A"]), ("2024-01-01 00:02:00", ["b"])]
    spark.createDataFrame(rows, "ts string, tokens array<string>").selectExpr("cast(ts as timestamp) ts", "tokens").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, tokens array<string>").parquet(str(tmp_path / "in"))
    q = streams.stream_dedup(s, "ts").writeStream.foreachBatch(streams.corpus_appender(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
