import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.operators import ranges
from nordlys.operators import segmentation as seg

EXTRACT = seg.Policy(frozenset({"f.eks.", "nr.", "kl."}), 3, 64, 0.5)
RUNTIME = seg.Policy(frozenset({"f.eks."}), 1, 8, 0.5)


def sentences(spark, text, policy=RUNTIME):
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [(r["tokens"], r["has_space_before"]) for r in seg.segment(d, policy, "doc_id").orderBy("sentence_index").collect()]


def extracted(spark, text, policy=EXTRACT):
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    return [r["tokens"] for r in seg.extract(d, policy, "doc_id").orderBy("place").collect()]


def test_quotes_and_spacing(spark):
    (tokens, flags), rest = sentences(spark, "Hun sa «nei», ikke sant?", seg.Policy(frozenset({"f.eks."}), 1, 64))[0], None
    assert len(tokens) == 9 and flags == [False, True, True, False, False, False, True, True, False]


def test_missing_spaces_fragments_and_chunks(spark):
    assert [len(t) for t, _ in sentences(spark, "Han ville gå.De kom.")] == [4, 3]
    assert [t for t, _ in sentences(spark, "OVERSKRIFT HER\nHan kom hjem.\nog så videre")] == [["OVERSKRIFT", "HER"], ["Han", "kom", "hjem", "."], ["og", "så", "videre"]]
    chunks = sentences(spark, " ".join(["ord"] * 19) + ".")
    assert [len(t) for t, _ in chunks] == [8, 8, 4] and all(not f[0] for _, f in chunks)
    assert sentences(spark, None) == sentences(spark, " \n ") == []


def test_protection(spark):
    got = [t for t, _ in sentences(spark, "Den 17. mai spiste de f.eks. Kake. Så gikk de.", seg.Policy(frozenset({"f.eks."}), 1, 64))]
    assert [len(t) for t in got] == [8, 4] and "17." in got[0] and "f.eks." in got[0]


def test_extraction(spark):
    assert extracted(spark, "Dette gjelder klima-\nbudsjett for alle.") == [["Dette", "gjelder", "klimabudsjett", "for", "alle", "."]]
    assert extracted(spark, "SAK\n\nsmå bokstaver først her.\n\nKort.\n\nDette er en fin setning.") == [["Dette", "er", "en", "fin", "setning", "."]]
    assert extracted(spark, "Se sak 2020/42652-5 fra 07.02.2017, takk.")[0][2] == "2020/42652-5"
    assert extracted(spark, "Innhold og tema..") == [] and extracted(spark, "Et viktig punkt....") == []
    assert len(extracted(spark, "Han ville ikke kom...")) == 1


def test_policy_is_checked():
    with pytest.raises(ValueError):
        seg.Policy(frozenset({"Nr."}))
    with pytest.raises(ValueError):
        seg.Policy(frozenset(), 5, 3)


def test_ranges():
    one = ranges.map_text("Katten sov. Hunden sov.", RUNTIME)
    assert [r for _, _, tr, _ in one for r in tr] == [[(0, 6)], [(7, 10)], [(10, 11)], [(12, 18)], [(19, 22)], [(22, 23)]]
    assert [sr for *_, sr in one] == [[(0, 11)], [(12, 23)]]
    assert ranges.map_text("  Hun sov.  ", RUNTIME)[0][3] == [(2, 10)]
    assert [r for r in ranges.map_text("Blåbær smaker godt.", RUNTIME)[0][2]] == [[(0, 8)], [(9, 15)], [(16, 20)], [(20, 21)]]
    assert [s[3] for s in ranges.map_text("De gikk.De kom.De sov.", RUNTIME)] == [[(0, 8)], [(8, 15)], [(15, 22)]]
    broken = ranges.map_text("Dette er språk-\nmodellen til laget.", RUNTIME)[0]
    assert broken[2][2] == [(9, 15), (17, 25)] and broken[3] == [(0, 15), (17, 36)]
    assert ranges.map_text(None, RUNTIME) == []
    assert [s[3] for s in ranges.map_text(" ".join(["katt"] * 19) + ".", RUNTIME)] == [[(0, 39)], [(40, 79)], [(80, 95)]]


@given(st.text(alphabet="abcÆØå. -!?…«»\n\"'12🙂", max_size=80))
@settings(max_examples=150, deadline=None)
def test_ranges_are_ordered_and_inside(text):
    size = len(text.encode())
    for _, _, token_ranges, sentence_ranges in ranges.map_text(text, RUNTIME):
        flat = [r for rs in token_ranges for r in rs]
        assert all(0 <= a < b <= size for a, b in flat)
        assert all(x[1] <= y[0] for x, y in zip(flat, flat[1:]))
        assert sentence_ranges[0][0] == flat[0][0] and sentence_ranges[-1][1] == flat[-1][1]


def test_offsets(spark):
    text = "a🙂ø"
    assert [ranges.utf16_offset(text, b) for b in (0, 1, 5, 7)] == [0, 1, 3, 4]
    assert [ranges.utf8_offset(text, u) for u in (0, 1, 3, 4)] == [0, 1, 5, 7]
    with pytest.raises(ValueError):
        ranges.utf8_offset(text, 2)
    d = spark.createDataFrame([(text, b) for b in (0, 1, 5, 7)] + [(None, 1), (text, None)], "t string, b int")
    assert [r[0] for r in d.select(X.utf8_to_utf16(F.col("t"), F.col("b"))).collect()] == [0, 1, 3, 4, None, None]
    d = spark.createDataFrame([(text, u) for u in (0, 1, 3, 4)] + [(None, 1), (text, None)], "t string, u int")
    assert [r[0] for r in d.select(X.utf16_to_utf8(F.col("t"), F.col("u"))).collect()] == [0, 1, 5, 7, None, None]
    for change, at in ((X.utf8_to_utf16, 2), (X.utf8_to_utf16, 9), (X.utf8_to_utf16, -1), (X.utf16_to_utf8, 2), (X.utf16_to_utf8, 5)):
        with pytest.raises(Exception, match="no character boundary"):
            spark.createDataFrame([(text, at)], "t string, a int").select(change(F.col("t"), F.col("a"))).collect()


@pytest.mark.parametrize("name, profile, sentences, tokens", [("bokmaal", "norwegian", 55, 905), ("nynorsk", "norwegian", 41, 803), ("english", "english", 51, 788)])
def test_whole_texts(spark, name, profile, sentences, tokens):
    from pathlib import Path

    from nordlys.profiles import PROFILES

    text = (Path(__file__).parent / "data" / f"{name}.txt").read_text(encoding="utf-8")
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for rows in (seg.segment(docs, PROFILES[profile].policy(), "doc_id"), ranges.segment_with_ranges(docs, PROFILES[profile].policy())):
        assert rows.agg(F.count("*"), F.sum(F.size("tokens"))).first()[:] == (sentences, tokens)


def test_range_checks(spark):
    rows = [(["a", "b"], [[(0, 1)], [(2, 3)]], True), (["a"], [[(1, 1)]], False), (["a", "b"], [[(0, 2)], [(1, 3)]], False), (["a", "b"], [[(0, 1)]], False)]
    d = spark.createDataFrame(rows, "t array<string>, r array<array<struct<start:bigint,end:bigint>>>, fine boolean")
    assert all(r[0] == r[1] for r in d.select(ranges.ranges_valid(F.col("t"), F.col("r")), "fine").collect())
    c = d.limit(1).select(ranges.clip(F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(6).alias("start"), F.lit(9).alias("end"))), F.lit(2), F.lit(6))).first()[0]
    assert [tuple(x) for x in c] == [(2, 4)]


def test_profiles():
    from nordlys.profiles import profile_of

    assert "f.eks." in profile_of("nb", "nn").policy().abbreviations and "e.g." in profile_of("en").policy().abbreviations
    assert (len(profile_of("nn").abbreviations), len(profile_of("en").abbreviations)) == (42, 71)
    with pytest.raises(ValueError):
        profile_of("nb", "en")


def test_ranges_come_in_parts():
    """However many texts an Arrow batch holds, a task keeps the rows of a bounded number of tokens."""
    import pyarrow as pa

    text = "Blåbær smaker godt, sa hun. Dette er språk-\nmodellen til laget."
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, 12_000)], pa.int64()), "text": [None if i == 5 else text for i in range(12_000)]})
    parts = list(ranges.in_parts(iter([batch]), RUNTIME, "doc_id", True))
    assert max(sum(len(t) for t in p.column("tokens")) for p in parts) < ranges.TOGETHER + RUNTIME.maximum_tokens
    rows = [r for p in parts for r in p.to_pylist()]
    assert [r["doc_id"] for r in rows[::2]] == [None, *(i for i in range(1, 12_000) if i != 5)] and len(rows) == 2 * 11_999
    for r in rows[:4] + rows[-2:]:
        base = r["token_ranges"][0][0]["start"]
        assert r["tokens"] == [b"".join(r["raw"][x["start"] - base : x["end"] - base] for x in t).decode() for t in r["token_ranges"]]
        assert (r["tokens"], r["has_space_before"], [[(x["start"], x["end"]) for x in t] for t in r["token_ranges"]]) == ranges.map_text(text, RUNTIME)[r["sentence_index"]][:3]


def test_ranges_check_joins_nothing(spark, tmp_path):
    """No text goes with each of its sentences, or through the driver; a document without a key counts, as in SQL."""
    from nordlys.plans import check_queries

    spark.createDataFrame([(1, "Katten sov. Hunden sov."), (None, "Hun kom.")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(["f.eks."],)], "abbreviation_tokens array<string>").write.parquet(str(tmp_path / "segmentation_policy.parquet"))
    found = check_queries.ranges_check(spark, str(tmp_path))
    assert sorted(found.collect(), key=str) == [(1, 2, 6, True, True), (None, 1, 3, True, True)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
