import math
import random

import pytest
from pyspark.sql import functions as F

from nordlys.functions import text as X
from nordlys.functions import vectors as V
from nordlys.operators import annotate, bundles, corpus, evaluation, probability, sampling, schema, subword
from nordlys.operators.segmentation import Policy

TOKEN = "sent_id int, tok_idx int, form string, lemma string, upos string, features map<string,string>"


def rules(spark, pairs):
    d = spark.createDataFrame(pairs, "t string, l string")
    return [tuple(r[0]) for r in d.select(X.derive_rule(F.col("t"), F.col("l"))).collect()]


def test_lemma_rules(spark):
    pairs = [("husene", "hus"), ("gikk", "gå"), ("forhånd", "hånd"), ("x", "y"), ("", "a"), ("🙂er", "🙂")]
    got = rules(spark, pairs)
    assert got[:4] == [(0, 3, "", ""), (0, 3, "", "å"), (3, 0, "", ""), (0, 1, "", "y")]
    d = spark.createDataFrame([(t, l, *r) for (t, l), r in zip(pairs, got)], "t string, l string, pr int, sr int, pa string, sa string")
    assert all(r[0] == r[1] for r in d.select(X.apply_rule(F.col("t"), F.struct("pr", "sr", "pa", "sa")), "l").collect())
    bad = spark.createDataFrame([("hus", 2, 2, "", "")], "t string, pr int, sr int, pa string, sa string")
    assert bad.select(X.apply_rule(F.col("t"), F.struct("pr", "sr", "pa", "sa"))).first()[0] is None


def test_rule_blocks_equal_the_standard_matcher(spark):
    from difflib import SequenceMatcher

    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcæ") for _ in range(rng.randint(1, 8))), "".join(rng.choice("abcæ") for _ in range(rng.randint(1, 8)))) for _ in range(300)]
    for (t, l), (pr, sr, pa, sa) in zip(pairs, rules(spark, pairs)):
        m = SequenceMatcher(None, t, l, autojunk=False).find_longest_match(0, len(t), 0, len(l))
        want = (m.a, len(t) - m.a - m.size, l[: m.b], l[m.b + m.size :]) if m.size else (0, len(t), "", l)
        assert (pr, sr, pa, sa) == want


def test_scalars(spark):
    d = spark.createDataFrame([("$.", ["Å", "x"]), ('$"', ["Å", None]), ("$$", [])], "l string, t array<string>")
    assert [r[0] for r in d.select(X.strip_marker(F.col("l"))).collect()] == [".", '"', "$"]
    prints = [r[0] for r in spark.createDataFrame([(["Å"],), (["å"],), (["a"],), (None,)], "t array<string>").select(X.fingerprint(F.transform("t", lambda x: x))).collect()]
    assert prints[2] != prints[0] and prints[3] is None
    forms = [(["Ångström", "ﬁn", "ΟΔΟΣ"],), (["A\u030angstro\u0308m", "FIN", "οδος"],), (["ångström", "fin", "οδοσ"],)]
    assert len({r[0] for r in spark.createDataFrame(forms, "t array<string>").select(X.fingerprint(F.col("t"))).collect()}) == 1
    import hashlib
    import unicodedata

    for (tokens,), got in zip(forms, spark.createDataFrame(forms, "t array<string>").select(X.fingerprint(F.col("t"))).collect()):
        assert got[0] == hashlib.sha256(b"".join(unicodedata.normalize("NFC", t).casefold().encode() + b"\0" for t in tokens)).hexdigest()
    f = spark.createDataFrame([({"Gender": "Fem,Masc", "Number": "Plur,Sing", "Odd": "x"},), ({},), (None,)], "f map<string,string>")
    assert [r[0] for r in f.select(X.feature_bundle(X.universal_subset(F.col("f")))).collect()] == ["Gender=Fem,Masc|Number=Plur,Sing", "_", "_"]
    assert f.select(X.common_gender(F.lit("ADJ"), F.col("f"))).first()[0]["Gender"] == "Com" and f.select(X.common_gender(F.lit("PRON"), F.col("f"))).first()[0]["Gender"] == "Fem,Masc"
    assert f.select(X.drop_value(F.col("f"), "Number", "Sing")).first()[0]["Number"] == "Plur"
    ids = F.create_map(*[F.lit(x) for kv in {"k": 5, "a": 6, "t": 7}.items() for x in kv])
    c = spark.createDataFrame([("kax",), ("kakakakaka",), ("",)], "t string").select(X.encode_characters(F.col("t"), ids, 8)).collect()
    assert [r[0] for r in c] == [[2, 5, 6, 1, 3], [2, 5, 6, 5, 4, 5, 6, 3], [2, 3]]
    e = f.select(*[schema.encode_feature(F.lit(v).cast("string"), ["Fem", "Masc"], True) for v in ("Fem,Masc", None, "Neut")]).first()
    assert list(e) == [[False, True, True], [True, False, False], None]
    assert spark.range(1).select(schema.encode_feature(F.lit("Plur,Sing"), ["Plur", "Sing"], False)).first()[0] is None


def pairs(spark, gold, system):
    return evaluation.aligned(spark.createDataFrame(gold, TOKEN), spark.createDataFrame(system, TOKEN))


def test_metrics(spark):
    gold = [(1, 0, "Lam", "lam", "NOUN", {"Number": "Sing"}), (1, 1, ".", "_", "PUNCT", {})]
    system = [(1, 0, "Lam", "lam", "NOUN", {}), (1, 1, ".", "x", "X", {"Local": "y"})]
    m = evaluation.ud_metrics(pairs(spark, gold, system)).first()
    assert (m["upos_f1"], m["ufeats_f1"], m["lemma_f1"]) == (0.5, 0.5, 1.0)
    with pytest.raises(Exception, match="not aligned"):
        pairs(spark, gold, system[:1]).collect()
    c = evaluation.classification(spark.createDataFrame([(2, 1, 3), (0, 0, 0)], "tp int, fp int, fn int")).collect()
    assert (c[0]["support"], round(c[0]["precision"], 6), c[0]["recall"], c[0]["f1"]) == (5, 0.666667, 0.4, 0.5) and c[1]["f1"] == 0
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (0.1, False)], "score double, target boolean")
    assert abs(evaluation.average_precision(s).first()[0] - 5 / 6) < 1e-9
    assert evaluation.average_precision(s.filter("not target")).first()[0] is None
    p = evaluation.frequency_profile(spark.createDataFrame([("Å",), ("å",), ("katt",), ("Katt",), ("KATT",), (None,)], "form string"))
    k = evaluation.with_frequency_class(spark.createDataFrame([("å",), ("katt",), ("rev",)], "form string"), p, 2)
    assert {r["form"]: r["freq_class"] for r in k.collect()} == {"å": "rare", "katt": "frequent", "rev": "oov"}


def test_bundles(spark):
    t = lambda xs: spark.createDataFrame([(i, 0, "f", "l", u, f) for i, (u, f) in enumerate(xs)], TOKEN)
    a, b, c = {"G": "M"}, {"G": "F"}, {"N": "S"}
    inv = bundles.bundle_inventory(t([("N", a), ("N", a), ("N", b), ("V", c), ("V", {})]))
    s = bundles.inventory_summary(inv).first()
    assert (s["bundles"], s["pairs"], s["max_per_upos"]) == (4, 4, 2)
    o = {r["slice"]: r for r in bundles.bundle_oracle(t([("N", a), ("N", b), ("V", {}), ("N", {"X": "y"})]), inv, (1, 2)).collect()}
    assert (o["all"]["seen"], o["all"]["seen_with_upos"], o["all"]["top_1"], o["all"]["top_2"], o["annotated"]["tokens"]) == (3, 3, 1, 3, 3)


def test_vectors(spark):
    z = F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(V.label_scores(z, True), V.label_scores(F.array(*[F.lit(0.0)] * 3), False), V.hard_decode(F.array(F.lit(2.0), F.lit(1.0)), True), V.hard_decode(F.array(F.lit(-0.1), F.lit(-2.0)), True), V.argmax(F.array(F.lit(3), F.lit(3)))).first()
    assert [round(x, 6) for x in r[0]] == [0.25, 0.5, 0.5] and [round(x, 6) for x in r[1]] == [0.333333] * 3
    assert r[2] == [False, True, True] and r[3] == [True, False, False] and r[4] == 0
    with pytest.raises(ValueError):
        V.logit_correction(z, z, 2.0)


def test_temperature_recovers_the_scale(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    z = rng.normal(size=(2000, 5))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    labels = [int(rng.choice(5, p=x)) for x in p]
    rows = spark.createDataFrame([((z[i] * 3).tolist(), labels[i]) for i in range(2000)], "z array<double>, label int")
    t, nll = probability.fit_temperature(rows)
    assert 2.4 < t < 3.7 and nll < probability.nll_grid(rows, [1.0]).first()["nll"]


def test_silver_filter(spark):
    rows = [("d", s, i, 1, 0.95, 1, 0.99, 1 if ok else 2, 1) for s, oks in ((0, [1, 1, 1, 1]), (1, [1, 0]), (2, [1, 1, 1, 0])) for i, ok in enumerate(oks)]
    t = spark.createDataFrame(rows, "document_id string, sentence_index int, tok_idx int, upos_id int, upos_confidence double, rule_id int, lemma_confidence double, agreed_upos_id int, agreed_rule_id int").selectExpr("*", "0.99D as morphology_confidence", "cast(null as boolean) as morphology_agrees")
    assert {r["sentence_index"]: r["keep"] for r in probability.silver_filter(t).collect()} == {0: True, 1: False, 2: True}
    assert probability.silver_report(probability.silver_filter(t.limit(0))).first()["sentences"] == 0


def test_corpus(spark):
    rows = [("a", i, [w] * 4) for i, w in enumerate("xyxzz")] + [("b", 0, ["x"] * 4), ("b", 1, None)]
    s = corpus.with_fingerprint(spark.createDataFrame(rows, "document_id string, sentence_index int, tokens array<string>"))
    once = corpus.first_seen(s, "document_id", "sentence_index")
    assert {(r["document_id"], r["sentence_index"]) for r in once.collect()} == {("a", 0), ("a", 1), ("a", 3), ("b", 1)}
    assert corpus.first_seen(once, "document_id", "sentence_index").count() == 4
    assert {r["sentence_index"] for r in corpus.within_budget(s.filter("document_id = 'a'"), 9, F.size("tokens"), "document_id", "sentence_index").collect()} == {0, 1, 2}
    assert [r["shard"] for r in corpus.shards(s, 3, "document_id", "sentence_index").orderBy("document_id", "sentence_index").collect()] == [0, 0, 0, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        corpus.validate(s, {"sentences": 8})
    corpus.validate(s, {"sentences": 7, "tokens": 24, "documents": 2})
    assert sampling.stride_sample(spark.range(100), 7, "id").count() == 7
    with pytest.raises(Exception, match="unknown upos"):
        schema.assert_known(spark.createDataFrame([("Q",)], "upos string"), spark.createDataFrame([("N",)], "upos string"), "upos").collect()


def test_annotate(spark):
    d = spark.createDataFrame([(1, "Han så 12 båter. Alt var stille."), (2, None), (3, "")], "doc_id int, text string")
    rows = annotate.annotate(d, Policy(frozenset(), 1, 64), annotate.SHAPE_LABELS, annotate.shape_scorer).orderBy("sentence_index", "tok_idx").collect()
    assert [r["form"] for r in rows] == ["Han", "så", "12", "båter", ".", "Alt", "var", "stille", "."]
    assert rows[0]["upos"] == "PROPN" and rows[2]["upos"] == "NUM" and rows[3]["lemma"] == "båt" and rows[3]["features"]["Number"] == ["Plur"]
    assert rows[0]["upos_distribution"][0]["probability"] == rows[0]["upos_confidence"] and math.isclose(sum(x["probability"] for x in rows[0]["upos_distribution"]), 1.0)


def test_word_spans(spark):
    d = spark.createDataFrame([([None, 0, 1, 1, 2, None], 3), ([0, 1, 0], 2), ([0, 2], 3), ([], 0)], "w array<int>, n int")
    got = [r[0] and [tuple(x) for x in r[0]] for r in d.select(subword.word_spans(F.col("w"), F.col("n"))).collect()]
    assert got == [[(1, 2), (2, 4), (4, 5)], None, None, None]
