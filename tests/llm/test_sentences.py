import numpy as np

from nordlys.llm import sentences as S

BODY = "Han kom kl. 14. Møtet ble satt av dr. Lund i 1901. «Vi venter her.» Kari snudde seg. «Nei!» ropte hun bestemt. Hva mente hun? Alle var der: losen, presten m.fl. Prisen steg."
ABBREVIATIONS = frozenset({"kl.", "dr.", "m.fl."})


def trained(texts):
    edge, seen = np.zeros(S.BUCKETS), np.zeros(S.BUCKETS)
    S.count_edges(texts, edge, seen)
    counts = S.Counts(edge, seen)
    pairs = [e for t in texts for e in S.examples(t, counts, ABBREVIATIONS)]
    weights = S.fit(np.asarray([x for x, _ in pairs]), np.asarray([float(y) for _, y in pairs]))
    return S.Segmenter(counts, weights, ABBREVIATIONS)


def corpus():
    lines = ["Han kom kl. 14.", "Møtet ble satt av dr. Lund i 1901.", "Alle var der: losen, presten m.fl.", "Hva mente hun?", "Prisen steg ca. 3 kroner."]
    return ["\n\n".join(" ".join(lines[(i + j + k) % 5] for j in range(3)) for k in range(4)) for i in range(60)]


def test_units_of_a_paragraph():
    got, at = [], 0
    for end in trained(corpus()).ends(BODY):
        got.append(BODY[at:end].strip())
        at = end
    assert got == ["Han kom kl. 14.", "Møtet ble satt av dr. Lund i 1901.", "«Vi venter her.»", "Kari snudde seg.", "«Nei!» ropte hun bestemt.", "Hva mente hun?", "Alle var der: losen, presten m.fl.", "Prisen steg."]


def test_blank_lines_and_blank_texts():
    s = trained(corpus())
    assert s.ends(None) == s.ends("") == s.ends(" \n\n ") == []
    text = "Kapittel 5\n\nHan gikk\nhjem nå.\r\n\r\nSlutt  "
    assert [text[:e].split("\n")[-1].strip() for e in s.ends(text)][0] == "Kapittel 5"
    assert len(s.ends(text)) == 3 and s.ends(text)[-1] == len(text.rstrip())
    assert s.ends("谁也不知道。水位是13.41米！") == [6, 16]


def test_operator_end_to_end(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus())] + [(900, None), (901, "  "), (902, "a" * 50_000), (0, corpus()[0])], "doc_id bigint, text string").selectExpr("*", "1 as unit")
    policies = spark.createDataFrame([(["kl.", " Dr", None, ""],), (None,)], "abbreviation_tokens array<string>")
    contracts = spark.createDataFrame([(["m.fl."],)], "abbreviations array<string>")
    units = S.sentence_units(docs, policies, contracts)
    rows = units.collect()
    assert {r["doc_id"] for r in rows} == {*range(60), 902}
    assert all(r["end_char"] - r["start_char"] == len(r["text"]) for r in rows)
    assert S.sentence_units(docs.limit(0), policies, contracts).count() == 0


def test_every_key_is_counted_by_itself(spark):
    """Two tokens that shared one of the 2^18 buckets: one that ends paragraphs, one that never does."""
    from itertools import product

    from xxhash import xxh64_intdigest

    shared = xxh64_intdigest("L\0dr.") % (1 << 18)
    other = next(w for w in ("q" + "".join(x) + "." for x in product("abcdefghijklmnopqrstuvwxyz", repeat=4)) if xxh64_intdigest(f"L\0{w}") % (1 << 18) == shared)
    docs = spark.createDataFrame([(f"Han så dr. Lund i går kveld der nede. Alle var med til {other}",)] * 40, "text string")
    counts = S.corpus_counts(docs)
    assert counts.of(S.count_key("L", "dr.")) == (0, 40) and counts.of(S.count_key("L", other)) == (40, 40)
    assert counts.of(S.count_key("L", "ukjent.")) == (0, 0)
    assert len(counts.keys) == len({*counts.keys}) and list(counts.keys) == sorted(counts.keys)


def test_decisions_do_not_change_with_the_size_of_the_corpus():
    """A stray paragraph that ends with an abbreviation takes away nothing, in a large corpus as in a small one."""
    text = "Prisen steg ca. 3 kroner."
    a, b = next(S.paragraphs(text))
    c = S.candidates(text, a, b)[0]
    k = S.keys(text, a, b, c.end, c.begin, c.close)
    order = np.argsort(k[:3])

    def never(edge, seen):
        counts = S.Counts(np.full(3, edge), np.full(3, seen), np.array(k[:3])[order])
        x = S.features(c, k, text, counts, frozenset(), False, False)
        return x[S.NAMES.index("never")], S.label(c, k, x, counts)

    assert never(0, 100)[0] > 0 and never(0, 100)[1] == 0
    assert never(10, 10_000)[0] > 0 and never(10, 10_000)[1] == 0
    assert never(1_000, 10_000)[0] == 0 and never(1_000, 10_000)[1] is None
