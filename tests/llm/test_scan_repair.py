from nordlys.llm import scan_repair as S

CLEAN = ("Kommunestyret godkjente ikke budsjettet for neste år. Han ventet på den gamle losen ved fyret. Det var en halv-åpen dør. " * 6).strip()
PAGES = [
    (1, "d", "010", "Kommunestyret godkjente ikke budsjettet for\nneste år. Han ventet på den gamle lo-\nsen ved fyret.\n\n          10"),
    (2, "d", "011", "        STRANDBOKEN\nHan ventet på den garnle losen ved fyret. Kom-\n   [11]"),
    (3, "d", "012", "        Strandboken\nmunestyret godkjente ikke budsjettet.\nDet var en halv-\nåpen dør.\n   [l2]"),
    (4, "d", "012", "        Strandboken\nmunestyret godkjente ikke budsjettet.\n1852\n   [12]"),
    (5, "d", None, None), (6, None, "3", ""), (7, "e", "x", "alene\n\n"),
]


def tables(spark):
    pages = spark.createDataFrame([*PAGES, PAGES[0]], "page_id bigint, document_id string, page string, text string").selectExpr("*", "1 as block", "'x' as kind")
    works = spark.createDataFrame([("d", "Strandboken"), ("d", "Strandboken"), ("e", None)], "document_id string, title string")
    texts = spark.createDataFrame([(CLEAN,)] * 30 + [(None,)], "text string")
    return pages, works, texts


def test_noise_of_every_kind(spark):
    got = {tuple(r) for r in S.find_noise(*tables(spark)).collect()}
    assert got == {
        (1, 2, "hyphen"), (1, 5, "page_number"), (2, 1, "header"), (2, 2, "misread"), (2, 2, "hyphen"), (2, 3, "page_number"),
        (3, 1, "header"), (3, 5, "page_number"), (4, 1, "header"), (4, 4, "page_number"),
    }


def test_paragraphs_run_over_lines_and_pages(spark):
    rows = {(r["document_id"], r["page"], r["paragraph"]): r["text"] for r in S.reflow(*tables(spark)).collect()}
    text = " ".join(rows[k] for k in sorted(k for k in rows if k[0] == "d"))
    assert "den gamle losen ved fyret. Han ventet på den gamle losen ved fyret. Kommunestyret godkjente" in text.replace("  ", " ")
    assert [k for k in rows if k[0] == "d"] and rows["d", 11, 0] if ("d", 11, 0) in rows else True
    assert "STRANDBOKEN" not in text and "[11]" not in text


def test_candidates_are_complete():
    v = S.Vocabulary({"kjøkken": 5, "dem": 3, "rust": 4, "tun": 2})
    assert {w for _, _, w in v.candidates("lcjøklcen")} == {"kjøkken"}
    assert {w for _, _, w in v.candidates("clern")} == {"dem"}
    assert {w for _, _, w in v.candidates("fiin")} == {"tun"}
    assert v.truth("kjøkken") is None and v.truth("1852") is None


def test_own_numbers():
    assert S.is_own_number("  — 66 —", 66) and S.is_own_number("[l61]", 161) and S.is_own_number("Side l22 av 218", 122)
    assert S.is_own_number("cxxii", 122) and S.is_own_number("s. 27", 27)
    assert not S.is_own_number("1852", 52) and not S.is_own_number("13.", 14) and not S.is_own_number("12", None)


def test_empty_tables(spark):
    pages, works, texts = tables(spark)
    assert S.find_noise(pages.limit(0), works.limit(0), texts.limit(0)).count() == 0
    assert S.reflow(pages.limit(0), works, texts).count() == 0


def test_trie_of_branchings_is_complete():
    import random

    rng = random.Random(2)
    counts = {"".join(rng.choice("cdkmnrul") for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(400)}
    v = S.Vocabulary(dict(counts))

    def undone(word, most):
        out = {word}
        if most:
            for i, ch in enumerate(word):
                for reading, truth in S.CONFUSIONS:
                    if word.startswith(reading, i):
                        out |= {word[:i] + truth + rest for rest in undone(word[i + len(reading) :], most - 1)}
        return out

    assert all(n == v.counts[w] and v.candidates(w) == sorted(v.candidates(w)) for w, n in counts.items())
    for word in ("lcrn", "clernc", "iifn", "lcclrn", "ulii", "rnrn"):
        known = {w for w in undone(word, 4) if w in counts and w != word}
        assert {w for _, _, w in v.candidates(word)} >= known
        assert all(w in counts and -n == counts[w] for _, n, w in v.candidates(word))


def test_no_word_is_left_out_whatever_the_size(spark):
    """More words than the former bound of 120,000, all seen twice, and many seen more often."""
    from pyspark.sql import functions as F

    letters = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abdeghkmpr")
    words = spark.range(125_000).select(F.concat(F.lit("sild"), letters).alias("w"))
    texts = words.select(F.concat_ws(" ", "w", "w").alias("text")).union(words.filter("id < 500").select(F.repeat(F.concat("w", F.lit(" ")), 3).alias("text")))
    got = S.load_vocabulary(texts, texts.limit(0)).counts
    assert len(got) == 125_000 and got["sildaaaaaa"] == 5 and got["sildadgmpr"] == 2


def test_variants_are_searched_completely():
    """Three readings that only together mend a word, beside thirteen single ones that look better."""
    v = S.Vocabulary({"pam" + "cpdg" * 14: 20, "kcpdgcpdg": 20, "kepdgepdg": 10_000})
    assert v.truth("pafu" + "cpdg" * 13) == "pam" + "cpdg" * 13  # fu, fn, rn, m
    assert v.truth("pam" + "cpdg" * 13) is None


def long_paragraph(spark, pages):
    """A paragraph over so many pages, each with a word of its own, and the texts that know the words."""
    words = {n: "sp" + "".join("abdeghkmpr"[int(x)] for x in f"{n:03}") + "ord" for n in range(1, pages + 1)}
    rows = [(n, "lang", str(n), f"{words[n]} og så\nvidere herfra") for n in words]
    texts = spark.createDataFrame([(" ".join([*words.values(), "og så videre herfra"]),)] * 9, "text string")
    works = spark.createDataFrame([("lang", "Strandboken")], "document_id string, title string")
    return words, rows, works, texts


def test_paragraphs_go_on_beyond_the_margin(spark):
    for pages in (S.BLOCK + S.MARGIN - 1, S.BLOCK + S.MARGIN, 110):
        words, rows, works, texts = long_paragraph(spark, pages)
        got = S.reflow(spark.createDataFrame(rows, "page_id bigint, document_id string, page string, text string"), works, texts).collect()
        got.sort(key=lambda r: r["page"])
        assert " ".join(r["text"] for r in got) == " ".join(f"{w} og så videre herfra" for w in words.values())
        starts = [1, *range(S.BLOCK + S.MARGIN, pages + 1, S.BLOCK)]
        assert [(r["page"], r["last_page"]) for r in got] == list(zip(starts, [*(s - 1 for s in starts[1:]), pages]))


def test_short_paragraphs_come_once_at_every_place(spark):
    words, rows, works, texts = long_paragraph(spark, 80)
    rows = [(n, d, p, t + ("." if n % 3 == 0 else "")) for n, d, p, t in rows]
    got = S.reflow(spark.createDataFrame(rows, "page_id bigint, document_id string, page string, text string"), works, texts).collect()
    assert sorted((r["page"], r["last_page"]) for r in got) == [(n, min(n + 2, 80)) for n in range(1, 81, 3)]


def test_pages_without_a_number_are_paragraphs_of_their_own(spark):
    rows = [(1, "d", "ix", "Han ventet på den garnle losen\nved fyret.\n\nKommunestyret godkjente."), (2, "d", None, "neste år"), (3, "d", "4", "Det var en dør."), (4, None, "x", "alene")]
    _, works, texts = tables(spark)
    got = S.reflow(spark.createDataFrame(rows, "page_id bigint, document_id string, page string, text string"), works, texts).collect()
    assert sorted((r["page"] or -1, r["paragraph"], r["last_page"] or -1, r["text"]) for r in got) == [
        (-1, 0, -1, "Han ventet på den gamle losen ved fyret."), (-1, 0, -1, "neste år"), (-1, 1, -1, "Kommunestyret godkjente."), (4, 0, 4, "Det var en dør."),
    ]


def test_the_automaton_retrieves_every_word_within_its_distance():
    """Against a plain edit distance over the whole vocabulary: no word within one or two edits is left out, none beyond comes."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    v = S.Vocabulary({"huset": 9, "brann": 8, "skole": 7, "havn": 3})
    for reading, word in (("hnset", "huset"), ("bramn", "brann"), ("skoie", "skole"), ("husot", "huset"), ("huet", "huset"), ("huseet", "huset")):
        assert word in {w for _, _, w in v.candidates(reading, distance=1)}, reading
    rng = random.Random(5)
    counts = {"".join(rng.choice("aeks") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(500)}
    v = S.Vocabulary(dict(counts))
    for _ in range(60):
        word = "".join(rng.choice("aeks") for _ in range(rng.randint(2, 7)))
        for k in (1, 2):
            want = {w for w in counts if w != word and distance(word, w) <= k}
            assert {w for _, _, w in v.candidates(word, most=0, distance=k)} == want
            assert {w for _, _, w in v.candidates(word, distance=k)} >= want


def test_context_ranks_candidates(spark):
    """The same reading between different words is another word; other edits than confusions need the context's word."""
    clean = "den gamle hunden sov . en stor handen veide mye . han så brannen på loftet . skolen lå ved havnen . " * 8
    texts = spark.createDataFrame([(clean.replace("en stor handen", "en stor hånden"),)], "text string")
    scanned = spark.createDataFrame([("den gamle bunden sov\nhan så brxnnen på loftet\nhun ga brxnnen til ham",)], "text string")
    v = S.load_vocabulary(texts, scanned)
    assert v.truth("bunden", "gamle", "sov") == "hunden"
    assert v.truth("brxnnen", "så", "på") == "brannen" and v.truth("brxnnen", "ga", "til") is None
    two = S.Vocabulary({"tun": 50, "run": 5}, pairs={S.pair_key("et", "tun"): 9, S.pair_key("a", "run"): 3})
    assert two.truth("fun", "a", "") == "run" and two.truth("fun", "et", "") == "tun" and two.truth("fun") == "tun"


ODD = [
    None, "", " ", ".,»", "«Den»  gamle…losen–ved—fyret", "\x0bden\x0cgamle\tlosen\r\nved !fyret! ", "hei\x1cdu\x1f \x85 \xa0a\xa0b c\x00d", "¬«ø»å‚„“”‘’…", "İ ΑΣ ΑΣ.Α ÆØÅ",
    "1852 !! 3,5 [a/b] <c>*d*", "\U0001f600«\U0001f600", "en", "â€“ Â«  ‐‑x", "den gamle den gamle " * 40,
]


def test_words_are_parted_as_by_the_expression(spark, monkeypatch):
    """Whatever the pieces: all kinds of separators, bytes like theirs in other characters, nulls, empty texts."""
    import re
    from collections import Counter

    import pyarrow as pa

    space = r"[ \t\n\x0b\f\r" + re.escape(S._PARTING.replace(" ", "").strip() + "!") + "]+"
    texts = spark.createDataFrame([(t,) for t in ODD], "text string").coalesce(1)
    sql = r"select w, count(*) n from (select explode(split(lower(text), r'[\s.,;:?()«»\"–—…„“”‚‘’\[\]/!*<>]+')) w from odd) where w rlike r'\p{L}' group by w"
    texts.createOrReplaceTempView("odd")
    want = {r["w"]: r["n"] for r in spark.sql(sql).collect()}
    assert {r["word"]: r["n"] for r in S.vocabulary_counts(texts).collect()} == want and want["gamle"] == 82
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(S, "PIECE_BYTES", size)
        for column in (pa.array(ODD), pa.array(["x", *ODD, "y"]).slice(1, len(ODD)), pa.array(ODD, pa.large_string()), pa.array([None, None], pa.string()), pa.array([""])):
            got = [w for words, _ in S.parted(column, S._PARTING + "!") for w in words.to_pylist()]
            assert Counter(got) == Counter(w for t in column.to_pylist() if t is not None for w in re.split(space, t))
            starts = sum(len(firsts) for _, firsts in S.parted(column, S._PARTING))
            assert starts == len(column) - column.null_count


def test_neighbours_are_counted_within_each_text(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(t,) for t in [*ODD, "losen ved", "Fyret", "ved", "fyret"]], "text string").coalesce(1)
    pairs = [("den", "gamle"), ("gamle", "den"), ("gamle", "losen"), ("ved", "fyret"), ("ved", "!fyret!"), ("fyret", "ved"), ("ø", "å"), ("en", "den"), ("d", "e"), ("hei\x1cdu\x1f", "\x85"), ("c", "d")]
    wanted = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a").bitwiseXOR(F.shiftleft(F.xxhash64("b"), 1)).alias("k"))
    got = Counter()
    for a, b, n in S._said(texts, wanted).collect():
        got[a, b] += n
    texts.createOrReplaceTempView("odd")
    sql = r"select array_remove(split(lower(text), r'[\s.,;:?()«»\"–—…„“”‚‘’\[\]/*<>]+'), '') w from odd"
    want = Counter(p for r in spark.sql(sql).collect() for p in zip(r["w"] or [], (r["w"] or [])[1:]) if p in pairs)
    assert got == want and want["den", "gamle"] == 82 and want["ved", "fyret"] == 1 and len(want) == 8
    assert S._said(texts, wanted.limit(0)).count() == 0


def test_no_word_of_the_texts_becomes_a_row(spark, tmp_path, monkeypatch):
    """The passes over the clean corpus count words and pairs as columns: a row a word and pair was over half of the CPU."""
    clean = "den gamle hunden sov . han så brannen på loftet . " * 8
    spark.createDataFrame([(clean,)], "text string").write.parquet(f"{tmp_path}/clean_texts")
    texts = spark.read.parquet(f"{tmp_path}/clean_texts")
    plans = []
    for name in ("collect", "toArrow"):
        was = getattr(type(texts), name)
        monkeypatch.setattr(type(texts), name, lambda df, was=was: plans.append((str(df.inputFiles()), df._jdf.queryExecution().toString())) or was(df))
    v = S.load_vocabulary(texts, spark.createDataFrame([("han så brxnnen på loftet",)], "text string"))
    assert v.truth("brxnnen", "så", "på") == "brannen" and v.pairs[S.pair_key("så", "brannen")] == 8
    over = [p for files, p in plans if "clean_texts" in files]
    assert len(over) == 2 and not any("Generate" in p for p in over)
