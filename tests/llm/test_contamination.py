import random

from nordlys.llm import contamination as C

ITEM = "Ved Holknes lå det en bregårdkrok som Eivild Ausnes byttet mot 19 rognhusovner etter at Vinddal hadde klaget .".split()
OTHER = "Ved Krokvik lå det en salttønn som Nora Dulberg byttet mot 7 barkmurer etter at Fosmo hadde klaget .".split()
COMMON = "Ved Lamvær lå det en kiste som Odd Selvik byttet mot 3 hatter etter at Gulmyr hadde klaget .".split()


def index():
    rows = [(1, "nb", ITEM), (2, "nb", ITEM), (3, "nb", OTHER), (5, "nb", "for kort".split())]
    return C.Index.build(rows + [(10 + i, "nb", [w if w.islower() or w == "." else f"{w}{i}" for w in COMMON]) for i in range(4)])


def found(words):
    ix = index()
    return {i for s, p in ix.scan(C.words_of(words)).items() if C.is_held(p) for i in ix.ids[s]}


FILL = "han kom hjem sent og så ut over havet mens regnet falt".split()


def test_whole_part_and_damaged_passages():
    assert found(FILL + ITEM + FILL) == {1, 2}
    assert found(FILL + ITEM[4:13] + FILL) == {1, 2}
    assert found([w.upper() for w in ITEM]) == {1, 2}
    damaged = list(ITEM)
    damaged[5], damaged[10], damaged[13] = "bregårclkrok", "mott", "rognhusovuer"
    assert found(FILL + damaged + FILL) == {1, 2}
    broken = [*ITEM[:5], "bregård", "krok", *ITEM[6:]]
    assert found(FILL + broken + FILL) == {1, 2}


def test_phrasing_and_snatches_are_no_cases():
    assert found(FILL + COMMON + FILL) == set()
    assert found(FILL + ITEM[5:11] + FILL) == set()
    assert found([]) == set()


DECOY = "Ved Holknes lå det en kiste som Odd Selvik byttet mot 19 hatter etter at Gulmyr hadde klaget .".split()


def test_decoy_hides_no_passage():
    assert found(FILL + DECOY + FILL) == set()
    assert found(FILL + DECOY + FILL + ITEM[4:13] + FILL) == {1, 2}
    assert found(FILL + ITEM[4:13] + FILL + DECOY) == {1, 2}
    assert found(FILL + ITEM[4:13] + DECOY[13:] + FILL) == {1, 2}
    joined = FILL + ITEM[:9] + "solgte mens 7 hatter".split() + ITEM[13:] + FILL  # one alignment over both, which fails as a whole
    assert found(joined) == {1, 2}


def test_every_passage_of_an_item():
    words = C.words_of(FILL + ITEM[4:13] + FILL + ITEM + FILL + ITEM[:9] + FILL)
    spans = sorted((p.at, p.until) for s, p in index().passages(words) if C.is_held(p))
    assert [" ".join(words[a:b]) for a, b in spans] == [" ".join(C.words_of(x)) for x in (ITEM[4:13], ITEM, ITEM[:9])]
    same_diagonal = C.words_of(FILL + ITEM[:9] + ITEM[:9] + ITEM[9:] + FILL)
    assert len([p for s, p in index().passages(same_diagonal) if C.is_held(p)]) == 2


def test_every_passage_is_cleaned(spark):
    rows = [("d", i, FILL) for i in range(20)]
    rows[3], rows[9], rows[15] = ("d", 3, ITEM[4:13]), ("d", 9, DECOY), ("d", 15, ITEM)
    s = spark.createDataFrame(rows, "document_id string, sentence_index int, tokens array<string>")
    items = spark.createDataFrame([(1, "nb", "test", ITEM)] + [(10 + i, "nb", "test", [w if w.islower() or w == "." else f"{w}{i}" for w in COMMON]) for i in range(4)], "item_id bigint, language_tag string, evaluation_split string, tokens array<string>")
    runs = spark.createDataFrame([("nb", "test")], "language_tag string, evaluation_split string")
    left = {r["sentence_index"] for r in C.clean_sentences(s, C.find_leaks(s, items, runs)).collect()}
    assert left == set(range(20)) - {3, 15}


def test_find_leaks_across_sentences_and_blocks(spark):
    rng = random.Random(4)
    rows = []
    for doc in ("hot", "plain"):
        for i in range(C.BLOCK + 50):
            rows.append((doc, i, [rng.choice(FILL) for _ in range(5)]))
    rows[C.BLOCK - 1] = ("hot", C.BLOCK - 1, ITEM[:9])
    rows[C.BLOCK] = ("hot", C.BLOCK, ITEM[9:])
    rows += rows[:20] + [(None, 1, ITEM), ("nulls", None, ITEM), ("nulls", 1, None), ("nulls", 2, [None, ""]), ("nulls", 3, [])]
    s = spark.createDataFrame(rows, "document_id string, sentence_index int, tokens array<string>").selectExpr("*", "1 as block", "2 as item_id")
    items = spark.createDataFrame([(1, "nb", "test", ITEM), (2, "nb", "train", ITEM), (3, "nb", None, ITEM), (4, None, "test", ITEM)], "item_id bigint, language_tag string, evaluation_split string, tokens array<string>")
    runs = spark.createDataFrame([("nb", "test"), ("nb", "test"), ("nb", None)], "language_tag string, evaluation_split string")
    leaks = C.find_leaks(s, items, runs)
    assert [tuple(r) for r in C.leaked_pairs(leaks).collect()] == [("hot", 1)]
    clean = C.clean_sentences(s, leaks)
    assert clean.filter(f"document_id = 'hot' and sentence_index in ({C.BLOCK - 1}, {C.BLOCK})").count() == 0
    assert C.find_leaks(s.limit(0), items, runs).count() == 0 and C.find_leaks(s, items.limit(0), runs).count() == 0


def test_rounds_change_nothing(spark):
    """The same passages from one round and from many, over items whose shared phrasing is common only taken together."""
    rng = random.Random(9)
    names = [f"{a}{b}" for a in ("Hol", "Vin", "Krok", "Fos", "Lam", "Gul") for b in ("nes", "dal", "vik", "mo", "vær", "myr")]
    item = lambda i: f"Ved {names[i % 36]}{i} lå det en kiste som {names[(i * 7) % 36]} byttet mot {i} hatter etter at {names[(i * 5) % 36]}{i} hadde klaget .".split()
    items = spark.createDataFrame([(i, "nb", "test", item(i)) for i in range(300)], "item_id bigint, language_tag string, evaluation_split string, tokens array<string>")
    rows = []
    for i in range(0, 300, 3):
        rows += [("d", len(rows), FILL), ("d", len(rows) + 1, item(i)[rng.randint(0, 4) :])]
    s = spark.createDataFrame(rows, "document_id string, sentence_index int, tokens array<string>")
    runs = spark.createDataFrame([("nb", "test")], "language_tag string, evaluation_split string")
    one = sorted(tuple(r) for r in C.find_leaks(s, items, runs).collect())
    many = sorted(tuple(r) for r in C.find_leaks(s, items, runs, per_round=60).collect())
    assert one == many and len({r[1] for r in one}) > 80


def test_any_two_damaged_words_leave_a_passage_found():
    """Eight words of an item with any two of them replaced or broken are still aligned, as long as an own word is whole."""
    ix = index()
    part = C.words_of(ITEM)[4:12]
    own = {i for i, w in enumerate(part) if ix.particular[0][C.words_of(ITEM).index(w)]}
    for a in range(8):
        for b in range(a + 1, 8):
            if own - {a, b}:
                for damage in (lambda w: ["xqz"], lambda w: [w[:2], w[2:]] if len(w) > 3 else ["xqz"]):
                    words = [x for i, w in enumerate(part) for x in (damage(w) if i in (a, b) else [w])]
                    assert any(s == 0 for s, _ in ix.passages(C.words_of(FILL) + words + C.words_of(FILL))), (a, b)
