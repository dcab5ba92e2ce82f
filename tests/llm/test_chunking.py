from hypothesis import given, settings
from hypothesis import strategies as st

from nordlys.llm.chunking import cut, split_oversized

words = st.lists(st.sampled_from(["a", "b", ".", ",", ";", "»", None, "ord", "hus", "og"]), max_size=300)


@given(words, st.integers(1, 40), st.integers(0, 50))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_everything_within_the_limit(tokens, maximum, overlap):
    pieces = cut(tokens, maximum, overlap)
    assert all(0 < b - a <= maximum for a, b in pieces)
    if len(tokens) <= maximum:
        assert pieces == ([(0, len(tokens))] if tokens else [])
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(tokens)
    shared = min(overlap, maximum - 1)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert d > b and (b - c == shared or c == 0)


def test_cuts_fall_on_sentence_ends():
    sentence = ["en", "to", "tre", "fire", "fem", "seks", "."]
    pieces = cut(sentence * 10, 30, 0)
    assert all(b % 7 == 0 for _, b in pieces)


def test_an_edit_changes_only_neighbouring_pieces():
    import random

    rng = random.Random(5)
    tokens = [f"w{rng.randrange(400)}" if rng.random() > 0.1 else "." for _ in range(3000)]
    edited = tokens[:100] + ["ny"] + tokens[100:]
    plain = {tuple(tokens[a:b]) for a, b in cut(tokens, 60, 0)}
    after = {tuple(edited[a:b]) for a, b in cut(edited, 60, 0)}
    assert len(plain & after) >= 0.8 * len(plain)


def test_split_oversized_defaults_nulls_and_repeats(spark):
    rows = [
        (1, "d", 0, "p", ["x"] * 5), (1, "d", 0, "p", ["x"] * 5), (2, "d", 1, None, ["x"] * 129), (3, "d", 2, "missing", ["x"] * 128),
        (4, "d", 3, "p", None), (5, "d", 4, "p", []), (6, "d", 5, "null", ["x"] * 200), (7, None, None, "p", [None] * 9),
    ]
    s = spark.createDataFrame([(*r, None) for r in rows], "sentence_id bigint, document_id string, sentence_index int, policy_id string, tokens array<string>, loaded_at timestamp")
    p = spark.createDataFrame([("p", 4, 1), ("p", 4, 1), ("null", None, None)], "policy_id string, maximum_token_count int, overlap_token_count int")
    s = s.withColumnsRenamed({}).selectExpr("*", "1 as piece", "2 as `end`")
    got = {}
    for r in split_oversized(s, p).collect():
        got.setdefault(r["sentence_id"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 4), (3, 5)] if (0, 4) in got[1] else sorted(got[1]), 2: sorted(got[2]), 6: sorted(got[6]), 7: sorted(got[7])}
    assert set(got) == {1, 2, 6, 7} and len(got[1]) == 2 and len(got[2]) == 2
    assert split_oversized(s.limit(0), p).count() == 0 and split_oversized(s, p.limit(0)).select("sentence_id").distinct().count() == 2
