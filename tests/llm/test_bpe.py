import random
from pathlib import Path

import pytest

from nordlys.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def automaton():
    return bpe.MergeAutomaton(bpe.load_vocabulary())


def test_equals_the_public_library(automaton):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {item: i for i, item in enumerate(automaton.items)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "aa", "the", "ing", "er", " ", "  ", "é", "ß", "中", "\n", "0", "12", "!!", "'s", "A", "ø", "🙂", "<|endoftext|>", "́", "　"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = automaton.encode(text)
        assert ids == library.encode_ordinary(text)
        assert automaton.decode(ids) == text
    long = "a" * 5000
    assert automaton.encode(long) == library.encode_ordinary(long)


def test_json_and_rank_file_hold_the_same_items(automaton):
    assert bpe.load_vocabulary(bpe.VOCABULARY.replace(".tiktoken", ".json")) == automaton.items


def test_null_empty_and_count(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "hei på deg"), (4, "  "), (3, "hei på deg")], "doc_id bigint, text string").selectExpr("*", "'x' as ids")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(d).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) > 0 and len(got[4]) > 0
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(d, "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_texts(d.limit(0)).count() == 0
