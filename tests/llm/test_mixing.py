import numpy as np
import pytest
from pathlib import Path

from nordlys.llm import bpe, mixing

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary files here")


def test_permutations_and_draws():
    for blocks in (1, 2, 3, 5, 64, 1000):
        out = mixing.permuted(np.arange(3 * blocks), blocks, 7)
        for k in range(3):
            assert sorted(out[k * blocks : (k + 1) * blocks]) == list(range(blocks))
    plan = mixing.draw({"a": (10, 1000), "b": (5, 33), "c": (1, 0)}, 16)
    used = {}
    for _, s, first, n, _ in plan:
        assert first == used.get(s, 0)
        used[s] = first + n
    assert used == {"a": 1000, "b": 33}


def test_shares_and_caps(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(0, 120)))), ("stor" if i % 10 else " LITEN ") if i % 97 else None) for i in range(800)]
    rows += [(2000, None, "stor"), (2001, "", "stor"), (2002, "x", "uten mål"), (2003, "lang " * 20_000, "stor")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as block", "2 as uses")
    goal = spark.createDataFrame([("stor", 0.6, 2), ("liten", 0.4, 4), ("tom", 0.1, 3), (None, 0.5, 1)], "source string, target_weight double, max_repeats int")
    spans, wanted = mixing.mix(docs, goal, size=16)
    report = {r["source"]: r for r in mixing.shares(spans, wanted).collect()}
    assert report["tom"]["tokens"] == 0
    assert abs(report["stor"]["share"] - 0.6) < 0.01 and abs(report["liten"]["share"] - 0.4) < 0.01
    assert all(r["most_uses"] <= r["max_repeats"] for r in report.values())
    chosen = mixing.selection(spans).collect()
    assert sum(r["used_tokens"] for r in chosen) == sum(r["tokens"] for r in report.values())
    assert all(r["used_tokens"] <= r["n_tokens"] * report[r["source"]]["max_repeats"] for r in chosen)
    assert mixing.mix(docs.limit(0), goal)[0].count() == 0


def test_slots_are_not_broadcast(spark):
    """They grow with the corpus, though the rows they are made from don't."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('ord og tall ', 50) AS text", "'stor' AS source")
    spans, _ = mixing.mix(docs, spark.createDataFrame([("stor", 1.0, 2)], "source string, target_weight double, max_repeats int"), size=1)
    rows = spans.collect()
    assert len(rows) == 2 * spans.select("source", "block").distinct().count() > 100_000
    assert "Broadcast" not in spans._jdf.queryExecution().executedPlan().toString()
