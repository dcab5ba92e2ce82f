import math
import random

import pytest

from nordlys.llm import cutoffs as C

LABELS = "document_id string, sentence_index int, upos_probabilities array<array<float>>, lemma_rule_probabilities array<array<float>>, labeled_at timestamp"


def test_sketch_brackets_the_true_rank():
    rng = random.Random(1)
    values = [round(rng.random(), 3) for _ in range(60_000)]
    parts = [values[i::7] for i in range(7)]
    total = C.Sketch(64)
    for p in parts:
        s = C.Sketch(64)
        s.add(p)
        total.merge(C.Sketch.load(s.dump()))
    ordered = sorted(values, reverse=True)
    assert total.n == len(values) and total.error < 0.3 * len(values)
    for k in (1, 10, 1000, 30_000, 59_999, 60_000):
        low, high = total.bracket(k)
        assert low <= ordered[k - 1] <= high


def brute(rows, works, targets):
    last = {}
    for doc, i, u, l, t in rows:
        def peak(a):
            if not a or any(not x or any(v is None or math.isnan(v) for v in x) for x in a):
                return None
            return min(max(x) for x in a)
        a, b = peak(u), peak(l)
        s = None if a is None or b is None else min(a, b)
        key = (t is not None, t or 0, s is not None, s or 0)
        if (doc, i) not in last or key > last[doc, i][0]:
            last[doc, i] = (key, s)
    by = {}
    for (doc, i), (_, s) in last.items():
        source = works.get(doc)
        if s is not None and source in targets:
            by.setdefault(source, []).append((s, doc, i))
    kept = set()
    for source, xs in by.items():
        k = -(-len(xs) * targets[source] // 1000)
        if k:
            cut = sorted(xs, reverse=True)[k - 1][0]
            kept |= {(d, i) for s, d, i in xs if s >= cut}
    return kept


@pytest.mark.parametrize("size", [16, C.SKETCH])
def test_kept_rows_equal_brute_force(spark, size, monkeypatch):
    import datetime as dt

    monkeypatch.setattr(C.cutoffs, "__defaults__", (size,))
    rng = random.Random(2)
    day = dt.datetime(2024, 1, 1)
    vec = lambda: [[rng.choice([0.1, 0.5, 0.9, 0.25]) for _ in range(3)] for _ in range(2)]
    rows = [(f"d{rng.choice([0, 0, 0, 1, 2, 3, 4])}", rng.randrange(300), vec(), vec(), day + dt.timedelta(days=rng.randrange(3))) for _ in range(1500)]
    rows += [("d1", 900, None, vec(), day), ("d1", 901, [], vec(), day), ("d1", 902, [[]], vec(), day), ("d1", 903, [[float("nan")]], vec(), day), ("d1", 904, [None], vec(), day), ("d1", 905, vec(), vec(), None), ("nowhere", 1, vec(), vec(), day)]
    rows = [(d, i, u, l, t) for d, i, u, l, t in rows]
    import numpy as np

    f32 = lambda a: None if a is None else [None if x is None else [float(np.float32(v)) for v in x] for x in a]
    works = {"d0": "hot", "d1": "a", "d2": "a", "d3": "zero", "d4": None}
    targets = {"hot": 333, "a": 501, "zero": 0, "unused": 10}
    labels = spark.createDataFrame(rows + rows[:50], LABELS).selectExpr("*", "'x' as source", "1 as score")
    w = spark.createDataFrame([*works.items(), ("d0", "hot")], "document_id string, corpus_id string")
    t = spark.createDataFrame([(k, v) for k, v in targets.items()], "source string, keep_permille int")
    kept, report = C.keep_share(labels, w, t)
    want = brute([(d, i, f32(u), f32(l), x) for d, i, u, l, x in rows], works, {k: v for k, v in targets.items() if v})
    assert {(r["document_id"], r["sentence_index"]) for r in kept.collect()} == want
    assert sum(r["kept"] for r in report.collect()) == len(want)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    w = spark.createDataFrame([], "document_id string, corpus_id string")
    t = spark.createDataFrame([], "source string, keep_permille int")
    kept, report = C.keep_share(labels, w, t)
    assert kept.count() == 0 and report.count() == 0
