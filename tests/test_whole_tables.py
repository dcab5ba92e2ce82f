"""Queries over all silver sentences."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nordlys.plans import catalogue, inputs
from nordlys.session import data_dir

SF = data_dir("sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


def test_every_sentence_has_its_spans(spark):
    sizes = dict(inputs.sentences(spark, SF).filter("size(tokens) > 0").select("sentence_id", F.size("tokens")).collect())
    got = {r["sentence_id"]: r for r in catalogue.QUERIES["subword_spans"](spark, SF).collect()}
    assert got.keys() == sizes.keys()
    assert all(r["spans"] is None or len(r["spans"]) == sizes[k] and r["spans"][-1]["end"] == r["n_ids"] for k, r in got.items())
    assert sum(r["spans"] is not None for r in got.values()) > 0.9 * len(got)


def test_every_token_comes_back_from_conllu(spark):
    tokens = {(k, i, t) for k, ts in inputs.sentences(spark, SF).select("sentence_id", "tokens").collect() for i, t in enumerate(ts or [])}
    rows = catalogue.QUERIES["conllu_sentences"](spark, SF).collect()
    assert {(r["sentence_id"], r["tok_idx"], r["form"]) for r in rows} == tokens and len(rows) == len(tokens)
