"""What must hold whatever the number of files, rounds or copies of the corpus."""

from pyspark.sql import functions as F

from nordlys.llm import bpe, cutoffs, sentences

TEXT = "Han kom fra kap. 3 i boken, sa hun. Det var en kald dag i mars. Saken gjelder f.eks. nr. 4 og kl. 12. Ingen visste det! Hvorfor ikke? Vi vet ikke.\n\nDen gamle losen ventet ved fyret. Han så ingen båter."


def test_texts_in_many_files_are_not_shuffled(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("doc_id"), F.lit(TEXT).alias("text")).repartition(64).write.parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = spark.read.parquet(str(tmp_path / "d"))
        if docs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
            assert "Exchange" not in bpe.encode_texts(docs)._jdf.queryExecution().executedPlan().toString()
        assert bpe.encode_texts(docs).select("ids").distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_statistics_of_tenfold_copies_decide_alike():
    """The judgement 'never ends a sentence' of a token does not depend on how large the corpus is."""
    assert all(sentences.rare(e, n) == sentences.rare(10 * e, 10 * n) for e, n in ((0, 5), (1, 150), (1, 250), (2, 399), (40, 90)))


def test_cutoffs_of_tenfold_copies(spark):
    scored = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), (F.xxhash64("id") % 1000 / 1000).cast("float").alias("score"))
    targets = spark.createDataFrame([(f"s{i}", 137) for i in range(3)], "source string, keep_permille int")
    once = {r["source"]: r["cutoff"] for r in cutoffs.cutoffs(scored, targets, 64).collect()}
    tenfold = scored.crossJoin(spark.range(10).drop("id").withColumn("x", F.lit(1))).drop("x").repartition(13)  # copies of a small table
    assert {r["source"]: r["cutoff"] for r in cutoffs.cutoffs(tenfold, targets, 64).collect()} == once
