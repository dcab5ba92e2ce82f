"""Writers: silver corpora with manifests, label shards, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nordlys.operators.corpus import manifest, shards
from nordlys.sources.readers import shard_hashes


def write_corpus(sentences: DataFrame, path: str, about: dict, format: str = "parquet") -> dict:
    """Writes the corpus and its manifest with the sizes counted; an empty one is an error before anything is written.

    Rows and manifest are written aside and moved into place when both are whole, the manifest last.
    """
    spark = sentences.sparkSession
    if sentences.isEmpty():
        raise ValueError("the corpus is empty")
    aside = f"{path}/_writing"
    sentences.write.mode("overwrite").format(format).save(f"{aside}/data")
    counts = manifest(spark.read.schema(sentences.schema).format(format).load(f"{aside}/data")).first().asDict()
    full = {"format_version": 1, **about, **counts}
    write_manifest(spark, full, f"{aside}/manifest")
    for part in ("data", "manifest"):
        move(spark, f"{aside}/{part}", f"{path}/{part}")
    return full


def write_manifest(spark: SparkSession, content: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(content, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder on whatever file system it lies; an existing target is an error."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(source).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if files.exists(make(target)):
        raise FileExistsError(target)
    if not files.rename(make(source), make(target)):
        raise OSError(f"{source} could not be moved to {target}")


def write_label_shards(labels: DataFrame, path: str, size: int = 20_000, about: dict | None = None) -> dict:
    """Labels in folders of ``size`` records in key order, and a manifest (returned, and written beside them) with
    each shard's records and hash and what the labels were made from (``about``: corpus, teachers, calibration)."""
    spark = labels.sparkSession
    numbered = shards(labels, size, "document_id", "sentence_index")
    numbered.repartition("shard").sortWithinPartitions("shard", "document_id", "sentence_index").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/data")
    counts = {r["shard"]: r["n"] for r in spark.read.parquet(f"{path}/data").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    hashes = shard_hashes(spark, f"{path}/data")
    content = {
        "format_version": 1, **(about or {}), "record_count": sum(counts.values()), "shard_count": len(counts),
        "shards": [{"shard": k, "record_count": counts[k], "sha256": hashes[k]} for k in sorted(counts)],
    }
    write_manifest(spark, content, f"{path}/manifest")
    return content


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def ranked(rows: DataFrame, errors: str = "errors", name: str = "name") -> DataFrame:
    """Adds rank (by most errors, then name) and share of all errors to a table of reports (one row a name)."""
    whole = Window.partitionBy()
    return rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc(errors), name))).withColumn("share", F.try_divide(F.col(errors).cast("double"), F.sum(errors).over(whole)))


def report_text(rows: DataFrame, name: str, *values: str, width: int = 24) -> DataFrame:
    """Aligned text lines of a metrics table: ranked ones by rank, others by name."""
    cells = [F.lpad(F.when(F.col(v).isNull(), F.lit("-")).otherwise(F.format_string("%.4f", F.col(v).cast("double"))), 12, " ") for v in values]
    return rows.orderBy("rank" if "rank" in rows.columns else name).select(F.concat(F.rpad(F.col(name).cast("string"), width, " "), *cells).alias("line"))
