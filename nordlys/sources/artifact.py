"""Model artifacts: their configuration as it is shipped beside the programs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nordlys.operators.segmentation import Policy


@dataclass(frozen=True)
class Program:
    subwords: int
    tokens: int
    file: str


@dataclass(frozen=True)
class Artifact:
    """Name, version, language tags, abbreviations of segmentation, and the programs by their shapes."""

    name: str
    version: str
    language_tags: tuple[str, ...]
    abbreviations: frozenset[str]
    programs: tuple[Program, ...]

    def policy(self, **limits) -> Policy:
        if not self.abbreviations:
            raise ValueError("the artifact names no abbreviations")
        return Policy(self.abbreviations, **limits)

    def program_for(self, subwords: int, tokens: int) -> Program:
        """The smallest program that holds so many sub-words and tokens."""
        for p in self.programs:
            if p.subwords >= subwords and p.tokens >= tokens:
                return p
        raise ValueError(f"no program holds {subwords} sub-words and {tokens} tokens")


def read_artifact(spark: SparkSession, path: str, backend: str = "xnnpack") -> Artifact:
    """An artifact's JSON configuration; a missing name, version or language is an error, programs of other backends are left out."""
    text = spark.read.option("wholetext", True).text(path).first()["value"]
    kind = "artifact_name string, artifact_version string, language_tags array<string>, segmentation struct<abbreviations:array<string>>, programs array<struct<backend:string,subwords:int,tokens:int,file:string>>"
    row = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("a")).first()["a"]
    for need in ("artifact_name", "artifact_version", "language_tags"):
        if not row[need]:
            raise ValueError(f"an artifact needs {need}")
    programs = sorted((p["subwords"], p["tokens"], p["file"]) for p in row["programs"] or [] if p["backend"] == backend)
    words = (row["segmentation"] or {"abbreviations": None})["abbreviations"] or []
    return Artifact(row["artifact_name"], row["artifact_version"], tuple(row["language_tags"]), frozenset(words), tuple(Program(*p) for p in programs))
