"""A corpus in five stages: drop poor documents, one of each near-duplicate group, contaminated ones, mask secrets, mix sources.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves; every stage but the last returns the columns
of its input. The last returns each document as often as the mix takes it, numbered by ``copy_no``. An empty table passes
through all stages; other columns ride along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomry.llm import decontaminate, jaccard_join, mix_sources, passage_quality, secret_scan
from fathomry.llm.common import finished, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, doesn't reject.

    Every row is scored by its own text, so repeated rows stay or go alike; null, empty and blank texts have the score of no
    evidence and are kept or rejected by it; null ids are scored but not learned from. Without usable labels all stay.
    """
    return passage_quality.keep_good(docs, passage_quality.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id (null last, then by a digest of the text).

    A row is told by its id and its text: rows equal in both become one, rows with one id and unlike texts are judged apart.
    Null, empty and blank texts link with nothing; each such id stays once for each of its texts.
    """
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contamination rule allows.

    Every row is judged by its own text; null, empty and wordless texts stay, and so do all without a benchmark.
    """
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each as often as before, secrets masked, and ``n_chars`` counted again where a text changed.

    Null and empty texts stay as they are.
    """
    return secret_scan.redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, numbered by ``copy_no`` (which replaces a column of that name).

    Null sources are one source, last in order; rows with equal id and text are taken alike; a source of size 0 gives none.
    """
    return mix_sources.mixed_rows(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

# A fitted classifier decides the first stage; tests/llm holds run() against a plain version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
