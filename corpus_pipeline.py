"""A corpus from raw documents to tokens, as stages over the table of documents.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which is written and read again as the next one's documents. All but the last
return the columns of the documents they got; the last adds the tokens and their digests.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bpe import add_tokens
from tidemill.llm.common import kept
from tidemill.llm.decontamination import without_leaks
from tidemill.llm.quality import keep_good
from tidemill.llm.secret_scan import redact_secrets
from tidemill.llm.shingle_sets import keep_one_of_similar
from tidemill.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or come from a rejected host go."""
    _ship(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of pairs with a similarity of 0.8 or more connect, that of the smallest id stays."""
    _ship(spark)
    return keep_one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _ship(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; every document stays."""
    _ship(spark)
    return redact_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get their tokens, with digests of these and of what they decode to."""
    _ship(spark)
    return add_tokens(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Similar sets, random walks and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, drop = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, drop_next = kept(stage(spark, docs, sf_dir), name)
        if drop:
            drop()
        drop = drop_next
    return STAGES[-1][1](spark, docs, sf_dir)


def _ship(spark):
    ship_package(spark, Path(__file__).resolve().parent / "tidemill")
