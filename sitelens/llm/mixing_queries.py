"""Documents drawn by source to the shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import documents, plain_source
from sitelens.llm.mixing import mix, shares_of, token_counts
from sitelens.session import cut
from sitelens.tables import load


def _counted(spark: SparkSession, folder: str) -> DataFrame:
    """Source and tokens of each document, counted once."""
    docs = documents(spark, folder, "source", "text").withColumn("key", F.struct("doc_id", plain_source(F.col("source")).alias("source")))
    return cut(token_counts(docs, "key", "text").select("key.doc_id", "key.source", "tokens").where("source is not null"))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "mix_targets").select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document, with its slot in the mixture; sources that are missing or too small for their share do not bound it."""
    return mix(_counted(spark, folder), _targets(spark, folder), spare=True)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in tokens."""
    docs, targets = _counted(spark, folder), _targets(spark, folder)
    return shares_of(cut(mix(docs, targets, spare=True)), targets, docs)


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
