"""All core queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import derived, market, problems, reads, reports, streams

QUERIES = problems.QUERIES | derived.QUERIES | market.QUERIES | reports.QUERIES | streams.QUERIES | reads.QUERIES
ORACLE = problems.ORACLE | derived.ORACLE | market.ORACLE | reports.ORACLE | streams.ORACLE | reads.ORACLE


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The word arm and the vector arm of the same postings, fused by reciprocal ranks."""
    return market.word_vector_fusion(spark, d)
