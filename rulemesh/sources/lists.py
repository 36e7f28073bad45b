"""Plain-text lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_skiplist(lines: DataFrame) -> DataFrame:
    """First space-separated token of each line, a SHA-256 in hex."""
    token = F.lower(F.split("value", " ")[0])
    return lines.select(token.alias("sha256")).filter("sha256 <> ''").distinct()


def load_skiplist(spark: SparkSession, path: str) -> DataFrame:
    return parse_skiplist(spark.read.text(path))


def parse_url_list(lines: DataFrame) -> DataFrame:
    """Distinct lines without trailing white space."""
    return lines.select(F.regexp_replace("value", r"\s+$", "").alias("url")).distinct()


def load_url_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_list(spark.read.text(path))
