"""Captured responses, the table that stands in for fetching.

Columns ``url string, http_code int, headers string, body string,
error string, short_error string``; one row per URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE_COLUMNS = {
    "url": "string",
    "http_code": "int",
    "headers": "string",
    "body": "string",
    "error": "string",
    "short_error": "string",
}


def load_captures(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table of captures; a column it lacks is NULL."""
    stored = spark.read.parquet(path)
    return stored.select(
        *[
            (F.col(name) if name in stored.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in CAPTURE_COLUMNS.items()
        ]
    )
