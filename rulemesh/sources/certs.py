"""Certificates in PEM form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ARMOUR = r"-----BEGIN CERTIFICATE-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END CERTIFICATE-----"
_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def load_certs(
    spark: SparkSession, path: str, symlinks: DataFrame | None = None, pattern: str = "*.pem"
) -> DataFrame:
    """``path, is_symlink, pem`` of every file whose name fits ``pattern``.

    The reader cannot tell symbolic links, so ``symlinks(path)`` may name them.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("pem"))
    )
    if symlinks is None:
        return files.select("path", F.lit(False).alias("is_symlink"), "pem")
    marked = symlinks.select("path").distinct().withColumn("_linked", F.lit(True))
    return files.join(marked, "path", "left").select(
        "path", F.coalesce("_linked", F.lit(False)).alias("is_symlink"), "pem"
    )


def pem_digest(pem: Column) -> Column:
    """SHA-256 of the DER bytes; NULL when there is no decodable block."""
    packed = F.regexp_replace(F.regexp_extract(pem, _ARMOUR, 1), r"\s+", "")
    usable = (packed != "") & packed.rlike(_BASE64)
    return F.when(usable, F.sha2(F.unbase64(packed), 256))


def with_digest(certs: DataFrame) -> DataFrame:
    """Adds ``der_sha256`` and ``error`` (NULL for a usable file)."""
    digest = certs.withColumn("der_sha256", pem_digest(F.col("pem")))
    return digest.withColumn(
        "error", F.when(F.col("der_sha256").isNull(), F.lit("no certificate in file"))
    )
