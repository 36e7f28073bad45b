"""Rule-set XML files as DataFrames."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULESET_SCHEMA = (
    "_name string, _platform string, _default_off string, "
    "target array<struct<_host string>>, "
    "rule array<struct<_from string, _to string>>, "
    "exclusion array<struct<_pattern string>>, "
    "test array<struct<_url string>>, "
    "_corrupt_record string"
)
XML_OPTIONS = {"rowTag": "ruleset", "ignoreSurroundingSpaces": "false"}


def _text(content: Column) -> Column:
    """Text of an XML file by its byte-order mark or declared encoding, UTF-8 by default; NULL if
    the bytes are none, or the encoding is not known here."""
    start = F.decode(F.substring(content, 1, 200), "ISO-8859-1")
    declared = F.upper(F.regexp_extract(start, r"^<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", 1))
    mark = F.hex(F.substring(content, 1, 2))
    return (
        F.when(mark.isin("FEFF", "FFFE"), F.decode(content, "UTF-16"))
        .when(declared.isin("", "UTF-8", "UTF8", "US-ASCII", "ASCII"), F.try_validate_utf8(content.cast("string")))
        .when(declared.isin("ISO-8859-1", "ISO8859-1", "LATIN1", "LATIN-1"), F.decode(content, "ISO-8859-1"))
    )


def load_rulesets(spark: SparkSession, paths: str | list[str], pattern: str = "*.xml") -> DataFrame:
    """One row per file of a directory whose name fits ``pattern``, or per file of an explicit list (whose
    entries may hold wildcards), whatever its name.

    Columns ``ruleset_id`` (the file's path below the directory, or below the folder that
    all listed files share), ``file_sha256`` (of the raw bytes) and ``content`` (the text, NULL where
    it cannot be decoded; such files are malformed).
    """
    reader = spark.read.format("binaryFile")
    if isinstance(paths, str):
        reader, root = reader.option("pathGlobFilter", pattern), paths
    else:
        # Above the first part with a wildcard.
        folders = [re.split(r"/[^/]*[*?\[{]", p, maxsplit=1) for p in paths]
        root = posixpath.commonpath([f[0] if len(f) > 1 else posixpath.dirname(f[0]) for f in folders])
    root = f"{root.split('://', 1)[-1].removeprefix('file:').strip('/')}/"
    below = F.expr("substring(path, locate(:root, path) + length(:root))".replace(":root", _quoted(root)))
    base = F.substring_index("path", "/", -1)
    return reader.load(paths).select(
        F.when(F.instr("path", root) > 0, below).otherwise(base).alias("ruleset_id"),
        F.sha2("content", 256).alias("file_sha256"),
        _text(F.col("content")).alias("content"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def parse_rulesets(files: DataFrame) -> DataFrame:
    """Adds the struct column ``ruleset``, child elements in file order."""
    return files.withColumn("ruleset", F.from_xml("content", RULESET_SCHEMA, XML_OPTIONS))


def malformed_rulesets(parsed: DataFrame) -> DataFrame:
    """Files that are no well-formed rule set, with their text, for quarantine."""
    broken = F.col("ruleset").isNull() | F.col("ruleset._corrupt_record").isNotNull()
    return parsed.filter(broken).select("ruleset_id", "file_sha256", "content")


def wellformed_rulesets(parsed: DataFrame) -> DataFrame:
    return parsed.filter(
        F.col("ruleset").isNotNull() & F.col("ruleset._corrupt_record").isNull()
    )
