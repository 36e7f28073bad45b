"""Report sinks. Each writes to a new place and never over its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemesh.operators.report import disable_failing, json_document, json_lines


def append_results(results: DataFrame, path: str, run: str | None = None) -> None:
    """Adds the rows to the table at ``path``.

    With ``run``, a name for this run, they lie in a partition of that name, which a repeated run
    replaces: its rows are there once, however often it was tried. (A repetition without any row replaces nothing.)
    Named and nameless runs do not share a table.
    """
    if run is None:
        results.write.mode("append").parquet(path)
        return
    named = results.withColumn("run", F.lit(run))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def write_json_report(results: DataFrame, coverage: DataFrame, path: str) -> None:
    """JSON lines, one folder per result class and one for ``coverage``."""
    lines = json_lines(results, coverage)
    lines.write.mode("errorifexists").partitionBy("section").text(path)


def write_json_document(results: DataFrame, coverage: DataFrame, path: str) -> None:
    """Text files that, one after the other in name order, are one JSON object."""
    order = ["part", "section", "line", "text"]
    document = json_document(results, coverage)
    document.orderBy(*order).select("text").write.mode("errorifexists").text(path)


def write_disabled(
    files: DataFrame, problems: DataFrame, path: str, tool: str = "rule checker"
) -> None:
    """One folder ``ruleset_id=...`` with one text file for each disabled rule set, whatever its size.

    The lines of a rule set go to one task, which sorts them (on disk if need be) and
    writes them one by one; nothing is gathered.
    """
    lines = disable_failing(files, problems, tool)
    ordered = lines.repartition("ruleset_id").sortWithinPartitions("ruleset_id", "part", "text")
    ordered.select("ruleset_id", "text").write.mode("errorifexists").partitionBy("ruleset_id").text(path)
