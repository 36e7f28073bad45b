"""Reports on the results of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemesh.operators.joins import fits_broadcast, keyed_join

# Texts that are part of the output.
DISABLED_TEXT = "failed ruleset test"
DISABLED_OPENING = "\n<!--\nDisabled by %s because:"


def results_by_class(results: DataFrame) -> DataFrame:
    return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def run_summary(files: DataFrame, tested: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: rule-set files, tested URL pairs and the run time given."""
    loaded = files.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("files"), F.lit(0).cast("bigint").alias("pairs")
    )
    pairs = tested.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).cast("bigint").alias("files"), F.col("n").alias("pairs")
    )
    return (
        loaded.unionByName(pairs)
        .agg(F.sum("files").alias("files"), F.sum("pairs").alias("pairs"))
        .withColumn("seconds", F.lit(seconds).cast("double"))
    )


def json_lines(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """``section, json``: one row per result, in the section of its class, and
    one per coverage problem. The form to write at scale."""
    rows = results.select(
        F.col("result").alias("section"),
        F.to_json(F.struct("details", "fname", "url", "https_url")).alias("json"),
    )
    problems = coverage.select(
        F.lit("coverage").alias("section"), F.to_json(F.struct("message")).alias("json")
    )
    return rows.unionByName(problems)


def json_document(results: DataFrame, coverage: DataFrame) -> DataFrame:
    """The whole report as the lines of one JSON object.

    Sorted by ``part, section, line, text`` the texts are the document:
    ``coverage`` with the list of messages, then each result class with the
    list of its rows. No list is gathered anywhere, so a class may hold any
    number of rows: the least row of a section follows its opening line and
    every other row brings its own comma.
    """
    elements = (
        results.select(
            F.lit(1).alias("part"),
            F.col("result").alias("section"),
            F.to_json(F.struct("details", "fname", "url", "https_url")).alias("text"),
        )
        .unionByName(
            coverage.select(F.to_json(F.array("message")).alias("m")).select(
                F.lit(0).alias("part"),
                F.lit("coverage").alias("section"),
                F.expr("substring(m, 2, length(m) - 2)").alias("text"),
            )
        )
        .groupBy("part", "section", "text")
        .agg(F.count(F.lit(1)).cast("int").alias("copies"))
    )
    # One row per result class, of which there are at most four.
    least = elements.groupBy("section").agg(F.min("text").alias("least"))
    first = (F.col("text") == F.col("least")) & (F.col("copy") == 1)
    body = (
        elements.join(F.broadcast(least), "section")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "part",
            "section",
            F.when(first, F.lit(1)).otherwise(F.lit(2)).alias("line"),
            F.when(first, F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text"),
        )
    )
    openings = (
        elements.filter("part = 1")
        .select("part", "section")
        .distinct()
        .select(
            "part",
            "section",
            F.lit(0).alias("line"),
            F.concat(F.lit('], "'), "section", F.lit('": [')).alias("text"),
        )
    )
    frame = results.sparkSession.sql(
        """SELECT * FROM VALUES (0, 'coverage', 0, '{"coverage": ['), (2, '', 0, ']}')
           AS t(part, section, line, text)"""
    )
    return frame.unionByName(openings).unionByName(body)


# What may stand before the root element, one attribute, and the start tag of a rule set. Possessive throughout:
# nothing is tried twice, however long a file is.
_PROLOG = r"\uFEFF?(?:\s++|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*+(?:\[.*?\]\s*+)?>)*+"
_NAME, _VALUE = r"[^\s=<>/\"']++", r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')"
_ATTRIBUTES = rf"(?:\s++{_NAME}{_VALUE})*+"
_START = rf"(?s)^({_PROLOG}<ruleset)({_ATTRIBUTES})"
_DECLARATION = r"(?s)^\uFEFF?<\?xml\s.*?\?>\s*"


def _switched_off(attributes: Column) -> Column:
    """Whether ``default_off`` is among the attributes; quoted values are no attributes."""
    values_gone = F.regexp_replace(attributes, r"\"[^\"]*+\"|'[^']*+'", "")
    return F.rlike(values_gone, F.lit(r"\sdefault_off\s*="))


def _marked(content: Column) -> Column:
    """The file with ``default_off`` added after its rule set's own attributes. An XML declaration, which has
    to come first in a file, is left out: the text is written as UTF-8."""
    head, attributes = F.regexp_extract(content, _START, 1), F.regexp_extract(content, _START, 2)
    rest = F.substr(content, F.length(head) + F.length(attributes) + 1)
    added = F.concat(head, attributes, F.lit(f" default_off='{DISABLED_TEXT}'"), rest)
    return F.regexp_replace(F.when(head == "", content).otherwise(added), _DECLARATION, "")


def disable_failing(
    files: DataFrame, problems: DataFrame, tool: str = "rule checker"
) -> DataFrame:
    """Disabled text of each failing rule set as rows ``ruleset_id, part, text``.

    ``files`` has ``ruleset_id, content``, ``problems`` has ``ruleset_id,
    message``. Part 0 opens the comment, part 1 holds one row per problem and
    part 2 is the file, marked ``default_off``, from inside its first comment.
    Rule sets whose start tag names ``default_off`` already, with whatever text, are left out. A rule set may have any
    number of problems: nothing is gathered.
    """
    enabled = files.filter(~_switched_off(F.regexp_extract("content", _START, 2)))
    ids = problems.select("ruleset_id").distinct()
    failing = enabled.join(ids, "ruleset_id", "left_semi")
    marked = _marked(F.col("content"))
    rest = F.when(marked.startswith("<!--"), F.substring(marked, F.lit(5), F.length(marked)))
    opening = failing.select(
        "ruleset_id",
        F.lit(0).alias("part"),
        F.lit(DISABLED_OPENING % tool).alias("text"),
    )
    own = failing.select("ruleset_id")
    listed = keyed_join(problems, own, "ruleset_id", "left_semi", fits=fits_broadcast(own)).select(
        "ruleset_id",
        F.lit(1).alias("part"),
        F.replace("message", F.lit("--"), F.lit("- -")).alias("text"),
    )
    body = failing.select(
        "ruleset_id",
        F.lit(2).alias("part"),
        F.coalesce(rest, F.concat(F.lit("\n-->\n"), marked)).alias("text"),
    )
    return opening.unionByName(listed).unionByName(body)
