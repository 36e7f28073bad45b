"""Do the tests of a rule set reach all of its rules and exclusions?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemesh.functions.patterns import (
    needed_tests_exclusion,
    needed_tests_rule,
    question_marks,
)
from rulemesh.operators.corpus import Corpus
from rulemesh.operators.index import RuleIndex, first_match, with_first
from rulemesh.operators.joins import fits_broadcast, keyed_join
from rulemesh.operators.rewrite import apply_ruleset

# Message formats that are part of the output.
NO_MATCH = "%s: No rule or exclusion applies to test URL %s"
TOO_FEW = "%s: Not enough tests (%d vs %s) for %s"
RULE_SHOWN = ("<Rule from '", "' to '", "'>")
EXCLUSION_SHOWN = ("<Exclusion pattern '", "'>")


def what_applies(tests: DataFrame, index: RuleIndex) -> DataFrame:
    """Adds ``kind, element_pos``: the first exclusion found in the URL, else
    the first rule found in it, else NULL."""
    url, items = F.col("url"), F.col("items")
    excluded = with_first(
        tests, index.exclusions, index, "_exclusion", first_match(url, items, "pattern")
    )
    ruled = with_first(
        excluded,
        index.rules,
        index,
        "_rule",
        F.when(F.col("_exclusion").isNull(), first_match(url, items, "from_pattern")),
    )
    return ruled.select(
        *tests.columns,
        F.when(F.col("_exclusion").isNotNull(), F.lit("exclusion"))
        .when(F.col("_rule").isNotNull(), F.lit("rule"))
        .alias("kind"),
        F.coalesce("_exclusion", "_rule").alias("element_pos"),
    )


def unmatched_tests(applied: DataFrame) -> DataFrame:
    """Rows of :func:`what_applies` that nothing applies to, with a message."""
    message = F.format_string(NO_MATCH, "ruleset_id", "url")
    return applied.filter(F.col("kind").isNull()).select(
        "ruleset_id", "origin", "pos", "url", message.alias("message")
    )


def needed_tests(corpus: Corpus, own_pattern: bool = False) -> DataFrame:
    """``ruleset_id, kind, pos, pattern, to_template, needed`` per element.

    By default an exclusion has the question marks of its rule set's last rule
    taken off, which is the established count; ``own_pattern`` takes off its own.
    """
    rules = corpus.rules.select(
        "ruleset_id",
        F.lit("rule").alias("kind"),
        F.col("pos").cast("int").alias("pos"),
        F.col("from_pattern").alias("pattern"),
        "to_template",
        needed_tests_rule(F.col("from_pattern")).alias("needed"),
    )
    exclusions = corpus.exclusions
    if own_pattern:
        exclusions = exclusions.withColumn("_off", question_marks(F.col("pattern")))
    else:
        last = corpus.rules.groupBy("ruleset_id").agg(
            F.max_by(question_marks(F.col("from_pattern")), "pos").alias("_off")
        )
        exclusions = keyed_join(
            exclusions, last, "ruleset_id", "left", fits=fits_broadcast(last)
        )
    return rules.unionByName(
        exclusions.select(
            "ruleset_id",
            F.lit("exclusion").alias("kind"),
            F.col("pos").cast("int").alias("pos"),
            "pattern",
            F.lit(None).cast("string").alias("to_template"),
            needed_tests_exclusion(
                F.col("pattern"), F.coalesce("_off", F.lit(0))
            ).alias("needed"),
        )
    )


def element_coverage(
    corpus: Corpus, applied: DataFrame, own_pattern: bool = False
) -> DataFrame:
    """Tests attributed to each element beside the number it needs."""
    counts = (
        applied.filter(F.col("kind").isNotNull())
        .groupBy("ruleset_id", "kind", F.col("element_pos").alias("pos"))
        .agg(F.count(F.lit(1)).cast("int").alias("actual"))
    )
    return (
        needed_tests(corpus, own_pattern)
        .join(counts, ["ruleset_id", "kind", "pos"], "left")
        .select(
            "ruleset_id",
            "kind",
            "pos",
            "pattern",
            "to_template",
            F.coalesce("actual", F.lit(0)).alias("actual"),
            "needed",
        )
    )


def coverage_problems(
    corpus: Corpus, applied: DataFrame, own_pattern: bool = False
) -> DataFrame:
    """Unmatched tests and elements with too few tests, with messages.

    ``applied`` is read twice; a caller with many tests stores it first.
    """
    element = F.when(
        F.col("kind") == "rule",
        F.concat(
            F.lit(RULE_SHOWN[0]),
            "pattern",
            F.lit(RULE_SHOWN[1]),
            F.regexp_replace("to_template", r"\$(\d)", r"\\g<$1>"),
            F.lit(RULE_SHOWN[2]),
        ),
    ).otherwise(F.concat(F.lit(EXCLUSION_SHOWN[0]), "pattern", F.lit(EXCLUSION_SHOWN[1])))
    short = element_coverage(corpus, applied, own_pattern).filter("actual < needed")
    few = short.select(
        "ruleset_id",
        "kind",
        element.alias("element"),
        "pos",
        "pattern",
        "actual",
        "needed",
        F.lit(None).cast("string").alias("url"),
    ).withColumn(
        "message",
        F.format_string(
            TOO_FEW,
            "ruleset_id",
            "actual",
            F.col("needed").cast("string"),
            "element",
        ),
    )
    unmatched = unmatched_tests(applied).select(
        "ruleset_id",
        F.lit("test").alias("kind"),
        F.lit(None).cast("string").alias("element"),
        F.col("pos").cast("int").alias("pos"),
        F.lit(None).cast("string").alias("pattern"),
        F.lit(None).cast("int").alias("actual"),
        F.lit(None).cast("int").alias("needed"),
        "url",
        "message",
    )
    return unmatched.unionByName(few)


def coverage_gate(problems: DataFrame) -> DataFrame:
    """One row: number of problems and the exit code that follows from it."""
    return problems.agg(F.count(F.lit(1)).alias("problems")).select(
        "problems", F.when(F.col("problems") > 0, F.lit(1)).otherwise(F.lit(0)).alias("exit_code")
    )


def corpus_lint(corpus: Corpus, index: RuleIndex) -> DataFrame:
    """Faults of the corpus as rows ``kind, subject, ruleset_id, n``.

    unrewritten_target  plain target its own rule set leaves alone or fails on
    duplicate_name      rule set whose name another file has too
    shared_host         target text claimed by several rule sets
    incomplete_host     target without a dot
    """
    plain = corpus.targets.filter(~F.col("host").contains("*")).select(
        "ruleset_id", F.concat(F.lit("http://"), "host", F.lit("/")).alias("url")
    )
    one = F.lit(1).cast("bigint").alias("n")
    unrewritten = (
        apply_ruleset(plain, index)
        .filter((F.col("new_url") == F.col("url")) | F.col("regex_error").isNotNull())
        .select(
            F.lit("unrewritten_target").alias("kind"),
            F.col("url").alias("subject"),
            "ruleset_id",
            one,
        )
    )
    names = corpus.rulesets.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    duplicates = keyed_join(corpus.rulesets, names, "name", hot_rows=index.hot_rows).select(
        F.lit("duplicate_name").alias("kind"), F.col("name").alias("subject"), "ruleset_id", "n"
    )
    claims = corpus.targets.select("host", "ruleset_id").distinct()
    shared_hosts = claims.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed_join(claims, shared_hosts, "host", hot_rows=index.hot_rows).select(
        F.lit("shared_host").alias("kind"), F.col("host").alias("subject"), "ruleset_id", "n"
    )
    incomplete = corpus.targets.filter(~F.col("host").contains(".")).select(
        F.lit("incomplete_host").alias("kind"), F.col("host").alias("subject"), "ruleset_id", one
    )
    return (
        unrewritten.unionByName(duplicates).unionByName(shared).unionByName(incomplete)
    )
