"""A rule corpus as relational tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemesh.functions.patterns import java_template, pattern_compiles, template_fits
from rulemesh.functions.urls import idn_ascii
from rulemesh.operators.joins import fits_broadcast, keyed_join


@dataclass(frozen=True)
class Corpus:
    """The child tables of a set of rule sets.

    rulesets    ruleset_id, name, platform, default_off, file_sha256
    targets     ruleset_id, pos, host
    rules       ruleset_id, pos, from_pattern, to_template, to_java
    exclusions  ruleset_id, pos, pattern
    tests       ruleset_id, pos, url, origin   (explicit ones)
    """

    rulesets: DataFrame
    targets: DataFrame
    rules: DataFrame
    exclusions: DataFrame
    tests: DataFrame

    def keep(self, rulesets: DataFrame) -> Corpus:
        """The part of the corpus that belongs to the given rule sets."""
        ids = rulesets.select("ruleset_id")
        fits = fits_broadcast(ids)

        def part(table: DataFrame) -> DataFrame:
            return keyed_join(table, ids, "ruleset_id", "left_semi", fits=fits)

        return Corpus(
            rulesets,
            part(self.targets),
            part(self.rules),
            part(self.exclusions),
            part(self.tests),
        )


def normalise(parsed: DataFrame) -> Corpus:
    """Split parsed rule sets into child tables; ``pos`` keeps the file order."""

    def children(element: str) -> DataFrame:
        return parsed.select("ruleset_id", F.posexplode(f"ruleset.{element}"))

    rulesets = parsed.select(
        "ruleset_id",
        F.col("ruleset._name").alias("name"),
        F.coalesce("ruleset._platform", F.lit("default")).alias("platform"),
        F.col("ruleset._default_off").alias("default_off"),
        "file_sha256",
    )
    targets = children("target").select(
        "ruleset_id", "pos", idn_ascii(F.col("col._host")).alias("host")
    )
    rules = children("rule").select(
        "ruleset_id",
        "pos",
        F.col("col._from").alias("from_pattern"),
        F.col("col._to").alias("to_template"),
        java_template(F.col("col._to")).alias("to_java"),
    )
    exclusions = children("exclusion").select(
        "ruleset_id", "pos", F.col("col._pattern").alias("pattern")
    )
    tests = children("test").select(
        "ruleset_id",
        "pos",
        F.col("col._url").alias("url"),
        F.lit("explicit").alias("origin"),
    )
    return Corpus(rulesets, targets, rules, exclusions, tests)


def active_rulesets(rulesets: DataFrame, include_default_off: bool = False) -> DataFrame:
    """Rule sets that are switched on. An empty ``default_off`` counts as on."""
    if include_default_off:
        return rulesets
    return rulesets.filter(F.coalesce("default_off", F.lit("")) == "")


def skip_known(rulesets: DataFrame, skiplist: DataFrame) -> DataFrame:
    """Rule sets whose file digest is not in the skiplist."""
    known = skiplist.select(F.col("sha256").alias("file_sha256"))
    kept = keyed_join(
        rulesets, known, "file_sha256", "left_anti", fits=fits_broadcast(known)
    )
    return kept.select(rulesets.columns)


def derive_tests(corpus: Corpus) -> DataFrame:
    """Explicit tests and one per target without a wildcard. Duplicates stay."""
    implied = corpus.targets.filter(~F.col("host").contains("*")).select(
        "ruleset_id",
        "pos",
        F.concat(F.lit("http://"), "host", F.lit("/")).alias("url"),
        F.lit("target").alias("origin"),
    )
    return corpus.tests.select("ruleset_id", "pos", "url", "origin").unionByName(implied)


def validate_rules(corpus: Corpus) -> DataFrame:
    """Every rule and exclusion with ``valid`` and ``error``.

    Patterns and templates are tried on the JVM's own regex engine, the one
    that later runs them, so nothing that passes can fail a job.
    """
    elements = corpus.rules.select(
        "ruleset_id",
        F.lit("rule").alias("kind"),
        F.col("pos").cast("int").alias("pos"),
        F.col("from_pattern").alias("pattern"),
        "to_java",
    ).unionByName(
        corpus.exclusions.select(
            "ruleset_id",
            F.lit("exclusion").alias("kind"),
            F.col("pos").cast("int").alias("pos"),
            "pattern",
            F.lit("").alias("to_java"),
        )
    )
    compiled = elements.withColumn("compiles", pattern_compiles(F.col("pattern")))
    fitted = compiled.withColumn(
        "fits", F.when(F.col("compiles"), template_fits(F.col("pattern"), F.col("to_java")))
    )
    error = F.when(~F.col("compiles"), F.lit("pattern does not compile")).when(
        ~F.col("fits"), F.lit("template names a missing group")
    )
    return fitted.select(
        "ruleset_id",
        "kind",
        "pos",
        "pattern",
        "to_java",
        error.isNull().alias("valid"),
        error.alias("error"),
    )


def usable_elements(corpus: Corpus) -> tuple[Corpus, DataFrame]:
    """The corpus with what cannot run set apart, and the rejected rows.

    A pattern that does not compile makes its file unreadable: all of the rule
    set goes. A rule whose template names a missing group stays in its place
    with an ``error``; tests that reach it end as regex errors.
    """
    checked = validate_rules(corpus)
    rejected = checked.filter(~F.col("valid"))
    unreadable = rejected.filter(F.col("error") == "pattern does not compile")
    readable = corpus.rulesets.join(
        unreadable.select("ruleset_id").distinct(), "ruleset_id", "left_anti"
    ).select(corpus.rulesets.columns)
    kept = corpus.keep(readable)
    failing = rejected.filter(F.col("kind") == "rule").select(
        "ruleset_id", "pos", F.concat_ws(" ", "error", "pattern").alias("error")
    )
    rules = kept.rules.join(failing, ["ruleset_id", "pos"], "left")
    return Corpus(kept.rulesets, kept.targets, rules, kept.exclusions, kept.tests), rejected
