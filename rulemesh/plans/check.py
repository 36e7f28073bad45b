"""The whole check of a corpus, from files and captures to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.operators.compare import big_distance, comparable, page_distance, verdict
from rulemesh.operators.corpus import (
    Corpus,
    active_rulesets,
    derive_tests,
    normalise,
    skip_known,
    usable_elements,
)
from rulemesh.operators.coverage import coverage_gate, coverage_problems, what_applies
from rulemesh.operators.index import RuleIndex, build_rule_index
from rulemesh.operators.joins import BROADCAST_BYTES, keyed_join, stored
from rulemesh.operators.redirects import (
    Side,
    capture_heads,
    pair_captures,
    resolve_both,
    resolve_platform,
)
from rulemesh.operators.rewrite import apply_ruleset, not_excluded, transform_urls
from rulemesh.session import cut_lineage, ship_package
from rulemesh.sources.rulesets import (
    load_rulesets,
    malformed_rulesets,
    parse_rulesets,
    wellformed_rulesets,
)


@dataclass(frozen=True)
class LoadedCorpus:
    corpus: Corpus
    rejected: DataFrame  # rules and exclusions that cannot run
    malformed: DataFrame  # files that are no rule set
    files: DataFrame  # ruleset_id, content of everything read


def load_corpus(
    spark: SparkSession,
    paths: str | list[str],
    skiplist: DataFrame | None = None,
    include_default_off: bool = False,
) -> LoadedCorpus:
    """Read, skip, parse, validate. The parsed files, and the tables cut from
    them, are kept in the checkpoint folder, since every later step reads them."""
    files = load_rulesets(spark, paths)
    wanted = files if skiplist is None else skip_known(files, skiplist)
    parsed = cut_lineage(parse_rulesets(wanted))
    whole = normalise(wellformed_rulesets(parsed))
    active = whole.keep(active_rulesets(whole.rulesets, include_default_off))
    usable, rejected = usable_elements(active)
    corpus = Corpus(
        rulesets=cut_lineage(usable.rulesets),
        targets=cut_lineage(usable.targets),
        rules=cut_lineage(usable.rules),
        exclusions=cut_lineage(usable.exclusions),
        tests=cut_lineage(usable.tests),
    )
    return LoadedCorpus(
        corpus, rejected, malformed_rulesets(parsed), parsed.select("ruleset_id", "content")
    )


def tested_pairs(
    corpus: Corpus,
    captures: DataFrame,
    index: RuleIndex,
    max_depth: int = 10,
    url_list: DataFrame | None = None,
    static_ca_set: str | None = None,
    ca_sets: DataFrame | None = None,
) -> DataFrame:
    """Each tested URL beside its plain and its rewritten response.

    Without ``url_list`` the tests of the corpus that are not excluded; with
    one, the listed URLs, rewritten by whatever rule sets cover them. ``ca_sets`` (platform,
    ca_set) names the certificate set of each platform, that of ``default`` for unknown ones;
    the sets then take the platforms' place.
    """
    if url_list is None:
        tests = derive_tests(corpus).withColumn("pos", F.col("pos").cast("bigint"))
        rewritten = apply_ruleset(not_excluded(tests, index), index)
    else:
        rewritten = transform_urls(url_list.select("url").distinct(), index).select(
            "ruleset_id",
            F.lit(None).cast("bigint").alias("pos"),
            "url",
            F.lit("list").alias("origin"),
            "new_url",
            "rule_pos",
            F.col("error").alias("regex_error"),
        )
    tests = keyed_join(
        rewritten, index.platforms, "ruleset_id", "left", fits=index.fits, hot_rows=index.hot_rows
    ).withColumn("platform", F.coalesce("platform", F.lit("default")))
    rulesets = index.platforms
    if static_ca_set is not None:
        tests = tests.withColumn("platform", F.lit(static_ca_set))
    elif ca_sets is not None:
        resolved = lambda df: resolve_platform(df, ca_sets).withColumn("platform", F.col("ca_set")).drop("ca_set")
        tests, rulesets = resolved(tests), resolved(rulesets)
    # Read by both resolutions and once more by the pairing.
    tests, found = stored(tests)
    plain = Side(tests.select(F.col("url").alias("start_url")))
    secure = Side(
        tests.filter("new_url IS NOT NULL").select(F.col("new_url").alias("start_url"), "platform"),
        index,
        rulesets,
        static_ca_set,
    )
    (first, size), (second, _) = resolve_both(plain, secure, capture_heads(captures), max_depth, index.hot_rows)
    fits = size["bytes"] <= BROADCAST_BYTES
    return pair_captures(tests, first, second, index.hot_rows, fits, found["rows"])


@dataclass(frozen=True)
class CheckRun:
    results: DataFrame  # one row per tested URL
    coverage: DataFrame  # coverage problems
    gate: DataFrame  # their number and the exit code
    distances: DataFrame  # pairs of pages that differ too much


def check_corpus(
    corpus: Corpus,
    captures: DataFrame,
    metric: str = "markup",
    max_distance: float = 0.1,
    max_depth: int = 10,
    url_list: DataFrame | None = None,
    static_ca_set: str | None = None,
    ca_sets: DataFrame | None = None,
) -> CheckRun:
    """Coverage, verdicts and page distances of a corpus over captures."""
    ship_package(corpus.rulesets.sparkSession)  # page outlines run in Python
    index = build_rule_index(corpus)
    applied = cut_lineage(what_applies(derive_tests(corpus), index))
    coverage = coverage_problems(corpus, applied)
    pairs = cut_lineage(
        tested_pairs(corpus, captures, index, max_depth, url_list, static_ca_set, ca_sets)
    )
    results = verdict(pairs)
    far = big_distance(page_distance(metric, comparable(pairs), captures), max_distance)
    return CheckRun(results, coverage, coverage_gate(coverage), far)
