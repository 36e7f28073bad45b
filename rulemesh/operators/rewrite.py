"""Which rule sets cover a host, and what they make of a URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulemesh.functions.urls import accepted_scheme, host_key, idn_ascii, scheme_error
from rulemesh.operators.index import (
    RULE_HIT,
    RuleIndex,
    first_match,
    first_rule_hit,
    host_target_keys,
    literal_keys,
    with_first,
)
from rulemesh.operators.joins import keyed_join


def match_targets(hosts: DataFrame, index: RuleIndex) -> DataFrame:
    """Distinct ``host, ruleset_id`` for every rule set with a covering target."""
    distinct_hosts = hosts.select("host").distinct()
    keys = host_target_keys(distinct_hosts, index)
    covered = keyed_join(
        keys,
        index.targets.withColumnRenamed("host", "target_host"),
        "target_host",
        fits=index.fits,
        hot_rows=index.hot_rows,
    )
    return covered.select("host", "ruleset_id").distinct()


def target_hierarchy(targets: DataFrame) -> DataFrame:
    """The host index as edges ``parent, child, kind, depth``.

    ``domain`` edges lead from a suffix to the suffix one label longer (the
    root is the empty text), ``ruleset`` edges from a target to its rule sets.
    """
    labels = F.split("host", r"\.")
    domains = (
        targets.select("host")
        .distinct()
        .select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth"))
        .select(
            F.when(F.col("depth") == 1, F.lit(""))
            .otherwise(F.expr("substring_index(host, '.', 1 - depth)"))
            .alias("parent"),
            F.expr("substring_index(host, '.', -depth)").alias("child"),
            F.lit("domain").alias("kind"),
            F.col("depth").cast("int").alias("depth"),
        )
        .distinct()
    )
    leaves = targets.select(
        F.col("host").alias("parent"),
        F.col("ruleset_id").alias("child"),
        F.lit("ruleset").alias("kind"),
        (F.size(labels) + 1).cast("int").alias("depth"),
    ).distinct()
    return domains.unionByName(leaves)


def not_excluded(pairs: DataFrame, index: RuleIndex) -> DataFrame:
    """Rows ``(ruleset_id, url, ...)`` whose rule set does not exclude the URL."""
    marked = with_first(
        pairs,
        index.exclusions,
        index,
        "_excluded",
        first_match(F.col("url"), F.col("items"), "pattern"),
    )
    return marked.filter(F.col("_excluded").isNull()).drop("_excluded")


def apply_ruleset(pairs: DataFrame, index: RuleIndex) -> DataFrame:
    """Adds ``new_url, rule_pos, regex_error`` to rows ``(ruleset_id, url, ...)``.

    The first rule that changes the URL wins. Excluded and unmatched URLs stay
    as they are, with ``rule_pos`` NULL.
    """
    marked = with_first(
        pairs,
        index.exclusions,
        index,
        "_excluded",
        first_match(F.col("url"), F.col("items"), "pattern"),
    )
    hit = F.when(F.col("_excluded").isNull(), first_rule_hit(F.col("url"), F.col("items")))
    tried = with_first(marked, index.rules, index, "_hit", hit)
    failed = F.col("_hit.error")
    return tried.select(
        *pairs.columns,
        F.when(failed.isNull(), F.coalesce("_hit.new_url", "url")).alias("new_url"),
        F.when(failed.isNull(), F.col("_hit.pos")).alias("rule_pos"),
        failed.alias("regex_error"),
    )


def _candidates(urls: DataFrame, index: RuleIndex) -> DataFrame:
    """URL rows with each rule set that covers their host.

    With a broadcast index the URLs are not shuffled; a rule set may then come
    twice, through two targets, which the final aggregation does not see.
    """
    hosted = urls.filter(accepted_scheme(F.col("url"))).withColumn(
        "host", idn_ascii(host_key(F.col("url")))
    )
    if index.fits:
        covered = host_target_keys(hosted, index).join(
            F.broadcast(index.targets.withColumnRenamed("host", "target_host")), "target_host"
        )
    else:
        covered = keyed_join(
            hosted, match_targets(hosted, index), "host", hot_rows=index.hot_rows
        )
    return covered.select(*urls.columns, "ruleset_id")


def _hits_by_lookup(urls: DataFrame, index: RuleIndex) -> DataFrame:
    """``urls`` with ``_hits``, by broadcast look-ups only: no row moves."""
    looked = urls.withColumn(
        "_host",
        F.when(accepted_scheme(F.col("url")), idn_ascii(host_key(F.col("url")))),
    )
    keys = literal_keys(F.col("_host"), index.shapes)
    looked = looked.select("*", *[key.alias(f"_key{i}") for i, key in enumerate(keys)])
    known = F.broadcast(index.by_target)
    for i in range(len(keys)):
        side = known.select(
            F.col("target_host").alias(f"_key{i}"), F.col("rulesets").alias(f"_sets{i}")
        )
        looked = looked.join(side, f"_key{i}", "left")
    none = F.array().cast(index.by_target.schema["rulesets"].dataType)
    sets = [F.coalesce(f"_sets{i}", none) for i in range(len(keys))]
    url = F.col("url")
    excluded = lambda s: first_match(url, s["_exclusions"], "pattern").isNotNull()
    hits = F.transform(
        F.sort_array(F.concat(*sets) if sets else none),
        lambda s: F.struct(
            s["ruleset_id"].alias("ruleset_id"),
            F.when(~excluded(s), first_rule_hit(url, s["_rules"])).alias("_hit"),
        ),
    )
    return looked.select(*urls.columns, F.filter(hits, lambda h: h["_hit"].isNotNull()).alias("_hits"))


def _first_by_lookup(urls: DataFrame, index: RuleIndex) -> DataFrame:
    found = _hits_by_lookup(urls, index)
    first = F.try_element_at("_hits", F.lit(1))
    last = F.try_element_at("_hits", F.lit(-1))
    return found.select(
        *urls.columns,
        first.alias("_first"),
        (first["ruleset_id"] != last["ruleset_id"]).alias("_several"),
    )


def _first_by_grouping(urls: DataFrame, index: RuleIndex) -> DataFrame:
    """The same by joins on host and rule set and one aggregation by URL row."""
    hits = with_first(
        not_excluded(_candidates(urls, index), index),
        index.rules,
        index,
        "_hit",
        first_rule_hit(F.col("url"), F.col("items")),
    ).select(*urls.columns, "ruleset_id", "_hit", F.lit(0).alias("_copies"))
    untouched = urls.select(
        *urls.columns,
        F.lit(None).cast("string").alias("ruleset_id"),
        F.lit(None).cast(RULE_HIT).alias("_hit"),
        F.lit(1).alias("_copies"),
    )
    changed_by = F.when(F.col("_hit").isNotNull(), F.col("ruleset_id"))
    return (
        untouched.unionByName(hits)
        .groupBy(*urls.columns)
        .agg(
            F.min(F.when(F.col("_hit").isNotNull(), F.struct("ruleset_id", "_hit"))).alias(
                "_first"
            ),
            (F.min(changed_by) != F.max(changed_by)).alias("_several"),
            F.sum("_copies").cast("int").alias("_copies"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select(*urls.columns, "_first", "_several")
    )


def transform_urls(urls: DataFrame, index: RuleIndex) -> DataFrame:
    """Rewrite each URL by the rule sets that cover its host.

    Input rows have a column ``url`` and any other columns; each gives one row.
    Adds ``new_url, ruleset_id, rule_pos, ambiguous, error``. The first rule
    set, by id, that changes the URL wins; ``ambiguous`` says that another would
    have changed it too. An unknown scheme is an error.

    A corpus measured to fit a broadcast is looked up in place and the URLs are
    not shuffled; a larger one is joined.
    """
    if index.by_target is not None:
        merged = _first_by_lookup(urls, index)
    else:
        merged = _first_by_grouping(urls, index)
    merged = merged.withColumn(
        "_error", F.coalesce(scheme_error(F.col("url")), F.col("_first._hit.error"))
    )
    error = F.col("_error")
    return merged.select(
        *urls.columns,
        F.when(error.isNull(), F.coalesce("_first._hit.new_url", "url")).alias("new_url"),
        F.when(error.isNull(), F.col("_first.ruleset_id")).alias("ruleset_id"),
        F.when(error.isNull(), F.col("_first._hit.pos")).alias("rule_pos"),
        F.coalesce("_several", F.lit(False)).alias("ambiguous"),
        error.alias("error"),
    )
