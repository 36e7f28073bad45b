"""Targets whose hosts overlap, found by walking two tries of host labels side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemesh.operators.joins import HOT_ROWS, keyed_join, stored
from rulemesh.session import cut_lineage


def _is_open(node: Column, depth: int) -> Column:
    """Whether a target of this text and number of labels covers hosts of more labels too."""
    return node.startswith("*.") if depth >= 3 else F.lit(False)


def _trie(hosts: DataFrame) -> DataFrame:
    """The edges ``depth, node, label, child, ends, wild``: ``ends`` says that the child is a target,
    ``wild`` that a target with a wildcard lies at or below it. The root is the empty text."""
    labels = F.split("host", r"\.")
    return (
        hosts.select("host", labels.alias("_labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth"))
        .select(
            "depth",
            F.when(F.col("depth") == 1, F.lit(""))
            .otherwise(F.expr("substring_index(host, '.', 1 - depth)"))
            .alias("node"),
            F.element_at("_labels", -F.col("depth")).alias("label"),
            F.expr("substring_index(host, '.', -depth)").alias("child"),
            (F.col("depth") == F.size("_labels")).alias("ends"),
            F.array_contains("_labels", "*").alias("wild"),
        )
        .groupBy("depth", "node", "label", "child")
        .agg(F.max("ends").alias("ends"), F.max("wild").alias("wild"))
    )


def overlapping_targets(targets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``host, other``: each target text with a wildcard and every other text that covers a host it covers as well.

    A wildcard stands for one label, a leftmost one of a target with three or more labels for one or more.
    Two texts with wildcards come out both ways round. Equal texts are no pair (``corpus_lint`` names them as
    ``shared_host``), repeated rows count once, NULL hosts are left out, further columns ignored.

    The walk holds pairs of trie nodes, one of the texts with wildcards and one of all texts, that agree
    label by label from the top level down. Every step and every ending is an equality join: a literal
    label is looked up as itself and as a wildcard, a wildcard by the other side's node. Texts that
    differ in a label are never paired below it.
    """
    spark = targets.sparkSession
    hosts = cut_lineage(targets.filter(F.col("host").isNotNull()).select("host").distinct())
    edges, trie = stored(_trie(hosts))
    wild_hosts = hosts.filter(F.array_contains(F.split("host", r"\."), "*"))
    below, suffixes = stored(
        hosts.select(
            "host", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("_depth")
        ).select("host", F.expr("substring_index(host, '.', -_depth)").alias("_node"))
    )
    wild_below = below.join(wild_hosts, "host", "left_semi")
    deepest = edges.agg(F.max("depth")).first()[0] or 0

    front = spark.createDataFrame([("", "")], "a string, b string")
    found = [spark.createDataFrame([], "host string, other string")]
    for depth in range(1, deepest + 1):
        steps = edges.filter(F.col("depth") == depth)
        own = steps.filter("wild").select(
            F.col("node").alias("a"), F.col("label").alias("_label"), F.col("child").alias("_a"),
            (F.col("ends") & F.array_contains(F.split("child", r"\."), "*")).alias("a_ends"),
        )
        theirs = steps.select(F.col("node").alias("b"), F.col("child").alias("_b"), F.col("ends").alias("b_ends"))
        # The side with many rows a key is the trie's: it is the one that is spread.
        moved, size = stored(keyed_join(own, front, "a", hot_rows=hot_rows, rows=trie["rows"]))
        any_label = moved.filter(F.col("_label") == "*").select("b", "_a", "a_ends")
        by_node = keyed_join(theirs, any_label, "b", hot_rows=hot_rows, rows=trie["rows"])
        below_b = lambda label: F.when(F.col("b") == "", label).otherwise(F.concat(label, F.lit("."), "b"))
        wanted = moved.filter(F.col("_label") != "*").select(
            "_a", "a_ends", F.explode(F.array(below_b(F.col("_label")), below_b(F.lit("*")))).alias("_b")
        )
        by_label = keyed_join(wanted, theirs.drop("b"), "_b", hot_rows=hot_rows, rows=2 * size["rows"])
        names = ["_a", "_b", "a_ends", "b_ends"]
        both, size = stored(by_node.select(names).unionByName(by_label.select(names)))
        if not size["rows"]:
            break
        found.append(both.filter("a_ends AND b_ends").select(F.col("_a").alias("host"), F.col("_b").alias("other")))
        for ended, open_side, closed_side, longer in (
            ("a_ends", "_a", "_b", below),
            ("b_ends", "_b", "_a", wild_below),
        ):
            covers = both.filter(F.col(ended) & _is_open(F.col(open_side), depth)).select(
                F.col(open_side).alias("_open"), F.col(closed_side).alias("_node")
            )
            met = keyed_join(longer, covers.distinct(), "_node", hot_rows=hot_rows, rows=suffixes["rows"])
            pair = ("_open", "host") if ended == "a_ends" else ("host", "_open")
            found.append(met.select(F.col(pair[0]).alias("host"), F.col(pair[1]).alias("other")))
        front = both.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return reduce(DataFrame.unionByName, found).filter("host <> other").distinct()


def shared_wildcards(targets: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Lint rows ``kind, subject, ruleset_id, n``: a wildcard target of a rule set, and how many other target texts
    that another rule set claims overlap it. Targets without any are left out."""
    claims = targets.filter(F.col("host").isNotNull()).select("host", "ruleset_id").distinct()
    owners = claims.groupBy(F.col("host").alias("other")).agg(
        F.min("ruleset_id").alias("_least"), F.max("ruleset_id").alias("_most")
    )
    pairs = keyed_join(cut_lineage(overlapping_targets(targets, hot_rows)), owners, "other", hot_rows=hot_rows)
    # Pairs are counted by their text's only owner, if it has one, before they meet the claims.
    sole = F.when(F.col("_least") == F.col("_most"), F.col("_least"))
    counts = pairs.groupBy("host", sole.alias("_sole")).agg(F.count(F.lit(1)).alias("n"))
    all_of = counts.groupBy("host").agg(F.sum("n").alias("_all"))
    own = counts.filter(F.col("_sole").isNotNull()).select("host", F.col("_sole").alias("ruleset_id"), "n")
    judged = keyed_join(claims, all_of, "host", hot_rows=hot_rows).join(own, ["host", "ruleset_id"], "left")
    others = (F.col("_all") - F.coalesce("n", F.lit(0))).alias("n")
    return judged.select(
        F.lit("wildcard_overlap").alias("kind"), F.col("host").alias("subject"), "ruleset_id", others
    ).filter("n > 0")
