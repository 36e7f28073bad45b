"""A corpus made ready for rewriting: host keys, bounded element lists, sizes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemesh.functions.patterns import necessary_literal
from rulemesh.operators.corpus import Corpus
from rulemesh.operators.joins import BROADCAST_BYTES, HOT_ROWS, keyed_join, stored
from rulemesh.session import cut_lineage

# Elements of one rule set are kept in ordered lists of at most this many.
CHUNK = 256
# Wildcard shapes written into the plan; with more, hosts walk their labels instead.
MAX_SHAPES = 256
# Look-ups per URL, one for each wildcard shape, up to which rewriting needs no
# shuffle at all.
MAX_LOOKUPS = 12

RULE_HIT = "struct<pos:int,new_url:string,error:string>"


@dataclass(frozen=True)
class Shape:
    """Labels of a target and where its wildcards are, counted from the top level."""

    labels: int
    stars: tuple[int, ...]

    @property
    def open(self) -> bool:
        """Whether the leftmost wildcard stands for any number of labels."""
        return self.labels >= 3 and (self.labels - 1) in self.stars


@dataclass(frozen=True)
class RuleIndex:
    """A corpus made ready, stored. Its tables are read from the files, by any number of URL tables."""

    targets: DataFrame  # ruleset_id, host
    rules: DataFrame  # ruleset_id, items
    exclusions: DataFrame  # ruleset_id, items
    platforms: DataFrame  # ruleset_id, platform
    shapes: tuple[Shape, ...] | None  # None: too many to write into the plan
    fits: bool  # all tables together may be broadcast
    one_list: bool  # no rule set has more than one list of either kind
    # target_host, rulesets: everything a host needs in one row, to broadcast;
    # None where that is too large or takes too many look-ups per URL.
    by_target: DataFrame | None = None
    hot_rows: int = HOT_ROWS


def _target_shapes(targets: DataFrame) -> DataFrame:
    """``labels, stars`` of each target, stars ascending from the top level."""
    reversed_labels = F.reverse(F.split("host", r"\."))
    stars = F.filter(
        F.transform(reversed_labels, lambda label, i: F.when(label == "*", i)),
        lambda i: i.isNotNull(),
    )
    return targets.select(
        F.size(F.split("host", r"\.")).alias("labels"),
        stars.alias("stars"),
    )


RULE_ITEM = "struct<pos:int,from_pattern:string,to_java:string,error:string,literal:string>"
EXCLUSION_ITEM = "struct<pos:int,pattern:string,literal:string>"


def _element_lists(corpus: Corpus) -> DataFrame:
    """``ruleset_id, list, targets, rules, exclusions, bytes, platform``: the elements of a rule set in ordered lists of at
    most ``CHUNK`` each, gathered by one aggregation. A pattern's necessary literal stands beside it. The platform is
    in the first list, which every rule set has."""
    rules = corpus.rules
    if "error" not in rules.columns:
        rules = rules.withColumn("error", F.lit(None).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)

    def part(elements: DataFrame, bytes_: Column, **own: Column) -> DataFrame:
        kinds = {"target": "struct<pos:int,host:string>", "rule": RULE_ITEM, "exclusion": EXCLUSION_ITEM, "platform": "string"}
        return elements.select(
            "ruleset_id",
            F.floor(F.col("pos") / CHUNK).alias("list"),
            bytes_.alias("bytes"),
            *[own.get(name, none(kind)).cast(kind).alias(name) for name, kind in kinds.items()],
        )

    size = lambda *texts: F.octet_length(F.concat("ruleset_id", *texts)) + 64
    pos = F.col("pos").cast("int").alias("pos")
    literal = lambda name: necessary_literal(F.col(name)).alias("literal")
    rows = (
        part(corpus.targets, size("host"), target=F.struct(pos, "host"))
        .unionByName(
            part(
                rules,
                size("from_pattern", F.coalesce("to_java", F.lit(""))),
                rule=F.struct(pos, "from_pattern", "to_java", "error", literal("from_pattern")),
            )
        )
        .unionByName(part(corpus.exclusions, size("pattern"), exclusion=F.struct(pos, "pattern", literal("pattern"))))
        .unionByName(
            part(
                corpus.rulesets.withColumn("pos", F.lit(0)),
                size(F.coalesce("platform", F.lit(""))),
                platform=F.col("platform"),
            )
        )
    )
    ordered = lambda name: F.sort_array(F.collect_list(name))
    return rows.groupBy("ruleset_id", "list").agg(
        F.transform(ordered("target"), lambda t: t["host"]).alias("targets"),
        ordered("rule").alias("rules"),
        ordered("exclusion").alias("exclusions"),
        F.sum("bytes").alias("bytes"),
        F.min("platform").alias("platform"),
    )


def _by_target(lists: DataFrame) -> DataFrame:
    """One row per target text with the lists of all its rule sets, by id."""
    ruleset = F.struct("ruleset_id", F.col("exclusions").alias("_exclusions"), F.col("rules").alias("_rules"))
    spread = lists.select(F.explode("targets").alias("target_host"), ruleset.alias("ruleset"))
    return spread.groupBy("target_host").agg(F.sort_array(F.collect_list("ruleset")).alias("rulesets"))


def build_rule_index(
    corpus: Corpus, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS
) -> RuleIndex:
    """The lists, stored; their write measures them, and one aggregation finds the shapes of the targets."""
    lists, found = stored(
        _element_lists(corpus),
        last=F.max("list"),
        listed=F.sum("bytes"),
        repeated=F.sum(F.col("bytes") * F.size("targets")),
    )
    targets = lists.select("ruleset_id", F.explode("targets").alias("host"))
    shapes = _target_shapes(targets).distinct().limit(MAX_SHAPES + 1).collect()
    few = len(shapes) <= MAX_SHAPES
    shapes = tuple(sorted((Shape(r["labels"], tuple(r["stars"])) for r in shapes), key=lambda x: (x.labels, x.stars)))
    one_list = found["last"] == 0
    fits = few and found["listed"] <= broadcast_bytes
    lookups = sum(1 for shape in shapes if shape.stars) + 1
    shuffle_free = fits and one_list and lookups <= MAX_LOOKUPS and found["repeated"] <= broadcast_bytes
    by_target = cut_lineage(_by_target(lists)) if shuffle_free else None
    return _index(lists, targets, shapes if few else None, fits, one_list, by_target, hot_rows)


def _index(lists, targets, shapes, fits: bool, one_list: bool, by_target, hot_rows: int) -> RuleIndex:
    items = lambda name: lists.filter(F.size(name) > 0).select("ruleset_id", F.col(name).alias("items"))
    return RuleIndex(
        targets=targets,
        rules=items("rules"),
        exclusions=items("exclusions"),
        platforms=lists.filter("list = 0").select("ruleset_id", "platform"),
        shapes=shapes,
        fits=fits,
        one_list=one_list,
        by_target=by_target,
        hot_rows=hot_rows,
    )


def literal_keys(host: Column, shapes: tuple[Shape, ...]) -> list[Column]:
    """The target texts that would cover the host, NULL where none of a shape."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    keys = [_literal_key(labels, size, shape) for shape in shapes if shape.stars]
    depths = [shape.labels for shape in shapes if not shape.stars]
    if depths:
        keys.append(F.when(size.isin(depths), host))
    return keys


def _literal_key(labels: Column, size: Column, shape: Shape) -> Column:
    """The target text of this shape that would cover the host, else NULL."""
    applies = (size >= shape.labels) if shape.open else (size == shape.labels)
    parts = [
        F.lit("*") if i in shape.stars else F.try_element_at(labels, F.lit(-1 - i))
        for i in reversed(range(shape.labels))
    ]
    return F.when(applies, F.concat_ws(".", *parts))


def host_target_keys(hosts: DataFrame, index: RuleIndex) -> DataFrame:
    """One row per host row and target text that would cover it, as ``target_host``.

    A target covers a host label by label, a wildcard standing for one label;
    a leftmost wildcard of a target with three or more labels stands for one or
    more. Written as keys, so an equality join finds the targets.
    """
    if index.shapes is not None:
        keys = literal_keys(F.col("host"), index.shapes)
        keyed = hosts.withColumn(
            "target_host", F.explode(F.array(*keys) if keys else F.array().cast("array<string>"))
        )
        return keyed.filter(F.col("target_host").isNotNull())
    return _walked_keys(hosts, index)


def _walked_keys(hosts: DataFrame, index: RuleIndex) -> DataFrame:
    """The keys of any number of shapes, by a walk over the labels from the top level.

    A step leads from a suffix of the targets to those one label longer that the host's
    label, or a wildcard, makes. Only suffixes that exist are followed, one equality join a step.
    """
    size = F.size(F.split("host", r"\."))
    suffixes = cut_lineage(
        index.targets.select("host", F.explode(F.sequence(F.lit(1), size)).alias("_depth"))
        .select("_depth", F.expr("substring_index(host, '.', -_depth)").alias("_node"))
        .distinct()
    )
    deepest = suffixes.agg(F.max("_depth")).first()[0] or 0
    front = hosts.withColumns({"_size": size, "_node": F.lit("")})
    none = hosts.select("*", F.lit(None).cast("string").alias("target_host")).limit(0)
    found = [none]
    for depth in range(1, deepest + 1):
        labels = F.array_distinct(F.array(F.element_at(F.split("host", r"\."), -depth), F.lit("*")))
        longer = F.transform(
            labels, lambda x: F.when(F.col("_node") == "", x).otherwise(F.concat(x, F.lit("."), "_node"))
        )
        front = front.filter(F.col("_size") >= depth).withColumn("_node", F.explode(longer))
        known = suffixes.filter(F.col("_depth") == depth).select("_node")
        front = cut_lineage(keyed_join(front, known, "_node", "left_semi", hot_rows=index.hot_rows))
        open_ended = F.col("_node").startswith("*.") if depth >= 3 else F.lit(False)
        ended = front.filter((F.col("_size") == depth) | open_ended)
        found.append(ended.select(*hosts.columns, F.col("_node").alias("target_host")))
    return reduce(DataFrame.unionByName, found)


def first_rule_hit(url: Column, items: Column) -> Column:
    """First rule of the list that changes the URL; later ones are not tried. A pattern whose necessary
    literal the URL does not hold is not run."""

    def attempt(rule: Column) -> Column:
        changed = F.transform(
            F.array(F.regexp_replace(url, rule["from_pattern"], rule["to_java"])),
            lambda new: F.when(
                new != url,
                F.struct(
                    rule["pos"].alias("pos"),
                    new.alias("new_url"),
                    F.lit(None).cast("string").alias("error"),
                ),
            ),
        )
        failed = F.struct(
            rule["pos"].alias("pos"),
            F.lit(None).cast("string").alias("new_url"),
            rule["error"].alias("error"),
        )
        return F.when(rule["error"].isNotNull(), failed).when(F.contains(url, rule["literal"]), changed[0])

    return F.aggregate(
        items, F.lit(None).cast(RULE_HIT), lambda hit, rule: F.coalesce(hit, attempt(rule))
    )


def first_match(url: Column, items: Column, pattern: str) -> Column:
    """``pos`` of the first element whose pattern is found in the URL. A pattern whose necessary literal the
    URL does not hold is not run."""
    return F.aggregate(
        items,
        F.lit(None).cast("int"),
        lambda hit, item: F.coalesce(
            hit, F.when(F.contains(url, item["literal"]) & F.rlike(url, item[pattern]), item["pos"])
        ),
    )


def with_first(
    pairs: DataFrame, lists: DataFrame, index: RuleIndex, name: str, hit: Column
) -> DataFrame:
    """``pairs`` plus the column ``name``: the least ``hit`` over the lists of
    the row's rule set, NULL without one. ``hit`` reads the column ``items``.

    Where some rule set has several lists the rows are grouped again; equal rows are
    counted there and come out as often as they came in.
    """
    joined = keyed_join(
        pairs,
        lists.select("ruleset_id", "items"),
        "ruleset_id",
        "left",
        fits=index.fits,
        hot_rows=index.hot_rows,
    ).select(*pairs.columns, hit.alias(name))
    if index.one_list:
        return joined
    copies = pairs.select("*", F.lit(None).cast(joined.schema[name].dataType).alias(name), F.lit(1).alias("_copies"))
    return (
        copies.unionByName(joined.withColumn("_copies", F.lit(0)))
        .groupBy(*pairs.columns)
        .agg(F.min(name).alias(name), F.sum("_copies").cast("int").alias("_copies"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .drop("_copies", "_copy")
    )
