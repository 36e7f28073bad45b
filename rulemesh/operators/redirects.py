"""Redirect chains over a table of captured responses."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulemesh.functions.errors import error_category
from rulemesh.functions.urls import absolutize, idn_url, is_redirect, last_location, scheme, scheme_error
from rulemesh.operators.index import RuleIndex
from rulemesh.operators.joins import BROADCAST_BYTES, HOT_ROWS, fits_broadcast, keyed_join, stored
from rulemesh.operators.rewrite import transform_urls
from rulemesh.session import cut_lineage

DEFAULT_PLATFORM = "default"
TOO_MANY = "Too many redirects"


def resolve_platform(
    rulesets: DataFrame, platforms: DataFrame, static_ca_set: str | None = None
) -> DataFrame:
    """Adds ``ca_set``: that of the row's platform, or of ``default`` if unknown.

    ``static_ca_set`` overrides them all. A platform table without a
    ``default`` row is refused.
    """
    if static_ca_set is not None:
        return rulesets.withColumn("ca_set", F.lit(static_ca_set))
    fallback = platforms.filter(F.col("platform") == DEFAULT_PLATFORM).select("ca_set").first()
    if fallback is None:
        raise ValueError("the platform 'default' is missing")
    named = platforms.select("platform", "ca_set")
    return keyed_join(
        rulesets, named, "platform", "left", fits=fits_broadcast(named)
    ).select(*rulesets.columns, F.coalesce("ca_set", F.lit(fallback["ca_set"])).alias("ca_set"))


def capture_heads(captures: DataFrame) -> DataFrame:
    """``url, http_code, location, error`` of each captured URL, without its body.

    The input of :func:`resolve_redirects`; a caller that resolves more than
    once does well to store it. URLs are compared in punycode form. Of several captures of a
    URL the first by (failed, status, Location, error text) counts, so one without an error
    if there is one.
    """
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    location = last_location(F.col("headers"))
    followed = is_redirect(F.col("http_code"))
    error = (
        F.when(failed, error_category(F.col("short_error"), F.col("error")))
        .when(F.coalesce("http_code", F.lit(0)) == 0, F.lit("fetch failed"))
        .when(followed & location.isNull(), F.lit("missing Location"))
    )
    head = F.struct(
        error.isNotNull().alias("failed"),
        F.col("http_code").cast("int").alias("http_code"),
        F.when(followed, location).alias("location"),
        error.alias("error"),
    )
    heads = captures.select(idn_url(F.col("url")).alias("url"), head.alias("_head"))
    first = heads.groupBy("url").agg(F.min("_head").alias("_head"))
    return first.select("url", "_head.http_code", "_head.location", "_head.error")


def _fault(rules_given: bool, mark: str = "") -> Column:
    """Why a capture cannot be followed or used; with rules, a Location of an unknown scheme is such a fault.
    ``mark`` stands before the names of the capture's columns."""
    error, location = F.col(f"{mark}error"), F.col(f"{mark}location")
    if not rules_given:
        return error
    absolute = error.isNull() & location.isNotNull() & (scheme(location) != "")
    return F.coalesce(error, F.when(absolute, scheme_error(location)))


def _kind(rules_given: bool, mark: str = "") -> Column:
    """final, error or redirect."""
    return (
        F.when(_fault(rules_given, mark).isNotNull(), F.lit("error"))
        .when(F.col(f"{mark}location").isNotNull(), F.lit("redirect"))
        .otherwise(F.lit("final"))
    )


def _nodes(heads: DataFrame, rules_given: bool) -> DataFrame:
    """``url, kind, http_code, error``."""
    return heads.select("url", _kind(rules_given).alias("kind"), "http_code", _fault(rules_given).alias("error"))


def _redirect_edges(
    heads: DataFrame, rows: int, index: RuleIndex | None, rulesets: DataFrame | None
) -> DataFrame:
    """``current, next_url, next_platform, fault`` of each redirect among the ``rows`` heads.

    Every Location is resolved and rewritten once here, not once per hop. Where the
    rules fail on it, ``fault`` says so and ``next_url`` is the Location itself.
    """
    resolved = absolutize(F.col("url"), F.col("location"))
    moved = heads.filter(_fault(index is not None).isNull() & F.col("location").isNotNull())
    no_platform = F.lit(None).cast("string").alias("next_platform")
    no_fault = F.lit(None).cast("string").alias("fault")
    if index is None:
        return moved.select(
            F.col("url").alias("current"), idn_url(resolved).alias("next_url"), no_platform, no_fault
        )
    located = moved.select(F.col("url").alias("current"), resolved.alias("url"))
    if index.by_target is None:  # read several times then
        located = cut_lineage(located)
    rewritten = transform_urls(located, index)
    target = idn_url(F.coalesce("new_url", "url")).alias("next_url")
    fault = F.col("error").alias("fault")
    if rulesets is None:
        return rewritten.select("current", target, no_platform, fault)
    # At most as many rows as the index has rule sets.
    named = rulesets.select("ruleset_id", F.col("platform").alias("next_platform"))
    return keyed_join(
        rewritten, named, "ruleset_id", "left", fits=index.fits, rows=rows, hot_rows=index.hot_rows
    ).select("current", target, "next_platform", fault)


@dataclass(frozen=True)
class Side:
    """Starts that follow the same rules, or none."""

    starts: DataFrame  # start_url and, optionally, platform
    index: RuleIndex | None = None
    rulesets: DataFrame | None = None
    static_platform: str | None = None


def _begun(side: Side, mark: int) -> DataFrame:
    platform = F.col("platform") if "platform" in side.starts.columns else F.lit(DEFAULT_PLATFORM)
    if side.static_platform is not None:
        platform = F.lit(side.static_platform)
    current = idn_url(F.col("start_url"))
    return side.starts.select(
        F.lit(mark).alias("side"), "start_url", platform.alias("start_platform"), _node(mark, current).alias("node")
    ).distinct()


def _node(mark: int, url: Column) -> Column:
    """Name of a URL among those of one side."""
    return F.concat(F.lit(f"{mark} "), url)


def _url(node: Column) -> Column:
    return F.substr(node, F.locate(" ", node) + 1)


def _first_jumps(side: Side, mark: int, heads: DataFrame, found: dict, hot_rows: int) -> DataFrame:
    """Where one hop leads from each redirect."""
    # The same rows for every side, so that they are sent once.
    behind = heads.select(
        F.col("url").alias("next_url"),
        *[F.col(c).alias(f"next_{c}") for c in ("http_code", "location", "error")],
        F.lit(True).alias("next_known"),
    )
    rules_given = side.index is not None
    edges = keyed_join(
        _redirect_edges(heads, found["rows"], side.index, side.rulesets),
        behind,
        "next_url",
        "left",
        fits=found["bytes"] <= BROADCAST_BYTES,
        rows=found["rows"],
        hot_rows=hot_rows,
    )
    faulty = F.col("fault").isNotNull()
    missing = F.col("next_known").isNull()
    loop = F.coalesce(F.col("next_url") == F.col("current"), F.lit(False))
    ended = F.when(faulty | missing, F.lit("error")).otherwise(_kind(rules_given, "next_"))
    node = _node(mark, F.col("current"))
    target = F.coalesce(_node(mark, F.col("next_url")), node)
    kind = F.when(loop, F.lit("error")).otherwise(ended)
    return edges.select(
        node.alias("node"),
        target.alias("target"),
        kind.alias("kind"),
        F.when(~faulty & ~loop, F.col("next_http_code")).alias("http_code"),
        F.when(loop, F.lit(TOO_MANY))
        .when(faulty, F.col("fault"))
        .when(missing, F.lit("no capture"))
        .otherwise(_fault(rules_given, "next_"))
        .alias("error"),
        F.lit(1).alias("hops"),
        loop.alias("is_cycle"),
        F.col("next_platform").alias("platform"),
        # Only what may meet itself again keeps its way: redirects under way, cycles and the
        # Locations that rules fail on.
        F.when(
            faulty | loop | (kind == "redirect"),
            F.array(F.struct(target.alias("node"), F.col("next_platform").alias("platform"))),
        ).alias("path"),
    )


def _doubled(under_way: DataFrame, jumps: DataFrame, fits: bool, rows: int, hot_rows: int) -> DataFrame:
    """The jumps ``under_way`` followed by those of their targets.

    A node met twice on the joined way ends it there, as a cycle. The first part has no
    node twice, so only the second is searched.
    """
    onward = jumps.select(
        F.col("node").alias("target"), *[F.col(c).alias(f"b_{c}") for c in jumps.columns if c != "node"]
    )
    joined = keyed_join(under_way, onward, "target", "left", fits=fits, rows=rows, hot_rows=hot_rows)
    names = lambda path: F.transform(path, lambda x: x["node"])
    passed = F.concat(F.array("node"), names(F.col("path")))
    later = names(F.col("b_path"))
    repeats = F.filter(
        F.transform(
            F.col("b_path"),
            lambda x, i: F.when(F.array_contains(F.concat(passed, F.slice(later, F.lit(1), i)), x["node"]), i + 1),
        ),
        lambda i: i.isNotNull(),
    )
    lost = F.col("b_target").isNull()
    looked = joined.withColumn("_at", F.array_min(repeats))
    again = F.col("_at").isNotNull()
    whole = F.concat("path", "b_path")
    steps = F.col("hops") + F.when(lost, F.lit(1)).otherwise(F.coalesce("_at", "b_hops"))
    way = F.slice(whole, F.lit(1), steps)
    end = F.element_at(way, -1)
    return looked.select(
        "node",
        F.when(again, end["node"]).otherwise(F.coalesce("b_target", "target")).alias("target"),
        F.when(again | lost, F.lit("error")).otherwise(F.col("b_kind")).alias("kind"),
        F.when(~again, F.col("b_http_code")).alias("http_code"),
        F.when(again, F.lit(TOO_MANY))
        .when(lost, F.lit("Location cannot be resolved"))
        .otherwise(F.col("b_error"))
        .alias("error"),
        steps.alias("hops"),
        again.alias("is_cycle"),
        F.when(again, end["platform"]).otherwise(F.col("b_platform")).alias("platform"),
        F.when(again, way).otherwise(whole).alias("path"),
    )


def _ends(first: DataFrame, hops: int, hot_rows: int) -> tuple[DataFrame, int, int]:
    """The end of every redirect after at most ``hops`` hops, with its rows and bytes.

    Redirects form a graph in which each node has one successor. A table of jumps of
    2 ** k hops joined with itself gives that of 2 ** (k + 1); the tables of the binary
    digits of ``hops``, one after the other, give exactly ``hops``. Ended jumps are written once and
    only looked up from then on; those under way are doubled until there are none.
    """
    sized = lambda df: stored(
        df.withColumn("open", F.col("kind") == "redirect"), "open", open=F.count_if(F.col("kind") == "redirect")
    )
    parts, counts = [], []

    def add(df: DataFrame) -> None:
        table, found = sized(df)
        parts.append(table)
        counts.append(found)

    def jumps(level: int) -> tuple[DataFrame, bool]:
        ended = [p.filter(~F.col("open")) for p in parts[:level]]
        size = sum(c["bytes"] for c in counts[: level + 1])
        return reduce(DataFrame.unionByName, [*ended, parts[level]]).drop("open"), size <= BROADCAST_BYTES

    def double(level: int) -> None:
        table, fits = jumps(level)
        add(_doubled(parts[-1].filter("open").drop("open"), table, fits, counts[-1]["open"], hot_rows))

    add(first)
    level = 0
    while 2 << level <= hops and counts[-1]["open"]:
        double(level)
        level += 1
    rest = hops - (1 << level)
    for digit in reversed(range(level)):
        if rest >> digit & 1 and counts[-1]["open"]:
            double(digit)
    everything, _ = jumps(len(parts) - 1)
    out = everything.withColumn(
        "error", F.when(F.col("kind") == "redirect", F.lit(TOO_MANY)).otherwise(F.col("error"))
    )
    return out.drop("path"), sum(c["rows"] for c in counts), sum(c["bytes"] for c in counts)


def _resolved(
    sides: list[Side], heads: DataFrame, found: dict | None, max_depth: int, hot_rows: int
) -> DataFrame:
    """The results of all sides, with a column ``side``; their jumps are doubled together."""
    begun = reduce(DataFrame.unionByName, [_begun(side, mark) for mark, side in enumerate(sides)])
    none = F.lit(None).cast("string")
    if max_depth < 1:
        ended = begun.withColumns({
            "target": F.col("node"), "http_code": F.lit(None).cast("int"), "hops": F.lit(0),
            "error": F.lit(TOO_MANY), "is_cycle": F.lit(False), "platform": none,
        })
    else:
        if found is None:
            heads, found = stored(heads)

        def still(side: Side, mark: int) -> DataFrame:
            own = _nodes(heads, side.index is not None)
            moved = F.col("kind") == "redirect"
            return own.filter(~moved if max_depth > 1 else F.lit(True)).select(
                _node(mark, F.col("url")).alias("node"),
                _node(mark, F.col("url")).alias("target"),
                "kind",
                "http_code",
                F.when(moved, F.lit(TOO_MANY)).otherwise(F.col("error")).alias("error"),
                F.lit(0).alias("hops"),
                F.lit(False).alias("is_cycle"),
                none.alias("platform"),
            )

        parts = [still(side, mark) for mark, side in enumerate(sides)]
        size = found["bytes"] * len(sides)
        if max_depth > 1:
            first = [_first_jumps(side, mark, heads, found, hot_rows) for mark, side in enumerate(sides)]
            ends, _, own = _ends(reduce(DataFrame.unionByName, first), max_depth - 1, hot_rows)
            parts.append(ends)
            size += own
        # Distinct starts: no key is hot here.
        every = reduce(DataFrame.unionByName, parts)
        ended = keyed_join(begun, every, "node", "left", fits=size <= BROADCAST_BYTES, rows=0)
    unknown = F.col("target").isNull()
    error = F.when(unknown, F.lit("no capture")).otherwise(F.col("error"))
    static = reduce(
        lambda chain, side: chain.when(F.col("side") == side[0], F.lit(side[1].static_platform)),
        enumerate(sides),
        F.when(F.lit(False), none),
    )
    return ended.select(
        "side",
        "start_url",
        "start_platform",
        _url(F.coalesce("target", "node")).alias("final_url"),
        F.when(error.isNull(), F.col("http_code")).alias("http_code"),
        F.coalesce("hops", F.lit(0)).alias("hops"),
        error.alias("error"),
        F.coalesce("is_cycle", F.lit(False)).alias("is_cycle"),
        F.coalesce(static, "platform", "start_platform").alias("platform"),
    )


def resolve_redirects(
    starts: DataFrame,
    heads: DataFrame,
    index: RuleIndex | None = None,
    rulesets: DataFrame | None = None,
    max_depth: int = 10,
    static_platform: str | None = None,
    hot_rows: int = HOT_ROWS,
    size: dict | None = None,
) -> DataFrame:
    """Final response of each start URL.

    ``starts`` has ``start_url`` and, optionally, ``platform``; ``heads`` comes
    from :func:`capture_heads`, with their ``size`` if they were :func:`stored` already. With an
    ``index`` every Location is rewritten by the rules before it is followed,
    and ``rulesets`` gives the platform of the rule set that did it; otherwise
    the start's platform holds again. At most ``max_depth`` captures are read.

    Result: ``start_url, start_platform, final_url, http_code, hops, error,
    is_cycle, platform``.

    Where each redirect ends is found for all of them together, by doubling the number of
    hops, and the starts then join that table once. A URL seen before proves a cycle,
    which no depth resolves, so it ends there with the same error. Every distinct start
    gives one row; a redirect that cannot be followed ends it as an error.
    """
    side = Side(starts, index, rulesets, static_platform)
    return _resolved([side], heads, size, max_depth, hot_rows).drop("side")


def resolve_both(
    plain: Side, rewritten: Side, heads: DataFrame, max_depth: int = 10, hot_rows: int = HOT_ROWS
) -> tuple[tuple[DataFrame, dict], tuple[DataFrame, dict]]:
    """:func:`resolve_redirects` of two sides in one pass. Both results are stored; each comes
    with the rows and bytes of the two together."""
    table, found = stored(_resolved([plain, rewritten], heads, None, max_depth, hot_rows), "side")
    first, second = (table.filter(F.col("side") == mark).drop("side") for mark in (0, 1))
    return (first, found), (second, found)


def pair_captures(
    tests: DataFrame,
    plain: DataFrame,
    rewritten: DataFrame,
    hot_rows: int = HOT_ROWS,
    fits: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Plain and rewritten response beside each test.

    ``tests`` has ``url, new_url, platform``; the two others are results of
    :func:`resolve_redirects`, which ``fits`` says may be broadcast. ``rows`` is the number of tests where
    it is known. A failed plain fetch leaves its code NULL.
    """

    def start_of(url: str, platform: str):
        size = F.length(platform).cast("string")
        return F.concat(size, F.lit(":"), F.col(platform), F.col(url)).alias("_start")

    first = plain.select(
        F.col("start_url").alias("url"),
        F.col("http_code").alias("plain_code"),
        F.col("final_url").alias("plain_final_url"),
        F.col("error").alias("plain_error"),
    )
    second = rewritten.select(
        start_of("start_url", "start_platform"),
        F.col("http_code").alias("new_code"),
        F.col("final_url").alias("new_final_url"),
        F.col("error").alias("new_error"),
    )
    known = {"fits": fits, "rows": rows, "hot_rows": hot_rows}
    with_plain = keyed_join(tests, first, "url", "left", **known)
    started = with_plain.select("*", start_of("new_url", "platform"))
    return keyed_join(started, second, "_start", "left", **known).drop("_start")
