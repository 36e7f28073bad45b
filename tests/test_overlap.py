import random

import pytest

from rulemesh.operators.overlap import overlapping_targets, shared_wildcards


def covers(target, host):
    """A target covers a host label by label; a leftmost wildcard before two or more labels takes several."""
    mine, theirs = target.split(".")[::-1], host.split(".")[::-1]
    if len(mine) >= 3 and mine[-1] == "*" and len(theirs) > len(mine):
        theirs = theirs[: len(mine)]
    return len(mine) == len(theirs) and all(m in ("*", t) for m, t in zip(mine, theirs))


def plain_pairs(targets):
    """By every host of up to six labels over an alphabet with one label no target names."""
    hosts, level = [], [""]
    for _ in range(6):
        level = [f"{x}.{h}" if h else x for h in level for x in "abz"]
        hosts += level
    names = {t: {h for h in hosts if covers(t, h)} for t in targets}
    return {(s, t) for s in targets if "*" in s.split(".") for t in targets if s != t and names[s] & names[t]}


@pytest.mark.parametrize("seed, hot_rows", [(1, 3), (2, 2_000_000), (3, 2_000_000)])
def test_pairs_are_those_with_a_common_host(spark, seed, hot_rows):
    draw = random.Random(seed)
    texts = {".".join(draw.choices("ab*", k=draw.randrange(1, 6))) for _ in range(60)}
    rows = [(h,) for h in texts] + [(h,) for h in list(texts)[:5]] + [(None,)]
    found = overlapping_targets(spark.createDataFrame(rows, "host string"), hot_rows).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == plain_pairs(texts)


def test_known_overlaps(spark):
    rows = [("r", "a.*.org"), ("r", "*.b.org"), ("r", "a.b.org"), ("r", "x.org"), ("r", "*.c.b.org"), ("r", "z.*.org")]
    found = {tuple(r) for r in overlapping_targets(spark.createDataFrame(rows, "ruleset_id string, host string")).collect()}
    wide = {("*.b.org", t) for t in ("a.*.org", "z.*.org", "a.b.org", "*.c.b.org")}
    assert found == wide | {("a.*.org", "*.b.org"), ("a.*.org", "a.b.org"), ("z.*.org", "*.b.org"), ("*.c.b.org", "*.b.org")}


def test_only_texts_of_other_rule_sets_count(spark):
    rows = [("r", "*.b.org"), ("r", "a.b.org"), ("s", "c.b.org"), ("s", "a.b.org"), ("s", "c.b.org"), ("t", "*.b.org"), ("t", None)]
    found = shared_wildcards(spark.createDataFrame(rows, "ruleset_id string, host string")).collect()
    # a.b.org and c.b.org are claimed by s, too; both wildcard texts are equal and no overlap
    assert sorted(tuple(r) for r in found) == [("wildcard_overlap", "*.b.org", "r", 2), ("wildcard_overlap", "*.b.org", "t", 2)]
    own = spark.createDataFrame([("r", "*.b.org"), ("r", "a.b.org")], "ruleset_id string, host string")
    assert shared_wildcards(own).collect() == []


def test_no_targets_and_no_wildcards(spark):
    assert overlapping_targets(spark.createDataFrame([], "host string")).collect() == []
    assert overlapping_targets(spark.createDataFrame([("a.b",), ("a",)], "host string")).collect() == []
