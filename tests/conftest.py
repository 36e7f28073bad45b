import pytest

from rulemesh.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_corpus(spark):
    """Corpus from a dict: ruleset_id -> targets, rules, exclusions, tests."""
    from pyspark.sql import functions as F

    from rulemesh.functions.patterns import java_template
    from rulemesh.operators.corpus import Corpus

    def make(rulesets: dict, platforms: dict | None = None):
        platforms = platforms or {}
        sets, targets, rules, exclusions, tests = [], [], [], [], []
        for name, parts in rulesets.items():
            sets.append((name, name, platforms.get(name, "default"), None, "0" * 64))
            targets += [(name, i, h) for i, h in enumerate(parts.get("targets", []))]
            rules += [(name, i, f, t) for i, (f, t) in enumerate(parts.get("rules", []))]
            exclusions += [(name, i, p) for i, p in enumerate(parts.get("exclusions", []))]
            tests += [(name, i, u, "explicit") for i, u in enumerate(parts.get("tests", []))]
        frame = spark.createDataFrame
        return Corpus(
            frame(sets, "ruleset_id string, name string, platform string, default_off string, file_sha256 string"),
            frame(targets, "ruleset_id string, pos int, host string"),
            frame(rules, "ruleset_id string, pos int, from_pattern string, to_template string").withColumn(
                "to_java", java_template(F.col("to_template"))
            ),
            frame(exclusions, "ruleset_id string, pos int, pattern string"),
            frame(tests, "ruleset_id string, pos int, url string, origin string"),
        )

    return make
