"""The registered queries: each operator over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulemesh.functions.errors import error_category as category_of
from rulemesh.functions.patterns import java_template
from rulemesh.functions.urls import (
    absolutize,
    accepted_scheme,
    host_key,
    idn_ascii,
    is_redirect,
    last_location,
    scheme_error,
    status_class,
)
from rulemesh.operators import certs as cert_ops
from rulemesh.operators import compare, coverage, overlap, redirects, report, rewrite
from rulemesh.operators import corpus as corpus_ops
from rulemesh.operators.index import build_rule_index
from rulemesh.operators.joins import stored
from rulemesh.plans import check, derived
from rulemesh.session import cut_lineage, shared_folder, ship_package
from rulemesh.sources import captures as captures_source
from rulemesh.sources import sinks
from rulemesh.sources.certs import load_certs, with_digest
from rulemesh.sources.lists import parse_skiplist, parse_url_list
from rulemesh.sources.rulesets import load_rulesets as load_rulesets_files
from rulemesh.sources.rulesets import malformed_rulesets, parse_rulesets, wellformed_rulesets

col = F.col


_table = derived.table


# --- sources ---------------------------------------------------------------


def load_rulesets(spark, folder):
    parsed = parse_rulesets(derived.ruleset_files(spark, folder))
    rulesets = corpus_ops.normalise(wellformed_rulesets(parsed)).rulesets
    return rulesets.select("ruleset_id", "name", "platform", "default_off", "file_sha256")


def malformed_files(spark, folder):
    parsed = parse_rulesets(derived.ruleset_files(spark, folder))
    return malformed_rulesets(parsed).select("ruleset_id", "file_sha256")


def normalise(spark, folder):
    parsed = parse_rulesets(derived.ruleset_files(spark, folder))
    tables = corpus_ops.normalise(wellformed_rulesets(parsed))
    none = F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, first: str, second=none) -> DataFrame:
        return df.select(
            "ruleset_id",
            F.lit(kind).alias("kind"),
            "pos",
            col(first).alias("value"),
            second.alias("template"),
        )

    return (
        part(tables.targets, "target", "host")
        .unionByName(part(tables.rules, "rule", "from_pattern", col("to_template")))
        .unionByName(part(tables.exclusions, "exclusion", "pattern"))
        .unionByName(part(tables.tests, "test", "url"))
    )


def skip_known(spark, folder):
    files = derived.ruleset_files(spark, folder)
    lines = files.filter(F.length("ruleset_id") % 3 == 0).select(
        F.concat(F.upper("file_sha256"), F.lit(" "), "ruleset_id").alias("value")
    )
    kept = corpus_ops.skip_known(files, parse_skiplist(lines))
    return kept.select("ruleset_id", "file_sha256")


def active_rulesets(spark, folder):
    tables = derived.corpus(spark, folder, include_default_off=True)
    active = corpus_ops.active_rulesets(tables.rulesets)
    return active.select("ruleset_id", "name", "platform")


def url_list(spark, folder):
    lines = derived.pages(spark, folder).select(F.concat("url", F.lit(" \t ")).alias("value"))
    return parse_url_list(lines.unionByName(lines.select(F.rtrim("value").alias("value"))))


def json_report(spark, folder):
    tables, index, pairs = _run(spark, folder)
    applied = cut_lineage(coverage.what_applies(corpus_ops.derive_tests(tables), index))
    problems = coverage.coverage_problems(tables, applied)
    return report.json_document(compare.verdict(pairs), problems)


# --- projections and predicates --------------------------------------------


def accepted_scheme_query(spark, folder):
    page = col("page_id") % 5
    url = (
        F.when(page == 0, F.regexp_replace("url", "^https?:", "ftp:"))
        .when(page == 1, F.regexp_replace("url", "^https?:", "HTTPS:"))
        .when(page == 2, F.regexp_replace("url", "^https?://", ""))
        .otherwise(col("url"))
    )
    shown = derived.pages(spark, folder).select("page_id", url.alias("url"))
    return shown.select(
        "page_id",
        "url",
        accepted_scheme(col("url")).alias("accepted"),
        scheme_error(col("url")).alias("error"),
    )


def url_host_key(spark, folder):
    page = col("page_id") % 4
    url = (
        F.when(page == 0, F.regexp_replace("url", "^(https?://[^/]+)", "$1:8443"))
        .when(page == 1, F.regexp_replace("url", "^(https?)://", "$1://User@"))
        .otherwise(col("url"))
    )
    shown = derived.pages(spark, folder).select("page_id", url.alias("url"))
    return shown.select("page_id", host_key(col("url")).alias("host"))


def idn_ascii_query(spark, folder):
    found = F.regexp_extract_all("text", F.lit(r"(\S*[^\x00-\x7F]\S*)"), F.lit(1))
    words = _table(spark, folder, "documents").select(F.explode(found).alias("word")).distinct()
    words = words.select(F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]", "").alias("word"))
    hosts = words.filter("word <> ''").select(
        F.concat("word", F.lit(".example.org")).alias("host")
    )
    return hosts.distinct().select("host", idn_ascii(col("host")).alias("ascii_host"))


def derived_tests(spark, folder):
    tests = corpus_ops.derive_tests(derived.corpus(spark, folder))
    return tests.select("ruleset_id", col("pos").cast("bigint").alias("pos"), "url", "origin")


def testable_tests(spark, folder):
    tables = derived.corpus(spark, folder)
    tests = rewrite.not_excluded(corpus_ops.derive_tests(tables), build_rule_index(tables))
    return tests.groupBy("ruleset_id").agg(F.count(F.lit(1)).alias("tests"))


def to_java(spark, folder):
    page = col("page_id")
    template = F.concat(
        F.lit("https://$1"), page.cast("string"), F.lit(".$2/$b\\"), page.cast("string"), F.lit("$$1")
    )
    return derived.pages(spark, folder).select(
        "page_id", template.alias("template"), java_template(template).alias("to_java")
    )


def validate_rules(spark, folder):
    tables = derived.corpus(spark, folder)

    def rule_of(pattern, template):
        return F.struct(pattern.alias("from_pattern"), template.alias("to_template"))

    variants = tables.rules.select(
        "ruleset_id",
        F.posexplode(
            F.array(
                rule_of(col("from_pattern"), col("to_template")),
                rule_of(F.concat("from_pattern", F.lit("(")), col("to_template")),
                rule_of(col("from_pattern"), F.concat("to_template", F.lit("$9"))),
            )
        ).alias("variant", "rule"),
        "pos",
    ).select(
        "ruleset_id",
        (col("pos") * 3 + col("variant")).alias("pos"),
        col("rule.from_pattern").alias("from_pattern"),
        col("rule.to_template").alias("to_template"),
        java_template(col("rule.to_template")).alias("to_java"),
    )
    widened = corpus_ops.Corpus(
        tables.rulesets, tables.targets, variants, tables.exclusions, tables.tests
    )
    return corpus_ops.validate_rules(widened).select(
        "ruleset_id", "kind", "pos", "pattern", "valid", "error"
    )


def status_class_query(spark, folder):
    shown = derived.captures(spark, folder)
    return shown.select(
        "url",
        "http_code",
        status_class(col("http_code")).alias("class"),
        is_redirect(col("http_code")).alias("redirect"),
    )


def last_location_query(spark, folder):
    shown = derived.captures(spark, folder)
    doubled = F.concat(F.replace(col("headers"), F.lit("\r\n\r\n"), F.lit("\r\nlocation: /again\r\n\r\n")))
    return shown.select(
        "url",
        last_location(col("headers")).alias("location"),
        last_location(doubled).alias("last_of_two"),
    )


def absolutize_query(spark, folder):
    hrefs = derived.pages(spark, folder).select(
        "page_id",
        "url",
        F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("nr", "word"),
    )
    form = (col("page_id") + col("nr")) % 5
    ref = (
        F.when(form == 0, F.concat(F.lit("/"), "word"))
        .when(form == 1, F.concat(F.lit("x/../"), "word"))
        .when(form == 2, F.concat(F.lit("../../../"), "word"))
        .when(form == 3, F.concat(F.lit("//other.example.net/"), "word"))
        .otherwise(F.concat(F.lit("http://abs.example.net/../"), "word"))
    )
    return hrefs.select("page_id", "nr", ref.alias("ref"), absolutize(col("url"), ref).alias("absolute_url"))


def pem_to_der_sha256(spark, folder):
    return with_digest(derived.certs(spark, folder)).select("path", "der_sha256", "error")


# --- joins -----------------------------------------------------------------


def match_targets(spark, folder):
    index = build_rule_index(derived.corpus(spark, folder))
    hosts = derived.with_site(derived.pages(spark, folder).select("url"))
    return rewrite.match_targets(hosts, index)


def target_hierarchy(spark, folder):
    return rewrite.target_hierarchy(derived.corpus(spark, folder).targets)


def _site_pairs(spark, folder) -> DataFrame:
    shown = derived.with_site(derived.pages(spark, folder).select("page_id", "url"))
    return shown.select("page_id", F.concat("site", F.lit(".xml")).alias("ruleset_id"), "url")


def not_excluded(spark, folder):
    index = build_rule_index(derived.corpus(spark, folder))
    return rewrite.not_excluded(_site_pairs(spark, folder), index)


def apply_ruleset(spark, folder):
    index = build_rule_index(derived.corpus(spark, folder))
    applied = rewrite.apply_ruleset(_site_pairs(spark, folder), index)
    return applied.select("page_id", "ruleset_id", "url", "new_url", "rule_pos")


def transform_pages(spark, folder):
    index = build_rule_index(derived.corpus(spark, folder))
    urls = derived.pages(spark, folder).select("page_id", "url")
    rewritten = rewrite.transform_urls(urls, index)
    return rewritten.select("page_id", "url", "new_url", "ruleset_id", "rule_pos", "ambiguous")


def what_applies(spark, folder):
    tables = derived.corpus(spark, folder)
    applied = coverage.what_applies(corpus_ops.derive_tests(tables), build_rule_index(tables))
    return applied.select(
        "ruleset_id", col("pos").cast("bigint").alias("pos"), "url", "origin", "kind", "element_pos"
    )


def resolve_platform(spark, folder):
    tables = derived.corpus(spark, folder, include_default_off=True)
    odd = tables.rulesets.select(
        "ruleset_id",
        F.when(F.length("ruleset_id") % 4 == 0, F.lit("unknown")).otherwise(col("platform")).alias("platform"),
    )
    return redirects.resolve_platform(odd, derived.platforms(spark))


def pair_captures(spark, folder):
    _, _, pairs = _run(spark, folder)
    return pairs.select(
        "ruleset_id", "pos", "origin", "url", "new_url", "plain_code", "plain_error", "new_code", "new_error"
    )


def resolve_redirects(spark, folder):
    tables = derived.corpus(spark, folder)
    heads, size = stored(redirects.capture_heads(derived.captures(spark, folder)))
    index = build_rule_index(tables)
    return redirects.resolve_redirects(
        heads.select(col("url").alias("start_url")), heads, index, index.platforms, size=size
    ).select("start_url", "final_url", "http_code", "hops", "error", "is_cycle", "platform")


def unique_certs(spark, folder):
    source = with_digest(derived.certs(spark, folder))
    nation = _table(spark, folder, "nation")
    exclude = nation.select(
        F.sha2(F.concat(F.lit("BUILDING:"), col("n_nationkey").cast("string")), 256).alias("der_sha256")
    )
    return cert_ops.unique_certs(source, exclude)


def trusted_closure(spark, folder):
    edges = derived.issues(spark, folder)
    roots = _table(spark, folder, "region").filter("r_name <> 'ASIA'").select(
        derived.node("region", col("r_regionkey")).alias("der_sha256")
    )
    held = {
        "nation": _table(spark, folder, "nation").select(col("n_nationkey").alias("key")),
        "supplier": _table(spark, folder, "supplier").select(col("s_suppkey").alias("key")),
        "order": _table(spark, folder, "orders").select(col("o_orderkey").alias("key")),
        "customer": _table(spark, folder, "customer")
        .filter("c_acctbal >= 0")
        .select(col("c_custkey").alias("key")),
    }
    parts = [df.select(derived.node(kind, col("key")).alias("der_sha256")) for kind, df in held.items()]
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    return cert_ops.trusted_closure(roots, candidates, edges)


# --- aggregations and verdicts ---------------------------------------------


def _applied(spark, folder):
    tables = derived.corpus(spark, folder)
    applied = coverage.what_applies(corpus_ops.derive_tests(tables), build_rule_index(tables))
    return tables, cut_lineage(applied)


def unmatched_tests(spark, folder):
    # Every page URL as a test of its own site's rule set, which knows plain and www names only.
    tables = derived.corpus(spark, folder)
    tests = _site_pairs(spark, folder).select(
        "ruleset_id", col("page_id").alias("pos"), "url", F.lit("explicit").alias("origin")
    )
    applied = coverage.what_applies(tests, build_rule_index(tables))
    return coverage.unmatched_tests(applied).select("ruleset_id", "url", "message")


def needed_tests(spark, folder):
    return coverage.needed_tests(derived.corpus(spark, folder)).select(
        "ruleset_id", "kind", "pos", "pattern", "needed"
    )


def element_coverage(spark, folder):
    tables, applied = _applied(spark, folder)
    return coverage.element_coverage(tables, applied).select(
        "ruleset_id", "kind", "pos", "pattern", "actual", "needed"
    )


def coverage_problems(spark, folder):
    tables, applied = _applied(spark, folder)
    return coverage.coverage_problems(tables, applied).select(
        "ruleset_id", "kind", "element", "pos", "actual", "needed", "url", "message"
    )


def coverage_gate(spark, folder):
    tables, applied = _applied(spark, folder)
    return coverage.coverage_gate(coverage.coverage_problems(tables, applied))


def _run(spark, folder):
    tables = derived.corpus(spark, folder)
    index = build_rule_index(tables)
    pairs = check.tested_pairs(tables, derived.captures(spark, folder), index)
    return tables, index, pairs


def load_captures(spark, folder):
    """The captures stored, read back and reduced to one head a URL."""
    path = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    derived.captures(spark, folder).write.parquet(path)
    heads = redirects.capture_heads(captures_source.load_captures(spark, path))
    return heads.select("url", "http_code", "location", "error")


def append_results(spark, folder):
    """The verdicts of two runs, appended to one table and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    _, _, pairs = _run(spark, folder)
    results = compare.verdict(pairs).select("result", "details", "fname", "url", "https_url")
    for _ in range(2):
        sinks.append_results(results, path)
    return spark.read.schema(results.schema).parquet(path)


def disabled_files(spark, folder):
    """The disabled rule sets written as files; their lines read back."""
    path = f"{shared_folder(spark)}/disabled-{uuid.uuid4().hex}"
    _, _, pairs = _run(spark, folder)
    failures = compare.verdict(pairs).filter("returned").select(col("fname").alias("ruleset_id"), "message")
    sinks.write_disabled(derived.ruleset_files(spark, folder), failures, path)
    return spark.read.schema("value string, ruleset_id string").text(path).select("ruleset_id", "value")


def _as_files(files: DataFrame, key: str, content: str) -> str:
    """Writes each row as a text file in a folder of its own."""
    path = f"{shared_folder(files.sparkSession)}/files-{uuid.uuid4().hex}"
    written = files.select(col(key).alias("file"), col(content).alias("value")).repartition("file")
    written.write.partitionBy("file").text(path)
    return path


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, "file=([^/]+)/", 1)


def ruleset_folder(spark, folder):
    """Rule sets read from the files of a folder, with what their parsed text says."""
    path = _as_files(derived.ruleset_files(spark, folder), "ruleset_id", "content")
    parsed = parse_rulesets(load_rulesets_files(spark, path, "part-*"))
    return wellformed_rulesets(parsed).select(
        _file_name(col("ruleset_id")).alias("ruleset_id"),
        "file_sha256",
        col("ruleset._name").alias("name"),
        F.size("ruleset.rule").alias("n_rules"),
    )


def ruleset_file_list(spark, folder):
    """The same files named one by one, by a list with wildcards."""
    path = _as_files(derived.ruleset_files(spark, folder), "ruleset_id", "content")
    loaded = load_rulesets_files(spark, [f"{path}/file=*/part-*"])
    return loaded.select(_file_name(col("ruleset_id")).alias("ruleset_id"), "file_sha256", "content")


def load_certs_query(spark, folder):
    """A file of each distinct content among the customers' certificates, read back with the digest of
    what it holds; some are named symbolic links."""
    contents = derived.certs(spark, folder).groupBy("pem").agg(F.min(F.substring_index("path", "/", -1)).alias("path"))
    path = _as_files(contents, "path", "pem")
    linked = F.regexp_extract("path", "file=([0-9]+)", 1).cast("int") % 5 == 0
    links = load_certs(spark, path, pattern="part-*").select("path").filter(linked)
    return with_digest(load_certs(spark, path, links, "part-*")).select(
        _file_name(col("path")).alias("path"), "is_symlink", "der_sha256", "error"
    )


def verdict(spark, folder):
    _, _, pairs = _run(spark, folder)
    return compare.verdict(pairs).select("result", "details", "fname", "url", "https_url")


def error_category(spark, folder):
    shown = derived.captures(spark, folder).filter("error IS NOT NULL")
    classed = shown.select(category_of(col("short_error"), col("error")).alias("category"))
    return classed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def results_by_class(spark, folder):
    _, _, pairs = _run(spark, folder)
    return report.results_by_class(compare.verdict(pairs))


def run_summary(spark, folder):
    tables = derived.corpus(spark, folder)
    tests = rewrite.not_excluded(corpus_ops.derive_tests(tables), build_rule_index(tables))
    files = derived.corpus(spark, folder, include_default_off=True).rulesets
    return report.run_summary(files, tests).select("files", "pairs")


def markup_distance(spark, folder):
    ship_package(spark)
    return compare.markup_distance(
        derived.page_pairs(spark, folder), derived.pages(spark, folder).withColumnRenamed("html", "body")
    ).select("page_id", "distance")


def novelty_distance(spark, folder):
    return compare.novelty_distance(
        derived.page_pairs(spark, folder), derived.pages(spark, folder).withColumnRenamed("html", "body")
    ).select("page_id", "distance")


def copied_distance(spark, folder):
    ship_package(spark)
    return compare.copied_distance(
        derived.page_pairs(spark, folder), derived.pages(spark, folder).withColumnRenamed("html", "body")
    ).select("page_id", "distance")


def big_distance(spark, folder):
    shown = derived.captures(spark, folder)
    distances = compare.page_distance("bsdiff", derived.twin_pairs(spark, folder), shown)
    return compare.big_distance(distances).select("page_id", "distance")


def disable_failing(spark, folder):
    _, _, pairs = _run(spark, folder)
    failures = compare.verdict(pairs).filter("returned").select(
        col("fname").alias("ruleset_id"), "message"
    )
    return report.disable_failing(derived.ruleset_files(spark, folder), failures)


def corpus_lint(spark, folder):
    tables = derived.flawed_corpus(spark, folder)
    return coverage.corpus_lint(tables, build_rule_index(tables))


def overlapping_targets(spark, folder):
    return overlap.overlapping_targets(derived.crossing_targets(spark, folder))


def shared_wildcards(spark, folder):
    return overlap.shared_wildcards(derived.crossing_targets(spark, folder))


QUERIES = {
    "load_rulesets": load_rulesets,
    "malformed_files": malformed_files,
    "normalise": normalise,
    "skip_known": skip_known,
    "active_rulesets": active_rulesets,
    "url_list": url_list,
    "json_report": json_report,
    "accepted_scheme": accepted_scheme_query,
    "url_host_key": url_host_key,
    "idn_ascii": idn_ascii_query,
    "derived_tests": derived_tests,
    "testable_tests": testable_tests,
    "to_java": to_java,
    "validate_rules": validate_rules,
    "status_class": status_class_query,
    "last_location": last_location_query,
    "absolutize": absolutize_query,
    "pem_to_der_sha256": pem_to_der_sha256,
    "match_targets": match_targets,
    "target_hierarchy": target_hierarchy,
    "not_excluded": not_excluded,
    "apply_ruleset": apply_ruleset,
    "transform_urls": transform_pages,
    "what_applies": what_applies,
    "resolve_platform": resolve_platform,
    "pair_captures": pair_captures,
    "resolve_redirects": resolve_redirects,
    "unique_certs": unique_certs,
    "trusted_closure": trusted_closure,
    "unmatched_tests": unmatched_tests,
    "needed_tests": needed_tests,
    "element_coverage": element_coverage,
    "coverage_problems": coverage_problems,
    "coverage_gate": coverage_gate,
    "verdict": verdict,
    "load_captures": load_captures,
    "append_results": append_results,
    "error_category": error_category,
    "results_by_class": results_by_class,
    "run_summary": run_summary,
    "markup_distance": markup_distance,
    "novelty_distance": novelty_distance,
    "copied_distance": copied_distance,
    "big_distance": big_distance,
    "disable_failing": disable_failing,
    "disabled_files": disabled_files,
    "ruleset_folder": ruleset_folder,
    "ruleset_file_list": ruleset_file_list,
    "load_certs": load_certs_query,
    "corpus_lint": corpus_lint,
    "overlapping_targets": overlapping_targets,
    "shared_wildcards": shared_wildcards,
}
