"""Rule corpus, captures and certificates derived from the given tables.

The tables hold no rule sets, so every registered query derives its inputs from
``pages`` (or, for certificates, from the trade tables) by these rules; they
grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.functions.patterns import java_template
from rulemesh.functions.urls import host_key
from rulemesh.operators.corpus import Corpus

# Two rule sets beside those of the sites: a wildcard in the middle, and a
# leftmost one that covers about a third of all hosts.
EXTRA_RULESETS = """
  SELECT * FROM VALUES
    ('aa-www-com.xml', 'Any www com'),
    ('zz-any-org.xml', 'Any org') AS t(ruleset_id, name)"""
EXTRA_TARGETS = """
  SELECT * FROM VALUES
    ('aa-www-com.xml', 0, 'www.*.example.com'),
    ('zz-any-org.xml', 0, '*.example.org') AS t(ruleset_id, pos, host)"""
EXTRA_RULES = r"""
  SELECT * FROM VALUES
    ('aa-www-com.xml', 0, r'^http://www\.([^/.]+)\.example\.com/', 'https://www.$1.example.com/'),
    ('zz-any-org.xml', 0, r'^http://([^/.]+)\.example\.org/', 'https://$1.example.org/'),
    ('zz-any-org.xml', 1, r'^http://(m|blog)\.', 'https://$1.')
    AS t(ruleset_id, pos, from_pattern, to_template)"""


_schemas: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once an application."""
    path = f"{folder}/{name}.parquet"
    known = spark.sparkContext.applicationId, path
    if known not in _schemas:
        _schemas[known] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[known]).parquet(path)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def with_site(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``site``, its last three labels."""
    hosted = urls.withColumn("host", host_key(F.col("url")))
    return hosted.withColumn("site", F.substring_index("host", ".", -3))


def sites(spark: SparkSession, folder: str) -> DataFrame:
    return with_site(pages(spark, folder).select("url")).select("site").distinct()


def _escaped(site: Column) -> Column:
    return F.replace(site, F.lit("."), F.lit("\\."))


def site_pattern(site: Column) -> Column:
    return F.concat(F.lit(r"^http://(www\.)?"), _escaped(site), F.lit("/"))


def site_template(site: Column) -> Column:
    return F.concat(F.lit("https://www."), site, F.lit("/"))


def _ruleset_id(site: Column) -> Column:
    return F.concat(site, F.lit(".xml"))


def corpus(spark: SparkSession, folder: str, include_default_off: bool = False) -> Corpus:
    """One rule set per site and the two extra ones."""
    site = F.col("site")
    # Same as active_rulesets on the result, but before the tables are cut.
    kept = F.lit(True) if include_default_off else F.length(site) % 7 != 0
    by_site = sites(spark, folder).filter(kept)
    identity = _ruleset_id(site).alias("ruleset_id")

    extra = spark.sql(EXTRA_RULESETS)
    rulesets = by_site.select(
        identity,
        F.initcap(F.substring_index("site", ".", 1)).alias("name"),
        F.when(F.length(site) % 3 == 0, F.lit("cacert")).otherwise(F.lit("default")).alias("platform"),
        F.when(F.length(site) % 7 == 0, F.lit("breaks login")).alias("default_off"),
        F.sha2(ruleset_xml(site), 256).alias("file_sha256"),
    ).unionByName(
        extra.select(
            "ruleset_id",
            "name",
            F.lit("default").alias("platform"),
            F.lit(None).cast("string").alias("default_off"),
            F.sha2("name", 256).alias("file_sha256"),
        )
    )
    targets = by_site.select(
        identity,
        F.posexplode(F.array(site, F.concat(F.lit("*."), site))).alias("pos", "host"),
    ).unionByName(spark.sql(EXTRA_TARGETS))
    rules = (
        by_site.select(
            identity,
            F.posexplode(
                F.array(
                    F.struct(
                        site_pattern(site).alias("from_pattern"),
                        site_template(site).alias("to_template"),
                    ),
                    F.struct(
                        F.lit("^http:").alias("from_pattern"), F.lit("https:").alias("to_template")
                    ),
                )
            ).alias("pos", "rule"),
        )
        .select("ruleset_id", "pos", "rule.*")
        .unionByName(spark.sql(EXTRA_RULES))
        .withColumn("to_java", java_template(F.col("to_template")))
    )
    exclusions = by_site.select(
        identity, F.lit(0).alias("pos"), F.lit(r"\?utm_source=").alias("pattern")
    )
    explicit = (
        with_site(pages(spark, folder).select("page_id", "url"))
        .filter(F.col("url").startswith("http://") & kept)
        .select(
            identity,
            F.col("page_id").alias("pos"),
            "url",
            F.lit("explicit").alias("origin"),
        )
    )
    return Corpus(rulesets, targets, rules, exclusions, explicit)


def ruleset_xml(site: Column) -> Column:
    """Rule-set file of a site, with a comment and a commented-out rule."""
    text = F.format_string(
        "<!-- rules of %s -->\n<ruleset name=\"%s\"%s%s>\n"
        "  <target host=\"%s\" />\n  <target host=\"*.%s\" />\n"
        "  <!-- <rule from=\"^ftp:\" to=\"sftp:\" /> -->\n"
        "  <exclusion pattern=\"\\?utm_source=\" />\n"
        "  <test url=\"http://%s/about?a=1&amp;b=2\" />\n"
        "  <rule from=\"^http://(www\\.)?%s/\" to=\"https://www.%s/\" />\n"
        "  <rule from=\"^http:\" to=\"https:\" />\n</ruleset>\n",
        site,
        F.initcap(F.substring_index(site, ".", 1)),
        F.when(F.length(site) % 3 == 0, F.lit(' platform="cacert"')).otherwise(F.lit("")),
        F.when(F.length(site) % 7 == 0, F.lit(' default_off="breaks login"')).otherwise(F.lit("")),
        site,
        site,
        site,
        _escaped(site),
        site,
    )
    return text


def ruleset_files(spark: SparkSession, folder: str) -> DataFrame:
    """``ruleset_id, file_sha256, content`` of one file per site; the files of
    sites with a name length that 11 divides are cut short and so malformed."""
    site = F.col("site")
    whole = ruleset_xml(site)
    content = F.when(F.length(site) % 11 == 0, F.replace(whole, F.lit("</ruleset>"), F.lit(""))).otherwise(whole)
    return sites(spark, folder).select(
        _ruleset_id(site).alias("ruleset_id"),
        F.sha2(content, 256).alias("file_sha256"),
        content.alias("content"),
    )


ERROR_TEXTS = [
    "(6) Could not resolve host: example",
    "(28) Operation timed out after 15000 milliseconds",
    "(7) Failed to connect to example port 443: No route to host",
    "(35) gnutls_handshake() failed: Handshake failed",
    "(56) some other failure",
]


def _error_text(page_id: Column) -> Column:
    choices = F.array(*[F.lit(t) for t in ERROR_TEXTS])
    return F.element_at(choices, (F.pmod(page_id, F.lit(len(ERROR_TEXTS))) + 1).cast("int"))


def secure_twin(url: Column, host: Column, site: Column) -> Column:
    """Where a site's own rules send one of its http URLs."""
    bare = (host == site) | (host == F.concat(F.lit("www."), site))
    return F.when(
        bare, F.regexp_replace(url, r"^http://[^/]+/", F.concat(F.lit("https://www."), site, F.lit("/")))
    ).otherwise(F.regexp_replace(url, "^http:", "https:"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """One capture per page URL and one per https twin of an http URL.

    Plain: every 17th page failed, every 11th is 404, every 13th redirects to
    the next page (or, every 26th, to itself), the rest are 200.
    Twins: every 19th failed, every 7th is 404, every 23rd redirects, and every
    fourth has the body of the next page.
    """
    source = with_site(pages(spark, folder))
    following = pages(spark, folder).select(
        (F.col("page_id") - 1).alias("page_id"),
        F.col("url").alias("next_url"),
        F.col("html").alias("next_html"),
    )
    joined = source.join(following, "page_id", "left")
    page = F.col("page_id")

    def response(failed: Column, missing: Column, moved: Column, location: Column):
        code = (
            F.when(failed, F.lit(0))
            .when(missing, F.lit(404))
            .when(moved, F.lit(301))
            .otherwise(F.lit(200))
        )
        headers = F.when(
            ~failed & ~missing & moved,
            F.concat(
                F.lit("HTTP/1.1 301 Moved\r\nX-Location: no\r\nLocation: "),
                F.coalesce(location, F.lit("")),
                F.lit("\r\n\r\n"),
            ),
        ).otherwise(F.lit("HTTP/1.1 200 OK\r\nServer: test\r\n\r\n"))
        error = F.when(failed, _error_text(page))
        return code.alias("http_code"), headers.alias("headers"), error.alias("error"), F.when(
            failed, F.lit("fetch")
        ).alias("short_error")

    plain = joined.select(
        "url",
        F.col("html").alias("body"),
        *response(
            page % 17 == 0,
            page % 11 == 0,
            page % 13 == 0,
            F.when(page % 26 == 0, F.col("url")).otherwise(F.col("next_url")),
        ),
    )
    twins = joined.filter(F.col("url").startswith("http://")).select(
        secure_twin(F.col("url"), F.col("host"), F.col("site")).alias("url"),
        F.when(page % 4 == 0, F.coalesce("next_html", "html")).otherwise(F.col("html")).alias("body"),
        *response(page % 19 == 0, page % 7 == 0, page % 23 == 0, F.col("next_url")),
    )
    return plain.unionByName(twins)


def platforms(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT * FROM VALUES ('default', 'mozilla'), ('cacert', 'mozilla+cacert')"
        " AS t(platform, ca_set)"
    )


def page_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each page and the next one, as ``page_id, left_url, right_url``."""
    left = pages(spark, folder).select("page_id", F.col("url").alias("left_url"))
    right = pages(spark, folder).select(
        (F.col("page_id") - 1).alias("page_id"), F.col("url").alias("right_url")
    )
    return left.join(right, "page_id")


def twin_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each http page and its https twin, as ``page_id, left_url, right_url``."""
    http = with_site(pages(spark, folder).select("page_id", "url")).filter(
        F.col("url").startswith("http://")
    )
    twin = secure_twin(F.col("url"), F.col("host"), F.col("site"))
    return http.select("page_id", F.col("url").alias("left_url"), twin.alias("right_url"))


def flawed_corpus(spark: SparkSession, folder: str) -> Corpus:
    """The corpus with faults: names shortened so that some files share one,
    further targets that no rule rewrites, and targets without a dot."""
    whole = corpus(spark, folder)
    label = F.substring(F.regexp_replace("ruleset_id", r"\..*$", ""), 1, 5)
    renamed = whole.rulesets.withColumn("name", label)
    odd = renamed.select(
        "ruleset_id",
        F.lit(2).alias("pos"),
        F.when(F.length("ruleset_id") % 2 == 0, label)
        .otherwise(F.concat(F.lit("cdn."), label, F.lit(".example.edu")))
        .alias("host"),
    )
    only_site_rule = whole.rules.filter((F.col("pos") == 0) | (F.length("ruleset_id") % 3 == 0))
    return Corpus(
        renamed, whole.targets.unionByName(odd), only_site_rule, whole.exclusions, whole.tests
    )


def crossing_targets(spark: SparkSession, folder: str) -> DataFrame:
    """``ruleset_id, host``: the corpus' targets and, for each site, further ones whose wildcards cross."""
    own = corpus(spark, folder).targets.select("ruleset_id", "host")
    site = F.col("site")
    rest = F.expr("substring_index(site, '.', -2)")
    first = F.substring_index(site, ".", 1)
    crossing = sites(spark, folder).select(
        F.concat(F.lit("cross-"), site).alias("ruleset_id"),
        F.explode(
            F.array(
                F.concat(F.lit("www."), first, F.lit(".*."), F.element_at(F.split(site, r"\."), -1)),
                F.concat(F.lit("*.m."), site),
                F.concat(F.lit("m.*."), rest),
                F.concat(F.lit("*."), F.substring(first, 1, 3), F.lit("."), rest),
            )
        ).alias("host"),
    )
    return own.unionByName(crossing)


def certs(spark: SparkSession, folder: str) -> DataFrame:
    """A certificate file per customer; many have the same content."""
    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    der = F.concat_ws(":", F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return customer.select(
        F.concat(F.lit("certs/"), F.lpad(key.cast("string"), 9, "0"), F.lit(".pem")).alias("path"),
        (F.col("c_acctbal") < 0).alias("is_symlink"),
        F.when(key % 50 == 0, F.lit("no certificate here"))
        .otherwise(
            F.concat(
                F.lit("-----BEGIN CERTIFICATE-----\n"),
                F.base64(der.cast("binary")),
                F.lit("\n-----END CERTIFICATE-----\n"),
            )
        )
        .alias("pem"),
    )


def node(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{kind}:"), key.cast("string")), 256)


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """Issuer edges: region to nation to supplier to order to customer."""

    def own(name: str) -> DataFrame:
        return table(spark, folder, name)

    def edges(df: DataFrame, up: Column, down: Column) -> DataFrame:
        return df.select(up.alias("issuer_sha256"), down.alias("subject_sha256"))

    c = F.col
    return (
        edges(own("nation"), node("region", c("n_regionkey")), node("nation", c("n_nationkey")))
        .unionByName(
            edges(own("supplier"), node("nation", c("s_nationkey")), node("supplier", c("s_suppkey")))
        )
        .unionByName(
            edges(own("lineitem"), node("supplier", c("l_suppkey")), node("order", c("l_orderkey")))
        )
        .unionByName(
            edges(own("orders"), node("order", c("o_orderkey")), node("customer", c("o_custkey")))
        )
    )
