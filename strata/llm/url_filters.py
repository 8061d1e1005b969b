"""URL filters: rules on host suffixes and path prefixes, found by hashed equi-joins.

Each distinct (host, path) is expanded into expressions: every host suffix at a
label border times every path prefix, restricted to the label counts and path
lengths that rules have.  Expressions and rules meet on a short hash prefix
(32 bits of SHA-256); the full digests then confirm the match.  Of the rules that
fit, the longest wins (host and path characters together, then host, then
``block`` before ``allow``).

Skew: expressions are made of distinct (host, path), counted before the shuffle.
Rules are copied ``SALTS`` times and expressions dealt over the copies, so an
expression that a third of all urls share is spread; verdicts go back to the
rows the same way.

Defined results.  Null url or one without ``://``: host and path empty.  No rule:
``rule`` null and the default verdict.  A rule with a null host, path or verdict
is ignored; repeated rules count once.  Repeated rows are all returned.  Extra
columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

SALTS = 16
PREFIX_HEX = 8


def split_url(url) -> tuple:
    """(host, path) columns: host lower-cased in A-Z, path up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", salts: int = SALTS) -> DataFrame:
    """key, host, path, rule, verdict of every row.  ``rules`` has host, path, verdict."""
    host, path = split_url(F.col(url).cast("string"))
    rows = pages.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), F.col(url).alias("_url"))
    rules = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna()
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block is last in order
    rules = rules.withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    # the shapes that rules have: at most as many as a host has labels and a path has characters
    labels = sorted(r[0] for r in rules.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())
    urls = rows.select("host", "path").distinct()
    parts = F.size(F.split("host", r"\.", -1))
    # a host has as many suffixes as labels, a path as many prefixes as characters; only those of rule shapes are made
    suffixes = [F.when(parts >= k, F.substring_index("host", ".", -k)) for k in labels]
    prefixes = [F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]
    some = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    suffixes, prefixes = some(suffixes), some(prefixes)
    terms = urls.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    terms = terms.withColumn("e_digest", F.sha2(F.concat_ws("\n", "h", "p"), 256)).withColumn("e_short", F.substring("e_digest", 1, PREFIX_HEX))
    terms = terms.withColumn("e_salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int"))
    copies = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = terms.join(copies, (terms.e_short == copies.short) & (terms.e_salt == copies.salt) & (terms.e_digest == copies.digest) & (terms.h == copies.r_host) & (terms.p == copies.r_path))
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("whole"), F.length("r_host").alias("host_chars"), F.col("r_verdict").alias("verdict"),
        F.concat("r_host", "r_path").alias("rule"),
    )
    best = hits.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(rank).alias("best"))
    best = best.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_key", "_url"), F.lit(salts)).cast("int"))
    joined = rows.join(best, (rows.host == best.b_host) & (rows.path == best.b_path) & (rows._salt == best.b_salt), "left")
    return joined.select(F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS t(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


QUERIES = {"op4_url_filters": op4_url_filters}
ORACLE = {
    "op4_url_filters": r"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, url, row_number() OVER () AS k,
             lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
best AS (SELECT k, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS r
         FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (k)"""
}
