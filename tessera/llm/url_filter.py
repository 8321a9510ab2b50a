"""URL filters by host-suffix and path-prefix expressions.

Each url is expanded into the expressions that a rule can equal: its host and parent domains
(of at most as many labels as any rule has) times the prefixes of its path at the lengths that rules have. Both sides' expressions are
keyed by the first 4 bytes of their sha256; the equi-join is on that short prefix and the
full digest confirms. Of the rules that fit, the longest (host and path) wins; of rules of
one length the longer host wins, then block before allow.

The rule list is broadcast up to ``BROADCAST_RULES`` rules; beyond that the join shuffles
both sides by the prefix. Urls are cut and expanded by built-in expressions only.

Edge cases: a null url and one without ``://`` has an empty host and path and fits no rule;
ports and user names stay part of the host; repeated rows each get a row; an empty table gives none;
an empty label (a host with ``..``) is an ordinary label. Null hosts in rules never fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
DEFAULT = "allow"
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """rules: (host, path, verdict) rows, or a DataFrame with those columns."""
    r = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    r = r.where("host is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    return r.select("*", digest.alias("r_digest"), F.substring(digest, 1, 8).alias("prefix"))


def judge(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages."""
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    lengths = [x[0] for x in table.select(F.length("r_path").alias("n")).distinct().collect()]
    most = F.size(F.split("r_host", r"\."))
    n_rules, deepest = table.agg(F.count(F.lit(1)), F.coalesce(F.max(most), F.lit(1))).first()
    p = pages.select("page_id", F.col("url").alias("u")).select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    # the verdict depends on host and path alone: pages are matched once per distinct pair
    sites = p.where("host <> ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
    labels = F.split("host", r"\.")
    labels = F.slice(F.reverse(labels), F.lit(1), F.lit(deepest))  # no rule has more labels
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.reverse(F.slice(labels, F.lit(1), i)), "."))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    e = sites.select("host", "path", F.explode(hosts).alias("e_host"), cuts.alias("cuts")).select("host", "path", "e_host", F.explode("cuts").alias("n"))
    e = e.withColumn("digest", F.sha2(F.concat(F.col("e_host"), F.lit("\n"), F.col("path").substr(F.lit(1), F.col("n"))), 256))
    e = e.withColumn("prefix", F.substring("digest", 1, 8))
    side = F.broadcast(table) if n_rules <= BROADCAST_RULES else table
    m = e.join(side, "prefix").where("digest = r_digest")
    best = F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    won = m.groupBy("host", "path").agg(best.alias("best")).select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), "best")
    out = p.join(won, (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


ORACLE = r"""
with r(r_host, r_path, r_verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), p as (
  select page_id, row_number() over () as rid,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages
), m as (
  select rid, r_host || r_path as rule, r_verdict, row_number() over (partition by rid order by length(r_host) + length(r_path) desc, length(r_host) desc) as k
  from p join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from p left join m on p.rid = m.rid and k = 1
"""
