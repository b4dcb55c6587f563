"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is a host and a path prefix; it fits its host and every subdomain. Each distinct (host, path) is
expanded into the expressions that some rule could equal, the expressions meet the rules in an equi-join on
the first 32 bits of their SHA-256, and a match counts only if the full digests agree. Among the rules that
fit, the longest wins; a longer host breaks ties; of two rules that are equal, block wins.

The expansion is bounded by the rules, not by the url: only path lengths and host depths that occur among the
rules are formed. The pages are read narrow (id and url) and joined once with the (host, path) pairs that a
rule fits, so a page that is repeated or a host with a third of all pages costs no group: both sides of that
join are plain exchanges, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import ascii_lower, table

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def compiled(rules: DataFrame) -> DataFrame:
    """One row per expression: its digest, the digest's first 32 bits, and what decides between rules. Rules without
    a host, or with a path that no url can start with, are left out."""
    rows = rules.select(ascii_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    rows = rows.where((F.col("h") != "") & ((F.col("p") == "") | F.col("p").startswith("/")))
    return (
        rows.groupBy("h", "p")
        .agg(F.max("verdict").alias("verdict"))  # 'block' sorts after 'allow'
        .select(
            F.sha2(F.concat("h", "p"), 256).alias("r_digest"),
            F.struct(
                (F.length("h") + F.length("p")).alias("len"), F.length("h").alias("host_len"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict"),
                F.size(F.split("h", r"\.")).alias("depth"), F.length("p").alias("path_len"),
            ).alias("r"),
        )
        .withColumn("short", F.substring("r_digest", 1, 8))
    )


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Returns id_col, host, path, rule (null where none fits) and verdict, a row for each row of pages.

    A null url, or one without '://', has an empty host and path and gets the default. Repeated rows are kept.
    Other columns of pages are not looked at.
    """
    ready = compiled(rules)
    shapes = ready.select(F.col("r.depth").alias("depth"), F.col("r.path_len").alias("path_len")).distinct().collect()
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shapes:
        return judged.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    depths = F.array(*[F.lit(d) for d in sorted({s.depth for s in shapes})])
    lengths = F.array(*[F.lit(n) for n in sorted({s.path_len for s in shapes})])
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(depths, lambda d: d <= F.size(labels)), lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    found = (
        judged.select("host", "path").where(F.col("host") != "").distinct()
        .select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 8))
        .join(ready, "short")
        .where(F.col("digest") == F.col("r_digest"))
        .groupBy(F.xxhash64("host", "path").alias("k"), "host", "path")
        .agg(F.max("r").alias("best"))
        .select(F.col("host").alias("m_host"), F.col("path").alias("m_path"), "best")
    )
    return judged.join(found, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left").select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


_values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP1_SQL = f"""
WITH r(host, path, verdict) AS (VALUES {_values}),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT u.host, u.path, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path) * 1000 + length(r.host)) AS best
  FROM (SELECT DISTINCT host, path FROM p) u
  JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path)
SELECT p.page_id, p.host, p.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
