"""Operator 10: URL filters, by host rules and by pattern rules indexed by their rarest token.

Host rules: (host, path, verdict) fits the host and its subdomains where the path
begins with the rule's; the longest fitting rule decides. Other URLs go to the
pattern rules. Each of those has one or more sets of literal tokens (runs of letters
and digits, without the digits that may follow them): a URL that matches holds all of
one of the sets. The rule is filed once for each set, under the token of it that is
rarest in the table at hand. A URL's own tokens, as they are and without trailing
digits, fetch candidates from that index, and only these run their regular
expressions. Any match blocks; without one the URL is allowed.

judge() takes the rules as lists, which travel as a map from token to patterns: it reads
the URLs once for the counts and once to judge them, and shuffles only the counts.
judge_by_tables() takes them as tables of any size and joins them.

Host and path are empty for a null URL or one without "://", which fits no rule
and is allowed. Of rules of equal length the greater by text decides. Repeated rows all
return; an empty table gives none; a very long URL is judged whole; no other columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BEST = "struct<size:int,rule:string,verdict:string>"
#: (host, path, verdict): the rules of the query.
HOST_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: (pattern, sets of literal tokens): advertising, tracking, sign-in and file links.
PATTERN_RULES = [
    (r"://(ads?|adserver|banner)\d*\.", [["ads"], ["ad"], ["adserver"], ["banner"]]),
    (r"/(ads?|banners?|sponsored)/", [["ads"], ["ad"], ["banner"], ["banners"], ["sponsored"]]),
    (r"[?&]utm_(source|medium|campaign)=", [["utm", "source"], ["utm", "medium"], ["utm", "campaign"]]),
    (r"[?&](gclid|fbclid)=", [["gclid"], ["fbclid"]]),
    (r"://(tracker|tracking|pixel)\.", [["tracker"], ["tracking"], ["pixel"]]),
    (r"/(login|signin|logout)(\.|/|\?|$)", [["login"], ["signin"], ["logout"]]),
    (r"/(cart|checkout)(/|\?|$)", [["cart"], ["checkout"]]),
    (r"\.(exe|zip|apk|iso)(\?|$)", [["exe"], ["zip"], ["apk"], ["iso"]]),
    (r"[?&](session|sessionid|sid)=", [["session"], ["sessionid"], ["sid"]]),
    (r"/wp-(admin|login)", [["wp"]]),
]


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and the names above it: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def tokens(url: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased, and these without trailing digits."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_union(runs, F.filter(F.transform(runs, lambda t: F.regexp_replace(t, "[0-9]+$", "")), lambda t: t != ""))


def token_counts(urls: DataFrame, rules: list = PATTERN_RULES) -> dict[str, int]:
    """How many URLs hold each token that a rule names; one row a named token."""
    named = sorted({t for _, required in rules for words in required for t in words})
    held = urls.select(F.explode(F.array_intersect(tokens(F.col("url")), F.array(*map(F.lit, named)))).alias("token"))
    return {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}


def index_rules(rules: list, counts: dict[str, int]) -> dict[str, list[str]]:
    """Token -> patterns: each rule under the rarest token of each of its sets, the least by text of equally rare ones."""
    filed: dict[str, list[str]] = {}
    for pattern, required in rules:
        for words in required:
            rarest = min(words, key=lambda t: (counts.get(t, 0), t))
            if pattern not in filed.setdefault(rarest, []):
                filed[rarest].append(pattern)
    return filed


def _longest(rules: list, host: Column, path: Column) -> Column:
    """The fitting rule of most characters, as (size, rule, verdict)."""
    names = suffixes(host)
    table = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    fit = F.filter(F.array(*table), lambda r: F.array_contains(names, r["host"]) & path.startswith(r["path"]))
    return F.array_max(F.transform(fit, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("size"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))


def _verdict(best: Column, hit: Column) -> list[Column]:
    return [best["rule"].alias("rule"), F.coalesce(best["verdict"], F.when(hit, "block").otherwise("allow")).alias("verdict")]


def judge(urls: DataFrame, host_rules: list = HOST_RULES, pattern_rules: list = PATTERN_RULES) -> DataFrame:
    """page_id, url, host, path, rule and verdict of every row of urls (page_id, url)."""
    urls = urls.select("page_id", "url")
    filed = index_rules(pattern_rules, token_counts(urls, pattern_rules))
    found = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    best = F.when(F.col("host") != "", _longest(host_rules, F.col("host"), F.col("path"))) if host_rules else F.lit(None).cast(_BEST)
    hit = F.lit(False)
    if filed:
        index = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for entry in sorted(filed.items()) for x in entry))
        fetched = F.array_intersect(tokens(F.col("url")), F.array(*map(F.lit, sorted(filed))))
        candidates = F.flatten(F.transform(fetched, lambda t: F.element_at(index, t)))
        hit = F.coalesce(F.exists(candidates, lambda p: F.rlike(F.col("url"), p)), F.lit(False))
    found = found.withColumn("best", best)
    return found.select("page_id", "url", "host", "path", *_verdict(F.col("best"), hit))


def judge_by_tables(urls: DataFrame, hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Like judge(), with rules of any number: hosts (host, path, verdict), patterns (pattern, required tokens)."""
    urls = urls.select("page_id", "url")
    distinct = urls.where("url is not null").select("url").distinct()
    held = distinct.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    sets = patterns.select("pattern", F.array_sort("required").alias("required")).distinct()
    named = sets.select(F.explode("required").alias("token")).distinct()
    counts = held.join(named, "token").groupBy("token").count()
    filed = sets.select("pattern", "required", F.explode("required").alias("token")).join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))["token"]
    filed = filed.groupBy("pattern", "required").agg(rarest.alias("token")).select("token", "pattern").distinct()
    hits = held.join(filed, "token").where("url rlike pattern").select("url").distinct().withColumn("hit", F.lit(True))
    places = distinct.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = places.where("host <> ''").select("url", F.col("path").alias("own"), F.explode(suffixes(F.col("host"))).alias("host")).join(hosts, "host")
    fit = fit.where(F.col("own").startswith(F.col("path")))
    size = (F.length("host") + F.length("path")).alias("size")
    fit = fit.groupBy("url").agg(F.max(F.struct(size, F.concat("host", "path").alias("rule"), "verdict")).alias("best"))
    known = fit.join(hits, "url", "full")
    found = urls.join(known, "url", "left").select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return found.select("page_id", "url", "host", "path", *_verdict(F.col("best"), F.coalesce("hit", F.lit(False))))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
_HIT_SQL = " OR ".join(f"regexp_matches(url, '{p}')" for p, _ in PATTERN_RULES)
OP10_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (
  SELECT p.*, (SELECT max(struct_pack(size := length(h) + length(q), rule := h || q, verdict := v))
    FROM (VALUES {_RULES_SQL}) AS r(h, q, v) WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, q)) AS best FROM p)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN {_HIT_SQL} THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""
