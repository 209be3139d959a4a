"""Operator 1: secret scans with credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are reported as they are. Other parts are weak:
an account (an assigned user or key name), a key (a free-standing run of 32 or
more base64 characters that mixes capitals, small letters and digits) and an
endpoint (a URL, or an assigned host). Parts of one document are joined as
intervals: two parts are in one scope if the gap between the end of one and the begin
of the other is at most SCOPE code points, whichever comes first and however long they
are. A weak account is reported if a secret is in its scope, a weak key if an
identifier is, an endpoint if both are. An assigned secret or a hex run is a
strong secret, an access key a strong identifier.

Positions are code points, ends exclusive. A weak part that begins within a base span
isn't reported again. Work is near linear in the matches of a text. A null text counts as empty; a null doc_id stays null; rows that
repeat in id and text each return; an empty table gives no rows; other columns
are left out of find() and kept by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, whole_text

#: Reach of a scope, and matches of a text that are measured together.
SCOPE, CHUNK = 240, 256
_VALUE, _QUOTE = "[A-Za-z0-9+/_.=-]+", "[\"']?"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN = f"({_either_case('password|passwd|secret|token|api_?key')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}({_VALUE})"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ACCOUNT = f"({_either_case('user|username|login|account|client_?id|access_?key_?id')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}({_VALUE})"
KEY = "[A-Za-z0-9+/_=-]{32,}"
ENDPOINT = f"(https?|s3|postgres|mysql|mongodb|redis)://[^\\s\"'<>]+|({_either_case('host|hostname|endpoint|server')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}({_VALUE})"
KINDS = ("assign", "access", "hex", "account", "key", "endpoint")
_SPAN = "array<struct<begin:int,rank:int,stop:int>>"


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column, use) -> Column:
    """An array of what use makes of each CHUNK items in turn."""
    last = F.floor((F.size(items) - 1) / CHUNK).cast("int")
    return F.when(F.size(items) == 0, F.array()).otherwise(
        F.transform(F.sequence(F.lit(0), last), lambda c: use(F.slice(items, c * CHUNK + 1, F.lit(CHUNK))))
    )


def _ends(sizes: Column) -> Column:
    """Running sums of an array of whole numbers."""
    zero = F.lit(0).cast("int")
    first = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("ends"))

    def add(state, n):
        at = state["at"] + n
        return F.struct(at.alias("at"), F.concat(state["ends"], F.array(at)).alias("ends"))

    def joined(parts):
        # what stands before each chunk, then each chunk's own sums
        before = F.aggregate(F.transform(parts, lambda p: p["at"]), first, add, lambda state: state["ends"])
        whole = lambda known: F.transform(parts, lambda p, i: F.transform(p["ends"], lambda e: e + F.when(i == 0, zero).otherwise(F.get(known, i - 1))))
        return F.flatten(_once(before, whole))

    return _once(_chunks(sizes, lambda some: F.aggregate(some, first, add)).cast("array<struct<at:int,ends:array<int>>>"), joined)


def _spans(text: Column, pattern: str, rank: int, passes=None) -> Column:
    """(begin, rank, stop) of the leftmost non-overlapping matches whose text passes."""
    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)).alias("gaps"),
    )

    def measured(state):
        found = state["found"]
        sizes = F.transform(found, lambda m, i: F.get(state["gaps"], i) + F.length(m))
        spans = lambda ends: F.transform(found, lambda m, i: F.struct(
            (F.get(ends, i) - F.length(m)).alias("begin"), F.lit(rank).alias("rank"), F.get(ends, i).alias("stop"), (passes(m) if passes else F.lit(True)).alias("kept")))
        kept = F.filter(_once(_once(sizes, _ends), spans), lambda s: s["kept"])
        return F.transform(kept, lambda s: F.struct(s["begin"].alias("begin"), s["rank"].alias("rank"), s["stop"].alias("stop")))

    return F.when(text.rlike(pattern), _once(both, measured)).otherwise(F.array().cast(_SPAN))


def _six(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _mixed(match: Column) -> Column:
    return match.rlike("[A-Z]") & match.rlike("[a-z]") & match.rlike("[0-9]")


def parts(text: Column) -> Column:
    """All base spans and weak parts of a text."""
    return F.concat(
        _spans(text, ASSIGN, 0, _six), _spans(text, ACCESS, 1), _spans(text, HEX, 2),
        _spans(text, ACCOUNT, 3), _spans(text, KEY, 4, _mixed), _spans(text, ENDPOINT, 5),
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), copies (rows alike), base and spans: sorted (begin, rank, stop) of each distinct row.

    Text is read once and not shuffled: only parts and one marker a row are.
    """
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), parts(text).alias("parts")
    )
    marker = F.struct(F.lit(-1).alias("begin"), F.lit(-1).alias("rank"), F.lit(-1).alias("stop"))
    one = rows.select("doc_id", "digest", F.explode(F.concat(F.array(marker), "parts")).alias("part"))
    one = one.select("doc_id", "digest", "part.*")
    rank = F.col("rank")
    upward = Window.partitionBy("doc_id", "digest").orderBy("begin").rangeBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("doc_id", "digest").orderBy(F.col("begin").desc()).rangeBetween(Window.unboundedPreceding, 0)
    identifiers, secrets = rank.isin(1, 3), rank.isin(0, 2, 4)

    def reached(kind):
        """Whether a part of this kind that begins before ends in the scope, or one that begins after does so there."""
        before = F.max(F.when(kind, F.col("stop"))).over(upward) >= F.col("begin") - SCOPE
        after = F.min(F.when(kind, F.col("begin"))).over(downward) <= F.col("stop") + SCOPE
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    covered = F.coalesce(F.max(F.when(rank.isin(0, 1, 2), F.col("stop"))).over(upward) > F.col("begin"), F.lit(False))
    joined = one.select("*", reached(identifiers).alias("identifier"), reached(secrets).alias("secret"), covered.alias("covered"))
    linked = F.when(rank == 3, F.col("secret")).when(rank == 4, F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    kept = joined.where((rank < 3) | ~F.col("covered") & linked)
    span = F.when(rank >= 0, F.struct("begin", "rank", "stop"))
    found = kept.groupBy("doc_id", "digest").agg(
        F.sum((rank < 0).cast("int")).alias("copies"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    return found.withColumn("base", F.filter("spans", lambda s: s["rank"] < 3))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["begin"], s["stop"])), ",")


def runs(found: DataFrame) -> DataFrame:
    """doc_id, digest and runs: (prev, begin, stop) of each stretch that spans cover, prev being the end of the one before."""
    one = found.select("doc_id", "digest", F.explode("spans").alias("s")).select("doc_id", "digest", "s.begin", "s.stop")
    text = Window.partitionBy("doc_id", "digest")
    ordered = text.orderBy("begin", "stop")
    before = F.coalesce(F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("prev", before)
    # a span that begins where others end, or later, begins a run
    run = F.sum((F.col("begin") >= F.col("prev")).cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    merged = one.withColumn("run", run).groupBy("doc_id", "digest", "run").agg(F.min("prev").alias("prev"), F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    return merged.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("prev", "begin", "stop"))).alias("runs"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every stretch of text that reported spans cover replaced by mark; n_chars follows the text.

    All rows and columns stay; a text without spans stays as it is, a null one null.
    """
    found = runs(find(docs.select("doc_id", "text"))).select(_row_key("doc_id", F.col("digest")).alias("own"), "runs")
    rows = docs.select(F.struct(*docs.columns).alias("row"), _row_key("doc_id", F.sha2(whole_text(), 256)).alias("own"))
    # only documents with spans come from the right side, at most one row of it for each
    joined = rows.join(found, "own", "left")
    text = F.col("row.text")

    def cut(some):
        """The text over some runs, with marks: a long text is cut once for them all, then bit by bit."""
        base = F.get(some, F.lit(0))["prev"]
        stretch = F.substring(text, base + 1, F.element_at(some, -1)["stop"] - base)
        mend = lambda part: F.array_join(F.transform(some, lambda r: F.concat(F.substring(part, r["prev"] - base + 1, r["begin"] - r["prev"]), F.lit(mark))), "")
        return _once(stretch, mend)

    rest = F.substring(text, F.element_at("runs", -1)["stop"] + 1, F.length(text))
    clean = F.concat(F.array_join(_chunks(F.col("runs"), cut), ""), rest)
    changed = F.col("runs").isNotNull()
    out = joined.select("row", F.when(changed, clean).otherwise(text).alias("clean"), changed.alias("changed"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def _row_key(doc_id: str, digest: Column) -> Column:
    """One value for a doc_id and a text's digest."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")), digest)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every document, with a digest of the base ones."""
    found = find(documents(spark, sf_dir))
    number = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _sql_spans(pattern: str, kind: str, rank: int, test: str = "true") -> str:
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, digest, b AS begin, {rank} AS rank, b + length(m) AS stop FROM (
      SELECT doc_id, digest, m, sum(length(g) + coalesce(lag_m, 0)) OVER (PARTITION BY doc_id, digest ORDER BY i) AS b FROM (
        SELECT *, lag(length(m)) OVER (PARTITION BY doc_id, digest ORDER BY i) AS lag_m FROM (
          SELECT doc_id, digest, unnest(regexp_extract_all(text, '{pattern}')) AS m,
            unnest(regexp_split_to_array(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) AS g,
            unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM d))) WHERE {test}"""


_ASSIGN_SQL = ASSIGN.replace("'", "''")
OP1_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest FROM documents),
parts AS ({" UNION ALL ".join([
    _sql_spans(ASSIGN, "assign", 0, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6"),
    _sql_spans(ACCESS, "access", 1), _sql_spans(HEX, "hex", 2), _sql_spans(ACCOUNT, "account", 3),
    _sql_spans(KEY, "key", 4, "regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')"),
    _sql_spans(ENDPOINT, "endpoint", 5),
])}),
linked AS (
  SELECT DISTINCT w.doc_id, w.digest, w.begin, w.rank, w.stop FROM parts w WHERE w.rank < 3 OR (
    NOT EXISTS (SELECT 1 FROM parts b WHERE b.doc_id = w.doc_id AND b.digest = w.digest AND b.rank < 3 AND b.begin <= w.begin AND b.stop > w.begin)
    AND (w.rank = 4 OR EXISTS (SELECT 1 FROM parts s WHERE s.doc_id = w.doc_id AND s.digest = w.digest AND s.rank IN (0, 2, 4) AND s.begin - w.stop <= {SCOPE} AND w.begin - s.stop <= {SCOPE}))
    AND (w.rank = 3 OR EXISTS (SELECT 1 FROM parts a WHERE a.doc_id = w.doc_id AND a.digest = w.digest AND a.rank IN (1, 3) AND a.begin - w.stop <= {SCOPE} AND w.begin - a.stop <= {SCOPE})))),
named AS (SELECT *, ['{"','".join(KINDS)}'][rank + 1] || ':' || begin::BIGINT || ':' || stop::BIGINT AS s FROM linked),
per AS (
  SELECT doc_id, digest, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(s, ',' ORDER BY begin, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY begin, rank) AS spans FROM named GROUP BY ALL)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) d LEFT JOIN per ON per.doc_id = d.doc_id AND per.digest = d.digest
"""
