"""Queries over texts: the driver's documents, pages and conversations stand in for statement pages.

Their texts are Latin, so script and keywords are passed where a job has them as
parameters. SQL is given where RE2 knows the patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import number_tokens, parse_number
from ..operators import text_jobs as J
from ..operators.risk import capped, text_flags
from .fixtures import spread, table

RULES = [("risks", ["ation", "risk"]), ("strategy", ["ment", "plan"]), ("esg", ["heit"]), ("governance", ["ción"])]
RISKS = [("sanctions", "high", ["worthless", "clown"]), ("climate", "medium", ["license", "copyright"]), ("cyber", "medium", ["token"]), ("legal", "medium", ["password", "secret"])]
KNOWN = ["license", "copyright", "warranty"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("double").alias("ocr_quality"))


VOWELS = "[aeiouyáéíóúèêäöü]"


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("mean_confidence", F.lit(80.0))
    return J.quality_scores(docs, T.LATIN, vowels=VOWELS).select("doc_id", "native", "reading")


def narrative_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "text", F.lit(None).cast("double").alias("ocr_quality"))
    return J.narrative_facts(pages, RULES, T.LATIN).select("doc_id", "category", "ord", F.md5("text").alias("text_md5"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), "text")
    return J.headings(pages, KNOWN).select("doc_id", "ord", F.md5("title").alias("title_md5"))


def doc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", J.document_class(F.col("text")).alias("document_type"), F.size(T.statement_codes(F.col("text"))).alias("n_codes"))


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences about orders: some name the reporting year, all hold dates."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"), F.col("o_custkey").alias("c"))
    year = F.col("y").cast("string")
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Annual report of the group "), (F.col("y") + 10).cast("string"))).otherwise(F.lit("Order"))
    return orders.select("doc_id", F.concat_ws(" ", said, F.lit("signed 31.12."), F.concat(F.lit("31.12."), year), F.lit("by customer"), F.col("c").cast("string"), F.concat(year, F.lit(".")), F.lit("12"), F.lit("19991")).alias("text"))


def text_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_texts(spark, sf_dir).select("doc_id", F.explode(T.years_in(F.col("text"))).alias("yr"))


def reporting_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_texts(spark, sf_dir).select("doc_id", J.reporting_year(F.col("text")).alias("yr"))


def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose numbers all occur in the conversation's first turn."""
    pages = _pages(spark, sf_dir)
    allowed = pages.where("page = 0").groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.claims(F.col("text")))))).alias("numbers"))
    joined = pages.join(allowed, "doc_id", "left").withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>")))
    return joined.select("doc_id", "page", F.size(T.claims(F.col("text"))).alias("n_numbers"), T.grounded(F.col("text"), F.col("numbers")).alias("grounded"))


def text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return J.unique_texts(items, ["conv_id", "role"], ["turn", "text"], 5).select("conv_id", "role", "ord", "turn")


def gibberish(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.gibberish(text).alias("gibberish"), T.tidy_item(text).alias("tidy"))


def risk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text")
    return capped(text_flags(pages, RISKS))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select("doc_id", F.length("cleaned").alias("n_chars"), F.md5("cleaned").alias("text_md5"))


def numbers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that stand in texts, summed a document."""
    read = _docs(spark, sf_dir).select("doc_id", number_tokens(F.col("text")).alias("numbers"))
    return read.select("doc_id", F.size("numbers").alias("n_numbers"), F.array_max("numbers").alias("largest"), F.array_min("numbers").alias("least"))


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in several ways and read back."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.format_number("l_extendedprice", 2).alias("cell"), F.col("l_linenumber").alias("way"))
    way = F.col("way") % 4
    cell = (
        F.when(way == 0, F.concat(F.lit("("), F.translate("cell", ",.", " ,"), F.lit(")"))).when(way == 1, F.concat(F.translate("cell", ",", " "), F.lit(" руб.")))
        .when(way == 2, F.concat(F.lit("−"), F.translate("cell", ",", " "))).otherwise(F.lit("н/д"))
    )
    return items.groupBy(way.alias("way")).agg(F.count("*").alias("n"), F.round(F.sum(parse_number(cell).cast("decimal(18,2)")).cast("double"), 2).alias("total"))


def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir).withColumn("image_coverage", F.lit(0.0))
    return J.pages_to_read(pages).select("doc_id", "reason", "quality")


def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 50 documents as one report each."""
    docs = _docs(spark, sf_dir)
    pages = docs.select(F.floor(F.col("doc_id") / 50).alias("doc_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("page"), "text")
    return J.candidate_pages(pages, 6)


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = J.document_facts(_pages(spark, sf_dir))
    return facts.select("doc_id", "n_pages", "text_pages", "ocr_pages", F.array_join("years", ",").alias("years"))


def section_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against user turns as a baseline."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit("risks").alias("section"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))
    numbers = F.array_distinct(F.flatten(F.collect_list(T.claims(F.col("text"))))).alias("numbers")
    allowed = turns.groupBy("doc_id").agg(numbers)
    found = J.accepted_sections(turns.where("role = 'assistant'"), turns.where("role <> 'assistant'"), allowed)
    return found.select("doc_id", "section", "ord", F.md5("text").alias("text_md5"))


def operational_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as operational figures: name, and price by size as a year; documents of 50 parts."""
    parts = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 50).alias("doc_id"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"),
        F.create_map(F.lit("2001"), F.round(F.col("p_size") * 1.0, 0)).alias("values"), F.lit("spreadsheet").alias("source_type"), F.lit(0.9).alias("confidence"),
    )
    return J.operational_unique(parts, T.LATIN).select("doc_id", "ord", "category", F.md5("name").alias("name_md5"))


QUERIES = {f.__name__: f for f in (
    text_quality, narrative_facts, headings, doc_class, text_years, reporting_years, number_grounding, text_dedup, gibberish, risk_text,
    clean_texts, numbers_read, parse_numbers, page_triage, page_neighbours, document_facts, section_acceptance, operational_dedup,
)}

_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_CODE = r"(?:1[1-7]\d0|2[1-5]\d0|4[1-5]\d0)"
_YEAR_SQL = r"""list_distinct([x[2:5]::INTEGER FOR x IN regexp_extract_all(' ' || regexp_replace(text, '(\d+)', ' \1 ', 'g'), ' (?:19|20)\d{2} ')])"""
_CLAIMS_SQL = r"""list_distinct([replace(x, ',', '.') FOR x IN regexp_extract_all(regexp_replace(coalesce(text, ''), '([A-Za-zА-Яа-яЁё])\d', '\1 ', 'g'), '\d+(?:[.,]\d+)?')])"""
_SQUEEZED_SQL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_LABEL_SQL = lambda c: rf"trim(regexp_replace(regexp_replace(translate(lower({c}), 'ё', 'е'), '[\x{{00AD}}\x{{2010}}-\x{{2015}}]', '-', 'g'), '\s+', ' ', 'g'), ' .,:;–—-' || chr(9))"
_WORD_SQL = "[А-Яа-яЁёA-Za-zÀ-ÖØ-öø-ÿ]{3,}"
_KEY_SQL = "trim(regexp_replace(translate(lower(text), 'ё', 'е'), '[^а-яa-z0-9]+', ' ', 'g'))"
_SAYS = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
_TOKENS_CTE = f"""k AS (SELECT id, unnest(regexp_extract_all(lower(t), '{_WORD_SQL}')) AS w FROM s),
m AS (SELECT id, max(c) AS top, sum(c) AS n FROM (SELECT id, w, count(*) AS c FROM k GROUP BY id, w) GROUP BY id)"""
_NOISE_SQL = lambda words: " OR ".join(f"contains(lower(t), '{w}')" for w in words)
_RULE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"""contains(l, '{w}')""" for w in words)} THEN '{name}'" for name, words in RULES) + " END"
#: A letter three times in a row, for an engine without back references.
_THRICE = "|".join(chr(c) * 3 for first, last in ("09", "az", "àÿ", "ая") for c in range(ord(first), ord(last) + 1))
_QUALITY_SQL = rf"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.TOKEN}')) AS w FROM documents),
e AS (SELECT *, regexp_matches(w, '[А-Яа-яЁёA-Za-z]') AS ab, NOT regexp_full_match(w, '[0-9]+') AS alpha, regexp_matches(w, '{T.LATIN}') AND NOT regexp_full_match(w, '[0-9]+') AS own, replace(lower(w), 'ё', 'е') AS l FROM k),
r AS (SELECT doc_id, max(c)::DOUBLE / sum(c) AS repeated FROM (SELECT doc_id, lower(w) AS w, count(*) AS c FROM e WHERE alpha GROUP BY ALL) GROUP BY doc_id),
c AS (SELECT doc_id, count(*)::DOUBLE AS n, greatest(count(*) FILTER (ab), 1)::DOUBLE AS ab, (count(*) FILTER (length(w) = 1 AND NOT regexp_full_match(w, '[0-9]')))::DOUBLE AS short, (count(*) FILTER (ab AND length(w) >= 3))::DOUBLE AS long,
  (count(*) FILTER (alpha))::DOUBLE AS alpha, (count(*) FILTER (own))::DOUBLE AS own, (count(*) FILTER (alpha AND regexp_matches(w, '[А-Яа-яЁё]') AND regexp_matches(w, '[A-Za-z]')))::DOUBLE AS mixed,
  coalesce(sum(CASE WHEN list_contains({T.FINANCIAL_WORDS!r}, l) THEN 2 WHEN length(regexp_replace(l, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')) >= 3 AND regexp_matches(l, '{VOWELS}') AND NOT regexp_matches(l, '{_THRICE}') THEN 1 ELSE 0 END) FILTER (own), 0)::DOUBLE AS sense FROM e GROUP BY doc_id),
t AS (SELECT doc_id, 2 * len(regexp_extract_all(text, '�')) + len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS broken FROM documents)
SELECT doc_id, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, least(45.0::DOUBLE, n / 4) + long / ab * 45 - short / n * 45 - least(35.0::DOUBLE, broken * 4.0::DOUBLE))), 1) END AS native,
  CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 80.0::DOUBLE * 0.62::DOUBLE + alpha / n * 13 + own / greatest(alpha, 1) * 8 + CASE WHEN own > 0 THEN sense / own ELSE 0 END * 12 + least(12.0::DOUBLE, n / 18)
    - greatest(0.0::DOUBLE, (n - alpha) / n - 0.7::DOUBLE) * 12 - short / n * 25 - mixed / greatest(alpha, 1) * 18 - greatest(0.0::DOUBLE, coalesce(repeated, 0) - 0.2::DOUBLE) * 30)), 1) END AS reading
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)"""
ORACLE_SQL = {
    "text_quality": _QUALITY_SQL,
    "number_grounding": f"""WITH t AS (SELECT conv_id, turn, {_CLAIMS_SQL} AS c FROM conversations), f AS (SELECT conv_id, flatten(list(c)) AS allowed FROM t WHERE turn = 0 GROUP BY conv_id)
SELECT conv_id AS doc_id, turn::INTEGER AS page, len(c)::INTEGER AS n_numbers,
  len([x FOR x IN c IF x NOT IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AND NOT list_contains(coalesce(allowed, []), x)]) = 0 AS grounded FROM t LEFT JOIN f USING (conv_id)""",
    "headings": rf"""WITH x AS (SELECT doc_id, unnest(r) AS raw, unnest(range(len(r))) AS pos FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS r FROM documents)),
y AS (SELECT doc_id, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS title FROM x), z AS (SELECT *, {_LABEL_SQL('title')} AS l FROM y WHERE length(title) BETWEEN 3 AND 150),
h AS (SELECT * FROM z WHERE regexp_matches(title, '^\d+(?:\.\d+){{0,3}}\.?\s+\D') OR (title = upper(title) AND title <> lower(title) AND len(string_split_regex(title, '\s+')) <= 12) OR {' OR '.join(f"contains(l, '{w}')" for w in KNOWN)}
  QUALIFY row_number() OVER (PARTITION BY doc_id, l ORDER BY pos) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INTEGER AS ord, md5(title) AS title_md5 FROM h QUALIFY ord <= 200""",
    "gibberish": f"""WITH s AS (SELECT doc_id AS id, {_SQUEEZED_SQL} AS t FROM documents), {_TOKENS_CTE}
SELECT id AS doc_id, length(t) NOT BETWEEN 8 AND 1400 OR coalesce(n, 0) < 3 OR top / n > 0.20 OR {_NOISE_SQL(T.BULLET_NOISE)} AS gibberish,
  length(t) BETWEEN 30 AND 500 AND coalesce(n, 0) >= 6 AND top / n <= 0.18 AS tidy FROM s LEFT JOIN m USING (id)""",
    "narrative_facts": rf"""WITH x AS (SELECT doc_id, unnest(r) AS text, unnest(range(len(r))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS r FROM documents)),
s AS (SELECT doc_id, pos, doc_id * 1000000 + pos AS id, {_SQUEEZED_SQL} AS t FROM x), {_TOKENS_CTE},
latin AS (SELECT id, count(*) FILTER (regexp_matches(w, '[A-Za-zÀ-ÖØ-öø-ÿ]')) AS own FROM k GROUP BY id),
c AS (SELECT doc_id, pos, t, {_LABEL_SQL('t')} AS l FROM s JOIN m USING (id) JOIN latin USING (id) WHERE length(t) BETWEEN 70 AND 650 AND n >= 9 AND own / n >= 0.65 AND top / n <= 0.16
  AND len(regexp_extract_all(t, '\b\d+\b')) <= n * 0.45 AND NOT ({_NOISE_SQL(T.TABLE_NOISE)})),
g AS (SELECT *, {_RULE_SQL} AS category FROM c), f AS (SELECT * FROM g WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, l[:220] ORDER BY pos) = 1)
SELECT doc_id, category, row_number() OVER (PARTITION BY doc_id, category ORDER BY pos)::INTEGER AS ord, md5(t) AS text_md5 FROM f QUALIFY ord <= 24""",
    "text_years": """WITH o AS (SELECT o_orderkey AS doc_id, year(o_orderdate)::INTEGER AS y, o_custkey AS c FROM orders)
SELECT doc_id, y AS yr FROM o UNION SELECT doc_id, y + 10 FROM o WHERE doc_id % 3 = 0 UNION SELECT doc_id, c::INTEGER FROM o WHERE regexp_full_match(c::VARCHAR, '(19|20)[0-9]{2}')""",
    "reporting_years": """WITH o AS (SELECT o_orderkey AS doc_id, year(o_orderdate)::INTEGER AS y, o_custkey::INTEGER AS c FROM orders)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN y + 10 WHEN c BETWEEN 1990 AND 2099 THEN greatest(y, c) ELSE y END AS yr FROM o""",
    "text_dedup": f"""WITH k AS (SELECT conv_id, role, turn, coalesce(text, '') AS text, {_KEY_SQL} AS key FROM conversations WHERE text IS NOT NULL),
f AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role, key ORDER BY turn, text) = 1)
SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text)::INTEGER AS ord, turn FROM f QUALIFY ord <= 5""",
    "risk_text": " UNION ALL ".join(
        f"""SELECT source AS doc_id, {100 + i} AS ord, '{code}' AS code, '{severity}' AS severity, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS pages
FROM (SELECT DISTINCT source, doc_id FROM documents WHERE {_SAYS(needles)} QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5) GROUP BY source"""
        for i, (code, severity, needles) in enumerate(RISKS)
    ),
    "parse_numbers": """SELECT l_linenumber % 4 AS way, count(*) AS n, CASE l_linenumber % 4 WHEN 3 THEN NULL WHEN 1 THEN 1 ELSE -1 END * round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS total
FROM lineitem GROUP BY l_linenumber % 4""",
    "doc_class": rf"""WITH {_DOCS}, c AS (SELECT doc_id, lower(text) AS t, len(list_distinct(regexp_extract_all(' ' || regexp_replace(text, '(\d+)', ' \1 ', 'g'), ' {_CODE} '))) AS n_codes FROM d)
SELECT doc_id, CASE WHEN n_codes >= 8 THEN 'ras_financial_statements' WHEN contains(t, 'investor presentation') THEN 'investor_presentation' ELSE 'corporate_document' END AS document_type, n_codes::INTEGER AS n_codes FROM c""",
    "document_facts": rf"""WITH y AS (SELECT conv_id, unnest({_YEAR_SQL}) AS yr FROM (SELECT conv_id, coalesce(text, '') AS text FROM conversations)),
a AS (SELECT conv_id, string_agg(DISTINCT yr::VARCHAR, ',' ORDER BY yr::VARCHAR) AS years FROM y GROUP BY conv_id)
SELECT conv_id AS doc_id, count(*) AS n_pages, count(*) FILTER (trim(coalesce(text, '')) <> '') AS text_pages, 0::BIGINT AS ocr_pages, coalesce(any_value(years), '') AS years
FROM conversations LEFT JOIN a USING (conv_id) GROUP BY conv_id""",
}
ORACLE_SQL["operational_dedup"] = f"""WITH p AS (SELECT p_partkey // 50 AS doc_id, p_partkey AS k, concat_ws(' ', p_name, p_brand, p_type) AS name, p_size FROM part),
t AS (SELECT k, unnest(regexp_extract_all(lower(name), '{_WORD_SQL}')) AS w FROM p), m AS (SELECT k, max(c) AS top, sum(c) AS n FROM (SELECT k, w, count(*) AS c FROM t GROUP BY k, w) GROUP BY k),
f AS (SELECT * FROM p JOIN m USING (k) WHERE n >= 2 AND top / n <= 0.25 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name), p_size ORDER BY k) = 1)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k)::INTEGER AS ord, '{J.OTHER}' AS category, md5(name) AS name_md5 FROM f QUALIFY ord <= 250"""
ORACLE_SQL["numbers_read"] = r"""WITH x AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\(?[\x{2212}-]?\d(?:[\d \x{00a0}]*\d)?(?:[,.]\d+)?\)?') AS cells FROM documents),
n AS (SELECT doc_id, [TRY_CAST(CASE WHEN starts_with(c, '(') AND ends_with(c, ')') THEN '-' ELSE '' END || replace(regexp_replace(translate(c, '−,', '-.'), '[() \x{00a0}]', '', 'g'), '--', '-') AS DOUBLE) FOR c IN cells] AS v FROM x)
SELECT doc_id, len(v)::INTEGER AS n_numbers, list_max(v) AS largest, list_min(v) AS least FROM n"""
_CODES_SQL = rf"""len(list_distinct(regexp_extract_all(' ' || regexp_replace(text, '(\d+)', ' \1 ', 'g'), ' {_CODE} ')))"""
_TITLED = lambda words: " OR ".join(f"contains(lower(text), '{w}')" for w in words)
_ALPHA = "[А-Яа-яЁёA-Za-z]"
ORACLE_SQL["page_triage"] = rf"""WITH {_DOCS}, k AS (SELECT doc_id, text, regexp_extract_all(text, '{T.TOKEN}') AS w, {_CODES_SQL} >= 2 OR {_TITLED(T.STATEMENT_TITLES)} AS evidence FROM d),
c AS (SELECT *, len(w) AS n, len([x FOR x IN w IF regexp_matches(x, '{_ALPHA}')]) AS alpha, len([x FOR x IN w IF length(x) = 1 AND NOT regexp_matches(x, '[0-9]')]) AS single,
  len([x FOR x IN w IF length(x) >= 3 AND regexp_matches(x, '{_ALPHA}')]) AS long,
  2 * len(regexp_extract_all(text, '\x{{FFFD}}')) + len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS broken FROM k),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE round(greatest(0, least(100, least(45, n / 4) + long / greatest(alpha, 1) * 45 - single / n * 45 - least(35, broken * 4))), 1) END AS quality FROM c)
SELECT doc_id, reason, quality::DOUBLE AS quality FROM (SELECT *, CASE WHEN length(trim(text)) < 80 THEN 'short' WHEN quality < 52 THEN 'poor' WHEN evidence AND quality < 78 THEN 'evidence' END AS reason FROM q) WHERE reason IS NOT NULL"""
ORACLE_SQL["page_neighbours"] = rf"""WITH {_DOCS}, p AS (SELECT doc_id // 50 AS doc_id, (doc_id % 50 + 1)::INTEGER AS page,
  4 * {_CODES_SQL} + CASE WHEN {_TITLED([w for _, words in J.PAGE_KINDS for w in words])} THEN 30 ELSE 0 END AS score FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page DESC) AS rank FROM p WHERE score > 0),
n AS (SELECT doc_id, page + o AS page, min(rank * 10 + pos) AS place FROM h, (VALUES (0, 0), (1, 1), (2, -1)) v(pos, o) GROUP BY ALL),
t AS (SELECT n.doc_id, n.page, row_number() OVER (PARTITION BY n.doc_id ORDER BY place) AS ord FROM n SEMI JOIN p ON p.doc_id = n.doc_id AND p.page = n.page),
b AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS c, max(score) OVER (PARTITION BY doc_id) AS top FROM p),
s AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS ord FROM b WHERE top = 0 AND list_contains([round_even(x * (c - 1) / 5, 0) FOR x IN range(least(6, c))], i))
SELECT doc_id, page::INTEGER AS page, ord::INTEGER AS ord FROM t WHERE ord <= 6 UNION ALL SELECT doc_id, page, ord::INTEGER FROM s"""
ORACLE_SQL["section_acceptance"] = rf"""WITH r AS (SELECT conv_id AS doc_id, turn, role, coalesce(text, '') AS text, {_CLAIMS_SQL} AS c, row_number() OVER () AS id FROM conversations),
s AS (SELECT id, {_SQUEEZED_SQL} AS t FROM r), {_TOKENS_CTE},
a AS (SELECT doc_id, flatten(list(c)) AS allowed FROM r GROUP BY doc_id),
good AS (SELECT r.* FROM r JOIN s USING (id) JOIN a USING (doc_id) LEFT JOIN m USING (id) WHERE role = 'assistant' AND length(t) BETWEEN 8 AND 1400 AND coalesce(n, 0) >= 3 AND top / n <= 0.20 AND NOT ({_NOISE_SQL(T.BULLET_NOISE)})
  AND len([x FOR x IN c IF x NOT IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AND NOT list_contains(allowed, x)]) = 0),
taken AS (SELECT * FROM good QUALIFY count(*) OVER (PARTITION BY doc_id) >= {J.SECTION_LEAST['risks']}),
u AS (SELECT doc_id, turn, text FROM taken UNION ALL SELECT doc_id, turn, text FROM r WHERE role IS DISTINCT FROM 'assistant' AND role IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM taken)),
k2 AS (SELECT *, {_KEY_SQL} AS key FROM u), f AS (SELECT * FROM k2 WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY turn) = 1)
SELECT doc_id, 'risks' AS section, row_number() OVER (PARTITION BY doc_id ORDER BY turn)::INTEGER AS ord, md5(text) AS text_md5 FROM f QUALIFY ord <= 5"""
