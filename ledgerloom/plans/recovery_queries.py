"""Queries of the second ways to a statement's content, over texts and rows made of the star-schema tables.

Orders, customers and lines stand in for statement pages, reports and transcriptions: what a
query must find again was put into the text by an expression that the SQL knows without the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ratios as R
from ..operators import recovery as Y
from ..operators import trends
from .fixtures import FX_SQL, facts, spread, table
from . import findings_queries
from .statement_queries import ORACLE_SQL as STATEMENTS
from .statement_queries import QUERIES as STATEMENT_QUERIES

#: Words between the auditor and the company, so that their surroundings differ.
GAP = "далее следует описание проверки " * 16


def _whole(expr: str) -> F.Column:
    """A whole amount with groups of three set apart, as pages print it."""
    return F.translate(F.format_number(F.expr(expr), 0), ",", " ")


def _form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order: a balance for every third, a profit and loss for the next, else a page of one code only."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")).selectExpr("o_orderkey AS doc_id", "o_orderkey % 3 AS kind", "cast(floor(o_totalprice) AS bigint) + 1000 AS a", "year(o_orderdate) AS reporting_year")
    amount = lambda text, *parts: F.concat_ws("\n", F.lit(text), *parts)
    row = lambda name, *exprs: F.concat_ws(" | ", F.lit(name), *map(_whole, exprs))
    # a window of three lines holds one row, as between rows stand two lines without numbers
    apart = [F.lit("в тысячах"), F.lit("за период")]
    balance = amount(
        "Бухгалтерский баланс", *apart, row("Запасы 1210", "a", "a + 1", "a + 2"), *apart,
        row("Денежные средства и эквиваленты", "a * 2", "a * 2 + 1", "a * 2 + 2"), F.lit("см. 1600"),
    )
    pnl = amount("Отчет о финансовых результатах", *apart, row("Выручка 2110", "a * 3", "a * 3 + 1"), *apart, row("Себестоимость продаж 2120", "a", "a + 1"))
    text = F.when(F.col("kind") == 0, balance).when(F.col("kind") == 1, pnl).otherwise(row("Запасы 1210", "a", "a", "a"))
    return orders.select("doc_id", F.lit(1).alias("page"), "reporting_year", text.alias("text"))


def statement_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.text_rows(_form_pages(spark, sf_dir))


def ranked_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows rank behind a document's own readings; orders of a fifth of the customers have one of inventory."""
    orders = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0 AND o_orderkey % 3 = 0")
    own = orders.selectExpr("o_orderkey AS doc_id", "'inventory' AS metric_key", "year(o_orderdate) AS yr", "cast(o_custkey AS double) AS val", "0.98D AS confidence")
    rows = Y.text_rows(_form_pages(spark, sf_dir)).select("doc_id", "metric_key", "yr", "val", "confidence")
    return Y.ranked_last(own, rows)


def ifrs_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of notes a customer; the second says other amounts, which count. Some stand in brackets, some have decimals and years."""
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"))
    customers = customers.selectExpr("c_custkey AS doc_id", "cast(floor(abs(c_acctbal)) AS bigint) + 10000 AS a", "explode(array(1, 2)) AS page")
    lines = [F.lit("Notes to the statements, thousands of roubles"), F.lit("Operating expenses")]
    two = ["cast(a * page AS string)", "cast(a * page + 7 AS string)"]
    written = [f"concat('Depreciation ', {two[0]}, ' ', {two[1]})", f"concat('Depreciation (', {two[0]}, ') (', {two[1]}, ')')", f"concat('Depreciation 2020 ', {two[0]}, ',5 2019 ', {two[1]}, ',5')"]
    lines.append(F.expr(f"CASE doc_id % 3 WHEN 0 THEN {written[0]} WHEN 1 THEN {written[1]} ELSE {written[2]} END"))
    finance = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Finance income and costs\nПроцентный расход "), F.col("a").cast("string"), F.lit(" "), (F.col("a") + 1).cast("string")))
    pages = customers.select("doc_id", "page", F.lit(2020).alias("reporting_year"), F.concat_ws("\n", *lines, finance).alias("text"))
    return Y.note_rows(pages)


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of customers: an auditor and the company by their full forms, a short form, a line, or none."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"))
    full = F.concat(F.lit("Аудиторская организация Акционерное общество «Проверка» "), F.lit(GAP), F.lit("акционерам Публичное акционерное общество «"), F.col("name"), F.lit("»"))
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit("Сведения об ООО «"), F.col("name"), F.lit("» за год"))).when(kind == 2, F.concat(F.lit("Annual report of the group\n  Group "), F.col("name"), F.lit("\n")))
    return Y.companies(customers.select("doc_id", text.alias("text")))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as stored results, their orders as metrics, a part of which carry a line code."""
    results = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS doc_id", "CASE c_custkey % 7 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'bank_ras_financial_statements' ELSE 'corporate_document' END AS document_type",
        "CASE WHEN c_custkey % 5 = 0 THEN 'РСБУ' ELSE 'МСФО' END AS standard", "concat('ПАО «Клиент', c_custkey, '» отчетность.pdf') AS filename",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Не определено' ELSE c_name END AS company",
    )
    metrics = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "CASE WHEN o_orderkey % 4 <> 0 THEN '1600' END AS row_code")
    return results, metrics


def stored_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.repaired_results(*_stored(spark, sf_dir))


def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "CASE WHEN l_suppkey % 3 = 0 THEN 'revenue' WHEN l_suppkey % 3 = 1 THEN 'assets' ELSE 'unknown' END AS metric_key",
        "CASE WHEN l_linenumber = 7 THEN 'x' ELSE cast(l_linenumber AS string) END AS page", "CASE WHEN l_partkey % 4 = 0 THEN '20x1' ELSE cast(year(l_shipdate) AS string) END AS yr",
        "CASE WHEN l_partkey % 6 = 1 THEN 'н/д' ELSE cast(cast(l_quantity AS int) AS string) END AS cell",
    )
    keys = spark.createDataFrame([("revenue",), ("assets",)], "metric_key string")
    pages = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "explode(sequence(1, 1 + cast(o_orderkey % 4 AS int))) AS page")
    rows = Y.transcribed_rows(raw, keys, pages)
    return rows.groupBy("doc_id", "page", "metric_key", "yr").agg(F.count("*").alias("n"), F.sum("val").alias("total"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id", "1 AS page", "l_linenumber AS attempt", "cast(l_partkey % 3 AS int) AS codes", "cast(l_suppkey % 2 AS int) AS titles",
        "cast(cast(l_quantity AS int) AS double) AS quality", "cast(l_partkey % 10 AS double) AS confidence", "cast(l_suppkey % 10 AS int) AS size",
    )


def read_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.best_retry(_reads(spark, sf_dir))


def read_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.best_pass(_reads(spark, sf_dir))


_FEATURES = [
    "cast(count(*) % 3 AS int) AS ocr_pages", "cast(cast(sum(l_quantity) AS bigint) % 100 AS double) AS ocr_quality", "cast(count(*) AS int) AS text_pages", "10 AS total_pages",
    "l_orderkey % 3 = 0 AS scan_only", "8 AS ocr_limit", "l_orderkey % 2 = 0 AS ocr_enabled",
    "CASE l_orderkey % 4 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'ifrs_financial_statements' ELSE 'other' END AS document_type", "l_orderkey % 5 = 0 AS elsewhere",
    "cast(count(*) AS int) AS candidates", "cast(count(*) * 2 AS int) AS primary_metrics", "cast(l_orderkey % 2 AS int) AS operational", "cast(l_orderkey % 3 AS int) AS tables",
]


def limitation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.expr(x) for x in _FEATURES])
    return Y.limitations(lines.withColumnRenamed("l_orderkey", "doc_id"))


def model_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts(spark, sf_dir)
    rows = Y.coverage(found, R.ratios(found))
    return rows.select("doc_id", "verified_metrics", "calculated_ratios", F.array_join("years", ",").alias("years"))


def risk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    numeric = STATEMENT_QUERIES["risk_numeric"](spark, sf_dir)
    disclosed = numeric.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.struct(F.lit(100 + i).alias("ord"), F.lit(c).alias("code")) for i, c in enumerate(["sanctions", "cyber"])])).alias("x"))
    return Y.risk_lines(numeric.select("doc_id", "ord", "code").unionByName(disclosed.select("doc_id", "x.*")))


def finding_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for findings in documents that have none in a section."""
    found = findings_queries.findings(spark, sf_dir).where("doc_id % 2 = 0")
    return Y.ratio_fallback(R.ratios(facts(spark, sf_dir)), found)


def page_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("pages"))
    return Y.pages_union(rows, ["l_orderkey"]).select(F.col("l_orderkey").alias("doc_id"), F.array_join("pages", ",").alias("pages"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(
        (F.col("p_size") % 50).alias("doc_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), (F.lit(0.8) + (F.col("p_partkey") % 3) * 0.1).alias("confidence"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("values"),
    )
    return Y.reporting_rows(items, None).select("doc_id", "ord", "name")


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("doc_id"))
    return Y.looked_up(trends.registry_latest(table(spark, sf_dir, "events")), asked).select("doc_id", "status", "n_events")


def reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios and flags anew for the documents asked for: nations of one region."""
    asked = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("doc_id"))
    kept = facts(spark, sf_dir).join(asked, "doc_id", "left_semi")
    return R.ratios(kept).select("doc_id", "ratio_key", F.round("value", 6).alias("value"), "status", "cur_year", "prev_year")


def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.floor("l_extendedprice").cast("double")).when(F.col("l_linenumber") % 3 == 1, F.col("l_extendedprice").cast("double"))
    return lines.select("l_orderkey", "l_linenumber", Y.export_number(value).alias("cell"))


QUERIES = {f.__name__: f for f in (
    statement_text_rows, ranked_text_rows, ifrs_notes, company_names, stored_repair, transcriptions, read_retries, read_passes, limitation_messages,
    model_coverage, risk_summaries, finding_fallbacks, page_unions, report_rows, registry_lookup, reanalysis, export_cells,
)}

_SHOWN = lambda name, *exprs: f"'в тысячах за период {name}'" + "".join(f" || ' | ' || replace(format('{{:,}}', {e}), ',', ' ')" for e in exprs)
_TEXT_ROWS = f"""o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS kind, floor(o_totalprice)::BIGINT + 1000 AS a, year(o_orderdate)::INTEGER AS y, o_custkey AS c FROM orders),
t AS (SELECT doc_id, 1 AS page, 'inventory' AS metric_key, '1210' AS code, (y - b)::INTEGER AS yr, (a + b)::DOUBLE AS val, 0.78::DOUBLE AS confidence, 'тыс. руб.' AS unit, {_SHOWN('Запасы 1210', 'a', 'a + 1', 'a + 2')} AS source_row FROM o, range(3) r(b) WHERE kind = 0
UNION ALL SELECT doc_id, 1, 'cash', '1250', (y - b)::INTEGER, (a * 2 + b)::DOUBLE, 0.62, 'тыс. руб.', {_SHOWN('Денежные средства и эквиваленты', 'a * 2', 'a * 2 + 1', 'a * 2 + 2')} FROM o, range(3) r(b) WHERE kind = 0
UNION ALL SELECT doc_id, 1, 'revenue', '2110', (y - b)::INTEGER, (a * 3 + b)::DOUBLE, 0.78, 'тыс. руб.', {_SHOWN('Выручка 2110', 'a * 3', 'a * 3 + 1')} FROM o, range(2) r(b) WHERE kind = 1
UNION ALL SELECT doc_id, 1, 'cogs', '2120', (y - b)::INTEGER, -(a + b)::DOUBLE, 0.78, 'тыс. руб.', {_SHOWN('Себестоимость продаж 2120', 'a', 'a + 1')} FROM o, range(2) r(b) WHERE kind = 1)"""
_RAS = "(document_type = 'bank_ras_financial_statements' OR standard = 'РСБУ' OR coded >= 8)"
ORACLE_SQL = {
    "statement_text_rows": f"WITH {_TEXT_ROWS} SELECT * FROM t",
    "ranked_text_rows": f"""WITH {_TEXT_ROWS}, own AS (SELECT doc_id, 'inventory' AS metric_key, y AS yr, c::DOUBLE AS val, 0.98::DOUBLE AS confidence FROM o WHERE c % 5 = 0 AND kind = 0)
SELECT * FROM own UNION ALL SELECT doc_id, metric_key, yr, val, confidence FROM t WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = t.doc_id AND own.metric_key = t.metric_key)""",
    "ifrs_notes": """WITH c AS (SELECT c_custkey AS doc_id, floor(abs(c_acctbal))::BIGINT + 10000 AS a FROM customer),
d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Depreciation ' || a * 2 || ' ' || (a * 2 + 7) WHEN 1 THEN 'Depreciation (' || a * 2 || ') (' || (a * 2 + 7) || ')' ELSE 'Depreciation 2020 ' || a * 2 || ',5 2019 ' || (a * 2 + 7) || ',5' END AS line FROM c)
SELECT doc_id, 'depreciation_amortization' AS metric_key, 2 AS page, (2020 - b)::INTEGER AS yr, (CASE WHEN doc_id % 3 = 1 THEN -1 ELSE 1 END * (a * 2 + 7 * b) + CASE WHEN doc_id % 3 = 2 THEN 0.5 ELSE 0 END)::DOUBLE AS val,
  'тыс. руб.' AS unit, 0.97::DOUBLE AS confidence, line AS source_row FROM d, range(2) r(b)
UNION ALL SELECT doc_id, 'interest_expense', 2, (2020 - b)::INTEGER, -(a + b)::DOUBLE, 'тыс. руб.', 0.97, 'Процентный расход ' || a || ' ' || (a + 1) FROM c, range(2) r(b) WHERE doc_id % 2 = 0""",
    "company_names": """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'ПАО «' || c_name || '»' WHEN 1 THEN 'ООО «' || c_name || '»' WHEN 2 THEN 'Group ' || c_name ELSE 'Не определено' END AS company FROM customer""",
    "stored_repair": f"""WITH m AS (SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 4 <> 0) AS coded FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS doc_id, CASE c_custkey % 7 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'bank_ras_financial_statements' ELSE 'corporate_document' END AS document_type,
  CASE WHEN c_custkey % 5 = 0 THEN 'РСБУ' ELSE 'МСФО' END AS standard, 'ПАО «Клиент' || c_custkey || '» отчетность.pdf' AS filename, CASE WHEN c_custkey % 2 = 0 THEN 'ПАО «Клиент' || c_custkey || '»' ELSE c_name END AS company FROM customer)
SELECT doc_id, CASE WHEN {_RAS} AND document_type <> 'bank_ras_financial_statements' THEN 'ras_financial_statements' ELSE document_type END AS document_type,
  CASE WHEN {_RAS} THEN 'РСБУ' ELSE standard END AS standard, CASE WHEN {_RAS} THEN 'Отдельное юридическое лицо' END AS scope, company, filename, {_RAS} AS is_ras
FROM (SELECT r.*, coalesce(coded, 0) AS coded FROM r LEFT JOIN m USING (doc_id))""",
    "transcriptions": """SELECT l_orderkey AS doc_id, l_linenumber::INTEGER AS page, CASE WHEN l_suppkey % 3 = 0 THEN 'revenue' ELSE 'assets' END AS metric_key, year(l_shipdate)::INTEGER AS yr, count(*) AS n, sum(l_quantity::INTEGER)::DOUBLE AS total
FROM lineitem WHERE l_suppkey % 3 < 2 AND l_linenumber < 7 AND l_partkey % 4 <> 0 AND l_partkey % 6 <> 1 AND l_linenumber <= 1 + l_orderkey % 4 GROUP BY ALL""",
    "read_retries": """SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS attempt FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 3 DESC, l_suppkey % 2 DESC, l_quantity::INTEGER DESC, l_partkey % 10 DESC, l_linenumber) = 1""",
    "read_passes": """SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS attempt FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INTEGER DESC, l_partkey % 10 DESC, l_suppkey % 10 DESC, l_linenumber) = 1""",
    "limitation_messages": f"""WITH d AS (SELECT l_orderkey AS doc_id, {', '.join(_FEATURES)} FROM lineitem GROUP BY l_orderkey)
SELECT doc_id, 0 AS ord, 'low_ocr_quality' AS rule_id FROM d WHERE ocr_pages > 0 AND ocr_quality < 60
UNION ALL SELECT doc_id, 1, 'ocr_first_pages' FROM d WHERE text_pages < 7 AND scan_only UNION ALL SELECT doc_id, 2, 'ocr_off' FROM d WHERE text_pages < 7 AND NOT scan_only AND NOT ocr_enabled
UNION ALL SELECT doc_id, 3, 'no_full_statements' FROM d WHERE document_type = 'annual_report' AND (elsewhere OR candidates < 5)
UNION ALL SELECT doc_id, 4, 'ifrs_incomplete' FROM d WHERE document_type = 'ifrs_financial_statements' AND primary_metrics < 12
UNION ALL SELECT doc_id, 5, 'ocr_names_hidden' FROM d WHERE scan_only AND operational = 0 UNION ALL SELECT doc_id, 6, 'no_tables' FROM d WHERE tables = 0 AND NOT scan_only""",
    "page_unions": """SELECT doc_id, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM (SELECT DISTINCT l_orderkey AS doc_id, unnest([l_linenumber, l_linenumber + 1]) AS p FROM lineitem) GROUP BY doc_id""",
    "report_rows": """SELECT p_size % 50 AS doc_id, p_partkey AS ord, p_name AS name FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 2 = 0 AND len(regexp_extract_all(p_name, '[A-Za-z]{3,}')) >= 2""",
    "registry_lookup": """SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n_events FROM events
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY user_id""",
    "reanalysis": f"""SELECT * FROM ({STATEMENTS['ratios_industrial']}) WHERE doc_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "export_cells": """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN replace(format('{:,}', floor(l_extendedprice)::BIGINT), ',', ' ')
  WHEN 1 THEN CASE WHEN l_extendedprice = floor(l_extendedprice) THEN replace(format('{:,}', floor(l_extendedprice)::BIGINT), ',', ' ') ELSE replace(format('{:,.2f}', l_extendedprice::DOUBLE), ',', ' ') END ELSE '—' END AS cell FROM lineitem""",
    "risk_summaries": f"""WITH f AS ({STATEMENTS['risk_numeric']}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS turn FROM f)
SELECT doc_id, turn::INTEGER AS ord, code AS codes FROM n WHERE turn <= 3 UNION ALL SELECT DISTINCT doc_id, 100, 'sanctions,cyber' FROM f""",
    "finding_fallbacks": f"""WITH r AS ({STATEMENTS['ratios_industrial']}), f AS (SELECT DISTINCT doc_id, section FROM ({findings_queries.ORACLE_SQL['findings']}) WHERE doc_id % 2 = 0),
s AS (SELECT doc_id, CASE WHEN status = 'good' THEN 'strengths' WHEN status IN ('bad', 'warn') THEN 'weaknesses' END AS section, ratio_key FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY ratio_key) AS ord FROM s WHERE section IS NOT NULL QUALIFY ord <= 4),
a AS (SELECT doc_id, section FROM (SELECT DISTINCT doc_id FROM r), (VALUES ('strengths'), ('weaknesses')) v(section) WHERE (doc_id, section) NOT IN (SELECT (doc_id, section) FROM f))
SELECT a.doc_id, a.section, coalesce(ord, 1)::INTEGER AS ord, coalesce(ratio_key, 'default') AS rule_id FROM a LEFT JOIN k ON k.doc_id = a.doc_id AND k.section = a.section""",
}
ORACLE_SQL["model_coverage"] = f"""WITH r AS ({STATEMENTS['ratios_industrial']}), n AS (SELECT doc_id, count(*) AS c FROM r WHERE status <> 'na' GROUP BY doc_id),
m AS (WITH {FX_SQL} SELECT doc_id, count(DISTINCT metric_key) AS verified_metrics, string_agg(DISTINCT yr::VARCHAR, ',' ORDER BY yr::VARCHAR) AS years FROM fx_facts GROUP BY doc_id)
SELECT m.doc_id, verified_metrics, coalesce(c, 0) AS calculated_ratios, years FROM m LEFT JOIN n USING (doc_id)"""
