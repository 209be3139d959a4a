"""Queries over scanned pages: tables below years, forms of banks, primary statements.

Line items and customers are laid out as positioned words; the SQL knows what was laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, text_jobs
from ..operators.page_tables import page_tables as tables_of
from .fixtures import spread, table


def _word(line_no: str, word_no: int, left: float, text: str | Column, top: str, width: float = 40.0) -> Column:
    """One word at a place; its line and top are SQL expressions, its text a column or a literal."""
    said = F.lit(text) if isinstance(text, str) else text.cast("string")
    return F.struct(
        F.expr(f"cast({line_no} AS bigint)").alias("line_no"), F.lit(word_no).alias("word_no"), said.alias("text"), F.lit(float(left)).alias("left"),
        F.expr(f"cast({top} AS double)").alias("top"), F.lit(float(width)).alias("width"),
    )


def _laid(rows: DataFrame, cells: list[Column], conf: str) -> DataFrame:
    """Words of rows, without those of null text."""
    said = rows.select("doc_id", "page", F.expr(f"cast({conf} AS double)").alias("conf"), F.explode(F.array(*cells)).alias("w"))
    return said.select("doc_id", "page", "conf", "w.*", F.lit(12.0).alias("height")).where("text IS NOT NULL")


#: A line item on a page of its order: v is made of its price and is no line code, later items of every third order stand below other years.
_ITEMS = [
    "l_orderkey AS doc_id", "1 AS page", "l_linenumber * 10000000000000 + l_partkey * 1000000 + cast(floor(l_extendedprice) AS bigint) AS line_no", "l_linenumber AS n",
    "cast(floor(l_extendedprice) AS bigint) + 10000 AS v", "l_orderkey % 4 = 1 AS form", "l_partkey % 7 = 0 AS single", "l_suppkey % 5 = 0 AS wild", "l_returnflag AS flag",
]


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page an order: a line of two years, a row an item; every fourth order is a form with line codes."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")).selectExpr(*_ITEMS)
    when = lambda condition, text: F.expr(f"CASE WHEN {condition} THEN {text} END")
    body = _laid(items, [
        _word("line_no", 0, 0, "Goods", "n * 20"), _word("line_no", 1, 60, F.col("flag"), "n * 20"), _word("line_no", 2, 200, when("form", "CASE WHEN n % 2 = 1 THEN '1210' ELSE '1230' END"), "n * 20"),
        _word("line_no", 3, 330, F.expr("v div 1000"), "n * 20"), _word("line_no", 4, 380, F.expr("lpad(v % 1000, 3, '0')"), "n * 20"),
        _word("line_no", 5, 650, when("NOT single", "concat('(', v * IF(wild, 100, 2), ')')"), "n * 20", 80),
    ], "90")
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "1 AS page", "40 + o_orderkey % 50 AS ocr_quality", "o_orderkey % 3 = 0 AS again")
    heads = _laid(orders, [
        _word("0", 0, 380, "2023", "0"), _word("0", 1, 680, "2022", "0"),
        _word("25000000000000", 0, 380, when("again", "'2021'"), "50"), _word("25000000000000", 1, 680, when("again", "'2020'"), "50"),
    ], "90")
    return tables_of(body.unionByName(heads), orders).drop("page")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).selectExpr("c_custkey AS doc_id", "1 AS page", "c_custkey AS k", "cast(floor(abs(c_acctbal)) AS bigint) + 10000 AS a")


def _pair(line_no: int, top: float, first: str, second: str, lefts: tuple[float, float]) -> list[Column]:
    return [_word(str(line_no), 8 + i, left, F.expr(f"cast({v} AS string)"), str(top), 60) for i, (left, v) in enumerate(zip(lefts, (first, second)))]


def _said(line_no: int, top: float, label: str) -> list[Column]:
    return [_word(str(line_no), i, i * 70, text, str(top), 60) for i, text in enumerate(label.split())]


def bank_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two public forms a bank: amounts below their label, beside it, or on a surer line just below; every tenth total is beyond belief."""
    banks, right = _customers(spark, sf_dir), (600, 800)
    near = _said(3, 400, "24 Всего обязательств") + _pair(3, 400, "a", "a + 1", right)
    # two words of one amount, which is no row number
    other = [_word("4", 0, 600, "1", "403", 10), _word("4", 1, 615, "984", "403", 30), _word("4", 2, 800, "77", "403", 60)]
    first = _said(1, 0, "14 Всего активов") + _pair(2, 30, "IF(k % 10 = 0, 600000000000, a * 2)", "a", right)
    second = _said(1, 0, "21 Операционные расходы") + _pair(1, 0, "a", "a * 3", right) + _said(3, 200, "26 Прибыль за отчетный период") + _pair(3, 200, "concat('+', a)", "a + 9", right)
    words = _laid(banks, first + near, "60 + k % 5").unionByName(_laid(banks, other, "60 + k % 17")).unionByName(_laid(banks.withColumn("page", F.lit(2)), second, "60 + k % 5"))
    pages = banks.selectExpr("doc_id", "inline(array(struct(1 AS page, 'Код формы 0409806' AS text), struct(2 AS page, 'Код формы 0409807' AS text)))")
    return layout.bank_rows(words, pages)


def _statement(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(words, pages) of a balance a customer; every fourth states its cash beside the label, and all state assets left of the columns.

    Every fifth has no year columns.
    """
    at, when, headed = (300, 500), "IF(k % 4 = 0, {0}, NULL)", "IF(k % 5 = 0, NULL, {0})"
    cells = [
        *_pair(0, 0, headed.format("2024"), headed.format("2023"), at), *_said(0, 0, "Balance"), *_said(1, 30, "Current assets"), *_said(2, 60, "Запасы"), *_pair(2, 60, "a", "a + 1", at),
        *_said(3, 90, "Денежные средства и их эквиваленты"), *_pair(3, 90, when.format("a + 5"), when.format("a + 6"), at), *_pair(4, 120, "a + 2", "a + 3", at),
        *_said(5, 150, "Non-current assets"), *_pair(6, 180, "a * 2", "a * 2 + 1", at), *_said(7, 210, "Итого активы"), *_pair(7, 210, "a * 3", "a * 3 + 1", (160, 200)),
        *_said(8, 240, "Total liabilities and equity"), *_pair(8, 240, "a * 3", "a * 3 + 1", at),
    ]
    owners = _customers(spark, sf_dir)
    return _laid(owners, cells, "60 + k % 30"), owners.select("doc_id", "page", F.lit("Consolidated statement of financial position, in millions of roubles").alias("text"))


def ifrs_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, pages = _statement(spark, sf_dir)
    rows = layout.lines(words)
    return layout.ifrs_rows(rows, layout.line_values(words, rows, F.lit(2024)), pages, layout.year_columns(words, F.lit(2024)))


def ifrs_section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, _ = _statement(spark, sf_dir)
    rows = layout.lines(words)
    return layout.ifrs_subtotals(rows, layout.line_values(words, rows, F.lit(2024))).drop("page")


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a customer: two labels with years and amounts in running text, between them a line that is none."""
    text = F.concat(
        F.lit("Revenue total 2024 "), F.col("a"), F.lit(" 2023 -"), F.expr("a + 7"), F.lit("\nдалее 2024 год\nЗапасы, тыс. руб. 2024 1 234,5 2023 "), F.expr("a * 2"), F.lit("\n")
    )
    return text_jobs.text_metrics(_customers(spark, sf_dir).select("doc_id", "page", text.alias("text"))).drop("page")


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages a customer; the first lists statements, one beyond the document, one only in every third."""
    lines = ["'Contents'", "'Consolidated statement of financial position .... 2'", "'Balance sheet 99'", "'Notes 3'", "IF(k % 3 = 0, 'Statement of cash flows 3', 'Income statement 3')"]
    pages = _customers(spark, sf_dir).drop("page").select("doc_id", F.expr(f"concat_ws('\n', {', '.join(lines)})").alias("first"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    return text_jobs.contents_pages(pages.select("doc_id", "page", F.when(F.col("page") == 1, F.col("first")).alias("text")))


QUERIES = {f.__name__: f for f in (page_tables, bank_forms, ifrs_statements, ifrs_section_totals, text_metrics, contents_pages)}

_A = "a AS (SELECT c_custkey AS doc_id, c_custkey AS k, floor(abs(c_acctbal))::BIGINT + 10000 AS a FROM customer)"
ORACLE_SQL = {
    "page_tables": """WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT * 10000000000000 + l_partkey * 1000000 + floor(l_extendedprice)::BIGINT AS line_no, floor(l_extendedprice)::BIGINT + 10000 AS v,
  l_orderkey % 4 = 1 AS form, l_linenumber % 2 AS odd, l_partkey % 7 = 0 AS single, l_suppkey % 5 = 0 AS wild, l_returnflag AS flag, l_orderkey % 3 = 0 AND l_linenumber >= 3 AS late FROM lineitem),
f AS (SELECT doc_id, form AND count(DISTINCT odd) = 2 AS is_form FROM i GROUP BY doc_id, form),
r AS (SELECT i.doc_id, line_no, CASE WHEN form THEN CASE odd WHEN 1 THEN '1210' ELSE '1230' END END AS code, is_form, v, single, wild,
  CASE WHEN NOT form THEN 'Goods ' || flag WHEN odd = 1 THEN 'Запасы' ELSE 'Дебиторская задолженность' END AS label, CASE WHEN late THEN 25000000000000 ELSE 0 END AS header_line,
  CASE WHEN late THEN 2021 ELSE 2023 END AS yr, row_number() OVER (PARTITION BY i.doc_id, late ORDER BY line_no) AS place FROM i JOIN f ON i.doc_id = f.doc_id),
k AS (SELECT * FROM r WHERE place <= 54 AND (single AND NOT is_form OR NOT single AND NOT wild) QUALIFY row_number() OVER (PARTITION BY doc_id, header_line, label, v, single ORDER BY line_no) = 1),
t AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, header_line) >= 2),
b AS (SELECT * FROM t QUALIFY header_line = min(header_line) OVER (PARTITION BY doc_id)),
q AS (SELECT o_orderkey AS doc_id, 40 + o_orderkey % 50 AS q FROM orders)
SELECT doc_id, header_line, line_no, code, label, yr + d AS yr, (CASE d WHEN 0 THEN v ELSE -2 * v END)::DOUBLE AS val, round(least(0.92::DOUBLE, 0.55::DOUBLE + q / 250.0::DOUBLE), 2) AS confidence
FROM b JOIN q USING (doc_id), (VALUES (0), (-1)) AS y(d) WHERE q >= 48 AND (d = 0 OR NOT single)""",
    "bank_forms": f"""WITH {_A} SELECT doc_id, 'assets' AS metric_key, '0409806' AS form, '14' AS row_code, a * 2.0::DOUBLE AS first, a::DOUBLE AS second, 235.0::DOUBLE + k % 5 AS score FROM a WHERE k % 10 <> 0
UNION ALL SELECT doc_id, 'liabilities', '0409806', '24', CASE WHEN w THEN 1984 ELSE a END::DOUBLE, CASE WHEN w THEN 77 ELSE a + 1 END::DOUBLE, 235.0::DOUBLE + CASE WHEN w THEN k % 17 ELSE k % 5 END FROM (SELECT *, k % 17 - k % 5 > 10 AS w FROM a)
UNION ALL SELECT doc_id, 'bank_operating_expenses', '0409807', '21', -a::DOUBLE, -3.0::DOUBLE * a, 235.0::DOUBLE + k % 5 FROM a
UNION ALL SELECT doc_id, 'net_profit', '0409807', '26', a::DOUBLE, (a + 9)::DOUBLE, 235.0::DOUBLE + k % 5 FROM a""",
    "ifrs_statements": f"""WITH {_A}, r AS (SELECT doc_id, k, 'inventory' AS metric_key, a::DOUBLE AS first, (a + 1)::DOUBLE AS second, 380.0::DOUBLE AS score, 'Запасы ' || a || ' ' || (a + 1) AS source_row FROM a
UNION ALL SELECT doc_id, k, 'assets', 3.0::DOUBLE * a, 3.0::DOUBLE * a + 1, 380.0::DOUBLE, 'Итого активы ' || a * 3 || ' ' || (a * 3 + 1) FROM a
UNION ALL SELECT doc_id, k, 'cash', (CASE WHEN k % 4 = 0 THEN a + 5 ELSE a END)::DOUBLE, (CASE WHEN k % 4 = 0 THEN a + 6 ELSE a + 1 END)::DOUBLE, CASE WHEN k % 4 = 0 THEN 380.0::DOUBLE ELSE 280 END,
  'Денежные средства и их эквиваленты' || CASE WHEN k % 4 = 0 THEN ' ' || (a + 5) || ' ' || (a + 6) ELSE '' END FROM a)
SELECT doc_id, metric_key, first, second, score + k % 30 - CASE WHEN k % 5 = 0 THEN 20 ELSE 0 END AS score, 1 AS page, 'млн руб.' AS unit, 0.98::DOUBLE AS confidence, source_row FROM r""",
    "text_metrics": f"""WITH {_A} SELECT doc_id, label, yr, v::DOUBLE AS val FROM (SELECT doc_id, unnest([
  {{'label': 'Revenue total', 'yr': 2024, 'v': a::DOUBLE}}, {{'label': 'Revenue total', 'yr': 2023, 'v': -(a + 7)::DOUBLE}},
  {{'label': 'Запасы, тыс. руб.', 'yr': 2024, 'v': 1234.5::DOUBLE}}, {{'label': 'Запасы, тыс. руб.', 'yr': 2023, 'v': a * 2.0::DOUBLE}}], recursive := true) FROM a)""",
    "contents_pages": f"WITH {_A} SELECT doc_id, 2 AS target FROM a UNION ALL SELECT doc_id, 3 FROM a WHERE k % 3 = 0",
    "ifrs_section_totals": f"""WITH {_A} SELECT doc_id, 'current_assets' AS metric_key, 4::BIGINT AS line_no, (a + 2)::DOUBLE AS first, (a + 3)::DOUBLE AS second FROM a
UNION ALL SELECT doc_id, 'noncurrent_assets', 6, 2.0::DOUBLE * a, 2.0::DOUBLE * a + 1 FROM a""",
}
