"""Queries over tables and positioned words that orders and line items stand in for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import EXCLUSIONS, SYNONYMS
from ..operators import layout, tables
from .fixtures import spread, table

#: Row labels by a number's remainder.
LABELS = ["Total assets", "Revenue, mln", "Cash and cash equivalents", "Net profit", "Wells drilled", "Cost of sales", "Доказанные запасы углеводородов", "Запасы, млн руб."]
_CODES = ["2110", "2120", "1600", "2400", "none", "2210", "0000", "1210"]


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as one table: a header with two years and a comparison, then a row an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    label = F.get(F.array(*map(F.lit, LABELS)), (F.col("k") % 8).cast("int"))
    code = F.get(F.array(*map(F.lit, _CODES)), (F.col("k") % 8).cast("int"))
    cell = lambda v: F.translate(F.format_number(v, 2), ",.", " ,")
    body = orders.select("doc_id", F.col("k").alias("row_no"), F.array(label, code, cell(F.col("p")), F.concat(F.lit("("), cell(F.col("p") * 2), F.lit(")")), F.lit("5%")).alias("cells"))
    head = orders.select("doc_id").distinct().select("doc_id", F.lit(-1).cast("long").alias("row_no"), F.array(*map(F.lit, ["", "Код", "31.12.2024", "За год, закончившийся 2023", "Изменение 2024/2023"])).alias("cells"))
    return tables.clean_rows(head.unionByName(body).withColumn("table_id", F.lit(1)))


def year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_years(table_rows(spark, sf_dir)).select("doc_id", "header_row", "col", "yr")


def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a statement label beside them."""
    label = F.concat_ws(" ", F.get(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % 8).cast("int")), F.col("p_partkey").cast("string"))
    return tables.metric_keys(table(spark, sf_dir, "part").select(label.alias("label")))


def table_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.table_candidates(table_rows(spark, sf_dir))
    return found.groupBy("label", "metric_key", "unit", "confidence", "yr").agg(F.count("*").alias("n"), F.sum(F.col("val").cast("decimal(18,2)")).cast("double").alias("total"))


def ras_code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.coded_rows(table_rows(spark, sf_dir))
    return found.groupBy("code", "metric_key", "yr").agg(F.count("*").alias("n"), F.sum(F.col("val").cast("decimal(18,2)")).cast("double").alias("total"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item's price as one word: an order is a document, its items lie side by side on two lines."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return items.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") % 2).cast("int").alias("line_no"), (F.col("l_linenumber") * F.lit(10**13) + F.col("l_partkey") * 1000000 + F.floor("l_extendedprice")).alias("word_no"),
        F.floor("l_extendedprice").cast("string").alias("text"), (F.col("l_linenumber") * 60.0 + F.col("l_partkey") % 40).alias("left"),
        ((F.col("l_linenumber") % 2) * 30.0 + F.col("l_partkey") % 7).alias("top"), F.lit(40.0).alias("width"), F.lit(12.0).alias("height"), (50 + F.col("l_quantity")).alias("conf"),
    )


def number_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.amounts(_words(spark, sf_dir), 48, 1.8).select("doc_id", "line_no", "grp", "value", "n_digits")


def widest_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.widest_amount(layout.amounts(_words(spark, sf_dir), 45, 1.8)).select("doc_id", "line_no", "value")


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(_words(spark, sf_dir), 60).select("doc_id", "line_no", "text", "top", F.round("conf", 6).alias("conf"))


def row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    rows = words.select("doc_id", "page", F.col("word_no").alias("line_no"), "text", F.col("top") + F.col("left") / 30, "left").toDF("doc_id", "page", "line_no", "text", "top", "left")
    return layout.row_clusters(rows).select("doc_id", "cluster", "n_lines", "text")


def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three year columns a page, and how many words and how much lies in each."""
    words = _words(spark, sf_dir)
    heads = words.select("doc_id", "page").distinct().select("doc_id", "page", F.explode(F.array(*[F.struct(F.lit(2023 + i).alias("yr"), F.lit(130.0 + 110 * i).alias("center")) for i in range(3)])).alias("h")).select("doc_id", "page", "h.*")
    found = layout.banded_words(words, layout.column_bands(heads))
    return found.groupBy("doc_id", "yr").agg(F.count("*").alias("n_words"), F.sum(F.col("text").cast("long")).alias("total"))


def anchor_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first item looks for the best other item within its band below."""
    words = _words(spark, sf_dir).withColumn("at", F.floor(F.col("word_no") / 10**13) * 55.0 + F.col("top"))
    anchors = words.where("word_no < 20000000000000").select("doc_id", "page", F.col("word_no").alias("anchor_id"), F.col("at").alias("top"))
    values = words.where("word_no >= 20000000000000").select("doc_id", "page", F.col("word_no").alias("line_no"), F.col("at").alias("top"), "conf", F.col("text").cast("double").alias("first"), F.col("left").alias("second"))
    return layout.anchored_values(anchors, values).select("doc_id", "anchor_id", "value_line", "first", F.round("score", 6).alias("score"))


_LINES = [("Выручка", "2110"), ("Себестоимость продаж", "2120"), ("Запасы", "1210"), ("Баланс", "1600")]


def ras_ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as statement lines: label, code and two amounts; an order is a page."""
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    kind = F.get(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(c).alias("code")) for a, c in _LINES]), (F.col("l_linenumber") % 4).cast("int"))
    cents = F.floor(F.col("l_extendedprice") * 100)
    word = lambda n, left, text: F.struct(F.lit(n).alias("word_no"), F.lit(float(left)).alias("left"), text.cast("string").alias("text"))
    cells = F.array(word(0, 0, kind["label"]), word(1, 250, kind["code"]), word(2, 350, cents), word(3, 600, cents * 2), word(4, 850, cents * 3))
    one = items.select(
        (F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * F.lit(10**13) + F.col("l_partkey") * 1000000 + F.floor("l_extendedprice")).alias("line_no"),
        (50 + F.col("l_quantity")).alias("conf"), F.explode(cells).alias("w"),
    )
    words = one.select("doc_id", "page", "line_no", "conf", "w.*", F.lit(0.0).alias("top"), F.lit(60.0).alias("width"), F.lit(12.0).alias("height"))
    return layout.ras_rows(words)


QUERIES = {f.__name__: f for f in (ras_ocr_rows, year_columns, label_keys, table_candidates, ras_code_rows, number_groups, widest_amounts, word_lines, row_clusters, column_bands, anchor_range_join)}

_CASE = lambda values: "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
# tables of one order have two rows and stay; none is over the cap
_ROWS = f"""r AS (SELECT o_custkey AS doc_id, o_orderkey AS k, round(o_totalprice, 2) AS p, round(o_totalprice * 2, 2) AS h, {_CASE(LABELS).replace('k % 8', 'o_orderkey % 8')} AS label, {_CASE(_CODES).replace('k % 8', 'o_orderkey % 8')} AS code FROM orders),
v AS (SELECT *, 2024 AS yr, p AS val FROM r UNION ALL SELECT *, 2023, -h FROM r)"""
_SYN = ", ".join(f"('{k}', '{s}', {i})" for i, (k, words) in enumerate(SYNONYMS.items()) for s in words)
_KEYED = f"""syn AS (SELECT * FROM (VALUES {_SYN}) AS s(metric_key, synonym, ord)),
hits AS (SELECT label, metric_key, row_number() OVER (PARTITION BY label ORDER BY length(synonym) DESC, ord) AS n FROM lab JOIN syn ON contains(lower(label), synonym)
  WHERE NOT ({' OR '.join(f"(metric_key = '{k}' AND regexp_matches(lower(label), '{'|'.join(words)}'))" for k, words in EXCLUSIONS.items())})),
best AS (SELECT label, metric_key FROM hits WHERE n = 1)"""
_WORDS = """w AS (SELECT l_orderkey AS doc_id, (l_linenumber % 2)::INTEGER AS line_no, (l_linenumber::BIGINT * 10000000000000 + l_partkey * 1000000 + floor(l_extendedprice)::BIGINT)::BIGINT AS word_no, floor(l_extendedprice)::BIGINT AS v, l_linenumber * 60.0::DOUBLE + l_partkey % 40 AS lft,
  (l_linenumber % 2) * 30.0::DOUBLE + l_partkey % 7 AS top, 50 + l_quantity AS conf FROM lineitem)"""
_ISLANDS = """g AS (SELECT *, lft - lag(lft + 40) OVER l AS gap FROM w WINDOW l AS (PARTITION BY doc_id, line_no ORDER BY lft, word_no)),
i AS (SELECT *, sum(CASE WHEN gap > {0} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY lft, word_no) AS grp FROM g),
a AS (SELECT doc_id, line_no, grp, string_agg(v::VARCHAR, '' ORDER BY lft, word_no) AS d, min(lft) AS lft FROM i GROUP BY doc_id, line_no, grp)"""
ORACLE_SQL = {
    "ras_ocr_rows": """WITH x AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey AS page, l_linenumber::BIGINT * 10000000000000 + l_partkey * 1000000 + floor(l_extendedprice)::BIGINT AS line_no, 50 + l_quantity AS conf, floor(l_extendedprice * 100) AS a,
  CASE l_linenumber % 4 WHEN 0 THEN '2110' WHEN 1 THEN '2120' WHEN 2 THEN '1210' ELSE '1600' END AS code FROM lineitem),
rich AS (SELECT page, CASE WHEN bool_or(code = '2110') THEN 'pnl' WHEN bool_or(code = '1600') THEN 'balance' END AS kind FROM x GROUP BY page HAVING count(DISTINCT code) >= 2)
SELECT doc_id, CASE code WHEN '2110' THEN 'revenue' WHEN '2120' THEN 'cogs' WHEN '1210' THEN 'inventory' ELSE 'assets' END AS metric_key, code,
  CASE WHEN code = '2120' THEN -a ELSE a END AS first, CASE WHEN code = '2120' THEN -2 * a ELSE 2 * a END AS second, CASE WHEN kind = 'balance' THEN 3 * a END AS third,
  120 + conf + CASE kind WHEN 'balance' THEN 30 ELSE 20 END AS score
FROM x JOIN rich USING (page) WHERE kind = CASE WHEN code < '2000' THEN 'balance' ELSE 'pnl' END QUALIFY row_number() OVER (PARTITION BY doc_id, code ORDER BY conf DESC, page, line_no) = 1""",
    "year_columns": "SELECT doc_id, 0 AS header_row, col, yr FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders), (VALUES (2, 2024), (3, 2023)) AS c(col, yr)",
    "label_keys": f"WITH lab AS (SELECT DISTINCT {_CASE(LABELS).replace('k % 8', 'p_partkey % 8')} || ' ' || p_partkey AS label FROM part), {_KEYED} SELECT label, metric_key FROM best",
    "table_candidates": f"""WITH {_ROWS}, lab AS (SELECT DISTINCT label FROM r), {_KEYED}
SELECT label, metric_key, CASE WHEN label LIKE '%млн руб.%' THEN 'млн руб.' END AS unit, 0.9::DOUBLE AS confidence, yr, count(*) AS n, sum(val::DECIMAL(18,2))::DOUBLE AS total FROM v LEFT JOIN best USING (label) GROUP BY ALL""",
    "ras_code_rows": f"""WITH {_ROWS}, c AS (SELECT * FROM (VALUES ('2110', 'revenue', false), ('2120', 'cogs', true), ('1600', 'assets', false), ('2400', 'net_profit', false), ('2210', 'commercial_expenses', true), ('1210', 'inventory', false)) AS c(code, metric_key, neg))
SELECT code, metric_key, yr, count(*) AS n, sum((CASE WHEN neg THEN -abs(val) ELSE val END)::DECIMAL(18,2))::DOUBLE AS total FROM v JOIN c USING (code) GROUP BY code, metric_key, yr""",
    "number_groups": f"WITH {_WORDS}, {_ISLANDS.format(48)} SELECT doc_id, line_no, grp::BIGINT AS grp, d::DOUBLE AS value, length(d)::INTEGER AS n_digits FROM a",
    "widest_amounts": f"WITH {_WORDS}, {_ISLANDS.format(45)} SELECT doc_id, line_no, arg_max(d, (length(d), lft))::DOUBLE AS value FROM a GROUP BY doc_id, line_no",
    "word_lines": f"WITH {_WORDS} SELECT doc_id, line_no, string_agg(v::VARCHAR, ' ' ORDER BY lft, word_no) AS text, min(top) AS top, round(avg(conf), 6) AS conf FROM w WHERE conf >= 60 GROUP BY doc_id, line_no",
    "row_clusters": f"""WITH RECURSIVE {_WORDS}, t AS (SELECT doc_id, word_no, v::VARCHAR AS text, lft, top + lft / 30 AS place, row_number() OVER (PARTITION BY doc_id ORDER BY top + lft / 30, lft, word_no) AS n FROM w),
f AS (SELECT *, 0 AS cluster, place AS anchor FROM t WHERE n = 1 UNION ALL
  SELECT t.*, CASE WHEN abs(t.place - f.anchor) > 12 THEN f.cluster + 1 ELSE f.cluster END, CASE WHEN abs(t.place - f.anchor) > 12 THEN t.place ELSE f.anchor END FROM f JOIN t ON t.doc_id = f.doc_id AND t.n = f.n + 1)
SELECT doc_id, cluster, count(*) AS n_lines, string_agg(text, ' ' ORDER BY lft, word_no, text) AS text FROM f GROUP BY doc_id, cluster HAVING count(*) >= 2""",
    "column_bands": f"WITH {_WORDS}, b AS (SELECT * FROM (VALUES (2023, 75.0, 185.0), (2024, 185.0, 295.0), (2025, 295.0, 405.0)) AS b(yr, lo, hi)) SELECT doc_id, yr, count(*) AS n_words, sum(v)::BIGINT AS total FROM w JOIN b ON lft + 20 >= lo AND lft + 20 < hi GROUP BY doc_id, yr",
    "anchor_range_join": f"""WITH {_WORDS}, p AS (SELECT *, word_no // 10000000000000 * 55.0::DOUBLE + top AS at FROM w), j AS (
  SELECT x.doc_id, x.word_no AS anchor_id, y.word_no AS value_line, y.v::DOUBLE AS first, 100 - 0.35::DOUBLE * abs(y.at - x.at) + 0.1::DOUBLE * y.conf AS score FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.word_no < 20000000000000 AND y.word_no >= 20000000000000 AND y.at - x.at BETWEEN -5 AND 140)
SELECT doc_id, anchor_id, value_line, first, round(score, 6) AS score FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, anchor_id ORDER BY j.score DESC, value_line) = 1""",
}
