"""Statement-shaped inputs derived from the star-schema tables: a nation is a document, an order year a reporting year.

The expressions are plain SQL that Spark and DuckDB read alike, so the queries and
the SQL they are checked against start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written

#: Sums over the lines of a document and year.
SUMS = {
    "revenue": "sum(ext*(1-disc))",
    "cogs": "-sum(ext*0.55)",
    "commercial_expenses": "-sum(ext*tax)",
    "inventory": "sum(CASE WHEN ls='O' THEN ext*0.2 ELSE 0 END)",
    "receivables": "sum(CASE WHEN rf='N' THEN ext*0.3 ELSE 0 END)",
    "cash": "sum(CASE WHEN rf='A' THEN ext*0.1 ELSE 0 END)",
    "noncurrent_assets": "sum(ext*0.8)",
    "current_liabilities": "sum(CASE WHEN rf='R' THEN ext*0.6 ELSE ext*0.1 END)",
    "longterm_liabilities": "sum(CASE WHEN ls='F' THEN ext*0.5 ELSE ext*0.05 END)",
    "operating_cash_flow": "sum(CASE WHEN rf='R' THEN -ext*0.4 ELSE ext*0.3 END)",
    "capex": "-sum(ext*0.06)",
    "interest_expense": "-sum(ext*0.02)",
    "depreciation_amortization": "-sum(ext*0.04)",
}
#: Amounts computed from those; assets are misstated in every fifth document, every seventh has a loss.
AMOUNTS = {
    "current_assets": "inventory+receivables+cash",
    "assets": "(noncurrent_assets+inventory+receivables+cash)*CASE WHEN doc_id % 5 = 0 THEN 1.10 ELSE 1.0 END",
    "equity": "noncurrent_assets+inventory+receivables+cash-longterm_liabilities-current_liabilities",
    "gross_profit": "revenue+cogs",
    "net_profit": "(revenue+cogs+commercial_expenses)*CASE WHEN doc_id % 7 = 0 THEN -0.2 ELSE 0.8 END",
    "operating_profit": "revenue+cogs+commercial_expenses",
}
#: The same lines read as a bank's statement.
BANK_SUMS = {
    "assets": "sum(ext)",
    "equity": "sum(ext*disc*2)",
    "net_profit": "sum(ext*tax*0.3)",
    "bank_customer_loans": "sum(CASE WHEN ls='O' THEN ext*0.9 ELSE ext*0.5 END)",
    "bank_customer_funds": "sum(ext*0.8)",
    "bank_operating_expenses": "-sum(ext*tax)",
    "bank_net_operating_income": "sum(ext*0.09)",
    "bank_credit_loss_charge": "-sum(CASE WHEN rf='R' THEN ext*0.06 ELSE 0 END)",
    "bank_net_interest_income": "sum(ext*disc)",
    "bank_fee_income": "sum(CASE WHEN rf='A' THEN ext*0.05 ELSE ext*0.01 END)",
}
METRICS = [*SUMS, *AMOUNTS]


def _exact(sums: dict[str, str]) -> dict[str, str]:
    """Sums of whole ten-thousandths, so that no order of rows changes them."""
    parts = {k: e[:-1].split("sum(", 1) for k, e in sums.items()}
    return {k: f"{sign}CAST(sum(CAST(floor(({x})*10000 + 0.5) AS BIGINT)) AS DOUBLE)/10000" for k, (sign, x) in parts.items()}


SUMS, BANK_SUMS = _exact(SUMS), _exact(BANK_SUMS)
#: (seq, source_type, confidence, unit, multiplier, row_code) of competing readings.
READINGS = [
    (1, "pdf_text", 0.55, "тыс. руб.", 1.0, None),
    (2, "ras_coordinate_ocr", 0.95, "тыс. руб.", 1.0, "2110"),
    (3, "spreadsheet", 0.98, "млн руб.", 0.001, None),
    (4, "ifrs_disclosure_note", 0.97, "тыс. руб.", 1.0, None),
    (5, "ocr_coordinate_table", 0.80, "тыс. руб.", 1.0, None),
]
_LINES = (
    "c_nationkey AS doc_id, year(o_orderdate) AS yr, l_returnflag AS rf, l_linestatus AS ls, "
    "l_extendedprice AS ext, l_discount AS disc, l_tax AS tax"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out over all cores where their files are fewer than these; large tables have splits enough and stay.

    They are written, as filters of later steps would else be moved before the exchange, where the few splits are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return written(rows.repartition(cores), "spread") if rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str, key: str = "c_nationkey") -> DataFrame:
    """Order lines, a document a nation or, with key c_custkey, a customer."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*_LINES.replace("c_nationkey", key).split(", "))


def _long(wide: DataFrame, metrics: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return wide.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"stack({len(metrics)}, {pairs}) AS (metric_key, val)", "yr").select("doc_id", "metric_key", "yr", "val")


def facts(spark: SparkSession, sf_dir: str, key: str = "c_nationkey", several: bool = False) -> DataFrame:
    """(doc_id, metric_key, yr, val): 19 amounts of every document and year; several: they are read more than once."""
    wide = lines(spark, sf_dir, key).groupBy("doc_id", "yr").agg(*[F.expr(e).alias(k) for k, e in SUMS.items()])
    wide = written(wide, "facts") if several else wide
    return _long(wide.select("*", *[F.expr(e).alias(k) for k, e in AMOUNTS.items()]), METRICS)


def bank_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = lines(spark, sf_dir).groupBy("doc_id", "yr").agg(*[F.expr(e).alias(k) for k, e in BANK_SUMS.items()])
    return _long(wide, list(BANK_SUMS))


def candidates(spark: SparkSession, sf_dir: str, key: str = "c_nationkey") -> DataFrame:
    """(doc_id, branch, metric_key, seq, source_type, confidence, unit, row_code, yr, val): five readings of each fact.

    Reading 2 fails the consistency gate in some documents, 4 is an outlier, 5 a single year.
    """
    rows = [f"struct({s} AS seq, '{t}' AS source_type, {c}D AS confidence, '{u}' AS unit, {m}D AS mult, {'NULL' if r is None else repr(r)} AS row_code)" for s, t, c, u, m, r in READINGS]
    readings = F.expr(f"inline(array({', '.join(rows)}))")
    one = facts(spark, sf_dir, key).select("*", readings)
    one = one.where("(seq <> 4 OR (doc_id % 6 = 1 AND yr = 1997)) AND (seq <> 5 OR yr = 1996)")
    value = "val * mult * CASE WHEN seq = 2 AND doc_id % 3 = 0 AND yr = 1998 THEN 1000 WHEN seq = 4 THEN 200 ELSE 1 END"
    return one.selectExpr("doc_id", "'ras' AS branch", "metric_key", "seq", "source_type", "confidence", "unit", "row_code", "yr", f"{value} AS val")


def _sums_sql(sums: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in sums.items())


def _union_sql(source: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric_key, yr, {m} AS val FROM {source}" for m in metrics)


_READINGS_SQL = ", ".join(f"({s}, '{t}', {c}::DOUBLE, '{u}', {m}::DOUBLE, {'NULL' if r is None else repr(r)})" for s, t, c, u, m, r in READINGS)
#: Common table expressions with the same rows; a query goes on with WITH {FX_SQL}, ...
FX_SQL = f"""fx_lines AS (
  SELECT {_LINES.replace("c_nationkey AS doc_id", "c_nationkey::BIGINT AS doc_id")} FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
fx_wide AS MATERIALIZED (SELECT doc_id, yr::INTEGER AS yr, {_sums_sql(SUMS)} FROM fx_lines GROUP BY doc_id, yr),
fx_stmt AS (SELECT *, {_sums_sql(AMOUNTS)} FROM fx_wide),
fx_facts AS MATERIALIZED ({_union_sql("fx_stmt", METRICS)}),
fx_candidates AS MATERIALIZED (
  SELECT f.doc_id, 'ras' AS branch, f.metric_key, s.seq, s.source_type, s.confidence, s.unit, s.row_code, f.yr,
    f.val * s.mult * CASE WHEN s.seq = 2 AND f.doc_id % 3 = 0 AND f.yr = 1998 THEN 1000 WHEN s.seq = 4 THEN 200 ELSE 1 END AS val
  FROM fx_facts f CROSS JOIN (VALUES {_READINGS_SQL}) AS s(seq, source_type, confidence, unit, mult, row_code)
  WHERE (s.seq <> 4 OR (f.doc_id % 6 = 1 AND f.yr = 1997)) AND (s.seq <> 5 OR f.yr = 1996))"""
BANK_SQL = f"""fx_lines AS (
  SELECT {_LINES.replace("c_nationkey AS doc_id", "c_nationkey::BIGINT AS doc_id")} FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
fx_wide AS MATERIALIZED (SELECT doc_id, yr::INTEGER AS yr, {_sums_sql(BANK_SUMS)} FROM fx_lines GROUP BY doc_id, yr),
fx_facts AS MATERIALIZED ({_union_sql("fx_wide", list(BANK_SUMS))})"""
