"""Queries over a full model: amounts with debt, derived lines, then ratios, flags, score and findings as one plan.

A quarter of the documents tells no debt; there the liabilities stand for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model, ratios, risk
from ..operators.findings import wide
from . import statement_queries as S
from .fixtures import FX_SQL, facts

#: Debt components out of other amounts: (metric, of which, share), by document.
DEBT = [
    ("longterm_debt_component", "longterm_liabilities", "CASE WHEN doc_id % 3 = 0 THEN 3.0 ELSE 0.7 END"),
    ("shortterm_debt_component", "current_liabilities", "CASE WHEN doc_id % 3 = 0 THEN 2.5 ELSE 0.2 END"),
]


def full_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, metric_key, yr, val) of the fixture, with debt, and with what the derivations add."""
    row = lambda key, val: F.struct(key.alias("metric_key"), val.alias("val"))
    debt = [
        F.when((F.col("metric_key") == of) & (F.col("doc_id") % 4 != 0), row(F.lit(key), F.col("val") * F.expr(share).cast("double")))
        for key, of, share in DEBT
    ]
    rows = F.array_compact(F.array(row(F.col("metric_key"), F.col("val")), *debt))
    given = facts(spark, sf_dir).select("doc_id", "yr", F.explode(rows).alias("x")).select(
        "doc_id", F.lit("ras").alias("branch"), "x.metric_key", "yr", "x.val", F.lit(0.9).alias("confidence"))
    return model.derived(given).select("doc_id", "metric_key", "yr", "val")


def full_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratios.ratios(full_facts(spark, sf_dir))
    return found.select("doc_id", "ratio_key", F.round("value", 6).alias("value"), "status", "cur_year", "prev_year")


def full_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.numeric_flags(wide(full_facts(spark, sf_dir)))


def full_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = full_facts(spark, sf_dir)
    return risk.scores(ratios.ratios(known), risk.numeric_flags(wide(known)))


QUERIES = {f.__name__: f for f in (full_ratios, full_flags, full_score)}

_SHARES = {k: f"CAST({share} AS DOUBLE)" for k, _, share in DEBT}
_FULL_SQL = f"""{FX_SQL.replace('fx_facts AS MATERIALIZED (', 'fx_base AS MATERIALIZED (', 1).replace('FROM fx_facts f', 'FROM fx_base f')},
fx_pair AS (SELECT doc_id, yr, max(val) FILTER (metric_key = 'longterm_liabilities') AS lt, max(val) FILTER (metric_key = 'current_liabilities') AS st,
  max(val) FILTER (metric_key = 'operating_profit') AS op, max(val) FILTER (metric_key = 'depreciation_amortization') AS da FROM fx_base GROUP BY doc_id, yr),
fx_facts AS MATERIALIZED (SELECT * FROM fx_base UNION ALL SELECT doc_id, 'liabilities', yr, lt + st FROM fx_pair UNION ALL SELECT doc_id, 'ebitda', yr, op + abs(da) FROM fx_pair
  UNION ALL SELECT doc_id, 'total_debt', yr, lt * {_SHARES['longterm_debt_component']} + st * {_SHARES['shortterm_debt_component']} FROM fx_pair WHERE doc_id % 4 <> 0)"""
_DEBT, _NET = "coalesce(c_total_debt, c_liabilities)", "coalesce(c_total_debt, c_liabilities) - c_cash"
_INPUTS = [*S._IND_INPUTS, "liabilities", "total_debt", "ebitda"]
_FORMULAS = {
    "debt_ratio": S._over(_DEBT, "c_assets"), "debt_equity": S._over(_DEBT, "c_equity"), "ebitda_margin": S._over("c_ebitda", "c_revenue"),
    "net_debt": _NET, "net_debt_equity": S._over(_NET, "c_equity"),
}
_TABLE = {k: (_FORMULAS.get(k, v), g) for k, (v, g) in S._IND_SQL.items()}
_CTE = f"{_FULL_SQL}, {S._wide_sql(_INPUTS)}, rt AS MATERIALIZED ({S._ratio_union(_TABLE)})"
_FLAGS = f"{S._FLAGS_SQL} UNION ALL SELECT doc_id, 5 AS ord, 'high_leverage' AS code, 'high' AS severity FROM w WHERE {_FORMULAS['debt_equity']} > 2"
ORACLE_SQL = {
    "full_ratios": f"WITH {_CTE} SELECT doc_id, ratio_key, round(value, 6) AS value, status, cur_year, prev_year FROM rt",
    "full_flags": f"WITH {_CTE} {_FLAGS}",
    "full_score": S.ORACLE_SQL["doc_score"].replace(S._RATIOS_CTE, _CTE).replace(S._FLAGS_SQL, _FLAGS),
}
