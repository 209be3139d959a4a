"""Queries of the findings: by figures alone, of banks, of full models, and with all that is known beside figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trends
from ..operators.findings import FALLBACKS, FIGURE_RISKS, LEAST_ACTIONS, MOST, known_of
from ..operators.findings import findings as rules
from ..sources.shared import written
from . import statement_queries as S
from .fixtures import BANK_SQL, FX_SQL, bank_facts, facts
from .model_queries import _FULL_SQL, _INPUTS, _TABLE, full_facts

_NAMES = ["doc_id", "section", "ord", "rule_id"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(facts(spark, sf_dir)).select(_NAMES)


def findings_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(bank_facts(spark, sf_dir)).select(_NAMES)


def full_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(full_facts(spark, sf_dir)).select(_NAMES)


#: What the customers' documents hold beside figures, as conditions on doc_id that both engines read.
_NO_FIGURES = "doc_id % 10 = 9"
_ABOUT = {"is_ras": "doc_id % 2 = 0", "audit_opinion": "CASE WHEN doc_id % 5 = 0 THEN 'clean' END"}
_FEW = "metric_key IN ('revenue', 'inventory', 'cash', 'capex')"
#: Amounts that some documents lack or have otherwise, so that each branch of a rule is met.
_CHANGED = (
    "CASE WHEN metric_key = 'operating_cash_flow' AND doc_id % 7 = 3 THEN NULL WHEN metric_key LIKE '%assets' AND doc_id % 11 = 4 THEN NULL "
    "WHEN metric_key IN ('revenue', 'gross_profit', 'operating_profit') AND doc_id % 13 = 5 THEN NULL ELSE val END"
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, "c_custkey", several=True).withColumn("val", F.expr(_CHANGED)).where("val IS NOT NULL")


def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of customers' documents: some tell of risks, ESG, an audit, some have operational figures alone."""
    known = _customers(spark, sf_dir)
    docs = written(known.select("doc_id").distinct(), "docs")
    told = F.array(*[F.struct(F.lit(100 + i).alias("ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(of).alias("of"))
                     for i, (code, severity, of) in enumerate(_TOLD)])
    flags = docs.select("doc_id", F.inline(told)).where("doc_id % of = 1")
    esg = docs.where("doc_id % 3 = 0").select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 3).cast("int"))).alias("ord"))
    movers = trends.top_movers(known.where(f"{_NO_FIGURES} AND {_FEW}"), **S._WORDS)
    movers = movers.select("doc_id", "rank", F.col("metric_key").alias("name"), F.col("percent_change").alias("change"), "direction")
    about = docs.select("doc_id", *[F.expr(e).alias(k) for k, e in _ABOUT.items()])
    beside = known_of(flags, movers, esg.withColumn("text", F.concat(F.lit("esg "), F.col("ord").cast("string"))), about)
    return rules(known.where(f"NOT {_NO_FIGURES}"), beside).select(_NAMES)


#: (code, severity, of): a risk that texts tell where doc_id leaves 1 of so many.
_TOLD = [("sanctions", "high", 6), ("market_price", "medium", 4), ("climate", "medium", 8), ("cyber", "medium", 8), ("legal", "medium", 3)]
QUERIES = {f.__name__: f for f in (findings, findings_bank, full_findings, report_findings)}

# ---- the same in SQL ----
_LIQUID = "(current_ratio >= 1 AND (quick_ratio IS NULL OR quick_ratio >= 0.8))"
_EASY = "(debt_equity <= 1.5 AND (interest_coverage IS NULL OR interest_coverage >= 2))"
_PAID = "(c_operating_cash_flow > 0 AND (cash_conversion IS NULL OR cash_conversion >= 0.8))"
_FALLS = "(coalesce(d_revenue < 0, false) OR coalesce(d_gross_profit < 0, false) OR coalesce(d_operating_profit < 0, false) OR coalesce(d_net_profit < 0, false))"
_RISES = "(coalesce(d_revenue > 0, false) OR coalesce(d_operating_profit > 0, false) OR coalesce(d_net_profit > 0, false))"
_BELOW = "(d_operating_profit > 0 AND d_net_profit < 0)"
_INDUSTRIAL = [
    ("summary", "opening", "true"), ("summary", "revenue_change", "d_revenue IS NOT NULL"), ("summary", "operating_change", "d_operating_profit IS NOT NULL"),
    ("summary", "net_profit_change", "d_net_profit IS NOT NULL"), ("summary", "liquidity", "current_ratio IS NOT NULL"), ("summary", "leverage", "debt_equity IS NOT NULL"),
    ("summary", "cash_flow", "c_operating_cash_flow IS NOT NULL"), ("summary", "top_risk", "doc_id IN (SELECT doc_id FROM fl)"),
    ("strengths", "margins", "gross_margin IS NOT NULL OR operating_margin IS NOT NULL OR net_margin IS NOT NULL"),
    ("strengths", "liquidity_cover", f"current_ratio IS NOT NULL AND {_LIQUID}"), ("weaknesses", "liquidity_gap", f"current_ratio IS NOT NULL AND NOT {_LIQUID}"),
    ("strengths", "moderate_debt", f"debt_equity IS NOT NULL AND {_EASY}"), ("weaknesses", "high_debt", f"debt_equity IS NOT NULL AND NOT {_EASY}"),
    ("weaknesses", "declining", _FALLS), ("strengths", "growing", f"{_RISES} AND NOT {_FALLS}"),
    ("strengths", "cash_quality", f"c_operating_cash_flow IS NOT NULL AND {_PAID}"), ("weaknesses", "cash_quality_low", f"c_operating_cash_flow IS NOT NULL AND NOT {_PAID}"),
    ("weaknesses", "cash_flow_decline", "d_operating_cash_flow < 0"), ("observations", "liquidity_scissors", "d_current_assets < 0 AND d_current_liabilities > 0"),
    ("observations", "below_operations", _BELOW), ("observations", "growth_without_profit", f"d_revenue > 0 AND d_net_profit < 0 AND NOT coalesce({_BELOW}, false)"),
    ("observations", "cash_and_profit", "d_operating_cash_flow IS NOT NULL AND d_net_profit IS NOT NULL"), ("observations", "turnover", "d_assets IS NOT NULL AND asset_turnover IS NOT NULL"),
    ("actions", "payment_calendar", "current_ratio < 1"), ("actions", "profit_bridge", "d_net_profit < 0"), ("actions", "cash_bridge", "d_operating_cash_flow < 0"),
    ("actions", "stress_test", "debt_equity IS NOT NULL"), ("actions", "risk_owners", "doc_id IN (SELECT doc_id FROM fl WHERE severity IN ('critical', 'high'))"),
    ("limitations", "ras_scope", "doc_id IN (SELECT doc_id FROM k_about WHERE is_ras)"),
]
_BANK = [
    ("summary", "opening", "true"), ("summary", "assets", "d_assets IS NOT NULL"), ("summary", "loans_and_funds", "d_bank_customer_loans IS NOT NULL AND d_bank_customer_funds IS NOT NULL"),
    ("summary", "interest_and_fees", "d_bank_net_interest_income IS NOT NULL AND d_bank_fee_income IS NOT NULL"), ("summary", "profit", "d_net_profit IS NOT NULL"),
    ("summary", "returns", "roa IS NOT NULL AND roe IS NOT NULL"), ("actions", "compare_limits", "true"), ("actions", "explain_interest", "true"), ("actions", "control_costs", "true"),
    ("actions", "check_capital", "true"), ("observations", "loans_against_funds", "d_bank_customer_loans IS NOT NULL AND d_bank_customer_funds IS NOT NULL"),
    ("observations", "interest_against_profit", "d_bank_net_interest_income IS NOT NULL AND d_net_profit IS NOT NULL"), ("observations", "credit_losses", "bank_credit_loss_to_loans IS NOT NULL"),
    ("limitations", "bank_forms", "true"), ("esg", "bank_no_esg", "true"),
]
_NOTHING = """k_flags AS (SELECT 0::BIGINT AS doc_id, 0 AS ord, '' AS code, '' AS severity LIMIT 0), k_movers AS (SELECT 0::BIGINT AS doc_id, 0 AS rank, '' AS name, '' AS direction LIMIT 0),
k_esg AS (SELECT 0::BIGINT AS doc_id, 0 AS ord LIMIT 0), k_about AS (SELECT 0::BIGINT AS doc_id, false AS is_ras, '' AS audit_opinion LIMIT 0)"""


def _sql(cte: str, table: dict, is_bank: bool, beside: str = _NOTHING) -> str:
    """cte defines w; the rules as rows, then what empty or short sections get, one source after another."""
    changes = ["revenue", "gross_profit", "net_profit", "operating_profit", "current_assets", "current_liabilities", "operating_cash_flow", "assets"]
    changes = ["assets", "net_profit", "bank_customer_loans", "bank_customer_funds", "bank_net_interest_income", "bank_fee_income"] if is_bank else changes
    columns = ", ".join([*(f"{v} AS {k}" for k, (v, _) in table.items()), *map(S._change, changes)])
    codes = [("negative_equity", 1, "critical", "c_equity < 0"), ("net_loss", 2, "high", "c_net_profit < 0"), ("profit_decline", 7, "medium", "net_profit_growth < 0")]
    if not is_bank:
        codes += [("negative_ocf", 3, "high", "c_operating_cash_flow < 0"), ("low_liquidity", 4, "high", "current_ratio < 1"), ("high_leverage", 5, "high", "debt_equity > 2"), ("revenue_decline", 6, "medium", "revenue_growth < 0")]
    flags = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{c}' AS code, '{s}' AS severity FROM x WHERE {t}" for c, i, s, t in codes)
    graded = " UNION ALL ".join(f"SELECT doc_id, {i} AS pos, '{k}' AS key, {g} AS status FROM (SELECT *, {k} AS v FROM x)" for i, (k, (_, g)) in enumerate(table.items()))
    hits = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS section, {i} AS n, '{r}' AS rule_id FROM x WHERE {t}" for i, (s, r, t) in enumerate(_BANK if is_bank else _INDUSTRIAL))
    lacking = lambda source, section: f"doc_id NOT IN (SELECT doc_id FROM {source} WHERE section = '{section}')"
    short = f"(SELECT count(*) FROM h3 WHERE h3.doc_id = d.doc_id AND h3.section = 'actions') < {LEAST_ACTIONS}"
    most = 5 if is_bank else FALLBACKS
    stand = " UNION ALL ".join(
        f"SELECT doc_id, '{section}', 1000 + pos, '{prefix}' || key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM rt WHERE status IN ({states})) WHERE place <= {most} AND {lacking('h1', section)}"
        for section, prefix, states in (("strengths", "good_", "'good'"), ("weaknesses", "weak_", "'bad', 'warn'")))
    risk = f"""SELECT doc_id, 'risks', place, 'flag_' || code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM fl WHERE {'true' if is_bank else 'ord <= 7'}) WHERE place <= {5 if is_bank else FIGURE_RISKS}"""
    other = "" if is_bank else f""" UNION ALL SELECT DISTINCT doc_id, 'risks', 50, 'disclosed' FROM fl WHERE ord > 7
  UNION ALL SELECT doc_id, 'esg', ord, 'esg_' || ord FROM k_esg WHERE doc_id NOT IN (SELECT doc_id FROM k_about WHERE is_ras)"""
    defaults = [(s, f"no_{s}") for s in ("strengths", "weaknesses")] + [("risks", "no_flags"), ("observations", "no_observations"), ("limitations", "general")]
    fill = " UNION ALL ".join(f"SELECT doc_id, '{s}', 3000, '{r}' FROM docs d WHERE {lacking('h3', s)}" for s, r in defaults)
    cap = " ".join(f"WHEN '{s}' THEN {n}" for s, n in MOST.items())
    return f"""WITH {cte}, {beside}, x AS MATERIALIZED (SELECT *, {columns} FROM w), docs AS (SELECT doc_id FROM x UNION SELECT doc_id FROM k_about),
fl AS MATERIALIZED ({flags} UNION ALL SELECT * FROM k_flags), rt AS MATERIALIZED (SELECT * FROM ({graded}) WHERE status <> 'na'),
h0 AS ({hits} UNION ALL SELECT d.doc_id, i.section, i.n, i.rule_id FROM docs d, (VALUES ('summary', 0, 'opening')) i(section, n, rule_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM x)
  UNION ALL SELECT DISTINCT d.doc_id, 'summary', 7, 'top_risk' FROM docs d JOIN fl USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM x)
  UNION ALL SELECT DISTINCT d.doc_id, 'actions', 27, 'risk_owners' FROM docs d JOIN fl USING (doc_id) WHERE severity IN ('critical', 'high') AND d.doc_id NOT IN (SELECT doc_id FROM x)
  UNION ALL SELECT doc_id, 'limitations', 28, 'ras_scope' FROM k_about WHERE is_ras AND doc_id NOT IN (SELECT doc_id FROM x)),
mv AS (SELECT * FROM k_movers WHERE doc_id NOT IN (SELECT doc_id FROM x)),
h1 AS MATERIALIZED (SELECT * FROM h0 UNION ALL SELECT doc_id, CASE direction WHEN 'strength' THEN 'strengths' ELSE 'weaknesses' END, 100 + rank, 'mover_' || name FROM mv WHERE direction <> 'neutral'
  UNION ALL SELECT doc_id, 'observations', 100 + rank, 'mover_' || name FROM mv UNION ALL SELECT doc_id, 'observations', 900, 'audit_opinion' FROM k_about WHERE audit_opinion IS NOT NULL),
h2 AS (SELECT * FROM h1 UNION ALL {stand} UNION ALL {risk}{other}),
h3 AS MATERIALIZED (SELECT * FROM h2 UNION ALL SELECT doc_id, 'esg', 0, CASE WHEN doc_id IN (SELECT doc_id FROM k_about WHERE is_ras) THEN 'ras_no_esg' ELSE 'no_esg' END FROM docs WHERE {lacking('h2', 'esg')}),
h4 AS (SELECT * FROM h3 UNION ALL {fill} UNION ALL SELECT doc_id, 'actions', 3000, 'monitoring' FROM docs d WHERE {short})
SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY n, rule_id)::INTEGER AS ord, rule_id FROM h4 QUALIFY ord <= CASE section {cap} ELSE 1000 END"""


_CUSTOMERS_SQL = FX_SQL.replace("c_nationkey::BIGINT", "c_custkey::BIGINT").split(",\nfx_candidates")[0].replace("fx_facts AS MATERIALIZED (", "fx_given AS MATERIALIZED (", 1)
_CUSTOMERS_SQL = f"""{_CUSTOMERS_SQL}, fx_all AS MATERIALIZED (SELECT * FROM (SELECT * REPLACE ({_CHANGED} AS val) FROM fx_given) WHERE val IS NOT NULL),
fx_few AS (SELECT * FROM fx_all WHERE {_NO_FIGURES} AND {_FEW}), fx_facts AS MATERIALIZED (SELECT * FROM fx_all WHERE NOT {_NO_FIGURES})"""
_MOVERS_SQL = S.ORACLE_SQL["top_movers"].replace(f"WITH {FX_SQL}, ", "WITH ").replace("fx_facts", "fx_few")
_TOLD_SQL = ", ".join(f"({100 + i}, '{c}', '{s}', {of})" for i, (c, s, of) in enumerate(_TOLD))
_BESIDE_SQL = f"""ids AS (SELECT DISTINCT doc_id FROM fx_all), k_flags AS (SELECT doc_id, ord, code, severity FROM ids, (VALUES {_TOLD_SQL}) t(ord, code, severity, each) WHERE doc_id % each = 1),
k_movers AS MATERIALIZED (SELECT doc_id, rank, metric_key AS name, direction FROM ({_MOVERS_SQL})), k_esg AS (SELECT doc_id, unnest(range(1, (doc_id % 4 + 4)::BIGINT)) AS ord FROM ids WHERE doc_id % 3 = 0),
k_about AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _ABOUT.items())} FROM ids)"""
ORACLE_SQL = {
    "findings": _sql(f"{FX_SQL}, {S._wide_sql(S._IND_INPUTS)}", S._IND_SQL, False),
    "findings_bank": _sql(f"{BANK_SQL}, {S._wide_sql(S._BANK_INPUTS)}", S._BANK_SQL, True),
    "full_findings": _sql(f"{_FULL_SQL}, {S._wide_sql(_INPUTS)}", _TABLE, False),
    "report_findings": _sql(f"{_CUSTOMERS_SQL}, {S._wide_sql(S._IND_INPUTS)}", S._IND_SQL, False, _BESIDE_SQL),
}
