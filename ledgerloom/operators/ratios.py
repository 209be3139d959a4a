"""Ratios of every document's latest year, their grades, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import average, grade, growth, ratio_display, safe_divide

#: key -> (good, warn): a threshold and its direction. Fixed values.
_UP, _DOWN = "up", "down"
INDUSTRIAL_GRADES = {
    "current_ratio": (_UP, 1.5, 1), "quick_ratio": (_UP, 1, 0.7), "cash_ratio": (_UP, 0.2, 0.1),
    "debt_ratio": (_DOWN, 0.5, 0.7), "debt_equity": (_DOWN, 1, 2), "equity_ratio": (_UP, 0.5, 0.3),
    "roa": (_UP, 0.08, 0.03), "roe": (_UP, 0.15, 0.08), "net_margin": (_UP, 0.1, 0.04),
    "gross_margin": (_UP, 0.3, 0.15), "operating_margin": (_UP, 0.12, 0.05), "ebitda_margin": (_UP, 0.15, 0.08),
    "asset_turnover": (_UP, 1, 0.5), "inventory_turnover": (_UP, 4, 2), "receivables_turnover": (_UP, 6, 3),
    "ocf_ratio": (_UP, 0.5, 0.2), "net_debt_equity": (_DOWN, 0.5, 1.5), "interest_coverage": (_UP, 5, 2),
    "ocf_margin": (_UP, 0.12, 0.05), "cash_conversion": (_UP, 1, 0.7), "revenue_growth": (_UP, 0.1, 0),
    "net_profit_growth": (_UP, 0.1, 0),
}
BANK_GRADES = {
    "roa": (_UP, 0.015, 0.007), "roe": (_UP, 0.15, 0.08), "equity_ratio": (_UP, 0.10, 0.07),
    "bank_cost_to_income": (_DOWN, 0.45, 0.60), "bank_credit_loss_to_loans": (_DOWN, 0.02, 0.04),
    "bank_net_interest_income_to_assets": (_UP, 0.04, 0.02), "bank_net_interest_income_growth": (_UP, 0.10, 0),
    "bank_fee_income_growth": (_UP, 0.08, 0), "net_profit_growth": (_UP, 0.10, 0),
}
PERCENT = [
    "debt_ratio", "equity_ratio", "roa", "roe", "net_margin", "gross_margin", "operating_margin", "ebitda_margin",
    "ocf_margin", "revenue_growth", "net_profit_growth", "bank_credit_loss_to_loans",
    "bank_net_interest_income_to_assets", "bank_net_interest_income_growth", "bank_fee_income_growth",
]
#: ratio -> the group it is reported in; the first group that names it. Fixed values.
GROUPS = {
    "liquidity": ["current_ratio", "quick_ratio", "cash_ratio", "working_capital", "ocf_ratio", "bank_loan_to_deposit"],
    "profitability": ["gross_margin", "operating_margin", "net_margin", "ebitda_margin", "roa", "roe", "bank_net_interest_income_to_assets"],
    "leverage": ["debt_ratio", "debt_equity", "equity_ratio", "net_debt", "net_debt_equity", "interest_coverage"],
    "efficiency": ["asset_turnover", "inventory_turnover", "receivables_turnover", "bank_cost_to_income", "bank_credit_loss_to_loans"],
    "cash_flow": ["free_cash_flow", "ocf_margin", "cash_conversion"],
    "growth": ["revenue_growth", "net_profit_growth", "bank_net_interest_income_growth", "bank_fee_income_growth"],
}
INPUTS = [
    "assets", "current_assets", "current_liabilities", "inventory", "cash", "total_debt", "liabilities", "equity",
    "net_profit", "revenue", "gross_profit", "operating_profit", "ebitda", "cogs", "receivables",
    "operating_cash_flow", "capex", "interest_expense", "bank_customer_loans", "bank_customer_funds",
    "bank_operating_expenses", "bank_net_operating_income", "bank_credit_loss_charge",
    "bank_net_interest_income", "bank_fee_income",
]


def latest_wide(facts: DataFrame, inputs: list[str] = INPUTS) -> DataFrame:
    """One row a document: cur_year, prev_year, is_bank, and c_key / p_key of each input in these years.

    With a single year the previous year is the current one. Facts become a row a year before they are shuffled;
    the two years are then taken from these few rows.
    """
    at = lambda k: F.max(F.when((F.col("metric_key") == k) & F.col("yr").isNotNull(), F.col("val")))
    years = facts.groupBy("doc_id", "yr").agg(F.max(F.col("metric_key").startswith("bank_")).alias("_bank"), *[at(k).alias(k) for k in inputs])
    rows = years.select("doc_id", "_bank", F.struct("yr", *inputs).alias("_c"))
    doc = Window.partitionBy("doc_id")
    newest = doc.orderBy(F.col("_c.yr").desc())
    rows = rows.select("doc_id", "_c", F.lead("_c").over(newest).alias("_p"), F.row_number().over(newest).alias("_n"), F.max("_bank").over(doc).alias("is_bank")).where("_n = 1")
    rows = rows.withColumn("_p", F.when(F.col("_p.yr").isNotNull(), F.col("_p")).otherwise(F.col("_c")))
    return rows.select(
        "doc_id", F.col("_c.yr").alias("cur_year"), F.col("_p.yr").alias("prev_year"), "is_bank",
        *[F.col(f"_c.{k}").alias(f"c_{k}") for k in inputs], *[F.col(f"_p.{k}").alias(f"p_{k}") for k in inputs],
    )


def _c(key: str) -> Column:
    return F.col(f"c_{key}")


def _mean(key: str) -> Column:
    return average(F.col(f"c_{key}"), F.col(f"p_{key}"))


def _grown(key: str) -> Column:
    return growth(F.col(f"c_{key}"), F.col(f"p_{key}"))


def industrial() -> dict[str, Column]:
    debt = F.coalesce(_c("total_debt"), _c("liabilities"))
    net_debt = debt - _c("cash")
    over = lambda key, of: safe_divide(_c(key), _c(of))
    return {
        "current_ratio": over("current_assets", "current_liabilities"),
        "quick_ratio": safe_divide(_c("current_assets") - _c("inventory"), _c("current_liabilities")),
        "cash_ratio": over("cash", "current_liabilities"),
        "debt_ratio": safe_divide(debt, _c("assets")),
        "debt_equity": safe_divide(debt, _c("equity")),
        "equity_ratio": over("equity", "assets"),
        "roa": safe_divide(_c("net_profit"), _mean("assets")),
        "roe": safe_divide(_c("net_profit"), _mean("equity")),
        "net_margin": over("net_profit", "revenue"),
        "gross_margin": over("gross_profit", "revenue"),
        "operating_margin": over("operating_profit", "revenue"),
        "ebitda_margin": over("ebitda", "revenue"),
        "asset_turnover": safe_divide(_c("revenue"), _mean("assets")),
        "inventory_turnover": safe_divide(F.abs(_c("cogs")), _mean("inventory")),
        "receivables_turnover": safe_divide(_c("revenue"), _mean("receivables")),
        "ocf_ratio": over("operating_cash_flow", "current_liabilities"),
        "free_cash_flow": _c("operating_cash_flow") - F.abs(_c("capex")),
        "working_capital": _c("current_assets") - _c("current_liabilities"),
        "net_debt": net_debt,
        "net_debt_equity": safe_divide(net_debt, _c("equity")),
        "interest_coverage": safe_divide(_c("operating_profit"), F.abs(_c("interest_expense"))),
        "ocf_margin": over("operating_cash_flow", "revenue"),
        "cash_conversion": over("operating_cash_flow", "net_profit"),
        "revenue_growth": _grown("revenue"),
        "net_profit_growth": _grown("net_profit"),
    }


def bank() -> dict[str, Column]:
    return {
        "roa": safe_divide(_c("net_profit"), _mean("assets")),
        "roe": safe_divide(_c("net_profit"), _mean("equity")),
        "equity_ratio": safe_divide(_c("equity"), _c("assets")),
        "bank_loan_to_deposit": safe_divide(_c("bank_customer_loans"), _c("bank_customer_funds")),
        "bank_cost_to_income": safe_divide(F.abs(_c("bank_operating_expenses")), _c("bank_net_operating_income")),
        "bank_credit_loss_to_loans": safe_divide(F.abs(_c("bank_credit_loss_charge")), _mean("bank_customer_loans")),
        "bank_net_interest_income_to_assets": safe_divide(_c("bank_net_interest_income"), _mean("assets")),
        "bank_net_interest_income_growth": _grown("bank_net_interest_income"),
        "bank_fee_income_growth": _grown("bank_fee_income"),
        "net_profit_growth": _grown("net_profit"),
    }


def graded(key: str, value: Column, grades: dict) -> Column:
    if key in ("free_cash_flow", "working_capital", "net_debt"):
        good = {"free_cash_flow": value > 0, "working_capital": value >= 0, "net_debt": value <= 0}[key]
        return F.when(value.isNull(), "na").when(good, "good").otherwise("warn" if key == "net_debt" else "bad")
    if key == "bank_loan_to_deposit":
        return grade(value, lambda v: v.between(0.70, 0.95), lambda v: v.between(0.55, 1.10))
    way, good, warn = grades[key]
    return grade(value, lambda v: v >= good if way == _UP else v <= good, lambda v: v >= warn if way == _UP else v <= warn)


def ratios(facts: DataFrame) -> DataFrame:
    """doc_id, ratio_key, value, status, is_percent, cur_year, prev_year; bank documents get the bank set."""
    wide = latest_wide(facts)
    entry = lambda k, v, grades: F.struct(F.lit(k).alias("ratio_key"), v.alias("value"), graded(k, v, grades).alias("status"))
    banks = F.array(*[entry(k, v, BANK_GRADES) for k, v in bank().items()])
    others = F.array(*[entry(k, v, INDUSTRIAL_GRADES) for k, v in industrial().items()])
    one = wide.select("doc_id", "cur_year", "prev_year", F.explode(F.when(F.col("is_bank"), banks).otherwise(others)).alias("r"))
    return one.select("doc_id", "r.*", F.col("r.ratio_key").isin(*PERCENT).alias("is_percent"), "cur_year", "prev_year")


def displayed(table: DataFrame) -> DataFrame:
    return table.withColumn("display", ratio_display(F.col("value"), F.col("is_percent")))


def grouped(table: DataFrame) -> DataFrame:
    """Adds ratio_group (null where no group names the ratio)."""
    pairs = [(k, g) for g, keys in GROUPS.items() for k in keys]
    names = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return table.withColumn("ratio_group", F.try_element_at(names, F.col("ratio_key")))
