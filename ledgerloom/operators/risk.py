"""Risk flags from figures and from page text, and the score of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_label, those_that

#: Points that a flag of each severity takes, and a grade gives. Fixed values.
PENALTY = {"critical": 10, "high": 6, "medium": 3, "low": 1}
POINTS = {"good": 100, "warn": 60, "bad": 20}
#: (code, severity, keywords) of risks that a text discloses. Fixed values.
TEXT_RISKS = [
    ("sanctions", "high", ["санкц", "ограничительн"]),
    ("market_price", "medium", ["снижение цен", "волатильност", "цена нефти"]),
    ("climate", "medium", ["климатическ риск", "углеродн"]),
    ("cyber", "medium", ["кибер", "информационн безопасност"]),
    ("legal", "medium", ["судебн", "комплаенс", "правов"]),
]
FLAGS, FLAG_PAGES = 20, 5


def flag_array() -> Column:
    """The flags of a document's figures, from columns of one row: c_equity, c_net_profit, ..., and the ratios named below."""
    rules = [
        ("negative_equity", "critical", F.col("c_equity") < 0),
        ("net_loss", "high", F.col("c_net_profit") < 0),
        ("negative_ocf", "high", F.col("c_operating_cash_flow") < 0),
        ("low_liquidity", "high", F.col("current_ratio") < 1),
        ("high_leverage", "high", F.col("debt_equity") > 2),
        ("revenue_decline", "medium", F.col("revenue_growth") < 0),
        ("profit_decline", "medium", F.col("net_profit_growth") < 0),
    ]
    flag = lambda i, code, severity: F.struct(F.lit(i).alias("ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity"))
    return those_that(*[(holds, flag(i, code, severity)) for i, (code, severity, holds) in enumerate(rules, 1)])


def numeric_flags(wide: DataFrame) -> DataFrame:
    """(doc_id, ord, code, severity) from one row a document."""
    return wide.select("doc_id", F.explode(flag_array()).alias("f")).select("doc_id", "f.*")


def text_flags(pages: DataFrame, risks: list = TEXT_RISKS) -> DataFrame:
    """(doc_id, ord, code, severity, pages): the first pages (of doc_id, page, text) that hold a keyword of each risk."""
    text = normalize_label(F.coalesce("text", F.lit("")))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("_t").contains(w))
    hits = F.array_compact(F.array(*[
        F.when(says(words), F.struct(F.lit(100 + i).alias("ord"), F.lit(code).alias("code"), F.lit(severity).alias("severity")))
        for i, (code, severity, words) in enumerate(risks)
    ]))
    found = pages.withColumn("_t", text).select("doc_id", "page", F.explode(hits).alias("h")).select("doc_id", "page", "h.*").distinct()
    first = Window.partitionBy("doc_id", "code").orderBy("page")
    few = found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= FLAG_PAGES)
    return few.groupBy("doc_id", "ord", "code", "severity").agg(F.array_join(F.array_sort(F.collect_list("page")), ",").alias("pages"))


def capped(flags: DataFrame, most: int = FLAGS) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ord")
    return flags.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _weight(column: str, table: dict) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(column)), F.lit(0))


def scores(ratios: DataFrame, flags: DataFrame) -> DataFrame:
    """doc_id, n_available, score, mode: mean of grades less penalties, half-even, within 0 and 100.

    With under five graded ratios the mode is document_completeness and the score null: see completeness().
    """
    graded = ratios.groupBy("doc_id").agg(F.count_if(F.col("status") != "na").alias("n_available"), F.avg(F.when(F.col("status") != "na", _weight("status", POINTS))).alias("base"))
    lost = flags.groupBy("doc_id").agg(F.sum(_weight("severity", PENALTY)).alias("lost"))
    joined = graded.join(lost, "doc_id", "left")
    value = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("base") - F.coalesce("lost", F.lit(0)), 0).cast("int")))
    enough = F.col("n_available") >= 5
    return joined.select("doc_id", "n_available", F.when(enough, value).alias("score"), F.when(enough, "financial").otherwise("document_completeness").alias("mode"))


def completeness(documents: DataFrame) -> DataFrame:
    """Points for what a document offers: text_pages, n_years, n_tables, n_operational, has_risks, has_audit."""
    points = (
        F.when(F.col("text_pages") > 0, 20).otherwise(0) + F.when(F.col("n_years") >= 2, 20).otherwise(0)
        + F.least(F.lit(20), F.col("n_tables") * 2) + F.least(F.lit(20), F.col("n_operational"))
        + F.when(F.col("has_risks"), 10).otherwise(0) + F.when(F.col("has_audit"), 10).otherwise(0)
    )
    return documents.withColumn("score", F.least(F.lit(100), points))
