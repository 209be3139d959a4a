"""Queries over statement facts: ratios, trends, merge, derivations, checks, branches, flags, score.

Amounts are rounded to five decimals, which they have, ratios to six decimals, so sums in another order compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import SOURCE_BONUS, TRUSTED_SOURCES
from ..operators import model, ratios, risk, trends, validate
from ..sources.shared import new_path, removed
from .fixtures import AMOUNTS, BANK_SQL, FX_SQL, SUMS, bank_facts, candidates, facts, table

_METRICS = [*SUMS, *AMOUNTS]


def ratios_industrial(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratios.ratios(facts(spark, sf_dir))
    return found.select("doc_id", "ratio_key", F.round("value", 6).alias("value"), "status", "cur_year", "prev_year")


def ratios_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratios.ratios(bank_facts(spark, sf_dir))
    return found.select("doc_id", "ratio_key", F.round("value", 6).alias("value"), "status", "cur_year", "prev_year")


def ratio_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ratios.grouped(ratios.ratios(facts(spark, sf_dir)).where("status <> 'na'"))
    return found.groupBy("ratio_group", "status").agg(F.count("*").alias("n_ratios"))


def trends_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(c, 5).alias(c)
    found = trends.trends(facts(spark, sf_dir))
    return found.select("doc_id", "metric_key", "from_year", "to_year", cents("from_value"), cents("to_value"), cents("absolute_change"), F.round("percent_change", 6).alias("percent_change"))


#: Stems that stand in for the operational ones in Latin fixtures.
_WORDS = {"worse": ["liabilities", "inventory"], "better": ["revenue", "profit", "cash"]}


def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trends.top_movers(facts(spark, sf_dir), **_WORDS)
    return found.select("doc_id", "metric_key", "rank", "direction", F.round("percent_change", 6).alias("percent_change"))


def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.latest_values(facts(spark, sf_dir)).select("doc_id", "metric_key", "yr", F.round("val", 5).alias("val"))


def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.registry_latest(table(spark, sf_dir, "events"))


def registry_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.registry_page(table(spark, sf_dir, "events"), 100)


def registry_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a tombstone; an event of the first type in the alphabet stands for one."""
    events = table(spark, sf_dir, "events")
    gone = events.where("event_type = 'click' AND value < 1").select(F.col("user_id").alias("doc_id")).distinct()
    return trends.registry_without(events, gone)


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.merged_values(model.gated(candidates(spark, sf_dir)))
    return found.select("doc_id", "metric_key", "yr", F.round("val", 5).alias("val"), "seq")


def merge_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.merged_attributes(model.gated(candidates(spark, sf_dir)))
    return found.select("doc_id", "metric_key", "confidence", "row_code", "source_type", "unit", "n_accepted")


def outlier_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.without_outliers(model.merged_values(model.gated(candidates(spark, sf_dir))))
    return found.where("dropped").select("doc_id", "metric_key", "yr", F.round("val", 5).alias("val"))


def _partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that lack lines in some documents, for the derivations to fill; confidence by metric."""
    gone = (
        "NOT (metric_key = 'assets' AND doc_id % 3 = 1) AND NOT (metric_key = 'current_assets' AND doc_id % 4 = 2) AND NOT (metric_key = 'equity' AND doc_id % 5 = 3)"
        " AND NOT (metric_key = 'gross_profit' AND doc_id % 2 = 0) AND NOT (metric_key = 'cogs' AND doc_id % 6 = 5) AND NOT (metric_key = 'cash' AND yr = 1996)"
    )
    surely = F.when(F.col("metric_key").isin("equity", "cogs"), 0.6).otherwise(F.lit(0.95))
    return facts(spark, sf_dir).where(gone).select("doc_id", F.lit("ras").alias("branch"), "metric_key", "yr", "val", surely.alias("confidence"))


def derive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = model.derived(_partial(spark, sf_dir)).where("is_derived")
    return found.select("doc_id", "metric_key", "yr", F.round("val", 5).alias("val"), "confidence")


def _with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select(
        "doc_id", F.lit("ras").alias("branch"), "metric_key", "yr", "val", F.when(F.col("metric_key") == "equity", 0.7).otherwise(0.9).alias("confidence"),
        (F.col("metric_key") == "assets").alias("has_code"), F.lit(False).alias("from_table"),
    )


#: Beside the assets of every fifth document other items are misstated, so that each kind of repair is met.
_MISSTATED = (
    "CASE WHEN metric_key = 'noncurrent_assets' AND doc_id % 5 IN (1, 3) AND yr % 2 = 0 THEN 1.3 WHEN metric_key = 'current_assets' AND doc_id % 5 = 3 AND yr % 2 = 1 THEN 1.3 "
    "WHEN metric_key = 'longterm_liabilities' AND doc_id % 5 = 2 THEN 1.5 ELSE 1.0 END"
)


def reconcile_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _with_attributes(spark, sf_dir).withColumn("val", F.expr(f"val * cast({_MISSTATED} AS double)"))
    found = model.balance_repairs(values)
    return found.select("doc_id", "yr", "metric_key", F.round("original", 5).alias("original"), F.round("repaired", 5).alias("repaired"), "confidence")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.identity_checks(_with_attributes(spark, sf_dir))


def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(c, 5).alias(c)
    return _checks(spark, sf_dir).select("doc_id", "yr", "check_name", "status", cents("left_side"), cents("right_side"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = model.gated(candidates(spark, sf_dir))
    sizes = model.merged_values(kept).groupBy(*model.KEYS).agg(F.max(F.abs("val")).alias("largest"))
    weak = F.when((F.col("metric_key") == "inventory") & (F.col("doc_id") % 2 == 0), 0.5).otherwise(F.col("confidence"))
    return model.merged_attributes(kept).join(sizes, model.KEYS, "left").withColumn("confidence", weak)


def row_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.row_checks(_metrics(spark, sf_dir))
    return found.select("doc_id", "metric_key", "status", F.array_join("issues", ",").alias("issues"))


def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.roll_up(_checks(spark, sf_dir)).select("doc_id", "validation", "n_passed", "n_failed", "n_not_tested")


def branch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(spark, sf_dir)
    found = validate.branch_scores(validate.validated(_metrics(spark, sf_dir), checks), validate.roll_up(checks))
    return found.select("doc_id", "branch", "n_valid", "n_core", "n_coded", "score", "reliable")


def branch_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _checks(spark, sf_dir)
    return validate.branch_choice(validate.branch_scores(validate.validated(_metrics(spark, sf_dir), checks), validate.roll_up(checks)))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.coverage(_partial(spark, sf_dir))


def _risk_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = ratios.latest_wide(facts(spark, sf_dir))
    found = ratios.industrial()
    return wide.select("*", *[found[k].alias(k) for k in ("current_ratio", "debt_equity", "revenue_growth", "net_profit_growth")])


def risk_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.numeric_flags(_risk_wide(spark, sf_dir))


def doc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.scores(ratios.ratios(facts(spark, sf_dir)), risk.numeric_flags(_risk_wide(spark, sf_dir)))


def pivot_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sheet: a row a document and metric, a column each year that the data have."""
    from ..sources.sinks import model_sheet

    sheet = model_sheet(facts(spark, sf_dir))
    return sheet.select("doc_id", "metric_key", *[F.round(c, 5).alias(c) for c in sheet.columns if c[:1] == "y"])


def export_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and ratios in one layout."""
    from ..sources.sinks import export_rows

    return export_rows(facts(spark, sf_dir), ratios.displayed(ratios.ratios(facts(spark, sf_dir)))).select("doc_id", "section", "key", "yr", F.round("value", 4).alias("value"), "status")


def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios after every fourth document's model is replaced by one of half the amounts."""
    from ..operators.findings import with_overrides

    known = facts(spark, sf_dir)
    supplied = known.where("doc_id % 4 = 0 AND metric_key <> 'cash'").withColumn("val", F.col("val") / 2)
    found = ratios.ratios(with_overrides(known, supplied))
    return found.select("doc_id", "ratio_key", F.round("value", 5).alias("value"), "status")


def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.findings import payload as structured

    known = facts(spark, sf_dir)
    found = structured(_metrics(spark, sf_dir), ratios.ratios(known), risk.numeric_flags(_risk_wide(spark, sf_dir)))
    kinds = "metrics array<struct<metric_key:string,source_type:string>>, ratios array<struct<ratio_key:string,status:string>>, flags array<struct<code:string,severity:string>>"
    told = found.select("doc_id", F.from_json("json", kinds).alias("j")).select("doc_id", "j.*")
    fields = {"metrics": ("metric_key", "source_type"), "ratios": ("ratio_key", "status"), "flags": ("code", "severity")}
    line = lambda c, one, two: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[one], x[two])), ","), F.lit(""))
    return told.select("doc_id", *[line(F.col(c), *names).alias(c) for c, names in fields.items()])


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status stream over the events file, run to its end; equals registry_latest."""
    from ..streaming.ingest import latest_status, status_rows

    place = new_path(spark, "status")
    latest_status(spark, f"{sf_dir}/events.parquet*", f"{place}/rows", f"{place}/checkpoint").awaitTermination()
    return status_rows(spark, f"{place}/rows")


def stream_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of customers' statements in three files over two batches, the second one with some that came before.

    Each document has readings in all files; its model equals that of one batch.
    """
    from ..streaming.ingest import ingest_statements, model_rows

    place, part = new_path(spark, "ingest"), F.col("seq") % 3
    names = ["doc_id", "branch", "metric_key", F.col("seq").cast("long").alias("seq"), "source_type", "confidence", "unit", "row_code", F.col("yr").cast("int").alias("yr"), "val"]
    candidates(spark, sf_dir, "c_custkey").select(*names).write.parquet(f"{place}/all")
    rows = spark.read.parquet(f"{place}/all")
    for again, files in enumerate(([part == 1, part == 2], [part == 0, part == 2])):
        for chosen in files:
            rows.where(chosen).write.mode("append").parquet(f"{place}/source")
        if again:
            removed(spark, f"{place}/all")
        ingest_statements(spark, f"{place}/source", f"{place}/target", f"{place}/checkpoint").awaitTermination()
    return model_rows(spark, f"{place}/target").select("doc_id", "metric_key", "yr", F.round("val", 5).alias("val"), "seq")


QUERIES = {f.__name__: f for f in (
    manual_override, payload, stream_status, stream_models,
    ratios_industrial, ratios_bank, ratio_groups, trends_yoy, top_movers, latest_value, registry_latest, registry_top, registry_live,
    merge_candidates, merge_attributes, outlier_years, derive_metrics, reconcile_balance, identity_checks, row_checks, validation_status,
    branch_scores, branch_choice, coverage, risk_numeric, doc_score, pivot_model, export_union,
)}

# ---- the same in SQL ----
def _repairs_sql() -> str:
    """A recursion over the years of a document, which carries the reliability of the six items."""
    near = lambda a, b: f"abs({a} - ({b})) <= greatest(abs({a}), abs({b}), 1.0) * 0.02::DOUBLE"
    at = lambda col: "CASE item " + " ".join(f"WHEN {i} THEN {col}{i}" for i in range(6)) + " END"
    items = ", ".join(f"max(CASE WHEN metric_key = '{k}' THEN val END) AS v{i}" for i, k in enumerate(model.BALANCE))
    sure = ", ".join(f"{0.7 if k == 'equity' else 0.9}::DOUBLE AS c{i}" for i, k in enumerate(model.BALANCE))
    kept = ", ".join(f"CASE WHEN done AND item = {i} THEN low ELSE c{i} END" for i in range(6))
    cs, names = ", ".join(f"f.c{i}" for i in range(6)), ", ".join(f"'{k}'" for k in model.BALANCE)
    return f"""WITH RECURSIVE {FX_SQL}, p AS (SELECT doc_id, yr, row_number() OVER (PARTITION BY doc_id ORDER BY yr) AS n, {items} FROM (SELECT doc_id, yr, metric_key, val * ({_MISSTATED})::DOUBLE AS val FROM fx_facts) GROUP BY doc_id, yr),
f AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 0::INTEGER AS yr, {sure}, 0 AS item, false AS done, 0::DOUBLE AS was, 0::DOUBLE AS fixed, 0::DOUBLE AS low FROM p
UNION ALL SELECT doc_id, n, yr, {kept}, item, done, was, fixed, low FROM (
  SELECT *, coalesce((item = 3 OR fixed >= 0) AND NOT ({near('was', 'fixed')}), false) AS done FROM (
  SELECT *, {at('v')} AS was,
    CASE item WHEN 0 THEN v1 + v2 WHEN 1 THEN v0 - v2 WHEN 2 THEN v0 - v1 WHEN 3 THEN v0 - (v4 + v5) WHEN 4 THEN v0 - (v3 + v5) WHEN 5 THEN v0 - (v3 + v4) END AS fixed,
    round(0.9::DOUBLE * CASE item WHEN 0 THEN least(c1, c2) WHEN 1 THEN least(c0, c2) WHEN 2 THEN least(c0, c1) WHEN 3 THEN least(c0, c4, c5) WHEN 4 THEN least(c0, c3, c5) WHEN 5 THEN least(c0, c3, c4) END, 2) AS low FROM (
  SELECT *, CASE WHEN sf AND NOT rs THEN 0 WHEN rf AND NOT rs THEN CASE WHEN c1 <= c2 THEN 1 ELSE 2 END
    WHEN rs AND NOT rf THEN CASE WHEN c3 <= c4 AND c3 <= c5 THEN 3 WHEN c4 <= c5 THEN 4 ELSE 5 END END AS item FROM (
  SELECT p.*, {cs}, {near('(v1 + v2)', 'v3 + v4 + v5')} AS sf, {near('v0', 'v1 + v2')} AS rs, {near('v0', 'v3 + v4 + v5')} AS rf FROM f JOIN p ON p.doc_id = f.doc_id AND p.n = f.n + 1)))))
SELECT doc_id, yr, ([{names}])[item + 1] AS metric_key, round(was, 5) AS original, round(fixed, 5) AS repaired, low AS confidence FROM f WHERE done"""


_IND_INPUTS = ["assets", "current_assets", "current_liabilities", "inventory", "cash", "equity", "net_profit", "revenue", "gross_profit", "operating_profit", "cogs", "receivables", "operating_cash_flow", "capex", "interest_expense"]
_BANK_INPUTS = ["assets", "equity", "net_profit", "bank_customer_loans", "bank_customer_funds", "bank_operating_expenses", "bank_net_operating_income", "bank_credit_loss_charge", "bank_net_interest_income", "bank_fee_income"]


def _wide_sql(inputs: list[str]) -> str:
    cells = ", ".join(f"max(CASE WHEN metric_key='{k}' AND yr={y}_year THEN val END) AS {p}_{k}" for k in inputs for p, y in (("c", "cur"), ("p", "prev")))
    return f"""yrs AS (SELECT doc_id, max(yr) AS cur_year, coalesce((SELECT max(b.yr) FROM fx_facts b WHERE b.doc_id = a.doc_id AND b.yr < max(a.yr)), max(yr)) AS prev_year FROM fx_facts a GROUP BY doc_id),
w AS MATERIALIZED (SELECT doc_id, cur_year, prev_year, {cells} FROM fx_facts JOIN yrs USING (doc_id) GROUP BY ALL)"""


def _mean_sql(k: str) -> str:
    return f"coalesce((c_{k}+p_{k})/2, c_{k}, p_{k})"


def _over(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def _up(good, warn):
    return f"CASE WHEN v IS NULL THEN 'na' WHEN v >= {good} THEN 'good' WHEN v >= {warn} THEN 'warn' ELSE 'bad' END"


def _down(good, warn):
    return f"CASE WHEN v IS NULL THEN 'na' WHEN v <= {good} THEN 'good' WHEN v <= {warn} THEN 'warn' ELSE 'bad' END"


def _sign(test: str, otherwise: str):
    return f"CASE WHEN v IS NULL THEN 'na' WHEN v {test} 0 THEN 'good' ELSE '{otherwise}' END"


_IND_SQL = {
    "current_ratio": (_over("c_current_assets", "c_current_liabilities"), _up(1.5, 1)),
    "quick_ratio": (_over("c_current_assets - c_inventory", "c_current_liabilities"), _up(1, 0.7)),
    "cash_ratio": (_over("c_cash", "c_current_liabilities"), _up(0.2, 0.1)),
    "debt_ratio": ("NULL::DOUBLE", _down(0.5, 0.7)), "debt_equity": ("NULL::DOUBLE", _down(1, 2)),
    "equity_ratio": (_over("c_equity", "c_assets"), _up(0.5, 0.3)),
    "roa": (_over("c_net_profit", _mean_sql("assets")), _up(0.08, 0.03)),
    "roe": (_over("c_net_profit", _mean_sql("equity")), _up(0.15, 0.08)),
    "net_margin": (_over("c_net_profit", "c_revenue"), _up(0.1, 0.04)),
    "gross_margin": (_over("c_gross_profit", "c_revenue"), _up(0.3, 0.15)),
    "operating_margin": (_over("c_operating_profit", "c_revenue"), _up(0.12, 0.05)),
    "ebitda_margin": ("NULL::DOUBLE", _up(0.15, 0.08)),
    "asset_turnover": (_over("c_revenue", _mean_sql("assets")), _up(1, 0.5)),
    "inventory_turnover": (_over("abs(c_cogs)", _mean_sql("inventory")), _up(4, 2)),
    "receivables_turnover": (_over("c_revenue", _mean_sql("receivables")), _up(6, 3)),
    "ocf_ratio": (_over("c_operating_cash_flow", "c_current_liabilities"), _up(0.5, 0.2)),
    "free_cash_flow": ("c_operating_cash_flow - abs(c_capex)", _sign(">", "bad")),
    "working_capital": ("c_current_assets - c_current_liabilities", _sign(">=", "bad")),
    "net_debt": ("NULL::DOUBLE", _sign("<=", "warn")), "net_debt_equity": ("NULL::DOUBLE", _down(0.5, 1.5)),
    "interest_coverage": (_over("c_operating_profit", "abs(c_interest_expense)"), _up(5, 2)),
    "ocf_margin": (_over("c_operating_cash_flow", "c_revenue"), _up(0.12, 0.05)),
    "cash_conversion": (_over("c_operating_cash_flow", "c_net_profit"), _up(1, 0.7)),
    "revenue_growth": (_over("c_revenue - p_revenue", "abs(p_revenue)"), _up(0.1, 0)),
    "net_profit_growth": (_over("c_net_profit - p_net_profit", "abs(p_net_profit)"), _up(0.1, 0)),
}
_BANK_SQL = {
    "roa": (_over("c_net_profit", _mean_sql("assets")), _up(0.015, 0.007)),
    "roe": (_over("c_net_profit", _mean_sql("equity")), _up(0.15, 0.08)),
    "equity_ratio": (_over("c_equity", "c_assets"), _up(0.10, 0.07)),
    "bank_loan_to_deposit": (_over("c_bank_customer_loans", "c_bank_customer_funds"), "CASE WHEN v IS NULL THEN 'na' WHEN v BETWEEN 0.70 AND 0.95 THEN 'good' WHEN v BETWEEN 0.55 AND 1.10 THEN 'warn' ELSE 'bad' END"),
    "bank_cost_to_income": (_over("abs(c_bank_operating_expenses)", "c_bank_net_operating_income"), _down(0.45, 0.60)),
    "bank_credit_loss_to_loans": (_over("abs(c_bank_credit_loss_charge)", _mean_sql("bank_customer_loans")), _down(0.02, 0.04)),
    "bank_net_interest_income_to_assets": (_over("c_bank_net_interest_income", _mean_sql("assets")), _up(0.04, 0.02)),
    "bank_net_interest_income_growth": (_over("c_bank_net_interest_income - p_bank_net_interest_income", "abs(p_bank_net_interest_income)"), _up(0.10, 0)),
    "bank_fee_income_growth": (_over("c_bank_fee_income - p_bank_fee_income", "abs(p_bank_fee_income)"), _up(0.08, 0)),
    "net_profit_growth": (_over("c_net_profit - p_net_profit", "abs(p_net_profit)"), _up(0.10, 0)),
}


def _ratio_union(table: dict) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{k}' AS ratio_key, v AS value, {g} AS status, cur_year, prev_year FROM (SELECT *, {v} AS v FROM w)" for k, (v, g) in table.items())


_RATIOS_CTE = f"{FX_SQL}, {_wide_sql(_IND_INPUTS)}, rt AS MATERIALIZED ({_ratio_union(_IND_SQL)})"
_GROUP_CASE = "CASE " + " ".join(f"WHEN ratio_key IN ({', '.join(repr(k) for k in keys)}) THEN '{g}'" for g, keys in ratios.GROUPS.items()) + " END"
_BONUS = "CASE source_type " + " ".join(f"WHEN '{s}' THEN {b}::DOUBLE" for s, b in SOURCE_BONUS.items()) + " ELSE 0::DOUBLE END"
#: In the fixture units are thousands or millions of rubles.
_KEPT_CTE = f"""{FX_SQL},
sized AS (SELECT *, count(*) OVER r AS n, max(abs(val)) FILTER (val <> 0) OVER r AS hi, min(abs(val)) FILTER (val <> 0) OVER r AS lo FROM fx_candidates WINDOW r AS (PARTITION BY doc_id, metric_key, seq)),
kept AS MATERIALIZED (
  SELECT doc_id, branch, metric_key, seq, source_type, confidence, 'тыс. руб.' AS unit, row_code, yr,
    val * CASE WHEN unit = 'млн руб.' THEN 1000 ELSE 1 END AS val, confidence + {_BONUS} AS quality FROM sized
  WHERE (hi IS NULL OR hi <= 50 * lo) AND NOT (source_type IN ('pdf_text', 'ocr_coordinate_table') AND n < 2 AND confidence < 0.9)),
ok AS (SELECT * FROM kept WHERE abs(val) <= 5e11),
merged AS MATERIALIZED (SELECT doc_id, branch, metric_key, yr, val, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, metric_key, yr ORDER BY quality DESC, seq DESC) AS n FROM ok) WHERE n = 1),
taken AS (SELECT * FROM (SELECT *, max(quality) OVER (PARTITION BY doc_id, metric_key, yr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ok)
  WHERE best IS NULL OR quality >= best),
attr AS MATERIALIZED (SELECT doc_id, branch, metric_key, max(least(confidence, 1.0)) AS confidence, arg_max(row_code, seq) FILTER (row_code IS NOT NULL) AS row_code,
  arg_max(source_type, (quality, seq)) AS source_type, arg_max(unit, (quality, seq)) AS unit, count(DISTINCT seq) AS n_accepted FROM taken GROUP BY ALL)"""
_AGREE = "abs({a} - {b}) <= greatest(abs({a}), abs({b}), 1.0) * 0.02"
_SIDES_CTE = """bal AS (SELECT doc_id, yr, max(val) FILTER (metric_key = 'assets') AS a, max(val) FILTER (metric_key = 'noncurrent_assets') AS n, max(val) FILTER (metric_key = 'current_assets') AS c,
  max(val) FILTER (metric_key = 'equity') AS e, max(val) FILTER (metric_key = 'longterm_liabilities') AS l, max(val) FILTER (metric_key = 'current_liabilities') AS k FROM fx_facts GROUP BY doc_id, yr),
sides AS (SELECT doc_id, yr, 'assets_equals_sections' AS check_name, a AS left_side, n + c AS right_side FROM bal
  UNION ALL SELECT doc_id, yr, 'assets_equals_equity_and_liabilities', a, e + l + k FROM bal),
checks AS MATERIALIZED (SELECT *, CASE WHEN left_side IS NULL OR right_side IS NULL THEN 'not_tested'
  WHEN abs(left_side - right_side) <= greatest(abs(left_side), abs(right_side), 1.0) * 0.02 THEN 'passed' ELSE 'failed' END AS status FROM sides)"""
_ROWS_CTE = f"""mt AS (SELECT a.* EXCLUDE (confidence), CASE WHEN a.metric_key = 'inventory' AND a.doc_id % 2 = 0 THEN 0.5 ELSE confidence END AS confidence,
  (SELECT max(abs(m.val)) FROM merged m WHERE m.doc_id = a.doc_id AND m.metric_key = a.metric_key) AS largest FROM attr a),
rc AS MATERIALIZED (SELECT *, concat_ws(',', CASE WHEN largest IS NULL THEN 'no_values' END,
  CASE WHEN source_type LIKE '%ocr' AND confidence < 0.72 THEN 'low_ocr_confidence'
    WHEN confidence < 0.55 AND source_type NOT IN ({', '.join(repr(s) for s in TRUSTED_SOURCES)}) THEN 'low_confidence' END,
  CASE WHEN largest > 1e15 THEN 'implausible_magnitude' END) AS issues FROM mt)"""
_SCORE_CTE = f"""{_KEPT_CTE}, {_SIDES_CTE}, {_ROWS_CTE},
roll AS (SELECT doc_id, count(*) FILTER (status = 'passed') AS n_passed, count(*) FILTER (status = 'failed') AS n_failed FROM checks GROUP BY doc_id),
cnt AS (SELECT doc_id, branch, count(*) AS n_valid, count(*) FILTER (metric_key IN ({', '.join(repr(k) for k in validate.CORE)})) AS n_core,
  count(row_code) AS n_coded, count(*) FILTER (source_type LIKE 'ras\\_%' ESCAPE '\\' OR source_type LIKE 'ifrs\\_primary%' ESCAPE '\\') AS n_primary FROM rc WHERE issues = '' GROUP BY doc_id, branch),
sc AS (SELECT *, 3*n_valid + 12*n_core + 8*n_passed + 2*n_coded + n_primary - 35*n_failed AS score, n_valid >= 8 AND n_core >= 3 AND n_failed = 0 AS reliable FROM cnt JOIN roll USING (doc_id))"""
_FLAG_RULES = [
    ("negative_equity", "critical", "c_equity < 0"), ("net_loss", "high", "c_net_profit < 0"), ("negative_ocf", "high", "c_operating_cash_flow < 0"),
    ("low_liquidity", "high", _IND_SQL["current_ratio"][0] + " < 1"), ("revenue_decline", "medium", _IND_SQL["revenue_growth"][0] + " < 0"),
    ("profit_decline", "medium", _IND_SQL["net_profit_growth"][0] + " < 0"),
]
_ORD = {"negative_equity": 1, "net_loss": 2, "negative_ocf": 3, "low_liquidity": 4, "revenue_decline": 6, "profit_decline": 7}
_FLAGS_SQL = " UNION ALL ".join(f"SELECT doc_id, {_ORD[c]} AS ord, '{c}' AS code, '{s}' AS severity FROM w WHERE {t}" for c, s, t in _FLAG_RULES)
_GONE = (
    "NOT (metric_key = 'assets' AND doc_id % 3 = 1) AND NOT (metric_key = 'current_assets' AND doc_id % 4 = 2) AND NOT (metric_key = 'equity' AND doc_id % 5 = 3)"
    " AND NOT (metric_key = 'gross_profit' AND doc_id % 2 = 0) AND NOT (metric_key = 'cogs' AND doc_id % 6 = 5) AND NOT (metric_key = 'cash' AND yr = 1996)"
)


def _rule_cte(number: int, target: str, formula: str, inputs: list[str]) -> str:
    """One derivation as rows: facts so far, and the target where its document has it in no year."""
    before = f"d{number - 1}"
    joins = " ".join(f"JOIN {before} i{n} ON i{n}.doc_id = b.doc_id AND i{n}.yr = b.yr AND i{n}.metric_key = '{k}'" for n, k in enumerate(inputs))
    for n, k in sorted(enumerate(inputs), key=lambda x: -len(x[1])):
        formula = formula.replace(k, f"@{n}@")
    for n in range(len(inputs)):
        formula = formula.replace(f"@{n}@", f"i{n}.val")
    least = ", ".join(f"i{n}.confidence" for n in range(len(inputs)))
    return f"""d{number} AS MATERIALIZED (SELECT * FROM {before} UNION ALL
  SELECT b.doc_id, '{target}', b.yr, {formula}, least({least}), true FROM (SELECT DISTINCT doc_id, yr FROM {before}) b {joins}
  WHERE NOT EXISTS (SELECT 1 FROM {before} x WHERE x.doc_id = b.doc_id AND x.metric_key = '{target}'))"""


_DERIVE_SQL = f"""WITH {FX_SQL}, d0 AS MATERIALIZED (SELECT doc_id, metric_key, yr, val, CASE WHEN metric_key IN ('equity', 'cogs') THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence, false AS is_derived FROM fx_facts WHERE {_GONE}),
{', '.join(_rule_cte(i, *rule) for i, rule in enumerate(model.DERIVATIONS, 1))}
SELECT doc_id, metric_key, yr, round(val, 5) + 0.0 AS val, confidence FROM d{len(model.DERIVATIONS)} WHERE is_derived AND metric_key NOT LIKE '%debt_component'"""
_REG = "reg AS (SELECT user_id AS doc_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n_events FROM events GROUP BY user_id)"
_TREND = """tr AS (SELECT doc_id, metric_key, lag(yr) OVER y AS from_year, yr AS to_year, lag(val) OVER y AS from_value, val AS to_value FROM fx_facts WINDOW y AS (PARTITION BY doc_id, metric_key ORDER BY yr))"""


def _change(k: str) -> str:
    return f"{_over(f'c_{k} - p_{k}', f'abs(p_{k})')} * 100 AS d_{k}"


_OVERRIDE = _RATIOS_CTE.replace("fx_facts AS MATERIALIZED (", "fx_all AS MATERIALIZED (", 1).replace("yrs AS (", """fx_facts AS MATERIALIZED (SELECT * FROM fx_all WHERE doc_id % 4 <> 0
  UNION ALL SELECT doc_id, metric_key, yr, val / 2 FROM fx_all WHERE doc_id % 4 = 0 AND metric_key <> 'cash'), yrs AS (""", 1)
_OVERRIDE = _OVERRIDE.replace("FROM fx_facts f CROSS JOIN", "FROM fx_all f CROSS JOIN")
ORACLE_SQL = {
    "manual_override": f"WITH {_OVERRIDE} SELECT doc_id, ratio_key, round(value, 5) AS value, status FROM rt",
    "stream_status": f"WITH {_REG} SELECT * FROM reg",
    "ratios_industrial": f"WITH {_RATIOS_CTE} SELECT doc_id, ratio_key, round(value, 6) AS value, status, cur_year, prev_year FROM rt",
    "ratios_bank": f"WITH {BANK_SQL}, {_wide_sql(_BANK_INPUTS)} SELECT doc_id, ratio_key, round(value, 6) AS value, status, cur_year, prev_year FROM ({_ratio_union(_BANK_SQL)})",
    "ratio_groups": f"WITH {_RATIOS_CTE} SELECT {_GROUP_CASE} AS ratio_group, status, count(*) AS n_ratios FROM rt WHERE status <> 'na' GROUP BY 1, 2",
    "trends_yoy": f"WITH {FX_SQL}, {_TREND} SELECT doc_id, metric_key, from_year, to_year, round(from_value, 5) AS from_value, round(to_value, 5) AS to_value, round(to_value - from_value, 5) AS absolute_change, round((to_value - from_value) / nullif(abs(from_value), 0) * 100, 6) AS percent_change FROM tr WHERE from_year IS NOT NULL",
    "top_movers": f"""WITH {FX_SQL}, {_TREND}, ch AS (SELECT doc_id, metric_key, (to_value - from_value) / nullif(abs(from_value), 0) * 100 AS pc FROM tr WHERE from_year IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, metric_key ORDER BY to_year DESC) = 1)
SELECT doc_id, metric_key, row_number() OVER (PARTITION BY doc_id ORDER BY abs(pc) DESC, metric_key)::INTEGER AS rank,
  CASE WHEN regexp_matches(metric_key, 'liabilities|inventory') THEN CASE WHEN pc < 0 THEN 'strength' ELSE 'weakness' END
    WHEN regexp_matches(metric_key, 'revenue|profit|cash') THEN CASE WHEN pc > 0 THEN 'strength' ELSE 'weakness' END ELSE 'neutral' END AS direction, round(pc, 6) AS percent_change
FROM ch WHERE abs(pc) >= 1 QUALIFY rank <= 8""",
    "latest_value": f"WITH {FX_SQL} SELECT doc_id, metric_key, max(yr) AS yr, round(arg_max(val, yr), 5) AS val FROM fx_facts GROUP BY doc_id, metric_key",
    "registry_latest": f"WITH {_REG} SELECT * FROM reg",
    "registry_top": f"WITH {_REG} SELECT * FROM reg ORDER BY updated_at DESC, doc_id LIMIT 100",
    "registry_live": f"WITH {_REG} SELECT * FROM reg WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND value < 1)",
    "merge_candidates": f"WITH {_KEPT_CTE} SELECT doc_id, metric_key, yr, round(val, 5) AS val, seq FROM merged",
    "merge_attributes": f"WITH {_KEPT_CTE} SELECT doc_id, metric_key, confidence, row_code, source_type, unit, n_accepted FROM attr",
    "outlier_years": f"""WITH {_KEPT_CTE} SELECT doc_id, metric_key, yr, round(val, 5) AS val FROM (SELECT *, max(abs(val)) FILTER (val <> 0) OVER k AS hi, min(abs(val)) FILTER (val <> 0) OVER k AS lo FROM merged WINDOW k AS (PARTITION BY doc_id, metric_key)) WHERE hi > 100 * lo AND abs(val) = hi""",
    "derive_metrics": _DERIVE_SQL,
    "reconcile_balance": _repairs_sql(),
    "identity_checks": f"WITH {FX_SQL}, {_SIDES_CTE} SELECT doc_id, yr, check_name, status, round(left_side, 5) AS left_side, round(right_side, 5) AS right_side FROM checks",
    "row_checks": f"WITH {_KEPT_CTE}, {_ROWS_CTE} SELECT doc_id, metric_key, CASE WHEN issues = '' THEN 'valid' ELSE 'invalid' END AS status, issues FROM rc",
    "validation_status": f"WITH {FX_SQL}, {_SIDES_CTE} SELECT doc_id, CASE WHEN n_failed > 0 THEN 'failed' WHEN n_passed > 0 THEN 'passed' ELSE 'partial' END AS validation, n_passed, n_failed, n_not_tested FROM (SELECT doc_id, count(*) FILTER (status = 'passed') AS n_passed, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'not_tested') AS n_not_tested FROM checks GROUP BY doc_id)",
    "branch_scores": f"WITH {_SCORE_CTE} SELECT doc_id, branch, n_valid, n_core, n_coded, score, reliable FROM sc",
    "branch_choice": f"WITH {_SCORE_CTE} SELECT doc_id, CASE WHEN bool_or(reliable) THEN 'ras' ELSE 'generic' END AS branch FROM sc GROUP BY doc_id",
    "coverage": f"""WITH {FX_SQL}, k AS (SELECT DISTINCT doc_id, metric_key FROM fx_facts WHERE {_GONE}), core AS (SELECT unnest({validate.CORE!r}) AS metric_key)
SELECT doc_id, (SELECT count(*) FROM k WHERE k.doc_id = d.doc_id)::INTEGER AS n_metrics, coalesce((SELECT string_agg(metric_key, ',' ORDER BY metric_key) FROM k JOIN core USING (metric_key) WHERE k.doc_id = d.doc_id), '') AS found,
  coalesce((SELECT string_agg(metric_key, ',' ORDER BY metric_key) FROM core WHERE metric_key NOT IN (SELECT metric_key FROM k WHERE k.doc_id = d.doc_id)), '') AS missing FROM (SELECT DISTINCT doc_id FROM k) d""",
    "risk_numeric": f"WITH {FX_SQL}, {_wide_sql(_IND_INPUTS)} {_FLAGS_SQL}",
    "doc_score": f"""WITH {_RATIOS_CTE}, fl AS ({_FLAGS_SQL}), g AS (SELECT doc_id, count(*) FILTER (status <> 'na') AS n_available, avg(CASE status WHEN 'good' THEN 100 WHEN 'warn' THEN 60 WHEN 'bad' THEN 20 END) AS base FROM rt GROUP BY doc_id),
p AS (SELECT doc_id, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 6 WHEN 'medium' THEN 3 ELSE 1 END) AS lost FROM fl GROUP BY doc_id)
SELECT doc_id, n_available, CASE WHEN n_available >= 5 THEN greatest(0, least(100, round_even(base - coalesce(lost, 0), 0)))::INTEGER END AS score, CASE WHEN n_available >= 5 THEN 'financial' ELSE 'document_completeness' END AS mode FROM g LEFT JOIN p USING (doc_id)""",
    "pivot_model": f"WITH {FX_SQL}, cells AS (SELECT doc_id, metric_key, 'y' || yr AS y, round(val, 5) AS val FROM fx_facts) PIVOT cells ON y USING max(val) GROUP BY doc_id, metric_key",
    "export_union": f"""WITH {_RATIOS_CTE} SELECT doc_id, 'financial' AS section, metric_key AS key, yr, round(val, 4) AS value, NULL::VARCHAR AS status FROM fx_facts
UNION ALL SELECT doc_id, 'ratio', ratio_key, cur_year, round(value, 4), status FROM rt""",
}
_SURE = [s for s in TRUSTED_SOURCES if s not in ("manual", "ras_ocr_form", "ifrs_primary_statement", "ifrs_disclosure_note")]
ORACLE_SQL["payload"] = f"""WITH a AS (SELECT *, CASE WHEN metric_key = 'inventory' AND doc_id % 2 = 0 THEN 0.5 ELSE coalesce(confidence, 0) END AS sure FROM ({ORACLE_SQL["merge_attributes"]})),
m AS (SELECT doc_id, string_agg(metric_key || ':' || source_type, ',' ORDER BY metric_key) AS metrics FROM a
  WHERE source_type = 'manual' OR sure >= 0.90 OR (sure >= 0.72 AND source_type IN ({", ".join(repr(x) for x in _SURE)})) GROUP BY doc_id),
r AS (SELECT doc_id, string_agg(ratio_key || ':' || status, ',' ORDER BY ratio_key) AS ratios FROM ({ORACLE_SQL["ratios_industrial"]}) WHERE status <> 'na' GROUP BY doc_id),
f AS (SELECT doc_id, string_agg(code || ':' || severity, ',' ORDER BY ord) AS flags FROM ({ORACLE_SQL["risk_numeric"]}) GROUP BY doc_id)
SELECT doc_id, coalesce(metrics, '') AS metrics, coalesce(ratios, '') AS ratios, coalesce(flags, '') AS flags FROM m FULL JOIN r USING (doc_id) LEFT JOIN f USING (doc_id)"""
ORACLE_SQL["stream_models"] = ORACLE_SQL["merge_candidates"].replace("c_nationkey::BIGINT", "c_custkey::BIGINT")
