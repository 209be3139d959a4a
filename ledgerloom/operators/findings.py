"""Rule-based findings: each rule reads a document's ratios and changes and writes a line in a section.

Rules of one document are an array on its one row, so precedence between them needs no join: a rule
may ask what others found (else-if), and a section that stays empty, or short, is filled from the next
source: movers of operational figures, then graded ratios, then a line that says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TRUSTED_SOURCES, bound, format_amount, format_decimal, format_percent, percent_change, those_that
from .ratios import BANK_GRADES, INDUSTRIAL_GRADES, INPUTS, bank, graded, industrial, latest_wide
from .risk import flag_array

#: Lines kept in each section; sections without a number keep all.
MOST = {"summary": 7, "strengths": 5, "weaknesses": 5, "risks": 5, "actions": 5, "observations": 4, "esg": 5}
#: Ratios that stand for an empty section, actions under which one is added, risks of figures and of texts that are told.
FALLBACKS, LEAST_ACTIONS, FIGURE_RISKS, TEXT_RISKS = 4, 3, 3, 4
#: Flags with an order up to this one come from figures, the others from texts.
LAST_FIGURE_FLAG = 7
_CHANGES = [
    "revenue", "gross_profit", "net_profit", "operating_profit", "current_assets", "current_liabilities", "operating_cash_flow", "assets", "cash",
    "bank_customer_loans", "bank_customer_funds", "bank_net_interest_income", "bank_fee_income",
]
_ROW = "array<struct<section:string,n:int,rule_id:string,text:string>>"
_FLAGS = "array<struct<ord:int,code:string,severity:string>>"
_MOVERS = "array<struct<rank:int,name:string,change:double,direction:string>>"
_ESG = "array<struct<ord:int,text:string>>"

Rule = tuple[str, str, Column, Column]


def wide(facts: DataFrame) -> DataFrame:
    """One row a document: amounts of two years, all ratios, and percent changes named d_metric."""
    base = latest_wide(facts, INPUTS)
    diffs = {f"d_{k}": percent_change(F.col(f"c_{k}"), F.col(f"p_{k}")) for k in _CHANGES}
    return base.select("*", *[v.alias(k) for k, v in industrial().items()], *[v.alias(f"b_{k}") for k, v in bank().items()], *[v.alias(k) for k, v in diffs.items()])


def known_of(
    flags: DataFrame | None = None, movers: DataFrame | None = None, esg: DataFrame | None = None, about: DataFrame | None = None
) -> DataFrame | None:
    """One row a document with what is known beside its figures, by one grouping of all parts.

    flags: doc_id, ord, code, severity, of texts; movers: doc_id, rank, name, change, direction (strength,
    weakness or neutral); esg: doc_id, ord, text; about: doc_id, is_ras, audit_opinion.
    """
    kinds = {"flags": (flags, _FLAGS), "movers": (movers, _MOVERS), "esg": (esg, _ESG), "about": (about, "array<struct<is_ras:boolean,audit_opinion:string>>")}
    parts = []
    for name, (rows, kind) in kinds.items():
        if rows is not None:
            names = [field.split(":")[0] for field in kind[13:-2].split(",")]
            own = F.struct(*[F.col(c) for c in names]).cast(kind[6:-1])
            parts.append(rows.select("doc_id", *[(own if n == name else F.lit(None).cast(k[6:-1])).alias(n) for n, (_, k) in kinds.items()]))
    if not parts:
        return None
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    lists = [F.array_sort(F.collect_list(n)).alias(n) for n in ("flags", "movers", "esg")]
    return whole.groupBy("doc_id").agg(*lists, F.max("about").alias("about")).select("doc_id", "flags", "movers", "esg", "about.*")


def _said(*parts: Column | str) -> Column:
    """The parts in a row, those that are null left out."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _change(key: str) -> Column:
    return format_percent(F.col(f"d_{key}"))


def _industrial_rules() -> list[Rule]:
    c = F.col
    told = lambda key: c(key).isNotNull()
    ratio = lambda key, name: F.when(told(key), _said(f" {name} ", format_decimal(c(key))))
    percent = lambda key, name: F.when(told(key), _said(f" {name} ", format_percent(c(key) * 100)))
    liquid = F.coalesce((c("current_ratio") >= 1) & F.coalesce(c("quick_ratio") >= 0.8, F.lit(True)), F.lit(False))
    easy = F.coalesce((c("debt_equity") <= 1.5) & F.coalesce(c("interest_coverage") >= 2, F.lit(True)), F.lit(False))
    paid = F.coalesce((c("c_operating_cash_flow") > 0) & F.coalesce(c("cash_conversion") >= 0.8, F.lit(True)), F.lit(False))
    any_of = lambda test, keys: F.greatest(*[F.coalesce(test(c(f"d_{k}")), F.lit(False)) for k in keys])
    falls = any_of(lambda d: d < 0, ["revenue", "gross_profit", "operating_profit", "net_profit"])
    rises = any_of(lambda d: d > 0, ["revenue", "operating_profit", "net_profit"])
    below = F.coalesce((c("d_operating_profit") > 0) & (c("d_net_profit") < 0), F.lit(False))
    margins = [percent("gross_margin", "валовая"), percent("operating_margin", "операционная"), percent("net_margin", "чистая")]
    liquidity = _said("Ликвидность:", ratio("current_ratio", "текущая"), ratio("quick_ratio", "быстрая"), ratio("cash_ratio", "абсолютная"))
    debt = _said("Долг к капиталу", ratio("debt_equity", ""), percent("equity_ratio", "доля капитала"), ratio("interest_coverage", "покрытие процентов"))
    cash = _said("Операционный поток ", format_amount(c("c_operating_cash_flow"), F.lit("тыс. руб.")), ratio("cash_conversion", "конверсия прибыли"))
    severe = F.exists("flags", lambda f: f["severity"].isin("critical", "high"))
    return [
        ("summary", "opening", F.lit(True), _said("Анализ отчетности за ", c("cur_year").cast("string"))),
        ("summary", "revenue_change", told("d_revenue"), _said("Выручка: изменение ", _change("revenue"))),
        ("summary", "operating_change", told("d_operating_profit"), _said("Прибыль от продаж: изменение ", _change("operating_profit"))),
        ("summary", "net_profit_change", told("d_net_profit"), _said("Чистая прибыль: изменение ", _change("net_profit"))),
        ("summary", "liquidity", told("current_ratio"), liquidity),
        ("summary", "leverage", told("debt_equity"), debt),
        ("summary", "cash_flow", told("c_operating_cash_flow"), cash),
        ("summary", "top_risk", F.size("flags") > 0, _said("Главный риск: ", F.get("flags", F.lit(0))["code"])),
        ("strengths", "margins", F.coalesce("gross_margin", "operating_margin", "net_margin").isNotNull(), _said("Маржинальность:", *margins, percent("roa", "ROA"), percent("roe", "ROE"))),
        ("strengths", "liquidity_cover", told("current_ratio") & liquid, liquidity),
        ("weaknesses", "liquidity_gap", told("current_ratio") & ~liquid, liquidity),
        ("strengths", "moderate_debt", told("debt_equity") & easy, debt),
        ("weaknesses", "high_debt", told("debt_equity") & ~easy, debt),
        ("weaknesses", "declining", falls, _said("Снижаются показатели отчета о результатах: выручка ", _change("revenue"), ", прибыль ", _change("net_profit"))),
        ("strengths", "growing", ~falls & rises, _said("Растут показатели отчета о результатах: выручка ", _change("revenue"), ", прибыль ", _change("net_profit"))),
        ("strengths", "cash_quality", told("c_operating_cash_flow") & paid, cash),
        ("weaknesses", "cash_quality_low", told("c_operating_cash_flow") & ~paid, cash),
        ("weaknesses", "cash_flow_decline", c("d_operating_cash_flow") < 0, _said("Операционный поток снизился: ", _change("operating_cash_flow"), F.when(c("d_cash") < 0, _said(", остаток денег ", _change("cash"))))),
        ("observations", "liquidity_scissors", (c("d_current_assets") < 0) & (c("d_current_liabilities") > 0), F.lit("Оборотные активы снижаются при росте краткосрочных обязательств")),
        ("observations", "below_operations", below, F.lit("Прибыль от продаж растет, чистая снижается")),
        ("observations", "growth_without_profit", ~below & (c("d_revenue") > 0) & (c("d_net_profit") < 0), F.lit("Выручка растет, чистая прибыль снижается")),
        ("observations", "cash_and_profit", told("d_operating_cash_flow") & told("d_net_profit"), _said("Изменение потока ", _change("operating_cash_flow"), ", прибыли ", _change("net_profit"))),
        ("observations", "turnover", told("d_assets") & told("asset_turnover"), _said("Активы: изменение ", _change("assets"), ", оборачиваемость ", format_decimal(c("asset_turnover")))),
        ("actions", "payment_calendar", c("current_ratio") < 1, F.lit("Вести платежный календарь и резерв денежных средств")),
        ("actions", "profit_bridge", c("d_net_profit") < 0, F.lit("Разложить путь от прибыли от продаж к чистой прибыли")),
        ("actions", "cash_bridge", c("d_operating_cash_flow") < 0, F.lit("Разложить снижение операционного потока по причинам")),
        ("actions", "stress_test", told("debt_equity"), F.lit("Проверить долг и ликвидность в стресс-сценариях")),
        ("actions", "risk_owners", severe, F.lit("Назначить владельцев и лимиты существенных рисков")),
        ("limitations", "ras_scope", c("is_ras"), F.lit("Отчетность одного юридического лица не заменяет консолидированную")),
    ]


def _bank_rules() -> list[Rule]:
    c = F.col
    told = lambda *keys: F.least(*[c(k).isNotNull() for k in (*keys, *keys[:1])])
    loans = _said("Кредиты: изменение ", _change("bank_customer_loans"), ", средства клиентов ", _change("bank_customer_funds"))
    interest = _said("Процентные доходы: изменение ", _change("bank_net_interest_income"))
    return [
        ("summary", "opening", F.lit(True), _said("Анализ отчетности банка за ", c("cur_year").cast("string"))),
        ("summary", "assets", told("c_assets", "d_assets"), _said("Активы: изменение ", _change("assets"))),
        ("summary", "loans_and_funds", told("d_bank_customer_loans", "d_bank_customer_funds"), loans),
        ("summary", "interest_and_fees", told("d_bank_net_interest_income", "d_bank_fee_income"), _said(interest, ", комиссионные ", _change("bank_fee_income"))),
        ("summary", "profit", told("c_net_profit", "d_net_profit"), _said("Прибыль: изменение ", _change("net_profit"))),
        ("summary", "returns", told("b_roa", "b_roe"), _said("ROA ", format_percent(c("b_roa") * 100), ", ROE ", format_percent(c("b_roe") * 100))),
        ("actions", "compare_limits", F.lit(True), F.lit("Сопоставить портфель и фондирование с лимитами")),
        ("actions", "explain_interest", F.lit(True), F.lit("Разложить процентный доход по причинам")),
        ("actions", "control_costs", F.lit(True), F.lit("Контролировать расходы и комиссии ежемесячно")),
        ("actions", "check_capital", F.lit(True), F.lit("Сверить капитал с обязательными нормативами")),
        ("observations", "loans_against_funds", told("d_bank_customer_loans", "d_bank_customer_funds"), loans),
        ("observations", "interest_against_profit", told("d_bank_net_interest_income", "d_net_profit"), _said(interest, ", прибыли ", _change("net_profit"))),
        ("observations", "credit_losses", told("b_bank_credit_loss_to_loans"), _said("Резервы к кредитам ", format_percent(c("b_bank_credit_loss_to_loans") * 100))),
        ("limitations", "bank_forms", F.lit(True), F.lit("Публичные формы не заменяют отчетность группы и нормативы")),
        ("esg", "bank_no_esg", F.lit(True), F.lit("Формы банка не содержат показателей устойчивого развития")),
    ]


def _row(section: str | Column, n: Column, rule_id: Column, text: Column) -> Column:
    section = F.lit(section) if isinstance(section, str) else section
    return F.struct(section.alias("section"), n.cast("int").alias("n"), rule_id.alias("rule_id"), text.alias("text"))


def _array(rules: list[Rule]) -> Column:
    return those_that(*[(r[2], _row(r[0], F.lit(i), F.lit(r[1]), r[3])) for i, r in enumerate(rules)])


def _ratio_lines(values: dict[str, Column], grades: dict) -> Column:
    """The graded ratios of a document in their order: status, key, value."""
    one = lambda key, v: F.struct(graded(key, v, grades).alias("status"), F.lit(key).alias("key"), v.alias("value"))
    return those_that(*[(v.isNotNull(), one(k, v)) for k, v in values.items()])


def _of_ratios(section: str, statuses: list[str], most: int) -> Column:
    chosen = F.slice(F.filter("ratio_lines", lambda r: r["status"].isin(*statuses)), 1, most)
    prefix = "good_" if section == "strengths" else "weak_"
    return F.transform(chosen, lambda r, i: _row(section, 1000 + i, F.concat(F.lit(prefix), r["key"]), _said(r["key"], ": ", format_decimal(r["value"], 4))))


def _then(hits: Column, when: Callable[[Column], Column], more: Column) -> Column:
    """The hits, followed by more where the condition on them holds; they are worked out once."""
    return bound(hits, lambda h: F.when(when(h), F.concat(h, more.cast(_ROW))).otherwise(h))


def _count(hits: Column, section: str) -> Column:
    return F.size(F.filter(hits, lambda h: h["section"] == section))


def _line(section: str, n: int, rule_id: str, text: str) -> Column:
    return F.array(_row(section, F.lit(n), F.lit(rule_id), F.lit(text)))


def findings(facts: DataFrame, known: DataFrame | None = None, most: dict = MOST) -> DataFrame:
    """(doc_id, section, ord, rule_id, text): the lines of each document, in order, at most so many a section.

    facts: doc_id, metric_key, yr, val. known: known_of(), also for documents without figures, whose
    operational movers stand for them. Lines that say the same in a section count once.
    """
    base = wide(facts).withColumn("has_metrics", F.lit(True))
    kinds = {"flags": _FLAGS, "movers": _MOVERS, "esg": _ESG, "is_ras": "boolean", "audit_opinion": "string"}
    base = base.join(known, "doc_id", "full") if known is not None else base.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items()})
    empty = lambda name: F.coalesce(name, F.array().cast(kinds[name]))
    figures = F.coalesce(flag_array().cast(_FLAGS), F.array().cast(_FLAGS))
    rows = base.withColumns({
        "flags": F.concat(figures, empty("flags")), "movers": empty("movers"), "esg": empty("esg"), "is_bank": F.coalesce("is_bank", F.lit(False)),
        "has_metrics": F.coalesce("has_metrics", F.lit(False)), "is_ras": F.coalesce("is_ras", F.lit(False)),
    })
    values = {k: F.col(f"b_{k}") for k in bank()}, {k: F.col(k) for k in industrial()}
    lines = F.when(F.col("is_bank"), _ratio_lines(values[0], BANK_GRADES)).otherwise(_ratio_lines(values[1], INDUSTRIAL_GRADES))
    hits = F.when(F.col("is_bank"), _array(_bank_rules())).otherwise(_array(_industrial_rules()))
    rows = rows.withColumns({"ratio_lines": lines, "hits": hits.cast(_ROW)}).select(
        "doc_id", "is_bank", "is_ras", "has_metrics", "audit_opinion", "flags", "movers", "esg", "ratio_lines", "hits"
    )
    return _ranked(rows.select("doc_id", F.explode(_completed()).alias("h")).select("doc_id", "h.*"), most)


def _completed() -> Column:
    """The hits of a document and what comes to them from other sources, one after another."""
    is_bank, is_ras = F.col("is_bank"), F.col("is_ras")

    def moved(section: str, kind: str | None = None) -> Column:
        chosen = F.filter("movers", lambda m: m["direction"] == kind) if kind else F.col("movers")
        return F.transform(chosen, lambda m: _row(section, 100 + m["rank"], F.concat(F.lit("mover_"), m["name"]), _said(m["name"], ": ", format_percent(m["change"]))))

    def named(flags: Column, n: int) -> Column:
        return F.transform(F.slice(flags, 1, n), lambda f, i: _row("risks", i, F.concat(F.lit("flag_"), f["code"]), f["code"]))

    movers = F.concat(moved("strengths", "strength"), moved("weaknesses", "weakness"), moved("observations"))
    audit = F.array(_row("observations", F.lit(900), F.lit("audit_opinion"), F.col("audit_opinion")))
    steps: list[tuple[Callable[[Column], Column], Column]] = [
        (lambda h: ~F.col("has_metrics"), movers), (lambda h: ~is_bank & F.col("audit_opinion").isNotNull(), audit),
    ]
    for section, statuses, text in (
        ("strengths", ["good"], "Положительные выводы ограничены составом извлеченных строк"), ("weaknesses", ["bad", "warn"], "Отрицательные отклонения среди коэффициентов не выявлены"),
    ):
        most_ratios = F.when(is_bank, MOST[section]).otherwise(FALLBACKS)
        steps.append((lambda h, s=section: is_bank | (_count(h, s) == 0), _of_ratios(section, statuses, most_ratios)))
        steps.append((lambda h, s=section: _count(h, s) == 0, _line(section, 2000, f"no_{section}", text)))
    figure = F.filter("flags", lambda f: f["ord"] <= LAST_FIGURE_FLAG)
    disclosed = F.transform(F.slice(F.filter("flags", lambda f: f["ord"] > LAST_FIGURE_FLAG), 1, TEXT_RISKS), lambda f: f["code"])
    told = F.array(_row("risks", F.lit(50), F.lit("disclosed"), _said("В тексте раскрыты: ", F.array_join(disclosed, ", "))))
    steps.append((lambda h: F.lit(True), F.when(is_bank, named(F.col("flags"), MOST["risks"])).otherwise(named(figure, FIGURE_RISKS))))
    steps.append((lambda h: ~is_bank & (F.size(disclosed) > 0), told))
    own_esg = F.transform("esg", lambda e, i: _row("esg", i, F.concat(F.lit("esg_"), e["ord"].cast("string")), e["text"]))
    steps.append((lambda h: ~is_bank & ~is_ras, own_esg))
    steps.append((lambda h: (_count(h, "esg") == 0) & is_ras, _line("esg", 0, "ras_no_esg", "Формы не содержат показателей устойчивого развития")))
    for section, least, rule_id, text in (
        ("esg", 1, "no_esg", "Показателей устойчивого развития недостаточно"), ("risks", 1, "no_flags", "Существенные риск-флаги не выявлены"),
        ("actions", LEAST_ACTIONS, "monitoring", "Включить основные показатели в ежемесячный мониторинг"),
        ("observations", 1, "no_observations", "Интерпретация ограничена составом форм"), ("limitations", 1, "general", "Аналитика не заменяет аудит и профессиональное заключение"),
    ):
        steps.append((lambda h, s=section, n=least: _count(h, s) < n, _line(section, 3000, rule_id, text)))
    hits = F.col("hits")
    for when, more in steps:
        hits = _then(hits, when, more)
    return hits


def _ranked(hit: DataFrame, most: dict) -> DataFrame:
    same = Window.partitionBy("doc_id", "section", "text").orderBy("n", "rule_id")
    # both windows lie within a document, so one shuffle serves them
    first = hit.repartition("doc_id").withColumn("_same", F.row_number().over(same)).where("_same = 1")
    order = Window.partitionBy("doc_id", "section").orderBy("n", "rule_id")
    limit = F.try_element_at(F.create_map(*[F.lit(x) for pair in most.items() for x in pair]), F.col("section"))
    ranked = first.withColumn("ord", F.row_number().over(order)).where(limit.isNull() | (F.col("ord") <= limit))
    return ranked.select("doc_id", "section", "ord", "rule_id", "text")


def verified(metrics: DataFrame) -> DataFrame:
    """Metrics sure enough to be written about: manual, 0.90 of confidence, or a trusted source and 0.72."""
    trusted = [s for s in TRUSTED_SOURCES if s not in ("manual", "ras_ocr_form", "ifrs_primary_statement", "ifrs_disclosure_note")]
    sure = F.coalesce("confidence", F.lit(0.0))
    return metrics.where((F.col("source_type") == "manual") | (sure >= 0.90) | F.col("source_type").isin(*trusted) & (sure >= 0.72))


def payload(metrics: DataFrame, ratios: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, json): verified metrics, graded ratios and flags of a document as one JSON text."""
    rows = lambda df, name, *cols: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    joined = rows(verified(metrics), "metrics", "metric_key", "confidence", "source_type").join(rows(ratios.where("status <> 'na'"), "ratios", "ratio_key", "status"), "doc_id", "full")
    joined = joined.join(rows(flags, "flags", "ord", "code", "severity"), "doc_id", "left")
    return joined.select("doc_id", F.to_json(F.struct("metrics", "ratios", "flags")).alias("json"))


def with_overrides(facts: DataFrame, supplied: DataFrame) -> DataFrame:
    """Facts of documents with a supplied model are replaced by it whole; supplied: doc_id, metric_key, yr, val."""
    kept = facts.join(supplied.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(supplied.select("doc_id", "metric_key", "yr", "val"))
