"""Jobs over page text: classes, facts, headings, years, pages to read, bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import bound, normalize_label, parse_number
from .tables import unit_of

# ---- fixed values: keywords by category, in the order in which they are tried ----
NARRATIVE = [
    ("risks", ["риск", "ограничени", "санкц", "неопределен", "волатильн"]),
    ("strategy", ["стратег", "приоритет", "развит", "проект", "инвестиц", "модернизац"]),
    ("esg", ["устойчив", "климат", "эколог", "выброс", "охрана труда"]),
    ("governance", ["совет директоров", "корпоративное управление", "внутренний аудит", "аудитор"]),
]
OPERATIONAL = [
    ("Добыча и запасы", ["добыч", "запас", "скваж", "бурен", "нефт", "газ", "углеводород"]),
    ("Переработка и производство", ["переработ", "производств", "выпуск", "мощност", "генерац", "электроэнерг"]),
    ("Продажи и сбыт", ["реализац", "продаж", "азс", "клиент", "рынок"]),
    ("ESG и персонал", ["выброс", "климат", "персонал", "сотрудник", "травмат", "эколог"]),
    ("Корпоративное управление", ["совет директоров", "акционер", "дивиденд", "вознагражден"]),
]
OTHER = "Прочие показатели"
HEADINGS = [
    "финансовые результат", "разведка и добыча", "переработка", "устойчивое развитие", "корпоративное управление",
    "управление рисками", "персонал", "климат", "акционерный капитал", "аудиторское заключение", "денежных поток",
    "финансового положения", "бухгалтерский баланс",
]
PAGE_KINDS = [
    ("balance", ["бухгалтерский баланс", "отчет о финансовом положении", "statement of financial position", "balance sheet"]),
    ("pnl", ["отчет о финансовых результатах", "отчет о прибылях и убытках", "отчет о совокупном доходе", "statement of profit", "income statement", "statement of comprehensive income"]),
    ("cashflow", ["отчет о движении денежных средств", "statement of cash flows", "cash flow statement"]),
    ("equity_changes", ["отчет об изменениях капитала", "statement of changes in equity"]),
]
IFRS_KINDS = [
    ("balance", ["консолидированный бухгалтерский баланс", "консолидированный отчет о финансовом положении", "statement of financial position", "consolidated balance sheet"]),
    ("pnl", ["консолидированный отчет о совокупном доходе", "консолидированный отчет о прибылях", "statement of comprehensive income", "statement of profit or loss"]),
    ("cashflow", ["консолидированный отчет о движении денежных средств", "statement of cash flows"]),
]
# ---- end of fixed values ----


def first_category(text: Column, rules: list, default: str | None = None) -> Column:
    """The first rule of which a keyword stands in the normalised text."""

    def first(label: Column) -> Column:
        named = [F.when(T.holds_any(label, needles), name) for name, needles in rules]
        return F.coalesce(*named, F.lit(default).cast("string"))

    return bound(normalize_label(text), first)


def document_class(text: Column) -> Column:
    """One of six classes, by ordered rules over titles, statement codes and keywords."""
    full, intro = normalize_label(text), normalize_label(F.substring(text, 1, 15000))
    says, opens = full.contains, intro.contains
    governed = says("корпоративное управление") & says("устойчивое развитие")
    balance = says("бухгалтерский баланс") | says("statement of financial position")
    profit = says("отчет о финансовых результатах") | says("statement of profit")
    consolidated = opens("консолидированная финансовая отчетность") | opens("statement of financial position")
    international = consolidated | opens("консолидированного финансового положения") | opens("international financial reporting standards")
    return (
        F.when(opens("годовой отчет") & (opens("оглавление") | governed), "annual_report")
        .when(F.size(T.statement_codes(text)) >= 8, "ras_financial_statements")
        .when(balance & profit & international, "ifrs_financial_statements")
        .when(balance & profit, "ras_financial_statements")
        .when(consolidated, "ifrs_financial_statements")
        .when(says("годовой отчет") | governed, "annual_report")
        .when(says("аудиторское заключение") | says("independent auditor's report"), "audit_report")
        .when(says("презентация для инвесторов") | says("investor presentation"), "investor_presentation")
        .otherwise("corporate_document")
    )


def reporting_year(text: Column) -> Column:
    """From three phrases in order, else the latest plausible year of the text."""
    t = F.translate(F.lower(text), "ё", "е")
    phrases = [r"(?iu)(?:за|for)\s+(20\d{2})\s*(?:год|year)", r"(?iu)(?:годовой отчет|annual report)[^\n]{0,80}?(20\d{2})", r"(?iu)по состоянию на 31 декабря (20\d{2})"]
    said = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int") for p in phrases]
    return F.coalesce(*said, F.array_max(F.filter(T.years_in(text), lambda y: y.between(1990, 2100))))


def ifrs_unit(text: Column) -> Column:
    """The unit that a page of an international statement names in words, else the last one written."""
    t = normalize_label(text)
    ruble = t.contains("руб") | t.contains("ruble") | t.contains("rouble")
    return F.when(ruble & (t.contains("миллион") | t.contains("million")), "млн руб.").when(ruble & (t.contains("тысяч") | t.contains("thousand")), "тыс. руб.").otherwise(unit_of(text))


def narrative_facts(pages: DataFrame, rules: list = NARRATIVE, script: str = T.CYRILLIC, most: int = 24) -> DataFrame:
    """(doc_id, category, ord, page, text): clean sentences of the first category that names them.

    pages: doc_id, page, text, ocr_quality (null: not recognised). Sentences that
    share their first 220 characters count once a document.
    """
    read = pages.where("ocr_quality IS NULL OR ocr_quality >= 58")
    parts = read.select("doc_id", "page", F.posexplode(F.split("text", r"(?U)(?<=[.!?])\s+")).alias("pos", "raw"))
    one = parts.withColumn("text", T.squeezed(F.col("raw"))).where(T.clean_sentence(F.col("text"), script))
    one = one.withColumns({"category": first_category(F.col("text"), rules), "_key": F.substring(normalize_label(F.col("text")), 1, 220)}).where("category IS NOT NULL")
    first = Window.partitionBy("doc_id", "_key").orderBy("page", "pos")
    kept = one.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("doc_id", "category").orderBy("page", "pos")
    return kept.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("doc_id", "category", "ord", "page", "text")


def headings(pages: DataFrame, known: list[str] = HEADINGS, most: int = 200) -> DataFrame:
    """(doc_id, ord, page, title): numbered, upper-case or known lines; each normalised text once."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "raw"))
    lines = lines.withColumn("title", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where(F.length("title").between(3, 150))
    title = F.col("title")
    upper = (title == F.upper(title)) & (title != F.lower(title)) & (F.size(F.split(title, r"(?U)\s+")) <= 12)
    lines = lines.withColumn("_key", normalize_label(title)).where(title.rlike(r"^\d+(?:\.\d+){0,3}\.?\s+\D") | upper | T.holds_any(F.col("_key"), known))
    first = Window.partitionBy("doc_id", "_key").orderBy("page", "pos")
    kept = lines.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("doc_id").orderBy("page", "pos")
    return kept.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("doc_id", "ord", "page", "title")


def text_metrics(pages: DataFrame) -> DataFrame:
    """(doc_id, page, label, yr, val): "label year value year value" in running text."""
    line = r"(?U)([А-ЯA-ZЁ][^\n]{3,140}?)\s+(20\d{2})\s+([-+−]?\d[\d\s]*(?:[,.]\d+)?)\s+(20\d{2})\s+([-+−]?\d[\d\s]*(?:[,.]\d+)?)"
    parts = [T.found(F.col("text"), line, g) for g in range(1, 6)]
    rows = pages.select("doc_id", "page", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("label", "y1", "v1", "y2", "v2"))])).alias("pos", "m"))
    pairs = F.array(*[F.struct(F.col(f"m.y{i}").cast("int").alias("yr"), parse_number(F.col(f"m.v{i}")).alias("val")) for i in (1, 2)])
    return rows.select("doc_id", "page", F.trim("m.label").alias("label"), F.explode(pairs).alias("p")).select("doc_id", "page", "label", "p.yr", "p.val").where("val IS NOT NULL")


def document_facts(pages: DataFrame) -> DataFrame:
    """One row a document: pages with text, recognised pages, mean quality, images, weak and failed pages, years."""
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    years = F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.years_in(F.coalesce("text", F.lit("")))))))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.count_if(text).alias("text_pages"), F.count_if(F.col("ocr_quality").isNotNull()).alias("ocr_pages"),
        F.round(F.avg("ocr_quality"), 1).alias("mean_quality"), F.count_if(F.col("ocr_quality") < 58).alias("weak_pages"), years.alias("years"),
    )


def quality_scores(pages: DataFrame, script: str = T.CYRILLIC, **plausibility) -> DataFrame:
    """Adds native (of a text layer) and reading (of a recognised text; needs mean_confidence). Tokens are cut once."""
    cut = pages.withColumn("_tokens", T.found(F.coalesce("text", F.lit("")), T.TOKEN))
    cut = cut.withColumn("_alpha", F.filter("_tokens", lambda w: ~w.rlike("^[0-9]+$")))
    cut = cut.withColumn("_own", F.filter("_alpha", lambda w: w.rlike(script)))
    reading = T.read_quality(F.col("_tokens"), F.col("_alpha"), F.col("_own"), F.col("mean_confidence"), script, **plausibility)
    return cut.withColumns({"native": T.native_quality(F.col("_tokens"), F.col("text")), "reading": reading}).drop("_tokens", "_alpha", "_own")


def pages_to_read(pages: DataFrame, least_chars: int = 80) -> DataFrame:
    """Pages whose text is short or poor, covered by an image, or holds statement evidence of middling quality."""
    cut = pages.withColumn("_tokens", T.found(F.coalesce("text", F.lit("")), T.TOKEN))
    cut = cut.withColumn("quality", T.native_quality(F.col("_tokens"), F.col("text"))).drop("_tokens")
    quality = F.col("quality")
    evidence = (T.statement_titles(F.col("text")) > 0) | (F.size(T.statement_codes(F.col("text"))) >= 2)
    image = F.coalesce("image_coverage", F.lit(0.0)) >= 0.55
    why = F.when(F.length(F.trim("text")) < least_chars, "short").when(quality < 52, "poor").when(image & evidence, "image").when(evidence & (quality < 78), "evidence")
    return cut.withColumn("reason", why).where("reason IS NOT NULL")


def contents_pages(pages: DataFrame, titles: list[str] = T.CONTENTS_TITLES, first_pages: int = 8) -> DataFrame:
    """(doc_id, target): page numbers at the end of contents lines that name a statement, within the document.

    Contents are sought on the first pages.
    """
    sized = pages.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("page") <= first_pages)
    lines = sized.select("doc_id", "n", F.explode(F.split("text", "\r\n|\n|\r")).alias("line")).where(T.holds_any(normalize_label(F.col("line")), titles))
    target = F.regexp_extract(F.trim("line"), r"(\d{1,3})\s*$", 1).try_cast("int")
    return lines.withColumn("target", target).where("target BETWEEN 1 AND n").select("doc_id", "target").distinct()


def candidate_pages(pages: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, page, ord): pages with statement evidence, best first, each followed by its neighbours.

    Without any evidence, pages spaced evenly over the document.
    """
    score = 4 * F.size(T.statement_codes(F.col("text"))) + F.when(first_category(F.col("text"), PAGE_KINDS).isNotNull(), 30).otherwise(0)
    scored = pages.select("doc_id", "page", score.alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), F.col("page").desc())
    hits = scored.where("score > 0").withColumn("rank", F.row_number().over(order))
    near = hits.select("doc_id", "rank", F.posexplode(F.array(F.col("page"), F.col("page") + 1, F.col("page") - 1)).alias("pos", "page"))
    near = near.join(scored.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    near = near.groupBy("doc_id", "page").agg(F.min(F.struct("rank", "pos")).alias("at"))
    taken = near.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("ord") <= most).select("doc_id", "page", "ord")
    doc = Window.partitionBy("doc_id")
    bare = scored.withColumns({"_any": F.max("score").over(doc), "_n": F.count("*").over(doc), "_i": F.row_number().over(doc.orderBy("page")) - 1}).where("_any = 0")
    picks = F.transform(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_n")).cast("int") - 1), lambda i: F.bround(i * (F.col("_n") - 1) / max(most - 1, 1), 0).cast("int"))
    spaced = bare.where(F.array_contains(picks, F.col("_i").cast("int"))).withColumn("ord", F.row_number().over(doc.orderBy("page"))).select("doc_id", "page", "ord")
    return taken.unionByName(spaced)


def unique_texts(items: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first row of each text key in each group, at most so many a group, numbered."""
    keyed = items.withColumn("_key", T.text_key(F.col("text"))).where("_key <> ''")
    first = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))).where("_n = 1")
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("ord") <= most).drop("_key", "_n")


#: How many sound bullets a section needs before they replace the baseline. Fixed values.
SECTION_LEAST = {"strengths": 3, "weaknesses": 2, "risks": 2, "management_actions": 3, "strategic_observations": 2, "data_limitations": 1, "esg_observations": 1}


def accepted_sections(supplied: DataFrame, baseline: DataFrame, allowed: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, section, ord, text): supplied bullets where enough are sound and grounded, else the baseline.

    supplied, baseline: doc_id, section, ord, text; allowed: doc_id, numbers (array of strings).
    """
    least = F.create_map(*[F.lit(x) for pair in SECTION_LEAST.items() for x in pair])
    sound = supplied.join(allowed, "doc_id", "left").where(~T.gibberish(F.col("text")) & T.grounded(F.col("text"), F.coalesce("numbers", F.array().cast("array<string>"))))
    sound = sound.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "section"))).where(F.col("_n") >= F.coalesce(F.try_element_at(least, F.col("section")), F.lit(1)))
    rest = baseline.join(sound.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    both = sound.select("doc_id", "section", "ord", "text").unionByName(rest.select("doc_id", "section", "ord", "text"))
    return unique_texts(both.withColumnRenamed("ord", "_ord"), ["doc_id", "section"], ["_ord"], most).select("doc_id", "section", "ord", "text")


def operational_unique(items: DataFrame, script: str = T.CYRILLIC, most: int = 250) -> DataFrame:
    """(doc_id, ord, name, values, category): readable figures, each name and value set once."""
    from ..functions.scalars import consistent

    name = F.trim(F.regexp_replace("name", r"(?U)\s+", " "), F.lit(" .:;|-"))
    kept = items.withColumn("name", name).where(T.clean_kpi(F.col("name"), F.coalesce("source_type", F.lit("")), F.col("confidence"), script))
    kept = kept.where((F.size("values") > 0) & consistent(F.map_values("values")))
    kept = kept.withColumn("_same", F.to_json(F.array_sort(F.map_entries("values")))).withColumn("_key", normalize_label(F.col("name")))
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_key", "_same").orderBy("ord"))).where("_n = 1")
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where(F.col("_rank") <= most)
    return ranked.select("doc_id", F.col("_rank").alias("ord"), "name", "values", first_category(F.col("name"), OPERATIONAL, OTHER).alias("category"))
