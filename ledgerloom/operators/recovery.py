"""Second ways to a statement's content: running text, notes, transcriptions, retries, stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import bound, normalize_label, number_tokens, parse_number, text_pair
from ..functions.vocabulary import NEGATIVE, RAS_LINES, ras_lines
from .text_jobs import ifrs_unit

PAGE = ["doc_id", "page"]
# ---- fixed values: page kinds by title and by code, note lines, legal forms, marks of context ----
TEXT_KINDS = [
    ("pnl", ["отчет о финансовых результатах"]),
    ("cashflow", ["отчет о движении денежных средств", "денежные потоки от текущих операций"]),
    ("balance", ["бухгалтерский баланс", "актив", "пассив"]),
]
KIND_CODES = [("cashflow", ["4200", "4300", "4400"]), ("balance", ["1300", "1400", "1500", "1700"])]
#: (metric, titles of its section, beginnings of its line, always negative)
NOTE_LINES = [
    ("depreciation_amortization", ["операционные расходы", "operating expenses"], ["амортизация", "depreciation and amortization", "depreciation"], False),
    (
        "interest_expense", ["финансовые доходы и расходы", "finance income and expenses", "finance income and costs"],
        ["процентный расход", "interest expense", "interest costs"], True,
    ),
]
NOTE_PAGES = ["примечания", "notes to"]
FULL_COMPANY = (
    r"(?iU)(публичн\w*\s+акционерн\w*\s+обществ\w*|акционерн\w*\s+обществ\w*|открыт\w*\s+акционерн\w*\s+обществ\w*|"
    r"обществ\w*\s+с\s+ограниченн\w*\s+ответственност\w*)\s+[«\"](?:[^«»\"\n]{2,80}[«\"])?([^«»\"\n]{2,120})[»\"]"
)
SHORT_COMPANY = [r"(?iu)(ПАО|АО|ООО|ОАО)\s+[«\"]([^»\"]+)[»\"]", r"(?iu)()(?:Группа|Компания)\s+[«\"]([^»\"]+)[»\"]"]
COMPANY_LINE = ["company", "компания", "group", "группа"]
COMPANY_CONTEXT = [
    (35, ["акционер", "совет директоров"]), (20, ["бухгалтерск", "финансовой отчетност"]),
    (10, ["аудируем", "руководств"]), (-30, ["аудиторская организация", "аудитор оказ"]),
]
RAS_TYPES = ["ras_financial_statements", "bank_ras_financial_statements"]
UNKNOWN = ["не определено", "ао «кэпт»"]


def official_codes(text: Column) -> Column:
    """The distinct line codes of statutory forms that stand alone in a text."""
    codes = "|".join(line[0] for line in RAS_LINES)
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!\d)(?:{codes})(?!\d)"), F.lit(0)))


def page_kind(text: Column) -> Column:
    """Which form a page of running text belongs to, by its title or, on a continuation, by its codes."""
    label = normalize_label(text)
    kind = F.lit(None).cast("string")
    for name, codes in reversed(KIND_CODES):
        kind = F.when(T.holds_any(text, codes), name).otherwise(kind)
    for name, titles in reversed(TEXT_KINDS):
        kind = F.when(T.holds_any(label, titles), name).otherwise(kind)
    return kind


#: Unit of the rows of running text (fixed value).
TEXT_UNIT = "тыс. руб."


def _lines_of_kinds() -> Column:
    """The lines of the forms by page kind, as a map of arrays: code, metric_key, parts, n_values, in order."""
    kinds = dict.fromkeys(line[2] for line in RAS_LINES)
    spec = lambda code, key, kind, parts, n: F.struct(
        F.lit(code).alias("code"), F.lit(key).alias("metric_key"), F.array(*map(F.lit, parts)).alias("parts"), F.lit(n).alias("n_values")
    )
    table = [x for kind in kinds for x in (F.lit(kind), F.array(*[spec(*line) for line in RAS_LINES if line[2] == kind]))]
    return F.create_map(*table)


def text_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, page, metric_key, code, yr, val, confidence, unit, source_row): statement rows out of pages (doc_id, page, text, reporting_year).

    A window of three lines counts by a line's code (0.78) or all parts of its label (0.62); of the
    numbers of 1000 and more behind it the first belong to the reporting year and those before. Pages
    need two codes. The first window of a page that has a metric's numbers is taken.

    Codes are found and labels put in order once a line; a window has those of its lines, so it is
    compared with its page's lines by lookups, and only what it holds is cut and read.
    """
    rich = pages.where(F.col("reporting_year").isNotNull()).withColumn("codes", official_codes(F.col("text")))
    rich = rich.where(F.size("codes") >= 2).withColumn("kind", page_kind(F.col("text"))).where("kind is not null")
    lines = rich.select(*PAGE, "reporting_year", "kind", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumns({"codes": official_codes(F.col("line")), "label": normalize_label(F.col("line"))})
    order = Window.partitionBy(*PAGE).orderBy("pos")
    next_two = lambda c: [c, F.lead(c, 1).over(order), F.lead(c, 2).over(order)]
    none = F.array().cast("array<string>")
    windows = lines.select(
        *PAGE, "reporting_year", "kind", "pos", F.concat_ws(" ", *next_two("line")).alias("near"), F.concat_ws(" ", *next_two("label")).alias("label"),
        F.concat(*[F.coalesce(c, none) for c in next_two("codes")]).alias("codes"),
    )
    window = F.struct("near", "label", "codes")

    def found(w: Column) -> Column:
        """The lines of the page's form that a window holds, with their numbers; w is worked out once for all of them."""
        holds = lambda s: F.array_contains(w["codes"], s["code"]) | F.forall(s["parts"], lambda part: w["label"].contains(part))

        def read(s: Column) -> Column:
            coded = F.array_contains(w["codes"], s["code"])
            behind = F.concat(F.lit(r"(?s)(?<!\d)"), s["code"], F.lit(r"(?!\d)(.*)$"))
            tail = F.when(coded, F.call_function("regexp_extract", w["near"], behind, F.lit(1))).otherwise(w["near"])
            numbers = F.filter(number_tokens(tail), lambda v: F.abs(v) >= 1000)
            return F.struct(
                s["code"].alias("code"), s["metric_key"].alias("metric_key"), s["n_values"].alias("n_values"), coded.alias("coded"), numbers.alias("numbers"), w["near"].alias("near")
            )

        # inside the generator, so that a filter doesn't read the numbers twice
        hits = F.transform(F.filter(F.try_element_at(_lines_of_kinds(), F.col("kind")), holds), read)
        return F.filter(hits, lambda x: F.size(x["numbers"]) >= x["n_values"])

    met = windows.select(*PAGE, "reporting_year", "pos", F.inline(bound(window, found)))
    first = Window.partitionBy(*PAGE, "metric_key").orderBy("pos")
    met = met.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    values = F.slice("numbers", F.lit(1), F.col("n_values"))
    values = F.when(F.col("metric_key").isin(*NEGATIVE), F.transform(values, lambda v: -F.abs(v))).otherwise(values)
    sure = F.when(F.col("coded"), 0.78).otherwise(0.62).alias("confidence")
    rows = met.select(*PAGE, "metric_key", "code", "reporting_year", sure, F.trim("near").alias("source_row"), F.posexplode(values).alias("back", "val"))
    return rows.select(
        *PAGE, "metric_key", "code", (F.col("reporting_year") - F.col("back")).alias("yr"), "val", "confidence", F.lit(TEXT_UNIT).alias("unit"), "source_row"
    )


def ranked_last(better: DataFrame, text: DataFrame) -> DataFrame:
    """All rows of better, and those of text whose metric the document has nowhere in better."""
    missing = text.join(better.select("doc_id", "metric_key").distinct(), ["doc_id", "metric_key"], "left_anti")
    return better.unionByName(missing, allowMissingColumns=True)


#: Confidence of a line of the notes (fixed value).
NOTE_CONFIDENCE = 0.97


def note_rows(pages: DataFrame) -> DataFrame:
    """(doc_id, metric_key, page, yr, val, unit, confidence, source_row): lines of notes that ratios need, of the last page that has them.

    A line's two amounts keep signs, brackets and decimals; years and a leading note number don't count.
    """
    label = normalize_label(F.col("text"))
    notes = pages.where(F.col("reporting_year").isNotNull() & T.holds_any(label, NOTE_PAGES))
    notes = notes.withColumns({"whole": label, "unit": ifrs_unit(F.col("text"))})
    lines = notes.select(*PAGE, "reporting_year", "whole", "unit", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("pos", "line"))
    lines = lines.withColumn("label", normalize_label(F.col("line")))
    named = [
        F.when(
            T.holds_any(F.col("whole"), titles) & bound(F.col("label"), lambda x: F.exists(F.array(*map(F.lit, begins)), lambda b: x.startswith(b))),
            F.struct(F.lit(key).alias("metric_key"), F.lit(negative).alias("negative")),
        )
        for key, titles, begins, negative in NOTE_LINES
    ]
    hit = lines.withColumn("found", F.explode(F.array_compact(F.array(*named)))).withColumn("pair", text_pair(F.col("line"))).where("pair.first is not null")
    last = Window.partitionBy("doc_id", "found.metric_key").orderBy(F.col("page").desc(), "pos")
    hit = hit.withColumn("turn", F.row_number().over(last)).where("turn = 1")
    signed = lambda v: F.when(F.col("found.negative"), -F.abs(v)).otherwise(v)
    values = F.array(signed(F.col("pair.first")), signed(F.col("pair.second")))
    rows = hit.select("doc_id", "found.metric_key", "page", "reporting_year", "unit", F.trim("line").alias("source_row"), F.posexplode(values).alias("back", "val"))
    return rows.select(
        "doc_id", "metric_key", "page", (F.col("reporting_year") - F.col("back")).alias("yr"), "val", "unit", F.lit(NOTE_CONFIDENCE).alias("confidence"), "source_row"
    )


def companies(texts: DataFrame, fallback: str = "Не определено") -> DataFrame:
    """(doc_id, company): the legal form and name whose surroundings speak most for the reporting entity.

    Of equally good mentions the first counts; without one a short form, then a line of the first
    twenty that names a company or group, then the fallback. Whole texts are searched.
    """
    text = F.coalesce("text", F.lit(""))
    rows = texts.select("doc_id", text.alias("text"))
    found = rows.select("doc_id", "text", F.split("text", FULL_COMPANY, -1).alias("gaps"), F.posexplode(F.regexp_extract_all("text", F.lit(FULL_COMPANY), F.lit(0))).alias("i", "m"))
    # only the texts' lengths and mentions are needed from here; where a mention begins is a running sum
    sums = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.select("doc_id", "text", "i", "m", F.length(F.get("gaps", F.col("i"))).alias("gap"))
    stop = F.sum(F.col("gap") + F.length("m")).over(sums)
    found = found.withColumn("stop", stop.cast("int")).withColumn("begin", F.col("stop") - F.length("m"))
    from_ = F.greatest(F.lit(0), F.col("begin") - 240)
    context = normalize_label(F.substring("text", from_ + 1, F.col("stop") + 180 - from_))
    score = F.lit(10)
    for points, marks in COMPANY_CONTEXT:
        score = score + F.when(T.holds_any(F.col("context"), marks), points).otherwise(0)
    form = normalize_label(F.regexp_extract("m", FULL_COMPANY, 1))
    short = F.when(form.startswith("публич"), "ПАО").when(form.startswith("открыт"), "ОАО").when(form.contains("ограниченн"), "ООО").otherwise("АО")
    name = F.concat(short, F.lit(" «"), F.trim(F.regexp_extract("m", FULL_COMPANY, 2)), F.lit("»"))
    best = found.withColumn("context", context).groupBy("doc_id").agg(F.max_by(name, F.struct(score.alias("score"), (-F.col("begin")).alias("place"))).alias("full"))
    other = F.lit(None).cast("string")
    for pattern in reversed(SHORT_COMPANY):
        said = F.trim(F.concat(F.upper(F.regexp_extract("text", pattern, 1)), F.lit(" «"), F.trim(F.regexp_extract("text", pattern, 2)), F.lit("»")))
        other = F.when(F.col("text").rlike(pattern), said).otherwise(other)
    lines = F.filter(F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    fits = lambda x: ~T.holds_any(F.lower(x), ["annual report", "годовой отчет"]) & F.length(x).between(3, 100) & T.holds_any(F.lower(x), COMPANY_LINE)
    line = F.get(F.filter(F.slice(lines, 1, 20), fits), 0)
    return rows.join(best, "doc_id", "left").select("doc_id", F.coalesce("full", other, line, F.lit(fallback)).alias("company"))


def is_ras(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """results with coded (rows that carry a line code) and is_ras: by type, by what describes it, or 8 coded rows."""
    coded = metrics.groupBy("doc_id").agg(F.count("row_code").alias("coded"))
    joined = results.join(coded, "doc_id", "left").withColumn("coded", F.coalesce("coded", F.lit(0)))
    described = F.lower(F.concat_ws(" ", "document_type", "standard", "filename"))
    said = F.coalesce(F.col("document_type").isin(*RAS_TYPES), F.lit(False)) | T.holds_any(described, ["рсбу", "рпбу"])
    return joined.withColumn("is_ras", said | (F.col("coded") >= 8))


def repaired_results(results: DataFrame, metrics: DataFrame) -> DataFrame:
    """Stored results with type, standard, scope and company put right from row codes and the file's name.

    A bank's statements keep their own type.
    """
    known = is_ras(results, metrics)
    ras = F.col("is_ras")
    kind = F.when(ras & F.coalesce(F.col("document_type") != RAS_TYPES[1], F.lit(True)), RAS_TYPES[0]).otherwise(F.col("document_type"))
    named = T.company_from_name(F.col("filename"))
    company = F.when(named.isNotNull() & F.lower(F.coalesce("company", F.lit(""))).isin(*UNKNOWN), named).otherwise(F.col("company"))
    return known.select(
        "doc_id", kind.alias("document_type"), F.when(ras, "РСБУ").otherwise(F.col("standard")).alias("standard"),
        F.when(ras, "Отдельное юридическое лицо").alias("scope"), company.alias("company"), "filename", "is_ras",
    )


def transcribed_rows(raw: DataFrame, keys: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows that a reader transcribed (doc_id, metric_key, page, yr, cell), as far as they can be used.

    The metric must be known, the year four digits of 1900 to 2099, the cell a number, and the page one that was shown.
    """
    rows = raw.withColumn("page", F.col("page").try_cast("int")).withColumn("val", parse_number(F.col("cell")))
    rows = rows.where(F.col("yr").rlike("^(19|20)[0-9]{2}$") & F.col("val").isNotNull())
    rows = rows.join(keys.select("metric_key").distinct(), "metric_key", "left_semi").join(pages.select(*PAGE).distinct(), PAGE, "left_semi")
    return rows.select(
        *PAGE, "metric_key", F.col("yr").cast("int").alias("yr"), "val",
        F.lit("ai_vision_recovery").alias("source_type"), F.lit(0.82).alias("confidence"),
    )


def best_retry(reads: DataFrame) -> DataFrame:
    """Of a page's reads (doc_id, page, attempt, codes, titles, quality, confidence) the best; an equal one doesn't replace an earlier."""
    rank = F.struct("codes", "titles", "quality", "confidence", (-F.col("attempt")).alias("earlier"))
    return reads.groupBy(*PAGE).agg(F.max_by("attempt", rank).alias("attempt"))


def best_pass(reads: DataFrame) -> DataFrame:
    """Of a page's passes (doc_id, page, attempt, quality, confidence, size) the best by quality, confidence and size."""
    rank = F.struct("quality", "confidence", "size", (-F.col("attempt")).alias("earlier"))
    return reads.groupBy(*PAGE).agg(F.max_by("attempt", rank).alias("attempt"))


def limitations(documents: DataFrame, least_quality: float = 60.0) -> DataFrame:
    """(doc_id, ord, rule_id): what a reader of the analysis must be told about how the document was read.

    documents: ocr_pages, ocr_quality, text_pages, total_pages, scan_only, ocr_limit, ocr_enabled, document_type,
    elsewhere (the report says that its statements stand elsewhere), candidates, primary_metrics, operational, tables.
    """
    c = F.col
    short = c("text_pages") < c("total_pages") * 0.7
    cut = c("scan_only") & (c("ocr_limit") < c("total_pages"))
    rules = [
        ("low_ocr_quality", (c("ocr_pages") > 0) & (F.coalesce("ocr_quality", F.lit(0.0)) < least_quality)),
        ("ocr_first_pages", short & cut),
        ("ocr_off", short & ~cut & ~c("ocr_enabled")),
        ("no_full_statements", (c("document_type") == "annual_report") & (c("elsewhere") | (c("candidates") < 5))),
        ("ifrs_incomplete", (c("document_type") == "ifrs_financial_statements") & (F.coalesce("primary_metrics", F.lit(0)) < 12)),
        ("ocr_names_hidden", c("scan_only") & (c("operational") == 0)),
        ("no_tables", (c("tables") == 0) & ~c("scan_only")),
    ]
    told = [F.when(hit, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("rule_id"))) for i, (name, hit) in enumerate(rules)]
    return documents.select("doc_id", F.explode(F.array_compact(F.array(*told))).alias("r")).select("doc_id", "r.ord", "r.rule_id")


def coverage(metrics: DataFrame, ratios: DataFrame) -> DataFrame:
    """(doc_id, verified_metrics, calculated_ratios, years): how much of a document's model there is."""
    model = metrics.groupBy("doc_id").agg(F.count_distinct("metric_key").alias("verified_metrics"), F.array_sort(F.collect_set("yr")).alias("years"))
    counted = ratios.where("status <> 'na'").groupBy("doc_id").agg(F.count("*").alias("calculated_ratios"))
    return model.join(counted, "doc_id", "left").select("doc_id", "verified_metrics", F.coalesce("calculated_ratios", F.lit(0)).alias("calculated_ratios"), "years")


#: Flags that come from figures; the others come from what a text discloses (fixed values).
FINANCIAL_FLAGS = ["negative_equity", "net_loss", "negative_ocf", "low_liquidity", "high_leverage", "revenue_decline", "profit_decline"]


def risk_lines(flags: DataFrame, most: int | None = 3, named: int | None = 4) -> DataFrame:
    """(doc_id, ord, codes): the first financial flags one by one, then all disclosed risks in one line.

    A line names the codes of its flags, of disclosed ones the first named. None stands for no cap.
    """
    financial = F.col("code").isin(*FINANCIAL_FLAGS)
    order = Window.partitionBy("doc_id", financial).orderBy("ord")
    ranked = flags.select("doc_id", "code", financial.alias("financial"), F.row_number().over(order).alias("turn"))
    one = ranked.where(F.col("financial") & (F.col("turn") <= (most or 1 << 30))).select("doc_id", F.col("turn").alias("ord"), F.col("code").alias("codes"))
    told = ranked.where(~F.col("financial") & (F.col("turn") <= (named or 1 << 30)))
    rest = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", "code"))).alias("c"))
    return one.unionByName(rest.select("doc_id", F.lit(100).alias("ord"), F.array_join(F.transform("c", lambda x: x["code"]), ",").alias("codes")))


def ratio_fallback(ratios: DataFrame, found: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, section, ord, rule_id): where findings have no strength (weakness), the first good (weak) ratios stand for it.

    A document without such a ratio gets the section's default line.
    """
    section = F.when(F.col("status") == "good", "strengths").when(F.col("status").isin("bad", "warn"), "weaknesses")
    said = ratios.select("doc_id", section.alias("section"), F.col("ratio_key").alias("rule_id")).where("section is not null")
    first = Window.partitionBy("doc_id", "section").orderBy("rule_id")
    said = said.withColumn("ord", F.row_number().over(first)).where(F.col("ord") <= most)
    asked = ratios.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("strengths"), F.lit("weaknesses"))).alias("section"))
    empty = asked.join(found.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    return empty.join(said, ["doc_id", "section"], "left").select("doc_id", "section", F.coalesce("ord", F.lit(1)).alias("ord"), F.coalesce("rule_id", F.lit("default")).alias("rule_id"))


def model_years(facts: DataFrame) -> DataFrame:
    """(doc_id, years): the years that any metric of a document has."""
    return facts.groupBy("doc_id").agg(F.array_sort(F.collect_set("yr")).alias("years"))


def pages_union(rows: DataFrame, by: list[str]) -> DataFrame:
    """The pages (an array a row) of all rows of a group, once each and in order."""
    return rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))


def reporting_rows(items: DataFrame, most: int | None = 30) -> DataFrame:
    """Operational rows fit for a report: 0.85 of confidence, two years, two words; the first by ord. None: no cap."""
    words = F.size(F.regexp_extract_all("name", F.lit("[А-Яа-яЁёA-Za-z]{3,}"), F.lit(0)))
    kept = items.where((F.coalesce("confidence", F.lit(0.0)) >= 0.85) & (F.size("values") >= 2) & (words >= 2))
    kept = kept.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))
    return (kept if most is None else kept.where(F.col("turn") <= most)).drop("turn")


def looked_up(latest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The registry's rows of the documents asked for."""
    return latest.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")


def export_number(value: Column) -> Column:
    """A number as exports write it: groups of three apart, two decimals unless whole, a dash for none."""
    whole = value == F.floor(value)
    shown = F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.coalesce(F.translate(shown, ",", " "), F.lit("—"))


def export_items(items: Column, empty: str = "Нет подтвержденных выводов.") -> Column:
    """The texts of a list that aren't empty, or one line that says so."""
    kept = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.when(F.size(kept) == 0, F.array(F.lit(empty))).otherwise(kept)
