"""Positioned words to rows and amounts: lines, islands of digits, bands, anchors, clusters.

Words are (doc_id, page, line_no, word_no, text, left, top, width, height, conf).
Range conditions always come with the equal keys (doc_id, page), so joins hash on
these and a page's words meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_label, repair_digits, text_pair
from ..functions.vocabulary import BANK_CASH_NOT, IFRS_SUBTOTALS, NEGATIVE, bank_lines, ifrs_lines, ras_lines
from .text_jobs import IFRS_KINDS, first_category, ifrs_unit

PAGE, LINE = ["doc_id", "page"], ["doc_id", "page", "line_no"]
#: Words of less confidence are left out of a line's text.
LEAST_CONFIDENCE = 15.0
NUMERIC = r"^[()\-+]?\d[\d.,()\-+]*$"


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of sides that both grow with the pages, by a shuffle on either side.

    Words are exploded out of few rows, and what is estimated of them is the size of these: left to
    the estimate, the right side would be broadcast through the driver however many pages there are.
    """
    return left.join(right.hint("merge"), keys, how)


def lines(words: DataFrame, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row a line: text in order of left, its top, left and mean confidence; unsure words are left out."""
    sure = words.where(F.col("conf") >= least_confidence)
    parts = F.array_sort(F.collect_list(F.struct("left", "word_no", "text")))
    grouped = sure.groupBy(*LINE).agg(parts.alias("_w"), F.min("top").alias("top"), F.min("left").alias("left"), F.avg("conf").alias("conf"))
    return grouped.withColumn("text", F.array_join(F.transform("_w", lambda w: w["text"]), " ")).drop("_w")


def amounts(words: DataFrame, least_gap: float, per_height: float, whole: bool = True, by: list[str] = LINE, taller: bool = False) -> DataFrame:
    """(by, grp, value, left, n_digits): numeric words joined across small gaps into amounts.

    A gap over max(least_gap, per_height times the height of the word before) begins
    another amount; with whole the second bound is cut to a whole number, with taller
    the taller of the two words counts.
    """
    raw = F.translate(repair_digits(F.trim("text")), "−~", "--")
    numeric = words.withColumn("_raw", raw).where(F.col("_raw").rlike(NUMERIC))
    order = Window.partitionBy(*by).orderBy("left", "word_no")
    before = F.lag("height").over(order)
    tall = (F.greatest(before, "height") if taller else before) * per_height
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(order)
    far = (gap > F.greatest(F.lit(float(least_gap)), F.floor(tall).cast("double") if whole else tall)).cast("int")
    islands = numeric.withColumn("_far", F.coalesce(far, F.lit(0))).withColumn("grp", F.sum("_far").over(order))
    parts = F.array_sort(F.collect_list(F.struct("left", "word_no", "_raw")))
    grouped = islands.groupBy(*by, "grp").agg(parts.alias("_w"), F.min("left").alias("left"))
    text = F.array_join(F.transform("_w", lambda w: w["_raw"]), " ")
    joined = grouped.withColumn("_t", text).withColumn("_d", F.regexp_replace("_t", r"\D", ""))
    size = F.col("_d").try_cast("double")
    negative = F.col("_t").contains("(") | F.col("_t").rlike(r"^\s*-")
    return joined.select(*by, "grp", F.when(negative, -size).otherwise(size).alias("value"), "left", F.length("_d").alias("n_digits"), "_t")


def widest_amount(found: DataFrame, by: list[str] = LINE) -> DataFrame:
    """Of each line the amount of most digits, the rightmost on ties."""
    best = F.max_by("value", F.struct("n_digits", "left"))
    return found.groupBy(*by).agg(best.alias("value"))


def bank_columns(words: DataFrame, reach: float = 500.0) -> DataFrame:
    """(LINE, first, second): the two amounts in the right-hand part of a line; a leading plus counts as minus."""
    line = Window.partitionBy(*LINE)
    right = words.withColumn("_right", F.max(F.col("left") + F.col("width")).over(line)).where(F.col("left") >= F.col("_right") - reach)
    found = amounts(right, 24.0, 1.3, whole=False)
    value = F.when(F.col("_t").rlike(r"^\s*\+"), -F.abs("value")).otherwise(F.col("value"))
    cells = found.where("value IS NOT NULL").groupBy(*LINE).agg(F.array_sort(F.collect_list(F.struct("left", value.alias("v")))).alias("_c"))
    return cells.where(F.size("_c") >= 2).select(*LINE, F.get("_c", 0)["v"].alias("first"), F.get("_c", 1)["v"].alias("second"))


def anchored_values(anchors: DataFrame, values: DataFrame, above: float = 5.0, below: float = 140.0) -> DataFrame:
    """(anchor's columns, first, second, score): the best line of two amounts from above to below an anchor's top.

    anchors: PAGE, anchor_id, top; values: PAGE, line_no, top, conf, first, second.
    A band join within a page: score 100 - 0.35 |distance| + 0.1 confidence, the upper line first on ties.
    """
    v = values.select(*PAGE, F.col("line_no").alias("value_line"), F.col("top").alias("_vt"), F.col("conf").alias("value_conf"), "first", "second")
    joined = _met(anchors, v, PAGE).where((F.col("_vt") - F.col("top")).between(-above, below))
    joined = joined.withColumn("score", 100 - 0.35 * F.abs(F.col("_vt") - F.col("top")) + 0.1 * F.col("value_conf"))
    best = Window.partitionBy(*PAGE, "anchor_id").orderBy(F.col("score").desc(), "value_line")
    return joined.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_vt")


def bank_rows(words: DataFrame, pages: DataFrame, most: float = 5e11) -> DataFrame:
    """(doc_id, metric_key, form, row_code, first, second, score): rows of a bank's public forms, best per metric."""
    form = F.regexp_extract("text", r"(?<!\d)(0409806|0409807)(?!\d)", 1)
    formed = pages.select(*PAGE, form.alias("form")).where("form <> ''")
    row = lines(words)
    labels = _met(row, formed, PAGE).withColumn("_l", normalize_label(F.col("text")))
    # a regulatory row number at the line's start, followed by its label
    number = F.translate(F.regexp_extract("text", r"^[\s\[\](){}|]{0,4}(\d{1,2}(?:[.,]\d+)?)(?!\d)[\s|\]\[().,:;_-]{0,8}[A-Za-zА-Яа-яЁё]", 1), ",", ".")
    spec = F.broadcast(bank_lines(words.sparkSession))
    joined = labels.withColumn("_no", number).join(spec, "form")
    says = F.exists("variants", lambda v: F.forall(v, lambda p: F.col("_l").contains(p)))
    bars = (F.col("metric_key") == "cash") & F.exists(F.array(*map(F.lit, BANK_CASH_NOT)), lambda p: F.col("_l").contains(p))
    hit = joined.withColumns({"exact": F.col("_no") == F.col("row_code"), "named": says}).where((F.col("exact") | F.col("named")) & ~bars)
    anchors = hit.select(*PAGE, F.concat_ws(":", "line_no", "metric_key").alias("anchor_id"), "top", F.col("conf").alias("anchor_conf"), "metric_key", "form", "row_code", "negative", "exact", "named", "ord")
    values = _met(bank_columns(words), row.select(*LINE, "top", "conf"), LINE)
    found = anchored_values(anchors, values).where(F.greatest(F.abs("first"), F.abs("second")) <= most)
    sure = F.greatest("anchor_conf", "value_conf")
    total = F.when(F.col("exact"), 140).otherwise(105) + F.when(F.col("named"), 35).otherwise(0) + sure
    signed = lambda c: F.when(F.col("negative"), -F.abs(c)).otherwise(F.abs(c)).alias(c)
    best = Window.partitionBy("doc_id", "metric_key").orderBy(F.col("total").desc(), "page", "ord", "anchor_id")
    ranked = found.withColumn("total", total).withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return ranked.select("doc_id", "metric_key", "form", "row_code", signed("first"), signed("second"), F.col("total").alias("score"))


def code_positions(words: DataFrame, codes: DataFrame) -> DataFrame:
    """(LINE, code, at_word, tier): where a line's code stands: exact, else short of a digit, the leftmost first."""
    digits = F.regexp_replace(repair_digits(F.col("text")), r"\D", "")
    tokens = words.select(*LINE, "word_no", digits.alias("d")).where(F.length("d").between(3, 4))
    exact = tokens.join(F.broadcast(codes.select("code")), F.col("d") == F.col("code")).select(*LINE, "code", "word_no", F.lit(0).alias("tier"))
    cut = codes.select("code", F.explode(F.array(F.substring("code", 2, 3), F.substring("code", 1, 3))).alias("d")).distinct()
    fuzzy = tokens.join(F.broadcast(cut), "d").select(*LINE, "code", "word_no", F.lit(1).alias("tier"))
    return exact.unionByName(fuzzy).groupBy(*LINE, "code").agg(F.min(F.struct("tier", "word_no")).alias("m")).select(*LINE, "code", F.col("m.word_no").alias("at_word"), F.col("m.tier").alias("tier"))


#: Which form a page is, by its line codes and then by its title (fixed values).
FORM_CODES = [("pnl", ["2110", "2400"]), ("cashflow", ["4100", "4200", "4300", "4400", "4500"]), ("balance", ["1100", "1200", "1300", "1400", "1500", "1600", "1700"])]
FORM_TITLES = [("pnl", ["отчет о финансовых результатах"]), ("cashflow", ["движении денежных средств"]), ("balance", ["актив", "пассив"])]
FULL_TITLES = ["бухгалтерский баланс", "отчет о финансовых результатах", "отчет о движении денежных средств"]


def form_pages(spots: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, page, kind): pages of statutory forms. spots: exact codes of pages; labels: lines of pages as labels.

    A page needs two codes, or one and a form's title without a word of consolidation.
    """
    codes = spots.groupBy(*PAGE).agg(F.collect_set("code").alias("codes"))
    said = labels.groupBy(*PAGE).agg(*[F.max(says).alias(name) for name, says in _titles().items()])
    return codes.join(said, PAGE).select(*PAGE, _form_kind().alias("kind")).where("kind is not null")


def _titles() -> dict[str, Column]:
    """What a line's label says of its page's form."""
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("label").contains(w))
    return {"titled": says(FULL_TITLES), "consolidated": says(["консолидирован"]), **{f"says_{kind}": says(words) for kind, words in FORM_TITLES}}


def _form_kind() -> Column:
    """The form of a page by its codes and what its lines say, null if it is none."""
    kind = F.lit(None).cast("string")
    for name, _ in reversed(FORM_TITLES):
        kind = F.when(F.col(f"says_{name}"), name).otherwise(kind)
    for name, some in reversed(FORM_CODES):
        kind = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, some))), name).otherwise(kind)
    n = F.size("codes")
    return F.when((n >= 2) | (n == 1) & F.col("titled") & ~F.col("consolidated"), kind)


def ras_rows(words: DataFrame, most: float = 2e10, apart: float = 50.0) -> DataFrame:
    """(doc_id, metric_key, code, first, second, third, score): lines of statutory forms, best per metric.

    A line counts on a page of its form, by its code, or by its label parts with a damaged code, if it
    has as many amounts as its form has columns, none above most nor apart times another.
    One shuffle of words by page serves all steps up to the best line of a metric.
    """
    spec = ras_lines(words.sparkSession)
    cut = spec.select(F.explode(F.array(F.substring("code", 2, 3), F.substring("code", 1, 3))).alias("d"), F.lit(1).alias("tier"), "code")
    marks = spec.select(F.col("code").alias("d"), F.lit(0).alias("tier"), "code").unionByName(cut)
    marks = marks.groupBy("d").agg(F.collect_set(F.struct("tier", "code")).alias("marks"))
    digits = F.regexp_replace(repair_digits(F.col("text")), r"\D", "")
    read = words.repartition(*PAGE).withColumn("d", digits).join(F.broadcast(marks), "d", "left")
    spot = F.transform("marks", lambda m: F.struct(m["tier"].alias("tier"), m["code"].alias("code"), F.col("word_no").alias("at_word")))
    line = read.groupBy(*LINE).agg(
        F.array_sort(F.collect_list(F.struct("left", "word_no", "text", "width", "height", "conf"))).alias("words"),
        F.avg(F.when(F.col("conf") >= LEAST_CONFIDENCE, F.col("conf"))).alias("conf"), F.flatten(F.collect_list(spot)).alias("spots"),
    )
    sure = F.filter("words", lambda w: w["conf"] >= LEAST_CONFIDENCE)
    line = line.withColumn("label", normalize_label(F.array_join(F.transform(sure, lambda w: w["text"]), " ")))
    page = Window.partitionBy(*PAGE)
    exact = F.transform(F.filter("spots", lambda x: x["tier"] == 0), lambda x: x["code"])
    line = line.withColumns({"codes": exact, **_titles()})
    codes = F.array_distinct(F.flatten(F.collect_list("codes").over(page)))
    line = line.withColumns({"codes": codes, **{name: F.max(name).over(page) for name in _titles()}})
    # a line without a sure word has no label
    line = line.where("conf IS NOT NULL AND size(spots) > 0").withColumn("kind", _form_kind()).where("kind IS NOT NULL")
    hit = line.select(*LINE, "kind", "label", "conf", "words", F.inline("spots")).join(F.broadcast(spec), ["code", "kind"])
    named = F.forall("parts", lambda p: F.col("label").contains(p))
    hit = hit.where((F.col("tier") == 0) | named)
    keep = hit.groupBy(*LINE).agg(F.min(F.struct("tier", "ord", "code", "metric_key", "at_word", "conf", "n_values")).alias("h"), F.first("words").alias("words"))
    tail = keep.select(*LINE, "h", F.inline(F.filter("words", lambda w: w["word_no"] > F.col("h.at_word"))))
    # what is known of a line goes along as a key, so lines needn't be joined again
    known = [*LINE, "h"]
    found = amounts(tail, 48.0, 1.8, by=known).where("value IS NOT NULL").groupBy(*known).agg(F.array_sort(F.collect_list(F.struct("left", "value"))).alias("all"))
    rows = found.select(*LINE, "h.*", "all").where(F.size("all") >= F.col("n_values"))
    rows = rows.withColumn("v", F.transform(F.slice("all", F.lit(1), F.col("n_values")), lambda x: x["value"]))
    sizes = F.filter(F.transform("v", lambda x: F.abs(x)), lambda x: x > 0)
    close = (F.size(sizes) < 2) | (F.array_max(sizes) / F.greatest(F.array_min(sizes), F.lit(1.0)) <= apart)
    rows = rows.where(F.forall("v", lambda x: F.abs(x) <= most) & close)
    score = F.when(F.col("tier") == 0, 120).otherwise(75) + F.col("conf") + 10 * F.col("n_values")
    best = Window.partitionBy("doc_id", "metric_key").orderBy(F.col("score").desc(), "page", "line_no")
    ranked = rows.withColumn("score", score).withColumn("turn", F.row_number().over(best)).where("turn = 1")
    value = lambda i: F.when(F.col("metric_key").isin(*NEGATIVE), -F.abs(F.get("v", F.lit(i)))).otherwise(F.get("v", F.lit(i)))
    return ranked.select("doc_id", "metric_key", "code", value(0).alias("first"), value(1).alias("second"), value(2).alias("third"), "score")


def year_columns(words: DataFrame, reporting_year: Column) -> DataFrame:
    """(PAGE, a, b): where the headers of the reporting year and of the one before stand, from the first line with both."""
    token = F.regexp_replace(repair_digits(F.col("text")), r"\D", "").try_cast("int")
    heads = words.where("line_no < 20").select(*LINE, "left", token.alias("y"), reporting_year.alias("ry"))
    place = lambda back: F.min(F.when(F.col("y") == F.col("ry") - back, F.col("left")))
    pairs = heads.groupBy(*LINE).agg(place(0).alias("a"), place(1).alias("b")).where("a < b")
    return pairs.groupBy(*PAGE).agg(F.min_by(F.struct("a", "b"), "line_no").alias("h")).select(*PAGE, "h.a", "h.b")


def two_column_values(words: DataFrame, reporting_year: Column) -> DataFrame:
    """(LINE, first, second): amounts under the two year headers; the boundary lies at 72 % between them."""
    first = year_columns(words, reporting_year)
    inside = _met(words, first, PAGE).where("left >= a - 85").withColumn("side", (F.col("left") >= F.col("a") + (F.col("b") - F.col("a")) * 0.72).cast("int"))
    raw = F.translate(repair_digits(F.trim("text")), "−", "-")
    cells = inside.withColumn("_raw", raw).where(F.col("_raw").rlike(NUMERIC)).groupBy(*LINE, "side").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_no", "_raw"))), lambda w: w["_raw"]), " ").alias("t"))
    size = F.regexp_replace("t", r"\D", "").try_cast("double")
    cells = cells.withColumn("v", F.when(F.col("t").contains("(") | F.col("t").startswith("-"), -size).otherwise(size))
    side = lambda i: F.max(F.when(F.col("side") == i, F.col("v")))
    return cells.groupBy(*LINE).agg(side(0).alias("first"), side(1).alias("second")).where("first IS NOT NULL AND second IS NOT NULL")


def line_values(words: DataFrame, rows: DataFrame, reporting_year: Column) -> DataFrame:
    """(LINE, first, second): amounts under the two year headers, else the two amounts of the line's text.

    rows: LINE, text; lines without two amounts are left out.
    """
    placed = _met(rows.select(*LINE, text_pair(F.col("text")).alias("pair")), two_column_values(words, reporting_year), LINE, "left")
    value = lambda c: F.when(F.col("first").isNotNull(), F.col(c)).otherwise(F.col(f"pair.{c}")).alias(c)
    return placed.select(*LINE, value("first"), value("second")).where("first IS NOT NULL")


def ifrs_rows(rows: DataFrame, values: DataFrame, pages: DataFrame, columned: DataFrame | None = None, most: float = 1e11) -> DataFrame:
    """(doc_id, metric_key, first, second, score, page, unit, confidence, source_row): lines of primary statements, best per metric.

    rows: LINE, text, conf (line_no without gaps); values: LINE, first, second; a row without amounts takes those of
    the line before, the second before, after, or second after. pages: doc_id, page, text and, where known,
    ocr_quality; the unit is the page's. columned: pages with year columns, whose lines count 20 more.
    """
    quality = F.coalesce(F.col("ocr_quality"), F.lit(80.0)) if "ocr_quality" in pages.columns else F.lit(80.0)
    kinds = pages.select(
        *PAGE, first_category(F.col("text"), IFRS_KINDS).alias("kind"), ifrs_unit(F.col("text")).alias("unit"),
        F.round(F.least(F.lit(0.99), 0.90 + quality / 1000), 2).alias("confidence"),
    ).where("kind IS NOT NULL")
    if columned is not None:
        kinds = _met(kinds, columned.select(*PAGE, F.lit(20).alias("columns")).distinct(), PAGE, "left")
    else:
        kinds = kinds.withColumn("columns", F.lit(0))
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    both = F.when(F.col("first").isNotNull(), F.struct("first", "second"))
    near = _met(rows, values, LINE, "left").withColumn("own", both)
    others = [F.lag("own", 1).over(order), F.lag("own", 2).over(order), F.lead("own", 1).over(order), F.lead("own", 2).over(order)]
    near = near.withColumn("got", F.coalesce("own", *others))
    named = _met(near.where("got IS NOT NULL"), kinds, PAGE).withColumn("_l", normalize_label(F.col("text")))
    hit = named.join(F.broadcast(ifrs_lines(rows.sparkSession)), "kind").where(F.exists("aliases", lambda a: F.col("_l").contains(a)))
    label, key = F.col("_l"), F.col("metric_key")
    bars = (
        (key == "liabilities") & label.rlike("и капитал|and equity") | (key == "equity") & ~label.rlike("^(итого капитал|total equity)")
        | (key == "receivables") & label.rlike("долгосроч|long-term|non-current")
    )
    own = F.when(F.col("own").isNotNull(), 100).otherwise(0)
    scored = hit.where(~bars).withColumn("score", 200 + F.col("conf") + F.coalesce("columns", F.lit(0)) + own)
    signed = lambda c: F.when(F.col("negative"), -F.abs(F.col(f"got.{c}"))).otherwise(F.col(f"got.{c}"))
    scored = scored.withColumns({"a": signed("first"), "b": signed("second")}).where(F.greatest(F.abs("a"), F.abs("b")) <= most)
    best = Window.partitionBy("doc_id", "metric_key").orderBy(F.col("score").desc(), "page", "ord", "line_no")
    ranked = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return ranked.select(
        "doc_id", "metric_key", F.col("a").alias("first"), F.col("b").alias("second"), "score", "page", "unit", "confidence",
        F.col("text").alias("source_row"),
    )


def ifrs_subtotals(rows: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, page, metric_key, line_no, first, second): the last line of only amounts between a section's title and the next."""
    text = rows.select(*LINE, normalize_label(F.col("text")).alias("_l"))
    table = F.array(*[F.struct(F.lit(k).alias("metric_key"), F.array(*map(F.lit, s)).alias("starts"), F.array(*map(F.lit, e)).alias("ends")) for k, s, e in IFRS_SUBTOTALS])
    each = text.select(*LINE, "_l", F.explode(table).alias("s")).select(*LINE, "_l", "s.*")
    opens = F.min(F.when(F.exists("starts", lambda a: F.col("_l").startswith(a)), F.col("line_no"))).over(Window.partitionBy(*PAGE, "metric_key"))
    each = each.withColumn("open", opens).where("line_no > open")
    closes = F.min(F.when(F.exists("ends", lambda a: F.col("_l").contains(a)), F.col("line_no"))).over(Window.partitionBy(*PAGE, "metric_key"))
    inside = each.withColumn("close", closes).where("close IS NULL OR line_no < close").where(~F.col("_l").rlike("[а-яa-z]{2,}"))
    valued = _met(inside, values, LINE)
    return valued.groupBy(*PAGE, "metric_key").agg(F.max_by(F.struct("line_no", "first", "second"), "line_no").alias("v")).select(*PAGE, "metric_key", "v.*")


def column_bands(headers: DataFrame) -> DataFrame:
    """(PAGE, yr, low, high): bands between the midpoints of year headers, half a typical gap beyond the outer ones.

    headers: PAGE, yr, center; pages with two to five years.
    """
    order = Window.partitionBy(*PAGE).orderBy("center")
    page = Window.partitionBy(*PAGE)
    gaps = headers.withColumns({"_prev": F.lag("center").over(order), "_next": F.lead("center").over(order), "_n": F.count("*").over(page)})
    gaps = gaps.withColumn("_gap", F.avg(F.col("_next") - F.col("center")).over(page)).where("_n BETWEEN 2 AND 5")
    low = F.coalesce((F.col("_prev") + F.col("center")) / 2, F.col("center") - F.col("_gap") / 2)
    high = F.coalesce((F.col("_next") + F.col("center")) / 2, F.col("center") + F.col("_gap") / 2)
    return gaps.select(*PAGE, "yr", low.alias("low"), high.alias("high"))


def banded_words(words: DataFrame, bands: DataFrame) -> DataFrame:
    """Words with the year of the band their middle falls in: a range join within a page."""
    middle = F.col("left") + F.col("width") / 2
    return _met(words.withColumn("_m", middle), bands, PAGE).where("_m >= low AND _m < high").drop("_m", "low", "high")


def row_clusters(rows: DataFrame, reach: float = 12.0) -> DataFrame:
    """(PAGE, cluster, top, n_lines, text): lines within reach of the first line of a cluster, clusters of two or more.

    The first line is the anchor, so this is a fold over a page's lines by top, not a gap test between neighbours.
    """
    ordered = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("top", "left", "line_no", "text"))).alias("_l"))
    kind = "array<struct<cluster:int,top:double,left:double,line_no:bigint,text:string>>"
    start = F.struct(F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("anchor"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = s["anchor"].isNull() | (F.abs(x["top"] - s["anchor"]) > reach)
        number = F.when(fresh, s["cluster"] + 1).otherwise(s["cluster"])
        row = F.struct(number.alias("cluster"), x["top"].cast("double").alias("top"), x["left"].cast("double").alias("left"), x["line_no"].cast("long").alias("line_no"), x["text"].alias("text"))
        return F.struct(number.alias("cluster"), F.when(fresh, x["top"].cast("double")).otherwise(s["anchor"]).alias("anchor"), F.concat(s["out"], F.array(row)).alias("out"))

    each = ordered.select(*PAGE, F.explode(F.aggregate("_l", start, step, lambda s: s["out"])).alias("r")).select(*PAGE, "r.*")
    parts = F.array_sort(F.collect_list(F.struct("left", "line_no", "text")))
    grouped = each.groupBy(*PAGE, "cluster").agg(F.min("top").alias("top"), F.count("*").alias("n_lines"), parts.alias("_p")).where("n_lines >= 2")
    return grouped.select(*PAGE, "cluster", "top", "n_lines", F.array_join(F.transform("_p", lambda p: p["text"]), " ").alias("text"))


def merged_passes(rows: DataFrame) -> DataFrame:
    """Lines of several reads of a page: of lines at one height with one text that of the best pass. rows: LINE, pass_quality, text, top."""
    same = Window.partitionBy(*PAGE, F.bround(F.col("top") / 12), normalize_label(F.col("text"))).orderBy(F.col("pass_quality").desc(), "line_no")
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
