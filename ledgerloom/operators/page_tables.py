"""Tables out of a page's positioned words: a line of years, the rows below it, amounts by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import repair_digits
from ..functions.text import squeezed
from ..functions.vocabulary import line_labels
from .layout import LINE, PAGE, amounts, widest_amount

YEAR = r"^(19|20)\d{2}$"
#: A page is a statutory form from this many line codes on; its amounts then have the lower ceiling.
FORM_CODES, FORM_CEILING, CEILING = 2, 2e10, 2e16
#: A table reaches this many lines and pixels down from its years; label words end this far left of the first year.
LINES, PIXELS, LEFT_OF_YEARS = 54, 1800, 24
LEAST_QUALITY, LEAST_ROWS, APART = 48, 2, 50


def _column_edges(centers: Column) -> Column:
    """Midpoints between neighbouring centres, and half a typical gap (the upper median) beyond the outer ones."""
    n = F.size(centers)
    gaps = F.transform(F.slice(centers, F.lit(2), n - 1), lambda c, i: c - F.get(centers, i))
    half = F.get(F.array_sort(gaps), F.floor(F.size(gaps) / 2).cast("int")) / 2
    between = F.transform(F.slice(centers, F.lit(2), n - 1), lambda c, i: (c + F.get(centers, i)) / 2)
    return F.concat(F.array(F.get(centers, F.lit(0)) - half), between, F.array(F.get(centers, n - 1) + half))


def _lines(words: DataFrame) -> DataFrame:
    """Per line: top, how many of its words are years, the years with the middle of the first word of each, left
    to right, the first line code, all codes, the words without digits, and those that may be amounts."""
    place = F.struct("left", "word_no")
    year = F.when(F.col("digits").rlike(YEAR), F.struct("left", "word_no", F.col("digits").cast("int").alias("yr"), "middle"))
    plain = F.when(F.col("digits") == "", F.struct("left", "word_no", "text", "middle"))
    figure = F.when((F.col("digits") != "") & F.col("code").isNull(), F.struct("left", "word_no", "text", "width", "height", "middle"))
    found = words.groupBy(*LINE).agg(
        F.min("top").alias("top"), F.array_sort(F.collect_list(year)).alias("_y"), F.array_sort(F.collect_list(plain)).alias("plain"), F.collect_list(figure).alias("figures"),
        F.min_by(F.struct("code", "code_label"), F.when(F.col("code").isNotNull(), place)).alias("c"), F.collect_set("code").alias("codes"),
    )
    first = F.transform(F.array_distinct(F.transform("_y", lambda y: y["yr"])), lambda yr: F.get(F.filter("_y", lambda y: y["yr"] == yr), 0))
    years = F.array_sort(F.transform(first, lambda y: F.struct(y["middle"].alias("middle"), y["yr"].alias("yr"))))
    return found.select(*LINE, F.coalesce("top", F.lit(0.0)).alias("top"), F.size("_y").alias("n_years"), years.alias("years"), "plain", "figures", "c.code", "c.code_label", "codes")


def _bodies(lines: DataFrame) -> DataFrame:
    """Lines below a line of two to five different years, up to the next line of years, with that line as head."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy("line_no")
    placed = lines.withColumns({"at": F.row_number().over(down), "form": F.size(F.array_distinct(F.flatten(F.collect_list("codes").over(page)))) >= FORM_CODES})
    opens = F.when(F.col("n_years") >= 2, F.struct("line_no", "at", "top", "years"))
    headed = placed.withColumn("head", F.last(opens, ignorenulls=True).over(down)).where("n_years < 2 AND size(head.years) BETWEEN 2 AND 5")
    lowest = F.max("top").over(Window.partitionBy(*PAGE, "head.line_no").orderBy("line_no"))
    return headed.withColumn("_low", lowest).where((F.col("at") - F.col("head.at") <= LINES) & (F.col("_low") - F.col("head.top") <= PIXELS)).drop("_low")


def page_tables(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(PAGE, header_line, line_no, code, label, yr, val, confidence): the first table of each page, a row an amount.

    words: as in layout; pages: PAGE, ocr_quality. A row has a label of letters left of the years and
    an amount under one of them; words with letters that are read for digits (O, I, l) are no part
    of the label. On a statutory form a row has a line code, which names it, and two amounts.
    Amounts over the ceiling are left out, rows of amounts over 50 times apart and repeated rows too.
    A table has two rows or more. Null texts count as empty; pages of null or low quality give nothing.
    One shuffle by page serves all steps: years and columns meet by order, not by a range join.
    """
    sure = pages.where(F.col("ocr_quality") >= LEAST_QUALITY).select(*PAGE, "ocr_quality")
    digits = F.regexp_replace(repair_digits(F.coalesce("text", F.lit(""))), r"\D", "")
    spec = F.broadcast(line_labels(words.sparkSession))
    coded = words.repartition(*PAGE).withColumns({"digits": digits, "middle": F.col("left") + F.col("width") / 2}).join(spec, F.col("digits") == F.col("code"), "left")
    # lines are where words were dealt to by page; a join of words would sort these once more
    body = _bodies(_lines(coded).join(sure.select(*PAGE), PAGE, "left_semi"))
    left = F.filter("plain", lambda w: w["middle"] < F.get("head.years", F.lit(0))["middle"] - LEFT_OF_YEARS)
    raw = F.trim(squeezed(F.array_join(F.transform(left, lambda w: w["text"]), " ")), F.lit(" .:;|"))
    named = body.withColumn("label", F.coalesce("code_label", raw)).where("NOT form OR code IS NOT NULL")
    named = named.where(F.col("label").rlike("[А-Яа-яЁёA-Za-z]{3,}") & (F.length("label") <= 220))
    edges = _column_edges(F.transform("head.years", lambda y: y["middle"]))
    named = named.withColumns({"header_line": F.col("head.line_no"), "years": F.transform("head.years", lambda y: y["yr"]), "edges": edges})
    row = F.struct("code", "label", "form", "header_line", "years")
    inside = named.select(*LINE, row.alias("row"), "edges", F.explode("figures").alias("w")).select(*LINE, "row", "edges", "w.*")
    inside = inside.withColumn("col", F.size(F.filter("edges", lambda e: e <= F.col("middle")))).where("col > 0 AND col < size(edges)")

    # what is known of a line goes along as a key, so lines needn't be joined again
    cell = [*LINE, "row", "col"]
    valued = widest_amount(amounts(inside, 45, 1.8, by=cell, taller=True), cell)
    valued = valued.where(F.abs("value") <= F.when(F.col("row.form"), FORM_CEILING).otherwise(CEILING))
    rows = valued.groupBy(*LINE, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("vals")).select(*LINE, "row.*", "vals")
    sizes = F.filter(F.transform("vals", lambda v: F.abs(v["value"])), lambda v: v > 0)
    close = (F.size(sizes) < 2) | (F.array_max(sizes) / F.greatest(F.array_min(sizes), F.lit(1.0)) <= APART)
    rows = rows.where((F.size("vals") >= F.when(F.col("form"), 2).otherwise(1)) & close)

    same = Window.partitionBy(*PAGE, "header_line", "label", "vals").orderBy("line_no")
    once = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    table = once.withColumn("_rows", F.count("*").over(Window.partitionBy(*PAGE, "header_line"))).where(F.col("_rows") >= LEAST_ROWS)
    first = table.withColumn("_first", F.min("header_line").over(Window.partitionBy(*PAGE))).where("header_line = _first")
    confidence = F.round(F.least(F.lit(0.92), 0.55 + F.col("ocr_quality") / 250), 2)
    cells = first.join(sure, PAGE).select(*PAGE, "header_line", "line_no", "code", "label", "years", F.explode("vals").alias("v"), confidence.alias("confidence"))
    return cells.select(*PAGE, "header_line", "line_no", "code", "label", F.get("years", F.col("v.col") - 1).alias("yr"), F.col("v.value").alias("val"), "confidence")
