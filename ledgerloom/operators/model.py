"""From competing readings to one model a document: merge, outliers, derivations, balance repair."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, plausible, quality, to_thousands, unit_multiplier

KEYS = ["doc_id", "branch", "metric_key"]
#: Readings of one year from these sources need a confidence of 0.9.
LOOSE_SOURCES = ["pdf_text", "ocr_coordinate_table"]
#: A reading whose largest amount is over this many times its least is left out; zeros don't count.
MOST_APART = 50.0


def gated(candidates: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Readings that pass the gate, in thousands of rubles, with their quality and plausibility.

    One shuffle: all later steps group by a superset of KEYS. by: those of KEYS that readings are dealt by,
    where they are dealt so already no shuffle.
    """
    # a reading's own rows are next to each other in the order of a metric's readings, so one sort serves both windows
    reading = Window.partitionBy(*KEYS, "seq")
    dealt = candidates.where("metric_key IS NOT NULL AND val IS NOT NULL AND yr BETWEEN 1900 AND 2099").repartition(*by)
    size = F.abs("val")
    sized = dealt.withColumns({"_high": F.max(size).over(reading), "_low": F.min(F.when(size > 0, size)).over(reading), "_n": F.count("*").over(reading)})
    loose = F.col("source_type").isin(*LOOSE_SOURCES) & (F.col("_n") < 2) & (F.coalesce("confidence", F.lit(0.0)) < 0.9)
    kept = sized.where(F.coalesce(F.col("_high") <= MOST_APART * F.col("_low"), F.lit(True)) & ~F.coalesce(loose, F.lit(False)))
    factor, unit = to_thousands(F.col("unit"))
    kept = kept.withColumns({"val": F.col("val") * factor, "unit": unit, "quality": quality(F.col("confidence"), F.col("source_type"))})
    key = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.coalesce("unit", F.first("unit").over(key))
    return kept.withColumn("plausible", plausible(F.col("val"), own)).drop("_high", "_low", "_n")


def merged_values(kept: DataFrame) -> DataFrame:
    """Of each metric and year the plausible reading of best quality, the later one on ties."""
    best = F.max_by(F.struct("val", "seq"), F.struct("quality", "seq")).alias("b")
    slots = kept.where("plausible").groupBy(*KEYS, "yr").agg(best)
    return slots.select(*KEYS, "yr", F.col("b.val").alias("val"), F.col("b.seq").alias("seq"))


def accepted(kept: DataFrame) -> DataFrame:
    """Readings that were at least as good as every plausible one before them in their slot."""
    before = Window.partitionBy(*KEYS, "yr").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranked = kept.where("plausible").withColumn("_best", F.max("quality").over(before))
    return ranked.where(F.col("_best").isNull() | (F.col("quality") >= F.col("_best"))).drop("_best")


def merged_attributes(kept: DataFrame) -> DataFrame:
    """Per metric: confidence, row_code, unit, source_type and number of readings that count."""
    taken = accepted(kept)
    best = F.max_by(F.struct("source_type", "unit"), F.struct("quality", "seq")).alias("b")
    coded = F.max_by("row_code", F.when(F.col("row_code").isNotNull(), F.col("seq")))
    return taken.groupBy(*KEYS).agg(
        F.max(F.least(F.col("confidence"), F.lit(1.0))).alias("confidence"), coded.alias("row_code"), best,
        F.count_distinct("seq").alias("n_accepted"),
    ).select(*KEYS, "confidence", "row_code", "b.source_type", "b.unit", "n_accepted")


def without_outliers(values: DataFrame, most: float = 100.0) -> DataFrame:
    """Drops the largest year of a metric that exceeds its least by over 100 times; kept and dropped are marked."""
    key = Window.partitionBy(*KEYS)
    size = F.when(F.col("val") != 0, F.abs("val"))
    marked = values.withColumns({"_low": F.min(size).over(key), "_high": F.max(size).over(key)})
    bad = (F.col("_high") > most * F.col("_low")) & (F.abs("val") == F.col("_high"))
    return marked.withColumn("dropped", F.coalesce(bad, F.lit(False))).drop("_low", "_high")


#: (target, formula, inputs) in order; a target is filled only if the document has it in no year.
DERIVATIONS = [
    ("assets", "noncurrent_assets + current_assets", ["noncurrent_assets", "current_assets"]),
    ("liabilities", "longterm_liabilities + current_liabilities", ["longterm_liabilities", "current_liabilities"]),
    ("total_debt", "longterm_debt_component + shortterm_debt_component", ["longterm_debt_component", "shortterm_debt_component"]),
    ("current_assets", "assets - noncurrent_assets", ["assets", "noncurrent_assets"]),
    ("noncurrent_assets", "assets - current_assets", ["assets", "current_assets"]),
    ("liabilities", "assets - equity", ["assets", "equity"]),
    ("current_liabilities", "liabilities - longterm_liabilities", ["liabilities", "longterm_liabilities"]),
    ("longterm_liabilities", "liabilities - current_liabilities", ["liabilities", "current_liabilities"]),
    ("equity", "assets - liabilities", ["assets", "liabilities"]),
    ("cash", "cash_end", ["cash_end"]),
    ("gross_profit", "revenue + cogs", ["revenue", "cogs"]),
    ("cogs", "gross_profit - revenue", ["revenue", "gross_profit"]),
    ("net_profit", "profit_before_tax + income_tax", ["profit_before_tax", "income_tax"]),
    ("operating_profit", "gross_profit - abs(commercial_expenses) - abs(administrative_expenses)", ["gross_profit", "commercial_expenses", "administrative_expenses"]),
    ("ebitda", "operating_profit + abs(depreciation_amortization)", ["operating_profit", "depreciation_amortization"]),
    ("administrative_expenses", "operating_profit - gross_profit - commercial_expenses", ["gross_profit", "commercial_expenses", "operating_profit"]),
]
COMPONENTS = ["longterm_debt_component", "shortterm_debt_component"]


def _terms(formula: str) -> list[tuple[str, float, bool]]:
    """(metric, factor, whether its size counts) of each part of a formula, from left to right."""
    parts = re.findall(r"([+-]?) ?(abs\()?([a-z_]+)\)?", formula)
    return [(key, -1.0 if sign == "-" else 1.0, bool(size)) for sign, size, key in parts]


def _rules() -> Column:
    """DERIVATIONS as an array: n, target, terms."""
    term = lambda key, factor, size: F.struct(F.lit(key).alias("key"), F.lit(factor).alias("factor"), F.lit(size).alias("size"))
    rule = lambda n, target, formula: F.struct(
        F.lit(n).alias("n"), F.lit(target).alias("target"), F.array(*[term(*t) for t in _terms(formula)]).alias("terms")
    )
    return F.array(*[rule(n, target, formula) for n, (target, formula, _) in enumerate(DERIVATIONS)])


def derived(values: DataFrame) -> DataFrame:
    """values (KEYS, yr, val, confidence) plus the derived ones; adds is_derived and rule, the place of its rule in DERIVATIONS.

    Debt components go. A document's years, each with a map of its metrics, are folded over the rules, so a
    later rule sees what an earlier one added; a target that any year has is left alone in all years.
    """
    used = list(dict.fromkeys(k for t, _, inputs in DERIVATIONS for k in [t, *inputs]))
    dealt = values.repartition("doc_id", "branch")
    one = dealt.where(F.col("metric_key").isin(*used)).groupBy(*KEYS, "yr").agg(F.max("val").alias("val"), F.max("confidence").alias("confidence"))
    cell = F.struct("val", "confidence", F.lit(None).cast("int").alias("rule")).alias("cell")
    years = one.where("val IS NOT NULL").groupBy("doc_id", "branch", "yr").agg(F.map_from_entries(F.collect_list(F.struct("metric_key", cell))).alias("m"))
    docs = years.groupBy("doc_id", "branch").agg(F.collect_list(F.struct("yr", "m")).alias("years"))

    def follow(known: Column, r: Column) -> Column:
        def add(year: Column) -> Column:
            cells = F.transform(r["terms"], lambda t: F.try_element_at(year["m"], t["key"]))
            parts = F.zip_with(cells, r["terms"], lambda c, t: t["factor"] * F.when(t["size"], F.abs(c["val"])).otherwise(c["val"]))
            surest = F.array_min(F.transform(cells, lambda c: c["confidence"]))
            made = F.struct(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x).alias("val"), surest.alias("confidence"), r["n"].alias("rule"))
            whole = F.forall(cells, lambda c: c.isNotNull())
            return F.struct(year["yr"].alias("yr"), F.when(whole, F.map_concat(year["m"], F.create_map(r["target"], made))).otherwise(year["m"]).alias("m"))

        had = F.exists(known, lambda year: F.map_contains_key(year["m"], r["target"]))
        return F.when(had, known).otherwise(F.transform(known, add))

    done = docs.select("doc_id", "branch", F.explode(F.aggregate(_rules(), F.col("years"), follow)).alias("y"))
    long = done.select("doc_id", "branch", "y.yr", F.explode("y.m").alias("metric_key", "x")).where(~F.col("metric_key").isin(*COMPONENTS))
    rest = values.where(~F.col("metric_key").isin(*used)).select(*KEYS, "yr", "val", "confidence", F.lit(None).cast("int").alias("rule"))
    both = long.select(*KEYS, "yr", "x.val", "x.confidence", "x.rule").unionByName(rest)
    return both.withColumn("is_derived", F.col("rule").isNotNull())


BALANCE = ["assets", "noncurrent_assets", "current_assets", "equity", "longterm_liabilities", "current_liabilities"]


def agree(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * tolerance, F.lit(False))


def balance_repairs(values: DataFrame) -> DataFrame:
    """(doc_id, branch, yr, metric_key, original, repaired, confidence): one odd total a year set right.

    values: KEYS, yr, val, confidence, has_code, from_table. Reported assets, asset
    sections and financing sections give one total three times; where two agree, the
    third, or its least reliable part, is replaced. A repair lowers that item's
    reliability in later years, hence a fold over the years of a document.
    """
    numbered = list(enumerate(BALANCE))
    pick = lambda k, c: F.max(F.when(F.col("metric_key") == k, F.col(c)))
    years = values.where(F.col("metric_key").isin(*BALANCE)).repartition("doc_id", "branch").groupBy("doc_id", "branch", "yr").agg(
        F.array(*[pick(k, "val") for k in BALANCE]).alias("v"), *[F.coalesce(pick(k, "confidence"), F.lit(-1.0)).alias(f"c{i}") for i, k in numbered],
        *[F.coalesce(pick(k, "has_code"), F.lit(False)).alias(f"k{i}") for i, k in numbered], *[F.coalesce(pick(k, "from_table"), F.lit(False)).alias(f"t{i}") for i, k in numbered],
    )
    docs = years.groupBy("doc_id", "branch").agg(
        F.array_sort(F.collect_list(F.struct("yr", "v"))).alias("years"), F.array(*[F.max(f"c{i}") for i, _ in numbered]).alias("conf"),
        F.array(*[F.max(f"k{i}") for i, _ in numbered]).alias("code"), F.array(*[F.max(f"t{i}") for i, _ in numbered]).alias("tab"),
    )
    kind = "array<struct<yr:int,item:int,original:double,repaired:double,confidence:double>>"
    start = F.struct(F.col("conf").alias("conf"), F.col("tab").alias("tab"), F.array().cast(kind).alias("out"))

    def fold(state: Column, year: Column) -> Column:
        v = year["v"]

        def odd(x: Column) -> Column:
            """The item that is odd: by three totals, and of a side's items the least reliable."""
            sure = [state["conf"][i] + F.when(F.col("code")[i], 0.12).otherwise(0.0) + F.when(state["tab"][i], 0.08).otherwise(0.0) for i in range(6)]
            weak_asset = F.when(sure[1] <= sure[2], 1).otherwise(2)
            weak_source = F.when((sure[3] <= sure[4]) & (sure[3] <= sure[5]), 3).when(sure[4] <= sure[5], 4).otherwise(5)
            one = x["sf"] & ~x["rs"]
            two = x["rf"] & ~x["rs"] & ~one
            three = x["rs"] & ~x["rf"] & ~one & ~two
            return F.when(one, 0).when(two, weak_asset).when(three, weak_source)

        def amount(item: Column) -> Column:
            """What the item is to be, and the confidence of that."""
            others = F.aggregate(F.sequence(F.lit(3), F.lit(5)), F.lit(0.0), lambda s, i: s + F.when(i == item, 0.0).otherwise(F.get(v, i)))
            fixed = F.when(item == 0, v[1] + v[2]).when(item <= 2, v[0] - F.get(v, 3 - item)).otherwise(v[0] - others)
            sources = F.filter(
                F.sequence(F.lit(0), F.lit(5)), lambda i: F.when(item == 0, i.isin(1, 2)).when(item <= 2, (i == 0) | (i == 3 - item)).otherwise((i == 0) | (i >= 3) & (i != item))
            )
            lower = F.bround(F.array_min(F.transform(sources, lambda i: F.get(state["conf"], i))) * 0.9, 2)
            return F.struct(item.cast("int").alias("item"), F.get(v, item).alias("was"), fixed.alias("fixed"), lower.alias("lower"))

        def put(x: Column) -> Column:
            """The state after the repair; without one it stays."""
            row = F.struct(year["yr"].alias("yr"), x["item"].alias("item"), x["was"].alias("original"), x["fixed"].alias("repaired"), x["lower"].alias("confidence"))
            done = x["was"].isNotNull() & x["fixed"].isNotNull() & ((x["item"] == 3) | (x["fixed"] >= 0)) & ~agree(x["was"], x["fixed"])
            after = F.struct(
                F.transform(state["conf"], lambda c, i: F.when(i == x["item"], x["lower"]).otherwise(c)).alias("conf"),
                F.transform(state["tab"], lambda c, i: F.when(i == x["item"], False).otherwise(c)).alias("tab"), F.concat(state["out"], F.array(row)).alias("out"),
            )
            return F.when(done, after).otherwise(state)

        sections, financing = v[1] + v[2], v[3] + v[4] + v[5]
        totals = F.struct(agree(sections, financing).alias("sf"), agree(v[0], sections).alias("rs"), agree(v[0], financing).alias("rf"))
        # each step is bound: an expression that lambdas name is worked out again for each of them
        return bound(bound(totals, odd), lambda item: F.when(item.isNull(), state).otherwise(bound(amount(item), put)))

    found = docs.select("doc_id", "branch", F.explode(F.aggregate("years", start, fold, lambda s: s["out"])).alias("r"))
    names = F.array(*map(F.lit, BALANCE))
    return found.select("doc_id", "branch", "r.yr", F.get(names, F.col("r.item")).alias("metric_key"), "r.original", "r.repaired", "r.confidence")


def reconciled(values: DataFrame, repairs: DataFrame) -> DataFrame:
    """values with the repaired amounts put in; is_repaired marks them."""
    fixes = repairs.select("doc_id", "branch", "metric_key", "yr", "repaired", F.col("confidence").alias("_c"))
    joined = values.join(fixes, [*KEYS, "yr"], "left")
    return joined.withColumns({"is_repaired": F.col("repaired").isNotNull(), "val": F.coalesce("repaired", "val"), "confidence": F.coalesce("_c", "confidence")}).drop("repaired", "_c")


def canonical(metrics: DataFrame) -> DataFrame:
    """Adds the unit's multiplier and a provenance array with one entry."""
    entry = F.struct("row_code", F.col("source_type").alias("extraction_method"), "confidence")
    return metrics.withColumns({"unit_multiplier": unit_multiplier(F.col("unit")), "provenance": F.array(entry)})
