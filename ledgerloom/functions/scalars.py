"""Scalar functions on columns: labels, numbers, units, growth, grades, displays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a missing number is written, dashes, quality bonus of a source, multipliers of units.
MISSING = ["-", "–", "—", "н/д", "n/a", "na"]
SOURCE_BONUS = {
    "bank_ras_coordinate_ocr": 0.42,
    "ras_coordinate_ocr": 0.35,
    "ras_ocr_form": 0.15,
    "ifrs_primary_statement": 0.42,
    "ifrs_disclosure_note": 0.44,
    "pdf_table": 0.10,
    "spreadsheet": 0.20,
}
UNIT_MULTIPLIERS = {"руб.": 1.0, "тыс. руб.": 1e3, "млн руб.": 1e6, "млрд руб.": 1e9, "RUB": 1.0}
#: What Unicode calls white space, as (?U)\s finds it.
WHITE_SPACE = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
TRUSTED_SOURCES = [
    "bank_ras_coordinate_ocr", "ras_coordinate_ocr", "ras_form", "ras_ocr_form", "ifrs_primary_statement",
    "ifrs_disclosure_note", "pdf_table", "spreadsheet", "spreadsheet_table", "docx_table", "ai_vision_recovery",
    "manual", "derived_from_verified_rows", "reconciled_from_accounting_identity",
]


def normalize_label(text: Column) -> Column:
    """Lower case, ё as е, one kind of dash, single spaces, no punctuation at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[­‐-―]", "-"), r"(?U)\s+", " ")
    return F.trim(plain, F.lit(" .,:;–—-\t"))


def bound(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def those_that(*rows: tuple[Column, Column]) -> Column:
    """The array of the values, of (condition, value) pairs, whose condition holds.

    Not array_compact, whose values Spark works out without generated code.
    """
    return F.concat(*[F.when(holds, F.array(value)).otherwise(F.array()) for holds, value in rows])


def parse_number(text: Column) -> Column:
    """The number that a cell spells, or null. "1,234,567" is null, "1,234" is 1.234, "5%" is 5."""

    def digits(cell: Column) -> Column:
        return F.regexp_replace(F.translate(cell, "\u2212", "-"), r"руб\.|[^0-9,.\-+]", "")

    def decimal(body: Column) -> Column:
        one_comma, comma_last = body.rlike("^[^,.]*,[^,.]*$"), body.rlike(r"\..*,[^.]*$")
        return (
            F.when(~body.contains(","), body)
            .when(one_comma, F.translate(body, ",", ".")).when(comma_last, F.translate(F.translate(body, ".", ""), ",", "."))
            .when(body.contains("."), F.translate(body, ",", "")).otherwise(body)
        ).try_cast("double")

    def read(cell: Column) -> Column:
        signed = bound(bound(digits(cell), decimal), lambda v: F.when(cell.startswith("(") & cell.endswith(")"), -F.abs(v)).otherwise(v))
        # most cells are plain digits, which no step would change
        return F.when(cell.rlike("^[0-9]+$"), cell.try_cast("double")).when(~cell.isin(*MISSING), signed)

    return bound(F.trim(text, F.lit(WHITE_SPACE)), read)


def safe_divide(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def average(a: Column, b: Column) -> Column:
    """Mean of what is there."""
    return F.coalesce((a + b) / 2, a, b)


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, F.abs(before))


def percent_change(now: Column, before: Column) -> Column:
    return growth(now, before) * 100


def grade(value: Column, good, warn) -> Column:
    return F.when(value.isNull(), "na").when(good(value), "good").when(warn(value), "warn").otherwise("bad")


def ceiling(unit: Column) -> Column:
    """The largest amount that a statement may hold in a unit."""
    most = lambda u: F.when(u.contains("тыс"), 5e11).when(u.contains("млн"), 5e8).when(u.contains("млрд"), 5e5).otherwise(5e14)
    # amounts are in thousands mostly, whose unit needn't be normalised
    return F.when(unit == "тыс. руб.", 5e11).otherwise(bound(normalize_label(F.coalesce(unit, F.lit(""))), most))


def plausible(value: Column, unit: Column) -> Column:
    return F.abs(value) <= ceiling(unit)


def to_thousands(unit: Column) -> tuple[Column, Column]:
    """Factor to thousands of rubles, and the unit after it; other units stay."""

    def times(u: Column) -> Column:
        ruble = u.contains("руб") | u.contains("rur")
        single = u.isin("руб", "руб.", "rur", "rub") | u.contains("руб") & ~u.contains("тыс")
        return F.when(u.contains("млрд") & ruble, 1e6).when(u.contains("млн") & ruble, 1e3).when(single, 1e-3)

    # the plain spellings needn't be normalised
    other = bound(normalize_label(F.coalesce(unit, F.lit(""))), times)
    factor = F.when(unit == "тыс. руб.", F.lit(None).cast("double")).when(unit == "млн руб.", 1e3).otherwise(other)
    return F.coalesce(factor, F.lit(1.0)), F.when(factor.isNotNull(), "тыс. руб.").otherwise(unit)


def unit_multiplier(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in UNIT_MULTIPLIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, unit), F.lit(1.0))


def consistent(values: Column, most: float = 50.0) -> Column:
    """Whether the largest of an array of amounts is at most 50 times the least, zeros and nulls aside."""
    sizes = F.filter(F.transform(values, F.abs), lambda v: v > 0)
    return F.coalesce(F.array_max(sizes) <= most * F.array_min(sizes), F.lit(True))


def source_bonus(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SOURCE_BONUS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, source), F.lit(0.0))


def quality(confidence: Column, source: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.5)) + source_bonus(source)


def repair_digits(token: Column) -> Column:
    """Letters that are read for digits, put back: O and О to 0, I and l to 1, no bars, round brackets."""
    return F.translate(F.translate(token, "|", ""), "OОIl{[", "0011((")


def number_tokens(text: Column) -> Column:
    """The numbers that stand in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"\(?[\u2212-]?\d(?:[\d \u00a0]*\d)?(?:[,.]\d+)?\)?"), F.lit(0))
    return F.filter(F.transform(found, parse_number), lambda v: v.isNotNull())


def two_amounts(tokens: Column) -> Column:
    """The split of digit groups into two amounts of most similar size: (first, second).

    Neither amount is zero. Score of a cut: |log10 of the ratio| plus 0.15 for each group that one side has more.
    """

    def cut(tokens: Column, i: Column) -> Column:
        left, right = F.slice(tokens, F.lit(1), i), F.slice(tokens, i + 1, F.size(tokens) - i)
        sides = [F.nullif(parse_number(F.array_join(side, " ")), F.lit(0.0)) for side in (left, right)]
        read = F.struct(sides[0].alias("a"), sides[1].alias("b"))

        def scored(x: Column) -> Column:
            far = F.abs(F.log10(F.abs(x["a"]) / F.abs(x["b"])))
            return F.struct((far + 0.15 * F.abs(2 * i - F.size(tokens))).alias("score"), i.alias("at"), x["a"].alias("first"), x["b"].alias("second"))

        return bound(read, scored)

    def split(tokens: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: cut(tokens, i))
        best = F.array_min(F.filter(cuts, lambda c: c["first"].isNotNull() & c["second"].isNotNull()))
        return F.when(F.size(tokens) >= 2, bound(best, lambda x: F.struct(x["first"].alias("first"), x["second"].alias("second"))))

    return bound(tokens, split)


def text_pair(text: Column) -> Column:
    """(first, second): the two amounts at the end of a line of text; null where there aren't two.

    A note's number before the words and years don't count; two amounts in brackets are the pair.
    Each step is bound, so that no expression is worked out again wherever the next one names it.
    """
    two = lambda a: F.struct(parse_number(F.get(a, F.lit(0))).alias("first"), parse_number(F.get(a, F.lit(1))).alias("second"))

    def neat(raw: Column) -> Column:
        return F.regexp_replace(F.translate(repair_digits(F.trim(raw)), "\u2212}]", "-))"), r"^\s*\d+(?:\s*,\s*\d+)*\s+[—–-]?\s*(?=[A-Za-zА-Яа-яЁё])", "")

    def cut(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(r"\([^)]*\d[^)]*\)|[-+]?\d[\d.,]*"), F.lit(0))
        bracketed = F.regexp_extract_all(line, F.lit(r"\([^)]*\d[^)]*\)"), F.lit(0))
        return F.struct(bracketed.alias("bracketed"), F.filter(found, lambda t: ~t.rlike(r"^(19|20)\d{2}$")).alias("tokens"))

    def pair(x: Column) -> Column:
        tokens = x["tokens"]
        return F.when(F.size(x["bracketed"]) == 2, two(x["bracketed"])).when(F.size(tokens) == 2, two(tokens)).otherwise(F.when(F.size(tokens) > 2, two_amounts(tokens)))

    chosen = bound(bound(bound(text, neat), cut), pair)
    return bound(chosen, lambda c: F.when(c["first"].isNotNull() & c["second"].isNotNull(), c))


def comma_decimal(value: Column, digits: int) -> Column:
    return F.translate(F.format_number(value, digits), ",.", " ,")


def format_amount(value: Column, unit: Column) -> Column:
    u = F.lower(F.coalesce(unit, F.lit("")))
    thousands, size = u.contains("тыс"), F.abs(value)
    plain = F.trim(F.concat_ws(" ", comma_decimal(value, 0), F.rtrim(F.coalesce(unit, F.lit("")), F.lit("."))))
    return (
        F.when(value.isNull(), "—")
        .when(thousands & (size >= 1e6), F.concat(comma_decimal(value / 1e6, 1), F.lit(" млрд руб")))
        .when(thousands & (size >= 1e3), F.concat(comma_decimal(value / 1e3, 1), F.lit(" млн руб")))
        .otherwise(plain)
    )


def format_percent(value: Column) -> Column:
    return F.concat(F.translate(F.format_string("%.1f", value), ".-", ",−"), F.lit("%"))


def format_decimal(value: Column, digits: int = 2) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", value), ".", ",")


def ratio_display(value: Column, is_percent: Column) -> Column:
    shown = F.when(is_percent, F.format_string("%.1f%%", value * 100)).otherwise(F.translate(F.format_number(value, 2), ",", " "))
    return F.when(value.isNull(), "—").otherwise(shown)
