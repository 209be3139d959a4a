"""Functions on text columns: quality, cleaning, predicates on sentences and bullets, numbers, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bound, normalize_label

# ---- fixed values ----
STATEMENT_TITLES = [
    "бухгалтерский баланс", "отчет о финансовых результатах",
    "отчет о движении денежных средств", "отчет о финансовом положении", "отчет о прибылях и убытках",
    "отчет о совокупном доходе", "statement of financial position", "statement of profit or loss",
    "statement of comprehensive income", "statement of cash flows", "balance sheet", "income statement",
    "cash flow statement",
]
#: Titles that a contents list names a statement by.
CONTENTS_TITLES = [
    "бухгалтерский баланс", "отчет о финансовом положении", "отчет о совокупном доходе",
    "отчет о финансовых результатах", "отчет о движении денежных средств",
    "statement of financial position", "statement of comprehensive income", "statement of cash flows",
]
FINANCIAL_WORDS = [
    "бухгалтерский", "баланс", "актив", "пассив", "оборотные", "внеоборотные", "активы", "обязательства", "капитал",
    "выручка", "себестоимость", "прибыль", "убыток", "дебиторская", "кредиторская", "задолженность", "денежные",
    "средства", "эквиваленты", "запасы", "инвестиции", "финансовые", "вложения", "налог", "операционный",
    "инвестиционный", "финансовый", "денежный", "поток", "платежи", "поступления", "заемные", "долгосрочные",
    "краткосрочные", "пояснения", "аудиторское", "заключение", "отчетность", "российским", "стандартам",
    "организация", "общество", "компания", "тысяч", "рублей", "показатель", "наименование", "текущих", "операций",
    "чистая", "валовая", "продаж",
]
STATEMENT_CODE = r"(?<!\d)(?:1[1-7]\d0|2[1-5]\d0|4[1-5]\d0)(?!\d)"
TABLE_NOISE = ["наименование показателя", "пояснения код", "единица измерения", "2025за", "2024за"]
KPI_NOISE = ["наименование показателя", "единица измерения", "пояснения код", "2025за", "2024за", "строка строк", "графа граф"]
BULLET_NOISE = ["наименование показателя", "единица", "2025за", "2024за", "пояснения код"]
TOKEN = "[А-Яа-яЁёA-Za-zÀ-ÖØ-öø-ÿ0-9]+"
#: Latin letters and the Cyrillic ones that look alike.
LOOK_ALIKES = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "K": "К", "M": "М", "O": "О", "P": "Р", "T": "Т", "X": "Х",
    "Y": "У", "a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у",
}
CYRILLIC, LATIN = "[А-Яа-яЁё]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
_LETTERS = "А-Яа-яЁёA-Za-zÀ-ÖØ-öø-ÿ"
# ---- end of fixed values ----


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column, least: int = 3) -> Column:
    return found(text, f"[{_LETTERS}]{{{least},}}")


def holds_any(text: Column, needles: list[str]) -> Column:
    """Whether one of the needles stands in a text, which is worked out once and not for each needle."""
    return bound(text, lambda t: F.exists(F.array(*map(F.lit, needles)), lambda n: t.contains(n)))


def top_share(tokens: Column) -> Column:
    """The share of the commonest of an array of strings; null for none."""
    order = F.array_sort(tokens)
    # runs of the sorted array: the longest one, without comparing all pairs
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, w):
        run = F.when(w == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.when(F.size(tokens) > 0, F.aggregate(order, start, step, lambda s: s["best"]) / F.size(tokens))


def share(tokens: Column, pattern: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w.rlike(pattern))) / F.greatest(F.size(tokens), F.lit(1))


def statement_codes(text: Column) -> Column:
    return F.array_distinct(found(text, STATEMENT_CODE))


def statement_titles(text: Column, titles: list[str] = STATEMENT_TITLES) -> Column:
    return bound(normalize_label(text), lambda label: F.size(F.filter(F.array(*map(F.lit, titles)), lambda t: label.contains(t))))


def years_in(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(found(text, r"(?<!\d)(?:19|20)\d{2}(?!\d)"), lambda y: y.cast("int"))))


def tenths(score: Column) -> Column:
    """A score to one decimal by its tenths, so that 61.45 is 61.5 although its nearest double lies below."""
    return F.round(score * 10) / 10


def native_quality(tokens: Column, text: Column) -> Column:
    """0 to 100: many tokens and long words, few single letters and broken characters. tokens: runs of letters and digits."""
    n = F.greatest(F.size(tokens), F.lit(1))
    alpha = F.size(F.filter(tokens, lambda w: w.rlike("[А-Яа-яЁёA-Za-z]")))
    single = F.size(F.filter(tokens, lambda w: w.rlike("^[^0-9]$")))
    long = F.size(F.filter(tokens, lambda w: (F.length(w) >= 3) & w.rlike("[А-Яа-яЁёA-Za-z]"))) / F.greatest(alpha, F.lit(1))
    broken = 2 * F.size(found(text, "�")) + F.size(found(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    score = F.least(F.lit(45.0), F.size(tokens) / 4.0) + long * 45.0 - single / n * 45.0 - F.least(F.lit(35.0), broken * 4.0)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(tenths(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))))


def word_plausibility(tokens: Column, letters: str = CYRILLIC, vowels: str = "[аеёиоуыэюя]", lexicon: list[str] = FINANCIAL_WORDS) -> Column:
    """Mean of 2 for lexicon words, 1 for three letters with a vowel and no letter thrice in a row, else 0."""
    known = F.array(*map(F.lit, lexicon))

    def one(word):
        w = F.translate(F.lower(word), "ё", "е")
        plain = (F.size(found(w, letters)) >= 3) & w.rlike(vowels) & ~w.rlike(r"(.)\1\1")
        return F.when(F.array_contains(known, w), 2.0).when(plain, 1.0).otherwise(0.0)

    total = F.aggregate(F.transform(tokens, one), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(tokens) > 0, total / F.size(tokens)).otherwise(0.0)


def read_quality(tokens: Column, alpha: Column, own: Column, mean_confidence: Column, script: str = CYRILLIC, **plausibility) -> Column:
    """0 to 100 for a recognised text: nine weighted terms over its tokens, those with letters, and those of its script."""
    n, many = F.greatest(F.size(tokens), F.lit(1)), F.greatest(F.size(alpha), F.lit(1))
    numeric = F.size(F.filter(tokens, lambda w: w.rlike("^[0-9]+$"))) / n
    short = F.size(F.filter(tokens, lambda w: w.rlike("^[^0-9]$"))) / n
    mixed = F.size(F.filter(alpha, lambda w: w.rlike("[А-Яа-яЁё]") & w.rlike("[A-Za-z]"))) / many
    repeated = F.coalesce(top_share(F.transform(alpha, F.lower)), F.lit(0.0))
    score = (
        mean_confidence * 0.62 + F.size(alpha) / n * 13 + F.size(own) / many * 8 + word_plausibility(own, script, **plausibility) * 12
        + F.least(F.lit(12.0), F.size(tokens) / 18.0) - F.greatest(F.lit(0.0), numeric - 0.70) * 12 - short * 25 - mixed * 18
        - F.greatest(F.lit(0.0), repeated - 0.20) * 30
    )
    return F.when(F.size(tokens) == 0, 0.0).otherwise(tenths(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))))


def repair_alphabet(text: Column) -> Column:
    """Latin look-alikes as Cyrillic letters within tokens that are mostly Cyrillic; single spaces."""
    def one(token):
        own, other = F.size(found(token, CYRILLIC)), F.size(found(token, "[A-Za-z]"))
        return F.when((own > 0) & (own >= other), F.translate(token, "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))).otherwise(token)

    return F.array_join(F.transform(F.split(squeezed(text), " "), one), " ")


def clean_line(line: Column) -> Column:
    """One line without soft hyphens, frame characters at its ends and spaces before punctuation."""
    t = F.translate(line, " −‐­", " --")
    t = repair_alphabet(t)
    t = F.regexp_replace(F.regexp_replace(t, r"^(?:[|¦Il1]\s*){2,}", ""), r"(?:\s*[|¦]){2,}$", "")
    return F.trim(F.regexp_replace(t, r"\s+([,.;:!?])", "$1"))


def clean_text(text: Column) -> Column:
    """Lines cleaned, rule lines and debris dropped, hyphenated line ends joined, blank lines squeezed."""
    lines = F.transform(F.split(text, "\r\n|\n|\r", -1), clean_line)
    letters = f"[{_LETTERS}]"
    kept = F.filter(lines, lambda w: ~w.rlike(r"^[._=|¦~\-–—\s]{4,}$") & ~((F.length(w) > 0) & (F.length(w) <= 2) & ~w.rlike(r"\d")) & ~((F.length(w) > 30) & ~w.rlike(letters)))
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"(?iu)-\n(?=[а-яёa-z])", "")
    return F.trim(F.regexp_replace(joined, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def clean_sentence(text: Column, script: str = CYRILLIC, noise: list[str] = TABLE_NOISE) -> Column:
    """Whether a sentence reads as prose: 70 to 650 characters, 9 words, mostly of one script, few digits, no repeats."""
    def prose(t: Column) -> Column:
        return F.length(t).between(70, 650) & ~holds_any(F.lower(t), noise) & bound(words(t), lambda tokens: (
            (F.size(tokens) >= 9) & (share(tokens, script) >= 0.65) & (F.size(found(t, r"(?U)\b\d+\b")) <= F.size(tokens) * 0.45)
            & (F.coalesce(top_share(F.transform(tokens, F.lower)), F.lit(0.0)) <= 0.16)
        ))

    return bound(squeezed(text), prose)


def clean_kpi(name: Column, source: Column, confidence: Column, script: str = CYRILLIC, noise: list[str] = KPI_NOISE) -> Column:
    """Whether an operational figure's name can be shown."""
    tokens = words(name)
    own = F.size(F.filter(tokens, lambda w: w.rlike(script)))
    return (
        (normalize_label(name) != "") & ~holds_any(normalize_label(name), noise) & (F.size(tokens) >= 2)
        & ((own == 0) | (own / F.size(tokens) >= 0.65)) & (F.coalesce(top_share(F.transform(tokens, F.lower)), F.lit(0.0)) <= 0.25)
        & ~(source.startswith("ocr") & (F.coalesce(confidence, F.lit(0.5)) < 0.9))
    )


def tidy_item(text: Column) -> Column:
    """Whether a narrative item is 30 to 500 characters with 6 words, none of them over 18 % of all."""
    t = squeezed(text)
    tokens = words(F.lower(t))
    return F.length(t).between(30, 500) & (F.size(tokens) >= 6) & (F.coalesce(top_share(tokens), F.lit(0.0)) <= 0.18)


def gibberish(text: Column, noise: list[str] = BULLET_NOISE) -> Column:
    t = squeezed(F.coalesce(text, F.lit("")))
    tokens = words(F.lower(t))
    return ~F.length(t).between(8, 1400) | (F.size(tokens) < 3) | (F.coalesce(top_share(tokens), F.lit(1.0)) > 0.20) | holds_any(F.lower(t), noise)


def claims(text: Column) -> Column:
    """Distinct numbers in a text, with a decimal point; digits after a letter don't count."""
    numbers = found(text, r"(?<![A-Za-zА-Яа-яЁё])\d+(?:[.,]\d+)?")
    return F.array_distinct(F.transform(numbers, lambda n: F.translate(n, ",", ".")))


def grounded(text: Column, allowed: Column) -> Column:
    """Whether each number of a text but 1 to 9 is among those allowed."""
    small = F.array(*[F.lit(str(i)) for i in range(1, 10)])
    return F.size(F.array_except(F.array_except(claims(text), small), allowed)) == 0


def text_key(text: Column) -> Column:
    """What two bullets must share to count as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "ё", "е"), "[^а-яa-z0-9]+", " "))


def fenced_json(text: Column) -> Column:
    """The outermost {...} of an answer, fenced or not; null without one."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner)


def bullet_text(item: Column, fields: tuple = ("action", "recommendation", "text", "finding", "insight", "description", "observation", "risk", "limitation", "title")) -> Column:
    """A structured bullet as prose: the first two distinct of its fields, only the first where it is complete in itself."""
    neat = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" •-\t")), F.lit(""))
    whole = F.coalesce(*[neat(item[f]) for f in fields[:3]])
    rest = F.array_distinct(F.array_compact(F.array(*[neat(item[f]) for f in fields[3:]])))
    return F.coalesce(whole, F.array_join(F.slice(rest, 1, 2), ": "))


def company_from_name(filename: Column) -> Column:
    """Legal form and name of a company in a file's name, up to the words about the report."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    pattern = r"(?U)\b(ПАО|АО|ООО)\s+[«\"]?([A-ZА-ЯЁ0-9][A-ZА-ЯЁa-zа-яё0-9 .&_-]{1,80})"
    form, name = F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)
    name = F.get(F.split(name, r"(?iuU)\s+(?:РСБУ|МСФО|отчетность|отчет|20\d{2})\b", 2), 0)
    name = F.trim(name, F.lit(' «»"_-'))
    return F.when((form != "") & (name != ""), F.concat(form, F.lit(" «"), name, F.lit("»")))
