from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def test_parse_number(spark):
    cases = {
        "13 344": 13344.0, "(1 250,5)": -1250.5, "1 234": 1234.0, "−5": -5.0, "5%": 5.0, "1,234": 1.234, "1,234,567": None,
        "1.234,5": 1234.5, "1,234.5": 1234.5, "н/д": None, "-": None, "": None, "12 руб.": 12.0, "abc": None, "–7": 7.0,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.x for r in rows.select("c", S.parse_number(F.col("c")).alias("x")).collect()}
    assert got == cases
    assert one(spark, S.parse_number, None) is None


def test_labels_units_growth(spark):
    assert one(spark, S.normalize_label, "  Запасы:  млн  руб. ") == "запасы: млн руб"
    assert one(spark, S.normalize_label, "Счёт–фактура") == "счет-фактура"
    assert one(spark, lambda a, b: S.growth(a, b), 12.0, 10.0) == 0.2
    assert one(spark, lambda a, b: S.safe_divide(a, b), 1.0, 0.0) is None
    assert one(spark, S.ceiling, "млн руб.") == 5e8
    assert one(spark, lambda u: S.to_thousands(u)[0], "млрд руб.") == 1e6
    assert one(spark, lambda u: S.to_thousands(u)[1], "руб.") == "тыс. руб."
    assert one(spark, S.unit_multiplier, "nothing") == 1.0


def test_two_amounts(spark):
    split = lambda c: S.two_amounts(F.split(c, " "))["first"]
    assert one(spark, split, "3 596 395 4 368 456") == 3596395.0


def test_displays(spark):
    assert one(spark, lambda v: S.format_amount(v, F.lit("тыс. руб.")), 2500000.0) == "2,5 млрд руб"
    assert one(spark, S.format_percent, -1.25) in ("−1,3%", "−1,2%")
    assert one(spark, lambda v: S.ratio_display(v, F.lit(True)), 0.125) == "12.5%"


def test_grounding_and_bullets(spark):
    check = lambda c: T.grounded(c, F.array(F.lit("12.5")))
    assert one(spark, check, "Маржа 12,5 и 3 пункта") is True
    assert one(spark, check, "Маржа 13,5") is False
    assert one(spark, T.gibberish, "да") is True
    assert one(spark, T.fenced_json, 'x ```json {"a": {"b": 1}} ``` y') == '{"a": {"b": 1}}'
    assert one(spark, T.company_from_name, "ПАО Ромашка РСБУ 2024.pdf") == "ПАО «Ромашка»"


def test_cleaning(spark):
    text = "Выруч-\nка за год\n_____\nab\n\n\n\nИтог"
    assert one(spark, T.clean_text, text) == "Выручка за год\n\nИтог"
    assert one(spark, T.repair_alphabet, "Bыpучка cash") == "Выручка cash"


def test_amounts_of_a_line(spark):
    from ledgerloom.functions.scalars import text_pair

    lines = ["7 Выручка 3 596 395 4 368 456", "Расходы (1 200) (900)", "3 596 395 4 368 456", "Активы 5,5 6,5", "За 2024 и 2023 годы", "Нет", "(1 200) 900 0", "", None]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(x,) for x in lines], "t string").select(text_pair(F.col("t")).alias("p")).collect()]
    assert got == [(3596395.0, 4368456.0), (-1200.0, -900.0), (3596395.0, 4368456.0), (5.5, 6.5), None, None, (-1200.0, 9000.0), None, None]


def test_numbers_equal_their_steps_one_by_one(spark):
    import random
    import re

    def plain(text):
        cell = re.sub(r"^\s+|\s+$", "", text)
        if cell in S.MISSING:
            return None
        body = re.sub(r"(?<=\d)\s+(?=\d)", "", cell.replace("\u00a0", " ").replace("\u2212", "-"))
        body = re.sub(r"[^0-9,.\-+]", "", re.sub(r"%|₽|руб\.", "", body))
        if re.search("^[^,.]*,[^,.]*$", body):
            body = body.replace(",", ".")
        elif re.search(r"\..*,[^.]*$", body):
            body = body.replace(".", "").replace(",", ".")
        elif "." in body and "," in body:
            body = body.replace(",", "")
        try:
            value = float(body)
        except ValueError:
            return None
        return -abs(value) if cell.startswith("(") and cell.endswith(")") else value

    rng = random.Random(3)
    bits = ["1", "23", "456", "0", ",", ".", "-", "+", "(", ")", " ", "  ", "\u00a0", "\u2009", "\u3000", "\t", "\n", "\u0085", "\u2212", "%", "₽", "руб.", "руб", "р", "у%б.", "н/д", "na", "x", "٣"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(6000)] + ["1 234 567,89", "(1 234,5)", "1,234,567", "1.234,5", "1,234.5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.parse_number(F.col("t")).alias("v")).collect()
    assert {r.i: r.v for r in rows} == {i: plain(t) for i, t in enumerate(texts)}
