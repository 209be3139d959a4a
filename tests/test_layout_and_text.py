import json

from ledgerloom.operators import layout, text_jobs
from ledgerloom.operators.page_tables import page_tables
from ledgerloom.sources import readers, sinks
from ledgerloom.streaming import ingest

WORD = "doc_id long, page int, line_no int, word_no int, text string, left double, top double, width double, height double, conf double"


def words(spark, lines):
    rows = []
    for n, line in enumerate(lines):
        for k, (left, text) in enumerate(line):
            rows.append((1, 1, n, k, text, float(left), n * 30.0, 8.0 * len(text), 12.0, 90.0))
    return spark.createDataFrame(rows, WORD)


def test_amounts_split_on_gaps(spark):
    df = words(spark, [[(0, "Выручка"), (100, "2110"), (200, "3"), (215, "453"), (245, "224"), (400, "(1"), (420, "200)")]])
    got = sorted((r.grp, r.value) for r in layout.amounts(df.where("word_no > 1"), 48, 1.8).collect())
    assert got == [(0, 3453224.0), (1, -1200.0)]


def test_ras_rows_by_code(spark):
    df = words(spark, [
        [(0, "Выручка"), (150, "2110"), (220, "100"), (400, "90")],
        [(0, "Себестоимость"), (150, "2120"), (220, "60"), (400, "50")],
    ])
    got = {r.metric_key: (r.first, r.second) for r in layout.ras_rows(df).collect()}
    assert got == {"revenue": (100.0, 90.0), "cogs": (-60.0, -50.0)}


def test_bank_rows_borrow_values_below(spark):
    df = words(spark, [
        [(0, "14"), (30, "Всего"), (90, "активов")],
        [(600, "1000"), (800, "900")],
        [(0, "21"), (30, "Операционные"), (150, "расходы"), (600, "50"), (800, "40")],
    ])
    pages = spark.createDataFrame([(1, 1, "Форма 0409806")], "doc_id long, page int, text string")
    got = {r.metric_key: (r.first, r.second) for r in layout.bank_rows(df, pages).collect()}
    assert got == {"assets": (1000.0, 900.0)}


def test_two_columns_and_ifrs(spark):
    from pyspark.sql import functions as F

    df = words(spark, [[(300, "2024"), (500, "2023")], [(0, "Total"), (60, "assets"), (300, "1"), (320, "000"), (500, "900")], [(0, "Inventories")], [(300, "55"), (500, "44")]])
    values = layout.two_column_values(df, F.lit(2024))
    assert {r.line_no: (r.first, r.second) for r in values.collect()} == {1: (1000.0, 900.0), 3: (55.0, 44.0), 0: (2024.0, 2023.0)}
    pages = spark.createDataFrame([(1, 1, "Consolidated statement of financial position")], "doc_id long, page int, text string")
    got = {r.metric_key: (r.first, r.second) for r in layout.ifrs_rows(layout.lines(df), values.where("line_no > 0"), pages).collect()}
    assert got["assets"] == (1000.0, 900.0) and "inventory" in got


def test_clusters_anchor_on_the_first_line(spark):
    rows = [(1, 1, n, f"l{n}", top, 0.0) for n, top in enumerate([0.0, 8.0, 16.0, 40.0])]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, top double, left double")
    # 16 is near 8 but not near the anchor at 0
    assert [(r.cluster, r.n_lines) for r in layout.row_clusters(df).collect()] == [(0, 2)]


def test_bands(spark):
    heads = spark.createDataFrame([(1, 1, 2023, 100.0), (1, 1, 2024, 200.0)], "doc_id long, page int, yr int, center double")
    got = {r.yr: (r.low, r.high) for r in layout.column_bands(heads).collect()}
    assert got == {2023: (50.0, 150.0), 2024: (150.0, 250.0)}


def test_page_neighbours(spark):
    pages = spark.createDataFrame([(1, p, "Бухгалтерский баланс 1100 1200" if p == 87 else "текст") for p in range(1, 101)], "doc_id long, page int, text string")
    got = {r.page for r in text_jobs.candidate_pages(pages, 6).collect()}
    assert got == {86, 87, 88}
    bare = spark.createDataFrame([(1, p, "текст") for p in range(1, 12)], "doc_id long, page int, text string")
    assert [r.page for r in text_jobs.candidate_pages(bare, 3).orderBy("ord").collect()] == [1, 6, 11]


def test_classes_years_and_sections(spark):
    from pyspark.sql import functions as F

    texts = [("Годовой отчет. Оглавление",), ("Бухгалтерский баланс и отчет о финансовых результатах",), ("1100 1200 1300 1400 1500 1600 2110 2120",), ("Investor presentation 2024",)]
    got = [r.c for r in spark.createDataFrame(texts, "t string").select(text_jobs.document_class(F.col("t")).alias("c")).collect()]
    assert got == ["annual_report", "ras_financial_statements", "ras_financial_statements", "investor_presentation"]
    year = spark.createDataFrame([("по состоянию на 31 декабря 2023, план 2025",), ("for 2022 year",), ("нет",)], "t string").select(text_jobs.reporting_year(F.col("t")).alias("y"))
    assert [r.y for r in year.collect()] == [2023, 2022, None]
    section = "doc_id long, section string, ord int, text string"
    sound = [(1, "risks", i, f"Риск номер {w} для компании остается высоким") for i, w in enumerate(["один", "два"])]
    baseline = spark.createDataFrame([(1, "risks", 0, "Базовый вывод о риске ликвидности"), (1, "strengths", 0, "Базовая сильная сторона компании")], section)
    allowed = spark.createDataFrame([(1, ["5"])], "doc_id long, numbers array<string>")
    got = text_jobs.accepted_sections(spark.createDataFrame(sound, section), baseline, allowed).collect()
    assert sorted((r.section, r.ord) for r in got) == [("risks", 1), ("risks", 2), ("strengths", 1)]


def test_csv_keeps_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Показатель;2024;2025\nВыручка;"1 200";1 300\n\n', encoding="utf-8")
    got = [r.cells for r in readers.statement_csv(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [["Показатель", "2024", "2025"], ["Выручка", "1 200", "1 300"]]


def test_csv_of_either_encoding(spark, tmp_path):
    (tmp_path / "utf.csv").write_text('Показатель,2024\n"Выручка, всего","1 ""200"""\n', encoding="utf-8")
    (tmp_path / "old.csv").write_bytes('Показатель;2024;\r\n;"a;b";Ёж №1\r\n'.encode("cp1251"))
    (tmp_path / "empty.csv").write_text("")
    got = readers.statement_csv(spark, str(tmp_path)).orderBy("path", "row_no").collect()
    assert [r.cells for r in got] == [["Показатель", "2024", ""], ["", "a;b", "Ёж №1"], ["Показатель", "2024"], ["Выручка, всего", '1 "200"']]


def page_rows(spark, lines, quality=90.0):
    pages = spark.createDataFrame([(1, 1, quality)], "doc_id long, page int, ocr_quality double")
    rows = page_tables(words(spark, lines), pages).orderBy("line_no", "yr").collect()
    return [(r.line_no, r.code, r.label, r.yr, r.val) for r in rows]


def test_page_tables(spark):
    years = [(400, "2024"), (700, "2023")]
    lines = [
        years,
        [(0, "Revenue"), (80, "sum:"), (130, "total"), (380, "1"), (400, "200"), (690, "(900)")],
        [(0, "Costs"), (690, "800")],
        [(0, "Costs"), (690, "800")],  # a repeated row; above, total has a letter that is read for a digit
        [(0, "Far"), (380, "1"), (690, "80")],  # 80 times apart
        [(380, "5"), (690, "6")],  # no label
        [(400, "2022"), (700, "2021")],  # ends the table
        [(0, "Other"), (380, "5")],
    ]
    assert page_rows(spark, lines) == [
        (1, None, "Revenue sum", 2023, -900.0), (1, None, "Revenue sum", 2024, 1200.0), (2, None, "Costs", 2023, 800.0)
    ]
    assert page_rows(spark, lines, quality=47.0) == page_rows(spark, lines, quality=None) == page_rows(spark, lines[:2]) == []


def test_page_tables_of_a_form(spark):
    lines = [
        [(400, "2024"), (700, "2023")],
        [(0, "Bыpучка"), (200, "2110"), (400, "500"), (700, "400")],
        [(0, "Себестоимость"), (200, "2120"), (400, "50")],  # one amount
        [(0, "Запасы"), (400, "50"), (700, "40")],  # no code
        [(0, "x"), (200, "1210"), (400, "30000000000"), (700, "40")],  # over the ceiling
        [(0, None), (200, "2400"), (400, "70"), (700, "60")],
    ]
    assert page_rows(spark, [[(left, text or "") for left, text in line] for line in lines]) == [
        (1, "2110", "Выручка", 2023, 400.0), (1, "2110", "Выручка", 2024, 500.0),
        (5, "2400", "Чистая прибыль (убыток)", 2023, 60.0), (5, "2400", "Чистая прибыль (убыток)", 2024, 70.0),
    ]


def test_sinks(spark, tmp_path):
    facts = spark.createDataFrame([(1, "cash", 2024, 5.0)], "doc_id long, metric_key string, yr int, val double")
    found = spark.createDataFrame([(1, "roa", 0.1, "good", 2024, "10.0%")], "doc_id long, ratio_key string, value double, status string, cur_year int, display string")
    rows = sinks.export_rows(facts, found)
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 2
    assert json.loads(sinks.as_json(rows).where("section = 'ratio'").first().json)["display"] == "10.0%"


def test_streams_equal_batch(spark, data, tmp_path):
    from ledgerloom.operators.model import gated, merged_values
    from ledgerloom.plans.fixtures import candidates

    rows = candidates(spark, data).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in ingest.CANDIDATES.split(", ")])
    rows.write.parquet(str(tmp_path / "in"))
    ingest.ingest_statements(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = ingest.model_rows(spark, str(tmp_path / "out")).select("doc_id", "metric_key", "yr", "seq")
    want = merged_values(gated(rows)).select("doc_id", "metric_key", "yr", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_class_by_a_late_keyword(spark):
    from ledgerloom.operators.text_jobs import document_class

    late = "some words " * 25000 + "investor presentation"
    rows = spark.createDataFrame([(late,), ("some words",)], "text string")
    assert [r[0] for r in rows.select(document_class(rows.text)).collect()] == ["investor_presentation", "corporate_document"]


def test_words_of_statutory_forms_are_shuffled_once(spark):
    """Also a page whose only code is damaged, a line of unsure words and one without text."""
    columns = "doc_id long, page long, line_no long, word_no int, text string, left double, top double, width double, height double, conf double"
    said = lambda page, line, texts, conf=90.0: [(1, page, line, i, t, 300.0 * i, 0.0, 60.0, 12.0, conf) for i, t in enumerate(texts)]
    rows = [
        *said(1, 1, ["Выручка", "2110", "100", "90"]), *said(1, 2, ["Себестоимость продаж", "212", "60", "50"]), *said(1, 3, ["Чистая прибыль", "2400", "7", "8"]),
        *said(1, 4, ["Выручка", "2110", "999", "998"], 5.0), *said(1, 5, [None, None]), *said(2, 1, ["Запасы", "121", "5", "6", "7"]),
    ]
    found = layout.ras_rows(spark.createDataFrame(rows, columns).repartition(3))
    got = {r.metric_key: (r.code, r["first"], r.second, r.score) for r in found.collect()}
    assert got == {"revenue": ("2110", 100.0, 90.0, 230.0), "cogs": ("2120", -60.0, -50.0, 185.0), "net_profit": ("2400", 7.0, 8.0, 230.0)}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(doc_id") == 2  # words by page, then lines by metric
    assert layout.ras_rows(spark.createDataFrame([], columns)).count() == 0


def test_page_tables_join_lines_with_pages_not_words(spark):
    """Also where pages are too many to be broadcast."""
    lines = [[(380.0, "2023"), (680.0, "2022")], [(0.0, "Goods"), (380.0, "52345"), (680.0, "51234")], [(0.0, "Services"), (380.0, "31234"), (680.0, "41234")]]
    pages = spark.createDataFrame([(1, 1, 80.0), (2, 1, 20.0)], "doc_id long, page int, ocr_quality double")
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = page_tables(words(spark, lines), pages)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert plan.index("LeftSemi") < plan.index("collect_set(code")  # the join is above the grouping of words to lines
    # words once, pages for each of their joins
    assert plan.count("Exchange hashpartitioning(doc_id") == 3
