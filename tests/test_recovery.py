"""Second ways to a statement's content: each query against its SQL, and odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recovery as Y
from ledgerloom.plans import recovery_queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_equal_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted([shown(v) for v in r] for r in got.collect()) == sorted([shown(r[i]) for i in place] for r in want.fetchall())


def test_text_rows_need_their_form(spark):
    page = "Отчет о финансовых результатах\nВыручка 2110 | 5 000 | 4 000\nСебестоимость продаж 2120 | (2 000) | (1 500)\n"
    pages = [(1, 1, page, 2024), (2, 1, page.replace("2120", ""), 2024), (3, 1, page, None), (4, 1, None, 2024), (5, 1, "", 2024)]
    rows = Y.text_rows(spark.createDataFrame(pages, "doc_id long, page int, text string, reporting_year int")).collect()
    assert {(r.doc_id, r.metric_key, r.yr, r.val) for r in rows} == {(1, "revenue", 2024, 5000.0), (1, "revenue", 2023, 4000.0), (1, "cogs", 2024, -2000.0), (1, "cogs", 2023, -1500.0)}


def test_the_auditor_is_not_the_company(spark):
    gap = "текст " * 60
    texts = [(1, f"Аудиторская организация АО «Аудит» Акционерное общество «Аудит» {gap} Акционерам Публичного акционерного общества «Нефть»"), (2, None), (3, "Группа «Сталь» за год"), (4, "Annual report of the company\nACME Group")]
    found = {r.doc_id: r.company for r in Y.companies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found == {1: "ПАО «Нефть»", 2: "Не определено", 3: "«Сталь»", 4: "ACME Group"}


def test_export_cells_and_items(spark):
    row = spark.range(1).select(
        Y.export_number(F.lit(1234567.0)).alias("a"), Y.export_number(F.lit(1234.5)).alias("b"), Y.export_number(F.lit(None).cast("double")).alias("c"),
        Y.export_items(F.array(F.lit(" x "), F.lit(""), F.lit(None))).alias("d"), Y.export_items(F.lit(None).cast("array<string>"), "none").alias("e"),
    ).first()
    assert list(row) == ["1 234 567", "1 234.50", "—", ["x"], ["none"]]


def test_notes_keep_signs_decimals_and_years_apart(spark):
    from ledgerloom.operators import recovery

    lines = ["Depreciation (1 234) (1 100)", "Depreciation 12,5 11,4", "Depreciation 2024 1 200 2023 1 100", "Depreciation"]
    pages = [(i, 1, 2024, f"Notes to the statements, in millions of roubles\nOperating expenses\n{line}") for i, line in enumerate(lines)]
    rows = recovery.note_rows(spark.createDataFrame(pages, "doc_id long, page int, reporting_year int, text string")).collect()
    assert {(r.doc_id, r.yr): r.val for r in rows} == {(0, 2024): -1234.0, (0, 2023): -1100.0, (1, 2024): 12.5, (1, 2023): 11.4, (2, 2024): 1200.0, (2, 2023): 1100.0}
    assert {(r.unit, r.confidence) for r in rows} == {("млн руб.", 0.97)}


def test_a_page_with_year_columns_beats_one_without(spark):
    from ledgerloom.operators import layout

    rows = [(1, page, 1, f"Итого активы {v} {v}", conf) for page, v, conf in ((1, 100, 95.0), (2, 200, 80.0))]
    values = [(1, page, 1, float(v), float(v)) for page, v in ((1, 100), (2, 200))]
    text = "Consolidated statement of financial position, thousands of roubles"
    pages = spark.createDataFrame([(1, 1, text, 50.0), (1, 2, text, None)], "doc_id long, page int, text string, ocr_quality double")
    given = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, conf double"), spark.createDataFrame(values, "doc_id long, page int, line_no int, first double, second double")
    columned = spark.createDataFrame([(1, 2)], "doc_id long, page int")
    got = layout.ifrs_rows(*given, pages, columned).first()
    assert (got.page, got.first, got.unit, got.confidence, got.score) == (2, 200.0, "тыс. руб.", 0.98, 400.0)
    assert layout.ifrs_rows(*given, pages).first().page == 1
