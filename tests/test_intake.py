"""Files to readings, units out of context, and the lineage of metrics, on small hand-made inputs."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import lineage, model, tables
from ledgerloom.plans import chain
from ledgerloom.sources import intake

ROWS = "doc_id long, table_id int, row_no int, cells array<string>, page int, sheet string, context string, source_type string, confidence double"
READ = (
    "doc_id long, branch string, metric_key string, seq long, source_type string, confidence double, unit string, row_code string, "
    "source_row string, page int, sheet string, yr int, val double"
)


def table(doc, rows, table_id=0, page=1, sheet=None, context=None, source=None, confidence=None):
    return [(doc, table_id, i, cells, page, sheet, context, source, confidence) for i, cells in enumerate(rows)]


def test_units_from_label_title_and_page(spark):
    head = ["", "2024", "2023"]
    rows = table(1, [head, ["Выручка, млн руб.", "5", "4"], ["Запасы", "2", "1"]], context="в тыс. руб.")
    rows += table(2, [head, ["Доля рынка", "5", "4"], ["Запасы", "2", "1"]], context="изменение, п.п.")
    rows += table(3, [head, ["Запасы", "2", "1"]])
    rows += table(4, [["Отчет, млрд руб.", "", ""], head, ["Запасы", "2", ""]], context="курс, долл.")
    pages = spark.createDataFrame([(3, 1, "Баланс, млн руб. Запасы 2 1 и тыс. т"), (1, 1, "шт.")], "doc_id long, page int, text string")
    made = tables.with_page_context(spark.createDataFrame(rows, ROWS), pages)
    got = {(r.doc_id, r.label): (r.unit, r.confidence) for r in tables.labelled_readings(made).collect()}
    assert got == {
        (1, "Выручка, млн руб."): ("млн руб.", 0.9), (1, "Запасы"): ("тыс. руб.", 0.9), (2, "Доля рынка"): ("п.п.", 0.9), (2, "Запасы"): (None, 0.9),
        (3, "Запасы"): ("млн руб.", 0.9), (4, "Запасы"): ("млрд руб.", 0.72),
    }


def test_coded_rows_tell_where_they_stand(spark):
    rows = table(1, [["", "Код", "2024", "2023"], ["Выручка", "2110", "5", "4"], ["Себестоимость", "212О", "(3)", "2"], ["нет", "9999", "1", "1"]], sheet="S")
    rows += table(2, [["", "Код", "2024"], ["Выручка", "2110", "5"]], context="млн руб.", source="docx_table")
    got = {(r.doc_id, r.metric_key, r.yr): r for r in tables.coded_readings(spark.createDataFrame(rows, ROWS)).collect()}
    assert {k: r.val for k, r in got.items()} == {
        (1, "revenue", 2024): 5.0, (1, "revenue", 2023): 4.0, (1, "cogs", 2024): -3.0, (1, "cogs", 2023): -2.0, (2, "revenue", 2024): 5.0,
    }
    one, two = got[1, "cogs", 2024], got[2, "revenue", 2024]
    assert (one.unit, one.source_type, one.source_row, one.row_code) == ("тыс. руб.", "spreadsheet_table", "Себестоимость | 212О | (3) | 2", "2120")
    assert (two.unit, two.source_type, two.confidence) == ("млн руб.", "docx_table", 0.98)


def test_files_of_one_document_in_one_order(spark, tmp_path):
    """Both encodings, JSON and Parquet, an unread file, and the same numbers however the tables are cut up."""
    head = ["Показатель", "2024", "2023"]
    for path, text, encoding in (
        ("sheets/doc_id=1/a.CSV", "﻿Отчетность по МСФО;;;\n;;;\nПоказатель;2024;;2023\nВыручка;5;;4\n", "utf-8"),
        ("sheets/doc_id=1/b.csv", "Показатель,2024,2023\nЗапасы,7,6\n", "cp1251"), ("sheets/other.csv", "a;2024\nВыручка;1\n", "utf-8"), ("notes.txt", "no table", "utf-8"),
    ):
        place = tmp_path / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_bytes(text.encode(encoding))
    stored = table(1, [head, ["Запасы", "9", "8"]], 4, 2) + table(1, [head, [None, None, None], ["Денежные  средства", "1", "1"]], 3, 1) + table(None, [head, ["Запасы", "1", "1"]])
    random.Random(1).shuffle(stored)
    spark.createDataFrame(stored[:3], ROWS).write.json(str(tmp_path / "tables/j"))
    spark.createDataFrame(stored[3:], ROWS).repartition(3).write.parquet(str(tmp_path / "tables/p"))
    spark.createDataFrame(stored[:3], ROWS).limit(0).write.parquet(str(tmp_path / "tables/empty"))
    routes = {(r.format, r.accepted) for r in intake.routed(spark, str(tmp_path)).where(~F.col("path").rlike(r"/[_.][^/]*$")).collect()}
    assert routes == {("csv", True), ("text", False), ("json", True), ("parquet", True)}
    rows = intake.table_rows(spark, str(tmp_path))
    cells = {(r.table_id, r.row_no): r.cells for r in rows.collect()}
    assert cells[0, 1] == ["Показатель", "2024", "2023"] and cells[0, 2] == ["Выручка", "5", "4"] and cells[1, 1] == ["Запасы", "7", "6"]
    found = tables.table_readings(rows)
    first = {(r.branch, r.seq, r.metric_key, r.yr): r.val for r in found.collect()}
    assert first == {(r.branch, r.seq, r.metric_key, r.yr): r.val for r in tables.table_readings(rows.repartition(5)).collect()}
    assert {k[0] for k in first} == {"generic", "ifrs"} and ("generic", 2, "revenue", 2024) in first and ("generic", tables.PLACE + 1, "inventory", 2024) in first


def reading(seq, source, confidence, val, years=(2024, 2023), unit="тыс. руб.", code=None, row=None, page=None, key="revenue"):
    return [(1, "ras", key, seq, source, confidence, unit, code, row, page, None, y, val) for y in years]


def entries(metrics):
    return {r.metric_key: r for r in metrics.collect()}


def test_attributes_of_accepted_readings(spark):
    rows = reading(1, "pdf_table", 0.72, 10.0, unit=None, page=5) + reading(2, "pdf_table", 0.98, 11.0, code="2110", row="Выручка | 2110", page=2)
    rows += reading(3, "pdf_text", 0.55, 12.0, page=9) + reading(4, "pdf_table", 0.98, 13.0, unit=None, page=2) + reading(5, "spreadsheet_table", 2.0, 5.0, code="9", page=7, years=(2022,))
    kept = model.gated(lineage.with_provenance(spark.createDataFrame(rows, READ)))
    got = entries(lineage.attributes(kept))["revenue"]
    assert (got.unit, got.confidence, got.source_type, got.row_code, got.source_row) == ("тыс. руб.", 1.0, "spreadsheet_table", "9", "Выручка | 2110")
    assert got.pages == [2, 5, 7] and got.n_accepted == 4 and [(p.page, p.row_code) for p in got.provenance] == [(2, "2110")]


def test_metrics_and_amounts_in_one_pass(spark):
    """Amounts beside the attributes are those of merge and outliers, and readings are shuffled once for both."""
    pick = random.Random(4)
    rows = [
        (doc, "ras", key, seq, source, confidence, pick.choice(["тыс. руб.", "млн руб.", None]), None, None, None, None, y, pick.choice([0.0, 1.0, 30.0, 900.0]))
        for doc in range(8) for key in ("revenue", "cash") for seq, (source, confidence) in enumerate([("pdf_table", 0.9), ("pdf_text", 0.95), ("pdf_table", 0.72), ("spreadsheet", 0.9)])
        for y in (2021, 2022, 2023) if pick.random() < 0.8
    ]
    kept = model.gated(spark.createDataFrame(rows, READ))
    told = lineage.without_outlier_years(lineage.attributes(kept))
    got = {(*r[:3], y.yr): y.val for r in told.select(*model.KEYS, "years").collect() for y in r.years}
    marked = model.without_outliers(model.merged_values(kept)).collect()
    assert any(r.dropped for r in marked) and got == {(r.doc_id, r.branch, r.metric_key, r.yr): r.val for r in marked if not r.dropped}
    assert told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_titles_and_codes_come_with_the_numbers(spark):
    """A table's rows are shuffled once for header, title and numbers; a row's code is that of its first cell with one."""
    rows = table(1, [["Отчет, млн руб.", "", "", ""], ["", "Код", "2024", "2023"], ["Выручка", "211О", "1600", "5"], ["Запасы", "x", "7", "6"]]) + table(1, [["нет", "1", "2", "3"]], 1)
    under = tables._under_years(spark.createDataFrame(rows, ROWS))
    assert [(r.row_no, r.label, r.row_code, r.source_row, r.title_unit) for r in under.orderBy("row_no").collect()] == [
        (2, "Выручка", "2110", "Выручка | 211О | 1600 | 5", "млн руб."), (3, "Запасы", None, None, "млн руб."),
    ]
    plan = tables.coded_readings(None, under=under)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_a_lost_year_makes_less_sure(spark):
    rows = reading(1, "pdf_table", 0.9, 10.0) + reading(2, "spreadsheet", 0.98, 5000.0, years=(2022,)) + reading(3, "pdf_table", 0.9, 7.0, key="cash")
    got = chain.built(spark.createDataFrame(rows, READ))
    metrics = entries(got.metrics)
    assert metrics["revenue"].confidence == 0.75 and metrics["revenue"].warnings == ["outlier_year_dropped"] and metrics["cash"].warnings == []
    assert {(r.metric_key, r.yr) for r in got.values.collect()} == {("revenue", 2024), ("revenue", 2023), ("cash", 2024), ("cash", 2023)}


def test_lineage_through_derivations_and_repairs(spark):
    amounts = {"noncurrent_assets": (60.0, 3), "current_assets": (40.0, 4), "assets": (150.0, 5), "equity": (50.0, 6), "longterm_liabilities": (20.0, 7), "current_liabilities": (30.0, 8)}
    rows = [r for i, (k, (v, page)) in enumerate(amounts.items()) for r in reading(i, "pdf_table", 0.9, v, key=k, page=page)]
    rows += reading(90, "pdf_table", 0.8, 10.0, key="revenue") + reading(91, "pdf_table", 0.9, 4.0, key="gross_profit", page=2) + reading(92, "pdf_table", 0.9, -1.0, key="commercial_expenses", page=1)
    rows += reading(93, "pdf_table", 0.9, 2.0, key="operating_profit", page=11)
    got = chain.built(spark.createDataFrame(rows, READ))
    metrics = entries(got.metrics)
    assert metrics["liabilities"].pages == [7, 8] and metrics["liabilities"].is_derived and metrics["liabilities"].formula.startswith("longterm")
    assert metrics["cogs"].pages == [2] and metrics["cogs"].confidence == 0.8 and [p.page for p in metrics["cogs"].provenance] == [2]
    assert metrics["administrative_expenses"].pages == [1, 2, 11]
    assets = metrics["assets"]
    assert (assets.source_type, assets.confidence, assets.is_reconciled) == ("reconciled_from_accounting_identity", 0.81, True)
    assert [(p.original_value, p.source_keys) for p in assets.provenance] == [(150.0, ["noncurrent_assets", "current_assets"])] * 2
    assert {(r.yr, r.val) for r in got.values.where("metric_key = 'assets'").collect()} == {(2024, 100.0), (2023, 100.0)}
    sheet = {(r.metric_key, r.ord): r for r in lineage.source_sheet(got.metrics).collect()}
    assert sheet["assets", 1].row == "noncurrent_assets + current_assets" and sheet["equity", 0].place == "6" and sheet["revenue", 0].place is None
    assert sheet["administrative_expenses", 2].method == "derived_from_verified_rows" and len([k for k in sheet if k[0] == "liabilities"]) == 2


def test_no_more_is_kept_than_models_read(spark):
    """Statements go once their rows are read, metrics once amounts and lineage are made of them."""
    import glob

    tables = lambda tag: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/{tag}-*"))
    before = {tag: tables(tag) for tag in ("metrics", "gated", "readings", "values", "derived")}
    got = chain.built(spark.createDataFrame(reading(1, "pdf_table", 0.9, 10.0), READ))
    assert {tag: len(tables(tag) - before[tag]) for tag in before} == {"metrics": 0, "gated": 0, "readings": 0, "values": 1, "derived": 1}
    assert got.values.count() == 2 and got.metrics.count() == 1


def test_empty_readings(spark):
    got = chain.built(spark.createDataFrame([], READ))
    assert got.values.count() == 0 and got.metrics.count() == 0
    assert tables.table_readings(spark.createDataFrame([], ROWS)).count() == 0
