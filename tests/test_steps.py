"""Steps that must not work out an expression again for each place that names it."""

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.scalars import normalize_label, text_pair
from ledgerloom.operators import text_jobs as J


def _plan(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_normalised_once_for_all_needles(spark):
    rows = spark.createDataFrame([("Бухгалтерский  баланс",), (None,), ("none",)], "text string")
    said = rows.select(T.holds_any(normalize_label(F.col("text")), ["баланс", "отчет"]).alias("x"))
    # the lambda over the needles gets the label as a variable
    assert "lower" not in _plan(said).split("exists(")[1]
    assert [r.x for r in said.collect()] == [True, None, False]
    assert _plan(rows.select(J.first_category(F.col("text"), J.PAGE_KINDS).alias("k"))).count("lower(") == 1


def test_a_line_is_cut_into_amounts_once(spark):
    rows = spark.createDataFrame([("Запасы 5 1 234 1 235",), ("Выручка (10) (12)",), ("3, 4 — Капитал 7 2024 8",), ("нет",), (None,)], "line string")
    pairs = rows.select(text_pair(F.col("line")).alias("p"))
    assert _plan(pairs).count("regexp_extract_all") == 2
    assert [tuple(r.p) if r.p else None for r in pairs.collect()][1:] == [(-10.0, -12.0), (7.0, 8.0), None, None]


def test_filters_run_on_all_cores(spark, data):
    from ledgerloom.plans.fixtures import spread, table

    rows = spread(table(spark, data, "orders")).where(F.length(F.col("o_orderkey").cast("string")) > 1)
    assert "Repartition" not in _plan(rows)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_scores_are_rounded_by_tenths(spark):
    """12 of 25 tokens have three letters: 6.25 and 21.6 are 27.85, whose nearest double lies below."""
    rows = spark.createDataFrame([(" ".join(["abc"] * 12 + ["ab"] * 13),)], "text string")
    assert J.quality_scores(rows.withColumn("mean_confidence", F.lit(80.0))).first().native == 27.9


def test_ingestion_holds_no_readings_in_state(spark, tmp_path):
    from ledgerloom.streaming import ingest

    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    row = (1, "ras", "revenue", 1, "pdf_table", 0.9, "тыс. руб.", None, 2024, 5.0)
    spark.createDataFrame([row, row], ingest.CANDIDATES).coalesce(1).write.parquet(source)
    ingest.ingest_statements(spark, source, target, checkpoint).awaitTermination()
    assert not (tmp_path / "checkpoint" / "state").exists()
    assert [(r.yr, r.val) for r in ingest.model_rows(spark, target).collect()] == [(2024, 5.0)]


def test_lines_and_their_amounts_are_not_broadcast(spark, data):
    """Both sides of these joins grow with the pages, though words exploded out of few rows are taken for few."""
    from ledgerloom.plans.form_queries import ifrs_section_totals

    plan = ifrs_section_totals(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 3
