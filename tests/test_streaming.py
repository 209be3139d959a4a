"""Status events: batches are written by the executors, the newest row of each document counts."""

import datetime
import os

from ledgerloom.streaming import ingest


def test_latest_status_over_batches(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    day = lambda n: datetime.datetime(2024, 1, n)
    batches = [
        [(1, day(1), 10, "open", 1.0, None), (2, day(2), 10, "view", 1.0, None), (3, day(1), 11, "open", 1.0, None)],
        [(4, day(3), 10, "close", 1.0, None), (5, day(1), 12, "open", 1.0, None)],
        [(6, day(2), 10, "late", 1.0, None)],
    ]
    os.mkdir(source)
    ingest.latest_status(spark, source, target, checkpoint).awaitTermination()
    assert ingest.status_rows(spark, target).count() == 0
    for rows in batches:
        spark.createDataFrame(rows, ingest.EVENTS).write.mode("append").parquet(source)
        ingest.latest_status(spark, source, target, checkpoint).awaitTermination()
    got = {r.doc_id: (r.status, r.updated_at.day, r.n_events) for r in ingest.status_rows(spark, target).collect()}
    assert got == {10: ("close", 3, 4), 11: ("open", 1, 1), 12: ("open", 1, 1)}
    sizes = {r.batch: r.n for r in spark.read.parquet(target).groupBy("batch").count().withColumnRenamed("count", "n").collect()}
    assert sorted(n for n in sizes.values() if n) == [1, 2, 2]


def test_a_document_in_three_files_over_two_batches(spark, tmp_path):
    """State holds what came before; a batch that is run again, or rows that come again, change nothing."""
    import glob

    from pyspark.sql import functions as F

    from ledgerloom.operators.model import gated, merged_values

    rows = [
        (doc, "ras", key, seq, source, confidence, unit, None, yr, 1000.0 * doc + seq + yr / 10)
        for doc in (1, 2, 3) for key in ("revenue", "cash") for seq, (source, confidence, unit) in
        enumerate([("pdf_table", 0.9, "тыс. руб."), ("spreadsheet", 0.8, "млн руб."), ("pdf_table", 0.9, None), ("pdf_text", 0.99, "тыс. руб."), ("spreadsheet", 0.8, "тыс. руб.")])
        for yr in (2023, 2024)
    ]
    everything = spark.createDataFrame(rows, ingest.CANDIDATES).withColumn("part", (F.col("seq") * 2 + F.col("yr")) % 3)
    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    shown = lambda df: sorted(map(tuple, df.select("doc_id", "branch", "metric_key", "yr", "val", "seq").collect()))
    add = lambda where: everything.where(where).drop("part").coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.ingest_statements(spark, source, target, checkpoint).awaitTermination()
    add("part = 0 AND doc_id < 3")
    add("part = 1")
    run()
    first = shown(ingest.model_rows(spark, target))
    assert first == shown(merged_values(gated(everything.where("part = 1 OR part = 0 AND doc_id < 3"))))
    add("part = 2 OR doc_id = 3")
    run()
    want = shown(merged_values(gated(everything)))
    assert shown(ingest.model_rows(spark, target)) == want != first
    batches = len(glob.glob(f"{target}/models/batch=*"))
    for name in ("1", ".1.crc"):  # as if the job had died before it was done
        os.remove(f"{checkpoint}/commits/{name}")
    run()
    assert shown(ingest.model_rows(spark, target)) == want and len(glob.glob(f"{target}/models/batch=*")) == batches
    add("part = 1")
    run()
    assert shown(ingest.model_rows(spark, target)) == want and len(glob.glob(f"{target}/models/batch=*")) == batches + 1


def test_a_batch_deals_its_readings_once(spark, tmp_path):
    """By document, for the join with those that came, for equal readings and for the models; the other shuffle is of their numbers."""
    from ledgerloom.operators.model import gated, merged_values

    plans = []

    def build(rows):
        found = merged_values(gated(rows, by=["doc_id"]))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    source, target, checkpoint = (str(tmp_path / name) for name in ("source", "target", "checkpoint"))
    row = (1, "ras", "revenue", 1, "pdf_table", 0.9, "тыс. руб.", None, 2024, 5.0)
    spark.createDataFrame([row, row], ingest.CANDIDATES).coalesce(1).write.parquet(source)
    ingest.ingest_statements(spark, source, target, checkpoint, build).awaitTermination()
    assert plans[-1].count("Exchange hashpartitioning") == plans[-1].count("Exchange hashpartitioning(doc_id") == 2
    assert [(r.yr, r.val) for r in ingest.model_rows(spark, target).collect()] == [(2024, 5.0)]
