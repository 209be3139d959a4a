"""Continuous ingestion: statement files to models, status events to a latest state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.model import gated, merged_values

CANDIDATES = "doc_id long, branch string, metric_key string, seq long, source_type string, confidence double, unit string, row_code string, yr int, val double"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
STATUS = "doc_id long, status string, updated_at timestamp, n_events long"


def ingest_statements(spark: SparkSession, source: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """New candidate files become models of their documents; model_rows reads the newest of each.

    What has come is kept in files, a folder of readings a batch. A batch writes its own readings, then
    the models of the documents that they are of, out of all readings of these so far, equal ones once.
    So a document may come in any number of files and batches, rows that come again change nothing, and
    no memory holds more than a task's share of a join, however many readings there are. A batch that is run
    again overwrites its own folders. Order plays no part: where readings are equally good, seq decides,
    which belongs to the reading. Each batch reads the folders of those before it, and deals their readings
    by document once: for the join with the documents that came, for equal ones and for the models.
    """
    build = build or (lambda rows: merged_values(gated(rows, by=["doc_id"])))
    stream = spark.readStream.schema(CANDIDATES).parquet(source).where("doc_id IS NOT NULL")

    def write(arrived: DataFrame, batch: int) -> None:
        arrived.write.mode("overwrite").parquet(f"{target}/readings/batch={batch}")
        known = spark.read.schema(f"{CANDIDATES}, batch long").parquet(f"{target}/readings").where(F.col("batch") <= batch)
        changed = spark.read.schema(CANDIDATES).parquet(f"{target}/readings/batch={batch}").select("doc_id").distinct()
        whole = known.drop("batch").repartition("doc_id").join(changed, "doc_id", "left_semi").distinct()
        build(whole).write.mode("overwrite").parquet(f"{target}/models/batch={batch}")

    empty = spark.createDataFrame([], CANDIDATES)
    empty.write.mode("overwrite").parquet(f"{target}/readings/batch=-1")
    build(empty).write.mode("overwrite").parquet(f"{target}/models/batch=-1")
    return stream_once(stream, write, checkpoint)


def stream_once(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that has come, a batch after another, and ends."""
    writer = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def model_rows(spark: SparkSession, target: str) -> DataFrame:
    """The newest model of each document that ingest_statements wrote; a document without one has no rows."""
    newest = spark.read.schema("doc_id long, batch long").parquet(f"{target}/readings").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{target}/models").join(newest, ["doc_id", "batch"]).drop("batch")


def latest_status(spark: SparkSession, source: str, target: str, checkpoint: str, watermark: str | None = None) -> StreamingQuery:
    """The newest status of each document that a batch of events changed, one folder a batch; status_rows reads them.

    A batch that is run again overwrites its own folder. State holds one row a document. With a watermark,
    events that late or later are left out.
    """
    events = spark.readStream.schema(EVENTS).parquet(source)
    events = events.withWatermark("ts", watermark) if watermark else events
    newest = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    state = events.groupBy(F.col("user_id").alias("doc_id")).agg(newest.alias("e"), F.count("*").alias("n_events"))
    rows = state.select("doc_id", F.col("e.event_type").alias("status"), F.col("e.ts").alias("updated_at"), "n_events")

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    # so that the folder can be read where no event came
    write(spark.createDataFrame([], STATUS), -1)
    return stream_once(rows, write, checkpoint)


def status_rows(spark: SparkSession, target: str) -> DataFrame:
    """The newest status of each document, from the folders that latest_status wrote."""
    rows = spark.read.schema(f"{STATUS}, batch long").parquet(target)
    newest = rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "updated_at", "n_events"), "batch").alias("e"))
    return newest.select("doc_id", "e.status", "e.updated_at", "e.n_events")
