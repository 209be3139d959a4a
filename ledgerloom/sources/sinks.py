"""What results are written as: one export layout, JSON, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(facts: DataFrame, ratios: DataFrame, operational: DataFrame | None = None) -> DataFrame:
    """Facts, operational figures and ratios in one layout: doc_id, section, key, yr, value, status, display."""
    none = F.lit(None).cast("string")
    parts = [
        facts.select("doc_id", F.lit("financial").alias("section"), F.col("metric_key").alias("key"), "yr", F.col("val").alias("value"), none.alias("status"), none.alias("display")),
        ratios.select("doc_id", F.lit("ratio").alias("section"), F.col("ratio_key").alias("key"), F.col("cur_year").alias("yr"), "value", "status", "display"),
    ]
    if operational is not None:
        parts.append(operational.select("doc_id", F.lit("operational").alias("section"), F.col("name").alias("key"), "yr", F.col("val").alias("value"), none.alias("status"), none.alias("display")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """Semicolon-separated, with a header; Spark writes a file a partition."""
    rows.write.mode("overwrite").csv(path, sep=";", header=True, encoding="UTF-8")


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """One JSON object a line, in a folder for each value of by."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def as_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the whole row as JSON text."""
    return rows.select(key, F.to_json(F.struct("*")).alias("json"))


def provenance_rows(metrics: DataFrame) -> DataFrame:
    """The source sheet: a row for each entry of the provenance array, with the metric's own fields where it has none."""
    one = metrics.select("doc_id", "metric_key", "confidence", "row_code", "source_type", F.explode_outer("provenance").alias("p"))
    return one.select("doc_id", "metric_key", F.coalesce("p.row_code", "row_code").alias("row_code"),
                      F.coalesce("p.extraction_method", "source_type").alias("method"), F.coalesce("p.confidence", "confidence").alias("confidence"))


def model_sheet(values: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """The wide sheet: a row a document, branch and metric, a column y<year> for each year in the data, then the metric's own columns.

    values: doc_id, metric_key, yr, val, and branch where there are several; metrics: the same keys and what is to stand
    beside the amounts. Years are looked up first; they are as many as the calendar has, whatever the table's size.
    """
    keys = [k for k in ("doc_id", "branch", "metric_key") if k in values.columns]
    years = sorted(r.yr for r in values.select("yr").distinct().where("yr BETWEEN 1900 AND 2099").collect())
    wide = values.groupBy(*keys).pivot("yr", years).agg(F.max("val"))
    sheet = wide.select(*keys, *[F.col(str(y)).alias(f"y{y}") for y in years])
    return sheet.join(metrics, keys, "left") if metrics is not None else sheet
