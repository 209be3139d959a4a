"""Year-on-year changes, latest values, movers and the event registry: windows and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_label, percent_change

#: Stems of operational names; a rise of the first kind is bad, of the second good. Fixed values.
WORSE_WHEN_HIGHER = ["выброс", "травм", "пострадав", "леталь", "сжиган", "загрязнен", "авар", "отход", "потер", "расход воды"]
BETTER_WHEN_HIGHER = ["добыч", "переработ", "производ", "реализац", "продаж", "запас", "мощност", "выработ", "экономия", "поступлен"]


def trends(facts: DataFrame) -> DataFrame:
    """Changes between consecutive years that a metric has; percent_change is null from zero."""
    years = Window.partitionBy("doc_id", "metric_key").orderBy("yr")
    pairs = facts.select("doc_id", "metric_key", F.lag("yr").over(years).alias("from_year"), F.col("yr").alias("to_year"),
                         F.lag("val").over(years).alias("from_value"), F.col("val").alias("to_value"))
    change = F.col("to_value") - F.col("from_value")
    return pairs.where("from_year IS NOT NULL").withColumns(
        {"absolute_change": change, "percent_change": percent_change(F.col("to_value"), F.col("from_value"))}
    )


def latest_values(facts: DataFrame) -> DataFrame:
    """The value of each metric in its own latest year."""
    return facts.groupBy("doc_id", "metric_key").agg(F.max("yr").alias("yr"), F.max_by("val", "yr").alias("val"))


def latest_changes(facts: DataFrame) -> DataFrame:
    """The last change of each metric: trends() at its latest to_year."""
    last = Window.partitionBy("doc_id", "metric_key").orderBy(F.col("to_year").desc())
    return trends(facts).withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def direction(name: Column, change: Column, worse: list[str] = WORSE_WHEN_HIGHER, better: list[str] = BETTER_WHEN_HIGHER) -> Column:
    """strength, weakness or neutral, by what a rise of the named figure means."""
    label = normalize_label(name)
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: label.contains(w))
    rises = F.when(says(worse), change < 0).when(says(better), change > 0)
    return F.when(rises.isNull(), "neutral").when(rises, "strength").otherwise("weakness")


def top_movers(facts: DataFrame, limit: int = 8, **words) -> DataFrame:
    """Of each document the figures that changed most, at least by 1 %, with their direction and rank."""
    moved = latest_changes(facts).where(F.abs("percent_change") >= 1)
    order = Window.partitionBy("doc_id").orderBy(F.abs("percent_change").desc(), "metric_key")
    ranked = moved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.withColumn("direction", direction(F.col("metric_key"), F.col("percent_change"), **words))


def registry_latest(events: DataFrame) -> DataFrame:
    """The newest status of each document; of events at one time the one of greatest id."""
    newest = F.max_by(F.struct("event_type", "ts", "event_id", "value"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("user_id").agg(newest, F.count("*").alias("n_events")).select(
        F.col("user_id").alias("doc_id"), F.col("e.event_type").alias("status"), F.col("e.ts").alias("updated_at"), "n_events"
    )


def registry_page(events: DataFrame, limit: int) -> DataFrame:
    """The documents that changed last, newest first; limit is held within 1 and 500."""
    return registry_latest(events).orderBy(F.col("updated_at").desc(), "doc_id").limit(max(1, min(500, limit)))


def registry_without(events: DataFrame, deleted: DataFrame) -> DataFrame:
    """Latest states of documents that have no tombstone."""
    return registry_latest(events).join(deleted.select("doc_id"), "doc_id", "left_anti")
