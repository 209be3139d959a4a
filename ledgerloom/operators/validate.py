"""Row checks, balance identities, model status, branch scores and the choice of a branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TRUSTED_SOURCES
from .model import BALANCE, KEYS, agree

#: Metrics that a statement is expected to have. Fixed values.
CORE = ["assets", "equity", "current_assets", "current_liabilities", "revenue", "net_profit", "operating_cash_flow"]


def row_checks(metrics: DataFrame) -> DataFrame:
    """metrics (KEYS, source_type, confidence, largest): issues and status (valid or invalid)."""
    source, sure = F.coalesce("source_type", F.lit("")), F.coalesce("confidence", F.lit(0.0))
    read_badly = source.endswith("ocr") & (sure < 0.72)
    found = F.array_compact(F.array(
        F.when(F.col("largest").isNull(), "no_values"), F.when(read_badly, "low_ocr_confidence"),
        F.when(~read_badly & (sure < 0.55) & ~source.isin(*TRUSTED_SOURCES), "low_confidence"),
        F.when(F.col("largest") > 1e15, "implausible_magnitude"),
    ))
    return metrics.withColumn("issues", found).withColumn("status", F.when(F.size("issues") > 0, "invalid").otherwise("valid"))


def identity_checks(values: DataFrame) -> DataFrame:
    """Two balance identities a year: passed, failed or not_tested, with both sides and their difference.

    Liabilities as one line stand for long-term and current ones where a model lacks either in all years.
    """
    used = [*BALANCE, "liabilities"]
    at = lambda k: F.max(F.when(F.col("metric_key") == k, F.col("val")))
    wide = values.groupBy("doc_id", "branch", "yr").agg(*[at(k).alias(k) for k in used])
    doc = Window.partitionBy("doc_id", "branch")
    has = lambda k: F.max(F.col(k).isNotNull()).over(doc)
    wide = wide.withColumn("whole", has("liabilities") & ~(has("longterm_liabilities") & has("current_liabilities")))
    short = F.col("equity") + F.col("liabilities")
    split = F.col("equity") + F.col("longterm_liabilities") + F.col("current_liabilities")
    check = lambda name, side: F.struct(name.alias("check_name"), side.alias("right_side"))
    checks = F.array(
        check(F.lit("assets_equals_sections"), F.col("noncurrent_assets") + F.col("current_assets")),
        check(F.when(F.col("whole"), "assets_equals_equity_and_total_liabilities").otherwise("assets_equals_equity_and_liabilities"), F.when(F.col("whole"), short).otherwise(split)),
    )
    one = wide.select("doc_id", "branch", "yr", F.col("assets").alias("left_side"), F.explode(checks).alias("c")).select("doc_id", "branch", "yr", "c.*", "left_side")
    tested = F.col("left_side").isNotNull() & F.col("right_side").isNotNull()
    status = F.when(~tested, "not_tested").when(agree(F.col("left_side"), F.col("right_side")), "passed").otherwise("failed")
    return one.withColumns({"status": status, "delta": F.abs(F.col("left_side") - F.col("right_side"))})


#: Members of each identity.
MEMBERS = {
    "assets_equals_sections": ["assets", "noncurrent_assets", "current_assets"],
    "assets_equals_equity_and_total_liabilities": ["assets", "equity", "liabilities"],
    "assets_equals_equity_and_liabilities": ["assets", "equity", "longterm_liabilities", "current_liabilities"],
}


def validated(metrics: DataFrame, checks: DataFrame) -> DataFrame:
    """Row checks, then a warning for valid members of failed identities; adds n_failed."""
    pairs = [F.struct(F.lit(c).alias("check_name"), F.lit(k).alias("metric_key")) for c, keys in MEMBERS.items() for k in keys]
    failed = checks.where("status = 'failed'").select("doc_id", "branch", "check_name", F.explode(F.array(*pairs)).alias("m"))
    failed = failed.where("check_name = m.check_name").groupBy("doc_id", "branch", F.col("m.metric_key").alias("metric_key")).agg(F.count("*").alias("n_failed"))
    joined = row_checks(metrics).join(failed, KEYS, "left").withColumn("n_failed", F.coalesce("n_failed", F.lit(0).cast("long")))
    return joined.withColumn("status", F.when((F.col("status") == "valid") & (F.col("n_failed") > 0), "warning").otherwise(F.col("status")))


def roll_up(checks: DataFrame) -> DataFrame:
    """One row a model: failed, passed or partial, with counts."""
    count = lambda s: F.count_if(F.col("status") == s)
    counted = checks.groupBy("doc_id", "branch").agg(count("passed").alias("n_passed"), count("failed").alias("n_failed"), count("not_tested").alias("n_not_tested"))
    return counted.withColumn("validation", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_passed") > 0, "passed").otherwise("partial"))


def branch_scores(metrics: DataFrame, rolled: DataFrame) -> DataFrame:
    """metrics (as validated() gives them) to one row a branch: score and whether it is reliable."""
    valid = metrics.where("status IN ('valid', 'warning')")
    primary = F.col("source_type").startswith("ras_") | F.col("source_type").startswith("ifrs_primary")
    counted = valid.groupBy("doc_id", "branch").agg(
        F.count("*").alias("n_valid"), F.count_if(F.col("metric_key").isin(*CORE)).alias("n_core"),
        F.count_if(F.col("row_code").isNotNull()).alias("n_coded"), F.count_if(primary).alias("n_primary"),
    )
    joined = counted.join(rolled.select("doc_id", "branch", "n_passed", "n_failed"), ["doc_id", "branch"], "left").fillna(0, ["n_passed", "n_failed"])
    coded = F.when(F.col("branch") == "ras", 2 * F.col("n_coded")).otherwise(F.lit(0))
    score = 3 * F.col("n_valid") + 12 * F.col("n_core") + 8 * F.col("n_passed") + coded + F.col("n_primary") - 35 * F.col("n_failed")
    return joined.withColumns({"score": score, "reliable": (F.col("n_valid") >= 8) & (F.col("n_core") >= 3) & (F.col("n_failed") == 0)})


def branch_choice(scores: DataFrame) -> DataFrame:
    """The reliable branch of best score, ras before ifrs on ties; generic where none is reliable."""
    rank = F.struct("score", F.when(F.col("branch") == "ras", 1).otherwise(0))
    best = F.max_by("branch", F.when(F.col("reliable") & F.col("branch").isin("ras", "ifrs"), rank))
    return scores.groupBy("doc_id").agg(F.coalesce(best, F.lit("generic")).alias("branch"))


def coverage(metrics: DataFrame, core: list[str] = CORE) -> DataFrame:
    """How many metrics a document has, and which core ones are found and missing."""
    keys = F.array_sort(F.collect_set("metric_key"))
    counted = metrics.groupBy("doc_id").agg(keys.alias("keys"))
    wanted = F.array(*map(F.lit, sorted(core)))
    return counted.select("doc_id", F.size("keys").alias("n_metrics"), F.array_join(F.array_intersect("keys", wanted), ",").alias("found"),
                          F.array_join(F.array_except(wanted, "keys"), ",").alias("missing"))
