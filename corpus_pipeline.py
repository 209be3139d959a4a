"""A corpus pipeline over documents: each stage applies one operator and its decisions take effect.

quality drops what the classifier rejects, near_dedup keeps one document of each
group of near copies (0.8 of five-word shingles), secrets replaces what the scan
reports, packing places the pieces of what is left in sequences. An empty table gives
an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import credentials, near_copies, packing, quality
from ledgerloom.llm.common import documents, lasting, scratch, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score THRESHOLD or more, by a machine trained on the labels of sf_dir.

    Null and empty texts are scored like any text, repeated rows alike; all columns stay.
    """
    machine = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.above(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; of rows that repeat in id and text one stays, with all columns."""
    return near_copies.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, also repeated ones, with secrets replaced by a mark; a null text stays null."""
    return credentials.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]
#: SQL can express neither the trained model nor the near copies; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
        return lasting(STAGES[-1][1](spark, docs, sf_dir), "packed")
