"""Operator 8: token ids as Parquet list columns, for selective reads.

write_tokens() sorts documents by id over range partitions, encodes them and
writes one file set: ids as dictionary-coded lists, the counters delta-coded
(data page version 2), in row groups of a stated size with page indexes, so a
reader of a few ids or of the counters alone skips the rest. Beside the data lies
a small index: one row a part, with its number of ids and its id range.

Nulls and odd rows: a null text counts as empty and yields the end id alone; a
null doc_id sorts first; repeated rows are all kept, equal ids ordered by text;
an empty table gives empty files; other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, whole_text
from .word_tokens import chunk_ids

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1000
_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def _encoder(vocabulary: str, end_id: int):
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        table, part, start = chunk_ids(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            data = [table.encode(text) + end for text in batch.column(1).to_pylist()]
            counts = np.array([len(x) >> 2 for x in data], np.int64)
            ends = np.cumsum(counts)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(data), part, np.int32)), batch.column(0), pa.array(start + ends - counts), pa.array(counts), ids],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(counts.sum())

    return encode


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Writes path/data and path/index. docs: doc_id, text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    (
        rows.mapInArrow(_encoder(vocabulary, end_id), _SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd")
        .parquet(f"{path}/data")
    )
    data = spark.read.schema(_SCHEMA).parquet(f"{path}/data")
    # a row a part: reads only two columns
    data.groupBy("part").agg(
        F.sum("n_tokens").alias("part_tokens"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("largest_id")
    ).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; start counts the ids of all documents before it."""
    index = spark.read.schema("part int, part_tokens long, least_id long, largest_id long").parquet(f"{path}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a written part, so the window and the broadcast are as small as the list of files
    index = index.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    data = spark.read.schema(_SCHEMA).parquet(f"{path}/data")
    return data.join(F.broadcast(index), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _checksums(batches):
    for batch in batches:
        ids = batch.column(3)
        offsets, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the written files."""
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
