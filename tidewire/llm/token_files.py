"""Token ids in ORC files: sorted by document, with row indexes and Bloom filters, and read back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewire.llm.common import ENCODED_ROWS, map_batches, slim
from tidewire.llm.packing import json_encoder
from tidewire.shared import materialize, shuffle_width

#: Bytes of the texts that a file holds the ids of.
FILE_BYTES = 128 << 20
#: Bytes of a stripe, rows between two index entries, and the Bloom filter's share of false hits.
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 8 << 20, 1000, 0.01
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text and the end id, in the rows' order."""

    def run(batch: pa.RecordBatch) -> dict:
        end = np.array([end_id], "<u4").tobytes()
        ids = [i + end for i in json_encoder(tokenizer_path)(batch.column("text"))]
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        flat = np.frombuffer(b"".join(ids), "<i4")
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}

    return slim(docs, id_col, text_col).mapInArrow(map_batches(run, TOKENS, ENCODED_ROWS), "doc_id long, ids array<int>")


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write ``(doc_id, ids)`` as ORC in ascending document order: file by file, and within each file.

    Documents are dealt by ranges of their id, so every file covers a range; there are as many files as the
    texts fill, one per task of a shuffle at least. Integers are run-length encoded
    by the format; each stripe has a row index and a Bloom filter on ``doc_id``, so a reader of one document
    or a range skips the rest, and stripes are read in parallel. Null ids come first; rows without an id, or that repeat one,
    follow each other by a hash and may fill several files. An empty table gives files without rows.
    """
    rows = slim(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    files = max(shuffle_width(docs.sparkSession), -(-size // FILE_BYTES))
    tie = F.xxhash64("text", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "text", tie.alias("tie")).repartitionByRange(files, "doc_id", "tie")
    rows = token_rows(rows.sortWithinPartitions("doc_id", "tie"), tokenizer_path, end_id)
    (
        rows.write.option("orc.compress", "SNAPPY")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, ids)`` of files that :func:`write_tokens` wrote; filters on ``doc_id`` reach the stripes."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


FACTS = pa.schema(
    [("file", pa.string()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it: within its file by a window over that file's rows,
    and before its file by the totals of the files, of which there is one row each.
    """

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column("ids")
        flat = lists.values.to_numpy().astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        return {
            "file": batch.column("file"),
            "doc_id": batch.column("doc_id"),
            "n_tokens": np.diff(ends),
            "ids_crc32": [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])],
        }

    read = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    facts = read.mapInArrow(map_batches(run, FACTS), "file string, doc_id long, n_tokens long, ids_crc32 long")
    facts = materialize(facts, "token-facts")
    files = facts.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("first"))
    # One row per file of FILE_BYTES: some hundred thousand rows for 100 TB. Files of one id follow in the order of their names.
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = facts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(files, "file").select(
        "doc_id", (F.col("skipped") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
