"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import id_bucket, map_batches, slim
from tidewire.shared import materialize, shuffle_width

#: Parts of the digest space; a run is merged lane by lane, so no task ever holds a whole run.
LANES = 4096
KEY = ["digest", "check_bits", "n_bytes"]
DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_crc", pa.int64()),
        ("digest", pa.binary()),
        ("check_bits", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)
RUN = pa.schema(
    [
        ("lane", pa.int32()),
        ("run", pa.int32()),
        ("digest", pa.binary()),
        ("check_bits", pa.int64()),
        ("n_bytes", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
    ]
)
RUN_SQL = "lane int, run int, digest binary, check_bits long, n_bytes long, keep_id long, group_size long"


def normalise(text: bytes) -> bytes:
    """UTF-8 bytes with A-Z in lower case; other letters stay."""
    return text.lower()


def _digest(batch: pa.RecordBatch) -> dict:
    raw = batch.column("text").cast(pa.binary()).to_pylist()
    texts = [normalise(t) for t in raw]
    second = (hashlib.blake2b(t, digest_size=8).digest() for t in texts)
    return {
        "doc_id": batch.column("doc_id"),
        "text_crc": [zlib.crc32(t) for t in raw],
        "digest": [hashlib.sha256(t).digest() for t in texts],
        "check_bits": [int.from_bytes(d, "little", signed=True) for d in second],
        "n_bytes": [len(t) for t in texts],
    }


def digests(docs: DataFrame, runs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_crc, digest, check_bits, n_bytes, lane, run)``, one row per document.

    The digest is verified by a second, independent hash and the length: rows match on all three only.
    """
    rows = slim(docs, id_col, text_col).mapInArrow(
        map_batches(_digest, DIGESTS), "doc_id long, text_crc long, digest binary, check_bits long, n_bytes long"
    )
    # Rows are dealt to runs by their place: copies without an id, or with one id, spread like any others.
    run = id_bucket(F.monotonically_increasing_id(), runs)
    return rows.withColumn("lane", id_bucket(F.col("digest"), LANES)).withColumn("run", run)


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (lane, run, key, better id first), one row per key with the first id and the summed size.

    Only the key last seen is held over from batch to batch.
    """
    held = None
    for batch in batches:
        out = []
        for *key, keep, size in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None and held[0] == key:
                held[2] += size
            else:
                if held is not None:
                    out.append((*held[0], held[1], held[2]))
                held = [key, keep, size]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RUN.types)], schema=RUN)
    if held is not None:
        row = (*held[0], held[1], held[2])
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, RUN.types)], schema=RUN)


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int, keep: str) -> DataFrame:
    """Merge ``n_runs`` runs into one, ``fan_in`` at a time, in rounds.

    Run ``i`` of a round joins run ``i // fan_in`` of the next one. The rows of a lane of the joined runs
    meet in one task, which reads them in sorted order and keeps the better identifier of equal digests,
    so a digest has at most ``fan_in`` rows there however often its text occurs.
    """
    width = shuffle_width(runs.sparkSession)
    best = F.col("keep_id").desc_nulls_last() if keep == "largest" else F.col("keep_id").asc_nulls_last()
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .repartition(width, "lane", "run")
            .sortWithinPartitions("lane", "run", *KEY, best)
            .select(RUN.names)
            .mapInArrow(merge_sorted, RUN_SQL)
        )
    return runs


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "largest",
    runs: int = 64,
    fan_in: int = 4,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are, after A-Z are lower-cased; null counts as empty. Of equal
    texts the row with the largest (or smallest) id stays. Rows that repeat an id are rows of the group like
    any other and get the same flag. A null id stays only where no row of its group has an id. An empty
    table gives an empty table; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, keep, runs, fan_in).drop("text_crc")


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int = 64, fan_in: int = 4) -> DataFrame:
    """As :func:`exact_groups`, with the CRC-32 of each row's own text, which tells rows without an id apart."""
    rows = materialize(digests(docs, runs, id_col, text_col), "digests")
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    first = rows.groupBy("lane", "run", *KEY).agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first = materialize(first, "runs")
    final = tree_merge(first, runs, fan_in, keep).drop("lane", "run")
    # Back down the tree: a run has one row per digest, so a text that fills a third of the table is spread.
    told = first.select("run", *KEY).join(final, KEY)
    told = materialize(told, "kept")
    out = rows.join(told, ["run", *KEY])
    return out.select(
        "doc_id",
        "text_crc",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The documents without their copies, all columns kept; of rows that repeat an id with one text, one stays."""
    kept = _grouped(docs, id_col, text_col, keep).where("kept")
    return rows_of(docs, kept, id_col, text_col)


def rows_of(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents named in ``kept(doc_id, text_crc)``, each once though rows of it may be repeated."""
    kept = kept.groupBy(F.col("doc_id").alias("_kept_id"), F.col("text_crc").alias("_kept_crc"))
    kept = materialize(kept.agg(F.count(F.lit(1)).alias("_rows")), "kept-ids")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (crc == F.col("_kept_crc"))
    once, again = kept.where("_rows = 1"), kept.where("_rows > 1")
    if again.isEmpty():
        return docs.join(once, same, "left_semi")
    return docs.join(once, same, "left_semi").unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
