"""Vector codes: parts of vectors as numbers of codebook entries, by dictionaries of each dimension's distinct values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewire.llm.common import join_counted
from tidewire.shared import materialize

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Steps of a component's grid in one unit; components beyond the largest integer count as that one.
SCALE, LARGEST = 4096, 1 << 62
LONG_MAX = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, embedding, label)`` of the rows whose vector is there and has no null or non-finite component."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))


def grid(lists: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of integers on the grid, all of ``width``; shorter ones end in zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


def dictionary_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of rows: their ids and labels, each dimension's distinct integers in order, and every row's place among these.

    A block is an Arrow batch, so it is bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch`` and its places
    fit into 32 bits. Every round works on these blocks, not on the vectors.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType().add("ids", T.ArrayType(kinds["vec_id"])).add("labels", T.ArrayType(kinds["label"]))
    schema = schema.add("values", T.ArrayType(T.ArrayType(T.LongType()))).add("places", T.BinaryType())

    def one(column: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = [np.unique(column, return_inverse=True) for column in grid(batch.column("embedding"), width).T]
                places = np.array([c[1] for c in coded], "<u4").tobytes()
                values = pa.array([[c[0] for c in coded]], pa.list_(pa.list_(pa.int64())))
                parts = [one(batch.column("vec_id")), one(batch.column("label")), values, pa.array([places], pa.binary())]
                yield pa.RecordBatch.from_arrays(parts, names=["ids", "labels", "values", "places"])

    return rows.mapInArrow(run, schema)


class Block:
    """One block's dictionaries, and the places of its rows in them."""

    def __init__(self, values: list[list[int]], places: bytes):
        self.values = [np.array(v, np.int64) for v in values]
        self.places = np.frombuffer(places, "<u4").reshape(len(values), -1)
        self.largest = max((max(-int(v[0]), int(v[-1])) for v in self.values), default=0)

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry in each part, the lower one of equals, and the squared distance: both (parts, rows).

        The squared differences of a dimension's distinct integers to all entries make a table; a row's distance is
        the sum of what its places name there. Where 64 bits can't hold such a sum, Python's integers do.
        """
        parts, _, part = books.shape
        wide = part * (self.largest + int(max(-books.min(), books.max()))) ** 2 > LONG_MAX
        kind = object if wide else np.int64
        at, distance = [], []
        for p in range(parts):
            total = np.zeros((self.places.shape[1], books.shape[1]), kind)
            for k in range(part):
                d = p * part + k
                table = (self.values[d].astype(kind)[:, None] - books[p, :, k].astype(kind)[None, :]) ** 2
                total += table[self.places[d]]
            at.append(total.argmin(axis=1))
            distance.append(total[np.arange(len(total)), at[-1]])
        return np.array(at), np.array(distance)

    def sums(self, at: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry the sum of the rows assigned to it, as Python's integers, and their number."""
        parts, part = len(at), len(self.values) // len(at)
        count = np.array([np.bincount(a, minlength=entries) for a in at])
        total = np.zeros((parts, entries, part), object)
        for p in range(parts):
            for k in range(part):
                d = p * part + k
                n = len(self.values[d])
                seen = np.bincount(at[p] * n + self.places[d], minlength=entries * n).reshape(entries, n)
                wide = self.largest * max(1, self.places.shape[1]) > LONG_MAX
                total[p, :, k] = seen.astype(object if wide else np.int64) @ self.values[d].astype(object if wide else np.int64)
        return total, count


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            yield Block(one.column("values").to_pylist()[0], one.column("places")[0].as_py()), one


SUMS = pa.schema(
    [("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())]
)


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign every part, then put the floor of its parts' mean in each entry's place; unused entries stay.

    A task adds up its blocks, Spark adds up the tasks; the driver gets one number per component of the codebooks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for block, _ in blocks_of(batches):
            t, c = block.sums(block.nearest(books)[0], books.shape[1])
            total, count = total + t, count + c
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = np.flatnonzero(count[part, entry])
        columns = [part[used], entry[used], place[used], total.ravel()[used].tolist(), count[part, entry][used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUMS)], schema=SUMS)

    sums = blocks.mapInArrow(run, "part int, entry int, place int, total decimal(38,0), n long")
    sums = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def first_books(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks ``(parts, entries, components)`` of the vectors with the smallest ids; fewer rows give fewer entries."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    vectors = grid(pa.array([[float(x) for x in r["embedding"]] for r in first], pa.list_(pa.float64())), width)
    return vectors.reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()


def fit_books(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        after = next_books(blocks, books)
        if (after == books).all():
            break
        books = after
    return books


def assign_codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``(vec_id, label, code, error)`` of every row of the blocks: two hex digits per part, and the distances' sum.

    An error beyond 64 bits counts as the largest such number.
    """
    kinds = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name in ("ids", "labels")}
    schema = T.StructType().add("vec_id", kinds["ids"]).add("label", kinds["labels"]).add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, one in blocks_of(batches):
            at, distance = block.nearest(books)
            codes = [c.tobytes().hex() for c in at.T.astype(np.uint8)]
            errors = [min(int(e), LONG_MAX) for e in distance.astype(object).sum(axis=0)]
            columns = [one.column("ids").flatten(), one.column("labels").flatten(), pa.array(codes), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.mapInArrow(run, schema)


def decode_vector(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for, in grid units divided by their number in one."""
    at = np.frombuffer(bytes.fromhex(code), np.uint8)
    return books[np.arange(len(books)), at].ravel().astype(np.float64) / SCALE


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row.

    Vectors of different lengths, or of one that the parts don't divide, end in zeros up to the least common width
    that they do. Rows without an id come last among the codebooks' first entries and have codes like others; repeated
    rows count each. Without a usable row the result is empty. ``label_error`` sums the errors of a label, null ones
    together, up to the largest 64-bit number; a label with a large share of all rows is added up before it is shuffled and joined by broadcast.
    """
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    if longest is None:
        kind = rows.schema["vec_id"].dataType
        schema = T.StructType().add("vec_id", kind).add("code", "string").add("error", "long").add("label_error", "long")
        return spark.createDataFrame([], schema.add("codebooks_sha256", "string"))
    width = max(1, -(-longest // PARTS)) * PARTS
    blocks = materialize(dictionary_blocks(rows, width), "vector-blocks")
    books = fit_books(blocks, first_books(rows, width))
    coded = materialize(assign_codes(blocks, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    labels = coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows"))
    out = join_counted(coded, labels, "label", "rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
