"""Small helpers that several operators share."""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.shared import materialize


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` (null: empty), whatever else the table carries."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


#: Rows of a batch are worked on so many at a time, so that the texts held as Python strings stay few.
ROWS_AT_ONCE = 1000


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda computes an expression anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_batches(fn: Callable[[pa.RecordBatch], dict], schema: pa.Schema, rows: int = ROWS_AT_ONCE) -> Callable:
    """A ``mapInArrow`` function from one that turns up to ``rows`` rows of a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(start, rows)), schema=schema)

    return run


#: Rows of a batch for the encoders, which hold texts as Arrow does and bound their bytes themselves.
ENCODED_ROWS = 10_000


def join_counted(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row per ``key`` (null is a key) with the number of its rows in ``count``.

    A key with more than a 4,096th of all rows is hot; there are fewer than 4,096 of these, so they are broadcast. The
    others meet by a shuffle, in which rows of hot keys are spread evenly.
    """
    facts = materialize(facts, "facts")
    n = facts.agg(F.sum(count).alias("n")).first()["n"] or 0
    others = [c for c in facts.columns if c not in (key, count)]
    hot, cold = (facts.where(w) for w in (F.col(count) * 4096 > n, F.col(count) * 4096 <= n))
    side = lambda df, mark: df.select(F.col(key).alias(f"_{mark}"), F.struct(*others).alias(f"_{mark}_facts"))
    rows = rows.join(F.broadcast(side(hot, "hot")), F.col(key).eqNullSafe(F.col("_hot")), "left")
    spread = 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(65_536))
    rows = rows.withColumn("_spread", F.when(F.col("_hot_facts").isNull(), F.lit(0).cast("long")).otherwise(spread))
    cold = side(cold, "cold").withColumn("_none", F.lit(0).cast("long"))
    rows = rows.join(cold, F.col(key).eqNullSafe(F.col("_cold")) & (F.col("_spread") == F.col("_none")), "left")
    found = F.coalesce("_hot_facts", "_cold_facts")
    rows = rows.withColumn("_found", found).drop("_hot", "_hot_facts", "_cold", "_cold_facts", "_spread", "_none")
    return rows.select("*", *[F.col("_found")[c].alias(c) for c in others]).drop("_found")


def id_bucket(col: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(buckets)).cast("int")


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return PACKERS[len(ids)].pack(*ids) if len(ids) < len(PACKERS) else struct.pack(f"<{len(ids)}I", *ids)


PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


#: Words and other chunks whose ids a worker remembers; the table starts afresh when it is full.
REMEMBERED = 500_000
#: Any white space; and where it is followed by a blank or newline, or a mark of ours stands in the text.
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD_TEXT = f"[{WHITE}][ \n]|\\x00"
BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \n])")
NOTHING = pa.scalar(b"", pa.large_binary())


class ChunkEncoder:
    """Encodes texts by space-led chunks whose ids are remembered.

    A chunk starts at a blank or newline after a character that is no white space. The pattern of the
    byte-level vocabularies, like one that drops white space, makes no piece across such a place, so the ids of a
    text are the ids of its chunks in order. ``pieces`` splits a chunk into what the tokenizer encodes one by one,
    ``encode`` gives the ids of many pieces, each as little-endian unsigned 32-bit bytes; it gets the new pieces of
    a group of texts at once. ``normal`` is applied to a chunk before it is split.

    Chunks are found and numbered by Arrow, so that Python sees each different chunk of a group of texts once.
    """

    def __init__(
        self,
        pieces: Callable[[str], list[str]],
        encode: Callable[[list[str]], list[bytes]],
        normal: Callable[[str], str] | None = None,
    ):
        self.pieces, self.encode, self.normal = pieces, encode, normal
        self.known: dict[str, bytes] = {}
        # What the pattern makes of a word of letters behind a blank, one piece with the blank or one without it; and
        # the marks that it parts from the word before them.
        trials = ["ab", "aB", "ABc", "\u00e9a"]
        leads = [lead for lead in (" ", "") if all(pieces(f" {w}.") == [lead + w, "."] for w in trials)]
        self.lead = leads[0] if leads else None
        marks = [m for m in ".,;:!?" if leads and pieces(f" ab{m}") == [f"{self.lead}ab", m]]
        # Letters whose normal form is no letters only: the pattern may join a mark to a word with one.
        self.unstable = ""
        if normal is not None:
            letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
            forms = dict(zip(letters, normal(" ".join(letters)).split(" "), strict=True))
            self.unstable = "".join(rf"\x{{{ord(c):x}}}" for c, form in forms.items() if not form.isalpha())
            self.unstable = self.unstable and f"[{self.unstable}]"
        self.tails = pa.array(["", *marks], pa.string())
        self.tail_ids = pa.array([b"", *encode(marks)], pa.large_binary())
        self.word = rf"^(?P<word>\p{{L}}+)(?P<tail>{'[' + ''.join(marks) + ']?' if marks else ''})$"

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk: behind its blank, or whole behind a zero byte."""
        first = chunk[:1]
        if self.lead is not None and chunk.isalpha():
            plain = chunk if self.normal is None else chunk.lower() if chunk.isascii() else self.normal(" " + chunk)[1:]
            if plain.isalpha():
                return [self.lead + plain]
        whole = chunk[1:] if first == "\0" else chunk if first == "\n" else " " + chunk
        return self.pieces(whole if self.normal is None else self.normal(whole))

    def ids_of(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks, each encoded whole."""
        names = chunks.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        fresh = [c for c, ids in zip(names, found) if ids is None]
        if fresh:
            parts = [self.split(c) for c in fresh]
            pieces = list(set().union(*parts))
            of = dict(zip(pieces, self.encode(pieces))).__getitem__
            made = [of(p[0]) if len(p) == 1 else b"".join(map(of, p)) for p in parts]
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
            self.known.update(zip(fresh, made))
            rest = iter(made)
            found = [next(rest) if ids is None else ids for ids in found]
        return pa.array(found, pa.large_binary())

    def ids_of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks; words of letters are looked up without the mark behind them."""
        if self.lead is None:
            return self.ids_of(chunks)
        parsed = pc.extract_regex(chunks, self.word)
        is_word = parsed.is_valid()
        if self.unstable:
            is_word = pc.and_(is_word, pc.invert(pc.match_substring_regex(chunks, self.unstable)))
        parsed = parsed.filter(is_word)
        words = parsed.field("word").dictionary_encode()
        tails = self.tail_ids.take(pc.index_in(parsed.field("tail"), self.tails))
        words = pc.binary_join_element_wise(self.ids_of(words.dictionary).take(words.indices), tails, NOTHING)
        every = pa.concat_arrays([words, self.ids_of(chunks.filter(pc.invert(is_word)))])
        flags = is_word.to_numpy(zero_copy_only=False)
        place = np.where(flags, np.cumsum(flags) - 1, len(words) + np.cumsum(~flags) - 1)
        return every.take(pa.array(place, pa.int64()))

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        out: list[bytes] = []
        for start, stop in groups_of(pc.binary_length(texts).to_numpy().tolist(), BYTES_AT_ONCE):
            out += self.group(texts.slice(start, stop - start))
        return out

    def group(self, texts: pa.Array) -> list[bytes]:
        odd = pc.match_substring_regex(texts, ODD_TEXT)
        # The first chunk of a text has no blank; in a text with runs of white space none has.
        plain = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        plain = pc.split_pattern(pc.binary_join_element_wise("\0", plain, ""), " ")
        whole = [["\0" + c for c in BEFORE_SPACE.split(t)] for t in texts.filter(odd).to_pylist()]
        flat = pa.concat_arrays([plain.flatten(), pa.array([c for chunks in whole for c in chunks], pa.string())])
        coded = flat.dictionary_encode()
        ids = self.ids_of_chunks(coded.dictionary).take(coded.indices)
        counts = np.concatenate([[0], pc.list_value_length(plain).to_numpy(), [len(c) for c in whole]])
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.cumsum(counts).astype(np.int64)].tolist()
        data = ids.buffers()[2].to_pybytes() if ids.buffers()[2] is not None else b""
        made = [data[a:b] for a, b in zip(ends[:-1], ends[1:])]
        odd = odd.to_numpy(zero_copy_only=False)
        order = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
        return [made[k] for k in order.tolist()]


#: Bytes of the texts that an encoder splits at once.
BYTES_AT_ONCE = 4_000_000


def groups_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as first and end, of about ``most`` bytes; a larger row is a run of its own."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > most:
            yield start, k
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)
