"""Byte-level BPE by rank tables: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewire.llm.common import ENCODED_ROWS, ChunkEncoder, id_bytes, map_batches, slim

NO_PAIR = 1 << 62


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the leftmost pair of lowest rank merges until no pair has a rank.

    The leaves of the segment tree stand for byte positions; a leaf holds ``rank << 32 | position`` of the
    pair that starts there, so the root names the leftmost pair of the lowest rank. A merge changes two
    leaves (the merged token's pair and its left neighbour's) and clears one, each in logarithmic time.
    Neighbours are found through linked positions. An unknown single byte raises KeyError.
    """
    if not piece:
        return []
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    size = 1 << (n - 1).bit_length()
    tree = [NO_PAIR] * (2 * size)
    rank_of = ranks.get
    for i in range(n - 1):
        rank = rank_of(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            low = a if a < b else b
            if tree[at] == low:
                break
            tree[at] = low
            at >>= 1

    def pair_at(at: int) -> int:
        middle = end[at]
        if middle == n:
            return NO_PAIR
        rank = rank_of(piece[at : end[middle]])
        return NO_PAIR if rank is None else rank << 32 | at

    while tree[1] != NO_PAIR:
        at = tree[1] & 0xFFFFFFFF
        gone = end[at]
        put(gone, NO_PAIR)
        end[at] = end[gone]
        if end[at] < n:
            left[end[at]] = at
        put(at, pair_at(at))
        if left[at] >= 0:
            put(left[at], pair_at(left[at]))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


#: Pieces of up to this many bytes are merged many at once; longer ones one by one.
LONGEST_AT_ONCE, PIECES_AT_ONCE = 64, 20_000


class PairRanks:
    """The rank of the bytes of two tokens in a row, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        of, found = ranks.get, {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = of(token[:cut]), of(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.pairs = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[p] for p in self.pairs.tolist()], np.int64)
        self.byte_ids = np.array([of(bytes([b]), -1) for b in range(256)], np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``NO_PAIR`` where there is none; a negative id is in no pair."""
        if not len(self.pairs):
            return np.full(a.shape, NO_PAIR, np.int64)
        code = np.where((a < 0) | (b < 0), -1, a << 32 | b)
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        return np.where(self.pairs[at] == code, self.ranks[at], NO_PAIR)


def merge_together(pieces: list[bytes], pairs: PairRanks, size: int) -> list[bytes]:
    """The ids of pieces of 2 to ``size`` bytes as 32-bit bytes, as :func:`merge_bytes` finds them.

    Every piece has its segment tree, a row of ``2 * size`` numbers, and in a round every piece that still has a
    pair with a rank makes its next merge: three leaves change, and so do the nodes above them.
    """
    many = len(pieces)
    length = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(many, size)
    place = np.arange(size)
    inside = place[None, :] < length[:, None]
    token = np.where(inside, pairs.byte_ids[raw], -1)
    if (token[inside] < 0).any():
        raise KeyError("a byte has no rank")
    after = np.tile(place + 1, (many, 1))
    before = np.tile(place - 1, (many, 1))
    tree = np.full((many, 2 * size), NO_PAIR, np.int64)
    rank = pairs(token[:, :-1], token[:, 1:])
    tree[:, size : 2 * size - 1] = np.where(rank == NO_PAIR, NO_PAIR, rank * size + place[:-1])
    level = size
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        at = at + size
        tree[row, at] = value
        at = at >> 1
        while len(at) and at[0]:
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            at = at >> 1

    def pair_at(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        far = after[row, at]
        ends = far >= length[row]
        rank = pairs(token[row, at], np.where(ends, -1, token[row, np.where(ends, 0, far)]))
        return np.where(rank == NO_PAIR, NO_PAIR, rank * size + at)

    row = np.flatnonzero(tree[:, 1] != NO_PAIR)
    while len(row):
        at = tree[row, 1] % size
        gone = after[row, at]
        token[row, at] = tree[row, 1] // size
        token[row, gone] = -1
        far = after[row, gone]
        after[row, at] = far
        more = far < length[row]
        before[row[more], far[more]] = at[more]
        put(row, gone, NO_PAIR)
        put(row, at, pair_at(row, at))
        left = before[row, at]
        has = left >= 0
        put(row[has], left[has], pair_at(row[has], left[has]))
        row = row[tree[row, 1] != NO_PAIR]
    alive = token >= 0
    ids = token[alive].astype("<u4").tobytes()
    ends = np.cumsum(alive.sum(axis=1) * 4).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    """Encodes and decodes texts with one rank file and one split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pairs = PairRanks(self.ranks)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.encode = ChunkEncoder(regex.compile(pattern).findall, self.merge)

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit bytes."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(raw):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = id_bytes([whole])
            elif len(piece) > LONGEST_AT_ONCE:
                out[k] = id_bytes(merge_bytes(piece, self.ranks))
            elif piece:
                by_size.setdefault(1 << (len(piece) - 1).bit_length(), []).append(k)
        for size, places in by_size.items():
            for start in range(0, len(places), PIECES_AT_ONCE):
                some = places[start : start + PIECES_AT_ONCE]
                for k, ids in zip(some, merge_together([raw[k] for k in some], self.pairs, max(size, 2))):
                    out[k] = ids
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text as little-endian unsigned 32-bit integers.

    One row per input row, repeated rows and null ids included; a null or empty text has no ids. The rank
    file must lie at the same path on every machine. No shuffle: each batch is encoded where it is read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": codec(ranks_path, pattern).encode(batch.column("text"))}

    return slim(docs, id_col, text_col).mapInArrow(map_batches(run, ENCODED, ENCODED_ROWS), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give an empty text, bytes that are no UTF-8 are replaced."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(ranks_path, pattern)
        texts = [own.decode(i or b"").decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return encoded.select("doc_id", "ids").mapInArrow(map_batches(run, schema), "doc_id long, text string")


def encoding_digests(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document's ids and of what they decode to.

    Rows as :func:`encode_documents` has them; ids are decoded and both are digested where they are made, so
    neither leaves its worker.
    """

    def run(batch: pa.RecordBatch) -> dict:
        own = codec(ranks_path, pattern)
        ids = own.encode(batch.column("text"))
        return {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [len(i) // 4 for i in ids],
            "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
            "decoded_sha256": [hashlib.sha256(own.decode(i)).hexdigest() for i in ids],
        }

    return slim(docs, id_col, text_col).mapInArrow(
        map_batches(run, DIGESTS, ENCODED_ROWS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
