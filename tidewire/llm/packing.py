"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import ENCODED_ROWS, ChunkEncoder, id_bytes, map_batches, slim
from tidewire.shared import materialize

#: Pieces that one packing group holds on average; all groups' last underfull sequences are packed together again.
GROUP_PIECES = 20_000


#: The byte-level alphabet. Printable Latin-1 bytes stand for themselves, the others, in order, for
#: the characters from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([b for b in range(256) if b not in PRINTABLE], range(256, 512)))
#: Fixed value: the split pattern of a byte-level pre-tokenizer that uses its own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split_pattern(pre_tokenizer: dict) -> str | None:
    """The pattern whose matches a byte-level tokenizer encodes one by one; None for another kind of tokenizer."""
    if pre_tokenizer.get("type") == "ByteLevel":
        plain = pre_tokenizer["use_regex"] and not pre_tokenizer["add_prefix_space"]
        return BYTE_LEVEL_PATTERN if plain else None
    steps = pre_tokenizer.get("pretokenizers", [])
    if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    keeps = steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    return steps[0]["pattern"].get("Regex") if keeps else None


@lru_cache(maxsize=4)
def json_encoder(path: str) -> Callable[[pa.Array], list[bytes]]:
    """Encodes texts as the tokenizers library does without special tokens of its own.

    Words and marks of a byte-level tokenizer that a worker has met are remembered, and only new ones go to the
    library's model. Other tokenizers encode whole texts, and so do all tokenizers where a text has the string of an added token,
    which the library makes that token's id.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    described = json.loads(tokenizer.to_str())
    pattern = split_pattern(described["pre_tokenizer"] or {})

    def whole(texts: pa.Array) -> list[bytes]:
        return [id_bytes(e.ids) for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]

    if pattern is None:
        return whole
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    tokenize, blank = tokenizer.model.tokenize, chr(BYTE_CHARS[32])

    def encode(pieces: list[str]) -> list[bytes]:
        # Of printable ASCII only the blank has another character in the byte-level alphabet.
        spelt = [
            p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(BYTE_CHARS)
            for p in pieces
        ]
        return [id_bytes([t.id for t in tokenize(s)]) for s in spelt]

    chunked = ChunkEncoder(regex.compile(pattern).findall, encode, normalizer_of(tokenizer, described["normalizer"]))

    def run(texts: pa.Array) -> list[bytes]:
        odd = np.zeros(len(texts), bool)
        for content in added:
            # In any case of its letters: some added tokens are looked for in the normal form.
            odd |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not odd.any():
            return chunked(texts)
        special, plain = (iter(f(texts.filter(pa.array(m)))) for f, m in ((whole, odd), (chunked, ~odd)))
        return [next(special if o else plain) for o in odd]

    return run


def normalizer_of(tokenizer, described: dict | None) -> Callable[[str], str] | None:
    """The tokenizer's normalizer, of which it is known that it turns ASCII words into lower case; None: it has none."""
    if not described:
        return None
    whole = tokenizer.normalizer.normalize_str
    if whole(" AbC") != " abc":
        raise ValueError(f"no lower-casing normalizer: {described}")
    return whole


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def cut_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """The token pieces of every whole text: ``doc_id, piece, start, length, ids_crc32[, ids]``.

    A text's ids and the end id are one piece if they fit; a longer one is cut so that all pieces but the
    first have full length. A null or empty text is its end id. Repeated rows give repeated pieces.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = PIECES.names if with_ids else PIECES.names[:-1]
    schema = pa.schema([PIECES.field(n) for n in names])

    def run(batch: pa.RecordBatch) -> dict:
        encoder = json_encoder(tokenizer_path)
        out: dict = {n: [] for n in PIECES.names}
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text"))):
            ids += end
            n = len(ids) // 4
            stop = n % capacity or capacity
            start = piece = 0
            while start < n:
                part = ids[4 * start : 4 * stop]
                for name, value in zip(PIECES.names, (doc, piece, start, stop - start, zlib.crc32(part), part)):
                    out[name].append(value)
                start, stop, piece = stop, stop + capacity, piece + 1
        return {n: out[n] for n in names}

    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return slim(docs, id_col, text_col).mapInArrow(map_batches(run, schema, ENCODED_ROWS), sql)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, in the order given, goes into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f is set while a bin has f free places
    for i, n in enumerate(lengths):
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                some ^= 1 << free
            bins[at].append(i)
        else:
            free, at = capacity, len(bins)
            bins.append([i])
        by_free[free - n].append(at)
        some |= 1 << (free - n)
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound of the number of bins.

    For each k: items above capacity - k are alone, items above half are in bins of their own, and items from k
    up to half need what room those leave or further bins; and of items above a third, a quarter, ... few fit together.
    """
    counts = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)[: capacity + 1]
    number, total = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    k = np.arange(half + 1)
    below = np.maximum(k - 1, 0)
    alone = number[capacity] - number[capacity - k]
    large = number[capacity - k] - number[half]
    room = large * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[below], 0)
    by_half = int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())
    # Of items above a part of the capacity only so many fit into one bin.
    parts = np.arange(1, capacity + 1)
    return max(by_half, int((-(-(number[capacity] - number[capacity // (parts + 1)]) // parts)).max()))


class Takers:
    """Bins that may take items: their items and lengths in ascending order, and the most room beside an item of each length.

    ``reach[s]`` is the largest room of a bin in ``ready`` that holds an item of length s (0: of any bin); heaps name that bin.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.items = [sorted(b, key=lambda i: lengths[i]) for b in bins]
        self.sizes = [[lengths[i] for i in b] for b in self.items]
        self.free = [capacity - sum(s) for s in self.sizes]
        self.ready = [False] * len(bins)
        self.open: dict[int, None] = {}
        self.pairs: dict[int, tuple[list[int], dict[int, tuple[int, int]]]] = {}
        self.where: list[set[int]] = [set() for _ in range(capacity + 1)]
        for at, sizes in enumerate(self.sizes):
            for size in sizes:
                self.where[size].add(at)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.reach = np.zeros(capacity + 1, np.int64)
        self.place = np.arange(capacity + 1)

    def valid(self, size: int, free: int, at: int) -> bool:
        if not self.ready[at] or self.free[at] != free:
            return False
        k = bisect_left(self.sizes[at], size)
        return not size or k < len(self.sizes[at]) and self.sizes[at][k] == size

    def refresh(self, sizes) -> None:
        for size in sizes:
            heap = self.heaps[size]
            while heap and not self.valid(size, -heap[0][0], heap[0][1]):
                heappop(heap)
            self.reach[size] = -heap[0][0] if heap else 0

    def enter(self, at: int) -> None:
        self.ready[at] = True
        self.open[at] = None
        for size in (0, *set(self.sizes[at])):
            heappush(self.heaps[size], (-self.free[at], at))
            self.reach[size] = max(self.reach[size], self.free[at])

    def leave(self, at: int) -> None:
        self.ready[at] = False
        self.open.pop(at, None)
        self.refresh((0, *set(self.sizes[at])))

    def move(self, source: int, target: int, size: int) -> None:
        self.pairs.pop(source, None)
        self.pairs.pop(target, None)
        at = bisect_left(self.sizes[source], size)
        self.sizes[source].pop(at)
        item = self.items[source].pop(at)
        at = bisect_left(self.sizes[target], size)
        self.sizes[target].insert(at, size)
        self.items[target].insert(at, item)
        self.free[source] += size
        self.free[target] -= size
        self.where[size].add(target)
        at = bisect_left(self.sizes[source], size)
        if at == len(self.sizes[source]) or self.sizes[source][at] != size:
            self.where[size].discard(source)

    def exchange(self, offers: list[tuple[int, ...]]) -> tuple[tuple[int, ...], int] | None:
        """Of offers, items of one bin by their lengths, the one that moves most into a taker, and what comes back."""
        if not offers:
            return None
        size = np.array([sum(o) for o in offers])
        # An offer fits where something smaller comes back and the difference is at most the room beside it.
        most = np.maximum.accumulate(np.where(self.reach > 0, self.place + self.reach, 0))
        back = np.searchsorted(most, size)
        gain = size - back
        best = int(gain.argmax())
        return (offers[best], int(back[best])) if gain[best] > 0 else None

    def step(self, giver: int, deep: bool) -> bool:
        """Make an exchange from the giver: an item that moves, or one or else two for a smaller one."""
        sizes = self.sizes[giver]
        one = sorted(set(sizes))
        found = self.exchange([(a,) for a in one])
        if found is None:
            two = [(a, b) for k, a in enumerate(one) for b in one[k + 1 :]]
            found = self.exchange(two + [(a, a) for a, b in zip(sizes, sizes[1:]) if a == b])
        if found is None:
            return deep and (self.one_for_two(giver, one) or self.split(giver, one))
        out, back = found
        taker = self.heaps[back][0][1]
        had = set(self.sizes[taker])
        for size in out:
            self.move(giver, taker, size)
        if back:
            self.move(taker, giver, back)
        self.refresh((0, *had))
        self.enter(taker)
        return True


    def one_for_two(self, giver: int, sizes: list[int]) -> bool:
        """Change an item for two of a taker that are shorter together, by no more than its room."""
        for at in self.open:
            room, (sums, pairs) = self.free[at], self.pairs_of(at)
            for whole in sizes:
                j = bisect_left(sums, whole - room)
                if j < len(sums) and sums[j] < whole:
                    had = set(self.sizes[at])
                    self.move(giver, at, whole)
                    for part in pairs[sums[j]]:
                        self.move(at, giver, part)
                    self.refresh((0, *had))
                    self.enter(at)
                    return True
        return False

    def pairs_of(self, at: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """The lengths that two items of a bin have together, in order, and a pair of each; kept until the bin changes."""
        if at not in self.pairs:
            sizes = self.sizes[at]
            one = sorted(set(sizes))
            two = {a + b: (a, b) for k, a in enumerate(one) for b in one[k + 1 :]}
            two |= {2 * a: (a, a) for a, b in zip(sizes, sizes[1:]) if a == b}
            self.pairs[at] = (sorted(two), two)
        return self.pairs[at]

    def split(self, giver: int, sizes: list[int]) -> bool:
        """Change an item for two of any bin, full ones too, that are as long together and one of which moves right after.

        The exchange leaves all fills as they are; the move then raises a fuller bin's, so this too ends.
        """
        room = int(self.reach[0])
        for whole in reversed(sizes):
            for part in range(min(room, whole - 1), 0, -1):
                rest = whole - part
                for at in self.where[part] & self.where[rest]:
                    if at == giver or part == rest and self.sizes[at].count(part) < 2:
                        continue
                    had = set(self.sizes[at])
                    self.move(giver, at, whole)
                    self.move(at, giver, part)
                    self.move(at, giver, rest)
                    if self.ready[at]:
                        self.refresh((0, *had))
                        self.enter(at)
                    taker = self.heaps[0][0][1]
                    had = set(self.sizes[taker])
                    self.move(giver, taker, part)
                    self.refresh((0, *had))
                    self.enter(taker)
                    return True
        return False


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """Empty underfull bins by moves and swaps that increase the sum of squared fills; the bins and the number of steps.

    The emptiest bin gives: an item moves to a fuller bin with room, or one item or two change places with a
    smaller item of a fuller bin, or one with two shorter ones, until it is empty and dropped or no exchange is left; then the
    next one gives. Every step raises a fuller bin's fill at the cost of an emptier one, so the search ends. It passes over all
    underfull bins until a pass makes no step or a lower bound allows no fewer.
    """
    state = Takers(bins, lengths, capacity)
    least, left, steps, before, thorough = least_bins(lengths, capacity), len(bins), 0, -1, False
    while least < left and (steps > before or not thorough):
        thorough, before = steps == before, steps
        open_ = sorted((k for k, s in enumerate(state.sizes) if s and state.free[k]), key=lambda k: (state.free[k], k))
        for at in open_:
            state.enter(at)
        # Exchanges that look through many bins are for those that get empty, and for all once a pass made no step without.
        deep = True
        for giver in reversed(open_):
            if left <= least:
                break
            state.leave(giver)
            while state.sizes[giver] and state.step(giver, deep):
                steps += 1
            left -= not state.sizes[giver]
            deep = thorough or deep and not state.sizes[giver]
    return [b for b in state.items if b], steps


def fitted(items: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of a best fit of the items in the order given."""
    return [[items[k] for k in b] for b in best_fit([lengths[i] for i in items], capacity)]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the local search from a best fit, longer items than half a bin first, then in the order given.

    The former need a bin each in any packing; what the fit wastes on the others the search wins back. Where it ends above the
    lower bound, it escapes: the emptiest 8, 16, 32, ... bins exchange all their items at once, packed anew from the
    longest to the shortest, and where that too increases the squared fill the search goes on from there.
    """
    items = sorted(range(len(lengths)), key=lambda i: 2 * lengths[i] <= capacity)
    bins, _ = local_search(fitted(items, lengths, capacity), lengths, capacity)
    least, width = least_bins(lengths, capacity), 8
    squares = lambda some: sum(sum(lengths[i] for i in b) ** 2 for b in some)
    while len(bins) > least and width < 2 * len(bins):
        bins.sort(key=lambda b: sum(lengths[i] for i in b))
        taken = sorted((i for b in bins[:width] for i in b), key=lambda i: -lengths[i])
        again = fitted(taken, lengths, capacity)
        if squares(again) > squares(bins[:width]):
            bins, _ = local_search(again + bins[width:], lengths, capacity)
        else:
            width *= 2
    return bins


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length``, such as :func:`cut_documents` gives.

    Pieces are dealt evenly to groups of about ``GROUP_PIECES``, whatever their ids, and every group is packed for
    itself, so a task holds lengths only, of a bounded number of pieces. Then the emptiest sequences of all
    groups, one of each, are packed together. An empty table gives an empty table; equal rows are packed one by one.
    """
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    packed = _packed(pieces, 0, groups, capacity)
    if groups == 1:
        return packed.drop("_last")
    packed = materialize(packed, "packed")
    last = packed.where("_last").select(pieces.columns)
    again = _packed(last, groups, max(1, -(-last.count() // GROUP_PIECES)), capacity)
    return packed.where("not _last").unionByName(again).drop("_last")


def _packed(pieces: DataFrame, first: int, groups: int, capacity: int) -> DataFrame:
    """Pieces packed in ``groups`` groups, numbered from ``first``; ``_last`` marks the emptiest sequence of each."""
    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long").add("_last", "boolean")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        group = int(part.pop("_group").iloc[0])
        # Rows come in any order; the same ones are packed alike again.
        part = part.sort_values(list(part.columns), kind="stable", ignore_index=True)
        order = np.random.default_rng(len(part)).permutation(len(part))
        lengths = part["length"].to_numpy()[order].tolist()
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        bins = pack_lengths(lengths, capacity)
        fill = [sum(lengths[i] for i in items) for items in bins]
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                sequence[order[i]], offset[order[i]] = group << 32 | k, at
                at += lengths[i]
        return part.assign(sequence_id=sequence, offset=offset, _last=sequence == (group << 32 | int(np.argmin(fill))))

    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)) + first
    return pieces.withColumn("_group", group).groupBy("_group").applyInPandas(pack, schema)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document."""
    pieces = cut_documents(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids=False)
    return pack_pieces(materialize(pieces, "pieces"), capacity)
