"""Periodic runs of words: maximal pairs of an LCP-interval tree whose distance is at most a third of their length."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewire.llm.common import ENCODED_ROWS, groups_of, map_batches, slim

#: Fixed value: what stands between white space is a word.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: The shortest part that the pair of a run repeats: one word fewer than the shortest run, or the periods after its first.
LEAST_REPEAT = min(max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) for q in range(1, LEAST_WORDS))
#: Bytes of texts whose words are sorted together.
BYTES_SORTED = 2_000_000


def rank_levels(codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ; and the places that share four words.

    ``codes`` ends every text with a number that occurs once. Each level sorts only what the one before left equal.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.r_[True, codes[order][1:] != codes[order][:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width, shared = [rank], 1, order[:0]
    while True:
        alone = head & np.r_[head[1:], True]
        order = order[~alone]
        if width == 4 or width < 4 and not len(order):
            shared = order
        if not len(order):
            return levels, shared
        old, behind = rank[order], rank[order + width]
        inner = np.argsort(old.astype(np.int64) * n + behind, kind="stable")
        order, old, behind = order[inner], old[inner], behind[inner]
        first = np.r_[True, old[1:] != old[:-1]]
        head = first | np.r_[True, behind[1:] != behind[:-1]]
        at = np.arange(len(order))
        # A new rank is the old one and the number of suffixes of the same old rank before.
        new = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        rank = rank.copy()
        rank[order] = new
        levels.append(rank)
        width *= 2


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b``, pairwise different places, have in common."""
    length = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def join_places(kept: list[int], more: list[int], length: int, left: list[int], found: list[tuple[int, int, int]]) -> list[int]:
    """Merge the occurrences of two children of an interval of ``length`` common words; note its maximal pairs.

    A pair must be at most a third of the length apart. Such occurrences of one string are a progression by its period,
    of which all but the first follow the same word. So of the occurrences before a place only the farthest within reach
    can be of another left-word class, and of those behind it only the farthest can be in another child.
    """
    if len(kept) < len(more):
        kept, more = more, kept
    reach = length // (LEAST_PERIODS - 1)
    for i in more:
        if kept[0] < i <= kept[-1] + reach:
            j = kept[bisect_left(kept, i - reach)] if i - reach > kept[0] else kept[0]
            if j < i and left[j] != left[i]:
                found.append((j, i, length))
        if kept[0] - reach <= i < kept[-1]:
            j = kept[bisect_right(kept, i + reach) - 1] if i + reach < kept[-1] else kept[-1]
            if j > i and left[j] != left[i]:
                found.append((i, j, length))
    if len(more) > 8:
        kept += more
        kept.sort()
    else:
        for i in more:
            insort(kept, i)
    return kept


def maximal_pairs(places: list[int], shared: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Maximal pairs ``(i, j, length)`` of suffixes in order, ``shared[k]`` words common to ``places[k]`` and the next one.

    The intervals of the LCP tree are closed bottom-up from a stack; a node is its occurrences, each with the class of
    the word on its left. Intervals too short for any run are never opened.
    """
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []
    for place, length in zip(places, shared):
        node = [place]
        while stack and stack[-1][0] > length:
            deeper, kept = stack.pop()
            node = join_places(kept, node, deeper, left, found)
        if length >= LEAST_REPEAT:
            if stack and stack[-1][0] == length:
                stack[-1] = (length, join_places(stack[-1][1], node, length, left, found))
            else:
                stack.append((length, node))
    return found


def runs_of_codes(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` in order of texts whose words are numbers; one that occurs once ends each text.

    A run is a stretch whose words repeat at its smallest period, long enough and with enough periods, that no neighbouring
    word extends. It is the maximal pair of its start and its second period; pairs of a multiple of the period have
    the same stretch, and the smallest one counts.
    """
    if not len(codes):
        return []
    levels, places = rank_levels(codes)
    if not len(places):
        return []
    places = places[np.argsort(levels[-1][places])]
    shared = np.append(common_prefix(levels, places[:-1], places[1:]), 0)
    # What neither neighbour shares enough words with is in no interval.
    near = shared >= LEAST_REPEAT
    near = near | np.r_[False, near[:-1]]
    # A word that ends a text is left of the next one and of no other.
    left = np.r_[-1, codes[:-1]].tolist()
    periods: dict[tuple[int, int], int] = {}
    for i, j, length in maximal_pairs(places[near].tolist(), shared[near].tolist(), left):
        period = j - i
        if length + period >= LEAST_WORDS:
            key = (i, length + period)
            periods[key] = min(period, periods.get(key, period))
    return sorted((start, length, period) for (start, length), period in periods.items())


def word_codes(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts as numbers, apart for every text and each text ended by one of its own; and where texts start."""
    flat = pa.array([w for text in words for w in text], pa.string()).dictionary_encode()
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.empty(starts[-1], np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(text)) + text
    codes[at] = flat.indices.to_numpy() + text * (len(flat.dictionary) + 1)
    codes[starts[1:] - 1] = np.arange(1, len(words) + 1) * (len(flat.dictionary) + 1) - 1
    return codes, starts


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
FOUND_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def found_in(texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Per text its number of words, its runs, and its words without the repeats, joined by blanks."""
    words = [WORD.findall(t) for t in texts]
    codes, starts = word_codes(words)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of_codes(codes):
        text = int(np.searchsorted(starts, start, "right")) - 1
        runs[text].append((start - int(starts[text]), length, period))
    for own, found in zip(words, runs):
        kept = own
        if found:
            # A word goes if it is in a run behind the run's first period.
            depth = np.zeros(len(own) + 1, np.int64)
            for start, length, period in found:
                depth[start + period] += 1
                depth[start + length] -= 1
            kept = [w for w, d in zip(own, np.cumsum(depth)[:-1].tolist()) if not d]
        yield len(own), found, " ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every whole text: its runs by start and period, and the text without repeats.

    Words are what stands between white space, ``collapsed`` joins the kept ones by single blanks. A null or empty text has no
    words and no runs, and an empty collapsed text; repeated rows and rows without an id each have their result. Nothing
    is shuffled; a task holds the words of about ``BYTES_SORTED`` bytes of texts, or of one longer text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text")
        out: dict = {"n_words": [], "runs": [], "collapsed": []}
        for start, stop in groups_of(pc.binary_length(texts).to_numpy().tolist(), BYTES_SORTED):
            for n, runs, collapsed in found_in(texts.slice(start, stop - start).to_pylist()):
                out["n_words"].append(n)
                out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
                out["collapsed"].append(collapsed)
        return {"doc_id": batch.column("doc_id"), **out}

    return slim(docs, id_col, text_col).mapInArrow(map_batches(run, FOUND, ENCODED_ROWS), FOUND_SQL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` in which a tenth of the texts, by a hash of the id, repeat a stretch of theirs up to the end.

    Of n words those from a on repeat with period p, where a is g modulo n, p is 1 + (n - a) / (3 + g modulo 8) and g is
    the hash without its last digit. Other texts stay; rows without an id and texts without words do too.
    """
    rows = slim(docs)
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(hashed % 10 == 0, F.lit(False))
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0)))
    rows = rows.select("doc_id", "text", F.floor(hashed / 10).alias("g"), words.alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    origin = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    edited = F.array_join(F.transform("w", lambda w, i: F.get("w", origin(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """Digests of :func:`periodic_runs` over :func:`with_planted_runs`, with the longest run (first start, then period)."""
    found = periodic_runs(with_planted_runs(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("b.s")).alias("start"),
        F.col("b.n").alias("length"),
        (-F.col("b.p")).alias("period"),
        F.floor(1000 * F.col("b.n") / -F.col("b.p")).alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
