"""Near copies in a stream: a keyed state of class representatives by slices of the fingerprint."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.pairs import print_of

BANDS, WIDTH = 4, 16
MASK = (1 << WIDTH) - 1
#: Keys of a band: a key holds all slices of one remainder, as a group of its own for each slice costs more than its rows.
PARTS = 128
#: A key's slices of which the highest bits agree are stored together, for a call to the store costs more than a few rows.
HIGH = 4
#: Timers of a class's life: they are set at the ends of as many equal spans, so that a key's classes are looked through seldom.
SPANS = 8
#: Bytes of new shingle sets that a key holds before it stores them.
HELD_BYTES = 1 << 26


def slices(fp: int) -> list[int]:
    return [fp >> (WIDTH * k) & MASK for k in range(BANDS)]


class Group:
    """The classes of a key's slices that are stored together: fingerprint, digest, first id, last time, number of shingles, and where the set is stored.

    Sets are stored in chunks of what one batch brings to the group; ``fresh`` has those of the chunk that is not stored yet.
    """

    FIELDS = ("prints", "digests", "ids", "times", "sizes", "chunks", "starts")

    def __init__(self, value=None):
        self.prints, self.times = (array("q", value[k] if value else ()) for k in (0, 3))
        self.digests, self.ids, self.sizes, self.chunks, self.starts = (list(value[k]) if value else [] for k in (1, 2, 4, 5, 6))
        self.place = {ident: k for k, ident in enumerate(zip(self.prints, self.digests))}
        self.fresh, self.chunk = bytearray(), max(self.chunks, default=-1) + 1

    def add(self, ident: tuple, first, at: int, s: bytes) -> None:
        self.place[ident] = len(self.prints)
        for name, x in zip(self.FIELDS, (*ident, first, at, len(s) // 8, self.chunk, len(self.fresh) // 8)):
            getattr(self, name).append(x)
        self.fresh += s

    def value(self) -> tuple:
        return tuple(list(getattr(self, name)) for name in self.FIELDS)

    def without(self, gone: set[int]) -> tuple:
        return tuple([x for k, x in enumerate(column) if k not in gone] for column in self.value())


class NearCopies(StatefulProcessor):
    """The classes of a band's slices with one remainder: texts of one fingerprint and shingle set count once, by their first row.

    A new class is compared with those of its slice whose time is within the hours, and is stored; a copy of a stored one only renews
    it, and one that comes later than the hours begins it anew. A pair is given by the first slice that its fingerprints share, so it comes once. A timer drops classes when
    the watermark is past their last row by the hours.
    """

    def __init__(self, hours: int, distance: int, similarity: float, id_type: str):
        self.ms, self.distance, self.similarity, self.id_type = hours * 3_600_000, distance, similarity, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = ("long", "string", self.id_type, "long", "int", "int", "long")
        self.known = handle.getMapState("classes", "number int", ", ".join(f"{name} array<{kind}>" for name, kind in zip(Group.FIELDS, kinds)))
        self.sets = handle.getMapState("sets", "number int, chunk int", "s binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        band = int(key[0]) // PARTS
        held = {int(number[0]): Group(value) for number, value in self.known.iterator()}
        touched, timers, fresh = set(), set(), 0
        for part in rows:
            out = []
            for row in part.sort_values("id").itertuples(index=False):
                ident, at, ids = (int(row.fp), row.k), int(row.ts.timestamp() * 1000), list(row.ids)
                number = slices(ident[0])[band] >> (WIDTH - HIGH)
                mine = held.setdefault(number, Group())
                k = mine.place.get(ident)
                if k is None or at - mine.times[k] > self.ms:
                    out += [(other, ids[0]) for other in self.near(band, number, mine, ident[0], at, np.frombuffer(row.s, np.int64))]
                    if k is None:
                        mine.add(ident, ids[0], at, row.s)
                        fresh += len(row.s)
                    else:
                        mine.ids[k], mine.times[k] = ids[0], at
                    copies = ids[1:]
                else:
                    mine.times[k] = max(mine.times[k], at)
                    copies = [i for i in ids if i != mine.ids[k]]
                k = mine.place[ident]
                touched.add(number)
                timers.add(self.end_of(mine.times[k]))
                if band == 0:
                    out += [(mine.ids[k], i) for i in copies]
                if fresh > HELD_BYTES:
                    self.store(held)
                    fresh = 0
            yield pd.DataFrame(out, columns=["a", "b"])
        self.store(held)
        for number in touched:
            self.known.updateValue((number,), held[number].value())
        for at in timers:
            self.handle.registerTimer(at)

    def store(self, held: dict[int, Group]) -> None:
        for number, mine in held.items():
            if mine.fresh:
                self.sets.updateValue((number, mine.chunk), (bytes(mine.fresh),))
                mine.fresh, mine.chunk = bytearray(), mine.chunk + 1

    def end_of(self, at: int) -> int:
        """The first end of a span by which a class of the time has expired."""
        span = max(1, self.ms // SPANS)
        return -(-(at + self.ms) // span) * span

    def near(self, band: int, number: int, those: Group, fp: int, at: int, mine: np.ndarray) -> list:
        """First ids of the group's classes that are near a new one and share its slice."""
        if not len(those.prints):
            return []
        apart = np.frombuffer(those.prints, np.uint64) ^ np.uint64(fp & (1 << 64) - 1)
        one_slice = (apart >> np.uint64(WIDTH * band)) & np.uint64(MASK) == 0
        found, own, stored = [], slices(fp), {}
        for k in np.flatnonzero(one_slice & (np.bitwise_count(apart) <= self.distance)).tolist():
            n = those.sizes[k]
            # Sets of too different a size cannot be alike, so theirs is not looked at.
            if abs(those.times[k] - at) > self.ms or min(n, len(mine)) < self.similarity * max(n, len(mine)):
                continue
            if next(b for b, (x, y) in enumerate(zip(own, slices(those.prints[k]))) if x == y) == band:
                chunk = those.chunks[k]
                if chunk == those.chunk:
                    whole = bytes(those.fresh[8 * those.starts[k] : 8 * (those.starts[k] + n)])
                    theirs = np.frombuffer(whole, np.int64)
                else:
                    if chunk not in stored:
                        stored[chunk] = self.sets.getValue((number, chunk))[0]
                    theirs = np.frombuffer(stored[chunk], np.int64, n, 8 * those.starts[k])
                shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                if shared >= self.similarity * (len(mine) + n - shared):
                    found.append(those.ids[k])
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (number,), value in list(self.known.iterator()):
            mine = Group(value)
            gone = {k for k, at in enumerate(mine.times) if at + self.ms <= now}
            if gone:
                left = mine.without(gone)
                # A chunk goes with the last class that has its set in it.
                for chunk in set(mine.chunks) - set(left[Group.FIELDS.index("chunks")]):
                    self.sets.removeKey((number, chunk))
                if left[0]:
                    self.known.updateValue((number,), left)
                else:
                    self.known.removeKey((number,))
        return iter(())

    def close(self) -> None:
        pass


def near_copies(stream: DataFrame, text: Column, hours: int, distance: int = 18, similarity: float = 0.7) -> DataFrame:
    """Pairs ``(a, b)`` of an earlier row and a near copy of it in ``stream(id, ts, ...)``, as they arrive.

    Fingerprints share a slice and differ in ``distance`` bits at most, and the shingle sets have a Jaccard of ``similarity``. Copies
    are one class: pairs are of classes' first rows, and each further copy has one with its class's first, so n copies
    give n - 1 pairs. Copies are brought together in a task before they meet the state. Rows without shingles take no part; rows
    more than ``hours`` behind the newest are late and dropped. State is kept in RocksDB.
    """
    spark, kind = stream.sparkSession, dict(stream.dtypes)["id"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found: dict = {}
            for i, ts, body in zip(x["id"], x["ts"], x["x"]):
                fp, s = print_of(body)
                if len(s):
                    found.setdefault((fp, s.tobytes()), []).append((i, ts))
            out = []
            for (fp, raw), rows in found.items():
                ids = sorted(r[0] for r in rows)
                k = hashlib.blake2b(raw, digest_size=16).hexdigest()
                out += [(b * PARTS + v % PARTS, ids[0], ids, fp, k, raw, max(r[1] for r in rows)) for b, v in enumerate(slices(fp))]
            yield pd.DataFrame(out, columns=["key", "id", "ids", "fp", "k", "s", "ts"])

    rows = stream.select("id", "ts", text.alias("x")).where("ts is not null and id is not null")
    schema = f"key long, id {kind}, ids array<{kind}>, fp long, k string, s binary, ts timestamp"
    rows = rows.mapInPandas(classes, schema).withWatermark("ts", f"{hours} hours")
    processor = NearCopies(hours, distance, similarity, kind)
    return rows.groupBy("key").transformWithStateInPandas(processor, f"a {kind}, b {kind}", "Append", "EventTime")
