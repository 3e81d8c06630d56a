"""Joins: seen items, near duplicates, similarity by blocking, evidence."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewire.functions import text as t
from tidewire.operators import sets
from tidewire.shared import materialize, shuffle_width

try:
    # The same digest; on short strings OpenSSL takes about twice as long.
    from _md5 import md5
except ModuleNotFoundError:
    md5 = hashlib.md5


def unseen(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")


def unique_insert(new: DataFrame, stored: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """New rows whose keys neither a stored row nor an earlier new row has, first in ``order``.

    Keys are taken one after another, as repeated inserts would refuse them; rows with a null key pass.
    """
    for key in keys:
        first = F.row_number().over(Window.partitionBy(key).orderBy(order))
        new = new.withColumn("_rn", first).where((F.col("_rn") == 1) | F.col(key).isNull()).drop("_rn")
        new = new.join(stored.select(key).where(f"{key} is not null"), key, "left_anti")
    return new


def band_candidates(prints: DataFrame, bands: int = 4) -> DataFrame:
    """Pairs ``(a, b)`` of ``prints(id, fp)`` that share a slice of the fingerprint.

    Rows with one fingerprint are one class, named by its smallest id: pairs are between class names, and every other
    member is paired with its name. No slice is cut short, and copies make no pairs among themselves.
    """
    # Written once, or each use of a fingerprint would compute it anew.
    prints = materialize(prints.select("id", "fp"), "prints").where("fp is not null")
    names = materialize(prints.groupBy("fp").agg(F.min("id").alias("id")), "names")
    keyed = names.select("id", F.posexplode(t.band_keys(F.col("fp"), bands)).alias("band", "slice"))
    left = keyed.select("band", "slice", F.col("id").alias("a"))
    right = keyed.select("band", "slice", F.col("id").alias("b"))
    between = left.join(right, ["band", "slice"]).where("a < b").select("a", "b").distinct()
    within = prints.join(names.select("fp", F.col("id").alias("a")), "fp").where("a <> id").select("a", F.col("id").alias("b"))
    return between.union(within)


#: For each byte of a text itself, where it belongs to a word of ASCII letters and digits, else a blank.
WORD_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def print_of(text: str | None, size: int = 3) -> tuple[int, np.ndarray]:
    """Fingerprint and distinct shingle hashes of a text, as ``simhash64`` and ``shingle_hashes`` have them."""
    words = (text or "").lower().encode().translate(WORD_BYTES).split()
    runs = [b" ".join(r) for r in zip(*(words[k:] for k in range(size)))] or ([b" ".join(words)] if words else [])
    raw = b"".join([md5(r).digest() for r in runs])
    first = np.frombuffer(raw, np.uint8).reshape(-1, 16)[:, :8]
    votes = np.unpackbits(first, axis=1).sum(axis=0) * 2 > len(runs)
    fp = int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)
    return fp, np.unique(np.frombuffer(raw, ">i8")[::2].astype(np.int64))


def fingerprints(rows: DataFrame, text: Column, size: int = 3) -> DataFrame:
    """``id, fp, s, k`` of each row's text by :func:`print_of`, written once: 64 votes over every shingle are numpy's work.

    ``k`` is a digest of the shingle set, by which equal sets are told without reading them again.
    """

    def run(batches):
        for batch in batches:
            prints, sets = zip(*(print_of(x, size) for x in batch.column("x").to_pylist())) if batch.num_rows else ((), ())
            digests = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
            columns = [batch.column("id"), pa.array(prints, pa.int64()), pa.array(sets, pa.list_(pa.int64())), digests]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "s", "k"])

    rows = rows.select("id", text.alias("x"))
    return materialize(rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long, s array<long>, k binary"), "fingerprints")


def near_duplicate_pairs(articles: DataFrame, text: Column, distance: int = 18, similarity: float = 0.7) -> DataFrame:
    """``(a, b, similarity)`` of texts whose fingerprints share a slice and differ in ``distance`` bits at most, and whose
    shingle sets have a Jaccard of ``similarity`` or more.

    Texts with one shingle set and fingerprint are one class, named by its smallest id: pairs are between names, and
    every other member is paired with its name. Texts without shingles take no part.
    """
    prints = fingerprints(articles, text).where(F.size("s") > 0)
    names = materialize(prints.groupBy("fp", "k").agg(F.min("id").alias("name")), "names")
    within = prints.join(names, ["fp", "k"]).where("name <> id").select(F.col("name").alias("a"), F.col("id").alias("b"))
    named = prints.join(names.select(F.col("name").alias("id")), "id", "left_semi")
    return near_fingerprints(named, distance, similarity).union(within.withColumn("similarity", F.lit(1.0)))


#: Bits of a shingle's hash that are shuffled. Two shingles with the same ones only bring rows together that the sets then tell apart.
TOKEN_BITS = 40


def rare_shingles(rows: DataFrame, similarity: float) -> DataFrame:
    """``(id, n, token, indexed)``: of each of ``rows(id, s)`` the rarest shingles that another row has, one of which two similar sets share.

    Of two sets with the similarity the larger has a common shingle among its first n - ceil(s n) + 1 in any
    common order, the smaller among its first n - ceil(2 s n / (1 + s)) + 1 (``indexed``); from rare to frequent, few rows meet.
    Shingles of one row alone are the rarest and meet nothing, so they only count in the places of the others and never leave their task.
    """
    most = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    every = rows.select("id", F.array_distinct("s").alias("k")).select("id", F.size("k").alias("n"), F.explode("k").alias("token"))
    every = every.withColumn("token", F.col("token").bitwiseAND((1 << TOKEN_BITS) - 1))
    shared = every.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("c > 1")
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("id"))
    # Of shingles with one token each has the first's place, so none comes too late.
    place = alone + F.rank().over(Window.partitionBy("id").orderBy("c", "token"))
    indexed = F.col("place") <= most(2 * similarity / (1 + similarity))
    return shared.withColumn("place", place).where(F.col("place") <= most(similarity)).select("id", "n", "token", indexed.alias("indexed"))


def near_fingerprints(rows: DataFrame, distance: int = 18, similarity: float = 0.7) -> DataFrame:
    """:func:`near_duplicate_pairs` of ``rows(id, fp, s)`` with different texts.

    Pairs meet at rare shingles, which finds every one with the similarity; slices and bits are tested on these. A slice
    of 16 bits would bring together a 65,536th of all texts, however unlike.
    """
    rare = materialize(rare_shingles(rows, similarity), "rare-shingles")
    side = lambda s: rare.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "indexed")])
    sizes = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (similarity - 1e-9)
    both = side("a").join(side("b"), "token").where("id_a < id_b and (indexed_a or indexed_b)").where(sizes)
    both = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    prints = lambda s: rows.select(F.col("id").alias(s), F.col("fp").alias(f"f{s}"))
    shared = F.exists(F.arrays_zip(t.band_keys(F.col("fa")).alias("x"), t.band_keys(F.col("fb")).alias("y")), lambda z: z["x"] == z["y"])
    both = both.join(prints("a"), "a").join(prints("b"), "b").where(t.hamming(F.col("fa"), F.col("fb")) <= distance)
    # Shingle sets join what the fingerprints left over: whole texts have many. A set that no pair asks for is not shuffled while
    # the ids asked for are few enough for the optimizer's own broadcast.
    both = materialize(both.where(shared).select("a", "b"), "near-prints")
    asked = materialize(both.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    held = rows.select("id", "s").join(asked, "id", "left_semi")
    sets = lambda s: held.select(F.col("id").alias(s), F.col("s").alias(f"s{s}"))
    both = both.join(sets("a"), "a").join(sets("b"), "b")
    both = both.withColumn("similarity", t.jaccard(F.col("sa"), F.col("sb")))
    return both.where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def cosine(a: Column, b: Column) -> Column:
    """The inner product of two unit vectors, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def hot_keys(many: DataFrame, key: str) -> DataFrame:
    """Keys with more than a 4,096th of the rows, fewer than 4,096 of them."""
    n = many.count()
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * 4096 > n)
    return materialize(hot.select(key, F.lit(True).alias("_hot")), "hot-keys")


def spread_join(few: DataFrame, many: DataFrame, key: str, unique: str, hot: DataFrame | None = None) -> DataFrame:
    """An inner join on ``key`` in which the rows of ``many`` with a hot key, told apart by ``unique``, fill many tasks.

    The hot keys are broadcast, for their number is bounded; the rows of ``few`` with one go to each of its parts.
    """
    hot, parts = F.broadcast(hot_keys(many, key) if hot is None else hot), shuffle_width(many.sparkSession)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(unique), F.lit(parts)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    many = many.join(hot, key, "left").withColumn("_part", part).drop("_hot")
    few = few.join(hot, key, "left").withColumn("_part", F.explode(every)).drop("_hot")
    return few.join(many, [key, "_part"]).drop("_part")


#: Vectors of a tile, the unit of exact similarity search, and the most pivots by which a block's vectors are parted.
TILE_ROWS, MOST_PIVOTS = 2048, 64


def tiles(vectors: DataFrame, block: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(tile, block, centre, radius, longest, ids, vectors)``: at most ``tile_rows`` vectors near one pivot, of one block.

    Rows are dealt by ranges of block, nearest pivot and a hash, so a block or a pivot with a large share of all rows fills many
    tasks; each task cuts its sorted rows into tiles. Blocks that fill no tile have one pivot, so that tiles stay few.
    """
    rows = vectors.select(F.col(block).alias("block"), "id", "embedding").where("block is not null and embedding is not null")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("block").alias("blocks")).first()
    count = min(MOST_PIVOTS, max(1, round(size["n"] / max(1, size["blocks"]) / tile_rows)))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("embedding").collect()
    pivots = np.array([r["embedding"] for r in first], np.float64)
    kinds = dict(rows.dtypes)

    def part(batches):
        for x in batches:
            v = np.array(x["embedding"].tolist(), np.float64).reshape(len(x), -1)
            # The nearest pivot has the least |p|^2 - 2 v p.
            yield x.assign(cell=((pivots**2).sum(axis=1) - 2 * v @ pivots.T).argmin(axis=1) if len(x) else [])

    def cut(batches):
        held, key = [], None

        def tile():
            v = np.stack([r.embedding for r in held]).astype(np.float64)
            centre = v.mean(axis=0)
            apart, length = np.linalg.norm(v - centre, axis=1).max(), np.linalg.norm(v, axis=1).max()
            return (key[0], centre.tolist(), float(apart), float(length), [r.id for r in held], v.tobytes())

        for x in batches:
            out = []
            for r in x.itertuples(index=False):
                if held and (key != (r.block, r.cell) or len(held) == tile_rows):
                    out.append(tile())
                    held.clear()
                key = (r.block, r.cell)
                held.append(r)
            yield pd.DataFrame(out, columns=TILE)
        if held:
            yield pd.DataFrame([tile()], columns=TILE)

    dealt = rows.mapInPandas(part, f"block {kinds['block']}, id {kinds['id']}, embedding {kinds['embedding']}, cell int") if count > 1 else rows.withColumn("cell", F.lit(0))
    dealt = dealt.repartitionByRange("block", "cell", F.xxhash64("id")).sortWithinPartitions("block", "cell", F.xxhash64("id"), "id")
    schema = f"block {kinds['block']}, centre array<double>, radius double, longest double, ids array<{kinds['id']}>, vectors binary"
    return materialize(dealt.mapInPandas(cut, schema).withColumn("tile", F.monotonically_increasing_id()), "tiles")


TILE = ["block", "centre", "radius", "longest", "ids", "vectors"]


def tile_pairs(cut: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` of tiles of one block, ``a <= b``, that may hold vectors with the inner product.

    By the triangle inequality vectors of two tiles are at least as far apart as the tiles' centres less both radii, which with
    their lengths bounds the product; the inequality of Cauchy and Schwarz bounds it by the centres' product and the radii.
    """
    side = lambda s: cut.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("tile", "centre", "radius", "longest")])
    both = side("a").join(side("b"), "block").where("tile_a <= tile_b")
    norm = lambda x: F.sqrt(cosine(x, x))
    between = norm(F.zip_with("centre_a", "centre_b", lambda x, y: x - y))
    gap = F.greatest(between - F.col("radius_a") - F.col("radius_b"), F.lit(0.0))
    by_gap = (F.pow("longest_a", F.lit(2)) + F.pow("longest_b", F.lit(2)) - F.pow(gap, F.lit(2))) / 2
    by_centres = cosine(F.col("centre_a"), F.col("centre_b")) + norm(F.col("centre_a")) * F.col("radius_b")
    by_centres = by_centres + norm(F.col("centre_b")) * F.col("radius_a") + F.col("radius_a") * F.col("radius_b")
    near = F.least(by_gap, by_centres) >= threshold - 1e-9
    return both.where(near).select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b"))


def similar_pairs(vectors: DataFrame, threshold: float, block: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of ``vectors(id, embedding, block)`` with a cosine of ``threshold`` or more within a block.

    Vectors lie in tiles around pivots; tiles that cannot hold a pair are never brought together, the others are multiplied two
    at a time, and only hits leave the task. Vectors are of unit length and one size; null ones take no part.
    """
    cut = tiles(vectors, block, tile_rows)
    kind = dict(vectors.dtypes)["id"]

    def multiply(part: pd.DataFrame) -> pd.DataFrame:
        ends = [(np.array(r.ids), np.frombuffer(r.vectors).reshape(len(r.ids), -1)) for r in part.itertuples()]
        (ia, va), (ib, vb) = ends[0], ends[-1]
        x, y = np.nonzero(va @ vb.T >= threshold - 1e-9)
        # Tiles of a pair come in either order, and one with itself has every pair twice.
        keep = ia[x] < ib[y] if len(ends) == 1 else ia[x] != ib[y]
        x, y = x[keep], y[keep]
        # Summed up from left to right, as everywhere else.
        found = np.concatenate([np.cumsum(va[x[k : k + 65_536]] * vb[y[k : k + 65_536]], axis=1)[:, -1] for k in range(0, len(x), 65_536)] or [np.zeros(0)])
        keep = found >= threshold
        a, b = ia[x][keep], ib[y][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": found[keep]})

    pairs = tile_pairs(cut, threshold)
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    ends = ends.join(cut.select("tile", "ids", "vectors"), "tile")
    return ends.groupBy("a", "b").applyInPandas(multiply, f"a {kind}, b {kind}, similarity double")


def window_pairs(items: DataFrame, hours: float) -> DataFrame:
    """Pairs of ``items(id, key, ts)`` of one key at most ``hours`` apart: an equi-join on time buckets and their neighbours."""
    width = int(hours * 3_600_000_000)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = items.select("id", "key", micros.alias("us"), F.floor(micros / width).alias("bucket"))
    a = rows.select(F.col("id").alias("a"), "key", F.col("us").alias("ua"), F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    b = rows.select(F.col("id").alias("b"), "key", F.col("us").alias("ub"), "bucket")
    return a.join(b, ["key", "bucket"]).where("a < b").where(F.abs(F.col("ua") - F.col("ub")) <= width).select("a", "b")


def postings(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(id, n, token, rank, place)``: of the distinct tokens of ``rows(id, tokens)`` those in ``tokens(token)``, from rare (rank 1) to frequent.

    A token's place counts the row's other tokens too, which stand before all of these.
    """
    every = rows.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    common = every.join(tokens, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("id")
    every = every.join(materialize(common, "common"), "token").select("id", "n", "token", F.row_number().over(own.orderBy("c", "token")).alias("rank"), F.count(F.lit(1)).over(own).alias("m"))
    return every.select("id", "n", "token", "rank", (F.col("n") - F.col("m") + F.col("rank")).alias("place"))


def compatible_pairs(articles: DataFrame, threshold: float | None = None, verdicts: DataFrame | None = None, headline: float = 0.20, entity: float = 0.15) -> DataFrame:
    """Pairs of ``articles(id, source, tokens, cues[, embedding])`` that may report one event.

    Two distinctive tokens in common, or one and two generic action words, and enough of either set. Tiles of articles meet
    in tasks that give the pairs by the rule; those that ``verdicts(a, b, same)`` decides are taken by it instead.
    """
    found = sets.compatible(articles, threshold, headline, entity)
    if verdicts is None:
        return found
    decided = verdicts.where("same is not null").select("a", "b").distinct()
    words = articles.select("id", "source", "tokens", "cues", *(["embedding"] if threshold is not None else []))
    side = lambda s: words.select(*[F.col(c).alias(s if c == "id" else f"{c}_{s}") for c in words.columns])
    p = verdicts.where("same").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    shared = F.array_union(F.array_intersect("tokens_a", "tokens_b"), F.array_intersect("cues_a", "cues_b"))
    none, distinctive = F.size(F.array_intersect("tokens_a", "tokens_b")) == 0, F.size(F.array_except(shared, t.words_in(t.GENERIC_CUES)))
    p = p.where(~((F.col("source_a") == F.col("source_b")) & (none | (distinctive < 2))))
    told = ["a", "b", t.set_overlap(F.col("tokens_a"), F.col("tokens_b")).alias("h"), t.set_overlap(F.col("cues_a"), F.col("cues_b")).alias("e")]
    told += [cosine(F.col("embedding_a"), F.col("embedding_b")).alias("similarity")] if threshold is not None else []
    return found.join(decided, ["a", "b"], "left_anti").unionByName(p.select(*told))


def dated_pairs(articles: DataFrame, threshold: float, span_hours: float) -> DataFrame:
    """:func:`compatible_pairs` of ``articles(id, source, tokens, cues, embedding, us)`` at most ``span_hours`` apart, with ``apart``: the time of
    ``a`` less that of ``b``.

    Articles without an id, a vector or a time take no part. A pair of repeated ids comes once for each two rows and each two times of theirs, as by joins.
    """
    rows = articles.where("id is not null and embedding is not null and us is not null")
    rows = rows.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("id")))
    return sets.compatible(rows, threshold, 0.20, 0.15, span_hours * 3600e6)


def related_articles(primary: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Context of cards: others of another cluster that share an anchor with a primary, by their best cosine.

    ``primary(card, id, cluster, anchors, embedding)``, ``others(id, cluster, anchors, embedding)``. Ids meet at anchors, of
    which hot ones are spread over tasks; the vectors join the distinct pairs that are left.
    """
    p = primary.select("card", F.col("id").alias("p"), F.col("cluster").alias("pc"), F.explode("anchors").alias("anchor"))
    o = materialize(others.select("id", "cluster", F.explode("anchors").alias("anchor")), "anchors")
    hits = spread_join(p, o, "anchor", "id").where("cluster <> pc").select("card", "p", "id", "anchor")
    hits = materialize(hits, "anchor-hits")
    shared = hits.groupBy("card", "id").agg(F.count_distinct("anchor").alias("shared"))
    vector = lambda df, i, v: df.select(F.col("id").alias(i), F.col("embedding").alias(v)).distinct()
    near = hits.select("card", "p", "id").distinct().join(vector(primary, "p", "pv"), "p").join(vector(others, "id", "ov"), "id")
    near = near.withColumn("s", cosine(F.col("pv"), F.col("ov"))).where(F.col("s") >= least)
    return near.groupBy("card", "id").agg(F.max("s").alias("similarity")).join(shared, ["card", "id"])


#: Expectations that are compared with the cards at once, and words whose keywords a task remembers.
EXPECTATIONS_AT_ONCE, WORDS_KNOWN = 4096, 1 << 18


class Keywords:
    """Which of a block's keywords occur in a text as substrings.

    One without a blank lies in a word of the text; a word is looked up by its stretches of the shortest keyword's length, once
    for all cards while it is remembered. The others are searched for one by one.
    """

    def __init__(self, keywords: set[str]):
        self.phrases = [k for k in keywords if " " in k or not k]
        plain = [k for k in keywords if k and " " not in k]
        self.size = min(map(len, plain), default=1)
        self.by_start: dict[str, list[str]] = {}
        for k in plain:
            self.by_start.setdefault(k[: self.size], []).append(k)
        self.known: dict[str, tuple] = {}

    def within(self, word: str) -> tuple:
        starts = {word[k : k + self.size] for k in range(len(word) - self.size + 1)}
        return tuple(k for s in starts for k in self.by_start.get(s, ()) if k in word)

    def found(self, hay: str) -> set[str]:
        out = {k for k in self.phrases if k in hay}
        if len(self.known) > WORDS_KNOWN:
            self.known.clear()
        for word in set(hay.split(" ")):
            if len(word) >= self.size:
                hits = self.known.get(word)
                if hits is None:
                    hits = self.known[word] = self.within(word)
                out.update(hits)
        return out


def expectation_hits(expectations: DataFrame, cards: DataFrame) -> DataFrame:
    """Keyword hits ``(expectation, card, hits)`` where enough of an expectation's keywords occur in a card.

    The expectations are a stated query set, compared with every card in blocks of a bounded number; a card is read once a block,
    whatever the number of keywords.
    """
    kinds = {"expectation": dict(expectations.dtypes)["expectation"], "card": dict(cards.dtypes)["card"]}
    held = materialize(expectations.select("expectation", "keywords", "min_hits").where("keywords is not null"), "expectations")
    blocks = max(1, -(-held.count() // EXPECTATIONS_AT_ONCE))
    # Never null, as a null text is an empty one; a filter would read every text once more below the shuffle.
    hay = cards.select("card", t.scorer_normal(F.col("text")).alias("hay"))
    hay = materialize(hay, "hay") if blocks > 1 else hay
    # Dealt evenly by their place in the written table, so a block holds about as many as stated.
    held = materialize(held.withColumn("block", F.ntile(blocks).over(Window.orderBy("expectation"))), "blocks") if blocks > 1 else held.withColumn("block", F.lit(1))

    def met(rows: list) -> DataFrame:
        need = [max(min(r["min_hits"], len(r["keywords"])), 1) if r["min_hits"] is not None else max(len(r["keywords"]), 1) for r in rows]
        of: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            for word in r["keywords"]:
                if word is not None:
                    of.setdefault(word, []).append(k)
        names = pa.array([r["expectation"] for r in rows], pa_type(expectations, "expectation"))

        def run(batches):
            keywords = Keywords(set(of))
            for batch in batches:
                which, at, hits = [], [], []
                for place, text in enumerate(batch.column("hay").to_pylist()):
                    count: dict[int, int] = {}
                    for word in keywords.found(text):
                        for k in of[word]:
                            count[k] = count.get(k, 0) + 1
                    for k, n in count.items():
                        if n >= need[k]:
                            which.append(k)
                            at.append(place)
                            hits.append(n)
                columns = [names.take(pa.array(which, pa.int64())), batch.column("card").take(pa.array(at, pa.int64())), pa.array(hits, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["expectation", "card", "hits"])

        return hay.mapInArrow(run, f"expectation {kinds['expectation']}, card {kinds['card']}, hits int")

    # A block's rows are bounded, so they go with the tasks.
    return reduce(DataFrame.union, [met(held.where(F.col("block") == k + 1).collect()) for k in range(blocks)])


def pa_type(rows: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(rows.schema[column].dataType)


def duplicate_cards(cards: DataFrame, least: float = 0.75) -> DataFrame:
    """Card pairs ``(a, b, overlap)`` of ``cards(id, tokens)`` whose smaller token set the other nearly contains."""
    return sets.containment_pairs(cards, least)


def coverage(wanted: DataFrame, ours: DataFrame, least: float = 0.5) -> DataFrame:
    """Per wanted row ``(id, tokens)`` its best containment in our token sets, misses included.

    Our rows are listed under those of their tokens that a wanted row has, from rare to frequent, and met at ranks 1-3, 4-15, 16-63, ... .
    The tokens that none has stand before all of these, so a row first met at a place shares none of its tokens before, which
    bounds its containment; so it is looked at only where that beats the best so far, and the search ends when no row's bound does. A
    frequent token is a late one of most rows, which end before it.
    """
    rows = materialize(ours.select("id", F.array_distinct("tokens").alias("tokens")), "ours")
    wants = materialize(wanted.select(F.col("id").alias("w"), F.array_distinct("tokens").alias("wt")), "wanted")
    best = materialize(wants.select("w", F.size("wt").alias("nw"), F.lit(0.0).alias("best")), "best")
    words = wants.select("w", F.explode("wt").alias("token"))
    every = materialize(postings(rows, materialize(words.select("token").distinct(), "wanted-tokens")), "postings")
    hot, first, then = hot_keys(every, "token"), 1, 4
    while True:
        low = best.agg(F.min("best").alias("b"), F.min("nw").alias("n")).first()
        beats = F.col("n") - F.col("place") + 1 > F.lit(low["b"] or 0.0) * F.least("n", F.lit(low["n"] or 0))
        ahead = every.where((F.col("rank") >= first) & beats)
        if low["b"] is None or ahead.isEmpty():
            break
        some = ahead.where(F.col("rank") < then).select("id", "n", "token", "place")
        met = spread_join(words, some, "token", "id", hot).join(best, "w")
        met = met.where(F.least("nw", F.col("n") - F.col("place") + 1) > F.col("best") * F.least("n", "nw")).select("w", "id").distinct()
        full = met.join(wants, "w").join(rows, "id")
        shared = F.size(F.array_intersect("wt", "tokens")) / F.least(F.size("wt"), F.size("tokens"))
        found = full.groupBy("w").agg(F.max(shared).alias("found"))
        best = best.join(found, "w", "left").select("w", "nw", F.greatest("best", F.coalesce("found", F.lit(0.0))).alias("best"))
        best, first, then = materialize(best, "best"), then, 4 * then
    return best.select("w", "best", (F.col("best") >= least).alias("covered"))
