"""Near duplicates: ProbMinHash signatures of weighted word shingles, banding, exact verification, classes."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.llm.common import map_batches, slim
from tidewire.llm.exact_dedup import rows_of
from tidewire.operators.graph import components
from tidewire.shared import materialize

WORDS = re.compile(r"\w+")
#: Words of a shingle, the similarity that links two texts, and bands times rows of a signature.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 6
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """8-byte hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 500_000:
            self.clear()
        self[word] = got = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return got


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def place_factor(place: int) -> np.uint64:
    """An odd multiplier for each place of a word in its shingle."""
    return np.uint64((int(MIX) * (2 * place + 1)) & 0xFFFFFFFFFFFFFFFF | 1)


def shingle_hashes(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of ``size`` words; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    known = word_hashes()
    codes = np.frombuffer(b"".join([known[w] for w in words]), np.uint64)
    size = min(size, len(codes))
    n = len(codes) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out += codes[k : k + n] * place_factor(k)
    return mix(out)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """ProbMinHash signatures of weighted sets, a row of ``slots`` element hashes each.

    ``elements`` are distinct within a set, ``sets`` names the set of each. Every element is a Poisson
    process whose rate is its weight; each arrival falls in a random slot, and a slot keeps the element of
    its earliest arrival. Two weighted sets agree in a slot with their probability Jaccard similarity.
    Elements advance together, an arrival a round; one whose last arrival is later than the earliest ones of
    all slots of its set can change nothing any more and ends.
    """
    best = np.full(n_sets * slots, np.inf)
    owner = np.zeros(n_sets * slots, np.uint64)
    alive, rate, base = elements, 1.0 / weights, sets.astype(np.intp) * slots
    at, draw = np.zeros(len(alive)), alive
    limit = np.full(n_sets, np.inf)
    while len(alive):
        draw = mix(draw + MIX)
        at = at - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) * rate
        place = base + (mix(draw ^ MIX) % np.uint64(slots)).astype(np.intp)
        np.minimum.at(best, place, at)
        won = at == best[place]
        owner[place[won]] = alive[won]
        own = base // slots
        live = np.unique(own)
        limit[live] = best.reshape(n_sets, slots)[live].max(axis=1)
        go = at < limit[own]
        alive, rate, base, at, draw = alive[go], rate[go], base[go], at[go], draw[go]
    return owner.reshape(n_sets, slots)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of each signature, different from band to band."""
    parts = signatures.reshape(len(signatures), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for k in range(rows):
        out = mix(out + parts[:, :, k] + MIX)
    return out.astype(np.int64)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def signed_bands(texts_words: list[list[str]], size: int, bands: int, rows: int) -> list[tuple[int, np.ndarray]]:
    """For each word list the number of distinct shingles and the band keys (without words: none).

    A shingle that occurs c times weighs 1 + ln c. Links compare plain sets, which weights may make look unlike, so
    a text that repeats a shingle also has the bands of its plain set, where they differ. Weights of 1 give both
    signatures alike: any two texts meet by the bands of their plain sets, whatever they repeat.
    """
    found = [np.unique(shingle_hashes(words, size), return_counts=True) for words in texts_words]
    full = [k for k, (shingles, _) in enumerate(found) if len(shingles)]
    out = [(0, np.zeros(0, np.int64))] * len(found)

    def keys_of(at: list[int], weigh) -> np.ndarray:
        elements = np.concatenate([found[k][0] for k in at])
        weights = weigh(np.concatenate([found[k][1] for k in at]))
        sets = np.repeat(np.arange(len(at)), [len(found[k][0]) for k in at])
        return band_keys(prob_minhash(elements, weights, sets, len(at), bands * rows), bands, rows)

    if full:
        for k, own in zip(full, keys_of(full, lambda counts: 1.0 + np.log(counts))):
            out[k] = len(found[k][0]), own
    repeating = [k for k in full if found[k][1].max() > 1]
    if repeating:
        for k, plain in zip(repeating, keys_of(repeating, lambda counts: np.ones(len(counts)))):
            out[k] = out[k][0], np.union1d(out[k][1], plain)
    return out


SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_crc", pa.int64()),
        ("words_key", pa.binary()),
        ("n_shingles", pa.int64()),
        ("bands", pa.list_(pa.int64())),
    ]
)
SETS = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])
#: Rows whose words and shingles are held at once.
TEXTS_AT_ONCE = 200
#: Rounds in which every bucket has one leader; what they leave open is settled by prefixes.
STAR_ROUNDS = 2
#: A key is hot if it has more than its share of rows when all rows are cut into so many parts; so fewer keys are hot.
HOT_PARTS, LEAST_PART = 4096, 256
#: Cells in which shingles are counted to order them from rare to frequent.
CELLS = 65_536
#: Keeps a ratio that equals the threshold on the right side of it.
EDGE = 1e-9


def signatures(docs: DataFrame, size: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_crc, words_key, n_shingles, bands``: the digest of the word sequence, and the band keys."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, fresh = [], {}
        texts = batch.column("text").to_pylist()
        for text in texts:
            words = words_of(text)
            keys.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            fresh.setdefault(keys[-1], words)
        made = dict(zip(fresh, signed_bands(list(fresh.values()), size, bands, rows)))
        counts, own = zip(*(made[k] for k in keys)) if keys else ((), ())
        crcs = [zlib.crc32(t.encode()) for t in texts]
        return {"doc_id": batch.column("doc_id"), "text_crc": crcs, "words_key": keys, "n_shingles": counts, "bands": list(own)}

    return slim(docs, id_col, text_col).mapInArrow(
        map_batches(run, SIGNED, TEXTS_AT_ONCE), "doc_id long, text_crc long, words_key binary, n_shingles long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, involved: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(node, shingles)`` of the documents in ``involved(doc_id, node)``: the distinct shingle hashes."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(words_of(t), size)) for t in batch.column("text").to_pylist()]
        return {"node": batch.column("node"), "shingles": [x.astype(np.int64) for x in sets]}

    texts = slim(docs, id_col, text_col).join(involved, "doc_id").select("node", "text")
    return texts.mapInArrow(map_batches(run, SETS, TEXTS_AT_ONCE), "node binary, shingles array<long>").dropDuplicates(["node"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b, ...)`` with the exact Jaccard ``similarity`` of their shingle sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    all_ = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").select(*pairs.columns, (both / all_).alias("similarity"))


def linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs(a, b, ...)`` those whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    return compared(pairs, sets).where(F.col("similarity") >= similarity - EDGE).drop("similarity")


def comparable(a: str, b: str, similarity: float) -> Column:
    """Set sizes whose ratio allows the similarity."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return low >= F.lit(similarity - EDGE) * high


def with_heads(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """``rows(key, node, ...)`` joined with ``heads(key, in_bucket, ...)``, one row per key that counts its rows.

    The rows of a hot key are dealt over several tasks by their node, and its head is sent to each. What is
    broadcast are the hot keys: their rows are more than a share of all rows, so there are fewer than ``HOT_PARTS``.
    """
    total = heads.agg(F.sum("in_bucket").alias("n")).first()["n"] or 0
    most = max(LEAST_PART, -(-total // HOT_PARTS))
    parts = F.ceil(F.col("in_bucket") / most).cast("int")
    hot = heads.where(F.col("in_bucket") > most).select(key, parts.alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(hot), key, "left").withColumn("part", part).drop("parts")
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return rows.join(heads, [key, "part"]).drop("part", "in_bucket")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels(node, label)`` after the labels that ``edges(a, b)`` link have become one."""
    edges = materialize(edges.select("a", "b").distinct(), "label-links")
    if edges.isEmpty():
        return labels
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b"))
    new = components(ends, edges).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return materialize(labels.join(new, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, kept``.

    Documents whose sets of word shingles have a Jaccard similarity of ``similarity`` or more are linked;
    linked documents form a class, named by its smallest id, and that document is kept. Words are runs of
    letters, digits and underscores in lower case; a text of fewer than ``size`` words is one shingle of them
    all; texts without words (null, empty) equal each other. Texts with one word sequence are one node, so
    exact copies are never paired. Repeated rows belong to their id's class, each with a row; null ids get a
    class of their word sequence whose id is null if no row of it has one. Other columns are not read.

    Candidates share a band of their signatures, weighted or plain. Twice, every bucket of a band has a leader with
    which its members of other classes are compared. First the leader is the text of the least hash, so a class of
    copies meets the same one in most of its buckets and gives about one link a text; then each bucket draws its own. Buckets that still hold
    several classes, such as texts around one shared passage, are settled by their rarest shingles (see
    :func:`prefix_links`), so no candidate link is lost and no bucket is compared all with all. Every comparison is exact.
    """
    return _classed(docs, id_col, text_col, size, similarity, bands, rows).drop("text_crc")


def _classed(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    size: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """As :func:`near_classes`, with the CRC-32 of each row's own text."""
    signed = materialize(signatures(docs, size, bands, rows, id_col, text_col), "signatures")
    nodes = signed.groupBy(F.col("words_key").alias("node")).agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    nodes = materialize(nodes, "nodes")
    members = nodes.select("node", "rep", "n", F.explode("bands").alias("band"))
    lead = lambda key, *more: F.min(F.struct(F.xxhash64(*key), "node", "n", *more)).alias("lead")
    heads = members.groupBy("band").agg(lead(["node"]), F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    heads = heads.select("band", "in_bucket", F.col("lead.node").alias("a"), F.col("lead.n").alias("na"))
    state = materialize(with_heads(members, materialize(heads, "heads"), "band"), "buckets")
    involved = state.where("rep is not null").select(F.col("rep").alias("doc_id"), "node").distinct()
    sets = materialize(shingle_sets(docs, involved, size, id_col, text_col), "shingle-sets")
    pairs = state.where(F.col("a") != F.col("node")).where(comparable("n", "na", similarity))
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    labels = components(nodes.select("node"), materialize(linked(pairs, sets, similarity), "links"))
    labels = materialize(labels, "labels")

    for k in range(1, STAR_ROUNDS + 1):
        # A leader has been compared with its whole bucket and leaves it.
        state = state.where("node <> a").select("band", "node", "n").join(labels, "node")
        state = materialize(state, "open-buckets")
        heads = state.groupBy("band").agg(
            lead([F.lit(k), "band", "node"], "label"), F.count(F.lit(1)).alias("in_bucket"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        heads = heads.where("lo <> hi").select(
            "band", "in_bucket", F.col("lead.node").alias("a"), F.col("lead.n").alias("na"), F.col("lead.label").alias("la")
        )
        state = materialize(with_heads(state, materialize(heads, "heads"), "band"), "buckets")
        if state.isEmpty():
            break
        if k < STAR_ROUNDS:
            pairs = state.where("label <> la").where(comparable("n", "na", similarity))
            pairs = pairs.select("a", F.col("node").alias("b"), "la", F.col("label").alias("lb")).dropDuplicates(["a", "b"])
            edges = linked(pairs, sets, similarity).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        else:
            edges = prefix_links(state.select("node", "n", "label").distinct(), sets, similarity)
        labels = relabelled(labels, edges)
    return _classes(signed, labels)


COUNTS = pa.schema([("cell", pa.int32()), ("c", pa.int64())])
PREFIXES = pa.schema(
    [("node", pa.binary()), ("label", pa.binary()), ("n", pa.int64()), ("rare", pa.list_(pa.int64())), ("indexed", pa.int64())]
)
#: Tasks over which the members of one class are compared with those of others.
SPREAD = 16


def prefixes(held: DataFrame, similarity: float) -> DataFrame:
    """``(node, label, n, rare, indexed)``: the rarest shingles of each of ``held(node, label, n, shingles)``.

    All sets are put into one order, from rare to frequent. Of two sets with the similarity, the larger has a
    common shingle among its first n - ceil(s n) + 1, which are ``rare``, and the smaller has it among its first
    n - ceil(2 s n / (1 + s)) + 1, which are the first ``indexed`` of them. Any order would do; frequencies are counted
    in ``CELLS`` cells of the hashes, so what the driver collects and broadcasts is bounded, and shingles that
    many texts share come late all the same.
    """

    def count(batches):
        for batch in batches:
            cells = batch.column("shingles").values.to_numpy() % CELLS
            cell, c = np.unique(cells, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(c, pa.int64())], schema=COUNTS)

    counts = np.zeros(CELLS, np.int64)
    for row in held.select("shingles").mapInArrow(count, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).collect():
        counts[row["cell"]] = row["c"]
    frequency = held.sparkSession.sparkContext.broadcast(counts)

    def first(batch: pa.RecordBatch) -> dict:
        rare, indexed = [], []
        for shingles in batch.column("shingles"):
            shingles = shingles.values.to_numpy()
            n = len(shingles)
            rare.append(shingles[np.lexsort((shingles, frequency.value[shingles % CELLS]))[: n - int(np.ceil(similarity * n - EDGE)) + 1]])
            indexed.append(n - int(np.ceil(2 * similarity * n / (1 + similarity) - EDGE)) + 1)
        return {**{c: batch.column(c) for c in ("node", "label", "n")}, "rare": rare, "indexed": indexed}

    held = held.select("node", "label", F.col("n").cast("long").alias("n"), "shingles")
    return held.mapInArrow(map_batches(first, PREFIXES, TEXTS_AT_ONCE), "node binary, label binary, n long, rare array<long>, indexed long")


def prefix_links(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` between the labels of ``nodes(node, n, label)`` that hold linked texts; all of them are found.

    Linked texts share a rare shingle (see :func:`prefixes`). What meets at a shingle are classes, not texts:
    the two label texts are compared once, and since 1 - Jaccard is a metric, their distance less the distances of
    two members from their labels bounds the members' distance from below. Members of two classes are looked at only where this
    leaves room, that is between classes that nearly touch, and paired only where their rarest shingles leave room too.
    """
    held = materialize(sets.join(nodes, "node").select("node", "label", "n", "shingles"), "open-sets")
    texts = materialize(prefixes(held, similarity), "prefixes")
    rare = texts.select("node", "label", "n", "indexed", F.posexplode("rare").alias("place", "shingle"))
    rare = rare.select("shingle", "node", "label", "n", (F.col("place") < F.col("indexed")).alias("indexed"))
    heads = rare.groupBy("shingle").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("indexed").alias("any"), F.count(F.lit(1)).alias("in_bucket")
    )
    heads = materialize(heads.where("lo <> hi and any").select("shingle", "in_bucket"), "heads")
    at = with_heads(rare, heads, "shingle").groupBy("shingle", "label").agg(
        F.max("indexed").alias("indexed"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    at = materialize(at, "shared-prefixes")
    side = lambda df, s: df.select([F.col(c).alias(c if c == "shingle" else f"{c}_{s}") for c in df.columns])
    ratio = F.lit(similarity - EDGE)
    sizes = (F.col("most_a") >= ratio * F.col("least_b")) & (F.col("most_b") >= ratio * F.col("least_a"))
    meet = side(at, "a").join(side(at, "b"), "shingle").where("label_a < label_b and (indexed_a or indexed_b)").where(sizes)
    meet = meet.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    meet = materialize(compared(meet, sets).select("a", "b", (1 - F.col("similarity")).alias("apart")), "class-pairs")
    most = 1 - similarity + EDGE
    links = meet.where(F.col("apart") <= most).select("a", "b")

    away = compared(held.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), sets)
    away = away.select(F.col("a").alias("node"), (1 - F.col("similarity")).alias("away"))
    texts = texts.join(away, "node", "left").withColumn("away", F.coalesce("away", F.lit(0.0)))
    texts = materialize(texts, "distances")
    reach = texts.groupBy("label").agg(F.max("away").alias("far"), F.count(F.lit(1)).alias("c"))
    reach = materialize(reach, "classes")
    # Of two classes the smaller one's members come to the larger one's.
    far = lambda s: side(reach, s).withColumnRenamed(f"label_{s}", s)
    open_ = meet.where(F.col("apart") > most).join(far("a"), "a").join(far("b"), "b")
    open_ = open_.where("c_a > 1 or c_b > 1").where(F.col("apart") - F.col("far_a") - F.col("far_b") <= most)
    turned = F.col("c_a") > F.col("c_b")
    small, large = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    left = F.when(turned, F.col("far_a")).otherwise(F.col("far_b"))
    open_ = open_.select(small.alias("label_a"), large.alias("label_b"), "apart", left.alias("far"))
    part = F.pmod(F.xxhash64("node_a"), F.lit(SPREAD)).cast("int")
    guests = open_.join(side(texts, "a"), "label_a").where(F.col("apart") - F.col("away_a") - F.col("far") <= most)
    hosts = texts.join(open_.select(F.col("label_b").alias("label")).distinct(), "label", "left_semi")
    hosts = side(hosts, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    # What two sets share lies in both prefixes, or behind the prefix of one of them.
    behind = lambda s: F.col(f"n_{s}") - F.size(f"rare_{s}")
    bound = F.size(F.array_intersect("rare_a", "rare_b")) + F.greatest(behind("a"), behind("b"))
    needed = (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - EDGE
    both = guests.withColumn("part", part).join(hosts, ["label_b", "part"])
    both = both.where(F.col("apart") - F.col("away_a") - F.col("away_b") <= most).where(comparable("n_a", "n_b", similarity)).where(bound >= needed)
    both = both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "label_a", "label_b")
    more = linked(both, sets, similarity).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return links.union(more)


def _classes(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """Class, size and survivor of each document from the class label of its word sequence."""
    ids = signed.groupBy("words_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c"))
    ids = materialize(ids.join(labels, F.col("words_key") == F.col("node")), "node-classes")
    named = ids.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("c").alias("class_size"))
    told = materialize(ids.select("words_key", "label").join(named, "label"), "class-names")
    out = signed.select("doc_id", "text_crc", "words_key").join(told, "words_key")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "text_crc", "class_id", "class_size", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents of which each class keeps one, all columns kept; of rows that repeat an id one stays.

    Rows without an id stay where no row of their class has one.
    """
    kept = _classed(docs, id_col, text_col, **how)
    # Of a kept id's rows with different texts one text stays; rows without an id have nothing in common.
    one = Window.partitionBy("class_id", "doc_id").orderBy("text_crc")
    kept = kept.where("kept").withColumn("_first", F.min("text_crc").over(one))
    return rows_of(docs, kept.where("text_crc = _first or doc_id is null"), id_col, text_col)
