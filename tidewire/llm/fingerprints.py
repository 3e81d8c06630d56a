"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.llm.common import bound, slim

#: Runs of up to eight words of a line: the finest nodes, by which two texts' trees are compared.
SEGMENT = r"(?:[^ \n]+ *){1,8}"
#: Documents that a range of neighbours holds on average, and ranges at most.
RANGE_ROWS, MOST_RANGES = 64, 65_536
NO_ID = -(2**63)


def tree_of(text: Column) -> Column:
    """The Merkle tree of a text: ``root``, ``sections`` and ``paragraphs`` (SHA-256, hexadecimal), ``segments``.

    Blank lines part sections, newlines part paragraphs. A section's digest covers its paragraphs' digests
    in order, the root those of the sections, so roots are equal exactly for equal texts. ``paragraphs`` has
    an array per section; ``segments`` has the distinct hashes of the runs of words within paragraphs.
    """
    paragraphs = F.transform(
        F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.sha2(p, 256))
    )
    sections = F.transform(paragraphs, lambda ps: F.sha2(F.array_join(ps, ","), 256))
    segments = F.transform(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)), lambda s: F.xxhash64(s))
    return F.struct(
        F.sha2(F.array_join(sections, ","), 256).alias("root"),
        sections.alias("sections"),
        paragraphs.alias("paragraphs"),
        F.array_distinct(segments).alias("segments"),
    )


def likeness(a: Column, b: Column) -> Column:
    """Of two trees, 1 for equal roots, else twice the common segments over both trees' segments."""
    common = F.size(F.array_intersect(a["segments"], b["segments"])).cast("double")
    all_ = F.size(a["segments"]) + F.size(b["segments"])
    return F.when(a["root"] == b["root"], 1.0).when(all_ == 0, 0.0).otherwise(2 * common / all_)


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first difference of two digest arrays; null if they are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(at > 0, (at - 1).cast("int"))


def locate(a: Column, b: Column) -> tuple[Column, Column]:
    """Section and paragraph (from 0) of the first difference of two trees, found by walking down from the root."""
    section = first_difference(a["sections"], b["sections"])
    mine = F.coalesce(F.get(a["paragraphs"], section), F.array())
    theirs = F.coalesce(F.get(b["paragraphs"], section), F.array())
    return section, F.when(section.isNotNull(), first_difference(mine, theirs))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tree`` of every whole text; a null text counts as empty, repeated rows stay, no shuffle."""
    return slim(docs, id_col, text_col).select("doc_id", tree_of(F.col("text")).alias("tree"))


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``next_text``: the text of the document with the next smaller id, after the smallest the largest's.

    Ids are cut at quantiles into ranges of about ``RANGE_ROWS`` documents, a window per range finds the
    neighbour, and the largest document of each range also visits the next range as the neighbour of its
    smallest one. So the texts are shuffled once and no task sees more than a few ranges. Rows that
    repeat an id are ordered by a hash of their text and share a range. Null ids come after all others, by a hash of their text
    that stands for an id below the smallest, so they fill ranges like ids do. Beyond ``MOST_RANGES`` ranges, which bound
    what the driver sends out, ranges hold more rows; a range is sorted and read in a stream that spills, so it may be large.
    """
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("named"), F.min("doc_id").alias("least")).first()
    least = facts["least"] if facts["least"] is not None else 0
    room = min(2**62, least - NO_ID)
    below = F.lit(least - 1) - F.pmod(F.xxhash64("text"), F.lit(room)) if room else F.lit(NO_ID)
    keyed = docs.withColumn("key", F.coalesce("doc_id", below) if facts["named"] < facts["n"] else F.col("doc_id"))
    ranges = max(1, min(MOST_RANGES, facts["n"] // RANGE_ROWS))
    at = ",".join(str((k + 1) / ranges) for k in range(ranges))
    rough = F.expr(f"percentile_approx(key, cast(split('{at}', ',') as array<double>), {max(10_000, 10 * ranges)})").alias("cuts")
    # Quantiles are rounded; a range ends at the largest key that it has.
    rough = sorted(set(keyed.agg(rough).first()["cuts"] or [0]))
    cuts = keyed.groupBy(_place_of("key", rough).alias("range")).agg(F.max("key").alias("end")).collect()
    cuts = sorted(r["end"] for r in cuts) or [0]
    last = cuts[-1]
    keyed = keyed.withColumn("range", _place_of("key", cuts))
    is_end = F.col("key") == F.get(_longs(cuts), F.col("range"))
    places = F.array(
        F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")),
        F.when(is_end, F.struct((F.col("range") + 1).alias("range"), F.lit(1).alias("guest"))),
        F.when(F.col("key") == F.lit(last), F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest"))),
    )
    placed = keyed.select("doc_id", "text", "key", F.explode(F.array_compact(places)).alias("place"))
    order = [F.col("place.guest") == 2, F.col("key").desc(), F.xxhash64("text")]
    near = Window.partitionBy("place.range").orderBy(*order)
    placed = placed.withColumn("next_text", F.lead("text").over(near))
    return placed.where("place.guest = 0").select("doc_id", "text", "next_text")


def _place_of(key: str, cuts: list[int]) -> Column:
    """How many cuts are below the key, by way of every so manieth of them."""
    step = max(1, int(len(cuts) ** 0.5))
    ends = _longs([cuts[min(k + step, len(cuts)) - 1] for k in range(0, len(cuts), step)])
    coarse = F.size(F.filter(ends, lambda c: c < F.col(key))) * step
    return bound(coarse, lambda k: k + F.size(F.filter(F.slice(_longs(cuts), k + 1, F.lit(step)), lambda c: c < F.col(key))))


def _longs(values: list[int]) -> Column:
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half comes from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and the first
    ``changed_section`` and ``changed_paragraph`` (null: no change). The last floor(n_chars / 2) code points
    are replaced by the first as many of the next document's text, or all of a shorter one. A null or empty
    text has the fingerprint of the empty text. A single document is its own neighbour; an empty table gives
    an empty table.
    """
    near = with_next(slim(docs, id_col, text_col))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    rows = near.select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        tree_of(F.col("text")).alias("tree"),
        tree_of(F.col("edited")).alias("edited_tree"),
        tree_of(F.col("next_text")).alias("next_tree"),
    )
    section, paragraph = locate(F.col("tree"), F.col("edited_tree"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        section.alias("changed_section"),
        paragraph.alias("changed_paragraph"),
    )
