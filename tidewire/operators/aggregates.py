"""Aggregations over groups: vectors, verdicts, consensus, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.functions.text import brief_flags
from tidewire.functions.times import age_hours


def vector_sums(members: DataFrame, group: str) -> DataFrame:
    """Per group the number of vectors and the sum of each dimension: ``(group, n, dim, s)``, combined map-side."""
    flat = members.select(group, F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy(group, "dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s"))


def centroids(members: DataFrame, group: str) -> DataFrame:
    """``(group, n, centroid)``: the normalised mean vector; an array of one small row per dimension."""
    sums = vector_sums(members, group)
    rows = sums.groupBy(group).agg(
        F.max("n").alias("n"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("v")
    )
    unit = F.transform("v", lambda x: F.when(F.col("norm") > 0, x["s"] / F.col("norm")).otherwise(x["s"]))
    return rows.select(group, "n", unit.alias("centroid"))


def intra_similarity(members: DataFrame, group: str) -> DataFrame:
    """Mean pairwise cosine of unit vectors, from the length of their sum; 1 for a single member."""
    sums = vector_sums(members, group).groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return sums.select(group, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def member_similarity(members: DataFrame, group: str) -> DataFrame:
    """Each member's cosine to its group's centroid; centroids are one row per group."""
    dot = F.aggregate(F.zip_with("embedding", "centroid", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return members.join(centroids(members, group).select(group, "centroid"), group).withColumn("to_centroid", dot).drop("centroid")


def consensus(mentions: DataFrame, ratio: float = 0.66, most: int = 8) -> DataFrame:
    """Entities by agreement: of ``mentions(cluster, article, key, text)`` the articles per key and whether confirmed.

    An entity is confirmed when at least ``ceil(ratio * articles)`` of its cluster name it; the text with most
    capitals stands for it. Per cluster and side the ``most`` best by count, then text.
    """
    sizes = mentions.groupBy("cluster").agg(F.countDistinct("article").alias("n"))
    caps = F.length(F.regexp_replace("text", "[^A-Z]", ""))
    each = mentions.groupBy("cluster", "key").agg(
        F.countDistinct("article").alias("sources"), F.max(F.struct(caps.alias("c"), F.col("text").alias("t"))).alias("best")
    )
    rows = each.join(sizes, "cluster").withColumn("confirmed", F.col("sources") >= F.ceil(F.lit(ratio) * F.col("n")))
    place = F.row_number().over(Window.partitionBy("cluster", "confirmed").orderBy(F.desc("sources"), "key"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("cluster", "key", F.col("best.t").alias("text"), "sources", "confirmed")


RELEVANCE_RANK = {"national": 3, "local": 2, "foreign_with_pk_effect": 1, "foreign": 0}


def rank_of(column: str, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, value in ranks.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def cluster_triage(verdicts: DataFrame, group: str = "cluster") -> DataFrame:
    """One verdict per group of ``verdicts(group, category, impact_label, story_type, pk_relevance, confidence)``.

    Category and labels by summed confidence, 0.1 at least a row, ties by name; any hard news makes hard news;
    the most national relevance counts.
    """
    weight = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.1))
    rows = verdicts.withColumn("w", weight)
    first = Window.partitionBy(group).orderBy(F.desc(F.round("w", 9)), "category")
    category = rows.groupBy(group, "category").agg(F.sum("w").alias("w")).withColumn("r", F.row_number().over(first)).where("r = 1")
    by_label = Window.partitionBy(group).orderBy(F.desc(F.round("w", 9)), "impact_label")
    labels = rows.groupBy(group, "impact_label").agg(F.sum("w").alias("w")).withColumn("r", F.row_number().over(by_label)).where("r <= 3")
    labels = labels.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "impact_label"))), lambda x: x["impact_label"]), ",").alias("impact_labels"))
    rest = rows.groupBy(group).agg(
        F.avg("confidence").alias("confidence"),
        F.when(F.bool_or(F.col("story_type") == "hard_news"), "hard_news").otherwise(F.min("story_type")).alias("story_type"),
        F.max_by("pk_relevance", rank_of("pk_relevance", RELEVANCE_RANK, -1)).alias("pk_relevance"),
        F.count(F.lit(1)).alias("verdict_count"),
    )
    return category.select(group, "category").join(labels, group).join(rest, group)


def topline(articles: DataFrame, group: str = "cluster") -> DataFrame:
    """Publisher prominence of a group of ``articles(group, source, prominence, bucket)``: summed maxima up to 42."""
    points = rank_of("bucket", {"lead": 4, "topline": 3, "secondary": 2}, 1)
    each = articles.groupBy(group, "source").agg(F.max("prominence").alias("top"), F.sum(points).alias("b"))
    return each.groupBy(group).agg(
        F.least(F.sum("top"), F.lit(42)).alias("score"),
        F.count_if(F.col("top") >= 18).alias("lead_sources"),
        F.count_if(F.col("top") >= 10).alias("prominent_sources"),
        F.sum("b").alias("bucket_score"),
    )


def partition_quality(rows: DataFrame, ours: str, truth: str) -> DataFrame:
    """Members of our groups that span events, and of events that span our groups."""
    merged = rows.groupBy(ours).agg(F.countDistinct(truth).alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1")
    split = rows.groupBy(truth).agg(F.countDistinct(ours).alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1")
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name))
    # Both sides are one row.
    return total(merged, "merged_in").join(F.broadcast(total(split, "split_apart")))


def service_health(beats: DataFrame, cards: DataFrame, now: Column, within: float = 28) -> DataFrame:
    """Freshness, first matching reason and verdict per service, from its last heartbeat, else from its newest card.

    ``beats(service, last_run_at, success_at, publication, editorial, story_analysis, embedding, triage, calls, selected)`` are runs,
    of which the last one counts; ``cards(service, created_at)``. A missing stage status is ``unknown`` and degrades nothing; a time in
    the future has the age 0; a service without any time is stale. Returns ``service, status, reason, signal, age_hours,
    pipeline_is_stale, calls, selected``.
    """
    stages = ["publication", "editorial", "story_analysis", "embedding", "triage"]
    beat = F.struct("last_run_at", "success_at", *stages, "calls", "selected")
    last = beats.groupBy("service").agg(F.max_by(beat, "last_run_at").alias("b")).select("service", "b.*")
    newest = cards.groupBy("service").agg(F.max("created_at").alias("newest"))
    rows = last.join(newest, "service", "full_outer").withColumns({s: F.coalesce(s, F.lit("unknown")) for s in stages})
    signal = F.when(F.col("success_at").isNotNull(), "heartbeat").when(F.col("newest").isNotNull(), "latest_card").otherwise("none")
    age = age_hours(F.coalesce("success_at", "newest"), now)
    age = F.when(age < 0, 0.0).otherwise(age)
    rows = rows.withColumns({"signal": signal, "age_hours": age})
    rows = rows.withColumn("pipeline_is_stale", F.coalesce(F.col("age_hours") >= within, F.lit(True)))
    bad = {"story_analysis": ("partial", "unavailable"), "embedding": ("unavailable", "degraded"), "triage": ("unavailable", "degraded")}
    reason = F.when(F.col("publication") == "failed", "publication_failed").when(F.col("editorial") == "unavailable", "editorial_unavailable")
    for stage, states in bad.items():
        reason = reason.when(F.col(stage).isin(*states), F.concat_ws("_", F.lit(stage), stage))
    age_word = F.when(F.col("pipeline_is_stale"), "stale").otherwise("fresh")
    reason = reason.when(F.col("signal") == "none", "no_signal").otherwise(F.concat_ws("_", "signal", age_word))
    degraded = F.col("pipeline_is_stale") | (F.col("publication") == "failed") | F.col("editorial").isin("unavailable", "degraded")
    for stage, states in bad.items():
        degraded = degraded | F.col(stage).isin(*states)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        "service", F.when(degraded, "degraded").otherwise("ok").alias("status"), reason.alias("reason"), "signal", "age_hours",
        "pipeline_is_stale", count("calls"), count("selected"),
    )


def omissions(candidates: DataFrame, published: DataFrame, notes: DataFrame, least: int = 4) -> DataFrame:
    """What an edition left out and what it took instead: ``edition, kind, id, sources, reason, passed_over``.

    ``candidates(edition, id, sources, relevance, headline)``, ``published(edition, id)``, ``notes(edition, note)`` with notes such as
    ``id: reason``. Kind ``omitted``: a national candidate of ``least`` sources or more that is not published, with its stated reason,
    "(no reason given)" for an empty one and ``unaccounted`` without a note. Kind ``thin``: a published card of fewer sources in an
    edition that dropped a national candidate, with the two best dropped ones of more sources than its own. Null sources count as 0.
    """
    rows = candidates.withColumn("sources", F.coalesce("sources", F.lit(0)))
    national = F.col("relevance") == "national"
    dropped = rows.where(national).join(published.select("edition", "id"), ["edition", "id"], "left_anti")
    part = F.split("note", ":", 2)
    text = F.trim(F.coalesce(F.get(part, F.lit(1)), F.lit("")))
    stated = notes.select("edition", F.trim(part[0]).alias("_id"), F.when(text == "", "(no reason given)").otherwise(text).alias("reason"))
    stated = stated.groupBy("edition", "_id").agg(F.max("reason").alias("reason"))
    left = dropped.where(F.col("sources") >= least).withColumn("_id", F.col("id").cast("string")).join(stated, ["edition", "_id"], "left")
    omitted = left.select("edition", F.lit("omitted").alias("kind"), "id", "sources", F.coalesce("reason", F.lit("unaccounted")).alias("reason"))
    # The best two of an edition decide for all of its thin cards, so no card meets every dropped candidate.
    head = F.substring(F.trim(F.coalesce("headline", F.lit(""))), 1, 70)
    best = dropped.select("edition", F.struct(F.col("sources").alias("n"), head.alias("head"), "id").alias("c"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("c")))).where("r <= 2")
    best = best.groupBy("edition").agg(F.sort_array(F.collect_list("c"), asc=False).alias("best"))
    thin = rows.where(F.col("sources") < least).join(published.select("edition", "id").distinct(), ["edition", "id"]).join(best, "edition")
    better = F.transform(F.filter("best", lambda c: c["n"] > F.col("sources")), lambda c: F.concat(c["n"].cast("string"), F.lit("-source "), c["head"]))
    thin = thin.select("edition", F.lit("thin").alias("kind"), "id", "sources", F.array_join(better, "; ").alias("passed_over"))
    return omitted.unionByName(thin, True)


def impact_lines(cards: DataFrame, impact: Column, headline: Column, restates: float) -> DataFrame:
    """One row: the impact lines of ``cards`` that are not blank, and how many restate their headline, lack an anchor, hedge or have the stock form.

    A line restates its headline by a share of ``restates`` of its words. A blank line has no fault.
    """
    flags = cards.select((F.trim(impact) != "").alias("line"), *[c.alias(k) for k, c in brief_flags(impact, headline).items()])
    return flags.agg(
        F.count_if("line").alias("impact_lines"),
        F.count_if(F.round("restates", 6) >= restates).alias("restating"),
        F.count_if("lacks_anchor").alias("lacking_anchor"),
        F.count_if("hedged").alias("hedged"),
        F.count_if("stock_form").alias("stock_form"),
    )
