"""Composite views over the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.functions import text as t, times, urls
from tidewire.operators import aggregates as ag, gates, grouping, models as md, pairs, ranking as rk
from tidewire.shared import materialize


#: Hours for which a day's feeds are read: a landed day is replayed whole, whenever it was landed.
REPLAYED = {"stale": 24 * 365, "fresh": 24 * 365}


def ingest(items: DataFrame, now: Column, cap: int = 40) -> DataFrame:
    """Articles of the items ``(endpoint, channel, rank, headline, link, body, published, tags)`` of healthy endpoints.

    One item per URL: the longest body, RSS before a sitemap where bodies are equally long; without tags it gets those of another channel.
    Then per host the newest ``cap``, RSS first. A missing body is empty; what is left of it after its wrapping decides the status, and an
    article without more than its headline has the headline as its text. Items without link or headline go.
    """
    ok = gates.gated_items(items, now, **REPLAYED)
    ok = ok.where((F.col("headline") != "") & F.col("link").rlike("^https?://")).withColumn("canonical_url", urls.canonical(F.col("link")))
    ok = ok.withColumns({"body": F.coalesce("body", F.lit("")), "is_rss": F.col("channel") == "rss"})
    best = [F.desc(F.length("body")), F.desc("is_rss"), "endpoint", "rank"]
    tagged = ok.where(F.size("tags") > 0)
    tags = rk.first_per(tagged, ["canonical_url"], best).select("canonical_url", F.col("tags").alias("any_tags"))
    one = rk.first_per(ok, ["canonical_url"], best).join(tags, "canonical_url", "left").withColumn("source", urls.host(F.col("link")))
    one = one.withColumn("tags", F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.coalesce("any_tags", F.expr("cast(array() as array<string>)"))))
    capped = rk.first_per(one, ["source"], [F.desc("published"), F.desc("is_rss"), "rank", "canonical_url"], cap)
    rows = capped.withColumn("told", t.strip_furniture(F.col("body"), F.col("headline")))
    status = rk.body_status(F.col("told"), F.col("headline"))
    text = F.when(F.length("told") > F.length("headline"), F.col("told")).otherwise(F.col("headline"))
    return rows.select(
        "source", "canonical_url", "headline", text.alias("main_text"), "published", "channel", "rank", "tags", status.alias("body_status"),
        rk.bucket(F.col("rank")).alias("bucket"), rk.prominence(F.col("rank"), F.col("is_rss")).alias("prominence"),
    )


def ingest_report(endpoints: DataFrame, items: DataFrame, now: Column, **limits) -> DataFrame:
    """The state of every endpoint of ``endpoints(endpoint, channel)``: ``endpoint, channel, status, newest_age_hours, item_count``.

    An endpoint from which nothing was landed is ``unreachable``; the others have the state of their newest item, and items only
    where that is ``ok``. Ages are rounded to a tenth of an hour.
    """
    report = gates.endpoint_report(items, now, **{**REPLAYED, **limits})
    rows = endpoints.join(report, "endpoint", "left")
    return rows.select(
        "endpoint", "channel", F.coalesce("status", F.lit("unreachable")).alias("status"), F.round("newest_age", 1).alias("newest_age_hours"),
        F.coalesce("accepted", F.lit(0)).alias("item_count"),
    )


def dedup(new: DataFrame, seen: DataFrame) -> DataFrame:
    """New articles whose URL is unseen, without near copies of earlier ones, and with contents not stored."""
    # As a table of its own the URLs have a size by which the optimizer chooses the join; else all texts may be shuffled for it.
    known = materialize(seen.select("canonical_url"), "seen-urls")
    rows = pairs.unseen(new.withColumn("canonical_url", urls.canonical(F.col("url"))), known, "canonical_url")
    kept = rows.join(grouping.keep_without_near_copies(rows, t.whole_text(), F.col("id")), "id", "left_semi")
    kept = kept.withColumn("content_hash", F.sha2(F.concat("headline", F.lit("\n"), "main_text"), 256))
    return pairs.unique_insert(kept, seen, ("content_hash",), "id") if "content_hash" in seen.columns else kept


def cluster_cards(articles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A card per cluster of ``articles(cluster, id, source, headline, url, publish_date)``: representative, verdict, sources."""
    lead = rk.first_per(articles, ["cluster"], [F.desc(F.length("headline")), "id"]).select("cluster", F.col("id").alias("lead_id"), "headline")
    facts = articles.groupBy("cluster").agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.max("publish_date").alias("latest"))
    told = ag.cluster_triage(articles.select("cluster", "id").join(verdicts, "id"))
    return lead.join(facts, "cluster").join(told, "cluster", "left")


def brief(cards: DataFrame, now: Column, most: int = 12) -> DataFrame:
    """The edition from cards: hard gates, ranking, diverse choice; ``(edition, id, slot)``."""
    rows = cards.withColumns({"published": F.col("latest"), "repeated": F.lit(False), "id": F.col("cluster")})
    rows = rows.where(gates.reject_reason(now).isNull()).withColumn("edition", F.lit(1))
    order = [
        F.desc(ag.rank_of("story_type", {"hard_news": 3, "routine": 1}, 0)),
        F.desc(ag.rank_of("pk_relevance", ag.RELEVANCE_RANK, 0)),
        F.desc("sources"),
        F.desc("latest"),
        "id",
    ]
    ranked = rk.numbered(rows, ["edition"], order, "place")
    families = t.acronyms(F.col("headline"))
    return rk.diverse_select(ranked.select("edition", "place", "id", "category", families.alias("families"), "sources"), most)


def publish(picks: DataFrame, cards: DataFrame, articles: DataFrame, run_at: Column) -> DataFrame:
    """Picked cards as they are published: the slot, copy, evidence and the stamp of the run.

    ``picks(id, slot)`` of ``brief``; ``cards`` of ``cluster_cards``; ``articles(id, headline, main_text)``. The snippet comes from the lead
    article without its wrapping (its headline where nothing is left); lines that a card lacks are the fixed ones of its category and first
    label. Evidence counts the card's articles and publishers. All cards of a run have its stamp, by which the newest edition is found.
    """
    rows = picks.select(F.col("id").alias("cluster"), "slot").join(cards, "cluster")
    lead = articles.select(F.col("id").alias("lead_id"), "headline", "main_text").join(rows.select("lead_id"), "lead_id", "left_semi")
    body = t.strip_furniture(F.coalesce("main_text", F.lit("")), F.coalesce("headline", F.lit("")))
    told = F.when(body == "", F.coalesce("headline", F.lit(""))).otherwise(body)
    rows = rows.join(lead.select("lead_id", t.snippet(told).alias("snippet")), "lead_id", "left")
    label = F.nullif(F.get(F.split("impact_labels", ","), F.lit(0)), F.lit(""))
    return rows.select(
        "slot", "cluster", "headline", "category", "snippet",
        F.coalesce(md.impact_copy(label), F.lit("")).alias("why_it_matters"), md.watch_copy(F.col("category")).alias("what_to_watch"),
        F.struct(F.col("sources").alias("source_count"), F.col("articles").alias("article_count"), "pk_relevance", "latest").alias("evidence"),
        run_at.cast("timestamp").alias("brief_run_at"), times.local_date(run_at.cast("timestamp")).alias("edition_date"),
    )


def feed(cards: DataFrame, articles: DataFrame, limit: int = 30) -> DataFrame:
    """Cards of the latest local date in reading order, with their sources as a sorted list."""
    names = articles.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source_names"))
    rows = cards.join(names, "cluster").where("category is not null")
    return rows.orderBy(F.desc("sources"), F.desc("latest"), "cluster").limit(limit).select("cluster", "headline", "category", "sources", "source_names")


def story(cards: DataFrame, articles: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Each card with its articles, newest first: ``cluster, card, category, role, id, source, place``.

    ``related(cluster, id, source, publish_date)`` are the cited articles of other clusters; they follow with their own places. Only
    public columns are given; a cluster without a card has no story.
    """
    columns = ["cluster", "id", "source", "publish_date"]
    rows = articles.select(*columns).withColumn("role", F.lit("relevant"))
    if related is not None:
        rows = rows.unionByName(related.select(*columns).withColumn("role", F.lit("related")))
    rows = rk.numbered(rows, ["cluster", "role"], [F.desc("publish_date"), "id"], "place")
    told = cards.select("cluster", F.col("headline").alias("card"), "category")
    return rows.join(told, "cluster").select("cluster", "card", "category", "role", "id", "source", "place")
