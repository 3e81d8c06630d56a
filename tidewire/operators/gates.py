"""Filters, gates and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.functions import urls
from tidewire.functions.times import age_hours


def endpoint_report(items: DataFrame, now: Column, stale: float = 48, future: float = -1, fresh: float = 36) -> DataFrame:
    """Per endpoint of ``items(endpoint, published)``: status, newest age in hours, items young enough.

    Ages cover all dated items; an endpoint whose newest one is older than ``stale`` hours or younger than
    ``future`` is shut, and so is one without dates. A null endpoint is one of its own.
    """
    age = age_hours(F.col("published"), now)
    report = items.groupBy("endpoint").agg(
        F.min(age).alias("newest_age"), F.count(F.lit(1)).alias("n_items"), F.count_if(age <= fresh).alias("n_fresh")
    )
    status = (
        F.when(F.col("newest_age").isNull(), "no-dates")
        .when(F.col("newest_age") > stale, "STALE")
        .when(F.col("newest_age") < future, "future-clock")
        .otherwise("ok")
    )
    report = report.withColumn("status", status)
    return report.withColumn("accepted", F.when(F.col("status") == "ok", F.col("n_fresh")).otherwise(F.lit(0)))


def gated_items(items: DataFrame, now: Column, **limits) -> DataFrame:
    """Items of endpoints in order that are young enough; the report is a row per endpoint and joins by key."""
    ok = endpoint_report(items, now, **limits).where("status = 'ok'").select("endpoint")
    return items.join(ok, "endpoint", "left_semi").where(age_hours(F.col("published"), now) <= limits.get("fresh", 36))


def reject_reason(now: Column) -> Column:
    """Why a candidate of ``category, story_type, pk_relevance, published, repeated`` is not publishable; null if it is."""
    return (
        F.when(F.col("category").isin("sports", "entertainment"), "category")
        .when(F.col("story_type").isin("advertorial", "opinion"), "story_type")
        .when(F.col("pk_relevance") == "foreign", "foreign")
        .when(F.col("story_type").isNull(), "no_verdict")
        .when(age_hours(F.col("published"), now) > 36, "too_old")
        .when(F.col("repeated"), "repeats_last_edition")
    )


def latest_edition(cards: DataFrame, stamp: str = "brief_run_at") -> DataFrame:
    """Cards of the newest stamp; if none has one, all. The stamp is one value, so a one-row side is joined."""
    top = cards.agg(F.max(stamp).alias("_top"))
    return cards.join(F.broadcast(top), F.col("_top").isNull() | (F.col(stamp) == F.col("_top"))).drop("_top")


def relevant_articles(articles: DataFrame, least: int = 2) -> DataFrame:
    """Articles ``(cluster, keywords, story)`` that share ``least`` keywords with their story; where none does, all."""
    own = Window.partitionBy("cluster")
    rows = articles.withColumn("_near", F.size(F.array_intersect("keywords", "story")) >= least)
    return rows.withColumn("_some", F.max("_near").over(own)).where(F.col("_near") | ~F.col("_some")).drop("_near", "_some")


def violations(table: DataFrame, key: str, rules: dict[str, Column], unique: tuple[str, ...] = ()) -> DataFrame:
    """``(rule, key)`` of every broken row rule and every repeated value of a unique column."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    out = table.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))
    for column in unique:
        again = table.groupBy(column).count().where(f"count > 1 and {column} is not null")
        out = out.unionByName(again.select(F.lit(f"unique_{column}").alias("rule"), F.col(column).cast("string").alias("key")))
    return out


def valid_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items ``(source, link, headline)`` with a headline and an http(s) link on the host of their source or its ``www.`` twin.

    ``sources(source, url)`` is the catalogue, one row per source; a source without a URL, or one that the catalogue lacks, allows
    every host. Which side is small is left to the optimizer, as a catalogue grows with its publishers.
    """
    link = F.trim(F.coalesce("link", F.lit("")))
    rows = items.where(link.rlike("^https?://") & (F.trim(F.coalesce("headline", F.lit(""))) != ""))
    rows = rows.join(sources.select("source", F.col("url").alias("_base")), "source", "left")
    anywhere = F.coalesce(F.trim("_base"), F.lit("")) == ""
    return rows.where(anywhere | urls.host_allowed(link, F.col("_base"))).drop("_base")
