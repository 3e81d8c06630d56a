"""Captured days: payloads, articles, verdicts, vectors by key, and a manifest of counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions import text as t, urls
from tidewire.operators import gates
from tidewire.operators.ranking import first_per
from tidewire.operators.snapshots import commit_snapshot, read_snapshot, staged, write_snapshot
from tidewire.shared import materialize

MANIFEST = "captured_at timestamp, per_source int, article_count long, embedded long, reused long, quarantined map<string, long>"


def embedding_key(headline: Column, body: Column) -> Column:
    """What a vector is recorded under: a digest of the exact text that is embedded."""
    return F.sha2(F.concat_ws(". ", F.coalesce(headline, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 500)), 256)


def quarantine(items: DataFrame, now: Column, **limits) -> DataFrame:
    """``items(endpoint, headline, link, published, ...)`` with ``label``, why one is not taken; null: it is."""
    # As a table of its own the report has a size by which the optimizer chooses the join; else all bodies may be shuffled by endpoint.
    shut = materialize(gates.endpoint_report(items, now, **limits).select("endpoint", F.col("status").alias("_status")), "endpoints")
    rows = items.join(shut, items.endpoint.eqNullSafe(shut.endpoint), "left").drop(shut.endpoint)
    label = (
        F.when(F.col("_status") != "ok", F.concat(F.lit("endpoint:"), "_status"))
        .when(F.coalesce(F.trim("headline"), F.lit("")) == "", "no_headline")
        .when(~F.coalesce(F.col("link").rlike("^https?://"), F.lit(False)), "no_link")
        .when(F.col("published").isNull(), "no_date")
    )
    return rows.withColumn("label", label).drop("_status")


def capture_day(items: DataFrame, verdicts: DataFrame, embed: Callable[[DataFrame], DataFrame], root: str, now: Column, per_source: int = 40, **limits) -> None:
    """Freeze a day below ``root``: items, articles, verdicts, vectors, manifest, each as one commit of its own table.

    ``embed(keyed)`` gives ``(key, embedding)`` for rows ``(key, headline, body)``; it gets the keys only that no earlier
    capture below the root has recorded, each once. Articles are the healthy items, one per URL, capped per source, newest first.
    """
    spark = items.sparkSession
    # What later steps read is written once, where it stays, and committed when all is there.
    items_version, labelled = staged(quarantine(items, now, **limits), f"{root}/items")
    at = [F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place")]
    fine = labelled.select("*", *at).where("label is null").withColumn("url", urls.canonical(F.col("link"))).withColumn("source", urls.host(F.col("link")))
    # Items are chosen without their bodies, which only the chosen ones' places meet.
    narrow = fine.select("_file", "_place", "url", "source", "published", "endpoint", "rank", F.length("body").alias("size"))
    one = first_per(narrow, ["url"], [F.desc("size"), "endpoint", "rank"])
    chosen = first_per(one, ["source"], [F.desc("published"), "rank", "url"], per_source)
    articles = fine.join(materialize(chosen.select("_file", "_place"), "chosen"), ["_file", "_place"], "left_semi")
    articles = articles.select("url", "source", "headline", "body", "published", embedding_key(F.col("headline"), F.col("body")).alias("key"))
    articles_version, articles = staged(articles, f"{root}/articles")
    keyed = articles.select("key", "headline", "body").dropDuplicates(["key"])
    known = recorded_vectors(spark, root)
    fresh = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
    fresh_version, fresh = staged(embed(fresh).select("key", "embedding"), f"{root}/vectors")
    counts = labelled.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("quarantined"))
    n = articles.agg(F.count(F.lit(1)).alias("article_count"), F.count_distinct("key").alias("keys")).join(F.broadcast(fresh.agg(F.count(F.lit(1)).alias("embedded"))))
    manifest = n.join(F.broadcast(counts)).select(now.alias("captured_at"), F.lit(per_source).alias("per_source"), "article_count", "embedded", (F.col("keys") - F.col("embedded")).alias("reused"), "quarantined")
    commit_snapshot(labelled, f"{root}/items", items_version)
    commit_snapshot(articles, f"{root}/articles", articles_version)
    write_snapshot(verdicts, f"{root}/verdicts")
    commit_snapshot(fresh, f"{root}/vectors", fresh_version, "overwrite" if known is None else "append")
    write_snapshot(manifest, f"{root}/manifest", "append")


def recorded_vectors(spark: SparkSession, root: str) -> DataFrame | None:
    """``(key, embedding)`` of all captures below the root; None before the first."""
    try:
        return read_snapshot(spark, f"{root}/vectors")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_captured(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_snapshot(spark, f"{root}/{name}") for name in ("items", "articles", "verdicts", "vectors", "manifest")}


def shifted(articles: DataFrame, captured_at: Column, now: Column) -> DataFrame:
    """Articles as of a later clock: all dates move by the time since the capture, so ages stay."""
    moved = F.unix_micros("published") + F.unix_micros(now) - F.unix_micros(captured_at)
    return articles.withColumn("published", F.timestamp_micros(moved))
