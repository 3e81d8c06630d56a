"""A captured day through the pipeline: replay at any clock, score, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions import text as t
from tidewire.operators import aggregates as ag, graph, grouping, pairs
from tidewire.plans import views
from tidewire.shared import materialize
from tidewire.sources import capture

#: Fixed value: two reports of one event have a cosine above it, whatever thresholds the grouping has.
EVENT_LINKAGE = 0.93


def replay(spark: SparkSession, root: str, expectations: DataFrame, now: Column, rules: grouping.EventRules, linkage: float = EVENT_LINKAGE) -> DataFrame:
    """One row: what the day captured below ``root`` comes to at the clock ``now``.

    Articles are shifted to the clock, take their recorded verdicts and vectors (one without a vector is a miss), are grouped into
    events, make cards and a brief, and the brief is scored against ``expectations(expectation, keywords, min_hits, bucket)``.
    """
    day = capture.read_captured(spark, root)
    at = day["manifest"].orderBy(F.desc("captured_at")).select("captured_at").first()[0]
    rows = capture.shifted(day["articles"], F.lit(at).cast("timestamp"), now).join(day["vectors"], "key", "left")
    rows = rows.join(day["verdicts"].withColumnRenamed("key", "url"), "url", "left").withColumn("id", F.col("url"))
    rows = materialize(rows.withColumnRenamed("published", "publish_date"), "replayed")
    core = t.event_core(F.col("headline"))
    words = rows.where("embedding is not null").select("id", "source", "embedding", t.plain_tokens(core, t.HEADLINE_STOPS).alias("tokens"), t.entity_cues(F.col("headline")).alias("cues"))
    groups = materialize(grouping.event_groups(rows, pairs.compatible_pairs(words, rules.pair), rules), "groups")
    alike = pairs.similar_pairs(rows.select("id", "embedding", F.lit(1).alias("day")), linkage, "day")
    truth = graph.components(groups.select(F.col("id").alias("node")), alike).withColumnRenamed("node", "id")
    quality = ag.partition_quality(groups.join(truth, "id"), "group_id", "label")
    members = rows.join(groups.select("id", F.col("group_id").alias("cluster")), "id")
    cards = materialize(views.cluster_cards(members, members.select("id", "category", "impact_label", "story_type", "pk_relevance", "confidence")), "cards")
    picked = cards.join(views.brief(cards, now).select(F.col("id").alias("cluster")), "cluster", "left_semi")
    texts = picked.join(members.select(F.col("id").alias("lead_id"), "body"), "lead_id").select(F.col("cluster").alias("card"), F.concat_ws(" ", "headline", "body").alias("text"))
    texts = materialize(texts, "brief-texts")
    facts = rows.agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("embedding").isNull()).alias("misses"), F.max("publish_date").alias("latest"))
    # Each side is one row.
    for part in (groups.agg(F.count_distinct("group_id").alias("clusters")), quality, brief_score(texts, expectations)):
        facts = facts.join(F.broadcast(part))
    return facts


def brief_score(cards: DataFrame, expectations: DataFrame) -> DataFrame:
    """One row of a brief's ``cards(card, text)`` against expectations of the buckets must_have, must_not_have and editor_call.

    ``expected, matched, recall`` of what must be there (nothing expected: 1), ``violations`` of what must not, and ``duplicates``: must-have
    stories that several cards tell.
    """
    hits = pairs.expectation_hits(expectations.select("expectation", "keywords", "min_hits"), cards)
    hits = hits.groupBy("expectation").agg(F.count(F.lit(1)).alias("cards"))
    rows = expectations.select("expectation", "bucket").join(hits, "expectation", "left")
    must, told = F.col("bucket") == "must_have", F.col("cards").isNotNull()
    score = rows.agg(
        F.count_if(must).alias("expected"),
        F.count_if(must & told).alias("matched"),
        F.count_if((F.col("bucket") == "must_not_have") & told).alias("violations"),
        F.count_if(must & (F.col("cards") > 1)).alias("duplicates"),
    )
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("matched") / F.col("expected"))
    return score.withColumn("recall", recall).join(F.broadcast(cards.agg(F.count(F.lit(1)).alias("size"))))


def gate(report: DataFrame, size: tuple[int, int], baseline: float | None, most_merged: int | None) -> DataFrame:
    """``report`` with ``failures``, a sorted list of names, and ``passed``: nothing failed and something was expected."""
    checks = {
        "baseline": F.lit(False) if baseline is None else F.col("recall") < baseline,
        "duplicates": F.col("duplicates") > 0,
        "merged": F.lit(False) if most_merged is None else F.col("merged_in") > most_merged,
        "misses": F.col("misses") > 0,
        "size": F.lit(False) if size[1] <= 0 else ~F.col("size").between(*size),
        "unreviewed": F.col("expected") == 0,
        "violations": F.col("violations") > 0,
    }
    failures = F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])), ",")
    return report.withColumn("failures", failures).withColumn("passed", F.col("failures") == "")
