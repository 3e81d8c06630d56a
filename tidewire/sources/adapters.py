"""The driver's tables in the shape of the library's: pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.shared import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def headline_and_body() -> list[Column]:
    """The first line of ``text`` as ``headline``, the rest as ``main_text`` (none: the first line again)."""
    head = F.substring_index("text", "\n", 1)
    rest = F.substring(F.col("text"), F.length(head) + 2, F.length("text"))
    return [head.alias("headline"), F.when(rest == "", head).otherwise(rest).alias("main_text")]


def publish_date() -> Column:
    """A time within four days, by the id."""
    return F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 96 as int))").alias("publish_date")


def articles(spark: SparkSession, sf_dir: str, embedded: bool = False) -> DataFrame:
    """``documents`` as articles: the first line is the headline, the rest the body; vectors on request."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    out = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        *headline_and_body(),
        publish_date(),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
    )
    if embedded:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        out = out.join(vectors, "id", "left")
    return out


#: The categories, labels and relevance levels of verdicts, in the adapters' order.
CATEGORIES = "economy politics city education health security international technology sports entertainment other".split()
RELEVANCE = "national local foreign_with_pk_effect foreign".split()
LABELS = "WALLET COMMUTE SAFETY WORK UTILITIES GOVERNANCE".split()


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` as triage verdicts: id, category, impact_label, story_type, pk_relevance, confidence."""
    pick = lambda items, n: F.element_at(F.expr(f"array({','.join(repr(i) for i in items)})"), (F.col("doc_id") % n + 1).cast("int"))
    kind = F.when(F.col("toxic") == 1, "advertorial").when(F.col("quality") == 1, "hard_news").otherwise("routine")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"),
        pick(CATEGORIES, 11).alias("category"),
        pick(LABELS, 6).alias("impact_label"),
        kind.alias("story_type"),
        pick(RELEVANCE, 4).alias("pk_relevance"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.4).alias("confidence"),
    )


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` by label as cluster members."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.col("vec_id").alias("id"), "embedding")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as feed items: the user is the endpoint, the event type its source, ranked by event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("endpoint"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("published"), "value"
    )


def url_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as items with URLs: even pages come by RSS, odd ones by sitemap."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", F.col("html").alias("body"), F.when(F.col("page_id") % 2 == 0, "rss").otherwise("sitemap").alias("channel")
    )


#: The same projections in DuckDB SQL, to stand before an oracle's own text.
ARTICLES_SQL = """articles as (
    select id, source, headline, case when rest = '' then headline else rest end as main_text, publish_date, url from (
        select doc_id as id, source, split_part(text, chr(10), 1) as headline,
               substr(text, length(split_part(text, chr(10), 1)) + 2) as rest,
               timestamp '2024-01-01 00:00:00' + to_hours((doc_id % 96)::int) as publish_date,
               'https://' || source || '.example.com/' || doc_id as url
        from documents))"""
VERDICTS_SQL = f"""verdicts as (
    select doc_id as id, ({CATEGORIES})[doc_id % 11 + 1] as category, ({LABELS})[doc_id % 6 + 1] as impact_label,
           case when toxic = 1 then 'advertorial' when quality = 1 then 'hard_news' else 'routine' end as story_type,
           ({RELEVANCE})[doc_id % 4 + 1] as pk_relevance,
           case when quality = 1 then 0.9::double else 0.4::double end as confidence
    from labels)"""
ITEMS_SQL = """items as (
    select event_id as item_id, user_id as endpoint, event_type as source, ts as published, value from events)"""
PAGES_SQL = """url_items as (
    select page_id as seq, url, html as body, case when page_id % 2 = 0 then 'rss' else 'sitemap' end as channel from pages)"""
MEMBERS_SQL = "cluster_members as (select label as cluster_id, vec_id as id, embedding from embeddings)"
#: Fixed clocks of the queries on documents and on events.
NOW_DOCS, NOW_EVENTS = "2024-01-05 00:00:00", "2024-01-31 00:00:00"
