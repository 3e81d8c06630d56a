"""Window, grouping and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t, urls
from tidewire.operators import aggregates as ag, graph, grouping, pairs, ranking as rk, sets
from tidewire.queries import duck as d
from tidewire.queries.aggregates import TOC, TRIAGE_SQL, triage, vectors
from tidewire.queries.joins import CANON, CH, prepared
from tidewire.registry import query
from tidewire.sources import adapters as ad

RANK = "case story_type when 'hard_news' then 3 when 'routine' then 1 else 0 end"
REL = "case pk_relevance when 'national' then 3 when 'local' then 2 when 'foreign_with_pk_effect' then 1 else 0 end"


@query(
    "win_merge_channels",
    f"with {ad.PAGES_SQL}, c as (select *, {CANON} as c from url_items) select c, seq, channel from c qualify row_number() over (partition by c order by length(body) desc, channel = 'rss' desc, seq) = 1",
)
def win_merge_channels(spark, sf_dir):
    items = ad.url_items(spark, sf_dir).withColumn("c", urls.canonical(F.col("url")))
    return rk.first_per(items, ["c"], [F.desc(F.length("body")), F.desc(F.col("channel") == "rss"), "seq"]).select("c", "seq", "channel")


@query("win_source_cap", f"with {ad.ARTICLES_SQL} select id from articles qualify row_number() over (partition by source order by publish_date desc, id) <= 8")
def win_source_cap(spark, sf_dir):
    return rk.first_per(ad.articles(spark, sf_dir), ["source"], [F.desc("publish_date"), "id"], 8).select("id")


@query("win_representative", f"with {TOC} select label, vec_id from tc qualify row_number() over (partition by label order by round(sim, 9) desc, vec_id) = 1")
def win_representative(spark, sf_dir):
    rows = ag.member_similarity(vectors(spark, sf_dir), "label")
    return rk.first_per(rows, ["label"], [F.desc(F.round("to_centroid", 9)), "vec_id"]).select("label", "vec_id")


PRIORITY = ["src3", "src1", "src0"]


@query(
    "win_headline_pick",
    f"with {ad.ARTICLES_SQL} select id % 40 as cluster, id, headline from articles qualify row_number() over (partition by id % 40 order by coalesce(list_position({d.quoted(PRIORITY)}, source), 99), length(headline) desc, url) = 1",
)
def win_headline_pick(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).withColumn("cluster", F.col("id") % 40)
    place = F.nullif(F.array_position(t.words_in(PRIORITY), F.col("source")), F.lit(0))
    return rk.first_per(rows, ["cluster"], [F.coalesce(place, F.lit(99)), F.desc(F.length("headline")), "url"]).select("cluster", "id", "headline")


TRIM = f"""{TOC}, m as (select vec_id, label, sim, 'src' || vec_id % 5 as source from tc where sim >= 0.05),
    s as (select * from m qualify row_number() over (partition by label, source order by round(sim, 9) desc, vec_id) <= 4),
    k as (select * from s qualify row_number() over (partition by label order by round(sim, 9) desc, source, vec_id) <= 12)"""


@query("win_cluster_trim", f"with {TRIM} select label, vec_id from k")
def win_cluster_trim(spark, sf_dir):
    rows = ag.member_similarity(vectors(spark, sf_dir), "label").where("to_centroid >= 0.05")
    rows = rows.withColumn("source", F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")))
    near = F.desc(F.round("to_centroid", 9))
    rows = rk.first_per(rows, ["label", "source"], [near, "vec_id"], 4)
    return rk.first_per(rows, ["label"], [near, "source", "vec_id"], 12).select("label", "vec_id")


@query(
    "win_editorial_articles",
    "select user_id, event_id from (select user_id, event_id, ts, event_type, row_number() over (partition by user_id, event_type order by ts desc, event_id) as own from events) qualify row_number() over (partition by user_id order by own > 1, ts desc, event_type, event_id) <= 8",
)
def win_editorial_articles(spark, sf_dir):
    rows = rk.numbered(ad.table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), "event_id"], "own")
    return rk.first_per(rows, ["user_id"], [F.col("own") > 1, F.desc("ts"), "event_type", "event_id"], 8).select("user_id", "event_id")


@query(
    "win_primary_articles",
    "select user_id, event_id from (select user_id, event_id, event_type, row_number() over (partition by user_id, event_type order by ts desc, event_id) as own from events qualify own <= 2) qualify row_number() over (partition by user_id order by own, event_type) <= 12",
)
def win_primary_articles(spark, sf_dir):
    return rk.fair_share(ad.table(spark, sf_dir, "events"), "user_id", "event_type", [F.desc("ts"), "event_id"], 2, 12).select("user_id", "event_id")


@query("win_related_caps")
def win_related_caps(spark, sf_dir):
    vec = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")
    rows = ad.articles(spark, sf_dir).join(vec, "id").select("id", "source", "cluster", "embedding", t.content_tokens(F.col("headline")).alias("anchors"))
    primary = rows.withColumn("card", F.col("id"))
    # The walk keeps two of a publisher and cluster at most.
    return rk.capped_related(sets.first_related(primary, rows, -1.0, 2))


@query(
    "win_rank_candidates",
    f"with {TRIAGE_SQL} select cluster, row_number() over (order by {RANK} desc, {REL} desc, verdict_count desc, cluster) as place from triage",
)
def win_rank_candidates(spark, sf_dir):
    rows = triage(spark, sf_dir).withColumn("edition", F.lit(1))
    story = ag.rank_of("story_type", {"hard_news": 3, "routine": 1}, 0)
    order = [F.desc(story), F.desc(ag.rank_of("pk_relevance", ag.RELEVANCE_RANK, 0)), F.desc("verdict_count"), "cluster"]
    return rk.numbered(rows, ["edition"], order, "place").select("cluster", F.col("place").cast("long").alias("place"))


@query("win_story_order", f"with {TRIAGE_SQL} select cluster, verdict_count from triage order by verdict_count desc, confidence desc, cluster limit 12")
def win_story_order(spark, sf_dir):
    return triage(spark, sf_dir).orderBy(F.desc("verdict_count"), F.desc("confidence"), "cluster").limit(12).select("cluster", "verdict_count")


@query("win_diverse_select")
def win_diverse_select(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir), "id")
    rows = rows.withColumn("edition", F.date_format("publish_date", "yyyy-MM-dd"))
    ranked = rk.numbered(rows, ["edition"], [F.desc("confidence"), "id"], "place")
    return rk.diverse_select(ranked.select("edition", "place", "id", "category", t.acronyms(F.col("headline")).alias("families"), F.lit(1).alias("sources")))


@query("win_newest_per_key", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id) = 1")
def win_newest_per_key(spark, sf_dir):
    return rk.first_per(ad.table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), "event_id"]).select("user_id", "event_id")


@query("win_clusters_by_size", "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, max(o_orderdate) desc, o_custkey limit 50")
def win_clusters_by_size(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    return rows.orderBy(F.desc("n"), F.desc("last"), "o_custkey").limit(50).select("o_custkey", "n")


@query(
    "win_candidate_windows",
    "with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) select o_custkey, w as size, count(*) as n from r, (select unnest([12, 20, 28]) as w) where place <= w group by o_custkey, w",
)
def win_candidate_windows(spark, sf_dir):
    rows = rk.numbered(ad.table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], "place")
    sizes = F.filter(F.array(F.lit(12), F.lit(20), F.lit(28)), lambda w: F.col("place") <= w)
    return rows.select("o_custkey", F.explode(sizes).alias("size")).groupBy("o_custkey", "size").agg(F.count(F.lit(1)).alias("n"))


@query(
    "win_best_attempt",
    "with a as (select user_id, event_type as attempt, count(*) filter (value >= 5) as accepted, min(event_id) as first from events group by user_id, event_type) select user_id, attempt, accepted from a qualify row_number() over (partition by user_id order by accepted desc, first) = 1",
)
def win_best_attempt(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("attempt"))
    rows = rows.agg(F.count_if(F.col("value") >= 5).alias("accepted"), F.min("event_id").alias("first"))
    return rk.first_per(rows, ["user_id"], [F.desc("accepted"), "first"]).select("user_id", "attempt", "accepted")


@query(
    "win_content_budget",
    f"""with {ad.ARTICLES_SQL}, c as (select id, source, least(length(main_text), 1500) as c from articles)
    select id, greatest(0, least(c, 6000 - coalesce(sum(c) over (partition by source order by id rows between unbounded preceding and 1 preceding), 0)))::bigint as allowed from c""",
)
def win_content_budget(spark, sf_dir):
    rows = rk.budgeted(ad.articles(spark, sf_dir), "source", ["id"], F.length("main_text"), 1500, 6000)
    return rows.select("id", F.col("allowed").cast("long").alias("allowed"))


@query("win_batches", f"with {ad.ARTICLES_SQL}, r as (select id, source, row_number() over (partition by source order by id) - 1 as r from articles) select id, (r // 50)::bigint as batch, 'i' || (r % 50) as key from r")
def win_batches(spark, sf_dir):
    rows = rk.numbered(ad.articles(spark, sf_dir), ["source"], ["id"], "r").withColumn("r", F.col("r") - 1)
    return rows.select("id", F.floor(F.col("r") / 50).alias("batch"), F.concat(F.lit("i"), (F.col("r") % 50).cast("string")).alias("key"))


DOT = "list_inner_product(x.embedding::double[], y.embedding::double[])"


@query(
    "grp_components",
    f"""with recursive e as (select x.vec_id as a, y.vec_id as b from embeddings x join embeddings y on x.label = y.label and x.vec_id <> y.vec_id where {DOT} >= 0.3),
    r as (select vec_id as node, vec_id as label from embeddings union select e.b, r.label from r join e on e.a = r.node)
    select node, min(label) as label from r group by node""",
)
def grp_components(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumnRenamed("vec_id", "id")
    edges = pairs.similar_pairs(v, 0.3, "label")
    return graph.components(v.select(F.col("id").alias("node")), edges)


@query("grp_near_dup_keep")
def grp_near_dup_keep(spark, sf_dir):
    # The walk goes source by source, newest first.
    order = F.struct("source", (-F.unix_micros(F.col("publish_date").cast("timestamp"))).alias("t"), "id")
    return grouping.keep_without_near_copies(ad.articles(spark, sf_dir), t.whole_text(), order)


@query("grp_events")
def grp_events(spark, sf_dir):
    us = F.unix_micros(F.col("publish_date").cast("timestamp")).alias("us")
    compatible = pairs.dated_pairs(prepared(spark, sf_dir, True, us), 0.05, 36)
    rules = grouping.EventRules(centroid=0.3, mean=0.05, span_hours=36, pair=0.05)
    return grouping.event_groups(ad.articles(spark, sf_dir, True), compatible, rules)


@query("grp_headlines")
def grp_headlines(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    rows = rows.select(F.date_format("publish_date", "yyyyMMddHH").alias("edition"), "id", t.content_tokens(F.col("headline")).alias("tokens"))
    return grouping.headline_leaders(rows)


@query("grp_distinct_headlines")
def grp_distinct_headlines(spark, sf_dir):
    cards = ad.articles(spark, sf_dir).select("id", t.content_tokens(F.col("headline")).alias("tokens"))
    return grouping.distinct_headlines(cards, 0.6)


@query("set_union_channels", f"with {ad.PAGES_SQL} select url, 'rss' as channel from url_items where channel = 'rss' union all select url, 'sitemap' from url_items where channel = 'sitemap'")
def set_union_channels(spark, sf_dir):
    items = ad.url_items(spark, sf_dir).select("url", "channel")
    return items.where("channel = 'rss'").unionByName(items.where("channel = 'sitemap'"))


@query("set_diff_expectations", "select item_id, 'file' as only_in from benchmark where item_id % 2 = 0 and item_id % 3 <> 0 union all select item_id, 'oracle' from benchmark where item_id % 3 = 0 and item_id % 2 <> 0 union all select item_id, 'both' from benchmark where item_id % 6 = 0")
def set_diff_expectations(spark, sf_dir):
    items = ad.table(spark, sf_dir, "benchmark").select("item_id")
    file, oracle = items.where("item_id % 2 = 0"), items.where("item_id % 3 = 0")
    tag = lambda df, name: df.withColumn("only_in", F.lit(name))
    return tag(file.exceptAll(oracle), "file").union(tag(oracle.exceptAll(file), "oracle")).union(tag(file.intersect(oracle), "both"))


@query("set_url_union", f"with {CH} select 'union' as op, count(*) as n from (select c from l union select c from r) union all select 'intersect', count(*) from (select c from l intersect select c from r) union all select 'minus', count(*) from (select c from l except select c from r)")
def set_url_union(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("c"))
    left, right = pages.where("page_id % 3 <> 0").select("c"), pages.where("page_id % 3 <> 1").select("c")
    n = lambda df, name: df.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return n(left.union(right).distinct(), "union").union(n(left.intersect(right), "intersect")).union(n(left.subtract(right), "minus"))
