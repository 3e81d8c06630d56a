"""State-change queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidewire.operators import snapshots as sn
from tidewire.registry import query
from tidewire.shared import shared_path
from tidewire.sources import adapters as ad


@query("mut_apply_embeddings", "select d.doc_id, vec_id is not null as has_vector from documents d left join embeddings on vec_id = doc_id and vec_id % 2 = 0")
def mut_apply_embeddings(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("array<float>").alias("embedding"))
    change = ad.table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), "embedding")
    change = change.join(docs.select("doc_id"), "doc_id", "left_semi")
    return sn.apply_columns(docs, change, "doc_id", ["embedding"]).select("doc_id", F.col("embedding").isNotNull().alias("has_vector"))


@query("mut_apply_metadata", f"with {ad.VERDICTS_SQL} select doc_id, category, confidence from documents left join verdicts on id = doc_id")
def mut_apply_metadata(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("double").alias("confidence"))
    change = ad.verdicts(spark, sf_dir).select(F.col("id").alias("doc_id"), "category", "confidence")
    return sn.apply_columns(docs, change, "doc_id", ["category", "confidence"])


@query("mut_hydrate_body", f"with {ad.ARTICLES_SQL} select id, case when length(main_text) < 600 and length(html) >= 600 then length(html) else length(main_text) end as n from articles left join pages on page_id = id")
def mut_hydrate_body(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("main_text"))
    return sn.hydrate(ad.articles(spark, sf_dir), pages).select("id", F.length("main_text").alias("n"))


NEW = "n as (select vec_id as id, 100 + vec_id % 3 as cluster_id from embeddings where label in (1, 2))"


@query("mut_replace_clusters", f"with {NEW} select vec_id as id, label as cluster_id from embeddings where label not in (select label from embeddings where vec_id in (select id from n)) union all select id, cluster_id from n")
def mut_replace_clusters(spark, sf_dir):
    old = ad.cluster_members(spark, sf_dir).select("id", "cluster_id")
    new = old.where("cluster_id in (1, 2)").select("id", (100 + F.col("id") % 3).cast("int").alias("cluster_id"))
    return sn.replace_groups(old, new)


@query("mut_assign_clusters", "select doc_id, label as cluster_id from documents left join embeddings on vec_id = doc_id and label <> 3")
def mut_assign_clusters(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("int").alias("cluster_id"))
    members = ad.cluster_members(spark, sf_dir).where("cluster_id <> 3").select(F.col("id").alias("doc_id"), "cluster_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    return sn.apply_columns(docs, members, "doc_id", ["cluster_id"])


@query("mut_delete", "select o_orderkey, case when o_custkey % 10 <> 0 then o_custkey end as o_custkey from orders where o_orderkey % 7 <> 0")
def mut_delete(spark, sf_dir):
    orders = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    left = sn.delete_ids(orders, orders.where("o_orderkey % 7 = 0"), "o_orderkey")
    gone = orders.where("o_custkey % 10 = 0").select("o_custkey").distinct()
    return sn.clear_reference(left, gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("mut_cluster_size", "select o_custkey, count(*)::int as cluster_size from orders group by o_custkey")
def mut_cluster_size(spark, sf_dir):
    groups = ad.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("article_ids"))
    return groups.select("o_custkey", F.size("article_ids").alias("cluster_size"))


@query("mut_prune", "select event_id from events where not (ts < timestamp '2024-01-24' and user_id not in (select user_id from events where event_id % 101 = 0))")
def mut_prune(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events")
    safe = events.join(events.where("event_id % 101 = 0").select("user_id").distinct(), "user_id", "left_semi")
    return sn.prune(events, safe, "event_id", F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")).select("event_id")


@query("mut_publish", "select event_id, user_id = 3 or event_id % 2 = 0 as is_published from events")
def mut_publish(spark, sf_dir):
    cards = ad.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 2 == 0).alias("is_published"))
    return cards.select("event_id", F.when(F.col("user_id") == 3, True).otherwise(F.col("is_published")).alias("is_published"))


@query("mut_run_state", "select user_id, bool_or(value >= 5) as ok, strftime(max(case when value >= 5 then ts end), '%Y-%m-%d %H:%M:%S') as last_success from events group by user_id")
def mut_run_state(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events")
    fold = lambda df: df.groupBy("user_id").agg(F.bool_or(F.col("value") >= 5).alias("ok"), F.max(F.when(F.col("value") >= 5, F.col("ts"))).alias("last_success"))
    old, new = fold(events.where("ts < timestamp'2024-01-15'")), fold(events.where("ts >= timestamp'2024-01-15'"))
    new = new.select("user_id", F.col("ok").alias("ok2"), F.col("last_success").alias("ls2"))
    both = old.join(new, "user_id", "full")
    ok = F.coalesce("ok", F.lit(False)) | F.coalesce("ok2", F.lit(False))
    return both.select("user_id", ok.alias("ok"), F.date_format(F.coalesce("ls2", "last_success"), "yyyy-MM-dd HH:mm:ss").alias("last_success"))


@query("mut_replace_card", "select event_id, case when event_id % 5 = 0 then value + 1 else value end as value from events")
def mut_replace_card(spark, sf_dir):
    cards = ad.table(spark, sf_dir, "events").select("event_id", "value")
    fresh = cards.where("event_id % 5 = 0").select("event_id", (F.col("value") + 1).alias("value"))
    return sn.upsert(cards, fresh, "event_id")


@query(
    "src_tables",
    f"""with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL}, {ad.MEMBERS_SQL}
    select 'articles' as name, count(*) as n, sum(id)::bigint as keys from articles union all
    select 'clusters', count(*), sum(cluster_id)::bigint from (select distinct cluster_id from cluster_members) union all
    select 'members', count(*), sum(id)::bigint from cluster_members union all
    select 'verdicts', count(*), sum(id)::bigint from verdicts""",
)
def src_tables(spark, sf_dir):
    """The four tables written in two commits each and read back: halves are appended, a first version is overwritten."""
    members = ad.cluster_members(spark, sf_dir)
    tables = {
        "articles": (ad.articles(spark, sf_dir), "id"),
        "clusters": (members.select("cluster_id").distinct(), "cluster_id"),
        "members": (members, "id"),
        "verdicts": (ad.verdicts(spark, sf_dir), "id"),
    }
    facts = []
    for name, (rows, key) in tables.items():
        root = shared_path(spark, f"table-{name}")
        if name in ("articles", "members"):
            sn.write_snapshot(rows.where(F.col(key) % 2 == 0), root)
            sn.write_snapshot(rows.where(F.col(key) % 2 == 1), root, "append")
        else:
            sn.write_snapshot(rows.where(F.col(key) % 2 == 0), root, "append")
            sn.write_snapshot(rows, root)
        facts.append(sn.read_snapshot(spark, root).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).cast("long").alias("keys")))
    return reduce(lambda x, y: x.union(y), facts)
