"""Sources and sinks, model batches, views and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import streaming as st
from tidewire.functions import text as t, times, urls
from tidewire.operators import grouping, models as md, pairs, ranking as rk, sets, validation
from tidewire.plans import golden, views
from tidewire.queries import duck as d
from tidewire.queries.aggregates import TRIAGE_SQL, bucketed
from tidewire.queries.gates import analysis_inputs, docs_now, editorial_inputs, now
from tidewire.queries.joins import CANON, prepared
from tidewire.queries.rankings import grp_events
from tidewire.registry import query
from tidewire.shared import materialize, shared_path
from tidewire.sources import adapters as ad, capture, feeds
from tidewire.streaming import near


@query("src_rss", f"with {ad.ARTICLES_SQL} select url as link, {d.normalize('headline')} as headline, strftime(publish_date, '%Y-%m-%d %H:%M:%S') as published, source as tag from articles")
def src_rss(spark, sf_dir):
    path = shared_path(spark, "feeds")
    feeds.write_feeds(ad.articles(spark, sf_dir), path)
    rows = feeds.read_rss(spark, path)
    return rows.select("link", "headline", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), F.get("tags", F.lit(0)).alias("tag"))


@query("src_sitemap", f"with {ad.ARTICLES_SQL} select url as link, source as headline, strftime(publish_date, '%Y-%m-%d %H:%M:%S') as published from articles")
def src_sitemap(spark, sf_dir):
    path = shared_path(spark, "sitemaps")
    feeds.write_sitemaps(ad.articles(spark, sf_dir), path)
    return feeds.read_sitemap(spark, path).select("link", "headline", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(
    "src_catalog",
    "select n_name as name, case when n_regionkey % 2 = 0 then 'A' else 'B' end as tier, channel, channel || '/' || n_nationkey as url from nation, (select unnest(['rss', 'sitemap']) as channel) where n_nationkey % 5 <> 0",
)
def src_catalog(spark, sf_dir):
    nation = ad.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("string")
    sources = nation.select(
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") % 2 == 0, "a").alias("tier"),
        (F.col("n_nationkey") % 5 != 0).alias("enabled"),
        F.array(F.concat(F.lit("rss/"), key)).alias("feed_urls"),
        F.array(F.concat(F.lit("sitemap/"), key)).alias("sitemap_urls"),
    )
    return feeds.catalogue(sources)


def recorded_day(spark, sf_dir):
    path = shared_path(spark, "day")
    verdicts = ad.verdicts(spark, sf_dir).join(ad.articles(spark, sf_dir).select("id", F.col("url").alias("key")), "id")
    pages = ad.table(spark, sf_dir, "pages")
    same = pages.select(urls.pair_key(F.col("url"), F.concat("url", F.lit("/x"))).alias("key"), (F.col("page_id") % 2 == 0).alias("same")).dropDuplicates(["key"])
    feeds.write_day(path, verdicts, same, ad.table(spark, sf_dir, "embeddings"))
    return path


@query("src_golden_day", f"with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL} select url as key, category, confidence from verdicts join articles using (id)")
def src_golden_day(spark, sf_dir):
    return feeds.read_day(spark, recorded_day(spark, sf_dir))["verdicts"].select("key", "category", "confidence")


def captured_items(spark, sf_dir, changed=False):
    """Articles as feed items; in a later state of the day a third of the bodies are new."""
    rows = ad.articles(spark, sf_dir)
    body = F.when((F.col("id") % 3 == 0) & F.lit(changed), F.concat("id", F.lit(" anew "), "main_text")).otherwise(F.col("main_text"))
    link = F.when(F.col("id") % 11 == 0, F.lit("ftp://none")).otherwise(F.col("url"))
    return rows.select(F.col("source").alias("endpoint"), F.col("id").alias("rank"), "headline", link.alias("link"), body.alias("body"), F.col("publish_date").cast("timestamp").alias("published"))


def recorded_verdicts(spark, sf_dir):
    return ad.verdicts(spark, sf_dir).join(ad.articles(spark, sf_dir).select("id", F.col("url").alias("key")), "id").drop("id")


def embed_by_hash(keyed):
    """A stand-in for the embedding service: eight components from the key's digest, of unit length."""
    part = lambda k: (F.conv(F.substring("key", 1 + 8 * k, 8), 16, 10).cast("double") / 2**31 - 1).alias(f"x{k}")
    rows = keyed.select("key", F.array(*[part(k) for k in range(8)]).alias("v"))
    norm = F.sqrt(pairs.cosine(F.col("v"), F.col("v")))
    return rows.select("key", F.transform("v", lambda x: x / norm).alias("embedding"))


KEYED = "sha256(headline || '. ' || substr({}, 1, 500))"


@query(
    "snk_capture",
    f"""with {ad.ARTICLES_SQL}, u as (select id, headline, main_text, case when id % 3 = 0 then id || ' anew ' || main_text else main_text end as body from articles where id % 11 <> 0 and trim(headline) <> ''),
    q as (select case when trim(headline) = '' then 'no_headline' else 'no_link' end as label, count(*) as n from articles where id % 11 = 0 or trim(headline) = '' group by 1),
    o as (select distinct {KEYED.format('main_text')} as k from u), w as (select distinct {KEYED.format('body')} as k from u),
    x as (select count(*) as f from w where k not in (select k from o))
    select 1 as capture, (select count(*) from u) as article_count, (select count(*) from o) as embedded, 0::bigint as reused, (select coalesce(sum(n), 0)::bigint from q) as quarantined
    union all select 2, (select count(*) from u), f, (select count(*) from w) - f, (select coalesce(sum(n), 0)::bigint from q) from x""",
)
def snk_capture(spark, sf_dir):
    """Capture a day, change a third of it, capture again: only changed keys are embedded."""
    root, clock = shared_path(spark, "captured"), docs_now()
    for changed in (False, True):
        at = clock + F.expr(f"interval {int(changed)} hours")
        capture.capture_day(captured_items(spark, sf_dir, changed), recorded_verdicts(spark, sf_dir), embed_by_hash, root, at, per_source=1 << 30, stale=24 * 365)
    manifest = capture.read_captured(spark, root)["manifest"]
    number = F.when(F.col("captured_at") == docs_now(), 1).otherwise(2).alias("capture")
    held = F.aggregate(F.map_values("quarantined"), F.lit(0).cast("long"), lambda acc, n: acc + n)
    return manifest.select(number, "article_count", "embedded", "reused", held.alias("quarantined"))


def clustered(spark, sf_dir):
    return ad.articles(spark, sf_dir).withColumn("cluster", F.col("source"))


def cards(spark, sf_dir):
    return views.cluster_cards(clustered(spark, sf_dir), ad.verdicts(spark, sf_dir))


CARDS_SQL = f"""{TRIAGE_SQL}, ld as (select source as cluster, id as lead_id, headline from articles qualify row_number() over (partition by source order by length(headline) desc, id) = 1),
    fc as (select source as cluster, count(*) as articles, count(distinct source) as sources, max(publish_date) as latest from articles group by source),
    cd as (select * from ld join fc using (cluster) left join triage using (cluster))"""
CARDS_SQL = f"{ad.ARTICLES_SQL}, {CARDS_SQL}"


@query("view_cluster_cards", f"with {CARDS_SQL} select cluster, lead_id, headline, articles, sources, category, impact_labels, story_type, pk_relevance from cd")
def view_cluster_cards(spark, sf_dir):
    return cards(spark, sf_dir).select("cluster", "lead_id", "headline", "articles", "sources", "category", "impact_labels", "story_type", "pk_relevance")


@query("view_feed", f"with {CARDS_SQL} select cluster, headline, category, sources, cluster as source_names from cd where category is not null order by sources desc, latest desc, cluster limit 30")
def view_feed(spark, sf_dir):
    return views.feed(cards(spark, sf_dir), clustered(spark, sf_dir))


@query(
    "snk_export",
    f"with {CARDS_SQL}, f as (select headline, category from cd where category is not null order by sources desc, latest desc, cluster limit 30) select headline, category, (select count(*) from f) as card_count from f",
)
def snk_export(spark, sf_dir):
    path = shared_path(spark, "export")
    feed = views.feed(cards(spark, sf_dir), clustered(spark, sf_dir))
    # At most 30 rows by the view's own limit, so one document.
    cards_ = F.collect_list(F.struct("place", *feed.columns))
    feed = feed.withColumn("place", F.monotonically_increasing_id())
    feed.agg(F.count(F.lit(1)).alias("card_count"), F.array_sort(cards_).alias("cards")).coalesce(1).write.json(path)
    read = spark.read.schema("card_count long, cards array<struct<headline: string, category: string>>").json(path)
    return read.select(F.inline("cards"), "card_count")


@query(
    "view_story",
    f"""with {CARDS_SQL} select a.source as cluster, cd.headline as card, cd.category, a.id, row_number() over (partition by a.source order by a.publish_date desc, a.id) as place
    from articles a join cd on cd.cluster = a.source""",
)
def view_story(spark, sf_dir):
    rows = views.story(cards(spark, sf_dir), clustered(spark, sf_dir))
    return rows.select("cluster", "card", "category", "id", F.col("place").cast("long").alias("place"))


@query("view_brief")
def view_brief(spark, sf_dir):
    told = cards(spark, sf_dir)
    return views.publish(views.brief(told, docs_now()), told, ad.articles(spark, sf_dir), docs_now())


@query("view_ingest")
def view_ingest(spark, sf_dir):
    """Articles of both channels, and the catalogue's endpoints by channel and state; of the catalogue's own ones nothing is landed."""
    rows, rss, maps = ad.articles(spark, sf_dir), shared_path(spark, "feeds"), shared_path(spark, "sitemaps")
    feeds.write_feeds(rows, rss)
    feeds.write_sitemaps(rows, maps)
    items = feeds.read_rss(spark, rss).withColumn("channel", F.lit("rss"))
    items = materialize(items.unionByName(feeds.read_sitemap(spark, maps).withColumn("channel", F.lit("sitemap")), True), "items")
    endpoints = items.select("endpoint", "channel").distinct().unionByName(src_catalog(spark, sf_dir).select(F.col("url").alias("endpoint"), "channel"))
    report = views.ingest_report(endpoints, items, docs_now()).groupBy("channel", "status")
    report = report.agg(F.count(F.lit(1)).alias("endpoints"), F.sum("item_count").alias("items"), F.min("newest_age_hours").alias("newest_age_hours"))
    told = views.ingest(items, docs_now()).withColumn("kind", F.lit("article"))
    return told.unionByName(report.withColumn("kind", F.lit("report")), True)


@query("view_dedup")
def view_dedup(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    seen = rows.where("id % 10 = 0").select(urls.canonical(F.col("url")).alias("canonical_url"), F.sha2(F.concat("headline", F.lit("\n"), "main_text"), 256).alias("content_hash"))
    return views.dedup(rows, seen).select("id", "source", "headline")


@query("view_clusters")
def view_clusters(spark, sf_dir):
    groups = grp_events(spark, sf_dir).where("size > 1")
    rows = groups.join(ad.articles(spark, sf_dir), "id")
    members = rk.first_per(rows, ["group_id", "source"], [F.desc("publish_date"), "id"], 2)
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ","), 256).alias("cluster_id"))


def golden_report(spark, sf_dir, clock):
    """The first capture of the day replayed at a clock."""
    root = shared_path(spark, "golden")
    day = ad.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(ad.articles(spark, sf_dir).withColumnRenamed("id", "vec_id"), "vec_id")
    keyed = day.select(capture.embedding_key(F.col("headline"), F.col("main_text")).alias("key"), "embedding").dropDuplicates(["key"])
    embed = lambda asked: asked.join(keyed, "key")
    capture.capture_day(captured_items(spark, sf_dir), recorded_verdicts(spark, sf_dir), embed, root, docs_now(), stale=24 * 365)
    rules = grouping.EventRules(centroid=0.3, mean=0.05, span_hours=36, pair=0.05)
    return golden.replay(spark, root, bucketed(spark, sf_dir), clock, rules, 0.3)


@query("view_golden_day")
def view_golden_day(spark, sf_dir):
    """The captured day replayed thirty days later, scored and gated."""
    return golden.gate(golden_report(spark, sf_dir, docs_now() + F.expr("interval 30 days")), (6, 12), 0.0, 12)


@query("view_expectations")
def view_expectations(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    tokens = rows.select(F.date_format("publish_date", "yyyyMMddHH").alias("edition"), "id", t.content_tokens(F.col("headline")).alias("tokens"))
    groups = grouping.headline_leaders(tokens).join(tokens.select("id", "tokens"), "id")
    words = groups.select("leader", F.explode("tokens").alias("k")).groupBy("leader", "k").agg(F.count(F.lit(1)).alias("c"))
    top = rk.first_per(words.where("c >= 2"), ["leader"], [F.desc("c"), "k"], 4)
    return top.groupBy("leader").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keywords"))


@query("mdl_normalize_vectors", "select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 4) as norm from embeddings")
def mdl_normalize_vectors(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", md.normalized(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return rows.select("vec_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


@query("mdl_triage_requests", f"with {ad.ARTICLES_SQL}, r as (select source, row_number() over (partition by source order by id) - 1 as r from articles) select source, (r // 50)::bigint as batch, count(*)::int as n from r group by 1, 2")
def mdl_triage_requests(spark, sf_dir):
    text = F.to_json(F.struct("headline", t.truncate(F.col("main_text"), 220).alias("summary")))
    return md.batched_requests(ad.articles(spark, sf_dir), "source", ["id"], text, 50).select("source", "batch", "n")


@query("mdl_pair_requests", f"with {ad.ARTICLES_SQL}, p as (select x.source, x.id as a, y.id as b from articles x join articles y on x.source = y.source and y.id = x.id + 20), r as (select source, row_number() over (partition by source order by a, b) - 1 as r from p) select source, (r // 8)::bigint as batch, count(*)::int as n from r group by 1, 2")
def mdl_pair_requests(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    right = rows.select((F.col("id") - 20).alias("id"), F.col("source").alias("s2"), F.col("headline").alias("h2"), F.col("id").alias("b"))
    p = rows.join(right, "id").where("source = s2")
    overlap = t.set_overlap(t.content_tokens(F.col("headline")), t.content_tokens(F.col("h2")))
    text = F.to_json(F.struct("headline", "h2", F.round(overlap, 3).alias("overlap")))
    return md.batched_requests(p, "source", ["id", "b"], text, 8).select("source", "batch", "n")


@query("mdl_candidate_rows", f"with {ad.ARTICLES_SQL} select source, array_to_string(list(headline order by id), '|') as headlines from (select source, id, headline from articles qualify row_number() over (partition by source order by id) <= 2) group by source")
def mdl_candidate_rows(spark, sf_dir):
    top = rk.first_per(ad.articles(spark, sf_dir), ["source"], ["id"], 2)
    lists = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("id", "headline"))).alias("h"))
    return lists.select("source", F.array_join(F.transform("h", lambda x: x["headline"]), "|").alias("headlines"))


@query("mdl_merge_editorial")
def mdl_merge_editorial(spark, sf_dir):
    answers, candidates = editorial_inputs(spark, sf_dir)
    stories = validation.editorial_stories(answers, candidates, ad.CATEGORIES, ad.LABELS)
    told = ad.articles(spark, sf_dir).select(F.col("id").alias("edition"), F.concat("main_text", F.lit(" It cost 22 billion.")).alias("reporting"))
    cards = candidates.withColumn("headline", F.concat("headline", F.lit(" 22"))).join(told, "edition")
    return md.merge_editorial(cards.select("edition", "cluster", "headline", "category", "labels", "reporting"), stories)


@query("mdl_what_to_watch")
def mdl_what_to_watch(spark, sf_dir):
    """Three documents in a row are a card; every second card has a line supplied, the others' articles end in a dated event."""
    rows = ad.articles(spark, sf_dir).withColumn("card", F.floor(F.col("id") / 3))
    subject = F.initcap(F.coalesce(F.get(md.words_of_story(F.col("headline")), F.lit(0)), F.lit("it")))
    day = F.concat(F.lit(" on January "), (F.col("card") % 28 + 1).cast("string"), F.lit(", 2024."))
    told = F.concat("main_text", F.lit(" The "), subject, F.lit(" hearing is"), day)
    articles = rows.select("card", (F.col("id") % 3).alias("place"), "headline", told.alias("main_text"), F.col("publish_date").alias("published"))
    supplied = F.when(F.col("card") % 2 == 0, F.concat(F.lit("Vote of "), subject, F.lit(" members"), day))
    cards = rows.where("id % 3 = 0").select("card", "headline", F.col("headline").alias("lead"), supplied.alias("supplied"), F.col("headline").alias("already_said"))
    return md.what_to_watch(cards, articles)


@query("mdl_analysis_packet")
def mdl_analysis_packet(spark, sf_dir):
    rows = clustered(spark, sf_dir).withColumn("publisher", F.concat(F.lit("p"), (F.col("id") % 5).cast("string")))
    newest = [F.desc("publish_date"), "id"]
    primary = rk.fair_share(rows, "cluster", "publisher", newest, 2, 12)
    vectors = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    source = F.col("publisher").alias("source")
    anchored = lambda df: df.join(vectors, "id").select("id", source, "cluster", "embedding", t.anchor_tokens(F.col("headline")).alias("anchors"))
    hits = sets.first_related(anchored(primary).withColumn("card", F.col("cluster")), anchored(rows), 0.0, 2)
    related = rk.capped_related(hits).join(rows, "id").select("card", "id", "main_text", "publish_date")
    primary = primary.select(F.col("cluster").alias("card"), "id", "main_text", "publish_date")
    return md.analysis_packet(primary, related, newest)


@query("mdl_analysis_outcome")
def mdl_analysis_outcome(spark, sf_dir):
    answers, packet = analysis_inputs(spark, sf_dir)
    return validation.analysis_outcome(validation.analysis_errors(answers, packet), answers)


@query("mdl_entities", f"with {ad.ARTICLES_SQL}, {d.event_core_cte('articles')} select distinct id, unnest({d.cues('core')}) as entity from core")
def mdl_entities(spark, sf_dir):
    return ad.articles(spark, sf_dir).select("id", F.explode(t.entity_cues(F.col("headline"))).alias("entity"))


@query("mdl_recorded_answers", f"with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL} select id, category, category is null as missed from articles left join verdicts using (id)")
def mdl_recorded_answers(spark, sf_dir):
    told, _ = md.recorded(ad.articles(spark, sf_dir).select("id"), ad.verdicts(spark, sf_dir).select("id", "category"), "id")
    return told.select("id", "category", F.col("category").isNull().alias("missed"))


def events_stream(spark, sf_dir):
    return st.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stm_late_drop", f"select event_id from events where ts >= timestamp '{ad.NOW_EVENTS}' - interval 36 hour")
def stm_late_drop(spark, sf_dir):
    return st.run_to_files(st.late_dropped(events_stream(spark, sf_dir), "ts", 36, now()).select("event_id"), "late-drop")


@query("stm_dedup", f"select distinct {CANON} as c from pages")
def stm_dedup(spark, sf_dir):
    pages = st.stream_table(spark, sf_dir, "pages").select(urls.canonical(F.col("url")).alias("c"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, page_id)").alias("ts"))
    return st.run_to_files(st.first_seen(pages, "c", "ts", 72), "stream-dedup").select("c")


@query("stm_health", "select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, count(*) as n from events where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 48 hour group by 1, 2")
def stm_health(spark, sf_dir):
    """Closed hours only: an hour is written when the watermark has passed it."""
    rows = st.run_to_files(st.hourly_health(events_stream(spark, sf_dir), "user_id", "ts"), "stream-health")
    return rows.select("user_id", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n")


@query("stm_resume", "select event_id from events where value >= 5")
def stm_resume(spark, sf_dir):
    done = st.run_batches(events_stream(spark, sf_dir), "stream-resume", lambda batch, epoch: batch.where("value >= 5").select("event_id"))
    return done.select("event_id")


@query("stm_near_dup")
def stm_near_dup(spark, sf_dir):
    """Pairs of a class's first row and a near copy, as micro-batches bring them."""
    docs = st.stream_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *ad.headline_and_body(), ad.publish_date())
    docs = docs.withColumn("ts", F.col("publish_date").cast("timestamp"))
    return st.run_to_files(near.near_copies(docs, t.whole_text(), 96), "stream-near")


@query("stm_ingest", f"with {ad.ARTICLES_SQL} select url as link, strftime(publish_date, '%Y-%m-%d %H:%M:%S') as published from articles")
def stm_ingest(spark, sf_dir):
    path = shared_path(spark, "landed")
    feeds.write_feeds(ad.articles(spark, sf_dir), path)
    rows = st.run_to_files(feeds.stream_rss(spark, path).select("link", "published"), "stream-items")
    return rows.select("link", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))
