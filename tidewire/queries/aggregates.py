"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t, times
from tidewire.operators import aggregates as ag, pairs
from tidewire.plans import golden
from tidewire.queries import duck as d
from tidewire.queries.gates import DOCS_NOW, NOW, docs_now, hours, now
from tidewire.queries.joins import EXPECT_SQL, TOKS, expectations
from tidewire.queries.texts import bucket, prominence
from tidewire.registry import ORACLES, query
from tidewire.sources import adapters as ad

SUMS = "us as (select label, dim, count(*) as n, sum(x) as s from (select label, unnest(range(1, 65)) as dim, unnest(embedding::double[]) as x from embeddings) group by label, dim)"
NORM = "nr as (select label, max(n) as n, sqrt(sum(s * s)) as norm, sum(s * s) as q from us group by label)"


def vectors(spark, sf_dir):
    return ad.table(spark, sf_dir, "embeddings")


@query("agg_centroid", f"with {SUMS}, {NORM} select label, (dim - 1)::int as dim, round(s / norm, 5) as value from us join nr using (label)")
def agg_centroid(spark, sf_dir):
    rows = ag.centroids(vectors(spark, sf_dir), "label").select("label", F.posexplode("centroid").alias("dim", "value"))
    return rows.select("label", "dim", F.round("value", 5).alias("value"))


@query("agg_intra_similarity", f"with {SUMS}, {NORM} select label, n, round(case when n < 2 then 1.0 else (q - n) / (n * (n - 1)) end, 5)::double as similarity from nr")
def agg_intra_similarity(spark, sf_dir):
    return ag.intra_similarity(vectors(spark, sf_dir), "label").withColumn("similarity", F.round("similarity", 5))


TOC = f"{SUMS}, {NORM}, ct as (select label, list(s / norm order by dim) as c from us join nr using (label) group by label), tc as (select vec_id, label, list_inner_product(embedding::double[], c) as sim from embeddings join ct using (label))"


@query("agg_min_member_similarity", f"with {TOC} select label, round(min(sim), 5) as least from tc group by label")
def agg_min_member_similarity(spark, sf_dir):
    rows = ag.member_similarity(vectors(spark, sf_dir), "label").groupBy("label").agg(F.min("to_centroid").alias("least"))
    return rows.select("label", F.round("least", 5).alias("least"))


@query("agg_group_stats", "select count(distinct case when label <> 0 then label end) as n_clusters, round(avg((label = 0)::int), 6) as noise_ratio from embeddings")
def agg_group_stats(spark, sf_dir):
    noise = F.col("label") == 0
    return vectors(spark, sf_dir).agg(F.countDistinct(F.when(~noise, F.col("label"))).alias("n_clusters"), F.round(F.avg(noise.cast("int")), 6).alias("noise_ratio"))


@query("agg_label_groups", "select label, array_to_string(list(vec_id order by vec_id), ',') as members from embeddings where label <> 0 group by label")
def agg_label_groups(spark, sf_dir):
    rows = vectors(spark, sf_dir).where("label <> 0").groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("m"))
    return rows.select("label", F.array_join(F.col("m").cast("array<string>"), ",").alias("members"))


@query(
    "agg_quality_report",
    f"with {TOC}, r as (select label, count(*) as articles, min(sim) as least from tc group by label) select label, articles, round(least, 5) as least, round((q - n) / (n * (n - 1)), 5)::double as similarity, (q - n) / (n * (n - 1)) < 0.65 or least < 0.70 as below from r join nr using (label)",
)
def agg_quality_report(spark, sf_dir):
    v = vectors(spark, sf_dir)
    least = ag.member_similarity(v, "label").groupBy("label").agg(F.count(F.lit(1)).alias("articles"), F.min("to_centroid").alias("least"))
    rows = least.join(ag.intra_similarity(v, "label"), "label")
    below = (F.col("similarity") < 0.65) | (F.col("least") < 0.70)
    return rows.select("label", "articles", F.round("least", 5).alias("least"), F.round("similarity", 5).alias("similarity"), below.alias("below"))


@query("agg_source_counters", "select source, count(*) as discovered, count(distinct text) as inserted, count(*) - count(distinct text) as duplicates, count(*) = 0 as degraded from documents group by source")
def agg_source_counters(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents")
    n, k = F.count(F.lit(1)), F.countDistinct(F.sha2("text", 256))
    return docs.groupBy("source").agg(n.alias("discovered"), k.alias("inserted"), (n - k).alias("duplicates"), (n == 0).alias("degraded"))


@query(
    "agg_ingest_summary",
    f"with {ad.ARTICLES_SQL} select count(*) as n, count(*) filter (length(main_text) >= 600) as full_bodies, quantile_cont(length(main_text), 0.5)::double as median_body, count(distinct source) as sources from articles",
)
def agg_ingest_summary(spark, sf_dir):
    size = F.length("main_text")
    return ad.articles(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(size >= 600).alias("full_bodies"), F.percentile(size, 0.5).alias("median_body"), F.countDistinct("source").alias("sources")
    )


@query("agg_feed_probe", f"with {ad.ITEMS_SQL} select endpoint, count(*) as items, count(published) as dated, count(*) filter ({hours('published')} <= 24) as last_day, round(min({hours('published')}), 4) as newest, round(quantile_cont(value, 0.5), 6) as median_value from items group by endpoint")
def agg_feed_probe(spark, sf_dir):
    age = times.age_hours(F.col("published"), now())
    return ad.feed_items(spark, sf_dir).groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("published").alias("dated"),
        F.count_if(age <= 24).alias("last_day"),
        F.round(F.min(age), 4).alias("newest"),
        F.round(F.percentile("value", 0.5), 6).alias("median_value"),
    )


@query("agg_sitemap_probe", f"with {ad.ITEMS_SQL} select source, count(*) as urls, round(min({hours('published')}), 4) as newest, count(*) filter ({hours('published')} <= 24) as last_day from items group by source")
def agg_sitemap_probe(spark, sf_dir):
    age = times.age_hours(F.col("published"), now())
    return ad.feed_items(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("urls"), F.round(F.min(age), 4).alias("newest"), F.count_if(age <= 24).alias("last_day"))


@query("agg_recency_profile", f"with {ad.ITEMS_SQL} select count(*) filter ({hours('published')} <= 24) as day, count(*) filter ({hours('published')} > 24 and {hours('published')} <= 168) as week, count(*) filter ({hours('published')} > 168) as older from items where endpoint not in (select endpoint from items where source = 'click')")
def agg_recency_profile(spark, sf_dir):
    items = ad.feed_items(spark, sf_dir)
    only = items.join(items.where("source = 'click'").select("endpoint").distinct(), "endpoint", "left_anti")
    age = times.age_hours(F.col("published"), now())
    return only.agg(F.count_if(age <= 24).alias("day"), F.count_if((age > 24) & (age <= 168)).alias("week"), F.count_if(age > 168).alias("older"))


@query("agg_source_attribution", f"with {ad.ARTICLES_SQL}, {ad.MEMBERS_SQL} select cluster_id, source, count(*) as n from cluster_members join articles using (id) group by cluster_id, source")
def agg_source_attribution(spark, sf_dir):
    rows = ad.cluster_members(spark, sf_dir).join(ad.articles(spark, sf_dir), "id").groupBy("cluster_id", "source").count()
    held = rows.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "count")))).alias("m"))
    return held.select("cluster_id", F.explode("m").alias("source", "n"))


CUES = f"{d.event_core_cte('articles')}, mt as (select distinct source as cluster, id as article, unnest({d.cues('core')}) as key from core join articles using (id))"


@query(
    "agg_entity_consensus",
    f"""with {ad.ARTICLES_SQL}, {CUES}, z as (select cluster, count(distinct article) as n from mt group by cluster), e as (select cluster, key, count(distinct article) as sources from mt group by cluster, key),
    r as (select cluster, key, sources, sources >= ceil(0.1 * n) as confirmed from e join z using (cluster) qualify row_number() over (partition by cluster, sources >= ceil(0.1 * n) order by sources desc, key) <= 8)
    select cluster, key, key as text, sources, confirmed from r""",
)
def agg_entity_consensus(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).select(F.col("source").alias("cluster"), F.col("id").alias("article"), F.explode(t.entity_cues(F.col("headline"))).alias("key"))
    return ag.consensus(rows.withColumn("text", F.col("key")), 0.1)


VS = f"v as (select d.source as cluster, v.* from verdicts v join documents d on d.doc_id = v.id), w as (select *, greatest(confidence, 0.1) as wt from v)"
TRIAGE_SQL = f"""{ad.VERDICTS_SQL}, {VS}, c as (select cluster, category from (select cluster, category, sum(wt) as s from w group by cluster, category) qualify row_number() over (partition by cluster order by round(s, 9) desc, category) = 1),
    l as (select cluster, array_to_string(list(impact_label order by r), ',') as impact_labels from (select cluster, impact_label, row_number() over (partition by cluster order by round(sum(wt), 9) desc, impact_label) as r from w group by cluster, impact_label) where r <= 3 group by cluster),
    o as (select cluster, avg(confidence) as confidence, case when bool_or(story_type = 'hard_news') then 'hard_news' else min(story_type) end as story_type,
          arg_max(pk_relevance, case pk_relevance when 'national' then 3 when 'local' then 2 when 'foreign_with_pk_effect' then 1 else 0 end) as pk_relevance, count(*) as verdict_count from w group by cluster),
    triage as (select * from c join l using (cluster) join o using (cluster))"""


def triage(spark, sf_dir):
    rows = ad.verdicts(spark, sf_dir).join(ad.articles(spark, sf_dir).select("id", F.col("source").alias("cluster")), "id")
    return ag.cluster_triage(rows)


@query("agg_triage", f"with {TRIAGE_SQL} select cluster, category, impact_labels, round(confidence, 6) as confidence, story_type, pk_relevance, verdict_count from triage")
def agg_triage(spark, sf_dir):
    return triage(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


PROM = f"""pm as (select id % 40 as cluster, source, id, publish_date, r, case when r <= 1 then 'lead' when r <= 4 then 'topline' when r <= 8 then 'secondary' else 'tail' end as bucket,
    case when r <= 1 then 24 when r <= 4 then 18 when r <= 8 then 10 else 4 end as prom from (select *, row_number() over (partition by source order by id) as r from articles)),
    tl as (select cluster, least(sum(top), 42) as score, count(*) filter (top >= 18) as lead_sources, count(*) filter (top >= 10) as prominent_sources, sum(b) as bucket_score from (
      select cluster, source, max(prom) as top, sum(case bucket when 'lead' then 4 when 'topline' then 3 when 'secondary' then 2 else 1 end) as b from pm group by cluster, source) group by cluster)"""


def prominent(spark, sf_dir):
    from tidewire.operators.ranking import numbered

    rows = numbered(ad.articles(spark, sf_dir), ["source"], ["id"], "r")
    return rows.select((F.col("id") % 40).alias("cluster"), "source", "id", "publish_date", bucket(F.col("r")).alias("bucket"), prominence(F.col("r"), F.lit(True)).alias("prominence"))


@query("agg_topline", f"with {ad.ARTICLES_SQL}, {PROM} select cluster, score::bigint as score, lead_sources, prominent_sources, bucket_score::bigint as bucket_score from tl")
def agg_topline(spark, sf_dir):
    return ag.topline(prominent(spark, sf_dir))


EVID = f"{PROM}, ev as (select cluster, count(distinct source) as source_count, count(*) as article_count, round(greatest(0, min({hours('publish_date', DOCS_NOW)})), 4) as hours_since_latest from pm group by cluster)"


@query("agg_evidence", f"with {ad.ARTICLES_SQL}, {EVID} select cluster, source_count, article_count, hours_since_latest, score::bigint as score, lead_sources from ev join tl using (cluster)")
def agg_evidence(spark, sf_dir):
    rows = prominent(spark, sf_dir)
    facts = rows.groupBy("cluster").agg(
        F.countDistinct("source").alias("source_count"),
        F.count(F.lit(1)).alias("article_count"),
        F.round(F.greatest(F.lit(0.0), F.min(times.age_hours(F.col("publish_date"), docs_now()))), 4).alias("hours_since_latest"),
    )
    return facts.join(ag.topline(rows).select("cluster", "score", "lead_sources"), "cluster")


@query("agg_processing_health", "select count(*) as rows, count(*) filter (l.doc_id is null) as no_verdict, case when count(*) >= 200000 then 'degraded' when count(*) filter (l.doc_id is null) = 0 then 'ok' when count(*) filter (l.doc_id is null) = count(*) then 'unavailable' else 'degraded' end as status from documents d left join labels l using (doc_id)")
def agg_processing_health(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir), "id", "left")
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("category").isNull()).alias("no_verdict"))
    status = F.when(F.col("rows") >= 200000, "degraded").when(F.col("no_verdict") == 0, "ok").when(F.col("no_verdict") == F.col("rows"), "unavailable")
    return out.withColumn("status", status.otherwise("degraded"))


@query("agg_adjudication_stats", "select count(*) as decided, count(*) filter (quality = 1) as merged, count(*) filter (toxic = 1) as failed from labels")
def agg_adjudication_stats(spark, sf_dir):
    return ad.table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("quality") == 1).alias("merged"), F.count_if(F.col("toxic") == 1).alias("failed"))


ANCHORS = "list_distinct(" + d.minus(f"list_filter(list_concat({d.all_acronyms('headline')}, {d.proper('headline')}), lambda w: length(w) >= 3)", t.ANCHOR_STOPS) + ")"


@query("agg_core_anchors", f"with {ad.ARTICLES_SQL}, a as (select source, id, unnest({ANCHORS}) as k from articles), n as (select source, count(*) as n from articles group by source) select source, k as anchor, count(*) as headlines from a join n using (source) group by source, k, n having count(*) >= ceil(n / 10.0)")
def agg_core_anchors(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.select("source", F.explode(t.anchor_tokens(F.col("headline"))).alias("anchor")).groupBy("source", "anchor").agg(F.count(F.lit(1)).alias("headlines"))
    return counts.join(sizes, "source").where(F.col("headlines") >= F.ceil(F.col("n") / 10)).select("source", "anchor", "headlines")


@query(
    "agg_group_keywords",
    f"""with {ad.ARTICLES_SQL}, {TOKS}, u as (select source, id, unnest(tk) as k from ct join articles using (id)), df as (select k, count(*) as df from u group by k), g as (select source, k, count(*) as c from u group by source, k)
    select source, k as keyword from g join df using (k) where c >= 2 and df <= greatest(6, 0.06 * (select count(*) from articles)) qualify row_number() over (partition by source order by c desc, k) <= 4""",
)
def agg_group_keywords(spark, sf_dir):
    from tidewire.operators.ranking import first_per

    rows = ad.articles(spark, sf_dir)
    words = rows.select("source", F.explode(t.content_tokens(F.col("headline"))).alias("keyword"))
    counts = words.groupBy("source", "keyword").agg(F.count(F.lit(1)).alias("c")).where("c >= 2")
    spread = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    kept = counts.join(spread, "keyword").join(F.broadcast(total)).where(F.col("df") <= F.greatest(F.lit(6.0), 0.06 * F.col("total")))
    return first_per(kept, ["source"], [F.desc("c"), "keyword"], 4).select("source", "keyword")


@query("agg_group_bucket", f"with {ad.VERDICTS_SQL}, {VS} select cluster, case when count(*) filter (story_type = 'hard_news') * 2 > count(*) then 'must_have' when count(*) filter (story_type = 'advertorial') * 2 > count(*) then 'must_not_have' else 'editor_call' end as bucket from v group by cluster")
def agg_group_bucket(spark, sf_dir):
    rows = ad.verdicts(spark, sf_dir).join(ad.articles(spark, sf_dir).select("id", F.col("source").alias("cluster")), "id")
    most = lambda kind: F.count_if(F.col("story_type") == kind) * 2 > F.count(F.lit(1))
    return rows.groupBy("cluster").agg(F.when(most("hard_news"), "must_have").when(most("advertorial"), "must_not_have").otherwise("editor_call").alias("bucket"))


@query(
    "agg_cluster_quality",
    "with r as (select vec_id % 7 as ours, label as truth from embeddings) select (select coalesce(sum(n), 0)::bigint from (select count(*) as n from r group by ours having count(distinct truth) > 1)) as merged_in, (select coalesce(sum(n), 0)::bigint from (select count(*) as n from r group by truth having count(distinct ours) > 1)) as split_apart",
)
def agg_cluster_quality(spark, sf_dir):
    rows = vectors(spark, sf_dir).select((F.col("vec_id") % 7).alias("ours"), F.col("label").alias("truth"))
    return ag.partition_quality(rows, "ours", "truth")


SCORE = f"{EXPECT_SQL}, sc as (select count(*) as expected, count(*) filter (expectation in (select expectation from ok)) as matched from ex)"


#: Share of an impact line's words from which on it restates its headline.
RESTATES = 0.5
LINES = f"""ln as (select * from (select count(*) filter (trim(main_text) <> '') as impact_lines from articles),
    (select count(*) filter (restates >= {RESTATES}) as restating, count(*) filter (lacks_anchor) as lacking_anchor, count(*) filter (hedged) as hedged,
        count(*) filter (stock_form) as stock_form from ({ORACLES["txt_brief_flags"]})))"""


@query("agg_brief_score", f"with {ad.ARTICLES_SQL}, {SCORE}, {LINES} select expected, matched, expected - matched as missed, case when expected = 0 then 1.0 else round(matched::double / expected, 6) end as recall, ln.* from sc, ln")
def agg_brief_score(spark, sf_dir):
    """All articles as the brief: which expectations it meets, and how many of its impact lines have which fault."""
    ex = expectations(spark, sf_dir)
    cards = ad.articles(spark, sf_dir).select(F.col("id").alias("card"), F.col("main_text").alias("text"))
    hit = pairs.expectation_hits(ex, cards).select("expectation").distinct().withColumn("hit", F.lit(1))
    rows = ex.join(hit, "expectation", "left").agg(F.count(F.lit(1)).alias("expected"), F.count("hit").alias("matched"))
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.round(F.col("matched") / F.col("expected"), 6))
    score = rows.select("expected", "matched", (F.col("expected") - F.col("matched")).alias("missed"), recall.alias("recall"))
    # Each side is one row.
    return score.join(F.broadcast(ag.impact_lines(ad.articles(spark, sf_dir), F.col("main_text"), F.col("headline"), RESTATES)))


BUCKET = "case item_id % 10 when 9 then 'must_not_have' when 8 then 'editor_call' else 'must_have' end"


def bucketed(spark, sf_dir):
    bucket = F.when(F.col("expectation") % 10 == 9, "must_not_have").when(F.col("expectation") % 10 == 8, "editor_call").otherwise("must_have")
    return expectations(spark, sf_dir).withColumn("bucket", bucket)


@query(
    "agg_gate_golden_day",
    f"""with {ad.ARTICLES_SQL}, {EXPECT_SQL}, h as (select expectation, count(*) as cards from ok group by expectation),
    b as (select expectation, {BUCKET.replace('item_id', 'expectation')} as bucket, cards from ex left join h using (expectation)),
    s as (select count(*) filter (bucket = 'must_have') as expected, count(*) filter (bucket = 'must_have' and cards > 0) as matched,
        count(*) filter (bucket = 'must_not_have' and cards > 0) as violations, count(*) filter (bucket = 'must_have' and cards > 1) as duplicates from b),
    m as (select coalesce(sum(n), 0)::bigint as merged_in from (select count(*) as n from embeddings group by vec_id % 7 having count(distinct label) > 1)),
    e as (select count(*) filter (vec_id is null) as misses, count(*) as size from articles left join embeddings on vec_id = id),
    r as (select *, case when expected = 0 then 1.0 else matched::double / expected end as recall from s, m, e)
    select expected, matched, violations, duplicates, merged_in, misses, size, concat_ws(',', case when recall < 0.5 then 'baseline' end, case when duplicates > 0 then 'duplicates' end,
        case when merged_in > 12 then 'merged' end, case when misses > 0 then 'misses' end, case when size not between 6 and 12 then 'size' end,
        case when expected = 0 then 'unreviewed' end, case when violations > 0 then 'violations' end) as failures from r""",
)
def agg_gate_golden_day(spark, sf_dir):
    """Every check of the gate, with all articles as the brief."""
    cards = ad.articles(spark, sf_dir).select(F.col("id").alias("card"), F.col("main_text").alias("text"))
    quality = ag.partition_quality(vectors(spark, sf_dir).select((F.col("vec_id") % 7).alias("ours"), F.col("label").alias("truth")), "ours", "truth")
    misses = ad.articles(spark, sf_dir, True).agg(F.count_if(F.col("embedding").isNull()).alias("misses"))
    report = golden.brief_score(cards, bucketed(spark, sf_dir)).join(F.broadcast(quality.select("merged_in"))).join(F.broadcast(misses))
    return golden.gate(report, (6, 12), 0.5, 12).select("expected", "matched", "violations", "duplicates", "merged_in", "misses", "size", "failures")


@query(
    "agg_run_health",
    "select strftime(ts, '%Y-%m-%d') as run, count(*) as cards, count(distinct case when value < 5 then event_type end) as degraded, case when count(*) < 6 then 'too_few_cards' when count(distinct case when value < 5 then event_type end) >= 4 then 'degraded_sources' else 'ok' end as health from events group by 1",
)
def agg_run_health(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"))
    rows = rows.agg(F.count(F.lit(1)).alias("cards"), F.countDistinct(F.when(F.col("value") < 5, F.col("event_type"))).alias("degraded"))
    return rows.withColumn("health", F.when(F.col("cards") < 6, "too_few_cards").when(F.col("degraded") >= 4, "degraded_sources").otherwise("ok"))


STAGES = {"publication": "error", "editorial": "signup", "story_analysis": "purchase", "embedding": "view", "triage": "click"}


def stage_sql(kind):
    n, good = f"count(*) filter (event_type = '{kind}')", f"count(*) filter (event_type = '{kind}' and value >= 50)"
    none = "failed" if kind == STAGES["publication"] else "unavailable"
    return f"case when {n} = 0 then 'unknown' when {good} = {n} then 'ok' when {good} = 0 then '{none}' when {good} * 2 >= {n} then 'partial' else 'degraded' end"


@query(
    "agg_service_health",
    f"""with runs as (select user_id as service, max(ts) as last_run_at, max(case when value >= 50 then ts end) as success_at, count(*) as calls, count(*) filter (value >= 50) as selected,
        {', '.join(f"{stage_sql(kind)} as {stage}" for stage, kind in STAGES.items())} from events where user_id % 5 <> 0 group by user_id, date_trunc('day', ts)),
    b as (select * from runs qualify row_number() over (partition by service order by last_run_at desc) = 1),
    c as (select user_id as service, max(ts) as newest from events where event_id % 7 = 0 group by user_id),
    j as (select *, coalesce(success_at, newest) as seen, case when success_at is not null then 'heartbeat' when newest is not null then 'latest_card' else 'none' end as signal from b full join c using (service)),
    k as (select *, case when {hours('seen')} < 0 then 0 else {hours('seen')} end as age, coalesce({hours('seen')} >= 28, true) as stale from j)
    select service, case when stale or publication = 'failed' or editorial in ('unavailable', 'degraded') or story_analysis in ('partial', 'unavailable') or triage in ('unavailable', 'degraded')
            or embedding in ('unavailable', 'degraded') then 'degraded' else 'ok' end as status,
        case when publication = 'failed' then 'publication_failed' when editorial = 'unavailable' then 'editorial_unavailable' when story_analysis in ('partial', 'unavailable') then 'story_analysis_' || story_analysis
            when embedding in ('unavailable', 'degraded') then 'embedding_' || embedding when triage in ('unavailable', 'degraded') then 'triage_' || triage when signal = 'none' then 'no_signal'
            else signal || case when stale then '_stale' else '_fresh' end end as reason,
        signal, round(age, 4) as age_hours, stale as pipeline_is_stale, coalesce(calls, 0) as calls, coalesce(selected, 0) as selected from k""",
)
def agg_service_health(spark, sf_dir):
    """Users as services: their days are runs, event types their stages; a fifth has no heartbeat but cards."""
    events = ad.table(spark, sf_dir, "events").withColumnRenamed("user_id", "service")
    good = F.col("value") >= 50

    def state(kind):
        one = F.col("event_type") == kind
        n, k = F.count_if(one), F.count_if(one & good)
        none = "failed" if kind == STAGES["publication"] else "unavailable"
        return F.when(n == 0, "unknown").when(k == n, "ok").when(k == 0, none).when(k * 2 >= n, "partial").otherwise("degraded")

    runs = events.where("service % 5 <> 0").groupBy("service", F.date_trunc("day", "ts").alias("day"))
    beats = runs.agg(
        F.max("ts").alias("last_run_at"), F.max(F.when(good, F.col("ts"))).alias("success_at"), F.count(F.lit(1)).alias("calls"),
        F.count_if(good).alias("selected"), *[state(kind).alias(stage) for stage, kind in STAGES.items()],
    )
    cards = events.where("event_id % 7 = 0").select("service", F.col("ts").alias("created_at"))
    return ag.service_health(beats, cards, now()).withColumn("age_hours", F.round("age_hours", 4))


@query(
    "agg_stage_status",
    "select strftime(ts, '%Y-%m-%d') as run, event_type as stage, count(*) as attempted, count(*) filter (value >= 5) as resolved, case when count(*) filter (value >= 5) = count(*) then 'ok' when count(*) filter (value >= 5) = 0 then 'unavailable' when count(*) filter (value >= 5) * 2 >= count(*) then 'partial' else 'degraded' end as status from events group by 1, 2",
)
def agg_stage_status(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_type").alias("stage"))
    rows = rows.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("value") >= 5).alias("resolved"))
    a, r = F.col("attempted"), F.col("resolved")
    return rows.withColumn("status", F.when(r == a, "ok").when(r == 0, "unavailable").when(r * 2 >= a, "partial").otherwise("degraded"))


@query("agg_outlet_counts", "select source, count(*) as n, source in ('src0', 'src1') as known from documents group by source order by n desc, source limit 20")
def agg_outlet_counts(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(20)
    return rows.withColumn("known", F.col("source").isin("src0", "src1"))


@query(
    "agg_omissions",
    f"""with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL},
    c as (select id - id % (2 + (id // 60) % 5) as id, (id // 60) % 3 as edition, count(distinct source) as sources, coalesce(bool_or(pk_relevance = 'national'), false) as national, min(headline) as headline
        from articles left join verdicts using (id) group by 1, 2),
    dr as (select * from c where national and (id // 2) % 4 <> 0),
    b as (select edition, sources as n, substr(trim(headline), 1, 70) as head, row_number() over (partition by edition order by sources desc, substr(trim(headline), 1, 70) desc, id desc) as r from dr qualify r <= 2)
    select edition, 'omitted' as kind, id, sources, case when (id // 2) % 10 = 5 then '(no reason given)' when (id // 2) % 5 = 0 then 'same event: told' else 'unaccounted' end as reason, null as passed_over from dr where sources >= 4
    union all
    select c.edition, 'thin', id, sources, null, coalesce(string_agg(n || '-source ' || head, '; ' order by r) filter (n > sources), '')
    from c join b on b.edition = c.edition where sources < 4 and (id // 2) % 4 = 0 group by c.edition, id, sources""",
)
def agg_omissions(spark, sf_dir):
    """Two to six documents in a row are a candidate; about every fourth one is published, every fifth one has a note."""
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir).select("id", "pk_relevance"), "id", "left")
    block = F.floor(F.col("id") / 60)
    key, number = F.col("id") - F.col("id") % (2 + block % 5), F.floor(F.col("id") / 2)
    national = F.coalesce(F.bool_or(F.col("pk_relevance") == "national"), F.lit(False))
    candidates = rows.groupBy(key.alias("id"), (block % 3).alias("edition")).agg(
        F.countDistinct("source").alias("sources"), F.when(national, "national").otherwise("other").alias("relevance"), F.min("headline").alias("headline")
    )
    note = F.concat(F.col("id").cast("string"), F.when(number % 10 == 5, ": ").otherwise(": same event: told"))
    return ag.omissions(candidates, candidates.where(number % 4 == 0), candidates.where(number % 5 == 0).select("edition", note.alias("note")))


@query("agg_gated_publish", "select user_id as token, count(*) as cards, count(*) between 1 and 12 and count(distinct event_id) = count(*) and min(value) >= 0 as allowed from events group by user_id")
def agg_gated_publish(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("token"))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("cards"), (n.between(1, 12) & (F.countDistinct("event_id") == n) & (F.min("value") >= 0)).alias("allowed"))


@query("agg_embedding_misses", "select count(*) as n, count(*) filter (vec_id is null) as misses from documents left join embeddings on vec_id = doc_id")
def agg_embedding_misses(spark, sf_dir):
    return ad.articles(spark, sf_dir, True).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("misses"))


@query("agg_latest_report", "select user_id, strftime(max(case when event_id % 7 <> 0 then ts end), '%Y-%m-%d %H:%M:%S') as latest from events group by user_id")
def agg_latest_report(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 7 != 0, F.col("ts"))).alias("latest"))
    return rows.select("user_id", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))
