"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t, urls
from tidewire.operators import pairs, sets
from tidewire.queries import duck as d
from tidewire.queries.texts import PATH, SIGNATURE, SIM, WHOLE, content_sql
from tidewire.registry import query
from tidewire.sources import adapters as ad

CANON = d.canonical_url("url")


@query("join_seen_urls", f"with p as (select page_id, {CANON} as c from pages) select page_id from p where c not in (select c from p where page_id % 3 = 0)")
def join_seen_urls(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("c"))
    return pairs.unseen(pages, pages.where("page_id % 3 = 0"), "c").select("page_id")


@query("join_unique_insert", "select min(doc_id) as doc_id from documents where doc_id % 4 <> 0 and text not in (select text from documents where doc_id % 4 = 0) group by text")
def join_unique_insert(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    new, stored = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    return pairs.unique_insert(new, stored, ("content_hash",), "doc_id").select("doc_id")


SLICES = "cross join (select unnest(range(0, 4)) as b)"
BANDS = f"""{SIM}, rep as materialized (select fp, min(id) as id from sim group by fp),
    k as materialized (select id, b, (fp >> (16 * b)::ubigint) & 65535 as s from rep {SLICES}),
    band as materialized (select distinct x.id as a, y.id as b from k x join k y on x.b = y.b and x.s = y.s and x.id < y.id
        union all select r.id, s.id from rep r join sim s using (fp) where r.id <> s.id)"""


@query("join_band_candidates", f"with {ad.ARTICLES_SQL}, {BANDS} select a, b from band")
def join_band_candidates(spark, sf_dir):
    prints = pairs.fingerprints(ad.articles(spark, sf_dir), t.whole_text()).where(F.size("s") > 0)
    return pairs.band_candidates(prints)


INTER = "len(list_intersect(x.s, y.s))"
NEAR = f"""{SIM}, sh as materialized (select id, fp, list_sort(list_distinct({d.shingles(WHOLE)})) as s from articles join sim using (id)),
    rep as materialized (select fp, s, min(id) as id from sh group by fp, s),
    k as materialized (select id, b, (fp >> (16 * b)::ubigint) & 65535 as v from rep {SLICES}),
    band as materialized (select distinct x.id as a, y.id as b from k x join k y on x.b = y.b and x.v = y.v and x.id < y.id)"""


@query(
    "join_near_dup_pairs",
    f"""with {ad.ARTICLES_SQL}, {NEAR} select a, b, round({INTER}::double / (len(x.s) + len(y.s) - {INTER}), 6) as similarity
    from band join rep x on x.id = a join rep y on y.id = b
    where bit_count(xor(x.fp, y.fp)) <= 18 and {INTER} >= 0.7 * (len(x.s) + len(y.s) - {INTER})
    union all select r.id, m.id, 1.0 from rep r join sh m using (fp, s) where r.id <> m.id""",
)
def join_near_dup_pairs(spark, sf_dir):
    found = pairs.near_duplicate_pairs(ad.articles(spark, sf_dir), t.whole_text())
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("join_verdicts", f"with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL} select id, category, v.id is null as missing from articles a left join verdicts v using (id)".replace("v.id is null", "category is null"))
def join_verdicts(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir), "id", "left")
    return rows.select("id", "category", F.col("category").isNull().alias("missing"))


@query("join_members", f"with {ad.ARTICLES_SQL}, {ad.MEMBERS_SQL} select cluster_id, id, source from cluster_members join articles using (id)")
def join_members(spark, sf_dir):
    clusters = ad.cluster_members(spark, sf_dir).groupBy("cluster_id").agg(F.collect_list("id").alias("article_ids"))
    members = clusters.select("cluster_id", F.explode("article_ids").alias("id"))
    return members.join(ad.articles(spark, sf_dir), "id").select("cluster_id", "id", "source")


@query("join_time_window", "select x.event_id as a, y.event_id as b from events x join events y on x.user_id = y.user_id and x.event_id < y.event_id and abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 7200000000")
def join_time_window(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return pairs.window_pairs(events, 2)


DOT = "list_inner_product(x.embedding::double[], y.embedding::double[])"


@query("join_similar_pairs", f"select x.vec_id as a, y.vec_id as b, round({DOT}, 5) as similarity from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id where {DOT} >= 0.3")
def join_similar_pairs(spark, sf_dir):
    vectors = ad.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return pairs.similar_pairs(vectors, 0.3, "label").select("a", "b", F.round("similarity", 5).alias("similarity"))


PREP = f"""{d.event_core_cte('articles')}, prep as (select id, source, list_distinct({d.plain('core', t.HEADLINE_STOPS)}) as tokens, list_distinct({d.cues('core')}) as cues from core join articles using (id)),
    tok as (select distinct id, unnest({d.minus('list_concat(tokens, cues)', t.GENERIC_CUES)}) as k from prep),
    cand as (select distinct x.id as a, y.id as b from tok x join tok y on x.k = y.k and x.id < y.id),
    pr as (select a, b, p.source = q.source as same, list_intersect(p.tokens, q.tokens) as st, list_intersect(p.cues, q.cues) as sc,
        len(p.tokens) as pt, len(q.tokens) as qt, len(p.cues) as pc, len(q.cues) as qc from cand join prep p on p.id = a join prep q on q.id = b),
    ov as (select *, case when pt = 0 or qt = 0 then 0.0::double else len(st)::double / (pt + qt - len(st)) end as h,
        case when pc = 0 or qc = 0 then 0.0::double else len(sc)::double / (pc + qc - len(sc)) end as e, list_distinct(list_concat(st, sc)) as sh from pr),
    dd as (select *, len({d.minus('sh', t.GENERIC_CUES)}) as dn from ov),
    comp as (select a, b, h, e from dd where not (same and (len(st) = 0 or dn < 2)) and case when dn = 1 and len(sh) >= 3 and h >= 0.20 then 2 else dn end >= 2 and (h >= 0.20 or e >= 0.15))"""


def prepared(spark, sf_dir, embedded=False, *more):
    core = t.event_core(F.col("headline"))
    keep = ["id", "source", t.plain_tokens(core, t.HEADLINE_STOPS).alias("tokens"), t.entity_cues(F.col("headline")).alias("cues")]
    return ad.articles(spark, sf_dir, embedded).select(*keep, *(["embedding"] if embedded else []), *more)


@query("join_compatible_pairs", f"with {ad.ARTICLES_SQL}, {PREP} select a, b, round(h, 6) as h, round(e, 6) as e from comp")
def join_compatible_pairs(spark, sf_dir):
    found = pairs.compatible_pairs(prepared(spark, sf_dir))
    return found.select("a", "b", F.round("h", 6).alias("h"), F.round("e", 6).alias("e"))


@query(
    "join_ambiguous_pairs",
    f"""with {ad.ARTICLES_SQL}, {PREP} select a, b, shared from (
        select a, b, len(st) as shared, h + e as o, {DOT} as s from ov join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b)
        where shared >= 2 and s between 0.0 and 0.10 order by shared desc, o desc, a, b limit 24""",
)
def join_ambiguous_pairs(spark, sf_dir):
    rows = prepared(spark, sf_dir, True).where("embedding is not null")
    return sets.most_shared(rows, 2, 0.0, 0.10, 24).select("a", "b", "shared")


@query(
    "join_pair_verdicts",
    "select a.page_id, case when a.page_id % 3 = 0 then true when a.page_id % 3 = 1 then false end as same from pages a join pages b on b.page_id = a.page_id + 1 where a.url <> b.url",
)
def join_pair_verdicts(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", "url")
    two = pages.join(pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("u2")), "page_id").where("url <> u2")
    two = two.withColumn("key", F.concat_ws("#", "page_id", urls.pair_key(F.col("url"), F.col("u2"))))
    told = two.where("page_id % 3 < 2").select("key", (F.col("page_id") % 3 == 0).alias("same"))
    return two.join(told, "key", "left").select("page_id", "same")


ANCH = "list_distinct(" + d.minus(f"list_filter(list_concat({d.all_acronyms('headline')}, {d.proper('headline')}), lambda w: length(w) >= 3)", t.ANCHOR_STOPS) + ")"


@query(
    "join_related",
    f"""with {ad.ARTICLES_SQL}, r as (select id, label as cluster, embedding, {ANCH} as anchors from articles join embeddings on vec_id = id),
    p as (select id as card, cluster as pc, embedding as e, unnest(anchors) as k from r where id % 50 = 0), o as (select id, cluster, embedding as f, unnest(anchors) as k from r)
    select card, id, count(distinct k) as shared, round(max(list_inner_product(e::double[], f::double[])), 5) as similarity from p join o using (k) where cluster <> pc group by card, id
    having max(list_inner_product(e::double[], f::double[])) >= 0.05""",
)
def join_related(spark, sf_dir):
    vectors = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")
    rows = ad.articles(spark, sf_dir).join(vectors, "id").select("id", "cluster", "embedding", t.anchor_tokens(F.col("headline")).alias("anchors"))
    primary = rows.where("id % 50 = 0").withColumn("card", F.col("id"))
    return pairs.related_articles(primary, rows, 0.05).select("card", "id", "shared", F.round("similarity", 5).alias("similarity"))


@query(
    "join_previous_edition",
    f"with {ad.ARTICLES_SQL}, k as (select id, source || '|' || lower({d.collapse('headline')}) as key, publish_date from articles) select id, exists (select 1 from k o where o.id % 10 = 0 and o.key = k.key and k.publish_date <= timestamp '2024-01-04') as suppressed from k",
)
def join_previous_edition(spark, sf_dir):
    key = F.concat_ws("|", "source", F.lower(t.collapse(F.col("headline"))))
    rows = ad.articles(spark, sf_dir).select("id", key.alias("key"), "publish_date")
    before = rows.where("id % 10 = 0").select("key").distinct().withColumn("was", F.lit(True))
    old = F.col("publish_date") <= F.lit("2024-01-04").cast("timestamp")
    return rows.join(before, "key", "left").select("id", (F.coalesce("was", F.lit(False)) & old).alias("suppressed"))


KEYW = "list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))"


def expectations(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "benchmark")
    words = F.slice(F.array_sort(F.array_distinct(t.findall(F.lower("text"), "[a-z]{6,}"))), 1, 4)
    return rows.select(F.col("item_id").alias("expectation"), words.alias("keywords"), F.lit(2).alias("min_hits")).where(F.size("keywords") > 0)


EXPECT_SQL = f"""ex as (select item_id as expectation, list_sort({KEYW})[1:4] as kw from benchmark where len({KEYW}) > 0),
    hay as (select id as card, regexp_replace(lower(main_text), '[^a-z0-9 ]+', ' ', 'g') as hay from articles),
    hits as (select expectation, card, len(list_filter(kw, lambda w: contains(hay, w))) as hits, len(kw) as n from ex, hay),
    ok as (select expectation, card, hits from hits where hits >= greatest(least(2, n), 1))"""


@query("join_expectations", f"with {ad.ARTICLES_SQL}, {EXPECT_SQL} select expectation, card, hits from ok")
def join_expectations(spark, sf_dir):
    cards = ad.articles(spark, sf_dir).select(F.col("id").alias("card"), F.col("main_text").alias("text"))
    return pairs.expectation_hits(expectations(spark, sf_dir), cards)


TOKS = f"ct as (select id, list_distinct({content_sql('headline')}) as tk from articles)"


@query(
    "join_duplicate_cards",
    f"""with {ad.ARTICLES_SQL}, {TOKS}, u as (select id, unnest(tk) as k, len(tk) as n from ct)
    select x.id as a, y.id as b, round(count(*)::double / least(x.n, y.n), 6) as overlap from u x join u y on x.k = y.k and x.id < y.id group by x.id, y.id, x.n, y.n having count(*) >= 0.75 * least(x.n, y.n)""",
)
def join_duplicate_cards(spark, sf_dir):
    cards = ad.articles(spark, sf_dir).select("id", t.content_tokens(F.col("headline")).alias("tokens"))
    return pairs.duplicate_cards(cards).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query(
    "join_coverage",
    f"""with {ad.ARTICLES_SQL}, {TOKS}, o as (select id, unnest(tk) as k, len(tk) as n from ct), w as (select item_id as id, unnest(list_distinct({content_sql('text')})) as k, len(list_distinct({content_sql('text')})) as n from benchmark),
    b as (select w.id as w, o.id as o, count(*)::double / least(w.n, o.n) as c from w join o using (k) group by w.id, o.id, w.n, o.n)
    select item_id as w, round(coalesce(max(c), 0.0::double), 6) as best, coalesce(max(c), 0) >= 0.5 as covered from benchmark left join b on b.w = item_id group by item_id""",
)
def join_coverage(spark, sf_dir):
    wanted = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), t.content_tokens(F.col("text")).alias("tokens"))
    ours = ad.articles(spark, sf_dir).select("id", t.content_tokens(F.col("headline")).alias("tokens"))
    return pairs.coverage(wanted, ours).select("w", F.round("best", 6).alias("best"), "covered")


CH = f"p as (select page_id, {CANON} as c from pages), l as (select distinct c from p where page_id % 3 <> 0), r as (select distinct c from p where page_id % 3 <> 1)"


@query(
    "join_discovery_sets",
    f"with {CH} select count(*) as n_union, count(*) filter (where r.c is null) as only_left, count(*) filter (where l.c is null) as only_right, round(100.0 * count(*) filter (where l.c is not null and r.c is not null) / count(*), 4)::double as covered_pct from l full join r on l.c = r.c",
)
def join_discovery_sets(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("c"))
    left = pages.where("page_id % 3 <> 0").select("c").distinct().withColumn("l", F.lit(1))
    right = pages.where("page_id % 3 <> 1").select("c").distinct().withColumn("r", F.lit(1))
    return left.join(right, "c", "full").agg(
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
        F.round(100.0 * F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.count(F.lit(1)), 4).alias("covered_pct"),
    )


@query(
    "join_body_fidelity",
    f"""with {ad.ARTICLES_SQL}, f as (select source, len(list_intersect(list_distinct({content_sql('html')}), list_distinct({content_sql('main_text')})))::double / greatest(1, len(list_distinct({content_sql('html')}))) as recall,
        length(main_text)::double / length(html) as ratio from pages join articles on id = page_id)
    select source, round(quantile_cont(recall, 0.5), 6) as recall, round(quantile_cont(ratio, 0.5), 6) as ratio, case when quantile_cont(recall, 0.5) >= 0.9 then 'complete' when quantile_cont(recall, 0.5) >= 0.6 then 'partial' else 'teaser' end as verdict from f group by source""",
)
def join_body_fidelity(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    rows = ad.articles(spark, sf_dir).join(pages, "id")
    page, feed = t.content_tokens(F.col("html")), t.content_tokens(F.col("main_text"))
    rows = rows.select("source", (F.size(F.array_intersect(page, feed)) / F.greatest(F.size(page), F.lit(1))).alias("recall"), (F.length("main_text") / F.length("html")).alias("ratio"))
    mid = rows.groupBy("source").agg(F.percentile("recall", 0.5).alias("recall"), F.percentile("ratio", 0.5).alias("ratio"))
    verdict = F.when(F.col("recall") >= 0.9, "complete").when(F.col("recall") >= 0.6, "partial").otherwise("teaser")
    return mid.select("source", F.round("recall", 6).alias("recall"), F.round("ratio", 6).alias("ratio"), verdict.alias("verdict"))


@query("join_unresolved", f"with {ad.ARTICLES_SQL} select id from articles where id not in (select doc_id from labels) order by publish_date desc, id limit 100")
def join_unresolved(spark, sf_dir):
    open_ = pairs.unseen(ad.articles(spark, sf_dir), ad.verdicts(spark, sf_dir), "id")
    return open_.orderBy(F.desc("publish_date"), "id").limit(100).select("id")
