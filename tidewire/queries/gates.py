"""Filters, gates and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t, times, urls
from tidewire.operators import gates, validation
from tidewire.queries import duck as d
from tidewire.registry import query
from tidewire.sources import adapters as ad

NOW = f"timestamp '{ad.NOW_EVENTS}'"
DOCS_NOW = f"timestamp '{ad.NOW_DOCS}'"
now = lambda: F.lit(ad.NOW_EVENTS).cast("timestamp")
docs_now = lambda: F.lit(ad.NOW_DOCS).cast("timestamp")
hours = lambda ts, at=NOW: f"((epoch_us({at}) - epoch_us({ts})) / 3600000000.0)::double"

REPORT_SQL = f"""report as (select endpoint, newest_age, n_items, n_fresh,
    case when newest_age is null then 'no-dates' when newest_age > 48 then 'STALE' when newest_age < -1 then 'future-clock' else 'ok' end as status
    from (select endpoint, min({hours('published')}) as newest_age, count(*) as n_items, count(*) filter ({hours('published')} <= 36) as n_fresh from items group by endpoint))"""


@query("agg_endpoint_report", f"with {ad.ITEMS_SQL}, {REPORT_SQL} select endpoint, round(newest_age, 4) as newest_age, n_items, n_fresh, status, case when status = 'ok' then n_fresh else 0 end as accepted from report")
def agg_endpoint_report(spark, sf_dir):
    report = gates.endpoint_report(ad.feed_items(spark, sf_dir), now())
    return report.withColumn("newest_age", F.round("newest_age", 4))


@query("flt_endpoint_gate", f"with {ad.ITEMS_SQL}, {REPORT_SQL} select item_id, endpoint from items join report using (endpoint) where status = 'ok' and {hours('published')} <= 36")
def flt_endpoint_gate(spark, sf_dir):
    return gates.gated_items(ad.feed_items(spark, sf_dir), now()).select("item_id", "endpoint")


@query("flt_item_age", f"with {ad.ITEMS_SQL} select item_id from items where {hours('published')} <= 36")
def flt_item_age(spark, sf_dir):
    return ad.feed_items(spark, sf_dir).where(times.age_hours(F.col("published"), now()) <= 36).select("item_id")


DOMAIN = f"regexp_extract({d.host('url')}, '[^.]+[.][^.]+$', 0)"
TWIN = "regexp_replace({}, '^www[.]', '')"


@query(
    "flt_item_valid",
    f"""with r as (select page_id, trim(url) as url, {d.markup("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as headline, {DOMAIN} as source from pages),
    c as (select source, arg_min(url, page_id) as base from r group by source)
    select page_id from r join c using (source) where regexp_matches(url, '^https?://') and headline <> '' and {d.host('url')} <> '' and {TWIN.format(d.host('url'))} = {TWIN.format(d.host('base'))}""",
)
def flt_item_valid(spark, sf_dir):
    """Pages as items of the publisher of their domain, whose catalogue entry is the URL of its first page."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    source = F.regexp_extract(urls.host(F.col("url")), "[^.]+[.][^.]+$", 0)
    items = ad.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("link"), t.clean_markup(title).alias("headline"), source.alias("source"))
    sources = items.groupBy("source").agg(F.min_by("link", "page_id").alias("url"))
    return gates.valid_items(items, sources).select("page_id")


@query("flt_lookback", f"select event_id, user_id from events where ts >= {NOW} - interval 3 day and event_type in (select event_type from events where event_id % 97 = 0)")
def flt_lookback(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events")
    wanted = events.where("event_id % 97 = 0").select("event_type").distinct()
    young = events.where(F.col("ts").cast("timestamp") >= now() - F.expr("interval 3 days"))
    return young.join(wanted, "event_type", "left_semi").select("event_id", "user_id")


GATES_SQL = f"""case when category in ('sports', 'entertainment') then 'category' when story_type in ('advertorial', 'opinion') then 'story_type'
    when pk_relevance = 'foreign' then 'foreign' when story_type is null then 'no_verdict' when {hours('publish_date', DOCS_NOW)} > 36 then 'too_old'
    when id % 50 = 0 then 'repeats_last_edition' end"""


@query("flt_hard_gates", f"with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL} select id, {GATES_SQL} as reason from articles left join verdicts using (id)")
def flt_hard_gates(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir), "id", "left")
    rows = rows.withColumns({"published": F.col("publish_date"), "repeated": F.col("id") % 50 == 0})
    return rows.select("id", gates.reject_reason(docs_now()).alias("reason"))


@query("flt_feed", f"with {ad.ARTICLES_SQL}, {ad.VERDICTS_SQL} select id, category, impact_label from articles join verdicts using (id) where story_type <> 'advertorial' and category = 'economy' and impact_label in ('WALLET', 'WORK') order by publish_date desc, id limit 30")
def flt_feed(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).join(ad.verdicts(spark, sf_dir), "id").where("story_type <> 'advertorial' and category = 'economy'")
    rows = rows.where(F.arrays_overlap(F.array("impact_label"), t.words_in(["WALLET", "WORK"])))
    return rows.orderBy(F.desc("publish_date"), "id").limit(30).select("id", "category", "impact_label")


@query("flt_latest_edition", "select event_id from events where ts::date = (select max(ts::date) from events)")
def flt_latest_edition(spark, sf_dir):
    cards = ad.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("brief_run_at"))
    return gates.latest_edition(cards).select("event_id")


KW = f"list_distinct({d.plain('headline', t.STORY_STOPS, 4)})"


@query(
    "flt_relevant_articles",
    f"""with {ad.ARTICLES_SQL}, k as (select id, source, {KW} as kw from articles),
    s as (select source, kw as story from k qualify row_number() over (partition by source order by id) = 1),
    n as (select id, source, len(list_intersect(kw, story)) >= 2 as near from k join s using (source))
    select id from (select id, near, bool_or(near) over (partition by source) as any_near from n) where near or not any_near""",
)
def flt_relevant_articles(spark, sf_dir):
    rows = ad.articles(spark, sf_dir).select("id", F.col("source").alias("cluster"), t.plain_tokens(F.col("headline"), t.STORY_STOPS, 4).alias("keywords"))
    story = rows.groupBy("cluster").agg(F.min_by("keywords", "id").alias("story"))
    return gates.relevant_articles(rows.join(story, "cluster")).select("id")


@query(
    "flt_valid_drafts",
    """select user_id, day from (select user_id, cast(cast(ts as date) as varchar) as day, count(*) as n, count(distinct event_type) as k, max(value) as top
       from events group by user_id, cast(ts as date)) where n between 1 and 12 and n = k and top < 1000000""",
)
def flt_valid_drafts(spark, sf_dir):
    """A user's events of a day are a draft."""
    drafts = ad.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    facts = drafts.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("k"), F.max("value").alias("top"))
    return facts.where("n between 1 and 12 and n = k and top < 1000000").select("user_id", "day")


@query(
    "val_constraints",
    """select 'headline_length' as rule, doc_id::varchar as key from documents where not (length(split_part(text, chr(10), 1)) between 8 and 180)
       union all select 'unique_text', text from documents group by text having count(*) > 1""",
)
def val_constraints(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents")
    size = F.length(F.substring_index("text", "\n", 1)).between(8, 180)
    return gates.violations(docs, "doc_id", {"headline_length": size}, ("text",))


@query("val_sources", f"select 'bad_url' as rule, page_id::varchar as key from pages where not regexp_matches(url, '^https?://[^/]+') union all select 'tier', page_id::varchar from pages where page_id % 3 = 2")
def val_sources(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").withColumn("tier", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("page_id") % 3 + 1).cast("int")))
    return gates.violations(pages, "page_id", {"bad_url": F.col("url").rlike("^https?://[^/]+"), "tier": F.col("tier").isin("A", "B")})


@query("val_article", f"with {ad.ARTICLES_SQL} select 'body' as rule, id::varchar as key from articles where length(trim(main_text)) < 200 union all select 'unique_headline', headline from articles group by headline having count(*) > 1")
def val_article(spark, sf_dir):
    return gates.violations(ad.articles(spark, sf_dir), "id", {"body": F.length(F.trim("main_text")) >= 200}, ("headline",))


@query(
    "val_triage",
    f"""with {ad.VERDICTS_SQL}, j as (select id, '{{"key":"i' || id || '","category":"' || category || '","confidence":' || case when id % 9 = 0 then '1.5' else confidence::varchar end || case when id % 7 = 0 then '' else '}}' end as answer from verdicts)
    select id, json_extract_string(answer, '$.category') as category from j where json_valid(answer) and json_extract(answer, '$.confidence')::double between 0 and 1""",
)
def val_triage(spark, sf_dir):
    conf = F.when(F.col("id") % 9 == 0, "1.5").otherwise(F.col("confidence").cast("string"))
    end = F.when(F.col("id") % 7 == 0, "").otherwise("}")
    answer = F.concat(F.lit('{"key":"i'), F.col("id").cast("string"), F.lit('","category":"'), "category", F.lit('","confidence":'), conf, end)
    schema = "key string, category string, confidence double, _corrupt_record string"
    parsed = ad.verdicts(spark, sf_dir).select("id", F.from_json(answer, schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("a"))
    good = parsed.where("a._corrupt_record is null and a.confidence between 0 and 1").where(F.col("a.category").isin(ad.CATEGORIES))
    return good.select("id", F.col("a.category").alias("category"))


@query(
    "val_adjudication",
    """select conv_id, turn, contains(lower(text), ' the ') as same_event from conversations
    where (conv_id + turn // 8) % 11 <> 0 and turn % 8 <> 3 and length(text) % 7 <> 0 and length(text) % 5 <> 0""",
)
def val_adjudication(spark, sf_dir):
    """Turns as pairs in batches of eight; answers have ids nobody asked, states that are no booleans and notes beside them.

    Some answers are broken, fenced, or bare lists.
    """
    size = F.length("text")
    rows = ad.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", F.floor(F.col("turn") / 8)).alias("batch"), F.concat(F.lit("p"), F.col("turn") % 8).alias("pair_id"),
        F.when(F.col("turn") % 8 == 3, "q3").otherwise(F.concat(F.lit("p"), F.col("turn") % 8)).alias("said"),
        F.when(size % 7 == 0, '"maybe"').otherwise(F.lower("text").contains(" the ").cast("string")).alias("same"),
        F.when(size % 5 == 0, ',"note":"none"').otherwise(',"confidence":0.8').alias("more"),
        (F.col("conv_id") + F.floor(F.col("turn") / 8)).alias("n"),
    )
    verdict = F.concat(F.lit('{"id":"'), "said", F.lit('","same_event":'), "same", "more", F.lit("}"))
    lists = rows.groupBy("batch", "n").agg(F.concat(F.lit("["), F.array_join(F.collect_list(verdict), ","), F.lit("]")).alias("list"))
    whole = F.concat(F.lit('{"verdicts":'), "list", F.lit("}"))
    answer = F.when(F.col("n") % 11 == 0, F.concat(F.lit("{"), whole)).when(F.col("n") % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
    answers = lists.select("batch", answer.otherwise(F.col("list")).alias("answer"))
    return validation.adjudication_verdicts(answers, rows.select("batch", "pair_id", "conv_id", "turn")).select("conv_id", "turn", "same_event")


def editorial_inputs(spark, sf_dir):
    """An answer of three stories per document, made from it, and the candidate that it may choose.

    The first story leaves out or breaks a field by the id, the second repeats the cluster in full, the third names another one.
    """
    rows = ad.articles(spark, sf_dir).select("id", "source", "headline", "main_text", t.first_sentences(F.col("main_text"), 3).alias("said"))
    rows = rows.withColumn("line", F.get("said", F.lit(0)))
    category = F.element_at(F.array(*[F.lit(c) for c in ad.CATEGORIES]), (F.col("id") % 11 + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(c) for c in ad.LABELS]), (F.col("id") % 6 + 1).cast("int"))
    n = F.col("id") % 8
    full = {
        "cluster_id": F.col("id").cast("string"),
        "priority": F.when(n != 1, (F.col("id") % 120).cast("string")),
        "headline": F.when(n != 2, F.to_json(F.array("headline"))),
        "impact_line": F.when(n != 3, F.to_json(F.array("line"))),
        "category": F.when(n == 4, F.lit('["fashion"]')).otherwise(F.to_json(F.array(category))),
        "impact_labels": F.when(n == 5, F.lit("[]")).otherwise(F.to_json(F.array(label))),
        "story_tags": F.when(n != 6, F.to_json(F.array(category, F.lit(" "), "source"))),
        "confidence": F.when(n == 7, F.lit('"high"')).otherwise(F.lit("0.8")),
    }
    inner = {"headline", "impact_line", "category"}
    value = lambda k, c: F.regexp_extract(c, r"(?s)^\[(.*)\]$", 1) if k in inner else c
    pairs_ = [F.when(c.isNotNull(), F.concat(F.lit(f'"{k}":'), F.lit('"') if k == "cluster_id" else F.lit(""), value(k, c), F.lit('"') if k == "cluster_id" else F.lit(""))) for k, c in full.items()]
    story = F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*pairs_)), ","), F.lit("}"))
    again = F.to_json(F.struct(F.col("id").cast("string").alias("cluster_id"), F.lit(60).alias("priority"), F.substring("main_text", 1, 100).alias("impact_line")))
    other = F.to_json(F.struct((F.col("id") + 1).cast("string").alias("cluster_id"), F.lit("Nobody may choose this one").alias("impact_line")))
    list_ = F.concat(F.lit("["), F.concat_ws(",", story, again, other), F.lit("]"))
    answer = F.when(F.col("id") % 2 == 0, list_).otherwise(F.concat(F.lit('{"stories":'), list_, F.lit("}")))
    answers = rows.select(F.col("id").alias("edition"), answer.alias("answer"))
    facts = F.slice("said", 2, 2)
    candidates = rows.select(
        F.col("id").alias("edition"), F.col("id").alias("cluster"), "headline", category.alias("category"), F.array(label).alias("labels"),
        F.lit(1).alias("articles"), facts.alias("facts"), "source",
    )
    return answers, candidates


@query("val_editorial")
def val_editorial(spark, sf_dir):
    answers, candidates = editorial_inputs(spark, sf_dir)
    return validation.editorial_stories(answers, candidates, ad.CATEGORIES, ad.LABELS)


@query("val_grounding")
def val_grounding(spark, sf_dir):
    """The first check that a card fails: its line is its whole body, its reporting that of the next document."""
    rows = ad.articles(spark, sf_dir).select("id", "headline", "main_text")
    other = rows.select((F.col("id") - 1).alias("id"), F.concat_ws(" ", "headline", "main_text").alias("reporting"))
    rows = rows.join(other, "id", "left")
    failed = validation.grounding_failure(F.col("headline"), F.col("main_text"), F.lit(None).cast("string"), F.col("reporting"))
    return rows.select("id", failed.alias("f")).select("id", F.col("f.cause").alias("cause"), F.col("f.token").alias("token"))


def analysis_inputs(spark, sf_dir):
    """Answers and packets per document: itself is the primary article, the next one related; the body is the analysis."""
    rows = ad.articles(spark, sf_dir).select("id", "source", "headline", "main_text")
    evidence = F.concat_ws(" ", "headline", "main_text").alias("evidence")
    # An article of two packets is read once.
    facts = validation.evidence_facts(rows.select("id", F.col("source").alias("publisher"), evidence))
    parts = F.array(F.struct(F.col("id").alias("card"), F.lit("primary_event").alias("role")), F.struct((F.col("id") - 1).alias("card"), F.lit("related").alias("role")))
    packet = facts.select(F.inline(parts), "id", "publisher", "tokens", "words")
    packet = packet.join(rows.select(F.col("id").alias("card")), "card", "left_semi")
    said = t.sentences(F.col("main_text"))
    claims = F.transform(said, lambda x, i: F.struct(x.alias("text"), F.array((F.col("id") + F.when(i % 4 == 3, i % 3).otherwise(0)).cast("string")).alias("ids")))
    added = F.when(F.col("id") % 3 == 0, " It cost 22 billion.").when(F.col("id") % 7 == 0, " Dawn reports a rise.").otherwise("")
    question = F.when(F.col("id") % 5 != 0, F.concat(F.lit("What audit or oversight of "), F.try_element_at(said, F.lit(-1)), F.lit("?")))
    answers = rows.select(
        F.col("id").alias("card"), F.concat("main_text", added).alias("analysis"), claims.alias("claims"), question.alias("question"),
        F.array(F.col("id").cast("string")).alias("question_ids"), F.lit("evidence_gap").alias("basis"), t.anchor_tokens(F.col("headline")).alias("subject"),
    )
    return answers, packet


@query("val_story_analysis")
def val_story_analysis(spark, sf_dir):
    """Errors of an answer against its packet: those that reject it, those that drop its question, and soft ones."""
    checked = validation.analysis_errors(*analysis_inputs(spark, sf_dir))
    names = ["errors", "soft_errors", "question_errors", "related"]
    return checked.select(F.col("card").alias("id"), "accepted", "question", *[F.array_join(c, ",").alias(c) for c in names])
