"""Row-level projections: text, URL and time rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as t, times, urls
from tidewire.operators.models import WATCH, impact_copy, watch_copy
from tidewire.operators.ranking import body_status, bucket, prominence
from tidewire.queries import duck as d
from tidewire.registry import query
from tidewire.shared import materialize
from tidewire.sources import adapters as ad

A = f"with {ad.ARTICLES_SQL} "


def on_articles(name, column, sql_expr, out="value"):
    """Register one expression over articles with its SQL."""

    @query(name, f"{A} select id, {sql_expr} as {out} from articles")
    def run(spark, sf_dir):
        return ad.articles(spark, sf_dir).select("id", column().alias(out))


def on_core(name, column, sql_expr):
    @query(name, f"with {ad.ARTICLES_SQL}, {d.event_core_cte('articles')} select id, {sql_expr} as value from core")
    def run(spark, sf_dir):
        return ad.articles(spark, sf_dir).select("id", column().alias("value"))


body, head = lambda: F.col("main_text"), lambda: F.col("headline")
WHOLE = "(headline || '. ' || main_text)"


@query(
    "txt_clean_markup",
    f"""select page_id, {d.normalize("replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!.CDATA.(.*?)..>', '\\1', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')")} as value from pages""",
)
def txt_clean_markup(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", t.clean_markup(F.col("html")).alias("value"))


@query("txt_normalize", f"{A} select id, {d.normalize('main_text')} as value from articles")
def txt_normalize(spark, sf_dir):
    return t.compose(ad.articles(spark, sf_dir).select("id", t.normalize(F.col("main_text")).alias("value")), "value")


@query("txt_strip_furniture")
def txt_strip_furniture(spark, sf_dir):
    return ad.articles(spark, sf_dir).select("id", t.strip_furniture(F.col("main_text"), F.col("headline")).alias("value"))


@query("txt_sentences")
def txt_sentences(spark, sf_dir):
    return ad.articles(spark, sf_dir).select("id", t.sentences(F.col("main_text")).alias("value"))


on_articles("txt_acronyms", lambda: t.joined(t.acronyms(body())), d.joined(d.acronyms("main_text")))
on_articles("txt_shingles", lambda: F.array_join(t.shingles(t.whole_text()), "|"), f"array_to_string({d.shingles(WHOLE)}, '|')")
on_articles(
    "txt_shingle_hashes",
    lambda: F.array_join(F.sort_array(F.transform(t.shingle_hashes(t.whole_text()), lambda h: F.hex(h))), ","),
    f"array_to_string(list_sort(list_distinct(list_transform({d.shingles(WHOLE)}, lambda s: ltrim(upper(substr(md5(s), 1, 16)), '0')))), ',')",
)
SIM = f"""sim as materialized (
    select id, sum(case when 2 * ones > n then (1::hugeint << b::int) else 0 end)::ubigint as fp from (
        select id, b, sum(((h >> b::ubigint) & 1)::int) as ones, count(*) as n from (
            select id, unnest(list_transform({d.shingles(WHOLE)}, lambda s: {d.hash64('s')})) as h from articles)
        cross join (select unnest(range(0, 64)) as b) group by id, b)
    group by id)"""
SIGNED = "case when fp > 9223372036854775807 then (fp::hugeint - 18446744073709551616)::bigint else fp::bigint end"


def prints(spark, sf_dir):
    return t.simhashes(ad.articles(spark, sf_dir).select("id", t.whole_text().alias("x")), F.col("x")).select("id", "fp")


@query("txt_simhash64", f"with {ad.ARTICLES_SQL}, {SIM} select a.id, coalesce({SIGNED}, 0)::bigint as value from articles a left join sim using (id)")
def txt_simhash64(spark, sf_dir):
    return prints(spark, sf_dir).select("id", F.col("fp").alias("value"))


@query(
    "txt_hamming",
    f"with {ad.ARTICLES_SQL}, {SIM} select a.id, bit_count(xor(a.fp, b.fp))::int as value from sim a join sim b on b.id = a.id + 1",
)
def txt_hamming(spark, sf_dir):
    own = materialize(prints(spark, sf_dir), "prints")
    nxt = own.select((F.col("id") - 1).alias("id"), F.col("fp").alias("fp2"))
    return own.join(nxt, "id").select("id", t.hamming(F.col("fp"), F.col("fp2")).cast("int").alias("value"))


@query(
    "txt_band_keys",
    f"""with {ad.ARTICLES_SQL}, {SIM} select id, b::int as band, ((fp >> (16 * b)::ubigint) & 65535)::bigint as value
        from sim cross join (select unnest(range(0, 4)) as b)""",
)
def txt_band_keys(spark, sf_dir):
    keys = t.band_keys(F.col("fp"))
    return prints(spark, sf_dir).select("id", F.posexplode(keys).alias("band", "value"))


def on_pair(name, column, sql_expr, tokens, sql_tokens):
    """An overlap of the tokens of headline and body."""

    @query(name, f"{A}, p as (select id, list_distinct({sql_tokens('headline')}) as a, list_distinct({sql_tokens('main_text')}) as b from articles) select id, round({sql_expr}, 6) as value from p")
    def run(spark, sf_dir):
        two = ad.articles(spark, sf_dir).select("id", tokens(head()).alias("a"), tokens(body()).alias("b"))
        return two.select("id", F.round(column(F.col("a"), F.col("b")), 6).alias("value"))


content_sql = lambda x: d.minus(f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda w: w <> '')", t.SCORER_STOPS)
both = "len(list_intersect(a, b))"
union = f"(len(a) + len(b) - {both})"
on_pair("txt_jaccard", t.jaccard, f"case when {union} = 0 then 1.0::double else {both}::double / {union} end", t.content_tokens, content_sql)
on_pair("txt_set_overlap", t.set_overlap, f"case when len(a) = 0 or len(b) = 0 then 0.0::double else {both}::double / {union} end", t.content_tokens, content_sql)
on_pair("txt_containment", t.containment, f"case when len(a) = 0 or len(b) = 0 then 0.0::double else {both}::double / least(len(a), len(b)) end", t.content_tokens, content_sql)
on_core("txt_event_core", lambda: t.event_core(head()), "core")
on_core("txt_headline_tokens", lambda: t.joined(t.headline_tokens(head())), d.joined(d.plain("core", t.HEADLINE_STOPS)))
on_core("txt_entity_cues", lambda: t.joined(t.entity_cues(head())), d.joined(d.cues("core")))
on_articles("txt_content_tokens", lambda: t.joined(t.content_tokens(body())), d.joined(content_sql("main_text")))
on_articles(
    "txt_anchor_tokens",
    lambda: t.joined(t.anchor_tokens(body())),
    d.joined(d.minus(f"list_filter(list_concat({d.all_acronyms('main_text')}, {d.proper('main_text')}), lambda w: length(w) >= 3)", t.ANCHOR_STOPS)),
)
SIGNATURE = d.minus("list_filter(regexp_extract_all(lower(regexp_replace({}, '<[^>]+>', ' ', 'g')), '[a-z][a-z0-9]+'), lambda w: length(w) >= 3)", t.HEADLINE_STOPS)
PATH = "regexp_extract(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?#]*([^?#]*)', 1)"


@query("txt_signature", f"select page_id, {d.joined(SIGNATURE.format('html'))} as words, {d.joined(SIGNATURE.format(PATH))} as slug from pages")
def txt_signature(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages")
    return pages.select("page_id", t.joined(t.signature(F.col("html"))).alias("words"), t.joined(t.slug_tokens(F.col("url"))).alias("slug"))


on_articles(
    "txt_story_keywords",
    lambda: t.joined(t.story_keywords(body())),
    d.joined(
        f"list_concat({d.acronyms('main_text')}, "
        + d.minus("list_filter(list_transform(regexp_extract_all(main_text, '[A-Za-z0-9'']+'), lambda w: trim(lower(w), '''')), lambda w: length(w) >= 4 and not regexp_full_match(w, '[0-9]+'))", t.STORY_STOPS)
        + ")"
    ),
)


@query("txt_evidence_tokens")
def txt_evidence_tokens(spark, sf_dir):
    rows = ad.articles(spark, sf_dir)
    return rows.select("id", t.joined(t.evidence_tokens(body())).alias("value"), t.joined(t.source_evidence_tokens(body())).alias("source_value"))


@query("txt_question_phrases")
def txt_question_phrases(spark, sf_dir):
    turns = ad.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", t.joined(t.question_phrases(F.col("text"))).alias("value"))


def publishers_sql() -> str:
    out = []
    for source, names in t.PUBLISHERS.items():
        forms = "|".join(sorted({f for n in names for f in (n.title(), n.upper())}))
        near = f"\\b(?:{forms})\\b\\W+(?:\\w+\\W+){{0,2}}{t.REPORTING_VERB}\\b"
        out.append(f"case when regexp_matches(main_text, '{near}') or regexp_matches(main_text, '(?i)\\baccording to\\s+(?:the\\s+)?(?:{forms})\\b') then '{source}' end")
    return f"array_to_string(list_filter([{', '.join(out)}], lambda s: s is not null), ',')"


on_articles("txt_named_publishers", lambda: F.array_join(t.named_publishers(body()), ","), publishers_sql())


@query("txt_culpability")
def txt_culpability(spark, sf_dir):
    return ad.articles(spark, sf_dir).select("id", t.asserts_culpability(body()).alias("value"))


on_articles(
    "txt_entity_key",
    lambda: F.concat_ws("|", t.entity_key(head(), F.lit("ORG")), t.entity_key(F.concat(F.lit("About $"), head()), F.lit("MONEY")), t.capitals(head())),
    f"""regexp_replace(lower({d.collapse('headline')}), '^(?:the |an? )', '') || '|' ||
        regexp_replace(regexp_replace(regexp_replace(lower({d.collapse("'About $' || headline")}), '^(?:the |an? )', ''),
        '^(?:approximately |about |around |nearly |over |almost |up to )', ''), '^[$£€¥]+', '') || '|' ||
        length(regexp_replace(headline, '[^A-Z]', '', 'g'))""",
)
LOWD = "trim(lower(trim(headline)), '''')"
on_articles(
    "txt_entity_filter",
    lambda: F.when(t.keep_entity(head(), F.lit("DATE")), t.truncate(head(), 140)),
    f"""case when length(headline) >= 2 and not regexp_matches(headline, '(?i)^https?://') and not contains({LOWD}, 'comments comments')
        and not (regexp_full_match({LOWD}, '{t.LOW_DATES}') or regexp_full_match({LOWD}, '(?:19|20)\\d{{2}}|\\d+\\s+(?:day|month|year)s?')
                 or (regexp_matches({LOWD}, '^(?:a|an|the|last|next|earlier|later) ') and regexp_matches({LOWD}, 'day|month|year')))
        then case when length({d.collapse('headline')}) <= 140 then {d.collapse('headline')} else rtrim(substr({d.collapse('headline')}, 1, 139)) || '…' end end""",
)


@query("txt_snippet")
def txt_snippet(spark, sf_dir):
    return ad.articles(spark, sf_dir).select("id", t.snippet(body()).alias("value"))


on_articles(
    "txt_truncate",
    lambda: t.truncate(body(), 220),
    f"case when length({d.collapse('main_text')}) <= 220 then {d.collapse('main_text')} else rtrim(substr({d.collapse('main_text')}, 1, 219)) || '…' end",
)
fold = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
on_articles(
    "txt_redundant_snippet",
    lambda: t.redundant_snippet(body(), head()),
    f"case when not ({fold('main_text')} = {fold('headline')} or regexp_matches(lower(main_text), '^(?:photo|file photo|representational image)\\b')) then main_text end",
)


@query(
    "txt_impact_label",
    "select event_id, case "
    + " ".join(f"when contains(upper(event_type), '{k}') then '{k}'" for k in t.IMPACT_LABELS)
    + " else 'UPDATE' end as value from events",
)
def txt_impact_label(spark, sf_dir):
    return ad.table(spark, sf_dir, "events").select("event_id", t.impact_label(F.col("event_type")).alias("value"))


IMPACT = "main_text"
NORM = f"regexp_replace(lower({IMPACT}), '[^a-z0-9 ]+', ' ', 'g')"


@query(
    "txt_brief_flags",
    f"""{A}, f as (select id, list_distinct({content_sql(IMPACT)}) as m, list_distinct({content_sql('headline')}) as h, {IMPACT} as i, {NORM} as n from articles)
    select id, trim(i) <> '' and not (regexp_matches(n, '[0-9]') or contains(i, '%')
        or list_has_any(string_split_regex(n, ' +'), {d.quoted([*t.CONCRETE_WORDS, 'rs'])})) as lacks_anchor,
        regexp_matches(i, '{t.HEDGE}') as hedged, regexp_matches(i, '(?i)^[^.]{{0,60}}?\\bfaces?\\b') as stock_form,
        round(case when len(m) = 0 then 0.0::double else len(list_intersect(m, h))::double / len(m) end, 6) as restates from f""",
)
def txt_brief_flags(spark, sf_dir):
    flags = t.brief_flags(body(), head())
    return ad.articles(spark, sf_dir).select("id", *[(F.round(c, 6) if k == "restates" else c).alias(k) for k, c in flags.items()])


@query("url_canonical", f"select page_id, {d.canonical_url('url')} as value from pages")
def url_canonical(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("value"))


BASE = "'https://www.site1.example.com'"
bare = lambda x: f"regexp_replace({x}, '^www\\.', '')"


@query("url_host_allowed", f"select page_id, {bare(d.host('url'))} <> '' and {bare(d.host('url'))} = {bare(d.host(BASE))} as value from pages")
def url_host_allowed(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages")
    return pages.select("page_id", urls.host_allowed(F.col("url"), F.lit(BASE.strip("'"))).alias("value"))


@query("url_pair_key", "select a.page_id, array_to_string(list_sort([a.url, b.url]), '␟') as value from pages a join pages b on b.page_id = a.page_id + 1")
def url_pair_key(spark, sf_dir):
    pages = ad.table(spark, sf_dir, "pages").select("page_id", "url")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("url2"))
    return pages.join(nxt, "page_id").select("page_id", urls.pair_key(F.col("url"), F.col("url2")).alias("value"))


on_articles("hash_content", lambda: F.sha2(F.concat(head(), F.lit("\n"), body()), 256), "sha256(headline || chr(10) || main_text)")
on_articles("card_key", lambda: F.concat_ws("|", "source", F.lower(t.collapse(head()))), f"source || '|' || lower({d.collapse('headline')})")
on_articles("art_embedding_text", lambda: F.concat(head(), F.lit(". "), F.substring(body(), 1, 500)), "headline || '. ' || substr(main_text, 1, 500)")
on_articles(
    "art_body_status",
    lambda: body_status(body(), head()),
    "case when length(main_text) >= 600 then 'full' when length(main_text) > length(headline) then 'summary' else 'headline_only' end",
)


@query(
    "art_prominence",
    f"""{A} select id, case when r <= 1 then 'lead' when r <= 4 then 'topline' when r <= 8 then 'secondary' else 'tail' end as bucket,
        case when id % 2 = 0 then case when r <= 1 then 24 when r <= 4 then 18 when r <= 8 then 10 else 4 end
             else case when r <= 1 then 18 when r <= 4 then 13 when r <= 8 then 7 else 2 end end as score
        from (select id, row_number() over (partition by source order by id) as r from articles)""",
)
def art_prominence(spark, sf_dir):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    rows = ad.articles(spark, sf_dir).select("id", rank.alias("r"))
    return rows.select("id", bucket(F.col("r")).alias("bucket"), prominence(F.col("r"), F.col("id") % 2 == 0).alias("score"))


@query(
    "card_fallback_copy",
    f"with {ad.VERDICTS_SQL} select id, case category when 'economy' then '{WATCH['economy']}' when 'health' then '{WATCH['health']}' else '{WATCH['other']}' end as what_to_watch, case when confidence > 0.5 then 'own line' else 'This matters for ' || lower(impact_label) || ' today.' end as why_it_matters from verdicts",
)
def card_fallback_copy(spark, sf_dir):
    rows = ad.verdicts(spark, sf_dir)
    own = F.when(F.col("confidence") > 0.5, "own line")
    return rows.select("id", watch_copy(F.col("category")).alias("what_to_watch"), F.coalesce(own, impact_copy(F.col("impact_label"))).alias("why_it_matters"))


NOW = f"timestamp '{ad.NOW_EVENTS}'"
now = lambda: F.lit(ad.NOW_EVENTS).cast("timestamp")
PKT = "(ts + interval 5 hour)"


@query("ts_trusted", "select event_id, coalesce(case when event_id % 3 <> 0 then ts end, timestamp '2024-01-30 12:00:00') as value from events")
def ts_trusted(spark, sf_dir):
    publish = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    scraped = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return ad.table(spark, sf_dir, "events").select("event_id", times.trusted(publish, scraped).alias("value"))


@query("ts_parse_feed", "select event_id, date_trunc('second', ts) as rfc, date_trunc('second', ts) as iso, null::timestamp as bad from events")
def ts_parse_feed(spark, sf_dir):
    rfc = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parse = times.parse_feed_date
    return ad.table(spark, sf_dir, "events").select("event_id", parse(rfc).alias("rfc"), parse(iso).alias("iso"), parse(F.lit("soon")).alias("bad"))


@query(
    "ts_publish_status",
    f"""select event_id, case when event_id % 7 = 0 then 'missing' when strftime(t, '%H:%M:%S.%f') = '19:00:00.000000' then 'date_only' else 'precise' end as status,
        case when event_id % 7 <> 0 then strftime(t + interval 5 hour, '%Y-%m-%d') end as published_on
        from (select event_id, case when event_id % 5 = 0 then date_trunc('day', ts) + interval 19 hour else ts end as t from events)""",
)
def ts_publish_status(spark, sf_dir):
    ts = F.when(F.col("event_id") % 5 == 0, F.date_trunc("day", "ts") + F.expr("interval 19 hours")).otherwise(F.col("ts"))
    ts = F.when(F.col("event_id") % 7 != 0, ts)
    return ad.table(spark, sf_dir, "events").select("event_id", times.publish_status(ts).alias("status"), times.local_date(ts).cast("string").alias("published_on"))


@query(
    "ts_edition",
    f"""select event_id, strftime({PKT}, '%Y-%m-%d') as edition, {PKT}::date = ({NOW} + interval 5 hour)::date and epoch_us({NOW}) - epoch_us(ts) between 0 and 72000000000 and hour({PKT}) >= 5 as fresh from events""",
)
def ts_edition(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "events")
    return rows.select("event_id", times.local_date(F.col("ts")).cast("string").alias("edition"), times.morning_fresh(F.col("ts"), now()).alias("fresh"))


@query("ts_age_hours", f"select event_id, round((epoch_us({NOW}) - epoch_us(ts)) / 3600000000.0, 1)::double as value from events")
def ts_age_hours(spark, sf_dir):
    return ad.table(spark, sf_dir, "events").select("event_id", F.round(times.age_hours(F.col("ts"), now()), 1).alias("value"))


@query(
    "ts_watch_date",
    "select event_id, case when ts::date >= date '2024-01-15' then strftime(ts, '%Y-%m-%d') end as value from events",
)
def ts_watch_date(spark, sf_dir):
    line = F.concat(F.lit("The hearing resumes on "), F.date_format("ts", "MMMM d"), F.lit(", officials say."))
    day = times.watch_date(line, F.lit("2024-01-15").cast("date"))
    return ad.table(spark, sf_dir, "events").select("event_id", day.cast("string").alias("value"))
