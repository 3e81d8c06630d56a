"""Landed feed files: RSS items, news sitemaps, the source catalogue, recorded days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewire.functions import text as t, times

RSS_ITEM = (
    "title string, link string, description string, summary string, `content:encoded` string, pubDate string, updated string, "
    "category array<string>"
)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def parse_items(files: DataFrame, payload: str = "value", endpoint: str = "endpoint") -> DataFrame:
    """Items of whole RSS payloads: ``endpoint, rank, headline, link, body, published, tags``.

    Rank is the place in the payload. The longest of the bodies counts; the date is the published, else the
    updated one; tags are the first four categories. A broken item gives nulls, a payload without items no row.
    """
    blocks = t.findall(F.col(payload), r"(?s)<item\b.*?</item>")
    rows = files.select(endpoint, F.posexplode(blocks).alias("rank", "block"))
    rows = rows.select(endpoint, "rank", F.from_xml("block", RSS_ITEM, {"mode": "PERMISSIVE"}).alias("i"))
    bodies = [F.coalesce(F.col(f"i.{c}"), F.lit("")) for c in ("description", "summary", "`content:encoded`")]
    longest = F.array_max(F.transform(F.array(*bodies), lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))["b"]
    return rows.select(
        endpoint,
        "rank",
        t.clean_markup(F.coalesce("i.title", F.lit(""))).alias("headline"),
        F.trim("i.link").alias("link"),
        t.clean_markup(longest).alias("body"),
        times.parse_feed_date(first_filled(F.col("i.pubDate"), F.col("i.updated"))).alias("published"),
        F.slice(F.coalesce("i.category", F.array()), 1, 4).alias("tags"),
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of every payload file below ``path``, plain or gzipped; the endpoint is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("endpoint"), "value")
    return parse_items(files)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Dated entries of news sitemaps: ``endpoint, rank, link, headline, published``; rank counts dated blocks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("endpoint"), "value")
    rows = files.select("endpoint", F.posexplode(t.findall(F.col("value"), r"(?s)<url>.*?</url>")).alias("place", "block"))
    part = lambda tag: F.nullif(F.regexp_extract("block", rf"(?s)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1), F.lit(""))
    rows = rows.select("endpoint", "place", part("loc").alias("link"), t.clean_markup(part("news:title")).alias("headline"), times.parse_feed_date(part("news:publication_date")).alias("published"))
    rows = rows.where("link is not null and published is not null")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("endpoint").orderBy("place")) - 1
    return rows.select("endpoint", rank.alias("rank"), "link", "headline", "published")


def stream_rss(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Items of new payload files as a stream."""
    files = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=True)
    return parse_items(files.select(F.col("_metadata.file_name").alias("endpoint"), "value"))


def catalogue(sources: DataFrame) -> DataFrame:
    """Endpoints of enabled sources ``(name, tier, enabled, feed_urls, sitemap_urls)``: a row per channel and URL."""
    on = sources.where("enabled").select("name", F.upper(F.coalesce("tier", F.lit("B"))).alias("tier"), "feed_urls", "sitemap_urls")
    rows = lambda c, channel: on.select("name", "tier", F.lit(channel).alias("channel"), F.explode(c).alias("url"))
    return rows("feed_urls", "rss").unionByName(rows("sitemap_urls", "sitemap"))


def write_feeds(articles: DataFrame, path: str, per_file: int = 500) -> None:
    """Land articles as RSS payload files of ``per_file`` items."""
    cdata = lambda c: F.concat(F.lit("<![CDATA["), F.regexp_replace(c, r"\]\]>", "]] >"), F.lit("]]>"))
    day = F.concat(F.date_format("publish_date", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = F.concat(
        F.lit("<item><title>"), cdata(F.col("headline")), F.lit("</title><link>"), F.col("url"), F.lit("</link><description>"),
        cdata(F.col("main_text")), F.lit("</description><pubDate>"), day, F.lit("</pubDate><category>"), F.col("source"), F.lit("</category></item>"),
    )
    articles.select(item.alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def write_sitemaps(articles: DataFrame, path: str, per_file: int = 500) -> None:
    """Land articles as news sitemap payload files."""
    day = F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(
        F.lit("<url><loc>"), F.col("url"), F.lit("</loc><news:news><news:publication_date>"), day,
        F.lit("</news:publication_date><news:title>"), F.col("source"), F.lit("</news:title></news:news></url>"),
    )
    articles.select(block.alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def read_day(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A recorded day: ``verdicts`` and ``pair_verdicts`` from JSON maps, one or more entries a line, ``vectors`` from Parquet."""
    whole = lambda name: spark.read.text(f"{path}/{name}")
    one = "map<string, struct<category:string, story_type:string, pk_relevance:string, confidence:double>>"
    return {
        "verdicts": whole("triage.json").select(F.explode(F.from_json("value", one)).alias("key", "v")).select("key", "v.*"),
        "pair_verdicts": whole("adjudication.json").select(F.explode(F.from_json("value", "map<string, boolean>")).alias("key", "same")),
        "vectors": spark.read.parquet(f"{path}/vectors"),
    }


def write_day(path: str, verdicts: DataFrame, pair_verdicts: DataFrame, vectors: DataFrame) -> None:
    """Freeze a day: JSON maps of one entry a line, vectors as Parquet."""
    entry = F.to_json(F.create_map("key", F.struct("category", "story_type", "pk_relevance", "confidence")))
    verdicts.select(entry.alias("value")).write.text(f"{path}/triage.json")
    pair_verdicts.select(F.to_json(F.create_map("key", "same")).alias("value")).write.text(f"{path}/adjudication.json")
    vectors.write.parquet(f"{path}/vectors")
