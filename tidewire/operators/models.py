"""Tables around model calls: requests out, answers in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.functions import text as t, times
from tidewire.operators import ranking


def normalized(v: Column) -> Column:
    """A vector at unit length in double precision; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return t.let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def batched_requests(rows: DataFrame, group: str, order: list, payload: Column, size: int, keep: int | None = None) -> DataFrame:
    """``(group, batch, request)``: JSON lists of ``size`` payloads with short keys; a batch is bounded by its size."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    rows = rows.withColumn("_r", place)
    item = F.struct(F.concat(F.lit("i"), (F.col("_r") % size).cast("string")).alias("key"), payload.alias("text"))
    rows = rows.select(group, F.floor(F.col("_r") / size).alias("batch"), "_r", item.alias("item"))
    lists = rows.groupBy(group, "batch").agg(F.array_sort(F.collect_list(F.struct("_r", "item"))).alias("items"))
    return lists.select(group, "batch", F.size("items").alias("n"), F.to_json(F.transform("items", lambda x: x["item"])).alias("request"))


def recorded(rows: DataFrame, answers: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the recorded answers of their key, and the rows that have none; no answer is made up."""
    return rows.join(answers, key, "left"), rows.join(answers.select(key), key, "left_anti")


def repaired_headline(headline: Column, reporting: Column) -> Column:
    """A headline that ends in a bare number gets the unit that follows this number in the reporting."""
    number = F.regexp_extract(headline, r"(\d+(?:\.\d+)?)$", 1)
    units = F.expr("split('billion|million|percent|crore|lakh|bn|pc', '[|]')")
    unit = F.get(F.filter(units, lambda u: F.contains(reporting, F.concat(number, F.lit(" "), u))), F.lit(0))
    return F.when((number != "") & unit.isNotNull(), F.concat(headline, F.lit(" "), unit)).otherwise(headline)


#: Coming events in the order in which they are looked for, and words that name no subject beside the months.
WATCH_EVENTS = "strike hearing vote election deadline rally meeting".split()
NO_SUBJECT = "the this that it a an".split()
MONTH_NAMES = "jan january feb february mar march apr april may jun june jul july aug august sep sept september oct october nov november dec december".split()


def words_of_story(text: Column) -> Column:
    """Distinct lower-case words of four characters or more that are neither months nor numbers."""
    words = F.transform(t.findall(F.coalesce(text, F.lit("")), "[A-Za-z0-9']+"), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(MONTH_NAMES) & ~w.rlike("^[0-9]+$")))


def names_a_subject(line: Column, event: Column | None = None) -> Column:
    """Whether a capitalised word is neither an opener, nor a month, nor the event itself."""
    words = F.transform(F.split(F.trim(line), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,:;()"']+|[.,:;()"']+$""", ""))
    event = F.lit("") if event is None else event
    return F.exists(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'\-]+$") & ~F.lower(w).isin(NO_SUBJECT + MONTH_NAMES) & (F.lower(w) != event))


def relates_to(line: Column, story: Column) -> Column:
    """Whether a line shares a word with the ``story`` words; a story without words relates to every line."""
    return (F.size(story) == 0) | F.arrays_overlap(words_of_story(line), story)


def supplied_line(line: Column, story: Column, said: Column, reference: Column) -> Column:
    """A supplied line where its dates are current, it names a subject, relates to the story and adds to what is ``said``; else empty."""
    current = F.forall(t.findall(line, times.NAMED_DAY), lambda m: F.coalesce(times.named_day(m, reference) >= reference, F.lit(False)))
    adds = (F.size(said) == 0) | (F.size(F.array_except(words_of_story(line), said)) > 0)
    return F.when(current & names_a_subject(line) & relates_to(line, story) & adds, line).otherwise("")


def what_to_watch(cards: DataFrame, articles: DataFrame) -> DataFrame:
    """A line to watch per card: ``card, line``; empty where there is none.

    ``cards(card, headline, lead, supplied, already_said)`` with the headline of the card and of its lead article;
    ``articles(card, place, headline, main_text, published)``. The newest article's local date is the day of reference. A supplied
    line is kept or dropped by ``supplied_line``, never replaced. Without one, the first sentence by article, field (headline before body)
    and position that has a coming date and an event, names a subject and relates to the story gives "The <event> is scheduled for
    <date>.". A card without a dated article has no day of reference, so no line with a date.
    """
    day = articles.groupBy("card").agg(times.local_date(F.max("published")).alias("reference"))
    story = F.array_union(words_of_story(F.col("headline")), words_of_story(F.col("lead")))
    line = F.trim(F.coalesce("supplied", F.lit("")))
    told = cards.select("card", story.alias("story"), line.alias("supplied"), words_of_story(F.col("already_said")).alias("said")).join(day, "card", "left")
    given = told.where("supplied <> ''").select("card", supplied_line(F.col("supplied"), F.col("story"), F.col("said"), F.col("reference")).alias("line"))
    open_ = told.where("supplied = ''").select("card", "story", "reference")
    # Sentences without a date or an event leave before they meet the cards.
    sentence = lambda c: t.sentences(F.coalesce(c, F.lit("")))
    dated = lambda c, field: F.transform(sentence(c), lambda s, i: F.struct(F.lit(field).alias("field"), i.alias("position"), s.alias("text")))
    rows = articles.select("card", "place", F.explode(F.concat(dated("headline", 0), dated("main_text", 1))).alias("s")).select("card", "place", "s.*")
    event = F.get(F.filter(F.array(*[F.lit(e) for e in WATCH_EVENTS]), lambda e: F.contains(F.lower("text"), e)), F.lit(0))
    rows = rows.withColumns({"mention": F.regexp_extract("text", times.NAMED_DAY, 0), "event": event}).where("mention <> '' and event is not null")
    rows = rows.join(open_, "card").where(times.named_day(F.col("mention"), F.col("reference")) >= F.col("reference"))
    rows = rows.where(names_a_subject(F.col("text"), F.col("event")) & relates_to(F.col("text"), F.col("story")))
    derived = F.concat(F.lit("The "), "event", F.lit(" is scheduled for "), "mention", F.lit("."))
    first = rows.groupBy("card").agg(F.min_by(derived, F.struct("place", "field", "position")).alias("line"))
    first = open_.select("card").join(first, "card", "left").withColumn("line", F.coalesce("line", F.lit("")))
    return given.unionByName(first)


def merge_editorial(cards: DataFrame, stories: DataFrame) -> DataFrame:
    """Cards with their accepted story laid over them: ``edition, cluster, headline, category, labels, impact_line, priority, mode``.

    ``cards(edition, cluster, headline, category, labels, reporting)``; ``stories`` from ``validation.editorial_stories``. A card
    without a story keeps its own fields and ``mode`` is "rules", else "editor". A headline that ends in a bare number
    gets its unit from the reporting.
    """
    own = ["headline", "category", "labels"]
    over = stories.select("edition", F.col("cluster").alias("_c"), *[F.col(c).alias(f"s_{c}") for c in own], "impact_line", "priority")
    rows = cards.withColumn("_c", F.col("cluster").cast("string")).join(over, ["edition", "_c"], "left")
    laid = [F.coalesce(f"s_{c}", c).alias(c) for c in own]
    mode = F.when(F.col("priority").isNull(), "rules").otherwise("editor").alias("mode")
    rows = rows.select("edition", "cluster", *laid, "impact_line", "priority", mode, "reporting")
    return rows.withColumn("headline", repaired_headline(F.col("headline"), F.col("reporting"))).drop("reporting")


def analysis_packet(primary: DataFrame, related: DataFrame, order: list, per_row: int = 5000, total: int = 60_000) -> DataFrame:
    """``card, id, role, allowed``: the characters of each article that a story analysis may read.

    ``primary`` and ``related`` have ``card, id, main_text`` and what ``order`` names. Primary articles come first, so related ones
    get what these leave of the total.
    """
    rows = primary.withColumn("role", F.lit("primary_event")).unionByName(related.withColumn("role", F.lit("related")), True)
    rows = ranking.budgeted(rows, "card", ["role", *order], F.length("main_text"), per_row, total)
    return rows.select("card", "id", "role", "allowed")


#: What is said where a card has no line of its own.
WATCH = {"economy": "Watch for the next official economic update.", "health": "Watch for the next health update.", "other": "Watch for the next verified update."}


def watch_copy(category: Column) -> Column:
    """What to watch where a card has no line of its own."""
    lines = {k: v for k, v in WATCH.items() if k != "other"}
    named = [F.when(category == k, v) for k, v in lines.items()]
    return F.coalesce(*named, F.lit(WATCH["other"]))


def impact_copy(label: Column) -> Column:
    """Why a card matters where it has no line of its own; null without a label."""
    return F.concat(F.lit("This matters for "), F.lower(label), F.lit(" today."))
