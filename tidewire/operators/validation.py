"""Checks of model answers against the reporting that they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.functions import text as t

#: What the checks of an edited card look for.
HEDGE_OR_MOOD = (
    r"(?i)\b(?:could|might|potential(?:ly)?|heightened\s+(?:concern|risk|scrutiny|security|tension)\w*|growing\s+concerns?)\b"
)
MAY_AS_HEDGE = r"(?<![A-Za-z])may(?![A-Za-z])(?!\s+\d{1,4}\b)"
DAY_AND_MAY = r"(?i)\b\d{1,2}(?:st|nd|rd|th)?\s+may\b"
CONSEQUENCE = r"(?i)\b(?:halt\w*|clos(?:e|ed|ure|ures)|disrupt\w*|shut\w*|unable|cannot|won't|will not|lose|loses|lost)\b"
CONSEQUENCE_FORMS = {
    "halt": ("halt",),
    "clos": ("close", "closed", "closure"),
    "disrupt": ("disrupt", "disruption"),
    "shut": ("shut",),
    "unable": ("unable",),
    "cannot": ("cannot",),
    "won't": ("won't", "will not"),
    "will not": ("will not", "won't"),
    "los": ("lose", "loses", "lost", "loss"),
}
DONE = r"(?i)\b(?:approved|began|begun|implemented|launched|notified|ordered|started)\b"
PROPOSED = (
    r"(?i)\b(?:call(?:ed|s)? for|hint(?:ed|s)?|mull(?:ed|s|ing)?|propos(?:al|e|ed|es)|recommend(?:ed|s)?|suggest(?:ed|s)?)\b"
)
GOVERNMENT_MOVE = r"(?i)\b(?:government|centre|officials?|minister)\s+(?:begin\w*|move\w*|replace\w*|start\w*)\b"
FIGURE = r"(?<![\p{L}\p{N}_])\d[\d,.]*(?![\p{L}\p{N}_])"
#: Stems of which a question of substance has two.
QUESTION_STEMS = (
    "audit budget closed closure delay exempt fund independent inspect protect obstruct previous criteria deadline eligib metric "
    "threshold timeline tariff verif violat warn oversight safeguard insulat mechanism mandat enforc complian jurisdiction "
    "loophole accountab framework protocol assess transparen justif regulat exclud omit"
).split()


def first_match(text: Column, pattern: str) -> Column:
    """The leftmost match, null if there is none."""
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def grounding_failure(headline: Column, impact: Column, watch: Column, reporting: Column) -> Column:
    """The first check that the copy of a card fails against its reporting, as ``cause`` and ``token``; null: none.

    In order: a hedge or mood in the impact line; figures that are not in the reporting; a consequence of
    whose word family the reporting has none; a government's move where the reporting only proposes. Null parts
    are empty.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    copy, impact, reporting = F.concat_ws(" ", headline, impact, watch), empty(impact), empty(reporting)
    hedge = F.coalesce(first_match(impact, HEDGE_OR_MOOD), first_match(F.regexp_replace(impact, DAY_AND_MAY, ""), MAY_AS_HEDGE))
    figures = lambda x: F.transform(t.findall(x, FIGURE), lambda n: F.replace(n, F.lit(",")))
    extra = F.array_sort(F.array_except(figures(copy), figures(reporting)))

    def told(term: Column, low: Column) -> Column:
        found = F.contains(low, term)
        for root, forms in reversed(CONSEQUENCE_FORMS.items()):
            any_form = F.lit(False)
            for form in forms:
                any_form |= F.contains(low, F.lit(form))
            found = F.when(F.startswith(term, F.lit(root)), any_form).otherwise(found)
        return found

    terms = t.findall(copy, CONSEQUENCE)
    missing = t.let(F.lower(reporting), lambda low: F.get(F.filter(terms, lambda w: ~told(F.lower(w), low)), F.lit(0)))
    move = F.when(reporting.rlike(PROPOSED) & ~reporting.rlike(DONE), first_match(copy, GOVERNMENT_MOVE))
    failed = lambda cause, token: F.struct(F.lit(cause).alias("cause"), token.alias("token"))
    return (
        F.when(hedge.isNotNull(), failed("hedge_or_mood", hedge))
        .when(F.size(extra) > 0, failed("unsupported_number", F.array_join(extra, ", ")))
        .when(missing.isNotNull(), failed("unsupported_consequence", missing))
        .when(move.isNotNull(), failed("proposal_reported_as_action", move))
    )


def editorial_stories(answers: DataFrame, candidates: DataFrame, categories: list[str], labels: list[str]) -> DataFrame:
    """Accepted stories of ``answers(edition, answer)``, JSON of an object with ``stories`` or of the list itself.

    ``candidates(edition, cluster, headline, category, labels, articles, facts, source)`` says what an edition
    may choose; stories of other clusters or without an impact line go. What is missing or not allowed falls
    back: the priority on the number of articles, headline, category and labels on the card, tags on the
    category and two facts (or the source). Then limits hold (headline 8 to 180 characters, impact line 16 to
    220, 1 to 3 labels, 1 to 4 tags, priority 0 to 100, confidence 0 to 1, reason 12 to 220, line to watch up to
    180), and of the stories of a cluster the first one counts. An answer that is no JSON has none.
    """
    text = F.trim("answer")
    parsed = F.from_json(F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"stories":'), text, F.lit("}"))).otherwise(text), "stories array<string>")
    fields = (
        "cluster_id string, headline string, impact_line string, why_it_matters string, category string, impact_labels array<string>, "
        "public_impact string, story_tags array<string>, what_to_watch string, selection_reason string"
    )
    # A story is read where it is listed: limits that the optimizer moves down to the list then find it read, not to be read for each.
    read = F.transform(parsed["stories"], lambda x: F.struct(F.from_json(x, fields).alias("s"), F.try_parse_json(x).alias("raw")))
    rows = answers.select("edition", F.posexplode(read).alias("place", "story"))
    kind = lambda name: F.schema_of_variant(F.variant_get(F.col("raw"), f"$.{name}", "variant"))
    rows = rows.select("edition", "place", "story.s", "story.raw").where("raw is not null")
    numbers = {
        "own_priority": F.when(kind("priority") == "BIGINT", F.try_variant_get(F.col("raw"), "$.priority", "long")),
        "own_confidence": F.when(kind("confidence").rlike("BIGINT|DECIMAL|DOUBLE"), F.try_variant_get(F.col("raw"), "$.confidence", "double")),
    }
    rows = rows.select("edition", "place", "s.*", *[c.alias(k) for k, c in numbers.items()])
    rows = rows.withColumn("cluster", F.trim(F.coalesce("cluster_id", F.lit(""))))
    base = candidates.select("edition", F.col("cluster").cast("string").alias("cluster"), *[F.col(c).alias(f"b_{c}") for c in ("headline", "category", "labels", "articles", "facts", "source")])
    rows = rows.join(base, ["edition", "cluster"])
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    good = F.filter(F.coalesce("impact_labels", F.array()), lambda x: x.isin(labels))
    slug = lambda f: F.replace(F.lower(F.trim(f)), F.lit(" "), F.lit("-"))
    facts = F.array_distinct(F.filter(F.transform(F.slice("b_facts", 1, 2), slug), lambda f: (f != "") & (f != F.col("b_category"))))
    default_tags = F.concat(F.array("b_category"), F.when(F.size(facts) > 0, facts).otherwise(F.array("b_source")))
    own_tags = F.when(F.size("story_tags") > 0, F.col("story_tags"))
    priority = F.coalesce("own_priority", F.least(F.lit(95), F.greatest(F.lit(50), 45 + 10 * F.col("b_articles"))).cast("long"))
    rows = rows.select(
        "edition",
        "cluster",
        "place",
        priority.alias("priority"),
        F.coalesce(F.nullif("headline", F.lit("")), "b_headline").alias("headline"),
        F.coalesce(filled(F.nullif("impact_line", F.lit(""))), filled("why_it_matters")).alias("impact_line"),
        F.when(F.col("category").isin(categories), F.col("category")).otherwise(F.col("b_category")).alias("category"),
        F.when(F.size(good) > 0, good).otherwise(F.col("b_labels")).alias("labels"),
        F.when(F.col("public_impact").isin("high", "medium", "watch"), F.col("public_impact")).otherwise(F.when(priority >= 80, "high").otherwise("medium")).alias("public_impact"),
        F.coalesce(own_tags, default_tags).alias("raw_tags"),
        F.coalesce("own_confidence", F.lit(0.65)).alias("confidence"),
        F.trim(F.coalesce("what_to_watch", F.lit(""))).alias("what_to_watch"),
        F.coalesce(F.nullif("selection_reason", F.lit("")), F.lit("Selected by editorial review.")).alias("selection_reason"),
    ).where("impact_line is not null")
    rows = rows.withColumn("tags", F.filter(F.transform("raw_tags", lambda x: F.trim(x)), lambda x: x != ""))
    held = (
        F.col("priority").between(0, 100)
        & F.length("headline").between(8, 180)
        & F.length("impact_line").between(16, 220)
        & F.size("labels").between(1, 3)
        & (F.size("raw_tags") <= 4)
        & (F.size("tags") >= 1)
        & F.col("confidence").between(0, 1)
        & (F.length("what_to_watch") <= 180)
        & F.length("selection_reason").between(12, 220)
    )
    rows = rows.where(held).withColumn("labels", F.array_distinct("labels"))
    first = F.row_number().over(Window.partitionBy("edition", "cluster").orderBy("place"))
    return rows.withColumn("_rn", first).where("_rn = 1").drop("_rn", "raw_tags")


def plain_words(text: Column) -> Column:
    """Lower-case words between single blanks, with one at either end: a phrase is looked up with its own blanks."""
    # What stays is joined, which costs a fraction of replacing what goes.
    return F.concat(F.lit(" "), F.array_join(t.unicode_words(F.lower(F.replace(text, F.lit(",")))), " "), F.lit(" "))


def evidence_facts(articles: DataFrame) -> DataFrame:
    """``articles`` with ``tokens`` and ``words`` in place of their ``evidence``: what a packet is asked for."""
    kept = [c for c in articles.columns if c != "evidence"]
    return articles.select(*kept, t.source_evidence_tokens(F.col("evidence")).alias("tokens"), plain_words(F.col("evidence")).alias("words"))


def analysis_errors(answers: DataFrame, packet: DataFrame) -> DataFrame:
    """What is wrong with story analyses: ``card, errors, soft_errors, question_errors, accepted, question, related``.

    ``answers(card, analysis, claims, question, question_ids, basis, subject)`` with claims of ``text`` and
    ``ids``; ``packet(card, id, role, publisher, evidence)`` holds the primary_event and related articles of a card, whose
    contents are capped, so a card's packet is small; an article of several cards may come with its :func:`evidence_facts` instead. Errors reject an analysis: no primary article, guilt concluded, figures
    that neither primary nor cited articles have, claims that cite unknown articles or none, or figures that the
    cited ones lack, a single cited publisher that is not named. A publisher outside the packet is a soft
    error. Question errors (unknown support, figures, names, guilt, nothing specific) only drop the question.
    """
    facts = evidence_facts(packet) if "evidence" in packet.columns else packet
    facts = facts.withColumn("id", F.col("id").cast("string"))
    pooled = facts.groupBy("card").agg(F.collect_list(F.struct("id", "role", "publisher", "tokens", "words")).alias("packet"))
    rows = answers.join(pooled, "card", "left")
    none = F.expr("cast(array() as array<string>)")
    known = F.coalesce(F.col("packet"), F.filter("packet", lambda p: F.lit(False)), F.expr("array()").cast(dict(pooled.dtypes)["packet"]))
    rows = rows.withColumn("packet", known)
    texts = lambda ids: F.transform(F.coalesce(ids, none), lambda i: i.cast("string"))
    of = lambda ids: F.filter("packet", lambda p: F.array_contains(ids, p["id"]))
    tokens = lambda articles: F.flatten(F.transform(articles, lambda p: p["tokens"]))
    # Most sentences have no figure, so nothing is gathered for them.
    lacks = lambda text, have: t.let(t.evidence_tokens(text), lambda own: (F.size(own) > 0) & (F.size(F.array_except(own, have)) > 0))
    allowed = F.transform("packet", lambda p: p["id"])
    unknown = lambda ids: (F.size(ids) == 0) | (F.size(F.array_except(ids, allowed)) > 0)
    claims = F.transform(
        F.coalesce("claims", F.expr("array()").cast(dict(answers.dtypes)["claims"])),
        lambda c: F.struct(c["text"].alias("text"), texts(c["ids"]).alias("ids"), unknown(texts(c["ids"])).alias("unknown")),
    )
    rows = rows.withColumn("claims", claims).withColumn("question_ids", texts(F.col("question_ids")))
    every = F.flatten(F.transform("claims", lambda c: c["ids"]))
    sound = F.flatten(F.transform(F.filter("claims", lambda c: ~c["unknown"]), lambda c: c["ids"]))
    rows = rows.withColumns({"cited": F.array_distinct(every), "sound": F.array_distinct(sound)})
    rows = rows.withColumn("cited_publishers", F.array_distinct(F.transform(of(F.col("sound")), lambda p: p["publisher"])))
    one = F.get("cited_publishers", F.lit(0))
    low = F.lower("analysis")
    aliases = F.contains(low, F.replace(one, F.lit("_"), F.lit(" ")))
    for source, names in t.PUBLISHERS.items():
        named = F.lit(False)
        for name in names:
            named |= F.contains(low, F.lit(name))
        aliases = F.when(one == source, named).otherwise(aliases)
    primary_or_cited = F.filter("packet", lambda p: (p["role"] == "primary_event") | F.array_contains("cited", p["id"]))
    analysis = {
        "missing_primary_articles": ~F.exists("packet", lambda p: p["role"] == "primary_event"),
        "unsupported_conclusion_in_analysis": t.asserts_culpability(F.col("analysis")),
        "unsupported_number_or_date_in_analysis": lacks(F.col("analysis"), tokens(primary_or_cited)),
        "unknown_claim_support": F.exists("claims", lambda c: c["unknown"]),
        "unsupported_number_or_date_in_claim": F.exists("claims", lambda c: ~c["unknown"] & lacks(c["text"], tokens(of(c["ids"])))),
        "missing_single_source_attribution": (F.size("cited_publishers") == 1) & ~aliases,
    }
    publishers = F.transform("packet", lambda p: p["publisher"])
    soft = {"unknown_publisher_in_analysis": F.size(F.array_except(t.named_publishers(F.col("analysis")), publishers)) > 0}
    question = F.coalesce("question", F.lit(""))
    bad_ids = unknown(F.col("question_ids"))
    support = F.when(bad_ids, F.col("packet")).otherwise(of(F.col("question_ids")))
    phrases = t.question_phrases(question)
    said = lambda phrase, articles: F.exists(articles, lambda p: F.contains(p["words"], F.concat(F.lit(" "), phrase, F.lit(" "))))
    stems = F.size(F.filter(t.words_in(QUESTION_STEMS), lambda w: F.contains(F.lower(question), w)))
    independence = (F.col("basis") == "source_independence") & F.lower(question).rlike("independent|verification")
    subject = F.coalesce("subject", none)
    specific = (
        (F.size(F.array_intersect(t.evidence_tokens(question), tokens(support))) > 0)
        | F.exists(phrases, lambda w: ~F.array_contains(subject, w) & said(F.lower(w), support))
        | F.coalesce(independence, F.lit(False))
        | (stems >= 2)
    )
    asked = F.col("question").isNotNull()
    questions = {
        "unknown_question_support": asked & bad_ids,
        "unsupported_number_or_date_in_question": asked & ~bad_ids & lacks(question, tokens(support)),
        "unsupported_named_subject_in_question": asked & ~bad_ids & F.exists(phrases, lambda w: ~said(F.lower(w), F.col("packet"))),
        "unsupported_conclusion_in_question": asked & t.asserts_culpability(question),
        "generic_question": asked & ~specific,
    }
    listed = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    rows = rows.select("*", listed(analysis).alias("errors"), listed(soft).alias("soft_errors"), listed(questions).alias("question_errors"))
    dropped = F.size("question_errors") > 0
    used = F.array_union("cited", F.when(dropped, none).otherwise(F.col("question_ids")))
    related = F.transform(F.filter("packet", lambda p: (p["role"] != "primary_event") & F.array_contains(used, p["id"])), lambda p: p["id"])
    return rows.select(
        "card",
        "errors",
        "soft_errors",
        "question_errors",
        (F.size("errors") == 0).alias("accepted"),
        F.when(~dropped, F.col("question")).alias("question"),
        F.when(dropped, F.col("question")).alias("rejected_question"),
        F.array_sort(related).alias("related"),
    )


def analysis_outcome(checked: DataFrame, answers: DataFrame) -> DataFrame:
    """Per card the validated analysis, or a fall-back with the reason and the rejected text, cut to 2000 and 800 characters.

    ``checked`` comes from :func:`analysis_errors`; ``answers(card, analysis)``.
    """
    rows = checked.join(answers.select("card", "analysis"), "card")
    bad = ~F.col("accepted")
    return rows.select(
        "card",
        F.when(bad, "fallback").when(F.col("rejected_question").isNotNull(), "question_dropped").otherwise("ok").alias("status"),
        F.when(bad, F.substring(F.array_join("errors", ","), 1, 2000)).alias("reason"),
        F.array_join(F.concat("question_errors", "soft_errors"), ",").alias("recorded"),
        F.when(~bad, F.col("analysis")).alias("analysis"),
        F.when(bad, F.substring("analysis", 1, 800)).alias("rejected"),
        "question",
        "rejected_question",
    )


def adjudication_verdicts(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """Verdicts of ``answers(batch, answer)`` for the pairs asked in ``asked(batch, pair_id, ...)``: its columns and ``same_event``.

    An answer is JSON of an object with ``verdicts`` or of the list itself, in a code fence or bare. A verdict has a textual id, a
    boolean and at most a confidence from 0 to 1 beside; others go, and so do ids that the batch did not ask. Of verdicts on one
    pair the last one counts; an empty or broken answer has none, what follows the JSON is not read.
    """
    text = F.trim("answer")
    bare = F.regexp_replace(F.regexp_replace(text, "^`+|`+$", ""), "^json\n", "")
    text = F.trim(F.when(F.startswith(text, F.lit("```")), bare).otherwise(text))
    whole = F.when(F.startswith(text, F.lit("[")), F.concat(F.lit('{"verdicts":'), text, F.lit("}"))).otherwise(text)
    list_ = F.when(F.expr("try_parse_json(whole)").isNotNull(), F.from_json("whole", "verdicts array<string>")["verdicts"])
    rows = answers.withColumn("whole", whole).select("batch", F.posexplode(list_).alias("place", "verdict"))
    rows = rows.select("batch", "place", "verdict", F.expr("try_parse_json(verdict)").alias("v"))
    keys = F.json_object_keys("verdict")
    allowed = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ("id", "same_event", "confidence")]))) == 0
    kind = lambda name: F.schema_of_variant(F.expr(f"try_variant_get(v, '$.{name}', 'variant')"))
    sure = F.coalesce(F.expr("try_variant_get(v, '$.confidence', 'double')").between(0, 1), ~F.array_contains(keys, "confidence"))
    good = rows.where(allowed & sure & (kind("id") == "STRING") & (kind("same_event") == "BOOLEAN"))
    verdict = F.expr("try_variant_get(v, '$.same_event', 'boolean')")
    last = good.groupBy("batch", F.expr("try_variant_get(v, '$.id', 'string')").alias("pair_id")).agg(F.max_by(verdict, F.col("place")).alias("same_event"))
    return asked.join(last, ["batch", "pair_id"])
