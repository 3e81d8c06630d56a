"""Text rules as Column functions: cleaning, tokens, cues, fingerprints and overlaps."""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

#: Abbreviations that end in a full stop without ending a sentence.
ABBREVIATIONS = (
    "approx apr aug capt co col dec dept dr eng etc feb fig gen gov hon inc jan jr jul jun lt ltd maj mar mr mrs "
    "ms no nov oct prof pvt rev rs sept sep sgt sr st vs"
).split()
#: Acronyms too common to identify a story.
GENERIC_ACRONYMS = "AJK CM DPM KP NA PA PM US UK".split()
#: Stop words of headline tokens.
HEADLINE_STOPS = (
    "about after amid and are around as at be been begins by for from has have in into is its more new of on over "
    "says say that the their this to under up was with"
).split()
#: Action words that never identify an event by themselves.
GENERIC_CUES = (
    "audit audits fire government govt health hospital hospitals inspection inspections order ordered orders "
    "review reviews report reports safety"
).split()
#: Stop words of the scorer.
SCORER_STOPS = (
    "a an and as at be by for from has have in is it its of on or that the to was were will with after amid over "
    "into up down out new says said"
).split()
#: Words that name a subject area or an office, never one story.
GENERIC_ANCHORS = (
    "pakistan pakistani islamabad karachi lahore government health minister ministry official officials president "
    "prime pm court police hospital report reports today national federal province provincial security senate "
    "assembly committee after against balochistan chief claims economy finding findings foreign orders price prices "
    "punjab sindh supreme city education entertainment international politics safety sports technology"
).split()
ANCHOR_STOPS = sorted({*GENERIC_ANCHORS, *"about after against amid and from into over says that their the this with".split()})
#: Stop words of story keywords.
STORY_STOPS = (
    "the and for with from into amid after this that over under about their his her its our your while through "
    "following announces announce report reports"
).split()
#: Words that give an impact line something concrete.
CONCRETE_WORDS = (
    "tomorrow tonight monday tuesday wednesday thursday friday saturday sunday rupees rupee paisa litre litres kilo "
    "kilos kg percent deadline closed closure shut shuts reopen reopens suspended cancelled queue queues blocked "
    "diverted strike outage blackout delay delays detour detours shortage rationing refund fine fines penalty permit"
).split()
#: Names of publishers in running text.
PUBLISHERS = {
    "app": ("app", "associated press of pakistan"),
    "ary": ("ary", "ary news"),
    "brecorder": ("business recorder", "brecorder"),
    "dawn": ("dawn",),
    "geo": ("geo", "geo news"),
    "nation": ("nation", "the nation"),
    "thenews": ("the news", "thenews"),
    "tribune": ("tribune", "express tribune"),
}
PUBLISHER_WORDS = sorted({w for names in PUBLISHERS.values() for n in names for w in n.split()})
#: Fixed value: verbs by which a text attributes something to a publisher.
REPORTING_VERB = (
    "(?:reports?|reported|reporting|says?|said|writes?|wrote|notes?|noted|carry|carries|carried|adds?|added|quotes?|"
    "quoted|describes?|described|attributes?|attributed|confirms?|confirmed)"
)
#: Conclusions of guilt, and cues that attribute a sentence to someone.
CONCLUSIONS = [
    "corrupt", "corruption", "lied", "lying", "cover-up", "cover up", "covered up", "ignored", "never happened", "never occurred",
]
ATTRIBUTION = (
    r"\b(?:alleged|allegedly|allegations?|accus\w+|claim\w*|said|says|according to|reports?|reported|criticis\w+|"
    r"criticiz\w+|denied|denies|denying|argued|argues|told|testified|complain\w+|opposition)\b"
)
#: Sentence openers that are no names.
QUESTION_IGNORED = (
    "according after before despite given how if since six the these this what when where whether which while why"
).split()
#: Months by their three-letter key.
MONTHS = "january february march april may june july august september october november december".split()

INCIDENT = r"(?i)\b(?:fire|blaze|blast|crash|flood|killing|death|tragedy)\b"
ACTION = r"(?i)\b(?:audit|inspect|launch|order|review|seek|start|survey)\w*\b"
WORD = r"[\p{L}\p{N}_]+"


def words_in(items: list[str]) -> Column:
    return F.expr(f"split('{'|'.join(items)}', '[|]')")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def findall(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def as_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def joined(items: Column) -> Column:
    return F.array_join(as_set(items), ",")


def collapse(text: Column) -> Column:
    # A single blank stays as it is, so it is no match.
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


#: Characters of the code points 0x80 to 0x9F in numeric entities, as browsers read them, and the named entities of HTML 4.
C1 = {chr(n): bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
NAMED = {"amp": "&", "quot": '"', "lt": "<", "gt": ">", "apos": "'"} | {name: chr(code) for name, code in name2codepoint.items()}
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"


def entity_character(entity: Column) -> Column:
    """The character of one entity; U+FFFD for no code point, empty for one without a character, an unknown name as it stands."""
    hexadecimal = F.substring(entity, 1, 3).isin("&#x", "&#X")
    digits = F.regexp_extract(entity, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    # Eight digits are more than any code point has, so longer numbers may be cut before they are read.
    read = lambda base: F.coalesce(F.conv(F.nullif(F.substring(digits, 1, 8), F.lit("")), base, 10).cast("long"), F.lit(0))
    code = F.when(hexadecimal, read(16)).otherwise(read(10))

    def character(n: Column) -> Column:
        none = n.between(0x1, 0x8) | n.isin(0xB, 0x7F) | n.between(0xE, 0x1F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
        known = {k: v for k, v in C1.items() if v}
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        char = F.when(n.between(0x80, 0x9F), F.translate(char, "".join(known), "".join(known.values()))).otherwise(char)
        return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(char)

    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    named = F.coalesce(F.element_at(names, F.regexp_extract(entity, "^&(.*);$", 1)), entity)
    return F.when(F.substring(entity, 2, 1) == "#", let(code, character)).otherwise(named)


def unescape(text: Column) -> Column:
    """Numeric and named entities as characters, each once: what an entity gives is not read again."""
    characters = F.transform(findall(text, ENTITY), entity_character)
    pieces = F.zip_with(F.split(text, ENTITY, -1), characters, lambda part, c: F.concat(part, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def clean_markup(text: Column) -> Column:
    """Unwrap CDATA, blank out tags, decode entities, normalise; null is empty."""
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return normalize(let(F.regexp_replace(out, "<[^>]+>", " "), unescape))


#: Characters without a place on the page.
INVISIBLE = "[​-‍⁠﻿­]"


def normalize(text: Column) -> Column:
    """Drop invisible characters, fold wide spaces, blank out controls, collapse white space; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    out = F.regexp_replace(out, "[   ]", " ")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    return collapse(out)


def compose(df: DataFrame, column: str) -> DataFrame:
    """NFC in one column. Only rows with a combining mark leave the JVM."""

    @F.pandas_udf("string")
    def nfc(texts):
        return texts.str.normalize("NFC")

    marked = F.coalesce(F.col(column).rlike(r"\p{M}"), F.lit(False))
    return df.where(~marked).unionByName(df.where(marked).withColumn(column, nfc(F.col(column))))


MONTH_DATE = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|"
    r"Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4}"
)


def strip_furniture(body: Column, headline: Column) -> Column:
    """Take a feed's wrapping off a body: wire prefix and footer, ticker, its own headline, byline, dateline."""
    out = normalize(body)
    out = F.trim(F.regexp_replace(out, r"(?i)^associated press of pakistan\s*[-–—:]?\s*", ""))
    footer = r"(?i)\s*this post\b.{0,200}?first appeared on associated press of pakistan(?:\s+and owns the property)?\.?\s*$"
    out = F.trim(F.regexp_replace(out, footer, ""))
    bare = F.trim(F.regexp_replace(out, r"^.{0,120}?\d{1,2}-[A-Za-z]{3}-\d{4}\s*[-–—]\s*", ""))
    enough = (F.length(bare) > 0) & ((F.length(bare) >= 80) | (F.length(bare) * 2 >= F.length(out)))
    out = F.when(enough, bare).otherwise(out)
    title = normalize(headline)
    again = (F.length(title) > 0) & F.startswith(F.lower(out), F.lower(title))
    out = F.when(again, F.regexp_replace(F.substring(out, F.length(title) + 1, F.length(out)), r"^[ .:—–-]+", "")).otherwise(out)
    byline = rf"(?i)^by\s+[a-z .'-]{{2,80}}?\s*(?:[-–—]\s*){{1,3}}(?:{MONTH_DATE})?\s*(?:[-–—]\s*)?"
    dateline = rf"(?i)^[A-Z][A-Z .'-]{{1,40}},?\s+(?:{MONTH_DATE})\s*:\s*"
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, byline, "")), dateline, ""))


#: Stands between sentences while they are parted.
MARK = "\u0001"


def sentences(text: Column) -> Column:
    """Sentences of a text. A stop ends none after an abbreviation or a lone letter, or before a digit or small letter."""
    stops = "|".join(ABBREVIATIONS)
    # A boundary is marked unless what follows or precedes forbids it; then the text is split at the marks. What precedes is
    # looked at only where a stop follows, not at every character.
    keep = rf"(?=[.!?])(?<![.!?])(?<!(?<![A-Za-z])(?i:{stops}))(?<!(?<![A-Za-z])[A-Za-z])([.!?]+)\s+(?![\p{{Ll}}\p{{Nd}}])"
    parts = F.split(F.regexp_replace(F.trim(text), keep, f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


#: Characters at a text's beginning in which its first sentences are sought before the whole text is.
BEGINNING = 1024


def first_sentences(text: Column, n: int) -> Column:
    """The first ``n`` of a text's :func:`sentences`.

    One that another follows within the text's beginning ends where it ends in the whole text; a beginning with too few makes
    the whole text be read.
    """
    start = F.substring(text, 1, BEGINNING)
    return let(sentences(start), lambda parts: F.when((F.size(parts) > n) | (F.length(text) <= BEGINNING), F.slice(parts, 1, n)).otherwise(F.slice(sentences(text), 1, n)))


def unicode_words(text: Column) -> Column:
    return findall(text, WORD)


def acronyms(text: Column) -> Column:
    """Lower-cased words of two or more capitals, without generic ones."""
    caps = F.filter(unicode_words(text), lambda w: w.rlike("^[A-Z]{2,}$"))
    return as_set(F.transform(F.array_except(caps, words_in(GENERIC_ACRONYMS)), lambda w: F.lower(w)))


def all_acronyms(text: Column) -> Column:
    return F.transform(F.filter(unicode_words(text), lambda w: w.rlike("^[A-Z]{2,}$")), lambda w: F.lower(w))


def proper_words(text: Column) -> Column:
    return F.transform(F.filter(unicode_words(text), lambda w: w.rlike("^[A-Z][a-z]{2,}$")), lambda w: F.lower(w))


def shingles(text: Column, size: int = 3) -> Column:
    """Runs of ``size`` ASCII words, lower case; a shorter text is one run, an empty one has none."""
    none = F.expr("cast(array() as array<string>)")

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
        found = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
        return F.when(F.size(words) > 0, found).otherwise(none)

    return let(findall(F.lower(text), "[a-z0-9]+"), runs)


def whole_text(headline: str = "headline", body: str = "main_text") -> Column:
    """Headline and body of an article as one text; a missing one is empty."""
    return F.concat(F.coalesce(headline, F.lit("")), F.lit(". "), F.coalesce(body, F.lit("")))


def hash64(item: Column) -> Column:
    """The first 64 bits of the MD5 as a two's complement integer."""
    # To a negative base the 64 bits are read with their sign, so one digest is enough.
    return F.conv(F.substring(F.md5(item), 1, 16), 16, -10).cast("bigint")


def shingle_hashes(text: Column, size: int = 3) -> Column:
    return F.array_distinct(F.transform(shingles(text, size), hash64))


def simhash64(text: Column, size: int = 3) -> Column:
    """A bit is set where more shingles, repeats included, have it than not; an empty text gives 0."""
    def sign(hashes: Column) -> Column:
        # The votes of a bit: how many hashes have it, against half of them.
        bit = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
        one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
        add = lambda acc, b: F.when(bit(b), acc.bitwiseOR(one(b))).otherwise(acc)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), add)

    return let(F.transform(shingles(text, size), hash64), sign)


def simhashes(rows: DataFrame, text: Column, size: int = 3) -> DataFrame:
    """``rows`` with ``fp``, the :func:`simhash64` of each one's text: all 64 votes are sums of one aggregation.

    Rows are told apart by their place, so repeated ids don't mix; a task adds up its shingles before anything is shuffled, and
    only counts are.
    """
    placed = rows.withColumns({"_row": F.monotonically_increasing_id(), "_x": text})
    hashes = placed.select(*rows.columns, "_row", F.explode_outer(shingles(F.col("_x"), size)).alias("_s"))
    hashes = hashes.withColumn("_h", hash64(F.col("_s"))).drop("_s")
    votes = [F.sum(F.getbit("_h", F.lit(b))).alias(f"_v{b}") for b in range(64)]
    keep = [F.first(c).alias(c) for c in rows.columns]
    counted = hashes.groupBy("_row").agg(*keep, F.count("_h").alias("_n"), *votes)
    bits = [F.when(F.col(f"_v{b}") * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(0) for b in range(64)]
    return counted.select(*rows.columns, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(fingerprint: Column, bands: int = 4) -> Column:
    """``bands`` equal slices of a fingerprint, lowest bits first."""
    if 64 % bands:
        raise ValueError("bands must divide 64")
    width = 64 // bands
    mask = F.lit((1 << width) - 1)
    return F.array(*[F.shiftrightunsigned(fingerprint, k * width).bitwiseAND(mask) for k in range(bands)])


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two sets; an empty one overlaps nothing."""
    both = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other covers."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def event_core(headline: Column) -> Column:
    """A headline without the incident that an action follows upon."""
    caused = r"(?i)^.+?\b(?:fire|blaze|blast|crash|flood|killing|death|tragedy)\s+(?:prompts?|sparks?|triggers?)\s+(.+)$"
    lead = r"(?i)^(?:after|following)\s+[^,:;]{3,120}[,:]\s+(.+)$"

    def tail_of(pattern: str):
        return lambda x: let(F.regexp_extract(x, pattern, 1), lambda m: F.when(m != "", F.trim(m)).otherwise(x))

    def behind_colon(x: Column) -> Column:
        at = F.instr(x, ":")
        rest = F.substring(x, at + 1, F.length(x))
        follows = (at > 0) & F.substring(x, F.lit(1), at - 1).rlike(INCIDENT) & rest.rlike(ACTION)
        return F.when(follows, F.trim(rest)).otherwise(x)

    def before_after(x: Column) -> Column:
        main = F.regexp_extract(x, r"(?i)^(.+?)\s+(?:after|following)\s+[^,;:]{3,120}$", 1)
        return let(main, lambda m: F.when((m != "") & m.rlike(ACTION), F.trim(m)).otherwise(x))

    text = collapse(headline)
    for step in (tail_of(lead), behind_colon, tail_of(caused), before_after):
        text = let(text, step)
    return text


def plain_tokens(text: Column, stops: list[str], least: int = 3) -> Column:
    words = F.filter(findall(F.lower(text), "[a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_sort(F.array_except(words, words_in(stops)))


def headline_tokens(headline: Column) -> Column:
    return plain_tokens(event_core(headline), HEADLINE_STOPS)


def entity_cues(headline: Column) -> Column:
    """Acronyms, figures and capitalised words of a headline's event."""
    return let(event_core(headline), _cues)


def _cues(core: Column) -> Column:
    figures = findall(core, r"(?i)\b\d[\d,./-]*(?:%|bn|m|million|billion|crore|lakh|rs|pkr|usd)?\b")
    names = F.array_except(proper_words(core), words_in(HEADLINE_STOPS))
    return as_set(F.concat(all_acronyms(core), F.transform(figures, lambda w: F.lower(w)), names))


def scorer_normal(text: Column) -> Column:
    """A lower-cased text with each stretch of other characters than ASCII letters, digits and blanks as one blank; null is empty."""

    def kept(low: Column) -> Column:
        # What stays is joined, which costs a fraction of replacing what goes; a stretch at either end is a blank too.
        edge = lambda c: F.when(c.rlike("^[^a-z0-9 ]"), " ").otherwise("")
        first, last = edge(F.substring(low, 1, 1)), edge(F.substring(low, -1, 1))
        return let(findall(low, "[a-z0-9 ]+"), lambda x: F.when(F.size(x) > 0, F.concat(first, F.array_join(x, " "), last)).otherwise(first))

    return let(F.lower(F.coalesce(text, F.lit(""))), kept)


def scorer_words(text: Column) -> Column:
    """The words of :func:`scorer_normal`, in order."""
    return findall(F.lower(F.coalesce(text, F.lit(""))), "[a-z0-9]+")


def content_tokens(text: Column) -> Column:
    return F.sort_array(F.array_except(scorer_words(text), words_in(SCORER_STOPS)))


def anchor_tokens(text: Column) -> Column:
    """Acronyms and capitalised words that can identify a story."""
    names = F.filter(F.concat(all_acronyms(text), proper_words(text)), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_except(names, words_in(ANCHOR_STOPS)))


def anchor_content(text: Column) -> Column:
    return plain_tokens(text, ANCHOR_STOPS, 4)


def signature(headline: Column) -> Column:
    """Words of three letters or more that begin with a letter, without tags and stop words."""
    bare = F.regexp_replace(headline, "<[^>]+>", " ")
    words = F.filter(findall(F.lower(bare), "[a-z][a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_except(words, words_in(HEADLINE_STOPS)))


def slug_tokens(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    words = F.filter(findall(F.lower(path), "[a-z][a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_except(words, words_in(HEADLINE_STOPS)))


def story_keywords(text: Column) -> Column:
    words = F.transform(findall(text, "[A-Za-z0-9']+"), lambda w: F.trim(F.lower(w), F.lit("'")))
    words = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$"))
    return as_set(F.concat(acronyms(text), F.array_except(words, words_in(STORY_STOPS))))


# Each pattern looks at the first character before anything else, as most of a text can begin none of its matches.
NUMBER = (
    r"(?i)(?=[0-9rpu])(?<![\w.])(?:(?:rs|pkr|usd)\.?\s*)?(?:\d{1,3}(?:,\d{3})+(?![\d,])|\d+)(?:\.\d+)?"
    r"(?:\s*(?:billion|million|percent|per\s+cent|crore|lakh|%|(?:bn|m)\b))?"
)
DATE_WORD = (
    r"(?i)(?=[adfjmnostw])\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec|"
    + "|".join(m for m in MONTHS if m != "may")
    + r")\.?\b"
)
MAY_DATE = r"(?i)(?=[0-9m])(?:\b\d{1,2}(?:st|nd|rd|th)?\s+may\b|\bmay\s+\d{1,4}\b)"
SCALES = {"bn": 10**9, "crore": 10**7, "m": 10**6, "lakh": 10**5}


def canonical_figure(token: Column) -> Column:
    """A figure as its magnitude, a month as three letters."""
    out = F.regexp_replace(F.regexp_replace(F.lower(token), r"[\s,]+", ""), r"^(?:rs|pkr|usd)\.?", "")
    out = F.regexp_replace(F.regexp_replace(out, "billion", "bn"), "million", "m")
    out = F.rtrim(F.regexp_replace(F.regexp_replace(out, "percent", "%"), "per cent", "%"), F.lit("."))
    month = F.when(out.rlike("^[a-z]+$") & F.substring(out, 1, 3).isin([m[:3] for m in MONTHS]), F.substring(out, 1, 3))
    number = F.regexp_extract(out, r"^(\d+(?:\.\d+)?)(bn|crore|m|lakh)$", 1)
    scale = F.regexp_extract(out, r"^(\d+(?:\.\d+)?)(bn|crore|m|lakh)$", 2)
    factor = F.lit(1)
    for name, value in SCALES.items():
        factor = F.when(scale == name, F.lit(value)).otherwise(factor)
    value = F.format_string("%.6f", number.try_cast("double") * factor)
    value = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")
    return F.coalesce(month, F.when(number != "", value), out)


def evidence_tokens(text: Column) -> Column:
    """Figures and date words of a text in canonical form."""
    may = F.transform(findall(text, MAY_DATE), lambda w: F.lit("may"))
    found = F.transform(F.concat(findall(text, NUMBER), findall(text, DATE_WORD)), canonical_figure)
    return as_set(F.filter(F.concat(found, may), lambda t: t != ""))


def source_evidence_tokens(text: Column) -> Column:
    """Evidence of a source, year ranges such as 2007-09 expanded to both ends."""
    ranges = findall(text, r"(?=[0-9])(?<!\d)(\d{4}\s*[-–—/]\s*(?:\d{2}|\d{4}))(?!\d)", 1)
    first = lambda r: F.substring(r, 1, 4).cast("int")
    tail = lambda r: F.regexp_extract(r, r"(\d+)$", 1)

    def last(r: Column) -> Column:
        end = (first(r) / 100).cast("int") * 100 + tail(r).cast("int")
        return F.when(F.length(tail(r)) == 4, tail(r).cast("int")).otherwise(F.when(end < first(r), end + 100).otherwise(end))

    ends = F.flatten(F.transform(ranges, lambda r: F.array(first(r).cast("string"), last(r).cast("string"))))
    return as_set(F.concat(evidence_tokens(text), ends))


def question_phrases(text: Column) -> Column:
    """Names that a question brings up: acronyms, and capitalised words that open no sentence."""
    inner = findall(text, r"(?<=[^.!?:;\s\"'“‘(\[])[\s\"'“‘(\[]+([A-Z][a-z]{2,})\b", 1)
    names = F.concat(all_acronyms(text), F.transform(inner, lambda w: F.lower(w)))
    return F.array_sort(F.array_except(names, words_in(sorted({*QUESTION_IGNORED, *GENERIC_ANCHORS, *PUBLISHER_WORDS}))))


def named_publishers(text: Column) -> Column:
    """Publishers that a text attributes something to: a name by a reporting verb, or behind "according to"."""
    found = []
    # A text without the name, or without the phrase, is told by a plain search and meets no pattern.
    phrase = text.rlike("(?i)according to")
    for source, names in PUBLISHERS.items():
        forms = sorted({f for n in names for f in (n.title(), n.upper())})
        named = reduce(lambda x, y: x | y, [F.contains(text, F.lit(f)) for f in forms])
        either = "|".join(forms)
        near = rf"(?=[{''.join(sorted({f[0] for f in forms}))}])\b(?:{either})\b\W+(?:\w+\W+){{0,2}}{REPORTING_VERB}\b"
        told = rf"(?i)\baccording to\s+(?:the\s+)?(?:{either})\b"
        found.append(F.when((named & text.rlike(near)) | (phrase & text.rlike(told)), F.lit(source)))
    return F.array_compact(F.array(*found))


def asserts_culpability(text: Column) -> Column:
    """Whether a sentence without an attribution concludes guilt."""
    # A single word counts as a word, a phrase wherever it stands.
    term = "|".join(rf"\b{c}\b" if c.isalpha() else c for c in CONCLUSIONS)
    guilty = lambda s: F.lower(s).rlike(term) & ~F.lower(s).rlike(ATTRIBUTION)
    # A text that has all words of none of the terms has no such sentence, unless it hides one behind invisible characters; a plain
    # search tells that before anything is replaced.
    parts = sorted({tuple(re.split("[ -]", c)) for c in CONCLUSIONS})
    every = lambda low, words: reduce(lambda p, q: p & q, [F.contains(low, F.lit(w)) for w in words])
    told = let(F.lower(text), lambda low: reduce(lambda p, q: p | q, [every(low, words) for words in parts])) | text.rlike(INVISIBLE)
    return F.when(told, F.exists(sentences(normalize(text)), guilty)).otherwise(False)


def entity_key(text: Column, kind: Column) -> Column:
    """A mention without leading article; of money also without qualifier and currency sign."""
    bare = F.regexp_replace(F.lower(collapse(text)), "^(?:the |an? )", "")
    money = F.regexp_replace(bare, "^(?:approximately |about |around |nearly |over |almost |up to )", "")
    return F.when(kind == "MONEY", F.regexp_replace(money, "^[$£€¥]+", "")).otherwise(bare)


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Z]", ""))


#: Dates that say nothing.
LOW_DATES = (
    "today|yesterday|tomorrow|daily|weekly|monthly|last year|this year|earlier this year|earlier this month|"
    "later this year|a day|a month|a year|one day|one month|one year|four-day|monday|tuesday|wednesday|thursday|"
    "friday|saturday|sunday|" + "|".join(MONTHS)
)


def keep_entity(text: Column, kind: Column) -> Column:
    """Whether a mention is worth showing: two characters or more, no URL, no date without content."""
    low = F.trim(F.lower(F.trim(text)), F.lit("'"))
    vague = low.rlike("^(?:a|an|the|last|next|earlier|later) ") & low.rlike("day|month|year")
    dull = low.rlike(rf"^(?:{LOW_DATES})$") | low.rlike(r"^(?:19|20)\d{2}$|^\d+\s+(?:day|month|year)s?$") | vague
    return (F.length(text) >= 2) & ~text.rlike("(?i)^https?://") & ~low.contains("comments comments") & ~((kind == "DATE") & dull)


def truncate(text: Column, limit: int) -> Column:
    """White space collapsed; a longer text is cut to end in an ellipsis within the limit."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def snippet(text: Column, limit: int = 240) -> Column:
    """Two sentences if they fit, else whole sentences that fit, else a clause, else words and an ellipsis.

    All of these lie in the text's beginning where its sentences come to more than the limit and a character; otherwise the whole text is read.
    """
    text = F.coalesce(text, F.lit(""))
    told = lambda x: let(collapse(x), lambda f: let(sentences(f), lambda parts: F.struct(_snippet(f, parts, limit).alias("t"), parts.alias("parts"))))
    # A text's own mark would be taken for a boundary.
    enough = lambda parts: (F.length(F.array_join(parts, " ")) > limit + 1) & ~F.contains(text, F.lit(MARK))
    start = F.substring(text, 1, 2 * limit)
    return let(told(start), lambda s: F.when((F.length(text) <= 2 * limit) | enough(s["parts"]), s["t"]).otherwise(told(text)["t"]))


def _snippet(flat: Column, parts: Column, limit: int) -> Column:
    two = F.when(F.size(parts) >= 2, F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(flat)
    zero = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"))

    def fit(acc: Column, s: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", acc["t"], s))
        take = acc["open"] & (F.length(longer) <= limit)
        return F.struct(F.when(take, longer).otherwise(acc["t"]).alias("t"), take.alias("open"))

    whole = F.aggregate(parts, zero, fit, lambda acc: acc["t"])
    cut = F.substring(two, 1, limit + 1)
    clause = F.regexp_extract(cut, r"(?s)^(.*)[,;:—–]", 1)
    word = F.when(F.instr(cut, " ") > 0, F.regexp_extract(cut, r"(?s)^(.*) ", 1)).otherwise(cut)
    tail = F.when(F.length(clause) >= limit // 2, F.rtrim(clause)).otherwise(F.regexp_replace(word, "[ .,:;]+$", ""))
    return F.when(F.length(two) <= limit, two).when(whole != "", whole).otherwise(F.concat(tail, F.lit("…")))


def redundant_snippet(snippet_: Column, headline: Column) -> Column:
    """Null where a snippet says no more than its headline or captions a photograph."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    dull = (fold(snippet_) == fold(headline)) | F.lower(snippet_).rlike(r"^(?:photo|file photo|representational image)\b")
    return F.when(~dull, snippet_)


#: The six impact labels, by a word that a raw label contains.
IMPACT_LABELS = ["WALLET", "COMMUTE", "SAFETY", "WORK", "UTILITIES", "GOVERNANCE"]


def impact_label(raw: Column) -> Column:
    up = F.upper(raw)
    return F.coalesce(*[F.when(up.contains(k), F.lit(k)) for k in IMPACT_LABELS], F.lit("UPDATE"))


#: Hedges of an impact line, and its stock form.
HEDGE = r"(?i)\b(?:may|might|could|potential|potentially|possible|possibly|expected to|set to|likely|would)\b"
STOCK_FORM = r"(?i)^[^.]{0,60}?\bfaces?\b"


def brief_flags(impact: Column, headline: Column) -> dict[str, Column]:
    """What an impact line is like: concrete, hedged, of the stock form, and how much of it the headline says."""
    concrete = impact.rlike("[0-9]") | impact.contains("%") | F.arrays_overlap(scorer_words(impact), words_in([*CONCRETE_WORDS, "rs"]))
    # Each side's words are taken once.
    share = lambda mine, said: F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, said)) / F.size(mine))
    restates = let(content_tokens(impact), lambda mine: share(mine, content_tokens(headline)))
    return {
        "lacks_anchor": (F.trim(impact) != "") & ~F.coalesce(concrete, F.lit(False)),
        "hedged": impact.rlike(HEDGE),
        "stock_form": impact.rlike(STOCK_FORM),
        "restates": restates,
    }
