"""URL filters: stated rules of hosts and paths, and association rules over URL tokens that FP-growth mines from their verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import join_counted
from tidewire.shared import materialize

BLOCK, ALLOW = "block", "allow"
#: Stated rules are compiled into one expression, so their number is bounded.
MOST_RULES = 1000
#: Least share of blocked URLs with a combination in all labelled ones, and in those with the combination; and the number of
#: stated rules that must have blocked such URLs.
SUPPORT, CONFIDENCE, SOURCES = 0.005, 0.9, 2
#: Combinations are mined from at most about so many labelled URLs; their support and confidence are counted over all.
SAMPLED_URLS = 500_000
#: The item that stands for the verdict in a transaction; tokens of URLs begin otherwise.
BLOCKED = "verdict=block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The base rules.
BASE_RULES = [
    Rule(BLOCK, "net", "/"),
    Rule(ALLOW, "example.net", "/en/"),
    Rule(BLOCK, "example.com", "/de/"),
    Rule(ALLOW, "org", "/fr/"),
]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host`` (after the first ``://``, A-Z lower-cased) and ``path`` (from there up to ``?`` or ``#``).

    Both are empty where the URL is null or has no ``://``.
    """
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substring(F.col(url_col), at + 3, F.length(url_col))).otherwise("")
    pages = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def base_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} stated rules")
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        within = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))
        fits = within & F.startswith(F.col("path"), F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """The distinct tokens of ``host``, ``path`` and the query of ``url``, with figures folded into ``#``.

    Host labels are named by their place from the right, so ``2:blog`` is no top-level domain; segments of the path and names
    of the query stand for themselves, whatever their place.
    """
    folded = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    labels = F.transform(F.reverse(F.split(F.col("host"), r"\.")), lambda x, i: F.concat(i.cast("string"), F.lit(":"), folded(x)))
    named = lambda mark, x: F.transform(F.filter(x, lambda s: s != ""), lambda s: F.concat(F.lit(mark), folded(s)))
    asked = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    names = F.transform(F.split(asked, "&"), lambda s: F.substring_index(s, "=", 1))
    every = F.concat(F.filter(labels, lambda x: ~F.endswith(x, F.lit(":"))), named("/", F.split(ascii_lower(F.col("path")), "/")), named("?", names))
    return F.array_distinct(F.coalesce(every, F.expr("cast(array() as array<string>)")))


def mine_candidates(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sampled: int = SAMPLED_URLS) -> DataFrame:
    """``(tokens)``: sorted combinations of tokens that tell blocked ``urls(tokens, verdict)``, by FP-growth.

    At most about ``sampled`` URLs are mined, chosen by a hash; their number, the tokens of a URL and the support bound the result.
    """
    urls = urls.where(F.size("tokens") > 0)
    n = urls.count()
    if not n:
        return urls.select("tokens")
    if n > sampled:
        urls = urls.where(F.pmod(F.xxhash64("tokens", F.monotonically_increasing_id()), F.lit(1_000_000)) < 1_000_000 * sampled // n)
    marked = F.when(F.col("verdict") == BLOCK, F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(urls.select(marked.alias("items")))
    found = found.associationRules.where(F.element_at("consequent", 1) == BLOCKED)
    return found.select(F.array_sort("antecedent").alias("tokens"))


def containing(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """``profiles`` with each of ``rules(tokens)`` all of whose tokens ``profile``, a set, has.

    The inverted index lists a rule under its first token; a profile has that token once, so a pair is found once.
    """
    index = rules.withColumn("token", F.element_at("tokens", 1))
    hits = profiles.withColumn("token", F.explode("profile")).join(index, "token").drop("token")
    return hits.where(F.size(F.array_except("tokens", "profile")) == 0)


def pruned_rules(candidates: DataFrame, labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, sources: int = SOURCES) -> DataFrame:
    """``(tokens, confidence, support)`` of the candidates that hold over all ``labelled(profile, rule, verdict, rows)``.

    Besides support and confidence a rule needs blocked URLs of ``sources`` stated rules: those of one say no more than it
    does. Of the rules that hold the least remain, since one with all tokens of another blocks nothing that the other doesn't.
    """
    n = labelled.agg(F.sum("rows").alias("n")).first()["n"] or 0
    blocked = F.col("verdict") == BLOCK
    counts = containing(labelled, candidates).groupBy("tokens").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(blocked, F.col("rows")).otherwise(0)).alias("blocked"),
        F.count_distinct(F.when(blocked, F.col("rule"))).alias("sources"),
    )
    rules = counts.select("tokens", (F.col("blocked") / F.col("rows")).alias("confidence"), (F.col("blocked") / max(n, 1)).alias("support"), "sources")
    rules = materialize(rules.where((F.col("confidence") >= confidence) & (F.col("support") >= support) & (F.col("sources") >= sources)), "rules")
    less = containing(rules.select(F.col("tokens").alias("profile")), rules.select("tokens")).where(F.size("tokens") < F.size("profile"))
    return rules.join(less.select(F.col("profile").alias("tokens")).distinct(), "tokens", "left_anti").drop("sources")


def match_rules(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """``(profile, matched, confidence)``: of the rules whose tokens a profile has the surest, of equal ones the first."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("tokens").alias("t")))
    hits = containing(profiles, rules.select("tokens", "confidence")).groupBy("profile").agg(best.alias("b"))
    return hits.select("profile", F.array_join("b.t", " ").alias("matched"), (-F.col("b.c")).alias("confidence"))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule] = BASE_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    sources: int = SOURCES,
    sampled: int = SAMPLED_URLS,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, matched, confidence`` of every page, one row per input row.

    A URL that a stated rule fits has its verdict. These verdicts are the labels from which association rules are mined; a URL
    without a stated rule is blocked where it has all tokens of a mined one, and else allowed. A null URL, or one without
    ``://``, has empty parts, no tokens, and is allowed. URLs are brought down to the tokens that candidates use before
    anything is shuffled, so URLs of one site are few profiles, however many; repeated rows and ids have a row each.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    name, verdict = base_rule(rules)
    rows = url_parts(rows).withColumns({"rule": name, "stated": verdict}).withColumn("tokens", url_tokens(F.col("url")))
    rows = materialize(rows.select("page_id", "host", "path", "rule", "stated", "tokens"), "urls")
    labelled = rows.where("stated is not null").select("tokens", F.col("stated").alias("verdict"))
    candidates = materialize(mine_candidates(labelled, support, confidence, sampled), "candidates")
    # Every token of a candidate has the support, so there are at most the tokens of a URL divided by it.
    used = [r["t"] for r in candidates.select(F.explode("tokens").alias("t")).distinct().collect()]
    used = F.array(*map(F.lit, sorted(used))) if used else F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("profile", F.array_sort(F.array_intersect("tokens", used))).drop("tokens")
    profiles = materialize(rows.groupBy("profile", "rule", F.col("stated").alias("verdict")).agg(F.count(F.lit(1)).alias("rows")), "profiles")
    kept = materialize(pruned_rules(candidates, profiles.where("verdict is not null"), support, confidence, sources), "kept")
    facts = profiles.groupBy("profile").agg(F.sum("rows").alias("rows"))
    facts = facts.join(match_rules(facts.select("profile"), kept), "profile", "left")
    out = join_counted(rows, facts, "profile", "rows")
    stated = F.col("stated").isNotNull()
    out = out.withColumns({c: F.when(~stated, F.col(c)) for c in ("matched", "confidence")})
    method = F.when(F.col("matched").isNotNull(), BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", "rule", F.coalesce("stated", method).alias("verdict"), "matched", "confidence")
