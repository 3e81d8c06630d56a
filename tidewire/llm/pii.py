"""Personal data by weak supervision, in DataFrame functions only.

Labelers (a strict format, a gazetteer, the context before, the characters around) vote on candidate spans;
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; and a
logistic span classifier is fitted on the estimated labels. The pattern table has a few hundred rows at
most, whatever the corpus, so these fits run on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.llm.common import bound, slim
from tidewire.shared import materialize

#: Kinds in output order; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "name"]
BASE_KINDS = 4
#: The patterns. Possessive quantifiers and look-behinds change no match, but keep the time linear
#: and the stack flat: a run of the leading class is tried from its first character, or from the end of the last match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Name:)\.? [A-Z][a-z]+(?: [A-Z][a-z]+)?",
}
#: What a gazetteer knows of each kind: mail providers, private and loop-back networks, card issuers, calling
#: codes, area numbers that are never given out, countries of account numbers, given names.
GAZETTEER = {
    "email": r"@(?:[a-z0-9-]*mail[a-z0-9-]*|outlook|hotmail|live|msn|yahoo|ymail|proton|icloud|me|aol|gmx|web|t-online|freenet|orange"
    r"|wanadoo|laposte|free|sfr|libero|virgilio|terra|telefonica|btinternet|sky|comcast|verizon|att|cox|zoho|fastmail|tutanota)\.",
    "ip": r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|169\.254|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6011|6[45])",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-69]|3[578]|42|5[09]|6[7-9]|8[0578]|9[679])[0-9])",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|BY|CH|CR|CY|CZ|DE|DK|DO|EE|EG|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO"
    r"|KW|KZ|LB|LC|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SC|SE|SI|SK|SM|TN|TR|UA|VA|VG|XK)",
    "name": r" (?:Alexander|Alice|Amelie|Andrea|Andreas|Anna|Anne|Antoine|Antonio|Barbara|Benjamin|Bernd|Camille|Carlos|Carmen"
    r"|Charles|Charlotte|Christian|Claire|Claudia|Cristina|Daniel|David|Diego|Dolores|Elena|Elizabeth|Emily|Emma|Eric|Eva|Felix"
    r"|Fernando|Francisco|Frank|Gabriel|George|Hans|Harry|Heinrich|Helen|Henri|Isabel|Jack|Jacques|James|Jan|Javier|Jean|Jennifer"
    r"|Jessica|John|Jonas|Jorge|Jose|Joseph|Juan|Julia|Julien|Karl|Katharina|Klaus|Laura|Lena|Linda|Lisa|Louis|Lucas|Lucia|Luis"
    r"|Manuel|Margaret|Maria|Marie|Mark|Marta|Martin|Mary|Matthew|Max|Michael|Miguel|Nicolas|Oliver|Pablo|Patricia|Paul|Pedro"
    r"|Peter|Philippe|Pierre|Rafael|Richard|Robert|Rosa|Samuel|Sandra|Sarah|Sofia|Sophie|Stefan|Susan|Thomas|Ursula|William|Wolfgang)(?: |$)",
}
#: Words shortly before a span that speak for a kind, and words that speak against any.
CUES = {
    "email": r"mail|contact|write|schreib|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|account|karte|carte|tarjeta|credit",
    "phone": r"phone|tel|call|mobile|fax|numer",
    "ssn": r"ssn|social|security",
    "iban": r"iban|konto|account|bank",
    "name": r"name|dear|patient|customer",
}
AGAINST = r"version|isbn|order|sku|invoice|serial|ticket|build"
CONTEXT, LABELERS = 32, ["strict", "known", "cued", "alone"]
MARK, OTHER = "\u0001", "\u0002"
#: Where the estimate of each labeler's reliability starts, and the bounds for all of them: better than a guess, never sure.
START = {"strict": 0.95, "known": 0.7, "cued": 0.75, "alone": 0.6}
LEAST, MOST = 0.51, 0.995
#: Digits that a candidate of a numeric kind has at least; shorter runs are no candidates.
LEAST_DIGITS = {"card": 13, "phone": 9}
SPAN = "struct<kind:int,start:int,stop:int,strict:int,known:int,cued:int,alone:int>"


#: A character that a text must have for a kind of candidate.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The array of ``join`` over all elements up to each one, in a logarithmic number of passes over the array.

    In a pass every element takes in the one 1, 2, 4, ... places before it (null ahead of the first).
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda s: s < F.size(values))
    return F.aggregate(steps, values, lambda acc, s: F.transform(acc, lambda x, i: join(x, F.get(acc, i - s))))


def marked_parts(text: Column, pattern: str) -> Column:
    """The text split at the leftmost non-overlapping matches of a pattern: every second part is a match."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def _places(text: Column, kind: int) -> Column:
    """Candidates of one kind of a text: the lengths of its parts give places in code points."""
    name = KINDS[kind]
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    total = lambda x, before: x + F.coalesce(before, F.lit(0))

    def spans(parts: Column, stops: Column) -> Column:
        hits = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        if name in LEAST_DIGITS:
            hits = F.filter(hits, lambda i: F.length(F.regexp_replace(F.get(parts, i), "[^0-9]", "")) >= LEAST_DIGITS[name])
        part = lambda i: F.get(parts, i)
        return F.transform(
            hits, lambda i: _span(kind, name, F.get(stops, i - 1), F.get(stops, i), part(i), part(i - 1), part(i + 1))
        )

    def found(parts: Column) -> Column:
        stops = lambda: running(F.transform(parts, lambda p: F.length(p)), total)
        return F.when(F.size(parts) > 1, bound(stops(), lambda s: spans(parts, s))).otherwise(empty)

    all_ = bound(marked_parts(text, PATTERNS[name]), found)
    return F.when(F.contains(text, F.lit(NEEDS[name])), all_).otherwise(empty) if name in NEEDS else all_


def _span(kind: int, name: str, start: Column, stop: Column, hit: Column, before: Column, after: Column) -> Column:
    context = F.lower(F.right(before, F.lit(CONTEXT)))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    edge = F.right(before, F.lit(1)).rlike("[A-Za-z0-9]") | F.left(after, F.lit(1)).rlike("[A-Za-z0-9]")
    strict = _strict(name, hit)
    return F.struct(
        F.lit(kind).alias("kind"),
        start.alias("start"),
        stop.alias("stop"),
        vote(strict, ~strict).alias("strict"),
        vote(hit.rlike(GAZETTEER[name]), F.lit(False)).alias("known"),
        vote(context.rlike(CUES[name]), context.rlike(AGAINST)).alias("cued"),
        vote(~edge, edge).alias("alone"),
    ).cast(SPAN)


def _strict(name: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if name == "ip":
        small = lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255
        return F.forall(F.split(hit, r"\."), small)
    if name == "card":
        return F.length(digits).between(13, 19) & (luhn(digits) % 10 == 0)
    if name == "phone":
        return F.length(digits).between(9, 15)
    if name == "iban":
        plain = F.replace(hit, F.lit(" "))
        turned = F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4)))
        value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        fold = lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(fold(acc, c))) == 1
    return F.lit(True)


def luhn(digits: Column) -> Column:
    """Luhn's sum of up to 19 digits: every second digit from the right is doubled."""
    right = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(F.substring(right, i, F.lit(1))) - 48
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    few = F.least(F.length(digits), F.lit(19))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(few, F.lit(1))), F.lit(0), add)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with the labelers' votes, kind by kind and by start.

    The work grows with the text and with the number of its spans times their logarithm.
    """
    every = lambda clean: F.concat(*[_places(clean, kind) for kind in range(len(KINDS))])
    return bound(F.replace(text, F.lit(MARK), F.lit(OTHER)), every)


@dataclass
class SpanModel:
    """Estimated labeler reliabilities and the weights of the span classifier."""

    reliability: dict[str, float] = field(default_factory=dict)
    bias: dict[int, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, kind: int, votes: tuple[int, ...]) -> float:
        x = self.bias.get(kind, 0.0) + sum(self.weights.get(n, 0.0) * v for n, v in zip(LABELERS, votes))
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))

    def score(self, span: Column) -> Column:
        """The classifier as an expression."""
        x = F.get(F.array(*[F.lit(self.bias.get(k, 0.0)) for k in range(len(KINDS))]), span["kind"])
        for name in LABELERS:
            x = x + F.lit(self.weights.get(name, 0.0)) * span[name]
        return 1.0 / (1.0 + F.exp(-x))


def fit_spans(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """EM over ``(kind, votes, count)`` rows, then logistic regression on the estimated labels.

    The hidden label of a span is right or not; a labeler that votes is correct with its reliability, which
    starts at ``START`` and stays between ``LEAST`` and ``MOST``; a kind has a prior. Without rows every span is as likely as not.
    """
    rate = dict(START)
    prior = {k: 0.5 for k in range(len(KINDS))}
    belief = [0.5] * len(patterns)
    for _ in range(rounds):
        for r, (kind, votes, _) in enumerate(patterns):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for name, v in zip(LABELERS, votes):
                if v:
                    yes += math.log(rate[name] if v > 0 else 1 - rate[name])
                    no += math.log(rate[name] if v < 0 else 1 - rate[name])
            belief[r] = 1.0 / (1.0 + math.exp(max(-50.0, min(50.0, no - yes))))
        for j, name in enumerate(LABELERS):
            cast = [(b if v[j] > 0 else 1 - b, c) for b, (_, v, c) in zip(belief, patterns) if v[j]]
            right, total = sum(b * c for b, c in cast), sum(c for _, c in cast)
            rate[name] = min(MOST, max(LEAST, (right + 10.0 * START[name]) / (total + 10.0)))
        for kind in prior:
            own = [(b, c) for b, (k, _, c) in zip(belief, patterns) if k == kind]
            prior[kind] = (sum(b * c for b, c in own) + 1.0) / (sum(c for _, c in own) + 2.0)
    model = SpanModel(rate, {k: 0.0 for k in prior}, {n: 0.0 for n in LABELERS})
    total = sum(c for *_, c in patterns) or 1
    for _ in range(400):
        step_b, step_w = {k: 0.0 for k in model.bias}, {n: 0.0 for n in LABELERS}
        for b, (kind, votes, count) in zip(belief, patterns):
            miss = (b - model.probability(kind, votes)) * count / total
            step_b[kind] += miss
            for name, v in zip(LABELERS, votes):
                step_w[name] += miss * v
        for k in step_b:
            model.bias[k] += 2.0 * step_b[k]
        for n in step_w:
            model.weights[n] += 2.0 * step_w[n]
    return model


def fit_pii(found: DataFrame) -> SpanModel:
    """The model of all candidates of ``found(spans)``; what reaches the driver is one row per vote pattern."""
    one = found.select(F.explode("spans").alias("s"))
    counts = one.groupBy("s.kind", *[f"s.{n}" for n in LABELERS]).count().collect()
    return fit_spans(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in counts))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: the candidates of every whole text, repeated rows included."""
    return slim(docs, id_col, text_col).select("doc_id", candidates(F.col("text")).alias("spans"))


def is_base(span: Column) -> Column:
    return (span["kind"] < BASE_KINDS) & (span["strict"] == 1)


def chosen(spans: Column, model: SpanModel) -> Column:
    """Base spans, and others that the classifier takes for personal data."""
    return F.filter(spans, lambda s: is_base(s) | (model.score(s) >= 0.5))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text, a row per row.

    The counts and the digest cover base spans: leftmost non-overlapping matches of a base kind that pass its
    check. ``spans`` has these and the classifier's further ones. Places are code points, the end exclusive.
    A null or empty text has none. An empty table gives an empty table.
    """
    found = materialize(find_spans(docs, id_col, text_col), "spans")
    model = fit_pii(found)
    base = F.filter("spans", is_base)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = found.select("doc_id", base.alias("base"), chosen(F.col("spans"), model).alias("all"))
    return rows.select(
        "doc_id",
        *[count(k) for k in range(BASE_KINDS)],
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.col("all")).alias("spans"),
    )


#: Code points of the blocks in which a text is cut before it is masked.
BLOCK = 512


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become the first one's.

    What stays is cut out of blocks of the text, so the work grows with the text and with the number of spans.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), s["kind"].alias("k"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        one = F.substring(F.get(blocks, first), a % BLOCK + 1, b - a)
        between = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
        more = F.concat(F.substring(F.get(blocks, first), a % BLOCK + 1, F.lit(BLOCK)), between, F.left(F.get(blocks, last), b - last * BLOCK))
        return F.when(a >= b, "").when(first == last, one).otherwise(more)

    def masked(order: Column, stops: Column, blocks: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(stops, i - 1), F.lit(0))
            return F.when(s["a"] >= at, F.concat(cut(blocks, at, s["a"]), F.get(names, s["k"]))).otherwise("")

        rest = cut(blocks, F.get(stops, F.size(stops) - 1), F.length(text))
        return F.concat(F.array_join(F.transform(order, piece), ""), rest)

    stops = lambda o: running(F.transform(o, lambda s: s["b"]), lambda x, before: F.greatest(x, before))
    all_ = bound(order, lambda o: bound(stops(o), lambda e: bound(blocks, lambda b: masked(o, e, b))))
    return F.when(F.size(spans) > 0, all_).otherwise(text)


def mask_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with personal data masked in the text; rows, other columns, empty and null texts stay.

    Candidates are searched once: the documents are written with them, and both the model and the masks use that table.
    """
    name = "_pii_spans"
    while name in docs.columns:
        name += "_"
    found = docs.withColumn(name, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    found = materialize(found, "documents-with-spans")
    model = fit_pii(found.select(F.col(name).alias("spans")))
    found = found.withColumn(name, chosen(F.col(name), model))
    masked = F.when(F.col(text_col).isNotNull(), mask(F.col(text_col), F.col(name)))
    return found.withColumn(text_col, masked).select(*docs.columns)
