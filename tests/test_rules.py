"""Edge cases of the rules that SQL does not express."""

import datetime
import html
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire import registry
from tidewire.functions import text as t, times, urls
from tidewire.operators import aggregates, gates, graph, grouping, models, pairs, ranking, snapshots, validation
from tidewire.plans import views
from tidewire.sources import capture, feeds

registry.load()


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, parts",
    [
        ("He met Dr. Khan. They spoke.", ["He met Dr. Khan.", "They spoke."]),
        ("It fell on Sept. 16 in all. Then 2 rose.", ["It fell on Sept. 16 in all.", "Then 2 rose."]),
        ("A. B. Cole won! Really?  Yes", ["A. B. Cole won!", "Really?", "Yes"]),
        ("Rs. 30m was paid. and so on. End.", ["Rs. 30m was paid. and so on.", "End."]),
        ("", []),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, t.sentences(F.col("v")), v=text) == parts


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("Rs22bn was lost", ["22000000000"]),
        ("Rs 22 billion and 22m", ["22000000", "22000000000"]),
        ("on Sept 16 and September 2,500", ["16", "2500", "sep"]),
        ("the party may expand; 3 may", ["3", "may"]),
        ("21 lakh, 7.5 per cent", ["2100000", "7.5%"]),
    ],
)
def test_evidence_tokens(spark, text, tokens):
    assert one(spark, t.evidence_tokens(F.col("v")), v=text) == tokens


def test_year_ranges_are_expanded(spark):
    assert {"2007", "2009"} <= set(one(spark, t.source_evidence_tokens(F.col("v")), v="in 2007-09 it rose"))
    assert {"1998", "2003"} <= set(one(spark, t.source_evidence_tokens(F.col("v")), v="1998-03"))


def test_event_core(spark):
    core = lambda v: one(spark, t.event_core(F.col("v")), v=v)
    assert core("After the PIMS fire, Punjab orders inspections") == "Punjab orders inspections"
    assert core("Hospital fire: Punjab orders audit") == "Punjab orders audit"
    assert core("Mill fire prompts safety review") == "safety review"
    assert core("City orders audit after deadly blaze") == "City orders audit"
    assert core("Rupee gains") == "Rupee gains"


def test_furniture_comes_off_once_and_stays_off(spark):
    body = "Associated Press Of Pakistan Rates rise today. This post Rates rise first appeared on Associated Press Of Pakistan and owns the property."
    clean = one(spark, t.strip_furniture(F.col("b"), F.col("h")), b=body, h="Nothing")
    assert clean == "Rates rise today."
    assert one(spark, t.strip_furniture(F.col("b"), F.col("h")), b=clean, h="Nothing") == clean
    assert one(spark, t.strip_furniture(F.col("b"), F.col("h")), b="Rates rise - banks cheer", h="Rates rise") == "banks cheer"


def test_snippets(spark):
    two = "One is here. Two is there. Three is gone."
    assert one(spark, t.snippet(F.col("v")), v=two) == "One is here. Two is there."
    long = "word " * 100
    cut = one(spark, t.snippet(F.col("v")), v=long)
    assert cut.endswith("…") and len(cut) <= 242
    assert one(spark, t.snippet(F.col("v")), v="") == ""


def test_publishers_and_guilt(spark):
    assert one(spark, t.named_publishers(F.col("v")), v="Dawn reports a rise; across the nation it fell") == ["dawn"]
    assert one(spark, t.named_publishers(F.col("v")), v="according to the Tribune, rates fell") == ["tribune"]
    assert one(spark, t.asserts_culpability(F.col("v")), v="The office is corrupt.") is True
    assert one(spark, t.asserts_culpability(F.col("v")), v="Members alleged the office is corrupt.") is False


def test_urls(spark):
    canonical = lambda v: one(spark, urls.canonical(F.col("v")), v=v)
    assert canonical("HTTPS://www.Site.com/a/b/?q=1#f") == "https://site.com/a/b"
    assert canonical("http://site.com") == "http://site.com/"
    allowed = lambda a, b: one(spark, urls.host_allowed(F.col("a"), F.col("b")), a=a, b=b)
    assert allowed("https://www.x.pk/1", "https://x.pk") and not allowed("https://life.x.pk/1", "https://x.pk")
    assert not allowed("no url", "https://x.pk")


def test_dates(spark):
    parse = lambda v: one(spark, times.parse_feed_date(F.col("v")), v=v)
    assert str(parse("Thu, 27 Aug 2026 10:00:00 +0500")).startswith("2026-08-27 05:00:00") or parse("Thu, 27 Aug 2026 10:00:00 +0500") is not None
    assert parse("2026-08-27T10:00:00Z") is not None
    assert parse("yesterday") is None


def test_feed_payloads(spark, tmp_path):
    (tmp_path / "one.xml").write_text(
        "<rss><channel><item><title><![CDATA[A &amp; B]]></title><link> https://x.pk/1 </link><description>short</description>"
        "<content:encoded><![CDATA[<p>a longer body</p>]]></content:encoded><pubDate>Thu, 27 Aug 2026 10:00:00 GMT</pubDate>"
        "<category>a</category><category>b</category></item><item><title>no date</title><link>u</link></item></channel></rss>"
    )
    rows = feeds.read_rss(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r["rank"], r.headline, r.link, r.body, r.tags) for r in rows] == [(0, "A & B", "https://x.pk/1", "a longer body", ["a", "b"]), (1, "no date", "u", "", [])]
    assert rows[0].published is not None and rows[1].published is None


def test_components_and_empty_graphs(spark):
    nodes = spark.range(12).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 6)] + [(9, 8), (3, 3)], "a long, b long")
    got = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert got == {k: 0 if k <= 6 else 8 if k in (8, 9) else k for k in range(12)}
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(nodes, none).where("node <> label").count() == 0
    assert graph.components(nodes.where("node < 0"), none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_keep_is_the_walk(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for k in range(40):
        if not any((a, k) in pairs for a in kept):
            kept.append(k)
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = sorted(r.id for r in grouping.greedy_keep(spark.range(40), edges).collect())
    assert got == kept


def test_event_groups(spark):
    rows = [(k, f"s{k}", f"u{k}", "2024-01-01 00:00:00", [1.0, 0.01 * k] if k < 3 else [0.0, 1.0]) for k in range(5)]
    articles = spark.createDataFrame(rows, "id long, source string, url string, d string, embedding array<float>").withColumn("publish_date", F.col("d").cast("timestamp"))
    pairs = spark.createDataFrame([(0, 1, 0.99, 0.5, 0.5), (1, 2, 0.99, 0.5, 0.5), (3, 4, 0.99, 0.5, 0.5)], "a long, b long, similarity double, h double, e double")
    got = {r.id: (r.group_id, r["size"]) for r in grouping.event_groups(articles, pairs).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: 3, 1: 3, 2: 3, 3: 2, 4: 2}
    assert got[0][0] == got[1][0] == got[2][0] != got[3][0]


def brute_events(rows, links, rules):
    """Groups of ``(id, us, vector)``, newest first, by trying every group for every article and every pair for every merge."""
    import numpy as np

    v = {i: np.array(x) / np.linalg.norm(x) for i, _, x in rows}
    at = {i: us for i, us, _ in rows}
    link = lambda a, b: links.get((min(a, b), max(a, b)))
    spans = lambda g: max(map(at.get, g)) - min(map(at.get, g)) <= rules.span

    def centre(g):
        return sum(v[i] for i in g) / max(np.linalg.norm(sum(v[i] for i in g)), 1e-12)

    def coherent(g):
        cosines = [v[a] @ v[b] for k, a in enumerate(g) for b in g[:k]]
        return sum(cosines) >= rules.mean * len(cosines) and min(v[i] @ centre(g) for i in g) >= rules.centroid

    def score(i, g):
        found = [link(i, m) for m in g if link(i, m)]
        if len(found) < grouping.support(len(g)) or not spans([*g, i]) or not coherent([*g, i]):
            return None
        best = [max(c) for c in zip(*found)]
        return 0.45 * best[0] + 0.35 * v[i] @ centre([*g, i]) + 0.12 * best[1] + 0.08 * best[2] + 0.02 * min(len(found), 3)

    def merged(g, h):
        found = [(a, b, link(a, b)) for a in g for b in h if link(a, b)]
        if not found or max(f[2][0] for f in found) < rules.pair or not spans(g + h) or not coherent(g + h):
            return None
        if len({f[0] for f in found}) < grouping.support(len(g)) or len({f[1] for f in found}) < grouping.support(len(h)):
            return None
        return 0.7 * max(f[2][0] for f in found) + 0.3 * max(max(f[2][1:]) for f in found)

    groups = []
    for i, _, _ in rows:
        tried = [(s, -k) for k, g in enumerate(groups) if (s := score(i, g)) is not None]
        groups[-max(tried)[1]].append(i) if tried else groups.append([i])
    while tried := [(s, -a, -b) for b in range(len(groups)) for a in range(b) if (s := merged(groups[a], groups[b])) is not None]:
        _, a, b = max(tried)
        groups[-a] += groups.pop(-b)
    order = {i: k for k, (i, _, _) in enumerate(rows)}
    return {(i, min(g, key=order.get), len(g)) for g in groups if len(g) == 1 or coherent(g) for i in g}


def event_tables(seed, n):
    own = random.Random(seed)
    centres = [[own.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, own.randint(0, 90), [c + own.gauss(0, 0.5) for c in own.choice(centres)]) for i in range(n)]
    links = {}
    for _ in range(4 * n):
        a, b = sorted(own.sample(range(n), 2))
        links[a, b] = (own.uniform(0.5, 1), own.random(), own.random())
    return sorted(rows, key=lambda r: (-r[1], f"u{r[0]:04d}")), links


@pytest.mark.parametrize("seed", range(4))
def test_event_groups_are_those_of_trying_all(spark, seed):
    rules = grouping.EventRules(centroid=0.6, mean=0.4, span_hours=30, pair=0.8)
    rows, links = event_tables(seed, 70)
    hour = 3_600_000_000
    table = [(i, "s", f"u{i:04d}", us * hour, x) for i, us, x in rows]
    articles = spark.createDataFrame(table, "id long, source string, url string, us long, embedding array<double>")
    articles = articles.withColumn("publish_date", F.timestamp_micros("us")).drop("us")
    pairs_ = spark.createDataFrame([(*k, *x) for k, x in links.items()], "a long, b long, similarity double, h double, e double")
    got = {tuple(r) for r in grouping.event_groups(articles, pairs_, rules).collect()}
    assert got == brute_events([(i, us * hour, x) for i, us, x in rows], links, rules)
    assert len({g for _, g, _ in got}) < len(got) < 71


def test_a_component_of_many_articles_is_a_stream():
    import time
    from collections import namedtuple

    row = namedtuple("row", "id us embedding near")
    own, hour, n = random.Random(1), 3_600_000_000, 50_000
    near = lambda k: [{"b": j, "similarity": 0.95, "h": 0.5, "e": 0.5} for j in range(max(0, k - 8), k)]
    walk, began, out, most = grouping.Events(grouping.EventRules()), time.time(), [], 0
    for k in range(n):
        topic = k // 500
        vector = [1.0 if d == topic % 16 else own.gauss(0, 0.05) for d in range(16)]
        out += walk.see(row(k, -(k * 0.01 + (50 if k >= n // 2 else 0)) * hour, vector, near(k)))
        most = max(most, len(walk.ids))
    out += walk.result()
    assert len({i for i, _, _ in out}) == len(out) and max(s for _, _, s in out) > 100
    # What a gap longer than a group's span parts is not held together.
    assert most == n // 2 and time.time() - began < 120


def test_diverse_select_guarantees_economy(spark):
    rows = [(1, k, k, "city", [], 1) for k in range(1, 8)] + [(1, 9, 9, "economy", [], 1)]
    ranked = spark.createDataFrame(rows, "edition int, place int, id int, category string, families array<string>, sources int")
    got = [r.id for r in ranking.diverse_select(ranked, most=3).orderBy("slot").collect()]
    assert got == [1, 2, 9]


def test_quality_of_a_partition(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "c"), (2, "c")], "ours int, truth string")
    assert aggregates.partition_quality(rows, "ours", "truth").first()[:] == (3, 2)


def test_snapshots_swap_and_changes_fail_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.write_snapshot(spark.range(3), root)
    snapshots.write_snapshot(spark.range(5), root)
    assert snapshots.read_snapshot(spark, root).count() == 5
    snapshots.write_snapshot(spark.range(2), root, "append")
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            snapshots.write_snapshot(broken, root, mode)
        assert sorted(r.id for r in snapshots.read_snapshot(spark, root).collect()) == [0, 0, 1, 1, 2, 3, 4]
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError):
        snapshots.apply_columns(table, spark.createDataFrame([(2, "b")], "id int, v string"), "id", ["v"])
    once = snapshots.upsert(table, spark.createDataFrame([(1, "b")], "id int, v string"), "id")
    assert snapshots.upsert(once, spark.createDataFrame([(1, "b")], "id int, v string"), "id").collect() == once.collect()


def test_a_captured_day_is_the_same_at_any_clock(spark, sf):
    from tidewire.queries import views as q

    clocks = [q.docs_now(), q.docs_now() + F.expr("interval 400 days")]
    one, two = (q.golden_report(spark, sf, c).first() for c in clocks)
    assert one.latest + (two.latest - one.latest) == two.latest and (two.latest - one.latest).days == 400
    assert {k: v for k, v in one.asDict().items() if k != "latest"} == {k: v for k, v in two.asDict().items() if k != "latest"}
    assert one.articles > 100 and one.clusters > 1 and one["size"] > 0 and one.misses < one.articles


def test_the_gate_names_every_failure(spark):
    from tidewire.plans import golden

    kind = "expected int, recall double, violations int, duplicates int, merged_in int, misses int, size int"
    good = (3, 0.9, 0, 0, 5, 0, 8)
    rows = [good, (0, *good[1:]), (3, 0.4, *good[2:]), (3, 0.9, 1, 2, 13, 4, 20)]
    got = golden.gate(spark.createDataFrame(rows, kind), (6, 12), 0.5, 12).collect()
    assert [(r.failures, r.passed) for r in got] == [("", True), ("unreviewed", False), ("baseline", False), ("duplicates,merged,misses,size,violations", False)]
    free = golden.gate(spark.createDataFrame([(3, 0.1, 0, 0, 99, 0, 0)], kind), (0, 0), None, None).first()
    assert free.passed


def test_captures_embed_changed_keys_only(spark, tmp_path):
    from tidewire.sources import capture

    asked = []

    def embed(keyed):
        asked.append(sorted(r.headline for r in keyed.collect()))
        return keyed.select("key", F.array(F.lit(1.0)).alias("embedding"))

    def day(*rows):
        rows = [(e, k, h, u, b, at) for k, (e, h, u, b, at) in enumerate(rows)]
        return spark.createDataFrame(rows, "endpoint string, rank int, headline string, link string, body string, at string").withColumn("published", F.to_timestamp("at"))

    t0, old = "2024-01-04 12:00:00", "2023-01-01 00:00:00"
    first = [("a", "One", "https://x.com/1", "b", t0), ("a", "", "https://x.com/2", "b", t0), ("a", "Two", "ftp://x", "b", t0), ("a", "Three", None, "b", None), ("c", "Old", "https://y.com/1", "b", old), ("a", "One", "https://z.com/1", "b", t0)]
    second = [("a", "One", "https://x.com/1", "b", t0), ("a", "New", "https://x.com/3", "b", t0)]
    verdicts, now = spark.createDataFrame([("k", "city")], "key string, category string"), F.lit("2024-01-04 13:00:00").cast("timestamp")
    capture.capture_day(day(*first), verdicts, embed, str(tmp_path / "d"), now)
    capture.capture_day(day(*second), verdicts, embed, str(tmp_path / "d"), now + F.expr("interval 1 hour"))
    assert asked == [["One"], ["New"]]
    read = capture.read_captured(spark, str(tmp_path / "d"))
    one, two = read["manifest"].orderBy("captured_at").collect()
    assert (one.article_count, one.embedded, one.reused) == (2, 1, 0) and (two.article_count, two.embedded, two.reused) == (2, 1, 1)
    assert one.quarantined == {"no_headline": 1, "no_link": 2, "endpoint:STALE": 1} and two.quarantined == {}
    assert read["vectors"].count() == 2 and read["articles"].count() == 2


def shingle_set(text):
    words = re.findall("[a-z0-9]+", text.lower())
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} or {tuple(words)} - {()}


def test_near_copies_are_told_by_whole_texts(spark):
    own = random.Random(4)
    prose = lambda n: " ".join("w" + str(own.randrange(9000)) for _ in range(n))
    body = prose(400)
    texts = {k: ("The same first line", prose(300)) for k in range(5)}
    texts |= {10 + k: (f"First line {k} of its own {k}", body) for k in range(4)}
    texts |= {20: ("Copy", texts[3][1]), 21: ("Copy", texts[3][1]), 22: ("Copy", texts[3][1]), 30: ("", "!"), 31: ("", None)}
    whole = {i: f"{h}. {b or ''}" for i, (h, b) in texts.items()}
    kept, near = [], set()
    for i in sorted(texts):
        s = shingle_set(whole[i])
        like = [j for j in sorted(texts) if j < i and s and len(s & shingle_set(whole[j])) >= 0.7 * len(s | shingle_set(whole[j]))]
        near |= {(j, i) for j in like}
        if not set(like) & set(kept):
            kept.append(i)
    assert kept == [0, 1, 2, 3, 4, 10, 30, 31] and len(near) == 12
    rows = spark.createDataFrame([(i, *x, f"https://a.example.com/{i}") for i, x in texts.items()], "id long, headline string, main_text string, url string")
    seen = rows.where("id < 0").select(F.col("url").alias("canonical_url"))
    assert sorted(r.id for r in views.dedup(rows, seen).collect()) == kept
    assert {r.id for r in grouping.keep_without_near_copies(rows, t.whole_text(), -F.col("id")).collect()} == {0, 1, 2, 4, 13, 22, 30, 31}


def run_near_stream(spark, folder, batches, hours):
    """Each batch one file and one micro-batch, in order."""
    import os
    import time

    from tidewire import streaming
    from tidewire.streaming import near

    kind = "id long, x string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, x string, at string").select("id", "x", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(f"{folder}/b{k}")
        for name in os.listdir(f"{folder}/b{k}"):
            os.utime(f"{folder}/b{k}/{name}", (time.time() + k, time.time() + k))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")
    return {tuple(r) for r in streaming.run_to_files(near.near_copies(stream, F.col("x"), hours), "near-test").collect()}


def test_a_stream_of_copies_gives_a_pair_for_each(spark, tmp_path):
    body, other = (" ".join(f"{w}{j}" for j in range(80)) for w in "ab")
    first = [(k, body, "2024-01-01 00:00:00") for k in range(0, 200)]
    second = [(k, body, "2024-01-01 01:00:00") for k in range(200, 400)] + [(500, body.replace("a40", "zz"), "2024-01-01 02:00:00"), (600, other, "2024-01-01 02:00:00"), (700, "", "2024-01-01 02:00:00")]
    got = run_near_stream(spark, tmp_path, [first, second], 24)
    assert {p for p in got if p[1] < 500} == {(0, k) for k in range(1, 400)}
    assert got - {(0, k) for k in range(1, 400)} == {(0, 500)}


def test_the_state_of_a_stream_expires(spark, tmp_path):
    body = " ".join(f"a{j}" for j in range(80))
    batches = [[(1, body, "2024-01-01 00:00:00")], [(2, body, "2024-01-01 05:00:00")], [(3, "x y z", "2024-01-05 00:00:00")], [(4, body, "2024-01-05 01:00:00")], [(5, body, "2024-01-05 02:00:00")]]
    # Row 3 moves the watermark past rows 1 and 2; what comes after is a class of its own.
    assert run_near_stream(spark, tmp_path, batches, 12) == {(1, 2), (4, 5)}


class HeldState(dict):
    """A map state in memory that counts what is stored."""

    stored = 0

    def updateValue(self, key, value):
        self.stored += 1
        self[tuple(key)] = value

    def getValue(self, key):
        return self.get(tuple(key))

    def iterator(self):
        return iter(list(self.items()))

    def removeKey(self, key):
        del self[tuple(key)]


class HeldHandle:
    def __init__(self):
        self.maps, self.timers = {}, set()

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, HeldState())

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_key_of_a_stream_stores_many_classes_by_few_calls():
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from tidewire.streaming import near

    own, handle, hour = random.Random(8), HeldHandle(), 3_600_000
    # Fingerprints of one slice and of others of the key; every fifth set is near the one before it.
    rows, base = [], []
    for k in range(400):
        base = [*base[1:], k + 10**6] if k % 5 == 0 and base else own.sample(range(10**5), own.randint(5, 40))
        part = 7 + near.PARTS * (0 if (k + 1) // 5 % 2 else own.randrange((1 << near.WIDTH) // near.PARTS))
        rows.append((k, own.getrandbits(6) << 20 | part, np.unique(np.array(base, np.int64))))
    frame = lambda some: pd.DataFrame([(k, [k], fp, str(k), s.tobytes(), pd.Timestamp("2024-01-01")) for k, fp, s in some], columns=["id", "ids", "fp", "k", "s", "ts"])
    got = []
    for some in (rows[:250], rows[250:]):
        step = near.NearCopies(24, 18, 0.7, "long")
        step.init(handle)
        for part in step.handleInputRows((7,), iter([frame(some)]), None):
            got += [tuple(p) for p in part.itertuples(index=False)]
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.7 * len(np.union1d(x, y))
    want = {(i, j) for i, fi, si in rows for j, fj, sj in rows if i < j and fi & near.MASK == fj & near.MASK and (fi ^ fj).bit_count() <= 18 and alike(si, sj)}
    assert len(want) > 20 and sorted(got) == sorted(want)
    assert sum(m.stored for m in handle.maps.values()) <= 4 << near.HIGH and len(handle.timers) == 1
    at = int(pd.Timestamp("2024-01-01").timestamp() * 1000)
    early, late = at + 24 * hour - 1, max(handle.timers)
    for now, left in ((early, True), (late, False)):
        step.handleExpiredTimer((7,), None, SimpleNamespace(getExpiryTimeInMs=lambda: now))
        assert [bool(m) for m in handle.maps.values()] == [left, left]


def texts_with_copies(seed, n=60):
    own = random.Random(seed)
    words = ["".join(own.choice("abcdefgh") for _ in range(own.randint(2, 6))) for _ in range(300)]
    rows = []
    for k in range(n):
        base = [own.choice(words) for _ in range(own.randint(4, 120))]
        rows.append(" ".join(base))
        for _ in range(k % 4):
            base = list(base)
            base[own.randrange(len(base))] = "other"
            rows.append(" ".join(base))
        if k % 5 == 0:
            rows += [rows[-1]] * 3
    own.shuffle(rows)
    return rows


def shingles_of(text, size=3):
    words = re.findall("[a-z0-9]+", text.lower())
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def test_near_duplicate_pairs_without_caps(spark):
    texts = texts_with_copies(1)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, x string")
    prints = {r.id: r.fp for r in pairs.fingerprints(rows, F.col("x")).collect()}
    direct = {r.id: r.fp for r in rows.select("id", t.simhash64(F.col("x")).alias("fp")).collect()}
    assert prints == direct
    first, truth = {}, set()
    for k, x in enumerate(texts):
        first.setdefault(frozenset(shingles_of(x)), k)
    for k, x in enumerate(texts):
        s = shingles_of(x)
        name = first[frozenset(s)]
        if name != k:
            truth.add((name, k))
            continue
        for j in range(k):
            o = shingles_of(texts[j])
            if first[frozenset(o)] != j:
                continue
            bits = (prints[j] ^ prints[k]) & (2**64 - 1)
            slices = any(not bits >> 16 * b & 0xFFFF for b in range(4))
            if slices and bits.bit_count() <= 18 and len(s & o) >= 0.7 * len(s | o):
                truth.add((j, k))
    got = pairs.near_duplicate_pairs(rows, F.col("x")).collect()
    assert {(r.a, r.b) for r in got} == truth and len(got) == len(truth)
    assert sum(r.similarity < 1 for r in got) > 20 and sum(r.similarity == 1 for r in got) > 20


def test_slices_hold_every_member(spark):
    rows = spark.createDataFrame([(k, 7) for k in range(400)] + [(1000, 7 | 1 << 60), (1001, -1)], "id long, fp long")
    got = {tuple(r) for r in pairs.band_candidates(rows).collect()}
    assert got == {(0, k) for k in range(1, 400)} | {(0, 1000)}


def test_walks_see_all_rows_in_order(spark):
    own = random.Random(3)
    rows = [(c, k, round(own.random(), 2), own.randint(1, 3), f"s{own.choice([0, 0, 0, 1, 2, 3])}", own.choice([0, 0, 0, *range(40)])) for c in range(4) for k in range(700)]
    got = {}
    df = spark.createDataFrame(rows, "card int, id int, similarity double, shared int, source string, cluster int")
    for r in ranking.capped_related(df).collect():
        got.setdefault(r.card, {})[r.place] = r.id
    for card in range(4):
        by, within, keep = {}, {}, []
        for _, i, *_, s, c in sorted((r for r in rows if r[0] == card), key=lambda r: (-r[2], -r[3], r[1])):
            if len(keep) < 20 and by.get(s, 0) < 4 and within.get(c, 0) < 2:
                by[s], within[c] = by.get(s, 0) + 1, within.get(c, 0) + 1
                keep.append(i)
        assert [got[card][k + 1] for k in range(len(keep))] == keep and len(got[card]) == len(keep)
    many = [(e, k, k, "city" if k < 900 else "economy" if k == 950 else "sport", [f"F{k % 3}"] if k % 2 else [], 1) for e in (1, 2) for k in range(1000)]
    ranked = spark.createDataFrame(many, "edition int, place int, id int, category string, families array<string>, sources int")
    for edition in (1, 2):
        picks = [r.id for r in ranking.diverse_select(ranked).where(f"edition = {edition}").orderBy("slot").collect()]
        assert picks == [0, 1, 2, 900, 902, 903, 950]


@pytest.mark.parametrize(
    "headline, impact, reporting, failure",
    [
        ("Fares rise", "Commuters pay 20 rupees more", "Fares rose by 20 rupees", None),
        ("Fares rise", "Commuters could pay more", "Fares rose", ("hedge_or_mood", "could")),
        ("Fares rise", "Commuters may pay more", "Fares rose", ("hedge_or_mood", "may")),
        ("Fares rise", "Commuters pay more from 3 May", "Fares rose 3", None),
        ("Fares rise", "Commuters pay 1,200 and 30 more", "Fares rose by 1200", ("unsupported_number", "30")),
        ("Road closed", "Drivers take a detour", "The road is open", ("unsupported_consequence", "closed")),
        ("Road closed", "Drivers take a detour", "A closure of the road", None),
        ("Shops lose trade", "Tenants wait", "A loss of trade", None),
        ("Government moves to ban bags", "Shoppers carry bags", "The ministry proposed a ban", ("proposal_reported_as_action", "Government moves")),
        ("Government moves to ban bags", "Shoppers carry bags", "The ministry proposed a ban and notified it", None),
        (None, None, None, None),
    ],
)
def test_grounding(spark, headline, impact, reporting, failure):
    found = validation.grounding_failure(F.col("h"), F.col("i"), F.lit(None).cast("string"), F.col("r"))
    got = one(spark, found, h=headline, i=impact, r=reporting)
    assert (got and tuple(got)) == failure


def analysed(spark, **changes):
    packet = [
        (1, "a", "primary_event", "dawn", "The council spent 40 million on roads in March. PIMS Hospital was named."),
        (1, "b", "related", "geo", "Tariffs rose 7 percent in 2021-22. The Multan police said so."),
    ]
    base = {
        "card": 1,
        "analysis": "According to Dawn, the council spent 40 million in March.",
        "claims": [("The council spent 40 million.", ["a"])],
        "question": "Why did tariffs rise 7 percent?",
        "question_ids": ["b"],
        "basis": "evidence_gap",
        "subject": ["pims"],
    } | changes
    schema = "card int, analysis string, claims array<struct<text string, ids array<string>>>, question string, question_ids array<string>, basis string, subject array<string>"
    answers = spark.createDataFrame([tuple(base.values())], schema)
    table = spark.createDataFrame(packet, "card int, id string, role string, publisher string, evidence string")
    return validation.analysis_errors(answers, table).first()


@pytest.mark.parametrize(
    "changes, errors",
    [
        ({}, []),
        ({"card": 2}, ["missing_primary_articles", "unsupported_number_or_date_in_analysis", "unknown_claim_support"]),
        ({"analysis": "Dawn says 40 million. The minister lied."}, ["unsupported_conclusion_in_analysis"]),
        ({"analysis": "Dawn says 7 percent were spent."}, ["unsupported_number_or_date_in_analysis"]),
        ({"analysis": "7 percent", "claims": [("7 percent in 2022", ["a", "b"])]}, []),
        ({"claims": [("x", ["c"]), ("y", [])]}, ["unknown_claim_support"]),
        ({"claims": [("7 percent", ["a"])]}, ["unsupported_number_or_date_in_claim"]),
        ({"analysis": "The council spent 40 million."}, ["missing_single_source_attribution"]),
        ({"claims": None, "analysis": "Roads."}, []),
    ],
)
def test_story_analysis(spark, changes, errors):
    got = analysed(spark, **changes)
    assert got.errors == errors and got.accepted == (not errors)


@pytest.mark.parametrize(
    "changes, errors",
    [
        ({"question": None}, []),
        ({"question_ids": ["c"]}, ["unknown_question_support"]),
        ({"question": "Why did tariffs rise 9 percent after the audit and the delay?"}, ["unsupported_number_or_date_in_question"]),
        ({"question": "What did the Rojhan audit of the budget find?"}, ["unsupported_named_subject_in_question"]),
        ({"question": "Was it corruption that the audit of the budget found?"}, ["unsupported_conclusion_in_question"]),
        ({"question": "Why does this keep happening?"}, ["generic_question"]),
        ({"question": "Why does this keep happening in PIMS?", "question_ids": ["a"]}, ["generic_question"]),
        ({"question": "Why do they ask Multan again?"}, []),
        ({"question": "Are these independent?", "basis": "source_independence"}, []),
    ],
)
def test_story_questions(spark, changes, errors):
    got = analysed(spark, **changes)
    assert got.question_errors == errors and got.accepted
    assert (got.question is None) == bool(errors or changes.get("question", 1) is None)
    assert got.related == ([] if errors or changes.get("question_ids") == ["a"] else ["b"])


def test_editorial_stories(spark):
    import json

    story = lambda **x: {"cluster_id": "1", "impact_line": "Commuters pay more from today"} | x
    many = [
        (1, json.dumps({"stories": [story(priority=120), story(priority=70, category="city", impact_labels=["WORK", "x", "WORK"], story_tags=[" a ", ""]), story(priority=60)]})),
        (2, json.dumps([story(priority="80", confidence="high", category="fashion", public_impact="low"), story(cluster_id="9")])),
        (3, json.dumps({"stories": [story(impact_line=" ", why_it_matters=" "), story(cluster_id=" 1 ", impact_line="", why_it_matters="Parents wait longer today", headline="Short")]})),
        (4, "no json"),
        (5, json.dumps({"stories": [story(story_tags=["a", "b", "c", "d", "e"]), story(selection_reason="short"), 7, story(confidence=1, priority=0)]})),
        (6, None),
    ]
    answers = spark.createDataFrame(many, "edition int, answer string")
    base = [(e, 1, "A base headline", "sports", ["SAFETY"], 3, ["One Fact", "one fact", "Third"], "dawn") for e in range(1, 7)]
    candidates = spark.createDataFrame(base, "edition int, cluster int, headline string, category string, labels array<string>, articles int, facts array<string>, source string")
    got = {r.edition: r for r in validation.editorial_stories(answers, candidates, ["city", "sports"], ["WORK", "SAFETY"]).collect()}
    assert set(got) == {1, 2, 5}
    assert (got[1].priority, got[1].category, got[1].labels, got[1].tags, got[1].place) == (70, "city", ["WORK"], ["a"], 1)
    assert (got[2].priority, got[2].category, got[2].labels, got[2].confidence, got[2].public_impact) == (75, "sports", ["SAFETY"], 0.65, "medium")
    assert got[2].tags == ["sports", "one-fact"] and got[2].headline == "A base headline"
    assert (got[5].priority, got[5].confidence, got[5].place) == (0, 1.0, 3)


def test_question_phrases(spark):
    phrases = lambda v: one(spark, t.question_phrases(F.col("v")), v=v)
    assert phrases("Why did Lahore and PIMS wait? Officials in Multan know.") == ["multan", "pims"]
    assert phrases("Nothing here.") == []


def test_headline_leaders_against_the_walk(spark):
    own = random.Random(5)
    rows = [(k % 3, k, sorted({f"w{own.randint(0, 25)}" for _ in range(own.randint(1, 8))})) for k in range(150)]
    got = {r.id: r.leader for r in grouping.headline_leaders(spark.createDataFrame(rows, "edition int, id int, tokens array<string>")).collect()}
    truth = {}
    for edition in range(3):
        groups = []
        for _, i, tokens in sorted((r for r in rows if r[0] == edition), key=lambda r: (-len(r[2]), r[1])):
            mine = set(tokens)
            if len(mine) < 3:
                continue
            home = next((g for g in groups if len(mine & g[1]) / min(len(mine), len(g[1])) >= 0.45), None)
            if home is None:
                groups.append((i, set(mine)))
                truth[i] = i
            else:
                home[1].update(mine)
                truth[i] = home[0]
    assert got == truth


def test_headlines_meet_few_groups():
    from collections import namedtuple

    row = namedtuple("row", "edition id tokens")
    own, walk = random.Random(2), grouping.Headlines(0.45)
    # Every headline has the same frequent word, which alone brings none to a group.
    rows = [row(1, k, ["city", *(f"w{own.randint(0, 10**6)}" for _ in range(5))]) for k in range(40_000)]
    assert sum(len(walk.see(r)) for r in rows) == 40_000 and len(walk.leaders) > 39_000


@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_similar_pairs_of_tiles(spark, threshold):
    import numpy as np

    own = np.random.default_rng(4)
    centres = own.normal(0, 1, (6, 8))
    v = np.concatenate([centres[k % 6] + own.normal(0, 0.15, 8) for k in range(240)]).reshape(-1, 8)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = [(k, v[k].tolist(), "x" if k % 10 else "y") for k in range(240)] + [(900, None, "x"), (901, v[0].tolist(), None)]
    rows = spark.createDataFrame(table, "id long, embedding array<double>, label string")
    got = {(r.a, r.b): r.similarity for r in pairs.similar_pairs(rows, threshold, "label", tile_rows=20).collect()}
    truth = {(a, b): v[a] @ v[b] for a in range(240) for b in range(a + 1, 240) if (a % 10 == 0) == (b % 10 == 0) and v[a] @ v[b] >= threshold}
    assert got == pytest.approx(truth)
    cut = pairs.tiles(rows, "label", 20)
    sizes = {r.tile: len(r.ids) for r in cut.collect()}
    assert max(sizes.values()) <= 20 and sum(sizes.values()) == 240
    compared = sum(sizes[r.a] * sizes[r.b] for r in pairs.tile_pairs(cut, 0.9).collect())
    # Tiles far apart are never brought together; one with itself counts twice.
    assert compared < 0.6 * (216 * 216 + 24 * 24) / 2


def test_coverage_and_related_with_frequent_tokens(spark):
    own = random.Random(7)
    words = lambda n: sorted({"common", *(f"w{int(own.random() ** 2 * 60)}" for _ in range(n))})
    ours = [(k, words(own.randint(1, 12))) for k in range(300)] + [(900, [])]
    wanted = [(k, words(own.randint(1, 30))) for k in range(25)] + [(50, ["none"]), (51, [])]
    kind = "id long, tokens array<string>"
    got = {r.w: (r.best, r.covered) for r in pairs.coverage(spark.createDataFrame(wanted, kind), spark.createDataFrame(ours, kind)).collect()}
    for i, tokens in wanted:
        best = max((len({*tokens} & {*o}) / min(len(tokens), len(o)) for _, o in ours if tokens and o), default=0.0)
        assert got[i] == (pytest.approx(best), best >= 0.5)
    table = [(k, k % 7, t_, [own.random(), own.random()]) for k, t_ in ours]
    others = spark.createDataFrame(table, "id long, cluster long, anchors array<string>, embedding array<double>")
    primary = others.where("id < 20").withColumn("card", F.col("id") % 5)
    found = {(r.card, r.id): (r.similarity, r.shared) for r in pairs.related_articles(primary, others, 0.4).collect()}
    truth = {}
    for a, ca, ta, va in table[:20]:
        for b, cb, tb, vb in table:
            if ca != cb and {*ta} & {*tb}:
                s, shared = truth.get((a % 5, b), (-9, set()))
                truth[a % 5, b] = (max(s, sum(x * y for x, y in zip(va, vb))), shared | ({*ta} & {*tb}))
    truth = {k: (pytest.approx(s), len(x)) for k, (s, x) in truth.items() if s >= 0.4}
    assert found == truth


def test_expectations_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "EXPECTATIONS_AT_ONCE", 3)
    ex = spark.createDataFrame([(k, [f"word{k}", "other"], 2) for k in range(8)], "expectation int, keywords array<string>, min_hits int")
    cards = spark.createDataFrame([(k, f"a word{k} and the other") for k in range(10)], "card int, text string")
    assert {tuple(r) for r in pairs.expectation_hits(ex, cards).collect()} == {(k, k, 2) for k in range(8)}


def test_expectations_read_a_card_once(spark):
    ex = spark.createDataFrame([(1, ["rain", "gate"], 1)], "expectation int, keywords array<string>, min_hits int")
    cards = spark.createDataFrame([(1, "The RAIN!"), (2, None), (3, "")], "card int, text string").repartition(2, "card")
    hits = pairs.expectation_hits(ex, cards)
    assert [tuple(r) for r in hits.collect()] == [(1, 1, 1)]
    # A filter on what was read would read it anew below the shuffle.
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_stored_rows_expire(spark, tmp_path):
    from tidewire import streaming

    step = streaming.against_store(str(tmp_path / "s"), lambda new, old: new.select(F.col("id").alias("b")).join(old.select(F.col("id").alias("a")), F.col("a") != F.col("b")), "ts", 48)
    batch = lambda *rows: spark.createDataFrame(rows, "id int, at string").select("id", F.to_timestamp("at").alias("ts"))
    assert step(batch((1, "2024-01-01 10:00:00"), (2, None)), 0).count() == 0
    assert {tuple(r) for r in step(batch((3, "2024-01-03 09:00:00")), 1).collect()} == {(3, 1)}
    assert {tuple(r) for r in step(batch((4, "2024-01-03 11:00:00")), 2).collect()} == {(4, 3)}
    assert {tuple(r) for r in step(batch((4, "2024-01-03 11:00:00")), 2).collect()} == {(4, 3)}


def test_stories_lie_over_cards_and_packets_put_primary_articles_first(spark):
    cards = spark.createDataFrame([(1, 1, "Costs rise by 22", "city", ["WORK"], "It cost 22 billion."), (1, 2, "Own line", "city", ["WORK"], "")], "edition int, cluster int, headline string, category string, labels array<string>, reporting string")
    stories = spark.createDataFrame([(1, "2", "A new headline", "sports", ["SAFETY"], "Commuters pay more", 70)], "edition int, cluster string, headline string, category string, labels array<string>, impact_line string, priority int")
    got = {r.cluster: r for r in models.merge_editorial(cards, stories).collect()}
    assert (got[1].headline, got[1].mode, got[1].category) == ("Costs rise by 22 billion", "rules", "city")
    assert (got[2].headline, got[2].mode, got[2].category, got[2].impact_line) == ("A new headline", "editor", "sports", "Commuters pay more")
    rows = lambda *x: spark.createDataFrame([(1, i, "x" * n) for i, n in x], "card int, id int, main_text string")
    packet = models.analysis_packet(rows((5, 60), (6, 60)), rows((1, 60), (2, 10)), ["id"], 50, 120)
    assert {(r.id, r.role, r.allowed) for r in packet.collect()} == {(5, "primary_event", 50), (6, "primary_event", 50), (1, "related", 20), (2, "related", 0)}


def test_entities_are_decoded_once_as_by_the_standard(spark):
    pieces = (
        "&amp; &lt; &#65; &#x41; &#X1F600; &#128; &#150; &#0; &#xD800; &#1114112; &#99999999999999; &eacute; &nosuch; &#38;lt; "
        "&amp;#65; &#38;amp; a & # &#; &#65 &nbsp; &#xFDD0; &#7; &#127; &#13; &hellip; &#xFFFF; &#00065; &apos;"
    ).split()
    draw = random.Random(1)
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(1000)]
    rows = spark.createDataFrame([(v,) for v in texts], "v string").select("v", t.unescape(F.col("v")).alias("x")).collect()
    assert [(r.v, r.x) for r in rows if r.x != html.unescape(r.v)] == []
    assert one(spark, t.clean_markup(F.col("v")), v="<b>Rs&#8217;s</b> <![CDATA[A &#38; B]]>&#x2009;end") == "Rs’s A & B end"
    assert one(spark, t.clean_markup(F.col("v")), v=None) == ""


def test_items_stay_on_the_host_of_their_source(spark):
    items = [
        (1, "a", "https://www.one.com/x", "Told"),
        (2, "a", " http://one.com/y ", "Told"),
        (3, "a", "https://blog.one.com/z", "Told"),
        (4, "b", "https://anywhere.org/", "Told"),
        (5, "none", "https://anywhere.org/", "Told"),
        (6, "a", "ftp://one.com/", "Told"),
        (7, "a", "https://one.com/", " "),
        (8, "a", None, "Told"),
        (9, "a", "https://one.com/", None),
    ]
    items = spark.createDataFrame(items, "id int, source string, link string, headline string")
    sources = spark.createDataFrame([("a", "https://one.com"), ("b", None)], "source string, url string")
    assert {r.id for r in gates.valid_items(items, sources).collect()} == {1, 2, 4, 5}
    assert gates.valid_items(items.limit(0), sources).count() == 0


def test_service_health_by_the_first_matching_reason(spark):
    day = lambda hour, n=3: datetime.datetime(2024, 1, n, hour)
    ok = ["ok"] * 5
    beats = [
        ("fresh", day(9), day(9), *ok, 4, 2),
        ("old", day(1, 1), day(1, 1), *ok, 4, 2),
        ("edge", day(6, 2), day(6, 2), *ok, 1, 1),
        ("failed", day(9), day(9), "failed", "unavailable", "ok", "ok", "ok", 4, 2),
        ("later", day(8), day(8), "failed", *["ok"] * 4, 4, 2),
        ("later", day(9), day(9), *ok, 5, 3),
        ("quiet", day(9), day(9), "ok", "degraded", "ok", "ok", "ok", 4, 2),
        ("story", day(9), day(9), "ok", "ok", "partial", "degraded", "ok", 4, 2),
        ("triage", day(9), None, None, None, None, None, "degraded", None, None),
        ("future", day(20), day(20), *ok, 1, 1),
    ]
    schema = "service string, last_run_at timestamp, success_at timestamp, publication string, editorial string, story_analysis string, embedding string, triage string, calls long, selected long"
    cards = spark.createDataFrame([("cards", day(1)), ("triage", day(1)), ("aged", day(1, 1)), ("none", None)], "service string, created_at timestamp")
    rows = aggregates.service_health(spark.createDataFrame(beats, schema), cards, F.lit("2024-01-03 10:00:00")).collect()
    found = {r.service: (r.status, r.reason, r.age_hours, r.calls) for r in rows}
    assert found == {
        "fresh": ("ok", "heartbeat_fresh", 1, 4),
        "old": ("degraded", "heartbeat_stale", 57, 4),
        "edge": ("degraded", "heartbeat_stale", 28, 1),
        "failed": ("degraded", "publication_failed", 1, 4),
        "later": ("ok", "heartbeat_fresh", 1, 5),
        "quiet": ("degraded", "heartbeat_fresh", 1, 4),
        "story": ("degraded", "story_analysis_partial", 1, 4),
        "triage": ("degraded", "triage_degraded", 9, 0),
        "future": ("ok", "heartbeat_fresh", 0, 1),
        "cards": ("ok", "latest_card_fresh", 9, 0),
        "aged": ("degraded", "latest_card_stale", 57, 0),
        "none": ("degraded", "no_signal", None, 0),
    }


def test_omissions_and_thin_cards(spark):
    rows = [(1, 7, "national", "Seven"), (2, 5, "national", "Five"), (3, 5, "national", "Four"), (4, 9, "foreign", "Far"), (5, 2, "local", "Thin"), (6, 5, "local", "Well"), (7, None, "national", None), (8, 6, "national", "Kept")]
    candidates = spark.createDataFrame([(1, *r) for r in rows] + [(2, 1, 1, "local", "Alone")], "edition int, id int, sources int, relevance string, headline string")
    published = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (1, 8), (2, 1)], "edition int, id int")
    notes = spark.createDataFrame([(1, "1: a: b"), (1, "2:"), (1, "no note"), (2, "3: elsewhere")], "edition int, note string")
    found = aggregates.omissions(candidates, published, notes).collect()
    assert {(r.edition, r.id, r.reason) for r in found if r.kind == "omitted"} == {(1, 1, "a: b"), (1, 2, "(no reason given)"), (1, 3, "unaccounted")}
    assert {(r.edition, r.id, r.passed_over) for r in found if r.kind == "thin"} == {(1, 5, "7-source Seven; 5-source Four"), (1, 7, "7-source Seven; 5-source Four")}


def test_adjudication_ignores_what_was_not_asked(spark):
    answers = [
        ("a", '```json\n{"verdicts":[{"id":"p1","same_event":true},{"id":"p9","same_event":true},{"id":"p2","same_event":"maybe"},{"id":"p3","same_event":false,"note":1}]}\n```'),
        ("b", '[{"id":"p1","same_event":true},{"id":"p1","same_event":false,"confidence":0.4},{"id":"p2","same_event":true,"confidence":3},7,{"id":3,"same_event":true}]'),
        ("c", '{"verdicts":[{"id":"p1","same_event":true}'),
        ("d", ""),
        ("e", None),
        ("f", '{"other":[]}'),
    ]
    asked = spark.createDataFrame([(b, f"p{i}", i) for b in "abcdef" for i in (1, 2, 3)], "batch string, pair_id string, pair int")
    found = validation.adjudication_verdicts(spark.createDataFrame(answers, "batch string, answer string"), asked).collect()
    assert {(r.batch, r.pair, r.same_event) for r in found} == {("a", 1, True), ("b", 1, False)}


@pytest.mark.parametrize(
    "supplied, line",
    [
        ("Railway hearing opens on January 9, 2024.", "Railway hearing opens on January 9, 2024."),
        ("Railway hearing opens on January 2, 2024.", ""),
        ("Railway hearing opens on January 9 and ended January 1.", ""),
        ("Railway hearing opens on February 30.", ""),
        ("the railway hearing", ""),
        ("October 27", ""),
        ("Cricket board meets soon", ""),
        ("Railway Workers strike", ""),
        ("Railway Workers strike spreads", "Railway Workers strike spreads"),
    ],
)
def test_supplied_lines_to_watch(spark, supplied, line):
    cards = spark.createDataFrame([(1, "Railway workers on strike", None, supplied, "Railway workers on strike")], "card int, headline string, lead string, supplied string, already_said string")
    articles = spark.createDataFrame([(1, 0, "h", "The Railway hearing is on January 30.", datetime.datetime(2024, 1, 5))], "card int, place int, headline string, main_text string, published timestamp")
    assert [r.line for r in models.what_to_watch(cards, articles).collect()] == [line]


def test_derived_lines_to_watch(spark):
    cards = [(n, "Railway workers on strike", "Railway news", "" if n % 2 else None, "x") for n in range(1, 7)] + [(7, None, None, None, None)]
    bodies = {
        1: ["The meeting is on January 20. Railway board calls a vote on Jan. 21.", "Railway hearing on January 19."],
        2: ["Railway board met on January 1. A vote came.", "No one. The Railway hearing and strike are due Sept 4."],
        3: ["The Fed meeting is scheduled for January 16."],
        4: ["the railway hearing is on January 16."],
        5: [None],
        7: ["The Fed meeting is scheduled for January 16, 2025."],
    }
    rows = [(n, i, None, text, datetime.datetime(2024, 1, 5)) for n, texts in bodies.items() for i, text in enumerate(texts)]
    articles = spark.createDataFrame(rows, "card int, place int, headline string, main_text string, published timestamp")
    cards = spark.createDataFrame(cards, "card int, headline string, lead string, supplied string, already_said string")
    assert {r.card: r.line for r in models.what_to_watch(cards, articles).collect()} == {
        1: "The vote is scheduled for Jan. 21.",
        2: "The strike is scheduled for Sept 4.",
        3: "", 4: "", 5: "", 6: "",
        7: "The meeting is scheduled for January 16, 2025.",
    }


def feed_items(spark, rows):
    schema = "endpoint string, channel string, rank int, headline string, link string, body string, published timestamp, tags array<string>"
    return spark.createDataFrame(rows, schema)


def test_ingest_merges_channels_and_reports_every_endpoint(spark):
    at = lambda hour: datetime.datetime(2024, 1, 5, hour)
    rows = [
        ("m1", "sitemap", 1, "Told", "https://www.a.com/1/", None, at(5), ["city"]),
        ("f1", "rss", 9, "Told", "https://a.com/1", None, at(5), None),
        ("f1", "rss", 0, "Long", "https://a.com/2", "x" * 600, at(4), []),
        ("m1", "sitemap", 0, "Long", "https://a.com/2", None, at(9), ["late"]),
        ("f1", "rss", 2, "Late one", "https://a.com/3", "Late one. More of it", at(3), ["own"]),
        ("f1", "rss", 3, "", "https://a.com/4", "no headline", at(3), None),
        ("f1", "rss", 4, "No link", None, "no link", at(3), None),
        ("f2", "rss", 0, "Undated", "https://b.com/1", "none", None, None),
        ("f3", "rss", 0, "Coming", "https://c.com/1", "none", at(20), None),
    ]
    items, now = feed_items(spark, rows), F.lit("2024-01-05 10:00:00").cast("timestamp")
    found = {r.canonical_url: r for r in views.ingest(items, now).collect()}
    assert {u: (r.channel, r.tags, r.body_status, r.bucket, r.prominence) for u, r in found.items()} == {
        "https://a.com/1": ("rss", ["city"], "headline_only", "tail", 4),
        "https://a.com/2": ("rss", ["late"], "full", "lead", 24),
        "https://a.com/3": ("rss", ["own"], "summary", "topline", 18),
    }
    assert found["https://a.com/1"].main_text == "Told"
    assert [r.canonical_url for r in views.ingest(items, now, 1).collect()] == ["https://a.com/1"]
    assert views.ingest(items.limit(0), now).count() == 0

    endpoints = spark.createDataFrame([("f1", "rss"), ("f2", "rss"), ("f3", "rss"), ("m1", "sitemap"), ("m2", "sitemap")], "endpoint string, channel string")
    report = {r.endpoint: (r.status, r.newest_age_hours, r.item_count) for r in views.ingest_report(endpoints, items, now).collect()}
    assert report == {"f1": ("ok", 5.0, 5), "f2": ("no-dates", None, 0), "f3": ("future-clock", -10.0, 0), "m1": ("ok", 1.0, 2), "m2": ("unreachable", None, 0)}
    old = {r.endpoint: r.status for r in views.ingest_report(endpoints, items, F.lit("2024-01-08 10:00:00"), stale=48).collect()}
    assert old["f1"] == old["m1"] == "STALE"


def test_published_cards_have_copy_evidence_and_one_stamp(spark):
    day = datetime.datetime(2024, 1, 4, 20)
    cards = [("a", 1, "Dam opens", 3, 2, day, "economy", "WALLET,WORK", "national"), ("b", 2, "Rain", 1, 1, day, None, "", None), ("c", 3, "Not picked", 1, 1, day, "city", "WORK", "local")]
    cards = spark.createDataFrame(cards, "cluster string, lead_id long, headline string, articles long, sources long, latest timestamp, category string, impact_labels string, pk_relevance string")
    picks = spark.createDataFrame([("a", 2), ("b", 1)], "id string, slot int")
    articles = spark.createDataFrame([(1, "Dam opens", "Dam opens. The gates were raised. Water ran."), (2, "Rain", None), (3, "Not picked", "x")], "id long, headline string, main_text string")
    rows = {r.cluster: r for r in views.publish(picks, cards, articles, F.lit("2024-01-04 20:30:00")).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].slot, rows["a"].snippet, rows["a"].why_it_matters) == (2, "The gates were raised. Water ran.", "This matters for wallet today.")
    assert rows["a"].what_to_watch == "Watch for the next official economic update."
    assert tuple(rows["a"].evidence) == (2, 3, "national", day)
    assert (rows["b"].snippet, rows["b"].why_it_matters, rows["b"].what_to_watch) == ("Rain", "", "Watch for the next verified update.")
    assert {(str(r.brief_run_at), str(r.edition_date)) for r in rows.values()} == {("2024-01-04 20:30:00", "2024-01-05")}


def worded(seed: int, n: int) -> list[tuple]:
    """Cards with few and frequent words, copies and empty ones."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(40)] + ["launch", "court"]
    pick = lambda most: sorted({rng.choice(pool[: rng.choice((4, 42))]) for _ in range(rng.randint(0, most))})
    rows = [(k, rng.choice(["p", "q", None]), pick(8), [w.upper() if w.startswith("w") else w for w in pick(3)]) for k in range(n)]
    return rows + [(n + k, *row[1:]) for k, row in enumerate(rows[:20])]


CARDS = "id long, source string, tokens array<string>, cues array<string>"


@pytest.fixture
def small_steps(monkeypatch):
    from tidewire.operators import sets

    monkeypatch.setattr(sets, "TILE_ROWS", 50)
    monkeypatch.setattr(sets, "CELLS", 300)
    monkeypatch.setattr(sets, "MEETINGS", 200)


@pytest.mark.parametrize("least", (0.6, 0.75, 1.0))
def test_duplicate_cards_meet_in_tiles(spark, small_steps, least):
    rows = worded(1, 130)
    sets_ = {r[0]: set(r[2]) for r in rows}
    want = {(a, b): len(sets_[a] & sets_[b]) / min(len(sets_[a]), len(sets_[b])) for a in sets_ for b in sets_ if a < b and sets_[a] and sets_[b]}
    cards = spark.createDataFrame(rows, CARDS)
    found = pairs.duplicate_cards(cards, least)
    # No candidates are dealt between tasks: what is joined is tiles.
    assert "token#" not in found._jdf.queryExecution().toString()
    assert {(r.a, r.b): r.overlap for r in found.collect()} == {k: v for k, v in want.items() if v >= least}


def test_compatible_pairs_meet_in_tiles(spark, small_steps):
    rows = worded(2, 130)
    generic = set(t.GENERIC_CUES)
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    want = {}
    for a, s, x, c in rows:
        for b, z, y, d in rows:
            common = set(x) & set(y) | set(c) & set(d)
            own = (s == z or s is None or z is None) and (not set(x) & set(y) or len(common - generic) < 2)
            h, e, n = jac(set(x), set(y)), jac(set(c), set(d)), len(common - generic)
            if a < b and not own and (2 if n == 1 and len(common) >= 3 and h >= 0.2 else n) >= 2 and (h >= 0.2 or e >= 0.15):
                want[a, b] = (h, e)
    found = pairs.compatible_pairs(spark.createDataFrame(rows, CARDS))
    assert "token#" not in found._jdf.queryExecution().toString()
    assert {(r.a, r.b): (r.h, r.e) for r in found.collect()} == want
    some = sorted(want)[:2]
    told = spark.createDataFrame([(*some[0], False), (*some[1], True)], "a long, b long, same boolean")
    assert {(r.a, r.b) for r in pairs.compatible_pairs(spark.createDataFrame(rows, CARDS), verdicts=told).collect()} == set(want) - {some[0]}


def test_distinct_headlines_are_the_walk_by_blocks(spark, small_steps, monkeypatch):
    monkeypatch.setattr(grouping, "FIRST_BLOCK", 20)
    rows = worded(3, 130)
    kept = []
    for k, _, x, _ in rows:
        if not any(len(set(x) & y) >= 0.6 * min(len(x), len(y)) for y in kept if x and y):
            kept.append(set(x))
            rows[k] = (k, "kept", x, [])
    got = {r.id for r in grouping.distinct_headlines(spark.createDataFrame(rows, CARDS), 0.6).collect()}
    assert got == {r[0] for r in rows if r[1] == "kept"}


def test_most_shared_of_tiles(spark, small_steps):
    from tidewire.operators import sets

    rng = random.Random(4)
    rows = [(*r, [rng.gauss(0, 0.3) for _ in range(3)] if k % 9 else None) for k, r in enumerate(worded(4, 130))]
    want = []
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    for a, _, x, c, v in rows:
        for b, _, y, d, w in rows:
            if a < b and v and w and len(set(x) & set(y)) >= 2 and -0.05 <= sum(p * q for p, q in zip(v, w)) <= 0.10:
                want.append((-len(set(x) & set(y)), -(jac(set(x), set(y)) + jac(set(c), set(d))), a, b))
    found = sets.most_shared(spark.createDataFrame(rows, CARDS + ", embedding array<double>"), 2, -0.05, 0.10, 24)
    assert [(r.a, r.b, r.shared) for r in found.collect()] == [(a, b, -n) for n, _, a, b in sorted(want)[:24]]


def test_keywords_are_found_by_words():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    keys = {word(rng.randint(2, 5)) for _ in range(12)} | {"a b", "", "aab ba"}
    known = pairs.Keywords(keys)
    for _ in range(300):
        hay = " ".join(word(rng.randint(0, 7)) for _ in range(rng.randint(0, 6)))
        assert known.found(hay) == {k for k in keys if k in hay}


def test_expectations_count_each_keyword(spark):
    rows = [(1, ["fuel", "oil price", "fuel"], 2), (2, ["price", None], 2), (3, [], 1), (4, ["ice"], None), (5, None, 1)]
    ex = spark.createDataFrame(rows, "expectation int, keywords array<string>, min_hits int")
    cards = spark.createDataFrame([("a", "Refuelling: the OIL, price"), ("b", "Oil price"), ("c", None)], "card string, text string")
    assert sorted(tuple(r) for r in pairs.expectation_hits(ex, cards).collect()) == [(1, "a", 2), (4, "a", 1), (4, "b", 1)]


def test_scorer_words_are_taken_not_replaced(spark):
    texts = ["", "!!", "!a!", " a  b ", "É2x, y\n", "K% off", "\U0001f600a"]
    norm = lambda x: re.sub("[^a-z0-9 ]+", " ", x.lower())
    assert [one(spark, t.scorer_normal(F.col("v")), v=x) for x in texts] == [norm(x) for x in texts]
    assert one(spark, t.scorer_normal(F.col("v")), v=None) == ""
    flags = spark.createDataFrame([("Two ON two rupees", "Two rupees")], "i string, h string").select(*[c.alias(k) for k, c in t.brief_flags(F.col("i"), F.col("h")).items()])
    assert flags.first().restates == 1.0
    # Replacing in whole texts, once a use, was most of the time.
    assert "regexp_replace" not in flags._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_ends_are_sought_at_stops_only(spark):
    plan = spark.range(1).select(t.sentences(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    # Look-behinds at every character were most of the time.
    assert "(?=[.!?])(?<!" in plan


def test_snippet_of_a_long_text_is_its_first_sentences(spark):
    assert one(spark, t.snippet(F.col("v")), v="One came. Two saw. " + "Word " * 20_000) == "One came. Two saw."


def test_hash64_reads_one_digest_with_its_sign(spark):
    import hashlib

    words = [str(k) for k in range(200)]
    plan = spark.createDataFrame([(w,) for w in words], "v string").select(t.hash64(F.col("v")).alias("h"))
    assert [r.h for r in plan.collect()] == [int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big", signed=True) for w in words]
    assert plan._jdf.queryExecution().analyzed().toString().count("md5(") == 1


def test_publishers_meet_patterns_only_where_named(spark):
    found = lambda v: one(spark, t.named_publishers(F.col("v")), v=v)
    assert found("DAWN said so. ACCORDING TO the geo it fell.") == ["dawn", "geo"]
    assert found("dawn said") == found("According to it") == []
    plan = spark.range(1).select(t.named_publishers(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(") >= len(t.PUBLISHERS)


@pytest.mark.parametrize("rows_per_tile", [8192, 40])
def test_first_related_as_by_all_hits(spark, small_steps, monkeypatch, rows_per_tile):
    from tidewire.operators import sets

    monkeypatch.setattr(sets, "LEAST_ROWS", rows_per_tile)
    rng = random.Random(6)
    vec = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]
    rows = [(k, f"s{k % 3}", k // 3 % 4 if k % 23 else None, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 3))], vec() if k % 17 else None) for k in range(150)]
    others = spark.createDataFrame(rows, "id long, source string, cluster int, anchors array<string>, embedding array<double>")
    for card in (F.col("id"), F.col("cluster").cast("long")):
        primary = others.where("id % 5 = 0 and cluster is not null").withColumn("card", card)
        old = pairs.related_articles(primary, others, -0.2).join(others.select("id", "source", "cluster"), "id")
        old = ranking.first_per(old, ["card", "source", "cluster"], [F.desc("similarity"), F.desc("shared"), "id"], 2)
        new = sets.first_related(primary, others, -0.2, 2)
        new = ranking.first_per(new, ["card", "source", "cluster"], [F.desc("similarity"), F.desc("shared"), "id"], 2)
        columns = ["card", "id", "source", "cluster", "similarity", "shared"]
        want = sorted(tuple(r) for r in old.select(*columns).collect())
        assert want and sorted(tuple(r) for r in new.select(*columns).collect()) == want


def test_guilt_is_sought_where_a_term_stands(spark):
    found = lambda v: one(spark, t.asserts_culpability(F.col("v")), v=v)
    assert found("It rained. The Corrupt clerk lied.") and found("A COVER-UP.")
    assert not found("It rained. He alleged corruption.") and found(None) is False and found("Incorruptible.") is False
    plan = spark.range(1).select(t.asserts_culpability(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("contains(") >= len(t.CONCLUSIONS)


def test_a_packet_of_facts_gives_the_errors_of_its_evidence(spark):
    texts = {1: "It fell by Rs 1,200 on Monday, 2007-09. “Ünïted” a_b, 3,5", 2: None, 3: "", 4: "The 5 May audit never​ happened.", 5: "cor​rupt\n\n men, 7.5 million"}
    said = [("In 2009 it fell by 1200.", ["1"]), ("No figure.", ["9"]), ("It took 22 billion.", ["4"]), ("No figure at all.", [])]
    kinds = "card long, analysis string, claims array<struct<text: string, ids: array<string>>>, question string, question_ids array<string>, basis string, subject array<string>"
    answers = spark.createDataFrame([(k, x, said, "What audit of 1,200 was there?", ["1"], "evidence_gap", []) for k, x in texts.items()], kinds)
    packet = spark.createDataFrame([(k, k + j, "related" if j else "primary_event", "dawn", texts.get(k + j)) for k in texts for j in (0, 1)], "card long, id long, role string, publisher string, evidence string")
    rows = lambda p: sorted(map(tuple, validation.analysis_errors(answers, p).collect()))
    told = rows(packet)
    assert told == rows(validation.evidence_facts(packet))
    assert ["unsupported_conclusion_in_analysis" in r[1] for r in told] == [False, False, False, True, True]
    words = {r.id: r.words for r in validation.evidence_facts(packet).collect()}
    assert words[1] == " it fell by rs 1200 on monday 2007 09 ünïted a_b 35 " and words[3] == "  "


def test_white_space_collapses_as_every_run_would(spark):
    own = random.Random(14)
    texts = ["".join(own.choice("ab \t\n\r\x0b\x0c ") for _ in range(own.randrange(12))) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.collapse(F.col("x")).alias("y")).collect()
    assert all(r.y == re.sub("[ \t\n\x0b\x0c\r]+", " ", r.x).strip(" ") for r in got)


def test_shingles_of_one_row_alone_leave_no_row(spark):
    own = random.Random(18)
    sets = []
    for k in range(150):
        base = own.sample(range(4000), own.randint(1, 30))
        sets += [base, [*base[1:], 5000 + k], [*base, 6000 + k]]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "id long, s array<long>")
    rare = pairs.rare_shingles(rows, 0.7).collect()
    holders = {}
    for k, s in enumerate(sets):
        for token in s:
            holders.setdefault(token, set()).add(k)
    assert rare and all(len(holders[r.token]) > 1 and r.n == len(sets[r.id]) for r in rare)
    met = {(x.id, y.id) for x in rare for y in rare if x.token == y.token and x.id < y.id and (x.indexed or y.indexed)}
    alike = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) for b in [sets[j]] if len({*a} & {*b}) >= 0.7 * len({*a} | {*b})}
    assert len(alike) > 200 and alike <= met


def test_shuffled_shingles_are_short_and_lose_no_pair(spark):
    own = random.Random(17)
    # Many hashes have their lowest 40 bits in common, also within a set.
    spread = lambda k: k % 700 - ((k // 700) << 40)
    sets = []
    for _ in range(100):
        base = own.sample(range(3000), own.randint(1, 30))
        sets += [base, [*base[1:], own.randrange(3000, 4000)]]
    rows = spark.createDataFrame([(k, [spread(x) for x in s]) for k, s in enumerate(sets)], "id long, s array<long>")
    rare = pairs.rare_shingles(rows, 0.7).collect()
    assert rare and all(0 <= r.token < 1 << 40 for r in rare)
    met = {(x.id, y.id) for x in rare for y in rare if x.token == y.token and x.id < y.id and (x.indexed or y.indexed)}
    alike = {(i, j) for i, a in enumerate(sets) for j in range(i + 1, len(sets)) for b in [sets[j]] if len({*a} & {*b}) >= 0.7 * len({*a} | {*b})}
    assert len(alike) > 50 and alike <= met


def test_equal_shingle_sets_have_one_digest(spark):
    texts = ["a b c d e", "A b, c d e", "a b c d e a b c d e a b c", "c d e a b c d e a b c", "a b", "", None, "ünï a b c", "K 1 2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    prints = sorted(pairs.fingerprints(rows, F.col("x")).collect())
    assert all((p.k == q.k) == ({*p.s} == {*q.s}) for p in prints for q in prints)
    said = rows.select("id", t.simhash64(F.coalesce("x", F.lit(""))).alias("fp"), t.shingle_hashes(F.coalesce("x", F.lit(""))).alias("s"))
    assert [(p.id, p.fp, p.s) for p in prints] == [(r.id, r.fp, sorted(r.s)) for r in sorted(said.collect())]


def test_a_staged_table_is_read_before_its_commit_and_counts_after_it(spark, tmp_path):
    root = str(tmp_path / "t")
    snapshots.write_snapshot(spark.range(2), root)
    version, rows = snapshots.staged(spark.range(5, 8), root)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(rows) == [5, 6, 7] and ids(snapshots.read_snapshot(spark, root)) == [0, 1]
    snapshots.commit_snapshot(rows, root, version, "append")
    assert ids(snapshots.read_snapshot(spark, root)) == [0, 1, 5, 6, 7]


def test_texts_are_not_shuffled_for_few_seen_urls(spark, tmp_path):
    own = random.Random(12)
    rows = [(k, f"https://a.example.com/{k}", f"Head {k}", " ".join(str(own.random()) for _ in range(100))) for k in range(200)]
    spark.createDataFrame(rows, "id long, url string, headline string, main_text string").write.parquet(str(tmp_path / "r"))
    new = spark.read.parquet(str(tmp_path / "r"))
    seen = new.where("id % 10 = 0").select(urls.canonical(F.col("url")).alias("canonical_url"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        kept = views.dedup(new, seen)
        assert {r.id for r in kept.collect()} == {k for k in range(200) if k % 10}
        plan = kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [canonical_url" in plan


def long_texts(seed, n):
    own = random.Random(seed)
    parts = ["One came", "Dr. Khan", "e.g. so", "x", ", and", "\u0001", "   ", "\n\n", "\t", "2 rose", "Ünï", "\u00a0", "word " * 30, " " * 300, "-" * 70, "\U0001f600"]
    ends = [".", "?!", "...", ". ", "! ", ".\n", ".  ", ". \n ", " ", ": "]
    return ["".join(own.choice(parts) + own.choice(ends) for _ in range(own.choice([1, 3, 20, 80, 200]))) for _ in range(n)]


def test_a_snippet_lies_in_the_beginning_of_a_long_text(spark):
    rows = spark.createDataFrame([(x,) for x in [*long_texts(22, 600), "y" * 479 + ". Z", "Y" * 239 + ". " + "Z" * 300, None]], "v string")
    whole = t.let(t.collapse(F.coalesce("v", F.lit(""))), lambda f: t.let(t.sentences(f), lambda parts: t._snippet(f, parts, 240)))
    told = rows.select("v", t.snippet(F.col("v")).alias("got"), whole.alias("want"))
    assert [r.v for r in told.collect() if r.got != r.want] == []
    assert "substring(coalesce(v" in told._jdf.queryExecution().analyzed().toString()


def test_first_sentences_are_those_of_the_whole_text(spark, monkeypatch):
    monkeypatch.setattr(t, "BEGINNING", 120)
    rows = spark.createDataFrame([(x,) for x in [*long_texts(19, 600), None, ""]], "v string")
    told = rows.select("v", t.first_sentences(F.col("v"), 3).alias("got"), F.slice(t.sentences(F.col("v")), 1, 3).alias("want"))
    rows = told.collect()
    assert [r.v for r in rows if r.got != r.want] == [] and sum(r.want is not None and len(r.want) == 3 for r in rows) > 300


def test_a_story_is_read_once(spark):
    answers = spark.createDataFrame([(1, '[{"cluster_id": "1", "impact_line": "The gates of the dam were raised."}, 7]')], "edition int, answer string")
    kinds = "edition int, cluster int, headline string, category string, labels array<string>, articles int, facts array<string>, source string"
    cards = spark.createDataFrame([(1, 1, "Gates raised", "city", ["SAFETY"], 1, ["A dam"], "dawn")], kinds).where("edition > 0")
    found = validation.editorial_stories(answers, cards, ["city"], ["SAFETY"])
    assert [(r.edition, r.cluster, r.priority, r.tags) for r in found.collect()] == [(1, "1", 55, ["city", "a-dam"])]
    # The list of an answer, and each story in it; limits that were moved down would read every story for themselves.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 2


def test_coverage_lists_only_tokens_that_are_wanted(spark):
    own = random.Random(26)
    kind = "id long, tokens array<string>"
    words = lambda n, m: [*(f"w{int(own.random() ** 2 * 40)}" for _ in range(n)), *(f"other{own.randrange(500)}" for _ in range(m))]
    ours = [(k, words(own.randint(0, 12), own.randint(0, 30))) for k in range(300)] + [(900, []), (901, None)]
    wanted = [(k, words(own.randint(1, 25), 0)) for k in range(25)] + [(50, ["none"])]
    table = spark.createDataFrame(ours, kind).withColumn("tokens", F.array_distinct("tokens"))
    asked = {x for _, tokens in wanted for x in tokens}
    listed = pairs.postings(table, spark.createDataFrame([(x,) for x in asked], "token string")).collect()
    of = {k: {*tokens} for k, tokens in ours if tokens}
    assert {(r.id, r.token) for r in listed} == {(k, x) for k, tokens in of.items() for x in tokens & asked}
    assert all(r.n == len(of[r.id]) and r.place == len(of[r.id] - asked) + r.rank for r in listed)
    got = {r.w: r.best for r in pairs.coverage(spark.createDataFrame(wanted, kind), spark.createDataFrame(ours, kind)).collect()}
    assert got == {k: pytest.approx(max(len({*x} & o) / min(len({*x}), len(o)) for o in of.values())) for k, x in wanted}


def test_bodies_are_not_shuffled_for_a_report_of_few_endpoints(spark, tmp_path):
    own = random.Random(25)
    rows = [(f"e{k % 3}" if k % 50 else None, f"Head {k}", f"https://a.example.com/{k}", " ".join(str(own.random()) for _ in range(100)), datetime.datetime(2024, 1, 1)) for k in range(200)]
    kind = "endpoint string, headline string, link string, body string, published timestamp"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "items"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        told = capture.quarantine(spark.read.parquet(str(tmp_path / "items")), F.lit("2024-01-01 01:00:00").cast("timestamp"))
        plan = told._jdf.queryExecution().sparkPlan().toString()
        assert told.where("label is null").count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


#: Bodies of which a sentence is left, and blank ones, which have none.
BLANK_BODIES = [(1, "Head\nOne came. Two saw."), (2, "Head\n   "), (3, ""), (4, None), (6, " ")]


def documents(spark, path, rows):
    made = [(k, x, "en", "dawn", len(x or "")) for k, x in rows]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_outcomes_of_blank_bodies_have_no_question(spark, tmp_path):
    found = registry.QUERIES["mdl_analysis_outcome"](spark, documents(spark, tmp_path, BLANK_BODIES)).collect()
    asked = {r.card: r.question or r.rejected_question for r in found}
    assert asked == {1: "What audit or oversight of Two saw.?", 2: None, 3: None, 4: None, 6: None}


def test_analyses_of_blank_bodies_are_checked(spark, tmp_path):
    found = registry.QUERIES["val_story_analysis"](spark, documents(spark, tmp_path, BLANK_BODIES)).collect()
    assert sorted(r.id for r in found) == [1, 2, 3, 4, 6]
    assert {r.id: "generic_question" in r.question_errors for r in found} == dict.fromkeys([1, 2, 3, 4, 6], False)


def test_a_brief_is_scored_with_its_impact_lines(spark, tmp_path):
    texts = ["Fares rise\nFares rise again", "Fares rise\nCommuters face delays", "Fares rise\nIt may rain", "Fares rise\n   ", "Fares rise\nA litre is 3 rupees", None]
    sf = documents(spark, tmp_path, enumerate(texts))
    spark.createDataFrame([(1, "commuters delays"), (2, "weather vanes")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    found = registry.QUERIES["agg_brief_score"](spark, sf).first().asDict()
    assert found == {"expected": 2, "matched": 1, "missed": 1, "recall": 0.5, "impact_lines": 4, "restating": 1, "lacking_anchor": 2, "hedged": 1, "stock_form": 1}


def test_every_article_is_a_card_of_related_ones(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, f"Karim meets Salma {k}\nBody") for k in (1, 2, 3, 50)])
    spark.createDataFrame([(k, [0.6, 0.8], k % 2) for k in (1, 2, 3, 50)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    found = {(r.card, r.place): r.id for r in registry.QUERIES["win_related_caps"](spark, sf).collect()}
    assert found == {(1, 1): 2, (1, 2): 50, (2, 1): 1, (2, 2): 3, (3, 1): 2, (3, 2): 50, (50, 1): 1, (50, 2): 3}


def test_tiles_of_many_rows_stay_few(spark, monkeypatch):
    from tidewire.operators import sets

    monkeypatch.setattr(sets, "LEAST_ROWS", 8)
    # Each tile goes to every tile of the cards, so what is shuffled grows with their number.
    assert sets.dealt_by(spark.range(400), ["id"]).count() <= sets.TILES


def test_tiles_hold_each_word_once(spark):
    from tidewire.operators import sets

    own = random.Random(33)
    rows = [(k, [f"word{own.randrange(300)}" for _ in range(own.randrange(20))] if k % 9 else None) for k in range(2000)]
    tiles = sets.cut(spark.createDataFrame(rows, "id long, tokens array<string>"), 2).collect()
    held = [sets.unpacked(pa.scalar(bytes(r.body), pa.binary())) for r in tiles]
    # In order, a row's pairs are written as two runs.
    assert all(part["id"].to_pylist() == sorted(part["id"].to_pylist()) for part in held)
    assert sorted((x["id"], x["tokens"] or []) for part in held for x in part.to_pylist()) == [(k, x or []) for k, x in rows]
    # Words and their lengths as they stand would be five times as much; each tile is shuffled once per other one.
    assert sum(len(r.body) for r in tiles) < sum(len(w) + 4 for _, x in rows for w in x or []) / 4


def test_tiles_of_compatible_pairs_keep_single_precision(spark, monkeypatch):
    from tidewire.operators import sets

    seen = []
    cut = sets.cut
    monkeypatch.setattr(sets, "cut", lambda rows, *a: seen.append(dict(rows.dtypes)["embedding"]) or cut(rows, *a))
    rows = [(k, f"s{k}", ["dam", "gate"], ["dam", "gate"], [0.6, 0.8]) for k in range(3)]
    for kind in ("float", "double"):
        articles = spark.createDataFrame(rows, f"id long, source string, tokens array<string>, cues array<string>, embedding array<{kind}>")
        found = pairs.compatible_pairs(articles, 0.5).collect()
        assert sorted((r.a, r.b) for r in found) == [(0, 1), (0, 2), (1, 2)] and all(r.similarity == pytest.approx(1.0) for r in found)
    assert seen == ["array<float>", "array<double>"]


def test_dated_pairs_group_as_pairs_that_meet_their_dates(spark):
    own = random.Random(45)
    vec = lambda: [own.choice([0.1, 0.5, 0.9]) for _ in range(3)]
    words = lambda n: own.sample([f"word{k}" for k in range(9)], n)
    rows = [(k, f"s{k % 5}", f"u{k}", own.randrange(96) if k % 19 else None, vec() if k % 13 else None, words(4), words(3)) for k in range(160)]
    rows += rows[40:60]
    kind = "id long, source string, url string, h int, embedding array<double>, tokens array<string>, cues array<string>"
    articles = spark.createDataFrame(rows, kind).withColumn("publish_date", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h)"))
    dated = pairs.dated_pairs(articles.withColumn("us", F.unix_micros("publish_date")), 0.05, 36)
    assert dated.count() > 300 and {r.x for r in dated.select((F.abs("apart") <= 36 * 3600e6).alias("x")).distinct().collect()} == {True}
    rules = grouping.EventRules(centroid=0.3, mean=0.05, span_hours=36, pair=0.05)
    plain = pairs.compatible_pairs(articles.where("embedding is not null").drop("publish_date"), 0.05)
    want = sorted(map(tuple, grouping.event_groups(articles, plain, rules).collect()))
    assert len({g for _, g, _ in want}) < len(want) - 30
    assert sorted(map(tuple, grouping.event_groups(articles, dated, rules).collect())) == want
