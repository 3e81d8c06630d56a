"""Each operator against brute force on a small table of hard cases, and on an empty one."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import bpe, exact_dedup, fingerprints, licenses, near_dedup, packing, periodic_runs, pii, quality, token_files, toxicity, url_filters, vector_codes


def sha(data):
    return hashlib.sha256(data).hexdigest()


def text_of(row):
    return row[1] or ""


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# 1 fingerprints


def test_fingerprints_of_texts_and_edits(rows, docs):
    got = by_id(fingerprints.edit_report(docs))
    texts = {r[0]: text_of(r) for r in rows}
    order = sorted(texts, reverse=True)
    prints = defaultdict(set)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == sha(edited.encode())
        prints[t].add(got[i].fingerprint)
        prints[edited].add(got[i].edited_fingerprint)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert (got[i].near_edited == 1) == (edited == t) or not t.strip()
        if edited == t:
            assert got[i].changed_section is None and got[i].changed_paragraph is None
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)
    long = [got[r[0]] for r in rows if len(text_of(r)) > 500 and " " in text_of(r)]
    assert all(0.3 < g.near_edited < 0.8 and g.near_next < 0.2 or g.near_next > 0.8 for g in long)


def merkle(text):
    """Root of the tree and the distinct runs of words, built from their definitions."""
    sections = [sha(",".join(sha(p.encode()) for p in s.split("\n")).encode()) for s in text.split("\n\n")]
    return sha(",".join(sections).encode()), set(re.findall(r"(?:[^ \n]+ *){1,8}", text))


def brute_likeness(a, b):
    (root_a, x), (root_b, y) = merkle(a), merkle(b)
    return 1.0 if root_a == root_b else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_fingerprints_are_merkle_trees(rows, docs):
    got = by_id(fingerprints.edit_report(docs))
    texts = {r[0]: text_of(r) for r in rows}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (merkle(t)[0], merkle(edited)[0])
        assert got[i].near_edited == pytest.approx(brute_likeness(t, edited))
        assert got[i].near_next == pytest.approx(brute_likeness(t, nxt))


def test_rows_without_an_id_have_neighbours(spark):
    table = [(None, f"text number {k}") for k in range(300)] + [(k, f"other {k}") for k in range(200)]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = fingerprints.with_next(fingerprints.slim(docs)).collect()
    assert len(got) == 500 and all(r.next_text is not None for r in got)
    assert {r.text for r in got} == {r.next_text for r in got}
    assert all(r.next_text == f"other {r.doc_id - 1}" for r in got if r.doc_id)


def test_an_edit_is_located(spark):
    two = spark.createDataFrame([(1, "a b\nc d\n\ne f\ng h", "a b\nc d\n\ne f\ng X")], "id int, x string, y string")
    a, b = fingerprints.tree_of(F.col("x")), fingerprints.tree_of(F.col("y"))
    two = two.select(a.alias("a"), b.alias("b"))
    section, paragraph = fingerprints.locate(F.col("a"), F.col("b"))
    assert two.select(section, paragraph).first()[:] == (1, 1)


def test_fingerprints_of_repeated_and_no_rows(repeated, empty):
    assert fingerprints.edit_report(repeated).count() == repeated.count()
    assert fingerprints.edit_report(empty).count() == 0


# 2 exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(rows, docs, keep):
    got = by_id(exact_dedup.exact_groups(docs, keep=keep, runs=8, fan_in=2))
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(text_of(r))].append(r[0])
    for text, ids in groups.items():
        for i in ids:
            best = max(ids) if keep == "largest" else min(ids)
            assert got[i][:] == (i, best, len(ids), i == best, sha(text.encode()))


def test_exact_copies_are_dropped(rows, docs, repeated, empty):
    texts = [ascii_lower(text_of(r)) for r in rows]
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and left.count() == len(set(texts))
    assert exact_dedup.drop_exact_copies(repeated).count() == len({*texts, "no id"})
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_a_merge_carries_groups_over_batches():
    import pyarrow as pa

    row = lambda d, keep, n: (0, 0, d, 1, 1, keep, n)
    batch = lambda *r: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*r), exact_dedup.RUN.types)], schema=exact_dedup.RUN)
    out = list(exact_dedup.merge_sorted(iter([batch(row(b"a", 9, 2), row(b"a", 5, 1)), batch(row(b"a", 3, 4), row(b"b", 1, 1))])))
    assert [tuple(r.values())[5:] for b in out for r in b.to_pylist()] == [(9, 7), (1, 1)]


# 3 byte-level BPE

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_as_the_library(rows, docs, repeated, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.encoding_digests(docs, RANKS, public_tokenizers.PATTERN))
    for r in rows:
        ids = np.array(library.encode_ordinary(text_of(r)), "<u4")
        assert got[r[0]][:] == (r[0], len(ids), sha(ids.tobytes()), sha(text_of(r).encode()))
    encoded = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    back = by_id(bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN))
    assert {r[0]: text_of(r) for r in rows} == {k: v.text for k, v in back.items()}
    assert bpe.encoding_digests(repeated, RANKS, public_tokenizers.PATTERN).count() == repeated.count()
    assert bpe.encoding_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_merges_take_the_leftmost_lowest_pair():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"ab": 299, b"aab": 301, b"aaaa": 302}
    assert bpe.merge_bytes(b"aaa", ranks) == [300, 97]
    assert bpe.merge_bytes(b"aab", ranks) == [301]
    assert bpe.merge_bytes(b"aaba", ranks) == [301, 97]
    assert bpe.merge_bytes(b"caaaaa", ranks) == [99, 302, 97]
    assert bpe.merge_bytes(b"", ranks) == []


def test_merges_of_many_pieces_are_those_of_each():
    own = np.random.default_rng(4)
    ranks = {bytes([c]): c for c in range(256)}
    while len(ranks) < 900:
        a, b = (list(ranks)[int(own.integers(97, 100)) if own.random() < 0.6 else int(own.integers(256, len(ranks) + 1)) - 1] for _ in range(2))
        if len(a + b) < 12:
            ranks.setdefault(a + b, len(ranks))
    pieces = [bytes(own.integers(97, 100, int(n)).astype(np.uint8)) for n in own.integers(2, 65, 600)]
    pieces = [p for p in pieces if p not in ranks]
    found = bpe.merge_together(pieces, bpe.PairRanks(ranks), 64)
    assert len(pieces) > 500 and [np.frombuffer(f, "<u4").tolist() for f in found] == [bpe.merge_bytes(p, ranks) for p in pieces]


# 4 packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD_PIECES = ["İ", "I\u0307", "i\u0307", "\u0307", "é", "e\u0301", "\u0301", "ش\u0651", "क\u093c", "\u0958", "\ufb2a", "\u1e9e", "ǅ", "Σ", "ς", "K", "Å", "한", "\u1112\u1161"]
ODD_PIECES += [" ", "  ", "\n", " \n", "\t", "\u00a0", "\u2003", "\x1c", "\u200b", "\x00", ".", ",", ";", ":", "!", "?", "'s", "'LL", "<", "|", "<|", "|>", "<|endoftext|>", "<|EndOfText|>"]
ODD_PIECES += ["<|startoftext|>", "word", "Word", "WORD", "BAŞKENTİ", "a", "B", "7", "१", "²", "🎉", "日本", "-", "_", "≮", "=\u0338", "ª", "ʰ"]


def odd_texts(n, seed):
    import random

    own = random.Random(seed)
    return ["".join(own.choice(ODD_PIECES) for _ in range(own.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_plain_library_call(name):
    import pyarrow as pa

    texts = ["Ankara BAŞKENTİ. Son", "İ.", "a <|endoftext|> b", *odd_texts(50_000, 5)]
    encode = packing.json_encoder(public_tokenizers.path(name))
    for start in range(0, len(texts), 5000):
        part = texts[start : start + 5000]
        got = [np.frombuffer(i, "<u4").tolist() for i in encode(pa.array(part))]
        wrong = [(t, g, e) for t, g, e in zip(part, got, library_ids(public_tokenizers.path(name), part)) if g != e]
        assert not wrong, wrong[:3]


def check_packing(pieces, expected, capacity):
    assert {r.doc_id for r in pieces} == set(expected)
    for i, ids in expected.items():
        own = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_packing(rows, docs, repeated, empty):
    ids = library_ids(JSON, [text_of(r) for r in rows])
    expected = {r[0]: [*i, 0] for r, i in zip(rows, ids)}
    used = check_packing(packing.pack_documents(docs, JSON).collect(), expected, 2048)
    assert used <= -(-sum(map(len, expected.values())) // 2048) + 1
    assert packing.pack_documents(repeated, JSON).select("doc_id").count() > packing.pack_documents(docs, JSON).count()
    assert packing.pack_documents(empty, JSON).count() == 0


def test_local_search_empties_bins():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]  # 30 in bins of 10
    poor = [[0], [1], [2], [3, 4], [5, 6], [7]]
    better, steps = packing.local_search([list(b) for b in poor], lengths, 10)
    assert steps > 0
    assert len(better) == 3
    assert sorted(i for b in better for i in b) == list(range(8))
    assert all(sum(lengths[i] for i in b) <= 10 for b in better)


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1500, 3000).tolist()
    bins = packing.pack_lengths(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sum(lengths[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= -(-sum(lengths) // 2048) * 1.005 + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_search_reaches_the_bound(sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()
    sizes = [len(i) + 1 for i in library_ids(JSON, [t or "" for t in texts])]
    lengths = [n % 2048 for n in sizes if n % 2048] + [2048] * sum(n // 2048 for n in sizes)
    start = packing.fitted(sorted(range(len(lengths)), key=lambda i: 2 * lengths[i] <= 2048), lengths, 2048)
    bound, found = packing.least_bins(lengths, 2048), packing.pack_lengths(lengths, 2048)
    assert len(start) > bound and len(found) == bound
    assert sorted(i for b in found for i in b) == list(range(len(lengths)))
    assert max(sum(lengths[i] for i in b) for b in found) <= 2048


def test_exchanges_keep_the_tables_of_the_bins():
    own = np.random.default_rng(12)
    for _ in range(60):
        lengths = own.integers(1, 100, 60).tolist()
        bins = packing.best_fit(lengths, 128)
        found, _ = packing.local_search([list(b) for b in bins], lengths, 128)
        assert sorted(i for b in found for i in b) == list(range(60)) and len(found) <= len(bins)
        assert all(sum(lengths[i] for i in b) <= 128 for b in found)
        state = packing.Takers([list(b) for b in bins], lengths, 128)
        for k in range(len(bins)):
            state.enter(k)
        for giver in range(len(bins)):
            state.leave(giver)
            while state.sizes[giver] and state.step(giver, True):
                assert all(sorted(lengths[i] for i in items) == sizes for items, sizes in zip(state.items, state.sizes))
                assert all(f == 128 - sum(s) >= 0 for f, s in zip(state.free, state.sizes))
                assert all(state.where[n] == {k for k, s in enumerate(state.sizes) if n in s} for n in range(129))


def test_groups_share_their_last_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 40)
    own = np.random.default_rng(6)
    lengths = own.integers(1, 900, 600).tolist()
    # Rows without an id and alike in all else are dealt evenly too.
    table = [(None, 0, 0, 5, 1)] * 300 + [(k, 0, 0, n, k) for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(table, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    packed = packing.pack_pieces(packing.materialize(pieces, "pieces")).collect()
    assert len(packed) == len(table)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 for b in bins.values())
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [o for o, _ in sorted(b)] == ends[:-1]
    assert len({i >> 32 for i in bins}) > 10
    assert len(bins) <= -(-sum(r.length for r in packed) // 2048) + 24


def test_the_search_packs_what_a_plain_fill_leaves(spark):
    own, emptied = np.random.default_rng(9), []
    for lengths in (own.integers(1, 1500, 2000), own.integers(1, 2049, 2000), np.minimum(2048, 1 + own.exponential(400, 2000)).astype(int)):
        lengths = lengths.tolist()
        plain = packing.best_fit(lengths, 2048)
        better, steps = packing.local_search(plain, lengths, 2048)
        assert steps > 100
        emptied.append(len(plain) - len(better))
        longest_first = packing.best_fit(sorted(lengths, reverse=True), 2048)
        assert packing.least_bins(lengths, 2048) <= len(packing.pack_lengths(lengths, 2048)) <= len(longest_first)
    assert min(emptied) >= 0 and sum(emptied) > 10
    assert packing.least_bins([700] * 9, 2048) == 5 and packing.least_bins([1025] * 4 + [1000] * 4, 2048) == 4


# 5 toxicity


def labelled(spark, n=400):
    from tests.llm.conftest import prose

    bad = ["idiot", "moron", "scumaa", "scumbb", "scumcc"]
    rows, labels = [], []
    for k in range(n):
        text, toxic = prose(60, 1000 + k), k % 3 == 0
        if toxic:
            text = text.replace(" ", f" {bad[k % 5]} ", 1 + k % 6)
        rows.append((k, text))
        labels.append((k, int(k % 5 > 0), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id < 250"))
    assert list(model.thresholds) == sorted(model.thresholds)
    got = by_id(toxicity.score_toxicity(docs, model))
    truth = {r.doc_id: bool(r.toxic) for r in labels.collect()}
    held = [i for i in truth if i >= 250]
    assert sum(got[i].toxic == truth[i] for i in held) >= 0.98 * len(held)
    assert not [i for i in held if got[i].toxic and not truth[i]]
    assert all(0 <= r.severity <= 1 for r in got.values())
    mild, grave = (toxicity._score(model, [t], {})[0][0] for t in ("you idiot", "idiot moron scumaa scumdd idiot"))
    assert mild < grave
    assert toxicity.drop_toxic(docs, model).count() == sum(not r.toxic for r in got.values())


def test_toxicity_of_hard_rows(spark, repeated, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels)
    assert toxicity.score_toxicity(repeated, model).count() == repeated.count()
    assert toxicity.drop_toxic(repeated, model).columns == repeated.columns
    assert toxicity.score_toxicity(empty, model).count() == 0
    none = toxicity.fit_toxicity(empty, labels)
    assert not [r for r in toxicity.score_toxicity(docs, none).collect() if r.toxic]


def test_severity_is_the_expected_grade(spark, rows, docs):
    labelled_docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(labelled_docs, labels)
    got = by_id(toxicity.score_toxicity(docs.union(docs.limit(0)), model))
    for r in rows + [(None, "you idiot moron")]:
        words = set(re.findall(r"\w+", text_of(r).lower()))
        features = {f for w in words for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]}
        total = sum(model.weights.get(f, 0.0) for f in features)
        above = [1 / (1 + np.exp(t - total)) for t in model.thresholds]
        if r[0] is not None:
            g = got[r[0]]
            assert g.severity == pytest.approx(sum(above) / 3) and g.p_toxic == pytest.approx(above[0])
            assert g.toxic == (above[0] >= toxicity.REJECT_AT)
        else:
            assert above[0] > 0.5 and above == sorted(above, reverse=True)


# 6 near duplicates


def brute_classes(texts):
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, w in words.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_classes(rows, docs, repeated, empty):
    truth = brute_classes({r[0]: text_of(r) for r in rows})
    got = by_id(near_dedup.near_classes(docs))
    assert {i: r.class_id for i, r in got.items()} == truth
    sizes = defaultdict(int)
    for c in truth.values():
        sizes[c] += 1
    assert all(r.class_size == sizes[r.class_id] and r.kept == (i == r.class_id) for i, r in got.items())
    assert near_dedup.near_classes(repeated).count() == repeated.count()
    assert near_dedup.drop_near_copies(docs).count() == len(sizes)
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert near_dedup.near_classes(empty).count() == 0


def test_a_chain_of_copies_is_one_class(spark):
    from tests.llm.conftest import near, prose

    texts, t = [], prose(150, 5)
    for k in range(40):
        texts.append(t)
        t = near(t, 11 * k + 3)
    table = {k: x for k, x in enumerate(texts)}
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == brute_classes(table)


def test_texts_that_repeat_passages_differently_are_linked(spark):
    from tests.llm.conftest import VOCAB

    own = np.random.default_rng(8)
    words = lambda n: own.choice(VOCAB, n).tolist()
    table = {}
    for k in range(60):
        passage, rest = words(90), words(260)
        table[2 * k] = " ".join(passage + rest + words(35))
        table[2 * k + 1] = " ".join(passage * 20 + rest + words(35))
    truth = brute_classes(table)
    assert len(set(truth.values())) == 60
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == truth


def pair_at(own, n, common):
    """Two texts of ``n`` words each of which ``common`` in a row are the same."""
    fresh = lambda k: [f"w{x}" for x in own.integers(0, 10**9, k)]
    shared = fresh(common)
    return " ".join(shared + fresh(n - common)), " ".join(shared + fresh(n - common))


def test_near_classes_lose_no_link_near_the_threshold(spark):
    own, table = np.random.default_rng(12), {}
    for k in range(150):
        # Of 204 words, 200 shingles; a common run of c words has c - 4 shingles, so the Jaccard is (c-4)/(404-c).
        table[2 * k], table[2 * k + 1] = pair_at(own, 204, 178 + k % 8)
    truth = brute_classes(table)
    linked = {i for i in table if i % 2 and truth[i] == i - 1}
    assert 60 <= len(linked) < 100
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    assert all(got[i] == truth[i] for i in table if i not in linked)
    assert sum(got[i] == truth[i] for i in linked) >= 0.97 * len(linked)


def test_texts_around_one_passage_are_settled_exactly(spark, monkeypatch):
    """Many texts that share a passage fill buckets without being copies; some of them are linked to one another."""
    own = np.random.default_rng(13)
    fresh = lambda k: [f"w{x}" for x in own.integers(0, 10**9, k)]
    passage, rows = fresh(120), []
    for k in range(90):
        tail = fresh(60)
        rows.append(passage + tail)
        if k % 3 == 0:
            rows.append(passage + tail[:-3] + fresh(3))
        if k % 9 == 0:
            rows += [passage + tail[:-j] + fresh(j) for j in (8, 20, 30)]
    table = {k: " ".join(r) for k, r in enumerate(rows)}
    truth = brute_classes(table)
    assert 90 <= len(set(truth.values())) < len(rows)
    seen = []
    real = near_dedup.prefix_links
    monkeypatch.setattr(near_dedup, "prefix_links", lambda *a: seen.append(real(*a)) or seen[-1])
    monkeypatch.setattr(near_dedup, "LEAST_PART", 4)
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == truth
    assert seen


def test_prefixes_link_every_pair_of_classes(spark):
    """The exact way alone: from single texts, and from classes whose members reach each other where their labels do not."""
    own = np.random.default_rng(14)
    sets = {}
    core = own.integers(0, 2**62, 300)
    for k in range(40):
        keep = core[own.random(300) < 0.93]
        sets[k] = np.unique(np.concatenate([keep, own.integers(0, 2**62, int(own.integers(0, 25)))]))
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    name = lambda k: k.to_bytes(2, "big")
    held = spark.createDataFrame([(name(k), [int(x) for x in s]) for k, s in sets.items()], "node binary, shingles array<long>")
    for label in (lambda k: k, lambda k: k // 4 * 4):
        nodes = spark.createDataFrame([(name(k), len(s), name(label(k))) for k, s in sets.items()], "node binary, n long, label binary")
        found = near_dedup.prefix_links(nodes, held, 0.8).collect()
        truth = {tuple(sorted((label(a), label(b)))) for a in sets for b in sets if a < b and label(a) != label(b) and jaccard(a, b) >= 0.8}
        links = {tuple(sorted(int.from_bytes(bytes(x), "big") for x in (r.a, r.b))) for r in found}
        assert 0 < len(truth) and links == truth


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    keep_a, keep_b = slice(0, 240), slice(60, 300)
    x = near_dedup.prob_minhash(a[keep_a], wa[keep_a], np.zeros(240), 1, 6000)[0]
    y = near_dedup.prob_minhash(a[keep_b], wb[keep_b], np.zeros(240), 1, 6000)[0]
    p, q = np.zeros(300), np.zeros(300)
    p[keep_a], q[keep_b] = wa[keep_a], wb[keep_b]
    exact = 0.0
    for d in range(60, 240):
        exact += 1 / np.maximum(p / p[d], q / q[d]).sum()
    assert abs((x == y).mean() - exact) < 0.03


# 7 licences


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    starts, labels = [], set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        p = phrase.split()
        for j in range(len(words) - len(p) + 1):
            if words[j : j + len(p)] == p:
                starts.append(j)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licences(rows, docs, repeated, empty):
    got = by_id(licenses.scan_licenses(docs))
    for r in rows:
        g = got[r[0]]
        assert g[1:6] == brute_licences(text_of(r))
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
        assert 0 <= g.score <= 1
    assert licenses.scan_licenses(repeated).count() == repeated.count()
    assert licenses.scan_licenses(empty).count() == 0


def test_licence_expressions():
    post, well, _ = licenses.parse_expression("(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0 rest")
    assert well and post == ["mit", "apache-2.0", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"]
    assert licenses.evaluate(post) == ({"mit", "apache", "gpl"}, True, False)
    assert licenses.evaluate(licenses.parse_expression("gpl-3.0 or mit")[0]) == ({"gpl", "mit"}, True, True)
    assert licenses.evaluate(["see"]) == (set(), False, False)
    assert licenses.parse_expression("mit or")[1] is False
    assert licenses.parse_expression("(mit")[1] is False
    assert licenses.parse_expression("") == ([], False, 0)


def test_identifiers_are_exact_and_tags_are_found_as_words():
    scan = lambda t: licenses.scan(t)[5:8]
    for unknown in ("gpl-nonsense-string", "apache-helicopter", "mit-licensed", "apache", "gpl-9.0", "classpath-exception-2.0"):
        assert scan(f"SPDX-License-Identifier: {unknown}") == ("", 0.0, None), unknown
    assert scan("x\n// spdx-license-identifier:GPL-2.0-or-later WITH Classpath-exception-2.0 */") == ("gpl", 1.0, False)
    assert scan("SPDX-License-Identifier: GPL-2.0 WITH made-up-exception")[1] < 1
    assert scan("SPDX-License-Identifier: MIT WITH ISC")[1] < 1
    assert scan("SPDX License Identifier: MIT") == ("", 0.0, None)
    assert scan("SPDX-License-Identifier MIT") == ("", 0.0, None)
    assert scan("a SPDX-License-Identifier: MIT b SPDX-License-Identifier: BSD-3-Clause")[0] == "bsd,mit"
    assert scan("é SPDX-License-Identifier: CC-BY-NC-4.0\nSPDX-License-Identifier: CC-BY-4.0") == ("cc-by,cc-by-nc", 1.0, False)


def brute_permissive(node):
    kind, *parts = node
    if kind == "with":
        return brute_permissive(parts[0])
    return parts[0] in ("mit", "isc") if kind == "id" else (any if kind == "or" else all)(map(brute_permissive, parts))


def test_expressions_against_their_trees():
    own = np.random.default_rng(2)

    def tree(depth):
        if depth == 0 or own.random() < 0.2:
            return ("id", str(own.choice(["mit", "isc", "gpl-3.0", "mpl-2.0"])))
        kind = str(own.choice(["or", "and", "with"]))
        return (kind, tree(0), ("id", "some-exception")) if kind == "with" else (kind, tree(depth - 1), tree(depth - 1))

    def written(node):
        return node[1] if node[0] == "id" else f"({written(node[1])} {node[0]} {written(node[2])})"

    for _ in range(200):
        node = tree(5)
        post, well, size = licenses.parse_expression(written(node))
        assert well and size == len(written(node))
        assert licenses.evaluate(post)[2] == brute_permissive(node)


def test_long_expressions_take_linear_time():
    text = "SPDX-License-Identifier: " + " AND ".join(["(MIT OR Apache-2.0)"] * 1000) + "\n"
    got = licenses.scan(text + "SPDX-License-Identifier: " + "(" * 5000 + "ISC" + ")" * 5000)
    assert got[5] == "apache,isc,mit" and got[6] == 1.0 and got[7] is True
    unknown = licenses.scan("SPDX-License-Identifier: see file")
    assert unknown[5] == "" and unknown[6] < 1 and unknown[7] is None
    many = licenses.scan("SPDX-License-Identifier: MIT\n" * 100_000)
    assert many[5] == "mit" and len(many[8]) == 100_000


# 8 token files

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_token_files(spark, rows, docs, repeated, empty, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, WORDS, 2)
    got = by_id(token_files.file_facts(spark, path))
    order = sorted(rows)
    at = 0
    for r, ids in zip(order, library_ids(WORDS, [text_of(r) for r in order])):
        ids = [*ids, 2]
        assert got[r[0]][:] == (r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = token_files.read_tokens(spark, path).where(f"doc_id = {order[3][0]}")
    assert one.count() == 1
    for name, table in (("r", repeated), ("e", empty)):
        token_files.write_tokens(table, str(tmp_path / name), WORDS, 2)
        facts = token_files.file_facts(spark, str(tmp_path / name)).collect()
        assert len(facts) == table.count()
        assert sorted(f.start for f in facts)[:1] in ([], [0])


def test_files_have_bloom_filters_and_are_pruned(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id * 2 as doc_id", "concat('text ', id) as text")
    token_files.write_tokens(docs, str(tmp_path / "t"), WORDS, 2)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = sorted((tmp_path / "t").glob("*.orc"))
    kinds, rows = set(), 0
    for path in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == token_files.INDEX_ROWS
        lines = reader.rows()
        for stripe in reader.getStripes():
            kinds |= {str(x.getKind()) for x in lines.readStripeFooter(stripe).getStreamsList()}
        lines.close()
    assert rows == 3000 and {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    one = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 2000")
    assert "EqualTo(doc_id,2000)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 2001").count() == 0


def test_rows_without_an_id_fill_several_files(spark, tmp_path):
    docs = spark.range(400).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text").union(spark.range(400).selectExpr("7L", "'same'"))
    token_files.write_tokens(docs, str(tmp_path / "t"), WORDS, 2)
    facts = token_files.file_facts(spark, str(tmp_path / "t")).collect()
    ends = sorted((f.start, f.start + f.n_tokens) for f in facts)
    assert len(facts) == 800 and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert max(f.start for f in facts if f.doc_id is None) < min(f.start for f in facts if f.doc_id == 7)
    import pyarrow.orc as orc

    assert sum(orc.ORCFile(str(p)).nrows > 0 for p in (tmp_path / "t").glob("*.orc")) >= 3


# 9 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email"
            ok |= kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
            ok |= kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
            ok |= kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(rows, docs, repeated, empty):
    got = by_id(pii.pii_report(docs))
    some = 0
    for r in rows:
        spans, g = brute_spans(text_of(r)), got[r[0]]
        some += len(spans)
        assert g.base_sha256 == sha(",".join(spans).encode()), text_of(r)[:80]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        assert set(spans) <= set(g.spans.split(","))
    assert some >= 10
    assert pii.pii_report(repeated).count() == repeated.count()
    assert pii.pii_report(empty).count() == 0


def test_masks_hide_all_base_spans(rows, docs, repeated):
    got = by_id(pii.mask_documents(docs))
    for r in rows:
        masked = got[r[0]].text
        if not brute_spans(text_of(r)):
            continue
        assert not [s for s in brute_spans(masked) if not s.startswith("card")]
    assert got[rows[0][0]].text is None
    assert pii.mask_documents(repeated).columns == repeated.columns
    assert pii.mask_documents(repeated).count() == repeated.count()


def test_long_runs_of_characters_take_no_stack(spark):
    texts = ["1" * 60000, "a" * 60000, "1-" * 30000, "a.b" * 20000, "+1" + "0 " * 30000, "@" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(pii.pii_report(docs))
    assert all(got[k].base_sha256 == sha(",".join(brute_spans(t) if k in (0, 2, 4) else []).encode()) for k, t in enumerate(texts))


def test_many_spans_take_near_linear_time(spark):
    import time

    part = "mail a{0}@b{0}.org from 10.0.{1}.7 or +1 603 555 {2:04d}; "
    text = "é😀 " + "".join(part.format(k, k % 256, k % 10000) for k in range(7000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    began = time.time()
    got, masked = by_id(pii.pii_report(docs)), by_id(pii.mask_documents(docs))
    assert time.time() - began < 60
    spans = brute_spans(text)
    assert got[1].n_email == got[1].n_phone == got[1].n_ip == 7000 and got[1].base_sha256 == sha(",".join(spans).encode())
    cut, at = [], 0
    for a, b, kind in sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in got[1].spans.split(",")):
        if a >= at:
            cut.append(text[at:a] + f"[{kind.upper()}]")
        at = max(at, b)
    assert masked[1].text == "".join(cut) + text[at:] and masked[2].text is None


def test_reliabilities_follow_agreement():
    model = pii.fit_spans([(0, (1, 1, 1, 1), 500), (0, (-1, 0, 0, 1), 400), (0, (1, 0, 1, 1), 100), (0, (-1, 0, -1, 1), 100)])
    assert model.reliability["strict"] >= model.reliability["alone"]
    assert model.probability(0, (1, 0, 0, 1)) > 0.5 > model.probability(0, (-1, 0, 0, 1))
    assert pii.fit_spans([]).probability(0, (0, 0, 0, 0)) == 0.5


# 10 quality


def test_quality_learns_from_rows_that_are_not_held_out(spark, repeated, empty):
    from tests.llm.conftest import prose

    rows = [(k, prose(150, k) if k % 2 else prose(150, k).upper().replace(" ", "!! ")) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    got = by_id(quality.score_quality(docs, model))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(300))
    held = [k for k in range(300) if got[k].held_out]
    assert sum(got[k].predicted == k % 2 for k in held) >= 0.98 * len(held)
    flipped = labels.select("doc_id", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    again = by_id(quality.score_quality(docs, quality.fit_quality(docs, flipped)))
    assert all(abs(got[k].score - again[k].score) < 1e-9 for k in range(300))
    scored = quality.score_quality(repeated, model).collect()
    assert len(scored) == repeated.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit_quality(empty, labels).score([quality.bag_of("x")])[0] == 0.5


def test_scores_are_the_attention_weighted_passages(spark, rows, docs):
    from tests.llm.conftest import prose

    table = [(k, prose(400, k) if k % 2 else prose(400, k).upper()) for k in range(60)]
    train = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(train, labels)
    got = by_id(quality.score_quality(docs, model))
    p = model.p
    for r in rows:
        words = text_of(r).split()
        before, hidden, raw = set(), [], []
        for at in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
            own = words[at : at + quality.PASSAGE_WORDS]
            z = (np.array(quality.describe(own, before)) - model.mean) / model.scale
            before |= set(own)
            h = np.tanh(z @ p["E"] + p["e"])
            hidden.append(h)
            raw.append(np.exp(np.clip((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"], -20, 20)))
        pooled = sum(a * h for a, h in zip(raw, hidden)) / sum(raw)
        assert got[r[0]].score == pytest.approx(float((1 / (1 + np.exp(-(pooled @ p["c"] + p["b"]))))[0]), abs=1e-6)
        assert got[r[0]].predicted == int(got[r[0]].score >= 0.5)


# the pipeline


def test_the_pipeline_keeps_what_its_stages_keep(spark, rows, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    more = spark.createDataFrame([(1000 + r[0], r[1]) for r in rows], "doc_id long, text string")
    docs = docs.union(more).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    now = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit_toxicity(docs, labels)
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, model).collect() if r.toxic}
    assert {r.doc_id for r in labels.where("toxic = 1").collect()} <= toxic
    now = {i: t for i, t in now.items() if i not in toxic}
    best = {}
    for i, t in now.items():
        best[ascii_lower(t)] = max(i, best.get(ascii_lower(t), i))
    now = {i: now[i] for i in best.values()}
    now = {i: now[i] for i, c in brute_classes(now).items() if i == c}
    kept = spark.createDataFrame(list(now.items()), "doc_id long, text string")
    masked = {r.doc_id: r.text for r in pii.mask_documents(kept).collect()}
    ids = library_ids(JSON, [masked[i] for i in masked])
    check_packing(out, {i: [*x, 0] for i, x in zip(masked, ids)}, 2048)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]


# 11 periodic runs


def brute_runs(words):
    """Every stretch of every period, the smallest period of a stretch first."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        start = None
        for k in range(len(words) - q + 1):
            same = k < len(words) - q and words[k] == words[k + q]
            if same and start is None:
                start = k
            if not same and start is not None:
                if k - start + q >= max(6, 4 * q):
                    found.setdefault((start, k - start + q), q)
                start = None
    return sorted((s, n, q) for (s, n), q in found.items())


def without_repeats(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_runs_of_random_texts():
    import random

    own = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(own.randint(1, 5)):
            letters, words = "abcdef"[: own.choice([1, 2, 2, 3, 5])], []
            while len(words) < own.randint(0, 110):
                words += [own.choice(letters) for _ in range(own.randint(1, 9))] * own.randint(1, 7)
            texts.append(words)
        for words, (n, runs, kept) in zip(texts, periodic_runs.found_in([" ".join(w) for w in texts])):
            assert (n, runs, kept) == (len(words), brute_runs(words), without_repeats(words, runs))


def test_runs_of_many_copies_are_found_in_little_time():
    # Each place has another left-word class, or all of them the same.
    apart = [w for k in range(20_000) for w in (f"item{k}", "is", "in", "stock", "at", "our", "store")]
    (_, none, kept), (_, one, _), (_, seven, _) = periodic_runs.found_in([" ".join(apart), "x " * 100_000, "a b c d e f g " * 20_000])
    assert none == [] and kept == " ".join(apart)
    assert one == [(0, 100_000, 1)] and seven == [(0, 140_000, 7)]


def test_run_report(spark, rows, docs, repeated, empty):
    more = [(k, " ".join(f"w{j * k % 41}" for j in range(k % 90))) for k in range(5000, 5300)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got, planted = by_id(periodic_runs.run_report(both)), 0
    for i, text in [(r[0], text_of(r)) for r in rows] + more:
        words = split_words(text)
        if len(words) > 2000:
            continue
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            a, planted = h // 10 % n, planted + 1
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        assert got[i][:6] == (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
        assert got[i].runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode())
        assert got[i].collapsed_sha256 == sha(without_repeats(words, runs).encode())
    assert planted > 20
    assert periodic_runs.run_report(repeated).count() == repeated.count()
    assert periodic_runs.run_report(empty).count() == 0
    report = by_id(periodic_runs.periodic_runs(docs))
    assert report[rows[0][0]][1:] == (0, [], "")


# 12 url filters


def url_fixture():
    urls = [f"http://a{k % 3}.example.{t}/{lang}/{k}?x=1" for k in range(40) for t in ("net", "com", "org") for lang in ("en", "fr", "de")]
    odd = [None, "", "no scheme", "://", "x://HOST", "http://net", "http://NET/", "http://xnet/a", "a://b.org/fr/?q", "a://org/fr", "a://b://c.net/d", "http://h.net?x/y", "http://u@h.com:80/de/#f"]
    return [*enumerate(urls + odd + urls[:50]), (None, "http://q.net/"), (7, None)]


def brute_judgement(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for r in url_filters.BASE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def brute_tokens(host, path, url):
    fold = lambda x: re.sub("[0-9]+", "#", x)
    asked = re.match(r"[^#]*?\?([^#]*)", url or "")
    out = {f"{k}:{fold(x)}" for k, x in enumerate(reversed(host.split("."))) if x}
    out |= {"/" + fold(x) for x in ascii_lower(path).split("/") if x}
    return frozenset(out | {"?" + fold(x.split("=")[0]) for x in (asked[1].split("&") if host and asked else []) if x.split("=")[0]})


def brute_rules(pages, support=url_filters.SUPPORT, confidence=url_filters.CONFIDENCE):
    """Of all sets of up to four tokens the least that support, confidence and two stated rules bear out."""
    from itertools import combinations

    seen = [(brute_tokens(h, p, u), r) for u in pages for h, p, r in [brute_judgement(u)] if r]
    counts = defaultdict(lambda: [0, 0, set()])
    for tokens, rule in seen:
        for size in range(1, 5):
            for c in combinations(sorted(tokens), size):
                n = counts[c]
                n[0] += 1
                if rule.verdict == "block":
                    n[1] += 1
                    n[2].add(rule.name)
    good = {frozenset(c) for c, (n, b, s) in counts.items() if b >= support * len(seen) and b >= confidence * n and len(s) >= 2}
    return {c for c in good if not any(o < c for o in good)}


def test_urls_are_judged_as_by_brute_force(spark):
    table = url_fixture()
    pages = spark.createDataFrame([(*r, "x", 1) for r in table], "page_id long, url string, verdict string, rows int").repartition(3)
    got = url_filters.judge_urls(pages).collect()
    rules = brute_rules([u for _, u in table])
    expected, mined = [], 0
    for i, url in table:
        host, path, rule = brute_judgement(url)
        hit = rule is None and any(r <= brute_tokens(host, path, url) for r in rules)
        mined += hit
        expected.append((i, host, path, rule and rule.name, rule.verdict if rule else "block" if hit else "allow"))
    assert frozenset(["/de"]) in rules and 0 < mined < len(table) / 3
    key = lambda r: tuple(map(str, r))
    assert sorted([r[:5] for r in got], key=key) == sorted(expected, key=key)
    assert all((r.matched is not None) == (r.rule is None and r.verdict == "block") for r in got)


def test_urls_of_no_pages_and_without_labels(spark):
    kind = "page_id long, url string"
    assert url_filters.judge_urls(spark.createDataFrame([], kind)).count() == 0
    plain = spark.createDataFrame([(1, "http://a.info/x"), (2, None)], kind)
    assert {r[3:5] for r in url_filters.judge_urls(plain).collect()} == {(None, "allow")}


def test_rare_and_unsure_rules_are_pruned(spark):
    table = [(["/a", "/b"], "r1", "block", 5), (["/a"], "r2", "block", 5), (["/b"], "r1", "allow", 5), (["/c"], "r1", "block", 9)]
    labelled = spark.createDataFrame(table, "profile array<string>, rule string, verdict string, rows long")
    candidates = spark.createDataFrame([(x,) for x in (["/a"], ["/b"], ["/c"], ["/a", "/b"])], "tokens array<string>")
    kept = url_filters.pruned_rules(candidates, labelled).collect()
    assert [(r.tokens, r.confidence, round(r.support, 3)) for r in kept] == [(["/a"], 1.0, 0.417)]


# 13 vector codes


def brute_codes(table):
    """Codes by the contract, in Python's integers."""
    import math

    good = [(i, [math.floor(4096 * x) for x in v], y) for i, v, y in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=1) // 8) * 8
    good = [(i, v + [0] * (width - len(v)), y) for i, v, y in good]
    cut = lambda v: [v[k : k + width // 8] for k in range(0, width, width // 8)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0]))[:16]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(8)]

    def nearest(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(6):
        own = defaultdict(list)
        for _, v, _ in good:
            for p, (_, k) in enumerate(nearest(v)):
                own[p, k].append(cut(v)[p])
        for (p, k), parts in own.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    found = [(i, nearest(v), y) for i, v, y in good]
    error = lambda n: sum(d for d, _ in n)
    labels = defaultdict(int)
    for _, n, y in found:
        labels[y] += error(n)
    digest = sha(",".join(str(c) for b in books for e in b for c in e).encode())
    return [(i, "".join(f"{k:02x}" for _, k in n), error(n), min(labels[y], 2**63 - 1), digest) for i, n, y in found]


def check_codes(spark, table):
    kind = "vec_id long, embedding array<double>, label int, code string, rows int"
    got = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in table], kind).repartition(3)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_codes(table), key=key)
    return got


def test_vector_codes(spark):
    own = np.random.default_rng(8)
    table = [(k * 13 % 1009, own.normal(0, 0.3, 32).tolist(), int(own.integers(0, 3))) for k in range(300)]
    bad = [(2000, None, 1), (2001, [float("nan")] * 32, 1), (2002, [None] * 32, 1), (2003, [float("inf")] * 32, 2), (-5, [0.0] * 31 + [None], 2)]
    same = [(3000 + k, table[5][1], None) for k in range(200)]
    assert len(check_codes(spark, table + bad + same + [(4000, [0.25] * 32, None)])) == 501


def test_vector_codes_of_odd_tables(spark):
    own = np.random.default_rng(9)
    few = [(k, own.normal(0, 1, 8).tolist(), None) for k in range(3)]
    check_codes(spark, few)
    check_codes(spark, [*few, (9, [0.5] * 5, 1), (10, [], 1), (11, [-3.25] * 19, 2)])
    # Beyond 64 bits in the differences, and negative floors.
    check_codes(spark, [(k, [float(x) for x in own.integers(-3, 4, 16) * 200_000.3], 0) for k in range(40)])
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1)], "vec_id int, embedding array<float>, label int")).count() == 0


def test_decoded_vectors_are_near(spark):
    own = np.random.default_rng(10)
    vectors = own.normal(0, 0.2, (40, 16))
    rows = vector_codes.usable(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int"))
    blocks = vector_codes.materialize(vector_codes.dictionary_blocks(rows, 16), "blocks")
    books = vector_codes.fit_books(blocks, vector_codes.first_books(rows, 16))
    for r in vector_codes.assign_codes(blocks, books).collect():
        apart = ((vector_codes.decode_vector(r.code, books) - np.floor(vectors[r.vec_id] * 4096) / 4096) ** 2).sum()
        assert apart == pytest.approx(r.error / 4096**2)
