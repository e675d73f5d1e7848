"""Operators that compare rows, learn, or write files."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.llm import jaccard_join, language_id, quality_classifier, warc
from lexspan.llm.blocks import TextBlock
from lexspan.llm.components import components

import pyarrow as pa  # isort: skip


def brute_groups(rows):
    sets = []
    for _, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["The", "THE", "é"]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([0, 2, 3, 5, 30, 60, 120]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
            own += ["tail"] * rng.choice([0, 0, 1, 4])
            rows.append((len(rows), rng.choice([" ", "\n"]).join(own)))
    common = [rng.choice(words) for _ in range(25)]
    rows += [(1000 + i, " ".join(common + [rng.choice(words) for _ in range(rng.randint(2, 12))])) for i in range(20)]
    return rows + [(None, "a b c d e"), (None, "a b c d e"), (5000, "x y z"), (3, None), (None, None)]


def twins(n=11):
    """Two different words that are equal under every polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("seed, parts", [(5, 2), (6, 100_000)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "ARRAY_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(jaccard_join, "PART_ROWS", parts)
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, sig string").repartition(3)
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == brute_groups(rows)
    if seed == 5:
        kept = jaccard_join.one_of_each(docs).collect()
        groups = {(k, c) for k, n, c in brute_groups(rows) if n}
        assert sorted(str(r["doc_id"]) for r in kept if (r["text"] or "").strip()) == sorted(str(c) for c in {c for _, c in groups})
        assert sum(not (r["text"] or "").strip() for r in kept) == sum(not (t or "").strip() for _, t in rows)


def test_words_of_one_polynomial_hash_are_not_linked(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(twins())], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect())) == [(0, 1, 0), (1, 1, 1)]


def test_classes_of_equal_first_halves_are_told_apart(spark, monkeypatch):
    rows = corpus(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    short = jaccard_join.class_id
    monkeypatch.setattr(jaccard_join, "_described", lambda *a: described(*a).withColumn("cid", F.col("cid") % 3))
    monkeypatch.setattr(jaccard_join, "_prefixes", lambda *a: prefixes(*a).withColumn("cid", F.col("cid") % 3))
    monkeypatch.setattr(jaccard_join, "_arrays", lambda docs, wanted, ngram: arrays(docs, wanted.drop("first").join(told, "cid2"), ngram))
    told = spark.createDataFrame([(a, b) for a, b in {short(s) for s in jaccard_join.shingle_sets(TextBlock(pa.array([t for _, t in rows], pa.string()))) if len(s)}], "first long, cid2 long")
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str) == brute_groups(rows)


described, prefixes, arrays = jaccard_join._described, jaccard_join._prefixes, jaccard_join._arrays


def test_near_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 64)
    monkeypatch.setattr(jaccard_join, "ARRAY_ROWS", 32)
    rng = random.Random(3)
    base = [f"u{i}" for i in range(90)]
    rows = []
    for i in range(400):  # one or two words changed: most copies link with few others
        own = list(base)
        for _ in range(rng.choice([1, 2])):
            own[rng.randrange(90)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str) == brute_groups(rows)


@pytest.mark.parametrize("names", [("th", "bits"), ("cid", "n"), ("tile", "key"), ("a b", "text")])
def test_columns_of_any_name(spark, names):
    key, text = names
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "q")], f"`{key}` long, `{text}` string").withColumns({"whole": F.lit(1), "comp": F.lit(2), "its_key": F.lit(3)})
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs, text=text, key=key).collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
    kept = jaccard_join.one_of_each(docs, text=text, key=key)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 3]


def test_likeliest_pairs():
    rng = np.random.default_rng(2)
    for _ in range(50):
        m = rng.integers(1, 12)
        d = np.where(rng.random((m, m)) < 0.4, rng.random((m, m)), np.inf).astype(np.float32)
        d = np.minimum(d, d.T)
        comp = rng.integers(0, m, m)
        possible = {(a, b) for a in range(m) for b in range(a + 1, m) if np.isfinite(d[a, b]) and comp[a] != comp[b]}
        pairs, more = jaccard_join.likeliest(d, comp)
        assert set(pairs) <= possible and len(pairs) < m and more == (len(pairs) < len(possible))
        groups = lambda edges: components_of(m, comp, edges)
        assert groups(pairs) == groups(possible)
        sets = [np.unique(rng.integers(0, 12, 9, dtype=np.uint64)) for _ in range(m)]
        true = {(a, b) for a, b in possible if 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))}
        links = jaccard_join.linked_pairs(d, comp, sets, 60)
        assert set(links) <= true and groups(links) == groups(true)


def components_of(m, comp, edges):
    label = list(comp)
    for a, b in [*edges, *edges]:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(empty).collect() == [] and jaccard_join.one_of_each(empty).collect() == []


def test_bitmaps_never_lose_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, rng.integers(1, len(a) + 1), replace=False), rng.integers(0, 2**64, rng.integers(0, 20), dtype=np.uint64))))
        p, q = (np.frombuffer(jaccard_join.bitmap(x), np.uint8) for x in (a, b))
        size = min(len(p), len(q))
        differing = int(np.bitwise_count(jaccard_join.folded(p, size) ^ jaccard_join.folded(q, size)).sum())
        both = len(np.intersect1d(a, b))
        assert jaccard_join.overlap(a, b) == both
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert jaccard_join.may_link(len(a), len(b), differing)
        assert (len(a) + len(b) - differing) // 2 >= both


@pytest.mark.parametrize("size", [10, 10_000])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr("lexspan.llm.components.TASK_EDGES", size)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (100, 300), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


PAGES = [(1, "http://a/ b", "<p>x"), (2, "http://b", "<p>x"), (3, None, "é😀\r\n\r\nWARC/1.1\r\n"), (4, "u", None), (5, "u", ""), (6, "u", "only"), (6, "u", "only"), (None, "u", "<p>x"), (None, "u", "lone")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, payload_bytes int")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    bodies = [(p or "").encode() for *_, p in PAGES]
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first = {1: None, 2: 1, 3: None, 4: None, 5: 4, 6: None}
    expected = []
    for (k, _, _), b in zip(PAGES, bodies):
        to = first[k] if k is not None else (1 if b == b"<p>x" else None)
        expected.append((k, len(b), digest(b), "revisit" if to is not None else "response", to))
    assert got == sorted(expected, key=str)
    assert warc.round_trip(pages.limit(0)).isEmpty()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_reader_pushes_filters_down(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages.coalesce(1), f"{tmp_path}/w", compression)
    found = warc.read_warc(spark, f"{tmp_path}/w")
    assert found.count() == len(PAGES)
    assert {bytes(r["payload"]).decode() for r in found.where("record_type = 'response' and page_id = '3'").collect()} == {PAGES[2][2]}
    assert found.where("record_type = 'revisit'").where("payload is not null").isEmpty()
    reader = warc.WarcReader({"path": f"{tmp_path}/w", "payload": "none"})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 4)]))
    assert len(left) == 1 and len(reader.tests) == 1
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows and {r["record_type"] for r in rows} == {"revisit"}


LANGUAGES = {"aa": "banana mango papaya ", "bb": "zxcv qwrt plkj mnbv ", "cc": "été où çà naïve "}


def language_rows(n):
    rng = random.Random(9)
    return [(i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(40)), lang) for i in range(n) for lang in [rng.choice(sorted(LANGUAGES))]]


def test_gradients_by_differences():
    net = language_id.Network(3, 4)
    net.p = [p.astype(np.float64) for p in net.p]
    rng = np.random.default_rng(0)
    data, length, label = rng.integers(0, 256, (6, 5)).astype(np.uint8), np.array([6, 3, 5, 1, 6]), np.array([0, 1, 2, 1, 0])

    def loss():
        probs = net.positions(data)
        return -sum(np.log(probs[t, label[w], w]) for w in range(5) for t in range(length[w])) / length.sum()

    for k, g in enumerate(net.gradients(data, length, label)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = net.p[k][at]
        sides = []
        for step in (0.01, -0.01):
            net.p[k][at] = old + step
            sides.append(loss())
        net.p[k][at] = old
        assert abs((sides[0] - sides[1]) / 0.02 - g[at]) < 1e-4


def test_language_of_held_out_rows(spark):
    docs = spark.createDataFrame(language_rows(240), "doc_id long, text string, lang string")
    net, names = language_id.fit(docs, ~language_id.held_out())
    got = {r["doc_id"]: r for r in language_id.predict(docs, net, names).collect()}
    held = [(i, lang) for i, _, lang in language_rows(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and sum(got[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "12 !?"), (3, "banana " * 20_000)], "doc_id long, text string")
    found = sorted(((r["lang_pred"], 0 <= r["score"] <= 1) for r in language_id.predict(odd, net, names).collect()))
    assert found == [("aa", True), ("und", True), ("und", True), ("und", True)]
    assert language_id.fit(docs.limit(0), F.lit(True)) == (None, []) and language_id.predict(odd, None, []).where("lang_pred <> 'und'").isEmpty()


def test_quality_of_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "lease", "binds", "both", "parties."]) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words if good else [w + "$$#" for w in words])))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality_classifier.fit(docs, marked, ~language_id.held_out())
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, net).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.97
    assert {r["doc_id"] for r in quality_classifier.keep_good(docs, net).collect()} == {i for i, s in got.items() if s >= 0.5}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "a " * 50_000)], "doc_id long, text string")
    assert quality_classifier.score(odd, net).where("score between 0 and 1").count() == 3
    assert quality_classifier.fit(docs, marked.limit(0), F.lit(True)) is None and quality_classifier.score(odd, None).where("score = 0.5").count() == 3


def test_passages_cover_whole_texts():
    block = TextBlock(pa.array(["x" * 1000, "", None, "é " * 300]))
    x, firsts = quality_classifier.passages(block)
    assert np.diff(firsts).tolist() == [4, 1, 1, 4] and x.shape[0] == 10


def templated(n, seed, own=7, common=46):
    """Texts of one template with words of their own, so that no two link."""
    rng = random.Random(seed)
    head = " ".join(f"c{i}" for i in range(common))
    return [(i, head + " " + " ".join(f"o{rng.randrange(10**9)}" for _ in range(own))) for i in range(n)]


def test_templated_texts_grow_in_proportion(spark, monkeypatch):
    """What is dealt out for comparison grows with the texts, not with their square."""
    seen, dealt = [], jaccard_join._dealt

    def noted(*args):
        out = dealt(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_dealt", noted)
    counts = []
    for n in (3000, 6000):
        seen.clear()
        rows = templated(n, n)
        found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert found.where("component_id <> doc_id").count() == 0
        counts.append(sum(seen))
    assert counts[1] <= 2.5 * max(counts[0], 3000)


def test_large_tiles_lose_no_link(spark, monkeypatch):
    """Small tiles at once count as large: members leave them, links do not."""
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 2)
    for seed, parts in ((5, 100_000), (6, 4)):
        monkeypatch.setattr(jaccard_join, "PART_ROWS", parts)
        rng = random.Random(seed)
        rows = templated(30, seed, own=4) + templated(10, seed + 1, own=2)
        rows = [(i, t) for i, (_, t) in enumerate(rows)]
        for i, t in rows[:12]:
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((100 + i, " ".join(words)))
            rows.append((200 + i, " ".join(t.split()[: rng.randint(44, 50)])))
        found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((tuple(r) for r in found.collect()), key=str) == brute_groups(rows)
