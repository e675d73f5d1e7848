"""Suffix dedup, centroid clustering and hard negatives against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexspan.llm import centroids, hard_negatives, suffix_dedup, vectors


def cut_by_hand(texts, length):
    """n_bytes, n_removed, n_spans, kept_sha256 of every text, from all windows of all texts."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def some_texts(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, short, odd = prose(60), prose(20), "día ñandú " * 4 + prose(40)
    texts = [prose(rng.randint(0, 150)) + rng.choice([passage, passage[:210], short, odd, ""]) + prose(rng.randint(0, 60)) for _ in range(60)]
    near = [texts[0][:k] + "!" + texts[0][k + 1 :] for k in range(0, len(texts[0]), 97)]
    return [*texts, *near, texts[5], texts[5], texts[5], None, None, "", passage, passage[:199], passage[:200], "a" * 700, "a" * 199, "xy" * 300, odd]


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats(spark, group):
    texts = some_texts(random.Random(3))
    docs = spark.createDataFrame([(i // 2, t, "x", -1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, id int")  # keys twice, clashing columns
    found = suffix_dedup.remove_repeats(docs, group=group)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(cut_by_hand(texts, 200))


def test_repeats_in_parts(monkeypatch):
    """A very long text goes in parts; its anchors are those of the whole."""
    import pyarrow as pa

    from lexspan.llm.blocks import TextBlock

    text = "".join(random.Random(4).choice("ab c") for _ in range(9000)) + "a" * 900
    block = TextBlock(pa.array([text]))
    _, whole, hashes = suffix_dedup.anchors(block.data, block.starts)
    monkeypatch.setattr(suffix_dedup, "PART", 700)
    told = []
    for data, starts, _, begin, before, after in suffix_dedup.parts(block, 200):
        _, places, own = suffix_dedup.anchors(data[before : len(data) - after], np.array([0, len(data) - before - after]))
        told += [(int(p) + before + begin, int(h)) for p, h in zip(places, own)]
    assert sorted(set(told)) == list(zip(whole.tolist(), hashes.tolist()))


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(6000))
    texts = [long, long[2000:2600], "x" * 250 + long[100:320]]
    whole = sorted(cut_by_hand(texts, 200))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.anchor_table(suffix_dedup.distinct_texts(spark, docs, "text")[0]).collect()
    assert len(rows) == len({(r["id"], r["place"]) for r in rows})
    assert sorted(tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs).collect()) == whole


def test_repeats_keep(spark):
    docs = spark.createDataFrame([("k", "q" * 50 + "0123456789" * 30), ("l", "0123456789" * 30 + "z"), (None, None)], "`the.key` string, text string")
    found = {r["the.key"]: r for r in suffix_dedup.remove_repeats(docs, keep=True, key="the.key").collect()}
    assert bytes(found["k"]["kept"]) == b"q" * 50 and found["k"]["spans"] == [[50, 350]]
    assert bytes(found["l"]["kept"]) == b"z" and found[None]["n_bytes"] == 0
    assert suffix_dedup.remove_repeats(docs.limit(0), key="the.key").count() == 0


def test_reaches():
    """Both orders and the windows they leave open, against all pairs."""
    rng = random.Random(5)
    for turn in range(300):
        n, length, letters = rng.randint(1, 14), rng.choice([6, 8, 10]), b"ab" if turn % 2 else b"abc"
        lefts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, length - 2))) for _ in range(n)]
        rights = [bytes(rng.choice(letters) for _ in range(rng.randint(0, length))) for _ in range(n)]
        groups = np.sort(np.array([rng.randint(0, 2) for _ in range(n)]))
        wanted = []
        for i in range(n):
            pairs = [(suffix_dedup._common(lefts[i][::-1], lefts[j][::-1]), suffix_dedup._common(rights[i], rights[j])) for j in range(n) if i != j and groups[i] == groups[j]]
            good = [p for p in pairs if sum(p) >= length]
            wanted.append((max((p[0] for p in good), default=-1), max((p[1] for p in good), default=-1)))
        back, on = suffix_dedup.reaches(lefts, rights, groups, length)
        assert list(zip(back.tolist(), on.tolist())) == wanted


def test_suffix_sort_with_colliding_hashes(monkeypatch):
    """Where hashes say that different bytes are equal the bytes decide."""
    monkeypatch.setattr(suffix_dedup, "_KEYS", np.ones(256, np.uint64))
    rng = random.Random(6)
    rows = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    sizes = np.array([len(r) for r in rows])
    strings = suffix_dedup.Strings(np.frombuffer(b"".join(rows), np.uint8), np.cumsum(sizes) - sizes, sizes)
    order, shared = suffix_dedup.suffix_sort(strings, np.zeros(40, np.int64))
    told = [rows[i] for i in order]
    assert told == sorted(rows)
    assert shared.tolist() == [0] + [suffix_dedup._common(a, b) for a, b in zip(told, told[1:])]


# Vectors --------------------------------------------------------------------


def odd_vectors(rng, n, d=64):
    """Rows of (vec_id, embedding, label) with nulls, repeats and lengths that take no part."""
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(d)], rng.randint(0, 3)) for i in range(n)]
    rows += [(rows[3][0], rows[3][1], rows[3][2])] * 3 + [(n + 1, None, 1), (n + 2, [0.5] * (d - 1), 1), (n + 3, [None] + [0.1] * (d - 1), 2), (n + 4, [float("nan")] + [0.1] * (d - 1), 2), (n + 5, [float("-inf")] * d, 0), (n + 6, [], 0), (n + 7, rows[5][1], None), (n + 8, rows[5][1], 3)]
    rng.shuffle(rows)
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters_by_hand(rows, k, rounds, d, factor):
    kept = [(i, np.floor(factor * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if v is not None and len(v) == d and None not in v and np.isfinite(v).all()]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes()))[:k]
    centers = [c.copy() for _, c in first]
    for r in range(rounds + 1):
        told = [(i, *min((int(((x - c) ** 2).sum()), j) for j, c in enumerate(centers))) for i, x in kept]
        if r < rounds:
            for j in range(len(centers)):
                own = [x for (_, x), (_, _, c) in zip(kept, told) if c == j]
                if own:
                    centers[j] = np.array([sum(int(x[t]) for x in own) // len(own) for t in range(d)])
    return sorted((i, c, s) for i, s, c in told), centers


def test_clusters(spark):
    rng = random.Random(8)
    for d, k in ((64, 7), (5, 40), (12, 3)):
        rows = odd_vectors(rng, 90, d)
        frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cluster string").repartition(3)
        found, final = centroids.cluster_vectors(frame, k=k, dimensions=d)
        wanted, centers = clusters_by_hand(rows, k, 3, d, 64)
        told = found.collect()
        assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in told) == wanted
        assert np.array_equal(final, np.array(centers))
        sums = Counter()
        for _, c, s in wanted:
            sums[c] += s
        assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values()) for r in told)


def test_clusters_of_few(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found, final = centroids.cluster_vectors(empty)
    assert found.count() == 0 and len(final) == 0
    same = spark.createDataFrame([(i, [0.5] * 64, 0) for i in (1, 1, None)], SCHEMA)
    found, final = centroids.cluster_vectors(same)
    assert [r["cluster"] for r in found.collect()] == [0, 0, 0] and len(final) == 3
    with pytest.raises(Exception, match="component"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64, 0)], SCHEMA))


def test_screening_bounds():
    """Bounds never exceed the distance, and most centroids need none exact."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-200, 200, (16, 64))
    x = centers[rng.integers(0, 16, 500)] + rng.integers(-9, 10, (500, 64))
    bounds = centroids.lower_bounds(centroids.segment_norms(x), centroids.segment_norms(centers))
    exact = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (bounds <= exact).all()
    cluster, best, taken = centroids.nearest(x, centroids.segment_norms(x), centers)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert taken < 500 * 4


def negatives_by_hand(rows, anchor, positives=5, negatives=10):
    kept = [(i, lab, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for n, (i, lab, x) in enumerate(kept):
        if not anchor(i):
            continue
        scores = [(-int(x @ y), j, other == lab) for m, (j, other, y) in enumerate(kept) if m != n and len(y) == len(x)]
        for ps, pid, _ in sorted(s for s in scores if s[2])[:positives]:
            good = sorted((s, j) for s, j, same in scores if not same and 30 * -ps <= 100 * -s <= 90 * -ps)[:negatives]
            out += [(i, pid, r + 1, j, -ps, -s) for r, (s, j) in enumerate(good)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    for d, size in ((64, 8192), (70, 5), (3, 8192)):
        monkeypatch.setattr(hard_negatives, "ANCHORS", size)  # small blocks of anchors: several scans
        rows = odd_vectors(rng, 150, d)
        rows += [(None, rows[0][1], 1)]
        frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", uid int").repartition(3)
        found = hard_negatives.hard_negatives(frame, F.col("key") % 10 == 0)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in found.collect()) == negatives_by_hand(rows, lambda i: i % 10 == 0)
    none = hard_negatives.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("key") % 10 == 0)
    assert none.count() == 0


def test_bit_sliced_products():
    """Every pair that is not ruled out has its exact product; pruning leaves planes out."""
    rng = np.random.default_rng(1)
    x, q = rng.integers(-300, 300, (200, 70)), rng.integers(-300, 300, (30, 70))
    anchors = hard_negatives.Anchors(q, 9)
    exact = x @ q.T
    floor = np.sort(exact, axis=0)[-3]
    r, c, s, summed = hard_negatives.qualifying(x, anchors, np.ones(exact.shape, bool), lambda low, high, n: high >= floor[n])
    assert (s == exact[r, c]).all()
    assert set(zip(r.tolist(), c.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(exact >= floor))))
    assert summed < exact.size * 10


def test_kept_vectors():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [], [None, 1.0], [float("inf"), 0.0], [1.0]], pa.list_(pa.float32()))
    assert vectors.kept_vectors(column).tolist() == [True, False, False, False, False, True]
    assert vectors.kept_vectors(column, 2).tolist() == [True, False, False, False, False, False]
    assert vectors.kept_vectors(column[3:]).tolist() == [False, False, True]


def test_sorted_groups():
    """Keys stay whole wherever batches end."""
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(200):
        keys = sorted(rng.randint(0, 8) for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(keys)) for _ in range(5))
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64())], ["key"]) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        told = [t.column("key").to_pylist() for t in suffix_dedup._sorted_groups(batches, 7)]
        assert sum(told, []) == keys
        assert all(a[-1] != b[0] for a, b in zip(told, told[1:]))
        assert all(len(t) < 7 + max(keys.count(k) for k in set(t)) + 40 for t in told)
