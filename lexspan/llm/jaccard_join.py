"""N-gram Jaccard join: documents whose sets of word 4-grams overlap by 85 in 100 or more.

1. Every text becomes a sorted array of 64-bit shingle hashes. Texts with the same set are
   one class from here on.
2. All classes agree on one order of shingles (those that very many documents hold last,
   otherwise by hash); two sets that overlap enough must share one of their first
   ``n - ceil(0.85 n) + 1`` shingles in that order. A tile is the classes that share such a
   shingle, cut into bands where the next size is too far to link. Whatever list of frequent
   shingles is used, no link is lost. Tiles of the same members are one tile: near copies
   share dozens of prefix shingles, and equal tiles hold equal pairs. From a tile of many,
   members go for which no other is small enough, if the tile's shingle is the first that
   they share: texts of one template that do not link leave its tiles.
3. In a tile, sizes are checked first; then the bits in which two hashed bitmaps differ (each
   as wide as its size band asks) bound the overlap from above. Of the pairs that are left, a
   tile names a spanning forest of the likeliest, so at most one pair per member; sorted-array
   intersection decides these, and links make components.
4. Tiles in which the bound leaves pairs of different components are looked at once more: a
   member with such a pair, counted in the first tile that the two share only, comes with its
   sorted array, and every pair still apart is intersected in its task. A tile of more than ``TILE_ROWS`` members is dealt in blocks: at first each
   block by itself, then its largest component's blocks against the others' only.

A link within one component need not be looked at, since only components are asked; so a
group of near copies costs about one exact comparison a member, not one a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import LOWER, SPACED, TextBlock, give_back, mix, text_blocks, window_hashes, word_hashes
from lexspan.llm.components import components
from lexspan.session import forget, settled, ship, spill, table

NGRAM, PERCENT = 4, 85
#: Shingles that come last in the order: at most so many, each in at least so many documents.
FREQUENT, FREQUENT_LEAST = 1 << 18, 24
#: Shingles that a task counts at a time; beyond that the rarest leave its summary.
SUMMARY = 1 << 16
#: Classes whose prefixes a task remembers having sent; beyond that some are sent twice, which tiles undo.
REMEMBERED = 1 << 18
#: A frequent shingle's tile is gathered in parts of about so many documents.
PART_ROWS = 100_000
#: Members of a tile that one task compares with as many others, by bitmaps and by sorted arrays.
TILE_ROWS, ARRAY_ROWS = 1024, 512
#: Keys of documents to read again are broadcast up to this many rows; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Rows that a task gathers before it sends them on.
OUT_ROWS = 5_000


def shingle_sets(block: TextBlock, ngram: int = NGRAM) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted; texts of fewer words have one for the whole sequence."""
    lowered = TextBlock.__new__(TextBlock)
    lowered.data, lowered.starts, lowered.n = LOWER[block.data], block.starts, block.n
    starts, ends, firsts = lowered.words(SPACED)
    words = word_hashes(lowered.data, starts, ends)
    windows = window_hashes(words, ngram)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if b - a >= ngram:
            own = np.sort(windows[a : b - ngram + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_id(shingles: np.ndarray) -> tuple[int, int]:
    """A hash over the sorted set in two halves of 64 bits: the same for equal sets."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Leading shingles of which a set shares one with every set that it links to."""
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each shingle's leading bits; two to four times as many bits as shingles, 64 at least."""
    width = max(6, int(2 * len(shingles) - 1).bit_length())
    bits = np.zeros(1 << width, bool)
    bits[(shingles >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) narrowed to ``size`` bytes: neighbouring bits are joined, as leading bits of the hash ask."""
    while bits.shape[-1] > size:
        wide = np.unpackbits(bits, axis=-1)
        bits = np.packbits(wide[..., ::2] | wide[..., 1::2], axis=-1)
    return bits


def may_link(n_a, n_b, differing, percent: int = PERCENT):
    """Whether sets of these sizes can link although ``differing`` bits differ: each such bit is a shingle of one set only."""
    most = (n_a + n_b - differing) // 2
    return 100 * most >= percent * (n_a + n_b - most)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Intersection size of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _frequent(docs: DataFrame, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents hold, sorted, and how many at least. A summary of bounded size from every task, of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, block in text_blocks(batches):
            sets = shingle_sets(block, ngram)
            own, times = np.unique(np.concatenate(sets) if sets else keys[:0], return_counts=True)
            again = times > 1
            known = np.isin(own, keys, assume_unique=True)
            keep = again | known
            keys, back = np.unique(np.concatenate((keys, own[keep])), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, times[keep])), minlength=len(keys)).astype(np.int64)
            if len(keys) > SUMMARY:
                cut = np.partition(counts, -SUMMARY)[-SUMMARY]
                counts = counts - cut + 1
                keys, counts = keys[counts > 0], counts[counts > 0]
        large = counts > 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[large].view(np.int64)), pa.array(counts[large])], ["sig", "n"])

    found = docs.select("text").mapInArrow(run, "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    rows = found.orderBy(F.desc("n"), "sig").limit(FREQUENT).toArrow()
    sigs = rows.column("sig").to_numpy().view(np.uint64)
    order = np.argsort(sigs)
    return sigs[order], rows.column("n").to_numpy()[order]


def _described(docs: DataFrame, ngram: int) -> DataFrame:
    """Per row: key, hash of the text, set size, class (``cid`` and ``cid2``), bitmap (once for each class of a task)."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch, block in text_blocks(batches):
            sets = shingle_sets(block, ngram)
            ids = [class_id(own) if len(own) else (None, None) for own in sets]
            bits = [bitmap(own) if first else None for own, first in zip(sets, _first_seen(ids, seen))]
            columns = [batch.column("key"), batch.column("th"), pa.array([len(own) for own in sets], pa.int64()), pa.array([c for c, _ in ids], pa.int64()), pa.array([c for _, c in ids], pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "th", "n", "cid", "cid2", "bits"])

    return docs.mapInArrow(run, f"key {kind}, th long, n long, cid long, cid2 long, bits binary")


def _first_seen(ids: list[tuple], seen: set[tuple]) -> Iterator[bool]:
    """Whether each class is one that this task has not told of yet."""
    for c in ids:
        fresh = c[0] is not None and c not in seen
        if fresh:
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(c)
        yield fresh


def _prefixes(docs: DataFrame, frequent: np.ndarray, ngram: int, percent: int) -> DataFrame:
    """Set size, class and prefix in the common order, once for each class of a task.

    Made from the texts again: stored, they would take a third of the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.zeros(1 << 20, bool)
        marked[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        seen: set[tuple[int, int]] = set()
        for _, block in text_blocks(batches):
            sets = shingle_sets(block, ngram)
            ids = [class_id(own) if len(own) else (None, None) for own in sets]
            kept = [(own, c) for own, c, first in zip(sets, ids, _first_seen(ids, seen)) if first]
            prefixes = [np.zeros(0, np.uint64)]
            for own, _ in kept:
                length = prefix_length(len(own), percent)
                late = marked[(own & np.uint64((1 << 20) - 1)).astype(np.int64)]
                if late.any():
                    at = np.flatnonzero(late)
                    late[at] = np.isin(own[at], frequent, assume_unique=True)
                    own = np.concatenate((own[~late], own[late]))
                prefixes.append(own[:length])
            stops = np.cumsum([len(p) for p in prefixes]).astype(np.int32)
            columns = [pa.array([len(own) for own, _ in kept], pa.int64()), pa.array([c for _, (c, _) in kept], pa.int64()), pa.array([c for _, (_, c) in kept], pa.int64()), pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(prefixes).view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "cid", "cid2", "prefix"])

    return docs.select("text").mapInArrow(run, "n long, cid long, cid2 long, prefix array<long>")


def _ambiguous(told: DataFrame) -> DataFrame:
    """First halves of class hashes that several classes have: rare, but not impossible."""
    return told.where("cid is not null").groupBy("cid").agg(F.min("cid2").alias("lo"), F.max("cid2").alias("hi")).where("lo <> hi").select("cid")


def _told_apart(rows: DataFrame, ambiguous: DataFrame | None) -> DataFrame:
    """``rows`` with class ids that differ wherever the halves of the class hash do."""
    if ambiguous is None:
        return rows
    again = rows.join(F.broadcast(ambiguous.withColumn("twice", F.lit(True))), "cid", "left")  # a handful of rows
    return again.withColumn("cid", F.when(F.col("twice"), F.xxhash64("cid", "cid2")).otherwise(F.col("cid"))).drop("twice")


def _members(percent: int):
    """Of rows sorted by part, sig, n and cid: tiles of several classes, a row each, with a hash of the members.

    A tile is cut wherever the next size is too large to link, so no pair of it is lost. One of
    more than ``TILE_ROWS`` members comes in rows of as many; its id is its shingle's, and so is
    that of a tile that is gathered in parts (``part`` > 0), whose single members stay.

    Of a tile of that size members are left out for which even its smallest set is too large
    (``most``, from the shingle's place): what they may link to shares an earlier shingle.
    """
    limit = TILE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]

        def put(d1: int, d2: int, row: int, cids: np.ndarray) -> None:
            for column, value in zip(out, (d1, d2, row, cids)):
                column.append(value)

        def flush() -> pa.RecordBatch:
            stops = np.concatenate(([0], np.cumsum([len(c) for c in out[3]]))).astype(np.int32)
            flat = np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))], ["tile", "tile2", "row", "cids"])
            for column in out:
                column.clear()
            return made

        names = ("part", "sig", "n", "cid", "most")
        held = [np.zeros(0, np.int64)] * 5  # the group that may go on
        rows_out, goes_on, least = 0, 0, 0  # its rows that are out already, its id and its smallest size
        for batch in _and_end(batches):
            part, sig, n, cid, most = held if batch is None else (np.concatenate((h, batch.column(c).to_numpy())) for h, c in zip(held, names))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1])
            apart = new.copy()
            apart[1:] |= (part[1:] == 0) & (100 * n[:-1] < percent * n[1:])
            fresh = apart.copy()
            fresh[1:] |= cid[1:] != cid[:-1]
            part, sig, n, cid, most, apart = part[fresh], sig[fresh], n[fresh], cid[fresh], most[fresh], apart[fresh]
            begins = np.flatnonzero(apart)
            ends = np.append(begins[1:], len(sig))
            mixed = mix(cid.view(np.uint64))
            sums = [np.concatenate(([np.uint64(0)], np.cumsum(m))) for m in (mixed, mix(mixed ^ np.uint64(0x5851F42D4C957F2D)))]
            d1, d2 = ((t[ends] - t[begins]).view(np.int64).tolist() for t in sums)
            lowest = np.where(part[begins] == 0, n[begins], 0).view(np.uint64)  # of the band; parts of a tile have one id
            own = mix(mix(sig[begins].view(np.uint64)) ^ mix(lowest)).view(np.int64).tolist()
            smallest = n[begins].copy()
            if rows_out:
                own[0], smallest[0] = goes_on, least
            stays = (most >= np.repeat(smallest, ends - begins)) | (part > 0)  # those of parts were looked at before
            last = len(begins) - 1
            for g, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                if batch is not None and g == last:  # waits for what follows, but for full rows
                    while b - a > limit:
                        put(own[g], int(part[a]), rows_out, cid[a : a + limit][stays[a : a + limit]])
                        a, rows_out = a + limit, rows_out + 1
                    held, goes_on, least = [part[a:b], sig[a:b], n[a:b], cid[a:b], most[a:b]], own[g], int(smallest[g])
                elif rows_out or b - a > limit or part[a]:
                    for at in range(a, b, limit):
                        put(own[g], int(part[a]), rows_out, cid[at : min(b, at + limit)][stays[at : min(b, at + limit)]])
                        rows_out += 1
                    rows_out = 0
                elif b - a > 1:
                    put(d1[g], d2[g], 0, cid[a:b])
            if len(out[0]) >= OUT_ROWS:
                yield flush()
        yield flush()

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _tiles(signed: DataFrame, hot: DataFrame | None, percent: int) -> DataFrame:
    """tile, cids: classes that share a prefix shingle and whose sizes are near enough to link, each member set once.

    ``hot``: frequent shingles with the number of parts in which their members are gathered.
    """
    part = F.lit(0).cast("long")
    if hot is not None:
        least = signed.join(F.broadcast(hot), "sig").groupBy("sig", "parts").agg(F.min("n").alias("least"))
        signed = signed.join(F.broadcast(least), "sig", "left").where("least is null or most >= least")  # a row per frequent shingle
        part = F.when(F.col("parts").isNull(), part).otherwise(1 + F.pmod(F.xxhash64("cid"), "parts"))
    placed = signed.select(part.alias("part"), "sig", "n", "cid", "most").repartition("sig", "part").sortWithinPartitions("part", "sig", "n", "cid")
    found = placed.mapInArrow(_members(percent), "tile long, tile2 long, row long, cids array<long>")
    return found.dropDuplicates(["tile", "tile2", "row"]).select("tile", "cids")


def _arrays(docs: DataFrame, wanted: DataFrame, ngram: int) -> DataFrame:
    """``cid`` and ``shingles`` of the classes in ``wanted`` (with ``cid2`` and ``rep`` and ``th`` of one document of each)."""
    small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = wanted.select("rep", F.col("th").alias("rep_th"), "cid", "first", "cid2")
    found = docs.join(F.broadcast(keys) if small else keys, (F.col("th") == F.col("rep_th")) & F.col("key").eqNullSafe(F.col("rep"))).select("cid", "first", "cid2", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            sets = shingle_sets(block, ngram)
            told = zip(batch.column("first").to_pylist(), batch.column("cid2").to_pylist())
            right = [class_id(s) == c for s, c in zip(sets, told)]
            yield pa.RecordBatch.from_arrays([batch.column("cid").filter(pa.array(right)), pa.array([s.tobytes() for s, r in zip(sets, right) if r], pa.binary())], ["cid", "shingles"])

    return found.mapInArrow(run, "cid long, shingles binary").dropDuplicates(["cid"])


def _linked(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sorted arrays overlap enough."""
    of = lambda side: arrays.select(F.col("cid").alias(side), F.col("shingles").alias(f"s_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("s_x"), batch.column("s_y"))):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = overlap(p, q)
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(kept), batch.column("y").filter(kept)], ["x", "y"])

    return pairs.join(of("x"), "x").join(of("y"), "y").mapInArrow(run, "x long, y long")


def _distances(band: list[tuple[np.ndarray, ...]], percent: int) -> np.ndarray:
    """For members in bands of one bitmap width each: the share of bits that differ, and infinity where sizes or the bound rule a link out.

    Only bands of the same or of neighbouring widths meet; a wider bitmap is folded first.
    """
    total = sum(len(n) for n, _ in band)
    out = np.full((total, total), np.inf, np.float32)
    at = 0
    for b, (n_l, bits_l) in enumerate(band):
        to = at
        for n_r, bits_r in band[b : b + 2]:
            begin, to = to, to + len(n_r)
            if bits_r.shape[1] > 2 * bits_l.shape[1]:
                break
            words_l, words_r = bits_l.view(np.uint64), folded(bits_r, bits_l.shape[1]).view(np.uint64)
            step = max(1, 200_000 // words_r.size)
            for i in range(0, len(n_l), step):
                size = n_l[i : i + step, None]
                near = 100 * np.minimum(size, n_r) >= percent * np.maximum(size, n_r)
                if not near.any():
                    continue
                differing = np.bitwise_count(words_l[i : i + step, None, :] ^ words_r).sum(axis=2, dtype=np.int64)
                near &= may_link(size, n_r, differing, percent)
                found = np.where(near, (differing / (size + n_r)).astype(np.float32), np.float32(np.inf))
                out[at + i : at + i + len(size), begin:to] = found
                if begin != at:
                    out[begin:to, at + i : at + i + len(size)] = found.T
        at += len(n_l)
    return out


def likeliest(distances: np.ndarray, comp: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Pairs to test: a spanning forest over the components, by least distances.

    ``distances`` is symmetric, infinite where a pair is out. Also whether pairs of different components are left out.
    """
    open_ = np.where(comp[:, None] == comp, np.float32(np.inf), distances)
    possible = int(np.isfinite(open_).sum()) // 2
    if not possible:
        return [], False
    pairs: set[tuple[int, int]] = set()
    _, label = np.unique(comp, return_inverse=True)
    while True:
        best = open_.argmin(axis=1)
        least = open_[np.arange(len(best)), best]
        rows = np.flatnonzero(np.isfinite(least))
        if not len(rows):
            break
        rows = rows[np.lexsort((rows, least[rows], label[rows]))]
        first = np.ones(len(rows), bool)
        first[1:] = label[rows][1:] != label[rows][:-1]
        root = np.arange(label.max() + 1)
        for row in rows[first].tolist():  # every component's nearest other
            x, y = int(label[row]), int(label[best[row]])
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                pairs.add((min(row, int(best[row])), max(row, int(best[row]))))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]
        open_[label[:, None] == label] = np.inf
    return sorted(pairs), len(pairs) < possible


def linked_pairs(distances: np.ndarray, comp: np.ndarray, shingles: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components as far as any do, found by intersecting the arrays of every pair still apart, the likeliest first."""
    x, y = np.nonzero(np.triu(np.isfinite(distances) & (comp[:, None] != comp)))
    order = np.argsort(distances[x, y], kind="stable")
    root = {c: c for c in comp.tolist()}
    out = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        p, q = comp[a], comp[b]
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q:
            both = overlap(shingles[a], shingles[b])
            if 100 * both >= percent * (len(shingles[a]) + len(shingles[b]) - both):
                root[max(p, q)] = min(p, q)
                out.append((a, b))
    return out


def _dealt(rows: DataFrame, again: bool, block: int) -> DataFrame:
    """tile, i, j, own, k, cid, comp: the members of tiles (tile, cid, comp), dealt into groups that one task compares.

    A tile's largest component need not be compared with itself, so in a tile of many its
    members meet only the others, and these meet all. Both are dealt by hash into blocks of
    about ``block``; two blocks that must meet go to one task, so no task holds more than two
    blocks, however large the tile. Tiles of one component are left out. The first time
    (not ``again``) every block is by itself.
    """
    if again:
        tally = rows.groupBy("tile", "comp").agg(F.count("*").alias("n")).groupBy("tile").agg(F.max_by("comp", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("members")).where("n_main < members")
    else:
        tally = rows.groupBy("tile").agg(F.min("cid").alias("main"), F.lit(0).alias("n_main"), F.count("*").alias("members"))
    cut = lambda n: F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("int")
    whole = F.col("members") <= block
    tally = tally.select("tile", "main", F.when(whole, 0).otherwise(cut(F.col("n_main")) if again else F.lit(0)).alias("m"), F.when(whole, 1).otherwise(cut(F.col("members") - F.col("n_main"))).alias("k"))
    placed = rows.join(tally, "tile").withColumn("is_main", (F.col("comp") == F.col("main")) & (F.col("m") > 0))
    tag = F.when(F.col("is_main"), F.pmod(F.xxhash64("cid"), F.greatest("m", F.lit(1)))).otherwise(F.col("m") + F.pmod(F.xxhash64("cid"), "k")).cast("int")
    dealt = placed.withColumn("own", tag)
    partner = F.explode(F.sequence(F.when(F.col("is_main"), F.col("m")).otherwise(F.lit(0)), F.col("m") + F.col("k") - 1)) if again else F.col("own")
    return dealt.withColumn("other", partner).select("tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "k", "cid", "comp")


class _Group:
    """The members that one task compares, in order of bitmap width and size."""

    def __init__(self, i: int, j: int, members: list[tuple], percent: int):
        """``members``: own, k, cid, comp, n, bits and what else the caller adds."""
        widths = [len(m[5]) for m in members]
        order = np.lexsort(([m[2] for m in members], [m[4] for m in members], widths)).tolist()
        self.members = [members[r] for r in order]
        self.comp = np.array([m[3] for m in self.members])
        bands = [(np.array([m[4] for m in g]), np.stack([np.frombuffer(m[5], np.uint8) for m in g])) for g in (list(g) for _, g in groupby(self.members, key=lambda m: len(m[5])))]
        self.distances = _distances(bands, percent)
        if i != j:
            own = np.array([m[0] for m in self.members])
            self.distances[own[:, None] == own] = np.inf  # pairs within a block belong to that block's own group


def _compared(dealt: DataFrame, names: list[str], compare, schema: str) -> DataFrame:
    """``compare(tile, i, j, members)`` of every group gives rows of longs."""
    names = ["tile", "i", "j", *names]
    dealt = dealt.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").select(names)
    out_names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(len(out_names))], out_names)
        stream = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names)))
        out: list[tuple] = []
        for (tile, i, j), group in groupby(stream, key=lambda r: r[:3]):
            out += compare(tile, i, j, [r[3:] for r in group])
            if len(out) >= OUT_ROWS:
                yield batch_of(out)
                out = []
        yield batch_of(out)
        give_back()

    return dealt.mapInArrow(run, schema)


def _candidates(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """x, y, tile: the likeliest pairs of each tile, and rows without x and y for tiles with more to come."""
    dealt = _dealt(rows, False, TILE_ROWS).join(classes.select("cid", "n", "bits"), "cid")

    def compare(tile: int, i: int, j: int, members: list[tuple]) -> list[tuple]:
        if len(members) == 1:
            return [(None, None, tile)] if members[0][1] > 1 else []
        group = _Group(i, j, members, percent)
        pairs, more = likeliest(group.distances, group.comp)
        ids = [m[2] for m in group.members]
        out = [(min(ids[a], ids[b]), max(ids[a], ids[b]), tile) for a, b in pairs]
        return [*out, (None, None, tile)] if more or members[0][1] > 1 else out

    return _compared(dealt, ["own", "k", "cid", "comp", "n", "bits"], compare, "x long, y long, tile long")


def _leave_out_earlier(group: _Group, tile: int, lists: list[list[int]]) -> None:
    """Pairs that share an earlier tile are looked at there; ``lists`` has the tiles of each member."""
    before = [[t for t in own if t < tile] for own in lists]
    _, back, times = np.unique(np.array([t for b in before for t in b], np.int64), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    common = times[back] > 1
    held = np.zeros((len(before), int((times > 1).sum())), np.float32)
    held[np.repeat(np.arange(len(before)), [len(b) for b in before])[common], column[back[common]]] = 1
    group.distances[held @ held.T > 0] = np.inf


def _undecided(rows: DataFrame, classes: DataFrame, percent: int, once: bool) -> DataFrame:
    """The rows (tile, cid, comp) of members with a pair that the bound leaves and that no component joins.

    ``once``: a pair counts in the first of ``rows``' tiles that it shares only.
    """
    told = classes.select("cid", "n", "bits")
    if once:
        told = told.join(rows.groupBy("cid").agg(F.collect_set("tile").alias("tiles")), "cid")
    else:
        told = told.withColumn("tiles", F.array().cast("array<long>"))

    def compare(tile: int, i: int, j: int, members: list[tuple]) -> list[tuple]:
        group = _Group(i, j, members, percent)
        apart = np.isfinite(group.distances) & (group.comp[:, None] != group.comp)
        if once and apart.any():
            _leave_out_earlier(group, tile, [m[6] for m in group.members])
            apart &= np.isfinite(group.distances)
        return [(tile, group.members[r][2], group.members[r][3]) for r in np.flatnonzero(apart.any(axis=1)).tolist()]

    return _compared(_dealt(rows, True, TILE_ROWS).join(told, "cid"), ["own", "k", "cid", "comp", "n", "bits", "tiles"], compare, "tile long, cid long, comp long").distinct()


def _last_links(rows: DataFrame, classes: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """x, y: links that join the components of each tile as far as any do."""
    tiles = rows.groupBy("cid").agg(F.collect_set("tile").alias("tiles"))
    dealt = _dealt(rows, True, ARRAY_ROWS).join(classes.select("cid", "n", "bits").join(tiles, "cid").join(arrays, "cid"), "cid")

    def compare(tile: int, i: int, j: int, members: list[tuple]) -> list[tuple]:
        group = _Group(i, j, members, percent)
        _leave_out_earlier(group, tile, [m[6] for m in group.members])
        found = linked_pairs(group.distances, group.comp, [np.frombuffer(m[7], np.uint64) for m in group.members], percent)
        ids = [m[2] for m in group.members]
        return [(ids[a], ids[b]) for a, b in found]

    return _compared(dealt, ["own", "k", "cid", "comp", "n", "bits", "tiles", "shingles"], compare, "x long, y long")


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, ``n_shingles`` and ``component_id``, the smallest key that links reach from it.

    A text without words (null, empty, white space) has no shingles, no links and its
    own key as component. Rows with equal texts or equal shingle sets are linked, also
    where their keys are equal. A null key counts as larger than all others; a component
    of null keys only has a null id. An empty table gives an empty result; other columns
    are not read, whatever their names. Classes are told apart by 128-bit hashes of their
    sets, shingles by 64-bit hashes.
    """
    return grouped(docs, ngram, percent, text, key).select(F.col("key").alias(key), "n_shingles", "component_id")


def _read(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``key``, ``text`` and ``th``, the text's xxhash64, whatever the columns of ``docs`` are called."""
    return docs.select(docs[_quoted(key)].alias("key"), docs[_quoted(text)].alias("text")).withColumn("th", F.xxhash64("text"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def grouped(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``th`` (the text's xxhash64), ``n_shingles``, ``component_id`` and ``comp`` (the component, null without words)."""
    spark = docs.sparkSession
    ship(spark)
    docs = _read(docs, text, key)
    frequent, counts = _frequent(docs, ngram)
    paths: dict[int, str] = {}

    def keep(frame: DataFrame) -> DataFrame:
        frame, path = spill(spark, frame)
        paths[id(frame)] = path
        return frame

    def done(*frames: DataFrame) -> None:
        forget(spark, *(paths.pop(id(f)) for f in frames))

    stored = keep(_described(docs, ngram).withColumn("first", F.col("cid")))
    ambiguous = settled(spark, _ambiguous(stored))
    ambiguous = None if ambiguous.isEmpty() else ambiguous
    told = _told_apart(stored, ambiguous)
    full = told.where("cid is not null")
    # one row per class; a task sends a class's bitmap once, so some rows of a class have none
    classes = full.groupBy("cid").agg(F.min("key").alias("least"), F.min(F.struct(F.col("key").alias("rep"), "th")).alias("r"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.min("first").alias("first"), F.min("cid2").alias("cid2"))
    classes = keep(classes.select("cid", "least", F.col("r.rep").alias("rep"), F.col("r.th").alias("th"), "n", "bits", "first", "cid2"))
    done()  # what the classes were grouped by is not needed while the tiles are gathered
    parts = -(-counts // PART_ROWS)
    hot = None
    if (parts > 1).any():
        hot = spark.createDataFrame(pa.table({"sig": frequent[parts > 1].view(np.int64), "parts": parts[parts > 1].astype(np.int64)}))
    signed = _told_apart(_prefixes(docs, frequent, ngram, percent), ambiguous).select("n", "cid", F.posexplode("prefix").alias("at", "sig"))
    # if the shingle at this place is the first that two sets share, all they share is from it on: the largest set that can link
    signed = signed.select("n", "cid", "sig", (F.expr(f"(n - at) * {100 + percent} div {percent}") - F.col("n")).cast("long").alias("most"))
    tiles = keep(_tiles(signed, hot, percent))
    members = tiles.select("tile", F.explode("cids").alias("cid"))

    groups = None
    named = keep(_candidates(members.withColumn("comp", F.col("cid")), classes, percent))
    pairs = keep(named.where("x is not null").select("x", "y").distinct())
    again = keep(named.where("x is null").select("tile").distinct())
    done(named)
    links = None

    def of_classes(wanted: DataFrame) -> DataFrame:
        return keep(_arrays(docs, classes.join(wanted, "cid", "left_semi"), ngram))

    def merged(found: DataFrame) -> None:
        nonlocal links, groups
        links = found if links is None else links.unionByName(found)
        groups = keep(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    if not pairs.isEmpty():
        arrays = of_classes(pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct())
        merged(keep(_linked(pairs, arrays, percent)))
        done(arrays)
    if not again.isEmpty():
        rows = members.join(again, "tile", "left_semi")
        if groups is None:
            rows = rows.withColumn("comp", F.col("cid"))
        else:
            rows = rows.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("tile", "cid", F.coalesce("component", "cid").alias("comp"))
        several = rows.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tile")
        rows = keep(rows.join(several, "tile", "left_semi"))
        done(tiles)
        for once in (False, True):  # the tiles of a member, told with each row, are few after the first
            if not rows.isEmpty():
                before, rows = rows, keep(_undecided(rows, classes, percent, once))
                done(before)
        if not rows.isEmpty():
            merged(keep(_last_links(rows, classes, of_classes(rows.select("cid").distinct()), percent)))

    if groups is None:
        groups = spark.createDataFrame([], "node long, component long")
    named = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "least", F.coalesce("component", "cid").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_class = named.join(smallest, "comp").select("cid", "comp", "component_id")
    out = told.select("key", "th", "n", "cid").join(by_class, "cid", "left").select("key", "th", F.col("n").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), "comp")
    out = settled(spark, out)
    forget(spark, *paths.values())
    return out


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the row with the smallest key.

    Among rows with the same smallest key that of the smallest text hash stays, and of
    rows equal in both one; null keys come after all others. Rows without words have no
    near duplicates and all stay. Columns keep their names, whatever these are; an empty
    table stays empty.
    """
    found = grouped(docs, ngram, percent, text, key).where("comp is not null").select("comp", "key", "th")
    order = F.struct(F.col("key").isNull().alias("late"), "key", "th")
    chosen = found.groupBy("comp").agg(F.min(order).alias("c"))
    rows = found.groupBy("comp", "key", "th").agg(F.count("*").alias("times")).join(chosen, "comp").withColumn("stays", order.eqNullSafe(F.col("c")))
    rows = settled(docs.sparkSession, rows.where("not stays or times > 1").select(F.col("key").alias("its_key"), F.col("th").alias("its_th"), "stays"))
    same = F.col("key").eqNullSafe(F.col("its_key")) & (F.col("th") == F.col("its_th"))
    hashed = docs.select(F.struct("*").alias("whole"), docs[_quoted(key)].alias("key"), F.xxhash64(docs[_quoted(text)]).alias("th"))
    fit = lambda part: F.broadcast(part) if part.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else part
    again = rows.where("stays").drop("stays")
    out = hashed.join(fit(rows.drop("stays")), same, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(hashed.join(fit(again), same, "left_semi").dropDuplicates(["key", "th"]))
    return out.select("whole.*")
