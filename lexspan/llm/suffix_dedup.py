"""Removes passages that stand more than once in a corpus, by a hash-compared suffix sort.

Every window of ``length`` bytes has an anchor: the place in it whose 32 bytes have the
smallest hash (the first of equals). Equal windows have equal anchors, so it is enough to
compare anchors with the same 32 bytes; there is about one anchor for 85 bytes of text. What
may matter of an anchor is its context, the ``length - 32`` bytes before it and ``length``
from it on.

1. Equal texts are one text with a number of copies (grouped by the texts themselves).
2. Anchors are counted by hash; those that stand once are dropped, and those whose contexts
   all agree need no comparison. Of the others every distinct context is fetched once.
3. Contexts with the same anchor hash meet in a task, as suffixes (from the anchor on) and
   reversed prefixes (before it). Both are put in order by mergesort. Two are compared by the
   length of what they share, found by binary search over prefix polynomial hashes, so a
   comparison takes a logarithmic number of steps. Each order is then verified: neighbours
   must share those bytes and differ in the next; if hashes collided, the bytes are sorted.
4. If two contexts share L bytes before and R from the anchor on and L + R >= ``length``, all
   of it is repeated. Neighbours in the two orders give the farthest reach to either side;
   where that of one side belongs to a pair too short, the windows in question are compared.
   As all windows of an anchor hold it, the reach to both sides is all there is to know.
5. A key with more than ``GROUP`` contexts (a passage in a third of all texts) is split
   before: the windows' offsets are halved, and contexts stay together only with those that
   share all bytes common to their half of the windows, down to single windows. These are
   counted, never gathered.
6. Each text gets its reaches, merges them and is cut.

Contexts count as equal by two hashes, of 64 bits (anchor) and 62 bits (context).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import TextBlock, give_back, mix, text_blocks, word_hashes
from lexspan.session import forget, settled, ship, spill, table

LENGTH, GRAM = 200, 32
#: Contexts that one task sorts at once; larger groups are split first.
GROUP = 20_000
#: Keys of groups to split are broadcast up to this many; more are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Bytes of a text that are looked through at once; longer texts in parts that overlap by a window.
PART = 1 << 22
_PLACE_BITS = 27
_KEYS = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


class PrefixHashes:
    """Prefix polynomial hashes of some bytes: the hash of any stretch in a constant number of steps."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not _POWERS or len(_POWERS[0]) <= n:
            size = max(n + 1, 1 << 20)
            _POWERS[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b)))) for b in (_BASE, _BACK)]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_KEYS[data] * _POWERS[0][:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * _POWERS[1][starts]

    def all_of(self, size: int) -> np.ndarray:
        """The hashes of all stretches of ``size`` bytes."""
        return (self.sums[size:] - self.sums[:-size]) * _POWERS[1][: len(self.sums) - size]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values: of the end of one block of ``width`` and the start of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.int64).max)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    starts = np.minimum.accumulate(rows, axis=1).ravel()
    ends = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(ends[: n - width + 1], starts[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts and places (in ``data``) of all anchors, in order, and the hashes of their ``gram`` bytes. ``starts``: of texts, n + 1."""
    windows = np.maximum(np.diff(starts) - length + 1, 0)
    if not windows.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = mix(PrefixHashes(data).all_of(gram))
    ordered = ((hashes >> np.uint64(_PLACE_BITS + 1)) << np.uint64(_PLACE_BITS)).astype(np.int64) | np.arange(len(hashes))
    least = sliding_least(ordered, length - gram + 1) & ((1 << _PLACE_BITS) - 1)
    text = np.repeat(np.arange(len(windows)), windows)
    ends = np.cumsum(windows)
    places = least[np.arange(ends[-1]) + np.repeat(starts[:-1] - (ends - windows), windows)]
    new = np.concatenate(([True], (places[1:] != places[:-1]) | (text[1:] != text[:-1])))
    return text[new], places[new], hashes[places[new]]


def parts(block: TextBlock, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]]:
    """Bytes, starts and numbers of texts: a whole block, or parts of one very long text.

    With these: the place in its text of the first byte, and how many bytes before and after
    are context only.
    """
    if len(block.data) <= PART:
        yield block.data, block.starts, np.arange(block.n), 0, 0, 0
        return
    for i in range(block.n):  # blocks this large hold one text
        whole = block.data[block.starts[i] : block.starts[i + 1]]
        for at in range(0, max(1, len(whole) - length + 1), PART - length + 1):
            low, high = max(0, at - length), min(len(whole), at + PART + length)
            yield whole[low:high], np.array([0, high - low]), np.array([i]), low, at - low, max(0, high - at - PART)


class Strings:
    """Stretches of some bytes, from ``starts`` over ``sizes``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data if len(data) else np.zeros(1, np.uint8), starts, sizes
        self.hashes = PrefixHashes(self.data)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the strings ``a`` and ``b`` begin with alike: binary search over prefix hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.sizes[a], self.sizes[b])
        x, y = self.starts[a], self.starts[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hashes.of(x, x + middle) == self.hashes.of(y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: whether string a stands before, with or after string b."""
        n = self.shared(a, b)
        ended_a, ended_b = n == self.sizes[a], n == self.sizes[b]
        last = len(self.data) - 1
        x, y = (self.data[np.minimum(self.starts[i] + n, last)].astype(np.int16) for i in (a, b))
        return np.where(ended_a | ended_b, ended_b.astype(np.int16) - ended_a, np.sign(x - y)).astype(np.int64)

    def alike(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the bytes themselves agree over the first ``n``."""
        out = np.ones(len(a), bool)
        for at in range(0, len(a), 50_000):
            m = n[at : at + 50_000]
            ends = np.cumsum(m)
            if not len(ends) or not ends[-1]:
                continue
            places = np.arange(ends[-1]) - np.repeat(ends - m, m)
            wrong = self.data[places + np.repeat(self.starts[a[at : at + 50_000]], m)] != self.data[places + np.repeat(self.starts[b[at : at + 50_000]], m)]
            out[at + np.repeat(np.arange(len(m)), m)[wrong]] = False
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def suffix_sort(strings: Strings, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings in order within their groups (numbers in rising order), and what each shares with the one before it (0 for a group's first).

    Mergesort from runs of one upwards; all merges of a level at once: the place of a string
    in the other run is found by binary search.
    """
    n = len(groups)
    order = np.arange(n)
    begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, n))
    base, total = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    within = np.arange(n) - base
    width = 1
    while width < sizes.max(initial=0):
        run = within // width
        other = (run ^ 1) * width  # the run to merge with
        active = np.flatnonzero(other < total)
        low = np.zeros(n, np.int64)
        high = np.where(other < total, np.minimum(width, total - other), 0)
        own_side = (run & 1).astype(bool)
        searching = active
        while len(searching):
            middle = (low[searching] + high[searching]) >> 1
            told = strings.before(order[base[searching] + other[searching] + middle], order[searching])
            ahead = (told < 0) | ((told == 0) & own_side[searching])  # of equals the left run's first
            low[searching[ahead]] = middle[ahead] + 1
            high[searching[~ahead]] = middle[~ahead]
            searching = searching[low[searching] < high[searching]]
        target = base + (run & ~1) * width + within % width + low
        target[other >= total] = np.flatnonzero(other >= total)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order = merged
        width *= 2
    return _verified(strings, groups, order)


def _verified(strings: Strings, groups: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in the order, held against the bytes; groups in which hashes collided are sorted by their bytes."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    if n < 2:
        return order, shared
    a, b = order[:-1], order[1:]
    pairs = np.flatnonzero(groups[a] == groups[b])
    a, b = a[pairs], b[pairs]
    told = strings.shared(a, b)
    good = strings.alike(a, b, told)
    full = (told == strings.sizes[a]) | (told == strings.sizes[b])
    last = len(strings.data) - 1
    x, y = strings.data[np.minimum(strings.starts[a] + told, last)], strings.data[np.minimum(strings.starts[b] + told, last)]
    good &= np.where(full, strings.sizes[a] <= strings.sizes[b], x < y)
    shared[pairs + 1] = told
    for group in np.unique(groups[a[~good]]):
        places = np.flatnonzero(groups[order] == group)
        order[places] = sorted(order[places].tolist(), key=strings.bytes_of)
        for p, q in zip(places[:-1], places[1:]):
            shared[q] = _common(strings.bytes_of(order[p]), strings.bytes_of(order[q]))
    return order, shared


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a[:n], np.uint8), np.frombuffer(b[:n], np.uint8)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def reaches(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """How far repeated windows of each context reach before its anchor and from it on (-1 and -1 where there are none).

    ``lefts``: bytes before the anchors; ``rights``: from them on; ``groups``: numbers in rising
    order. Contexts of a group must differ.
    """
    n = len(groups)
    left_sizes, right_sizes = np.array([len(x) for x in lefts], np.int64), np.array([len(x) for x in rights], np.int64)
    backward = Strings(np.frombuffer(b"".join(x[::-1] for x in lefts), np.uint8), np.cumsum(left_sizes) - left_sizes, left_sizes)
    forward = Strings(np.frombuffer(b"".join(rights), np.uint8), np.cumsum(right_sizes) - right_sizes, right_sizes)
    orders = []
    for strings in (backward, forward):
        order, shared = suffix_sort(strings, groups)
        rank = np.zeros(n, np.int64)  # equal strings have one rank
        new = np.ones(n, bool)
        if n:
            a, b = order[:-1], order[1:]
            new[1:] = (groups[a] != groups[b]) | (shared[1:] != strings.sizes[a]) | (shared[1:] != strings.sizes[b])
        rank[order] = np.cumsum(new)
        orders.append(rank)
    reach = [np.full(n, -1), np.full(n, -1)]
    most = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for side, (first, second) in enumerate(((orders[0], orders[1]), (orders[1], orders[0]))):
        order = np.lexsort((second, first, groups))  # of equals on one side, those closest on the other meet
        a, b = order[:-1], order[1:]
        pairs = groups[a] == groups[b]
        a, b = a[pairs], b[pairs]
        before, after = backward.shared(a, b), forward.shared(a, b)
        true = backward.alike(a, b, before) & forward.alike(a, b, after)
        for i in np.flatnonzero(~true).tolist():  # hashes collided
            before[i], after[i] = _common(lefts[a[i]][::-1], lefts[b[i]][::-1]), _common(rights[a[i]], rights[b[i]])
        for own in (a, b):
            np.maximum.at(most[side], own, (before, after)[side])
            enough = before + after >= length
            np.maximum.at(reach[0], own[enough], before[enough])
            np.maximum.at(reach[1], own[enough], after[enough])
    # A side is settled if its farthest reach is of a pair that is long enough; the two sides together must allow a window.
    possible = (most[0] + most[1] >= length) & ((reach[0] < most[0]) | (reach[1] < most[1]))
    if possible.any():
        _compare_windows(lefts, rights, groups, np.flatnonzero(possible), most, reach, length)
    return reach[0], reach[1]


def _compare_windows(lefts: list[bytes], rights: list[bytes], groups: np.ndarray, rows: np.ndarray, most: list[np.ndarray], reach: list[np.ndarray], length: int) -> None:
    """For contexts that the two orders leave open: the windows beyond what is known, against those of all contexts of the group at the same offset."""
    wanted: dict[tuple[int, int], list[int]] = {}
    for i in rows.tolist():
        low = max(0, length - int(most[1][i]))  # offsets of the anchor in windows that may be repeated
        known = (length - reach[1][i], reach[0][i]) if reach[0][i] >= 0 else (1, 0)
        for offset in range(low, int(most[0][i]) + 1):
            if not known[0] <= offset <= known[1]:
                wanted.setdefault((int(groups[i]), offset), []).append(i)
    begins = np.searchsorted(groups, np.unique(groups))
    bounds = {int(groups[b]): (int(b), int(e)) for b, e in zip(begins, np.append(begins[1:], len(groups)))}
    for (group, offset), own in wanted.items():
        seen: dict[bytes, int] = {}
        for j in range(*bounds[group]):
            if len(lefts[j]) >= offset and len(rights[j]) >= length - offset:
                window = (lefts[j][len(lefts[j]) - offset :], rights[j][: length - offset])
                seen[window] = seen.get(window, 0) + 1
        for i in own:
            if len(lefts[i]) >= offset and seen.get((lefts[i][len(lefts[i]) - offset :], rights[i][: length - offset]), 0) > 1:
                reach[0][i], reach[1][i] = max(reach[0][i], offset), max(reach[1][i], length - offset)


# On Spark -------------------------------------------------------------------


def anchor_table(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, place, ``gram`` and ``context`` (hashes) of every anchor; ``texts`` has ``id`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            ids = batch.column("id").to_numpy()
            last = -1
            for data, starts, numbers, begin, before, after in parts(block, length):
                inner = data[before : len(data) - after]
                text, places, hashes = anchors(inner, starts if not before + after else np.array([0, len(inner)]), length)
                places = places + before
                if begin + before and len(text) and places[0] + begin == last:  # the part before ended with it
                    text, places, hashes = text[1:], places[1:], hashes[1:]
                if not len(text):
                    continue
                low, high = np.maximum(places - (length - GRAM), starts[text]), np.minimum(places + length, starts[text + 1])
                columns = [pa.array(ids[numbers[text]]), pa.array(places - starts[text] + begin), pa.array(hashes.view(np.int64)), pa.array(_context_hashes(data, low, places, high).view(np.int64))]
                last = int(places[-1]) + begin
                yield pa.RecordBatch.from_arrays(columns, ["id", "place", "gram", "context"])

    return texts.select("id", "text").mapInArrow(run, "id long, place long, gram long, context long")


def _context_hashes(data: np.ndarray, low: np.ndarray, places: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix(word_hashes(data, low, high) + (places - low).astype(np.uint64))


def contexts(texts: DataFrame, wanted: DataFrame, length: int = LENGTH) -> DataFrame:
    """The wanted columns with ``before`` and ``after``, the bytes around each place; ``wanted`` has id, place, gram, context, often."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("place", "gram", "context", "often")).alias("wanted"))  # as many as the text has places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after = [], []
            own = batch.column("wanted")
            places, ends = own.flatten().field("place").to_pylist(), np.cumsum([len(x) for x in own]).tolist()
            for row, (begin, end) in enumerate(zip([0, *ends], ends)):
                data = memoryview(batch.column("text")[row].as_buffer())
                before += [bytes(data[max(0, p - (length - GRAM)) : p]) for p in places[begin:end]]
                after += [bytes(data[p : p + length]) for p in places[begin:end]]
            columns = [own.flatten().field(c) for c in ("gram", "context", "often")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["gram", "context", "often", "before", "after"])

    return texts.select("id", "text").join(lists, "id").mapInArrow(run, "gram long, context long, often boolean, before binary, after binary")


def _sorted_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows in order of ``key``, in tables of whole keys of about ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if count >= limit:
            keys = batch.column("key").to_numpy()
            last = held[-1].column("key")[-1].as_py()
            cut = int(np.argmax(keys != last)) if keys[-1] != last else len(keys)
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def compared(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, context, ``back`` and ``on``: the reaches of contexts with repeated windows; ``rows`` has key, gram, context, before, after.

    Rows of a key differ in before or after, and are few enough for a task.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _sorted_groups(batches, GROUP // 2):
            keys = own.column("key").to_numpy()
            groups = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            back, on = reaches(own.column("before").to_pylist(), own.column("after").to_pylist(), groups, length)
            hit = np.flatnonzero(back >= 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([*(pa.array(own.column(c).to_numpy()[hit]) for c in ("gram", "context")), pa.array(back[hit]), pa.array(on[hit])], ["gram", "context", "back", "on"])
        give_back()

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "gram long, context long, back long, on long")


def split_groups(spark: SparkSession, rows: DataFrame, group: int, length: int = LENGTH) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """Rows whose keys have at most ``group`` contexts, what is known of the others (gram, context, back, on), and the stored tables.

    A key that is too large is parted: each context goes on twice, for the windows with the
    anchor in the first and in the second half of the offsets left, under a key that hashes
    the bytes which all windows of that half share. Contexts that agree on all bytes of a half
    are counted: its windows are repeated. At a single offset all that share the key agree.
    """
    found, small, paths = [], [], []
    rows = rows.withColumn("least", F.lit(0)).withColumn("most", F.lit(length - GRAM))
    while True:
        stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("before", "after")).alias("a"), F.max(F.xxhash64("before", "after")).alias("b"))
        stats, path = spill(spark, stats.where("n > 1"))
        paths.append(path)
        large = stats.where(F.col("n") > group)
        if not large.limit(1).count():
            break
        told = rows.join(stats, "key")
        agreed = told.where("a = b").select("gram", "context", F.least(F.octet_length("before"), F.col("most")).cast("long").alias("back"), F.least(F.octet_length("after"), F.lit(length) - F.col("least")).cast("long").alias("on"))
        found.append(agreed.where((F.col("back") + F.col("on")) >= length))
        small.append(told.where((F.col("a") != F.col("b")) & (F.col("n") <= group)).select("key", "gram", "context", "before", "after"))
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("least").alias("l"), middle.alias("m")), F.struct((middle + 1).alias("l"), F.col("most").alias("m"))))
        open_ = told.where((F.col("a") != F.col("b")) & (F.col("n") > group)).select("*", halves.alias("half")).where("half.l <= half.m")
        # the bytes that may matter of a half, and those that all of its windows share
        open_ = open_.where((F.octet_length("before") >= F.col("half.l")) & (F.octet_length("after") >= F.lit(length) - F.col("half.m")))
        after = F.expr(f"substring(after, 1, {length} - half.l)")
        before = F.expr("substring(before, greatest(octet_length(before) - half.m, 0) + 1, half.m)")
        core = F.xxhash64("key", F.col("half.l"), F.expr("substring(before, octet_length(before) - half.l + 1, half.l)"), F.expr(f"substring(after, 1, {length} - half.m)"))
        rows, path = spill(spark, open_.select(core.alias("key"), "gram", "context", before.alias("before"), after.alias("after"), F.col("half.l").alias("least"), F.col("half.m").alias("most")))
        paths.append(path)
    small.append(rows.join(stats.where("a != b"), "key").select("key", "gram", "context", "before", "after"))
    agreed = rows.join(stats.where("a = b"), "key").select("gram", "context", F.least(F.octet_length("before"), F.col("most")).cast("long").alias("back"), F.least(F.octet_length("after"), F.lit(length) - F.col("least")).cast("long").alias("on"))
    found.append(agreed.where((F.col("back") + F.col("on")) >= length))
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out, found, paths


def merged_spans(begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[tuple[int, int]] = []
    order = np.argsort(begins, kind="stable")
    for b, e in zip(begins[order].tolist(), ends[order].tolist()):
        if out and b <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((b, e))
    return out


def repeated_spans(spark: SparkSession, texts: DataFrame, length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, list[str]]:
    """Per text (``id``) with repeated windows its ``begins`` and ``ends`` (not merged yet); and the stored tables to forget.

    ``texts`` is a stored table of distinct texts: id, text.
    """
    ship(spark)
    every, every_path = spill(spark, anchor_table(texts, length))
    counts, counts_path = spill(spark, every.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")))
    repeated, repeated_path = spill(spark, every.join(counts, "gram"))  # anchors that stand again, their own text included
    forget(spark, every_path, counts_path)
    wanted = repeated.where("mixed").groupBy("gram", "context").agg(F.min(F.struct("id", "place")).alias("first"), (F.count("*") > 1).alias("often"))
    wanted = wanted.select("first.id", "first.place", "gram", "context", "often")
    around, around_path = spill(spark, contexts(texts, wanted, length).withColumn("key", F.col("gram")))
    paths = [repeated_path, around_path]
    large, large_path = spill(spark, around.groupBy("key").count().where(F.col("count") > group).select("key"))
    paths.append(large_path)
    small, found = around.drop("often"), []
    if (n := large.count()):  # only these are split; the others stay where they are
        mark = F.broadcast(large) if n <= BROADCAST_KEYS else large
        parts_of_large, found, more = split_groups(spark, small.join(mark, "key", "left_semi"), group, length)
        small = small.join(mark, "key", "left_anti").unionByName(parts_of_large)
        paths += more
    known = compared(small, length)
    for part in found:
        known = known.unionByName(part)
    whole = around.where("often").select("gram", "context", F.octet_length("before").cast("long").alias("back"), F.octet_length("after").cast("long").alias("on"))
    known = known.unionByName(whole).groupBy("gram", "context").agg(F.max("back").alias("back"), F.max("on").alias("on"))
    known, known_path = spill(spark, known)
    paths.append(known_path)
    reached = repeated.where("mixed").join(known, ["gram", "context"]).select("id", "place", "back", "on")
    agreed = repeated.where("not mixed").select("id", "place", F.lit(length - GRAM).cast("long").alias("back"), F.lit(length).cast("long").alias("on"))  # cut to the text below
    spans = reached.unionByName(agreed).groupBy("id").agg(F.collect_list(F.struct((F.col("place") - F.col("back")).alias("begin"), (F.col("place") + F.col("on")).alias("end"))).alias("spans"))  # as many as the text has anchors
    return spans, paths


def distinct_texts(spark: SparkSession, docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """id, text, ``digest`` (MD5) and ``copies`` of each distinct text; null is empty."""
    named = docs.select(F.coalesce(docs[_quoted(text)], F.lit("")).alias("text"))
    counted = named.groupBy("text").agg(F.count("*").alias("copies"))
    return spill(spark, counted.select(F.monotonically_increasing_id().alias("id"), "text", F.unhex(F.md5("text")).alias("digest"), "copies"))


def cut(texts: DataFrame, spans: DataFrame, length: int = LENGTH, keep: bool = False) -> DataFrame:
    """digest, n_bytes, n_removed, n_spans, kept_sha256 of each distinct text, and with ``keep`` the spans and the bytes that stay."""
    more = ", spans array<array<long>>, kept binary" if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, copies = batch.column("digest"), batch.column("copies").to_pylist()
            rows = []
            for row in range(batch.num_rows):
                data = memoryview(batch.column("text")[row].as_buffer())
                runs: list[tuple[int, int]] = []
                if copies[row] > 1 and len(data) >= length:
                    runs = [(0, len(data))]
                elif (own := batch.column("spans")[row]).is_valid:
                    begins, ends = own.values.field("begin").to_numpy(), own.values.field("end").to_numpy()
                    runs = merged_spans(np.maximum(begins, 0), np.minimum(ends, len(data)))
                stays, at, digest = [], 0, hashlib.sha256()
                for b, e in [*runs, (len(data), len(data))]:
                    digest.update(data[at:b])
                    if keep:
                        stays.append(bytes(data[at:b]))
                    at = e
                rows.append((len(data), sum(e - b for b, e in runs), len(runs), digest.hexdigest(), runs, b"".join(stays)))
            columns = list(zip(*rows)) if rows else [()] * 6
            arrays = [digests, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())]
            if keep:
                arrays += [pa.array([[list(r) for r in x] for x in columns[4]], pa.list_(pa.list_(pa.int64()))), pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["its_spans", "kept"] if keep else [])])
            give_back()

    joined = texts.select("id", "text", "digest", "copies").join(spans, "id", "left").select("text", "digest", "copies", "spans")
    return joined.mapInArrow(run, "digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more.replace("spans array", "its_spans array"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP, keep: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: the key, n_bytes, n_removed, n_spans and kept_sha256 after every byte is removed that a string
    of ``length`` bytes covers which starts anywhere else too, in the same text or another.

    With ``keep`` also ``spans`` (the removed runs: begin and end bytes) and ``kept`` (binary;
    a cut may fall within a character). Texts are UTF-8; null ones are empty. Repeated rows
    are documents like any other, so texts that stand twice lose everything if they are
    ``length`` bytes or longer. Shorter texts lose nothing. Null and equal keys are rows of
    their own; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    texts, texts_path = distinct_texts(spark, docs, text)
    spans, paths = repeated_spans(spark, texts, length, group)
    results, results_path = spill(spark, cut(texts, spans, length, keep))
    forget(spark, texts_path, *paths)
    named = docs.select(docs[_quoted(key)].alias("key"), F.unhex(F.md5(F.coalesce(docs[_quoted(text)], F.lit("")))).alias("digest"))
    out = named.join(results, "digest").select(F.col("key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *([F.col("its_spans").alias("spans"), "kept"] if keep else []))
    out = settled(spark, out)
    forget(spark, results_path)
    return out


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
