"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers, one reading forwards and one backwards, pass over windows of
``WINDOW`` successive bytes of a text's UTF-8. Both states together label every byte
position; a document's probabilities are the mean of those of all its positions. The
network is trained here, in numpy, by backpropagation through time on a bounded sample
of labelled rows; the whole texts are then read in batches of windows, so that numpy
does one step for thousands of windows at once.

For speed the gates and the candidate state use ``x / (1 + |x|)`` (scaled to 0..1 for
gates) in place of the logistic function and tanh, in training and prediction alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import TextBlock, quoted, text_blocks
from lexspan.session import ship, table

WINDOW = 64
HIDDEN = 8
#: The training sample: at most so many labelled documents of a language, chosen by hash, ...
TRAIN_DOCS = 300
#: ... so many bytes of each, from a place chosen by hash, ...
TRAIN_CHARS = 512
#: ... and so many documents of all languages together, shared evenly, but at least one of each.
TRAIN_TOTAL = 60_000
#: Windows that one step reads together.
BATCH = 4096


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def windows_of(block: TextBlock, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (position x window; 0 where a document ends), true lengths, and each window's document."""
    n = -(-block.lengths // size)
    doc = np.repeat(np.arange(block.n), n)
    start = block.starts[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
    length = np.minimum(size, block.starts[1:][doc] - start)
    at = start + np.arange(size)[:, None]
    data = np.where(np.arange(size)[:, None] < length, block.data[np.minimum(at, max(0, len(block.data) - 1))], 0) if len(doc) else np.zeros((size, 0), np.uint8)
    return data.astype(np.uint8), length, doc


class Network:
    """Parameters: per direction the input table (3h x 256) and recurrent matrix (3h x h); the output (classes x 2h) and bias.

    The rows of the first two are the update gate, the reset gate and the candidate.
    """

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = [draw(3 * hidden, 256, scale=0.5), draw(3 * hidden, hidden, scale=0.4), draw(3 * hidden, 256, scale=0.5), draw(3 * hidden, hidden, scale=0.4), draw(classes, 2 * hidden, scale=0.3), np.zeros((classes, 1), np.float32)]

    def _states(self, table: np.ndarray, loop: np.ndarray, data: np.ndarray, backwards: bool, keep: bool):
        """States after every position (position x h x windows) and, if kept, what the way back needs."""
        h, (size, n) = self.h, data.shape
        states = np.empty((size, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        kept = []
        x, a = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        for t in range(size - 1, -1, -1) if backwards else range(size):
            np.take(table, data[t], axis=1, out=x, mode="clip")
            np.matmul(loop, state, out=a)
            pre = x[: 2 * h] + a[: 2 * h]
            gates = np.abs(pre)
            gates += 1
            np.divide(pre, gates, out=gates)
            gates *= 0.5
            gates += 0.5
            cand = gates[h:] * a[2 * h :]
            cand += x[2 * h :]
            new = np.abs(cand)
            new += 1
            np.divide(cand, new, out=new)
            if keep:
                kept.append((t, state, pre, gates, a[2 * h :].copy(), cand, new))
            step = new - state
            step *= gates[:h]
            state = np.add(state, step, out=states[t])
        return states, kept

    def positions(self, data: np.ndarray, keep: bool = False):
        """Class probabilities of every position (position x classes x windows)."""
        ahead, kept_ahead = self._states(self.p[0], self.p[1], data, False, keep)
        back, kept_back = self._states(self.p[2], self.p[3], data, True, keep)
        logits = np.matmul(self.p[4][:, : self.h], ahead)
        logits += np.matmul(self.p[4][:, self.h :], back)
        logits += self.p[5]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return (logits, ahead, back, kept_ahead, kept_back) if keep else logits

    def gradients(self, data: np.ndarray, length: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross-entropy over all true positions."""
        probs, ahead, back, kept_ahead, kept_back = self.positions(data, keep=True)
        size, n = data.shape
        true = (np.arange(size)[:, None] < length).astype(np.float32) / max(1, int(length.sum()))
        delta = probs
        delta[:, label, np.arange(n)] -= 1
        delta *= true[:, None, :]
        out = [np.zeros_like(p) for p in self.p]
        out[4][:, : self.h] = np.einsum("tcn,thn->ch", delta, ahead, optimize=True)
        out[4][:, self.h :] = np.einsum("tcn,thn->ch", delta, back, optimize=True)
        out[5][:, 0] = delta.sum(axis=(0, 2))
        for first, kept, w in ((0, kept_ahead, self.p[4][:, : self.h]), (2, kept_back, self.p[4][:, self.h :])):
            self._way_back(first, kept, np.matmul(w.T, delta), data, out)
        return out

    def _way_back(self, first: int, kept: list, from_output: np.ndarray, data: np.ndarray, out: list[np.ndarray]) -> None:
        h, loop = self.h, self.p[first + 1]
        carried = np.zeros(from_output.shape[1:], np.float32)
        by_byte = np.zeros((256, 3 * h), np.float32)
        for t, before, pre, gates, inner, cand, new in reversed(kept):
            d = carried + from_output[t]
            z, r = gates[:h], gates[h:]
            d_cand = d * z / (1 + np.abs(cand)) ** 2
            d_gates = np.concatenate((d * (new - before), d_cand * inner)) * 0.5 / (1 + np.abs(pre)) ** 2
            d_in = np.concatenate((d_gates, d_cand))
            d_loop = np.concatenate((d_gates, d_cand * r))
            out[first + 1] += d_loop @ before.T
            np.add.at(by_byte, data[t], d_in.T)
            carried = d * (1 - z) + loop.T @ d_loop
        out[first] += by_byte.T


def train(data: np.ndarray, length: np.ndarray, label: np.ndarray, classes: int, steps: int = 160, batch: int = 192, rate: float = 0.02, seed: int = 11) -> Network:
    """Adam on batches that hold all classes in equal parts, as far as these have windows."""
    net = Network(classes)
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(label == c) for c in range(classes)]
    groups = [g for g in groups if len(g)]
    mean, square = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, batch // len(groups))) for g in groups])
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, s in zip(net.p, net.gradients(data[:, pick], length[pick], label[pick]), mean, square):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return net


def pooled(net: Network, block: TextBlock) -> np.ndarray:
    """Mean class probabilities over all positions of each document (documents x classes); zeros without text."""
    data, length, doc = windows_of(block)
    classes = len(net.p[5])
    sums = np.zeros((len(doc), classes))
    whole = np.arange(WINDOW)[:, None]
    for at in range(0, len(doc), BATCH):
        part = slice(at, at + BATCH)
        probs = net.positions(data[:, part])
        short = length[part] < WINDOW
        if short.any():
            probs[:, :, short] *= (whole < length[part][short])[:, None, :]
        sums[part] = probs.sum(axis=0).T
    out = np.zeros((block.n, classes))
    for c in range(classes):
        out[:, c] = np.bincount(doc, sums[:, c], minlength=block.n)
    return out / np.maximum(block.lengths, 1)[:, None]


_LETTER_BYTES = np.zeros(256, bool)
_LETTER_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def lettered(block: TextBlock) -> np.ndarray:
    """Whether each document has a letter."""
    sums = np.concatenate(([0], np.cumsum(_LETTER_BYTES[block.data])))
    out = sums[block.starts[1:]] > sums[block.starts[:-1]]
    for i in np.flatnonzero(~out & (block.lengths > 0)):
        out[i] = any(c.isalpha() for c in block.texts[int(i)].as_py())
    return out


def fit(docs: DataFrame, learn_from: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", part: int | None = TRAIN_CHARS) -> tuple[Network | None, list[str]]:
    """Train on rows where ``learn_from`` holds and ``lang`` and ``text`` are not null; the sample is bounded as said above.

    Of each row drawn the fit sees ``part`` characters from a place that its key gives, or the
    whole text where ``part`` is null.

    Every language is learned. Rows equal in key, language and text count once; others of
    equal keys are told apart by their texts. Without rows there is no network.
    """
    spark = docs.sparkSession
    rows = docs.where(learn_from & docs[quoted(lang)].isNotNull() & (F.length(docs[quoted(text)]) > 0)).select(docs[quoted(lang)].alias("lang"), docs[quoted(text)].alias("text"), F.xxhash64(docs[quoted(key)], docs[quoted(text)], F.lit(1)).alias("h"), F.xxhash64(docs[quoted(key)], F.lit(3)).alias("at"))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(1, min(TRAIN_DOCS, TRAIN_TOTAL // max(1, len(known))))
    # hashes below a language's bound are about twice as many as wanted; the smallest of them are the sample, so nothing is sorted
    bounds = spark.createDataFrame([(name, min(2**63 - 1, int(2**64 * min(1.0, (2 * each + 64) / n)) - 2**63)) for name, n in known.items()], "lang string, bound long")
    seen = F.col("text") if part is None else F.substr("text", (F.pmod("at", F.greatest(F.length("text") - part, F.lit(1))) + 1).cast("int"), F.lit(part))
    drawn = rows.join(F.broadcast(bounds), "lang").where("h <= bound").select("lang", "h", seen.alias("t")).distinct()  # a row per language is broadcast
    sample, taken = [], dict.fromkeys(known, 0)
    for name, h, t in sorted(tuple(r) for r in drawn.collect()):
        if taken[name] < each:
            taken[name] += 1
            sample.append((name, h, t))
    names = sorted(known)
    if not sample:
        return None, []
    data, length, doc = windows_of(TextBlock(pa.array([s[2] for s in sample], pa.string())))
    label = np.array([names.index(s[0]) for s in sample])[doc]
    return train(data, length, label, len(names)), names


def predict(docs: DataFrame, net: Network | None, names: list[str], text: str = "text", key: str = "doc_id", unknown: str = "und") -> DataFrame:
    """Per row: the key, ``lang_pred`` and ``score``, the document's probability of that language.

    Without text, a letter, or any language learned: ``und`` and a score of 0. Equal
    probabilities go to the first name in order. Null or repeated keys are rows like
    any other; only key and text are read. One pass, no shuffle; the network (a few
    thousand numbers) goes to every task.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    kind = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            found, score = [unknown] * block.n, np.zeros(block.n)
            if net is not None:
                probs = pooled(net, block)
                top = probs.argmax(axis=1)
                ok = lettered(block)
                found = [names[c] if k else unknown for c, k in zip(top.tolist(), ok.tolist())]
                score = np.where(ok, np.clip(probs.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string()), pa.array(score)], ["key", "lang_pred", "score"])

    return named.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the key as text leaves 1 when divided by 3. Null keys are held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, names = fit(docs, ~held_out())
    return predict(docs, net, names).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
