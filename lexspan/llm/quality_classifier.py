"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` bytes, all of its text. Each passage is
encoded (tanh layer over the frequencies of its pairs of byte classes and of repeated
words); gated attention, ``softmax(w . (tanh(V h) * sigmoid(U h)))`` over the bag, weighs
the encodings; the weighted sum is the document's representation, which a logistic
output scores. Everything is learned together from document labels, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.blocks import SPACED, TextBlock, numbered, quoted, text_blocks, word_hashes
from lexspan.llm.language_id import held_out
from lexspan.session import ship, table

PASSAGE = 256
#: The training sample: at most so many labelled rows, chosen by hash, ...
TRAIN_ROWS = 4000
#: ... and so many passages of each, evenly spaced.
TRAIN_PASSAGES = 48
HIDDEN, ATTENTION = 16, 8

_CLASS = np.full(256, 15, np.int64)
for _i, _group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",;:", "!?", "'\"()[]", "-_/", "#*$%&", "|<>", "=+@~^`\\{}"]):
    _CLASS[[ord(_c) for _c in _group]] = _i
_CLASS[0x80:] = 13
_CLASS[0xC3] = 14
FEATURES = 16 * 16 + 2


def passages(block: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and each document's first passage (n + 1 of them). An empty text has one passage of zeros."""
    n = np.maximum(1, -(-block.lengths // PASSAGE))
    firsts = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros((firsts[-1], FEATURES), np.float32)
    if len(block.data):
        doc = np.repeat(np.arange(block.n), block.lengths)
        place = np.arange(len(block.data)) - block.starts[:-1][doc]
        owner = firsts[doc] + place // PASSAGE
        kind = _CLASS[block.data]
        same = owner[1:] == owner[:-1]
        pairs = np.bincount((owner[1:] * 256 + kind[1:] * 16 + kind[:-1])[same], minlength=firsts[-1] * 256)
        out[:, :256] = pairs.reshape(-1, 256)
        starts, ends, _ = block.words(SPACED)
        words = word_hashes(block.data, starts, ends)
        home = owner[starts]
        total = np.bincount(home, minlength=firsts[-1])
        for column, back in ((256, 1), (257, 2)):
            if len(words) > back:
                again = (words[back:] == words[:-back]) & (home[back:] == home[:-back])
                out[:, column] = np.bincount(home[back:][again], minlength=firsts[-1])
        size = np.maximum(out[:, :256].sum(axis=1, keepdims=True), 1)
        out[:, :256] = np.sqrt(out[:, :256] / size)
        out[:, 256:] = np.sqrt(out[:, 256:] / np.maximum(total, 1)[:, None])
    return out, firsts


class Bags:
    """The network: encoder, gated attention, output. Small first weights, so that signs never seen in training say little."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = [draw(FEATURES, HIDDEN, scale=0.02), np.zeros(HIDDEN, np.float32), draw(HIDDEN, ATTENTION, scale=0.3), draw(HIDDEN, ATTENTION, scale=0.3), draw(ATTENTION, scale=0.3), draw(HIDDEN, scale=0.3), np.zeros(1, np.float32)]

    def forward(self, x: np.ndarray, firsts: np.ndarray):
        w, b, v, u, a, c, bias = self.p
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (tv * su) @ a
        bag = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        e = np.exp(e - np.maximum.reduceat(e, firsts[:-1])[bag])
        weight = e / np.add.reduceat(e, firsts[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, firsts[:-1])
        return 1 / (1 + np.exp(-np.clip(z @ c + bias, -30, 30))), (h, tv, su, weight, z, bag)

    def gradients(self, x: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, c, bias = self.p
        score, (h, tv, su, weight, z, bag) = self.forward(x, firsts)
        d = (score - y) / len(y)
        dz = d[:, None] * c
        dh = weight[:, None] * dz[bag]
        dw = (h * dz[bag]).sum(axis=1)  # by attention weight
        de = weight * (dw - np.add.reduceat(weight * dw, firsts[:-1])[bag])
        dg = de[:, None] * a
        dv, du = dg * su * (1 - tv**2), dg * tv * su * (1 - su)
        dh += dv @ v.T + du @ u.T
        dx = dh * (1 - h**2)
        return [x.T @ dx, dx.sum(axis=0), h.T @ dv, h.T @ du, (tv * su).T @ de, z.T @ d, np.array([d.sum()])]


def train(x: np.ndarray, firsts: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.03) -> Bags:
    """Adam over the whole sample, with a little weight decay."""
    net = Bags()
    mean, square = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, rounds + 1):
        for p, g, m, s in zip(net.p, net.gradients(x, firsts, y), mean, square):
            g = g + 1e-5 * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, text: str = "text", key: str = "doc_id", label: str = "quality", passages_each: int | None = TRAIN_PASSAGES) -> Bags | None:
    """Train on labelled rows of ``docs``, drawn by hash of their key from the rows of ``labels`` where ``learn_from`` holds.

    At most ``TRAIN_ROWS`` labels and, where keys are repeated, twice as many documents, the
    first by hash of key and text. Null keys and labels teach nothing; repeated labels count
    as often as they stand. Of longer texts the fit sees ``passages_each`` passages, spread evenly,
    or all where it is null. Without any labelled row there is no network.
    """
    ship(docs.sparkSession)
    drawn = labels.where(learn_from & labels[quoted(label)].isNotNull() & labels[quoted(key)].isNotNull()).select(labels[quoted(key)].alias("k"), labels[quoted(label)].cast("int").alias("y")).orderBy(F.xxhash64("k", F.lit(9)), "k", "y").limit(TRAIN_ROWS)
    own = docs.select(docs[quoted(key)].alias("k"), docs[quoted(text)].alias("text"))
    sample = own.join(F.broadcast(drawn), "k").select("y", "text", F.xxhash64("k", "text").alias("h"))  # at most TRAIN_ROWS rows are broadcast

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            x, firsts = passages(block)
            bags = []
            for a, b in zip(firsts[:-1], firsts[1:]):
                own = x[a:b] if passages_each is None or b - a <= passages_each else x[a + np.linspace(0, b - a - 1, passages_each).astype(int)]
                bags.append(own.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), pa.array(bags, pa.binary())], ["y", "h", "bag"])

    rows = sorted((r["y"], bytes(r["bag"])) for r in sample.mapInArrow(encode, "y int, h long, bag binary").orderBy("h", "y").limit(2 * TRAIN_ROWS).collect())
    if not rows:
        return None
    bags = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, b in rows]
    return train(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), np.array([y for y, _ in rows], np.float32))


def scores(net: Bags | None, block: TextBlock) -> np.ndarray:
    if net is None:
        return np.full(block.n, 0.5)
    x, firsts = passages(block)
    return net.forward(x, firsts)[0].astype(np.float64)


def score(docs: DataFrame, net: Bags | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: the key and ``score``, the probability of label 1. Null and empty texts are scored as an empty passage.

    Without any labelled row every score is 0.5. Null or repeated keys are rows like
    any other; only key and text are read. One pass, no shuffle.
    """
    ship(docs.sparkSession)
    named = docs.select(docs[quoted(key)].alias("key"), docs[quoted(text)].alias("text"))
    kind = named.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores(net, block))], ["key", "score"])

    return named.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, net: Bags | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with a score of ``threshold`` or more.

    Null and empty texts are scored as an empty passage; repeated rows are judged alike, and
    an empty table stays empty. Without a network every score is 0.5.
    """
    ship(docs.sparkSession)
    at = f"c{docs.columns.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches, at):
            yield batch.filter(pa.array(scores(net, block) >= threshold))

    told = numbered(docs)
    return told.mapInArrow(run, told.schema).toDF(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
