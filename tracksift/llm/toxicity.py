"""Toxicity: subword-bag embeddings, averaged, into a linear softmax; trained jointly in numpy.

A text is lower-cased (ASCII) and every other character than letters and digits becomes a space. Its
features are the byte n-grams (3 to 5) of words with one space on either side, hashed into BUCKETS
embeddings of DIM numbers. The embeddings of a window of WINDOW words are averaged and a linear softmax
gives its class; a text's score is its most toxic window's, so a long text with one insult isn't
diluted. Training drops a share of the n-grams at random, so weight spreads over a word's n-grams and
an unseen misspelling, which shares some, is still found.

At scoring, each n-gram adds one number (embedding times weights), so whole texts are scored by prefix
sums over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.session import ship

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 12, 6
THRESHOLD = 0.3
#: The training sample: at most so many labelled rows of each label, and bytes of their whole texts.
TRAIN_ROWS, TRAIN_BYTES = 3000, 5_000_000
HELD_OUT = 2
_EPOCHS, _BATCH, _DROP = 14, 64, 0.4

_FOLD = W.LOWER.copy()
_FOLD[np.setdiff1d(np.arange(128), [*range(48, 58), *range(65, 91), *range(97, 123)])] = 32


class Grams(NamedTuple):
    """Buckets of the n-grams at each position, by n (-1: none), and the words of a block."""

    bucket: np.ndarray
    word_from: np.ndarray
    word_to: np.ndarray
    first: np.ndarray


def grams(off: np.ndarray, data: np.ndarray) -> Grams:
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    c = np.full(len(data) + n + 1 + max(GRAMS), 32, np.uint32)
    c[np.arange(len(data)) + row + 1] = _FOLD[data]
    size = len(data) + n + 1
    blank = c == 32
    before = np.concatenate([[0], np.cumsum(blank)])
    out = np.full((len(GRAMS), size), -1, np.int32)
    with np.errstate(over="ignore"):
        for k, m in enumerate(GRAMS):
            h = np.full(size, np.uint32(m * 0x9E3779B1 & 0xFFFFFFFF))
            for j in range(m):
                h = (h ^ c[j : j + size]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
            whole = before[m - 1 : m - 1 + size] == before[1 : 1 + size]
            out[k] = np.where(whole, (h & np.uint32(BUCKETS - 1)).astype(np.int32), -1)
    ink = ~blank[:size]
    start = np.flatnonzero(ink & np.append(True, ~ink[:-1]))
    end = np.flatnonzero(ink & np.append(~ink[1:], True)) + 1
    return Grams(out, start - 1, end, np.searchsorted(start, off + np.arange(n + 1)))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the words of each row: first word, last word + 1, row. A row without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    lo = first[row] + STRIDE * W.ragged(np.zeros(len(n), np.int64), count)
    return lo, np.minimum(lo + WINDOW, first[row + 1]), row


class Model(NamedTuple):
    """value: each bucket's part in the logit of class 1 against class 0; bias: the rest."""

    value: np.ndarray
    bias: float


def window_logits(m: Model, g: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Logit and row of every window."""
    value = np.append(m.value, np.float32(0))
    total = np.zeros(g.bucket.shape[1] + 1)
    count = np.zeros(g.bucket.shape[1] + 1)
    np.cumsum(value[g.bucket].sum(axis=0), out=total[1:])
    np.cumsum((g.bucket >= 0).sum(axis=0), out=count[1:])
    lo, hi, row = windows(g.first)
    a, b = g.word_from[lo], g.word_to[hi - 1]
    return (total[b] - total[a]) / np.maximum(count[b] - count[a], 1) + m.bias, row


def scores(m: Model, off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A score for each row: its most toxic window's; without words, that of the bias alone."""
    logit, row = window_logits(m, grams(off, data))
    top = np.full(len(off) - 1, m.bias)
    if len(row):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        top[row[at]] = np.maximum.reduceat(logit, at)
    return 1 / (1 + np.exp(-np.clip(top, -50, 50)))


def train(texts: list[str], labels: list[int], seed: int = 1) -> Model:
    """Joint training of embeddings and softmax (AdaGrad). No rows, or rows of one label: their share as bias."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    if len(set(labels)) < 2:
        return flat
    rng = np.random.default_rng(seed)
    raw = pa.array([t or "" for t in texts], pa.large_string())
    off, data = W.buffers(raw)
    g = grams(off - off[0], data[off[0] : off[-1]])
    lo, hi, row = windows(g.first)
    a, b = g.word_from[lo], g.word_to[hi - 1]
    has = np.bincount(row, minlength=len(y)) > 0
    first = np.searchsorted(row, np.arange(len(y) + 1))
    emb = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[-1] = 0
    soft = rng.normal(0, 0.5, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    emb_sq, soft_sq, bias_sq = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def model() -> Model:
        return Model((emb[:-1] @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))

    docs = np.flatnonzero(has)
    for epoch in range(_EPOCHS):
        # windows to learn from: at first any of the row, later the row's most toxic one
        logit = window_logits(model(), g)[0]
        for part in np.array_split(rng.permutation(docs), max(1, len(docs) // _BATCH)):
            picks = []
            for d in part:
                i, j = first[d], first[d + 1]
                if epoch < 4:
                    picks.append(rng.integers(i, j, 6) if j - i > 6 else np.arange(i, j))
                else:
                    top = i + np.argmax(logit[i:j])
                    picks.append(np.array([top] if y[d] else [top, rng.integers(i, j)]))
            at = np.concatenate(picks)
            buckets = g.bucket[:, W.ragged(a[at], b[at] - a[at])]
            owner = np.broadcast_to(np.repeat(np.arange(len(at)), b[at] - a[at]), buckets.shape)
            keep = (buckets >= 0) & (rng.random(buckets.shape) >= _DROP)
            bucket, owner = buckets[keep], owner[keep]
            n = np.maximum(np.bincount(owner, minlength=len(at)), 1).astype(np.float32)
            mean = np.stack([np.bincount(owner, emb[bucket, k], minlength=len(at)) for k in range(DIM)], axis=1).astype(np.float32) / n[:, None]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[row[at]]] -= 1
            p /= len(part)
            back = (p @ soft) / n[:, None]
            grad = np.stack([np.bincount(bucket, back[owner, k], minlength=BUCKETS) for k in range(DIM)], axis=1).astype(np.float32)
            g_soft, g_bias = p.T @ mean, p.sum(axis=0)
            emb_sq += grad**2
            soft_sq += g_soft**2
            bias_sq += g_bias**2
            emb[:-1] -= 0.4 * grad / np.sqrt(emb_sq)
            soft -= 0.1 * g_soft / np.sqrt(soft_sq)
            bias -= 0.1 * g_bias / np.sqrt(bias_sq)
    return model()


def held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text, modulo 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """The bounded training sample: of each label the first rows by a hash of the id, whole texts, up to the byte bound."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    picks = None
    for value in (0, 1):
        own = known.where(F.col("y") == value).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
        picks = own if picks is None else picks.unionByName(own)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picks), "id").where("text is not null")
    rows = rows.withColumn("size", F.octet_length("text")).where(F.col("size") <= TRAIN_BYTES)
    so_far = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    got = rows.withColumn("bytes", so_far).where(F.col("bytes") <= TRAIN_BYTES).select("text", "y").toArrow()
    return got["text"].to_pylist(), got["y"].to_pylist()


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Each row's id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Learns from labelled rows that aren't held out; labels other than 0 and 1, null labels and null texts
    teach nothing, and an id with both labels teaches both. Null and empty texts and texts without
    letters or digits get the bias's score. Without any labels all scores are 0.5's near: the bias of no
    evidence. Rows that repeat are scored alike. An empty table gives no rows. Only text is an input.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(*sample(docs, labels, id_col, text_col, label_col)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in W.blocks(batch.column(2)):
                s = scores(model.value, off, data)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(scan, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
