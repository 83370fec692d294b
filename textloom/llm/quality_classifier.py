"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes, as their eight bits, pass ``FILTERS`` learned filters of ``WIDTH`` bytes at
every ``STRIDE``-th byte. Responses are max-pooled over overlapping chunks of ``CHUNK`` bytes that
cover the whole text; a hidden layer turns each chunk's maxima into features; their mean and their
maximum over all chunks are combined into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

WIDTH, STRIDE, FILTERS, HIDDEN = 8, 2, 24, 16
CHUNK = 256
HALF = CHUNK // 2  # chunks overlap by half
PLACES = HALF // STRIDE
#: Most labelled rows to learn from, shared evenly by the two labels; a hash of the id picks them.
MAX_TRAIN = 2000
EPOCHS = 10
THRESHOLD = 0.3
DDL = "doc_id long, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float32) * 2 - 1
_BITS[0] = 0  # padding


def halves(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded bytes of all texts in half chunks, and the index of each text's first half.
    Every text has two halves at least and ends in WIDTH zeros at least."""
    n = np.array([max(2, -(-(len(d) + WIDTH) // HALF)) for d in docs], np.int64)
    first = np.concatenate(([0], np.cumsum(n)))
    buf = b"".join(d + bytes(int(k) * HALF - len(d)) for d, k in zip(docs, n, strict=True))
    return np.frombuffer(buf + bytes(WIDTH), np.uint8), first


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {
            "filters": r.normal(0, 0.15, (WIDTH * 8, FILTERS)),
            "bias": np.zeros(FILTERS),
            "hidden": r.normal(0, 0.2, (FILTERS + 1, HIDDEN)),
            "hidden_bias": np.zeros(HIDDEN),
            "out": r.normal(0, 0.2, 2 * HIDDEN),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def windows(self, buf: np.ndarray) -> np.ndarray:
        bits = _BITS[buf]
        n = (len(buf) - WIDTH) // STRIDE
        return np.lib.stride_tricks.as_strided(bits, (n, WIDTH * 8), (STRIDE * 32, 4), writeable=False)

    def forward(self, docs: list[bytes], learn: bool = False):
        p = self.p
        buf, first = halves(docs)
        win = np.ascontiguousarray(self.windows(buf))
        conv = (win @ p["filters"]).reshape(-1, PLACES, FILTERS)
        conv[first[1:] - 1, PLACES - WIDTH // STRIDE :] = -1e9  # these windows reach into the next text
        arg = conv.argmax(1) if learn else None
        top = conv.max(1)
        # a chunk is a half and the next one of the same text
        left = np.delete(np.arange(first[-1]), first[1:] - 1)
        second = top[left + 1] > top[left]
        pool = np.where(second, top[left + 1], top[left]) + p["bias"]
        # the last feature tells how much of a chunk a short text fills
        fill = np.minimum(1, np.array([len(d) for d in docs], np.float32) / CHUNK)
        feat = np.concatenate([np.tanh(pool / 4), np.repeat(fill, np.diff(first) - 1)[:, None]], 1)
        pre = feat @ p["hidden"] + p["hidden_bias"]
        hid = np.maximum(pre, 0)
        begin = first[:-1] - np.arange(len(docs))
        count = np.diff(first) - 1
        mean = np.add.reduceat(hid, begin, axis=0) / count[:, None]
        most = np.maximum.reduceat(hid, begin, axis=0)
        both = np.concatenate([mean, most], 1)
        z = both @ p["out"] + p["out_bias"]
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return prob, (win, arg, left, second, feat, pre, hid, count, most, both) if learn else None

    def gradient(self, docs: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        prob, (win, arg, left, second, feat, pre, hid, count, most, both) = self.forward(docs, True)
        dz = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": both.T @ dz, "out_bias": dz.sum(keepdims=True)}
        d = dz[:, None] * p["out"][None]
        of = np.repeat(np.arange(len(docs)), count)
        is_most = hid == most[of]
        dh = (d[:, :HIDDEN] / count[:, None])[of] + d[:, HIDDEN:][of] * is_most * (hid > 0)
        dp = dh * (pre > 0)
        g |= {"hidden": feat.T @ dp, "hidden_bias": dp.sum(0)}
        df = ((dp @ p["hidden"].T) * (1 - feat * feat) / 4)[:, :FILTERS]
        g["bias"] = df.sum(0)
        half = np.where(second, left[:, None] + 1, left[:, None])
        at = half * PLACES + np.take_along_axis(arg, half, 0)
        g["filters"] = np.stack([df[:, f] @ win[at[:, f]] for f in range(FILTERS)], 1)
        return g

    def fit(self, docs: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.006, group: int = 60_000, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = r.permutation(len(docs))
            size = np.cumsum([len(docs[k]) + CHUNK for k in order]) // group
            for k in np.unique(size):
                at = order[size == k]
                g = self.gradient([docs[i] for i in at], y[at], weight[at])
                t += 1
                lr = rate * (1 - epoch / epochs) ** 0.5
                for key, x in g.items():
                    m[key] += 0.1 * (x - m[key])
                    v[key] += 0.01 * (x * x - v[key])
                    self.p[key] -= (lr * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self

    def score(self, docs: list[bytes]) -> np.ndarray:
        """Probability of each text, about 0.25 MB of padded bytes at a time."""
        out, size = np.zeros(len(docs)), np.cumsum([len(d) + CHUNK for d in docs]) // 250_000
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            out[at] = self.forward([docs[i] for i in at])[0]
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Network | None:
    """Learns from at most max_train labelled rows of docs, whole texts; None if there is none or
    only one label. Labels other than 0 and 1 and null ids do not count; of several labels of one
    id the largest counts. Loss weights restore the labels' true shares."""
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = max_train // 2
    bound = F.when(F.col("y") == 1, min(1.0, share / counts[1])).otherwise(min(1.0, share / counts[0]))
    picked = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound * (1 << 30)).orderBy(F.xxhash64("id"), "id").limit(max_train)
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most max_train ids: small enough to broadcast at any size of the tables
    rows = text.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["id"], r["y"], r["text"].encode()) for r in rows)
    y = np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    weight = np.where(y > 0, counts[1] / (y > 0).sum(), counts[0] / (y == 0).sum()).astype(np.float32)
    return Network().fit(*with_pieces([r[2] for r in rows], y, weight))


def with_pieces(docs: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 3):
    """The texts and, so that short texts are learned as well, one short piece of each at a random
    place, with the text's label and a third of its weight."""
    r = np.random.default_rng(seed)
    pieces = []
    for d in docs:
        n = int(r.integers(12, 240))
        at = int(r.integers(0, max(1, len(d) - n + 1)))
        pieces.append(d[at : at + n])
    return docs + pieces, np.concatenate([y, y]), np.concatenate([weight, weight / 3])


def classify(docs: DataFrame, model: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: score (0 to 1), the probability of label 1 by the whole text.

    Null texts count as empty; empty texts get the network's answer to padding. Without a model
    (nothing to learn from) every score is 0.5. Nothing but the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shared.value
        for b in C.packed(batches):
            text = C.texts(b.column(1))
            yield C.batch(SCHEMA, b.column(0), net.score(text) if net else np.full(len(text), 0.5))

    return C.id_text(docs, id_col, text_col).mapInArrow(run, DDL)


def keep(docs: DataFrame, model: Network | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs, all columns, whose score reaches the threshold; all rows without a model."""
    if model is None:
        return docs
    C.small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for b in C.packed(batches, at):
            yield b.filter(pa.array(shared.value.score(C.texts(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return C.crc_mod(id_col, 5) == 0
