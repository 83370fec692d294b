"""Language-model scoring by context-tree weighting.

Each byte is eight binary decisions; for each of the 255 prefixes of a byte there is a tree over
the preceding bytes, up to ``DEPTH``. A node estimates its next bit by Krichevsky-Trofimov from
its counts and mixes this, half and half by prior, with what its children estimate. With the
counts of the training texts fixed, a byte's probability is a product of eight mixtures over all
depths: p = w0 kt0 + (1 - w0)(w1 kt1 + (1 - w1)(...)).

The corpus enters through exact counts of (context of five bytes, next byte), gathered over all
texts: those to be scored take part with count 0, so that every byte to be scored has its entry.

1. Texts are packed into chunks of about ``PACK`` bytes, written once, as many rows of at most some
   100 KB (large rows would fill the JVM's heap). Each chunk sends its distinct grams and words with their counts, in blocks by the three bytes next to the predicted
   one (words: by hash). The number of blocks follows the bytes of the texts.
2. A bucket merges its blocks and remembers where each chunk's keys are. It holds whole subtrees,
   so weights are computed bottom-up inside it, some subtrees at a time; only depth 0 to 2 (the
   pairs of bytes that occur, 65,536 at most, with 255 nodes each) meet on the driver.
3. Each bucket answers every chunk with the log probabilities of the chunk's own grams, in the
   order in which they were sent. A chunk meets its answers by number and is scored at once.

No table of the corpus is broadcast or collected, and the texts are read three times at any size.

A text is preceded by five 0xFF bytes and ended by one, which is coded too (0xFF is not in UTF-8).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

U = np.uint64
DEPTH = 5
TOP = 3
GRAM, WORD = 0, 1
#: Bytes of text in a chunk (a longer text is a chunk of its own).
PACK = 8_000_000
#: Bytes of text in a row of a chunk.
PIECE = 400_000
#: Keys held before equal ones are merged.
HELD = 1_500_000
#: Bytes of text for each bucket, and at most two to this power buckets.
SHARE, MOST_BITS = 16_000_000, 20
#: Keys whose subtrees are computed at once (more, if one subtree has more).
SLICE = 100_000
LOG10_2 = np.log10(2.0)

#: id: of the partition (23 bits), the chunk (24) and the row (16 bits).
CHUNKS = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("texts", pa.list_(pa.binary()))])
CHUNKS_DDL = "id long, size long, ids array<long>, learn array<boolean>, texts array<binary>"
ROW_BITS = 16
ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_DDL = "kind int, bucket int, chunk long, keys binary, counts binary"
TABLE = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("total", pa.int64()), ("seen", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("chunks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])
TABLE_DDL = "kind int, bucket int, total long, seen long, keys binary, counts binary, chunks array<long>, places array<binary>"
ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("values", pa.binary())])
ANSWER_DDL = "kind int, bucket int, chunk long, values binary"


# --- bytes to counts --------------------------------------------------------------------------


def layout(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes of all texts, start of each, and which bytes are coded (text and its end)."""
    buf = np.frombuffer(b"\xff" * DEPTH + (b"\xff" * (DEPTH + 1)).join(docs) + b"\xff", np.uint8)
    start = DEPTH + np.cumsum([0, *(len(d) + DEPTH + 1 for d in docs[:-1])])
    coded = np.ones(len(buf), bool)
    for k in range(1, DEPTH + 1):
        coded[start - k] = False
    return buf, start, coded


def grams(buf: np.ndarray) -> np.ndarray:
    """For each byte from number DEPTH on: preceding bytes, the nearest foremost, then the byte."""
    n = len(buf) - DEPTH
    out = buf[DEPTH:].astype(U)
    for k in range(1, DEPTH + 1):
        out |= buf[DEPTH - k : DEPTH - k + n].astype(U) << U(8 * (DEPTH + 1 - k))
    return out


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, off = C.joined(docs)
    buf = C.LOWER[buf]
    s, e, first = C.word_spans(buf, off, C.NON_SPACE)
    return C.span_hash(C.prefix_hash(buf), s, e) if len(s) else np.zeros(0, U), first


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def bucket_of(kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """Grams by their TOP nearest context bytes, words by their hash."""
    return ((C.mix64(keys >> U(8 * (DEPTH + 1 - TOP))) if kind == GRAM else keys) >> U(64 - bits)).astype(np.int64)


def pack(docs: DataFrame, limit: int = PACK) -> DataFrame:
    """(doc_id, text, learn) in chunks, several rows each: numbers that are unique in the written
    table, ids, texts."""

    def run(batches):
        chunk, row, size = TaskContext.get().partitionId() << 24, 0, 0
        for b in C.packed(batches, limit=min(limit, PIECE)):
            n = b.column(1).nbytes
            if row and (size + n > limit or row + 1 >> ROW_BITS):
                chunk, row, size = chunk + 1, 0, 0
            yield C.batch(CHUNKS, [chunk << ROW_BITS | row], [n], [b.column(0).to_pylist()], [[bool(x) for x in b.column(2).to_pylist()]], [C.texts(b.column(1))])
            row, size = row + 1, size + n

    return C.materialize(docs.mapInArrow(run, CHUNKS_DDL))


def keys_of(texts: list[bytes], learn: list[bool]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of a chunk, sorted, and how often the texts to learn from have them."""
    held, n = {GRAM: [], WORD: []}, 0
    at, size = 0, np.cumsum([0, *(len(t) + 16 for t in texts)])
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(size, size[at] + C.CHUNK // 2, "right")) - 1)
        for flag in (True, False):
            own = [t for t, x in zip(texts[at:stop], learn[at:stop], strict=True) if x == flag]
            if not own:
                continue
            buf, _, coded = layout(own)
            for kind, keys in ((GRAM, grams(buf)[coded[DEPTH:]]), (WORD, word_hashes(own)[0])):
                k, c = np.unique(keys, return_counts=True)
                held[kind].append((k, c * flag))
                n += len(k)
        if n > HELD:
            held = {kind: [merge(parts)] for kind, parts in held.items()}
            n = sum(len(x[0][0]) for x in held.values()) // 2
        at = stop
    return {kind: merge(parts) for kind, parts in held.items()}


def in_buckets(kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, then key; buckets that occur; and where each begins and the last ends."""
    b = bucket_of(kind, keys, bits)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange((1 << bits) + 1))
    there = np.flatnonzero(np.diff(cut))
    return order, there, np.append(cut[there], len(keys))


def ask(chunks: DataFrame, bits: int) -> DataFrame:
    """Keys and counts of every chunk, one row for each kind and bucket that it has."""

    def out(chunk, learn, texts):
        for kind, (keys, counts) in keys_of(texts, learn).items():
            order, there, cut = in_buckets(kind, keys, bits)
            keys, counts = keys[order], counts[order].astype(np.int32)
            spans = [slice(s, e) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield C.batch(ASKED, np.full(len(there), kind), there, np.full(len(there), chunk), pa.array([C.planes(keys[x]) for x in spans], pa.binary()), pa.array([C.planes(counts[x]) for x in spans], pa.binary()))

    def run(batches):
        # should tasks share a file, and so a chunk, each of its parts is asked for by its first row
        at, last, learn, texts = None, None, [], []
        for b in batches:
            for row, some_learn, some in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if at is not None and row != last + 1:
                    yield from out(at, learn, texts)
                    at, learn, texts = None, [], []
                at, last = row if at is None else at, row
                learn += some_learn
                texts += some
        if at is not None:
            yield from out(at, learn, texts)
        C.trim()

    return chunks.select("id", "learn", "texts").mapInArrow(run, ASKED_DDL)


def gather(chunks: DataFrame, bits: int) -> DataFrame:
    """One row for each kind and bucket: its keys with the counts of the whole corpus, and for each
    chunk the places of its keys."""

    def unite(batches):
        at, rows = None, []

        def out():
            every = np.concatenate([C.unplanes(k, U) for _, k, _ in rows])
            every.sort()
            every = every[np.concatenate(([True], every[1:] != every[:-1]))]
            counts, places = np.zeros(len(every), np.int64), []
            for _, k, c in rows:
                place = np.searchsorted(every, C.unplanes(k, U))
                counts[place] += C.unplanes(c, np.int32)
                places.append(C.planes(place.astype(np.int32)))
            return C.batch(TABLE, [at[0]], [at[1]], [int(counts.sum())], [int((counts > 0).sum())], pa.array([C.planes(every)], pa.binary()), pa.array([C.planes(counts)], pa.binary()), [[x for x, _, _ in rows]], pa.array([places], pa.list_(pa.binary())))

        for b in batches:
            for kind, bucket, *row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at is not None and at != (kind, bucket):
                    yield out()
                    rows = []
                at = (kind, bucket)
                rows.append(row)
        if at is not None:
            yield out()
        C.trim()

    return C.materialize(ask(chunks, bits).repartition(C.tasks(bits, 4), "kind", "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(unite, TABLE_DDL))


# --- the tree ---------------------------------------------------------------------------------


def log_gamma(z: np.ndarray) -> np.ndarray:
    """For z > 0, to about 1e-12."""
    prod = np.ones_like(z)
    for k in range(8):
        prod = prod * (z + k)
    y = z + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(prod)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a zeros and b ones under the Krichevsky-Trofimov estimator."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)


def slices(keys: np.ndarray, size: int = SLICE):
    """Slices of sorted grams of about so many, none cutting a subtree of depth TOP."""
    if len(keys):
        tree = keys >> U(8 * (DEPTH + 1 - TOP))
        head = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        head = head[np.concatenate(([True], head[1:] // size != head[:-1] // size))]
        yield from (slice(s, e) for s, e in zip(head, [*head[1:], len(keys)], strict=True))


class Subtrees:
    """Counts and weights of the nodes of depth TOP to DEPTH over some grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        self.rows, self.up = [None] * (DEPTH + 1), [None] * (DEPTH + 1)  # up[d]: row of depth d for each row of depth d + 1
        self.rows[DEPTH] = (keys, counts.astype(float))
        for d in range(DEPTH - 1, TOP - 2, -1):
            k, c = self.rows[d + 1]
            # drop the farthest context byte, which stands before the byte itself
            short = ((k >> U(16)) << U(8)) | (k & U(255))
            u, inv = np.unique(short, return_inverse=True)
            self.rows[d], self.up[d] = (u, np.bincount(inv, weights=c, minlength=len(u))), inv
        self.own = {}  # (depth, bit): weight of the node itself, for each row; and P(the row's bit)
        below = [None] * 8
        for d in range(DEPTH, TOP - 1, -1):
            k, c = self.rows[d]
            for j in range(8):
                prefix = k >> U(8 - j)
                head = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
                node = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(k))))
                bit = (k >> U(7 - j)) & U(1)
                n = np.bincount(node, weights=c, minlength=len(head))
                b = np.bincount(node, weights=c * bit, minlength=len(head))
                kt = log_kt(n - b, b)
                if d == DEPTH:
                    w, weight = kt, np.ones(len(head))
                else:
                    child_head, child = below[j]
                    kids = np.bincount(node[self.up[d][child_head]], weights=child, minlength=len(head))
                    w = np.logaddexp(kt, kids) - np.log(2)
                    weight = np.exp(kt - np.log(2) - w)
                below[j] = (head, w)
                bn = np.where(bit == 1, b[node], (n - b)[node])
                self.own[d, j] = (weight[node], (bn + 0.5) / (n[node] + 1))
        self.top = below

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """For depth TOP - 1: number of (context bytes, node) and log weighted probability summed
        over the children among these grams."""
        k, _ = self.rows[TOP]
        where, what = [], []
        for j in range(8):
            head, w = self.top[j]
            x = k[head]
            where.append(((x >> U(16)) * U(256) + (U(1 << j) | ((x & U(255)) >> U(8 - j)))).astype(np.int64))
            what.append(w)
        where, what = np.concatenate(where), np.concatenate(what)
        u, inv = np.unique(where, return_inverse=True)
        return u, np.bincount(inv, weights=what)

    def log10(self, top: dict) -> np.ndarray:
        """Log probability of each gram, given the tables of depth 0 to 2."""
        at = {DEPTH: np.arange(len(self.keys))}
        for d in range(DEPTH - 1, TOP - 1, -1):
            at[d] = self.up[d][at[d + 1]]
        x, c1 = self.keys & U(255), (self.keys >> U(8 * DEPTH)).astype(np.int64)
        pair = top["at"][(self.keys >> U(8 * (DEPTH - 1))).astype(np.int64)]
        total = np.zeros(len(self.keys))
        for j in range(8):
            p = self.own[DEPTH, j][1]
            for d in range(DEPTH - 1, TOP - 1, -1):
                w, kt = self.own[d, j]
                p = w[at[d]] * kt[at[d]] + (1 - w[at[d]]) * p
            node = (U(1 << j) | (x >> U(8 - j))).astype(np.int64)
            bit = ((x >> U(7 - j)) & U(1)) == 1
            for w, one in ((top["w2"][pair, node], top["p2"][pair, node]), (top["w1"][c1, node], top["p1"][c1, node]), (top["w0"][node], top["p0"][node])):
                p = w * np.where(bit, one, 1 - one) + (1 - w) * p
            total += np.log10(p)
        return total


TOPS_DDL = "nodes binary, sums binary, keys binary, counts binary"
TOPS = pa.schema([(c, pa.binary()) for c in ("nodes", "sums", "keys", "counts")])


def mixtures(counts: np.ndarray, kids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts by rows, from the counts of their next bytes and the sums of their children by
    node: log weighted probability, weight of the node itself and its probability of a one."""
    w, weight, one = np.zeros(kids.shape), np.ones(kids.shape), np.full(kids.shape, 0.5)
    for j in range(8):
        node = slice(1 << j, 2 << j)
        half = counts.reshape(len(counts), 1 << j, 2, 128 >> j).sum(3)
        kt = log_kt(half[:, :, 0], half[:, :, 1])
        w[:, node] = np.logaddexp(kt, kids[:, node]) - np.log(2)
        weight[:, node] = np.exp(kt - np.log(2) - w[:, node])
        one[:, node] = (half[:, :, 1] + 0.5) / (half.sum(2) + 1)
    return w, weight, one


def top_tables(blocks_df: DataFrame) -> dict:
    """Weights and probabilities of depth 0 to 2, on the driver: 255 nodes for each pair of bytes
    that occurs (65,536 pairs at most), whose row in the tables is at[pair]."""

    def run(batches):
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, counts = C.unplanes(keys, U), C.unplanes(counts, np.int64)
                for part in slices(keys):
                    t = Subtrees(keys[part], counts[part])
                    yield C.batch(TOPS, *[pa.array([x.tobytes()], pa.binary()) for x in (*t.sums(), t.rows[TOP - 1][0].astype(np.int64), t.rows[TOP - 1][1])])

    at, n, kids, counts = np.full(1 << 16, -1, np.int32), 0, np.zeros((256, 256)), np.zeros((256, 256))
    for r in blocks_df.select("keys", "counts").mapInArrow(run, TOPS_DDL).toLocalIterator():
        nodes, keys = np.frombuffer(r["nodes"], np.int64), np.frombuffer(r["keys"], np.int64)
        new = np.unique(keys >> 8)
        new = new[at[new] < 0]
        at[new] = np.arange(n, n + len(new))
        n += len(new)
        if n > len(kids):
            kids, counts = (np.concatenate([x, np.zeros((2 * n - len(x), 256))]) for x in (kids, counts))
        np.add.at(kids, (at[nodes >> 8], nodes & 255), np.frombuffer(r["sums"], float))
        np.add.at(counts, (at[keys >> 8], keys & 255), np.frombuffer(r["counts"], float))
    log2, w2, p2 = mixtures(counts[:n], kids[:n])
    kids1, counts1 = np.zeros((256, 256)), np.zeros((256, 256))
    pairs = np.flatnonzero(at >= 0)
    np.add.at(kids1, pairs >> 8, log2[at[pairs]])
    np.add.at(counts1, pairs >> 8, counts[at[pairs]])
    log1, w1, p1 = mixtures(counts1, kids1)
    _, w0, p0 = mixtures(counts1.sum(0, keepdims=True), log1.sum(0, keepdims=True))
    return {"at": at, "w2": w2, "p2": p2, "w1": w1, "p1": p1, "w0": w0[0], "p0": p0[0]}


def answers(tables: DataFrame) -> DataFrame:
    """To each chunk and bucket, values of the chunk's keys: log10 probabilities of grams (32-bit
    floats), log10(count + 1) of words (0: not known)."""
    top = tables.sparkSession.sparkContext.broadcast(top_tables(tables.where(F.col("kind") == GRAM)))

    def run(batches):
        for b in batches:
            for kind, bucket, keys, counts, chunks, places in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                keys, counts = C.unplanes(keys, U), C.unplanes(counts, np.int64)
                if kind == GRAM:
                    values = np.concatenate([np.zeros(0, np.float32), *(Subtrees(keys[x], counts[x]).log10(top.value).astype(np.float32) for x in slices(keys))])
                else:
                    values = np.log10(counts + 1.0)
                for k in range(0, len(chunks), 256):
                    some = [C.planes(values[C.unplanes(p, np.int32)]) for p in places[k : k + 256]]
                    yield C.batch(ANSWER, np.full(len(some), kind), np.full(len(some), bucket), chunks[k : k + 256], pa.array(some, pa.binary()))

    return tables.select("kind", "bucket", "keys", "counts", "chunks", "places").mapInArrow(run, ANSWER_DDL)


# --- scoring ----------------------------------------------------------------------------------


PART_DDL = "doc_id long, n_bytes long, n_words long, n_found long, base double, score double"
PART = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("n_found", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])


def lookups(texts: list[bytes], learn: list[bool], answer: list[tuple[int, int, bytes]], bits: int) -> dict:
    """By kind, a lookup of a chunk's mixed keys and the values in its order."""
    out = {}
    for kind, (keys, _) in keys_of(texts, learn).items():
        order, there, _ = in_buckets(kind, keys, bits)
        parts = {bucket: values for k, bucket, values in answer if k == kind}
        values = np.concatenate([np.zeros(0), *(C.unplanes(parts[k], np.float32 if kind == GRAM else np.float64) for k in there.tolist())])
        mixed = C.mix64(keys[order])
        by = np.argsort(mixed)
        out[kind] = C.Lookup(mixed[by]), values[by]
    return out


def summed(chunks: DataFrame, answer: DataFrame, bits: int) -> DataFrame:
    """Sums of the answered values over each text's grams and words."""
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    sent = answer.select("chunk", "kind", "bucket", "values", none("ids", "array<long>"), none("learn", "array<boolean>"), none("texts", "array<binary>"))
    own = chunks.select(F.col("id").alias("chunk"), none("kind", "int"), none("bucket", "int"), none("values", "binary"), "ids", "learn", "texts")
    rows = sent.unionByName(own).repartition(F.shiftright("chunk", ROW_BITS)).sortWithinPartitions("chunk", F.col("kind").isNull())

    def out(answer, ids, learn, texts):
        tables = lookups(texts, learn, answer, bits)
        (gram, logs), (word, known) = tables[GRAM], tables[WORD]
        at, size = 0, np.cumsum([0, *(len(t) + 16 for t in texts)])
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(size, size[at] + C.CHUNK // 2, "right")) - 1)
            some = texts[at:stop]
            buf, start, coded = layout(some)
            val = np.where(coded[DEPTH:], logs[gram(C.mix64(grams(buf)))], 0).astype(np.float64)
            h, first = word_hashes(some)
            found = known[word(C.mix64(h))] if len(h) else np.zeros(0)
            base, hits = (np.concatenate(([0], np.cumsum(x)))[first] for x in (found, found > 0))
            yield C.batch(PART, ids[at:stop], [len(t) for t in some], np.diff(first), np.diff(hits), np.diff(base), np.add.reduceat(val, start - DEPTH))
            at = stop

    def run(batches):
        # the answers to a chunk stand before its first row
        held = [], [], [], []
        for b in batches:
            for kind, bucket, values, *row in zip(*(b.column(k).to_pylist() for k in range(1, 7)), strict=True):
                if kind is not None:
                    if held[3]:
                        yield from out(*held)
                        held = [], [], [], []
                    held[0].append((kind, bucket, values))
                else:
                    for x, y in zip(held[1:], row, strict=True):
                        x.extend(y)
        if held[3]:
            yield from out(*held)
        C.trim()

    return rows.mapInArrow(run, PART_DDL)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, chunk: int = PACK) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens (words and
    one end), n_known, train_tokens, base_score (log10 probability by add-one word counts), score
    (log10 probability of the whole text by the weighted context tree) and bits_per_byte.

    Learns from the rows where ``learn`` is true; null texts are empty (an end only). With nothing
    to learn from, every bit has probability 1/2. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = pack(given, chunk)
    bits = bits or max(4, min(MOST_BITS, int(chunks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // SHARE).bit_length()))
    tables = gather(chunks, bits)
    n_docs = given.where("learn").count()
    n_words, distinct = tables.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    n_train, distinct = n_words + n_docs, distinct + (n_docs > 0)
    out = summed(chunks, answers(tables), bits)
    n_tokens = F.col("n_words") + 1
    log_total = float(np.log10(n_train + distinct + 1.0))
    return out.select(
        "doc_id",
        "n_bytes",
        n_tokens.alias("n_tokens"),
        (F.col("n_found") + int(n_docs > 0)).alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(n_docs + 1.0)) - n_tokens * log_total).alias("base_score"),
        "score",
        (-F.col("score") / LOG10_2 / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
