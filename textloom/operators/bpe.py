"""Byte-pair encoding: all distinct words are counted in Spark and take part in learning, texts are
encoded in Arrow batches. A word table of at most ``ON_DRIVER`` words is learned from on the driver;
a larger one stays in Spark, and only its pair counts (at most the vocabulary squared) are fetched
for each batch of merges. Both ways give the same merges."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import io

SPECIALS = ("<PAD>", "<BOS>", "<EOS>", "<UNK>")
PIECE = r" ?[A-Za-z\x{80}-\x{10ffff}]+| ?[0-9]+| ?[^\sA-Za-z0-9\x{80}-\x{10ffff}]+|\s+"
#: Distinct words up to which merges are learned on the driver; more are learned from in Spark.
ON_DRIVER = 200_000
#: Words of a packed block, and merges after which the blocks are written anew.
BLOCK_WORDS, RENEW = 50_000, 64
BLOCKS_DDL = "n_words long, n binary, symbols binary"
PAIRS_DDL = "a int, b int, n long"


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def learn(counts: list[tuple[bytes, int]], vocab_size: int) -> list[tuple[bytes, bytes]]:
    """Merges, most frequent pair first (ties: the smaller pair), until the vocabulary is full.
    Only words that hold the merged pair are looked at again."""
    words = [[bytes([b]) for b in w] for w, _ in counts]
    n = [c for _, c in counts]
    pairs: Counter = Counter()
    where: dict[tuple, set[int]] = defaultdict(set)
    for k, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += n[k]
            where[p].add(k)
    merges = []
    while len(merges) + 256 + len(SPECIALS) < vocab_size and pairs:
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        merges.append(best)
        for k in where.pop(best):
            w = words[k]
            for p in zip(w, w[1:], strict=False):
                pairs[p] -= n[k]
                if pairs[p] <= 0:
                    del pairs[p]
            words[k] = w = _merged(w, best)
            for p in zip(w, w[1:], strict=False):
                pairs[p] += n[k]
                where[p].add(k)
        pairs.pop(best, None)
    return merges


def _merged(w: list[bytes], pair: tuple[bytes, bytes]) -> list[bytes]:
    out, i = [], 0
    while i < len(w):
        if i + 1 < len(w) and (w[i], w[i + 1]) == pair:
            out.append(w[i] + w[i + 1])
            i += 2
        else:
            out.append(w[i])
            i += 1
    return out


class Encoder:
    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {p: i for i, p in enumerate(merges)}
        names = [s.encode() for s in SPECIALS] + [bytes([b]) for b in range(256)] + [a + b for a, b in merges]
        self.names, self.ids = names, {}
        for i, t in enumerate(names[len(SPECIALS) :], len(SPECIALS)):
            self.ids.setdefault(t, i)
        self.cache: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        if word not in self.cache:
            if len(self.cache) > 100_000:
                self.cache.clear()
            w = [bytes([b]) for b in word.encode()]
            while len(w) > 1:
                pair = min(zip(w, w[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
                if pair not in self.rank:
                    break
                w = _merged(w, pair)
            self.cache[word] = [self.ids[t] for t in w]
        return self.cache[word]

    def decode(self, ids) -> str:
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")


def _pack(batches):
    """(word, n) to blocks: counts, and 32-bit symbols with -1 after each word."""
    for b in batches:
        words = [np.frombuffer(w.encode(), np.uint8) for w in b.column(0).to_pylist()]
        size = np.array([len(w) + 1 for w in words], np.int64)
        symbols = np.full(int(size.sum()), -1, np.int32)
        keep = np.ones(len(symbols), bool)
        keep[np.cumsum(size) - 1] = False
        symbols[keep] = np.concatenate([*words, np.zeros(0, np.uint8)])
        yield _batch(BLOCKS_DDL, [len(words)], [b.column(1).to_numpy().astype(np.int64).tobytes()], [symbols.tobytes()])


def _batch(ddl: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in ddl.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _apply(symbols: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Symbols after merging (a, b, new) one after the other, leftmost first in a run of equal ones."""
    for a, b, new in merges:
        at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
        if not len(at):
            continue
        if a == b:
            head = np.concatenate(([True], at[1:] != at[:-1] + 1))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
        symbols = symbols.copy()
        symbols[at] = new
        symbols = np.delete(symbols, at + 1)
    return symbols


def _blocks(batches):
    for b in batches:
        for size, n, symbols in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            yield size, n, np.frombuffer(symbols, np.int32)


def _choose(table: list[tuple[int, int, int]], names: list[bytes], room: int) -> list[tuple[int, int]]:
    """Leading merges that are certain from the pair counts (a, b, n): learning one by one would
    take the same. A merge takes from pairs that end in its left or begin with its right symbol, and
    its new symbol's pairs count no more than these or itself; the batch ends where that matters."""
    before, after = defaultdict(int), defaultdict(int)
    for a, b, n in table:
        before[b], after[a] = max(before[b], n), max(after[a], n)
    out, lefts, rights, bound, known = [], set(), set(), 0, set(names)
    for a, b, n in sorted(table, key=lambda r: (-r[2], names[r[0]], names[r[1]])):
        if len(out) == room or n < 2 or n <= bound or a in rights or b in lefts:
            break
        out.append((a, b))
        lefts.add(a)
        rights.add(b)
        bound = max(bound, min(n, max(before[a], after[b])))
        if names[a] + names[b] in known:  # the symbol's pairs exist already and may grow
            break
        known.add(names[a] + names[b])
    return out


def learn_in_spark(words: DataFrame, vocab_size: int, block: int = BLOCK_WORDS, renew: int = RENEW) -> list[tuple[bytes, bytes]]:
    """The merges of learn() for a table (word, n) of any size, which stays in Spark."""
    spark = words.sparkSession
    names = [bytes([b]) for b in range(256)]
    ids = {t: i for i, t in enumerate(names)}
    merges, fresh = [], []

    def merged(todo):
        def run(batches):
            for size, n, symbols in _blocks(batches):
                yield _batch(BLOCKS_DDL, [size], [n], [_apply(symbols, todo).tobytes()])

        return run

    def pairs(todo):
        def run(batches):
            for _, n, symbols in _blocks(batches):
                s = _apply(symbols, todo)
                weight = np.frombuffer(n, np.int64)[np.cumsum(s == -1) - (s == -1)]
                at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                key, which = np.unique((s[at].astype(np.int64) << 32) | s[at + 1], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, which, weight[at])
                yield _batch(PAIRS_DDL, (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), total)

        return run

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(block))
    try:
        state = io.materialize(words.select("word", "n").mapInArrow(_pack, BLOCKS_DDL))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    while (room := vocab_size - len(merges) - 256 - len(SPECIALS)) > 0:
        if len(fresh) >= renew:
            old, state, fresh = state, io.materialize(state.mapInArrow(merged(list(fresh)), BLOCKS_DDL)), []
            io.discard(old)
        table = state.mapInArrow(pairs(list(fresh)), PAIRS_DDL).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
        chosen = _choose(list(zip(*(table.column(k).to_pylist() for k in range(3)), strict=True)), names, room)
        if not chosen:
            break
        for a, b in chosen:
            merges.append((names[a], names[b]))
            new = ids.setdefault(names[a] + names[b], len(names))
            if new == len(names):
                names.append(names[a] + names[b])
            fresh.append((a, b, new))
    io.discard(state)
    return merges


def train(df: DataFrame, text_col: str, vocab_size: int = 8000, on_driver: int = ON_DRIVER) -> list[tuple[bytes, bytes]]:
    words = word_counts(df, text_col).persist()
    try:
        few = words.limit(on_driver + 1).collect()
        if len(few) > on_driver:
            return learn_in_spark(words, vocab_size)
        return learn([(r["word"].encode(), r["n"]) for r in few], vocab_size)
    finally:
        words.unpersist()


def encode(spark: SparkSession, text: Column, merges: list[tuple[bytes, bytes]]) -> Column:
    """array<int> of the text; null for null. Encoding is lossless."""
    shared = spark.sparkContext.broadcast(merges)

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        e = Encoder(shared.value)
        return words.map(lambda ws: None if ws is None else [i for w in ws for i in e.word(w)])

    return run(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def decode(spark: SparkSession, ids: Column, merges: list[tuple[bytes, bytes]]) -> Column:
    shared = spark.sparkContext.broadcast(merges)

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        e = Encoder(shared.value)
        return x.map(lambda ids: None if ids is None else e.decode(ids))

    return run(ids)


def save(spark: SparkSession, merges: list[tuple[bytes, bytes]], path: str) -> None:
    rows = [(i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, left binary, right binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[tuple[bytes, bytes]]:
    return [(bytes(r["left"]), bytes(r["right"])) for r in spark.read.parquet(path).orderBy("rank").collect()]


def vocabulary_size(merges) -> int:
    return len(SPECIALS) + 256 + len(merges)
