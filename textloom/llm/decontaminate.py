"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (lower-case A-Z; runs of digits, letters a-z and non-ASCII characters) become
small integers and go into one generalised suffix automaton. Documents stream through it: after
each word the automaton gives the longest suffix that occurs in some item. A suffix of at least
``window`` words hits all its words; an item of fewer words hits where it occurs whole.

Words that no item has, and pairs of neighbours that no item has, reset the match, so only runs
of known pairs that are long enough to hold a hit are streamed; the result is the same.

Items of up to ``block_words`` words together are one automaton, and one pass does all. More are
dealt to blocks of about that size by hash; then one pass over all documents looks up every window
in a bitmap of the items' windows (``MOST_BITS`` at most), and only documents with a window that may
occur go through the blocks' automata, one after the other. So what the driver holds and broadcasts
is bounded, and the whole table is read once, whatever the number of items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

WINDOW = 13
BLOCK_WORDS = 200_000
#: At most two to this power bits (128 MB) tell which windows may occur.
MOST_BITS = 30
#: A document is contaminated if the words hit are at least 1 / COVERAGE of its words.
COVERAGE = 20


class SuffixAutomaton:
    """Of several word sequences; states know the items that contain their words."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[set] = [set()]
        self.added: list[tuple] = []
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (item, words) that end there whole

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q that is reached by words of length(p) + 1 at most."""
        c = self._state(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def add(self, item, words: list[int], window: int) -> None:
        """States may be split by later items, so items are marked in finish()."""
        state = 0
        for w in words:
            state = self._extend(state, w)
        self.added.append((item, words, window))

    def finish(self) -> SuffixAutomaton:
        for item, words, window in self.added:
            state = 0
            for w in words:
                state = self.next[state][w]
                s = state
                while s > 0 and item not in self.items[s]:
                    self.items[s].add(item)
                    s = self.link[s]
            if words and len(words) < window:
                self.short.setdefault(state, []).append((item, len(words)))
        # nearest state up the suffix links, itself included, at which an item ends whole
        self.shorter = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]] if self.link[s] > 0 else -1
        self.added = []
        return self

    def stream(self, words: list[int], window: int, hits: list[tuple[int, int]], found: set, at: int) -> None:
        """Appends (first, end) word ranges that are hit; adds the items to found."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for i, w in enumerate(words, at):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w not in nxt[state]:
                continue
            state = nxt[state][w]
            n += 1
            most = 0
            if n >= window:
                most, s = n, state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items[s]
            s = self.shorter[state]
            while s > 0:
                for item, k in self.short[s]:
                    if k <= n:
                        found.add(item)
                        most = max(most, k)
                s = self.shorter[link[s]] if link[s] > 0 else -1
            if most:
                hits.append((i + 1 - most, i + 1))


class Matcher:
    """An automaton with the fingerprints of its words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        buf, off = C.joined([t for _, t in items])
        buf = C.LOWER[buf]
        s, e, first = C.word_spans(buf, off, C.ALNUM)
        h = C.span_hash(C.prefix_hash(buf), s, e) if len(buf) else np.zeros(0, C.U)
        self.window = window
        self.lookup = C.Lookup(np.unique(h))
        ids = self.lookup(h).astype(np.int64)
        self.n = len(self.lookup.keys)
        self.automaton = SuffixAutomaton()
        pairs, self.least = [], window
        for k, (item, _) in enumerate(items):
            w = ids[first[k] : first[k + 1]]
            if len(w):
                self.automaton.add(item, w.tolist(), window)
                self.least = min(self.least, len(w))
                pairs.append(w[:-1] * self.n + w[1:])
        self.automaton.finish()
        self.pairs = C.Lookup(np.unique(C.mix64(np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(C.U))))

    def spans(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """By document: word ranges that are hit, and items; documents without hits are absent."""
        out: dict[int, tuple[list, set]] = {}
        if not self.n or not len(h):
            return out
        ids = self.lookup(h).astype(np.int64)
        same = np.zeros(len(ids), bool)  # word and predecessor are a known pair of one document
        a, b = ids[:-1], ids[1:]
        both = np.flatnonzero((a >= 0) & (b >= 0))
        same[both + 1] = self.pairs(C.mix64((a[both] * self.n + b[both]).astype(C.U))) >= 0
        same[first[:-1][first[:-1] < len(same)]] = False
        # runs: a known word, then known pairs
        begin = np.flatnonzero((ids >= 0) & ~same)
        stop = np.flatnonzero((ids >= 0) & ~np.append(same[1:], False)) + 1
        long = np.flatnonzero(stop - begin >= self.least)
        doc = np.searchsorted(first, begin[long], "right") - 1
        for k, d in zip(long, doc, strict=True):
            hits, found = out.get(d) or ([], set())
            self.automaton.stream(ids[begin[k] : stop[k]].tolist(), self.window, hits, found, int(begin[k] - first[d]))
            if hits:
                out[d] = (hits, found)
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def matcher_of(shared, window: int) -> Matcher:
    """Of a broadcast block, built once in each worker; only the latest is kept."""
    key = (id(shared.value), window)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value, window)
    return _MATCHERS[key]


DDL = "doc_id long, n_words long, first_words array<long>, end_words array<long>, starts array<long>, ends array<long>, items array<string>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("first_words", "end_words", "starts", "ends")), ("items", pa.list_(pa.string()))])


def merged(ranges) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch or overlap united."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_table(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(item, text) of the items; null ids are left out, null texts are empty."""
    return items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where(F.col("item").isNotNull())


def block_count(table: DataFrame, block_words: int) -> int:
    """Blocks that the items need, by the most words that their lengths allow."""
    words = table.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
    return max(1, -(-int(words) // block_words))


def item_block(table: DataFrame, blocks: int, k: int) -> list[tuple[str, bytes]]:
    """The items of block k, in order."""
    own = table.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
    return sorted((r["item"], r["text"].encode()) for r in own.collect())


def windows(h: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``length`` words within documents, and the document of each."""
    count = np.maximum(np.diff(first) - length + 1, 0)
    at = C.ragged(first[:-1], count)
    return C.span_hash(C.prefix_sums(C.mix64(h)), at, at + length), np.repeat(np.arange(len(count)), count)


def _words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, off = C.joined(docs)
    buf = C.LOWER[buf]
    s, e, first = C.word_spans(buf, off, C.ALNUM)
    return C.span_hash(C.prefix_hash(buf), s, e) if len(s) else np.zeros(0, C.U), first


class Bitmap:
    """Which windows may occur in an item: a bit for each fingerprint, and the lengths in use."""

    def __init__(self, bits: int, slots: np.ndarray, lengths: list[int]):
        self.bits, self.slots, self.lengths = bits, slots, lengths

    @staticmethod
    def of(table: DataFrame, window: int) -> Bitmap:
        """From the items in Spark; equal windows and bits combine before the shuffle."""

        def run(batches):
            for b in C.packed(batches):
                h, first = _words(C.texts(b.column(1)))
                n = np.diff(first)
                for length in range(1, window + 1):
                    own = n >= window if length == window else n == length
                    key, doc = windows(h, first, length)
                    key = np.unique(key[own[doc]]) if len(key) else key
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), length, np.int32)), pa.array(key.view(np.int64))], names=["length", "key"])

        keys = C.materialize(table.mapInArrow(run, "length int, key long").distinct())
        lengths = {r["length"]: r["count"] for r in keys.groupBy("length").count().collect()}
        bits = max(10, min(MOST_BITS, (16 * sum(lengths.values())).bit_length()))
        slots = np.zeros(1 << (bits - 6), np.int64)
        placed = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("place"))
        for r in placed.groupBy(F.shiftright("place", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("b")).toLocalIterator():
            slots[r["slot"]] = r["b"]
        return Bitmap(bits, slots.view(C.U), sorted(lengths))

    def touched(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each document whether a window of it may occur."""
        out = np.zeros(len(first) - 1, bool)
        for length in self.lengths:
            key, doc = windows(h, first, length)
            place = key >> C.U(64 - self.bits)
            hit = (self.slots[(place >> C.U(6)).astype(np.int64)] >> (place & C.U(63))) & C.U(1)
            out[doc[hit == 1]] = True
        return out


def _match(matcher: Matcher, docs: list[bytes]):
    """Number of words of each document; by document, (word ranges, byte ranges, items)."""
    buf, off = C.joined(docs)
    buf = C.LOWER[buf]
    s, e, first = C.word_spans(buf, off, C.ALNUM)
    out = {}
    for d, (hits, what) in matcher.spans(C.span_hash(C.prefix_hash(buf), s, e), first).items():
        hits = merged(hits)
        out[d] = (hits, [(int(s[first[d] + x] - off[d]), int(e[first[d] + y - 1] - off[d])) for x, y in hits], sorted(what))
    return np.diff(first), out


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: n_words, the maximal ranges of words hit (first_words, end_words), the same
    as UTF-8 byte offsets (starts, ends), and the items with a window that occurs.

    Null and empty texts have no words and no hits; items without words match nothing; equal items
    all count. Rows of docs are not merged.
    """
    own, table = C.id_text(docs, id_col, text_col), item_table(items, item_col, item_text)
    blocks = block_count(table, block_words)
    if blocks == 1:
        return _pass(own, docs.sparkSession.sparkContext.broadcast(item_block(table, 1, 0)), window)
    own = C.materialize(probed(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), Bitmap.of(table, window)))
    found = _united(own.where(F.col("text").isNotNull()).select("row", "text"), table, blocks, window).withColumnRenamed("doc_id", "row")
    none = F.array().cast("array<long>")
    clean = own.where(F.col("text").isNull()).select("doc_id", "n_words", *[none.alias(c) for c in SCHEMA.names[2:6]], none.cast("array<string>").alias("items"))
    hit = own.where(F.col("text").isNotNull()).select("row", "doc_id").join(found, "row").select(*SCHEMA.names)
    return clean.unionByName(hit)


def probed(docs: DataFrame, bitmap: Bitmap) -> DataFrame:
    """(row, doc_id, n_words, text): the text is null where no window of it can occur in an item."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in C.packed(batches, 2):
            text = C.texts(b.column(2))
            h, first = _words(text)
            yield C.batch(schema, b.column(0), b.column(1), np.diff(first), [t.decode() if x else None for t, x in zip(text, shared.value.touched(h, first), strict=True)])

    return docs.mapInArrow(run, "row long, doc_id long, n_words long, text string")


def _united(docs: DataFrame, table: DataFrame, blocks: int, window: int) -> DataFrame:
    """The matches of several blocks of items, by row number, for (row, text). One block at a time
    is fetched, broadcast and let go."""
    out = None
    for k in range(blocks):
        block = docs.sparkSession.sparkContext.broadcast(item_block(table, blocks, k))
        part = C.materialize(_pass(docs, block, window))
        block.unpersist()
        out = part if out is None else out.unionByName(part)
    every = out.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list(F.arrays_zip("first_words", "end_words", "starts", "ends")))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches):
        for b in batches:
            words, spans = [], []
            for r in b.column(2).to_pylist():
                words.append(merged((x["first_words"], x["end_words"]) for x in r))
                at = {x["first_words"]: x["starts"] for x in r}
                to = {x["end_words"]: x["ends"] for x in r}
                spans.append([(at[f], to[e]) for f, e in words[-1]])
            cols = [[x[0] for x in w] for w in words], [[x[1] for x in w] for w in words], [[x[0] for x in w] for w in spans], [[x[1] for x in w] for w in spans]
            yield C.batch(SCHEMA, b.column(0), b.column(1), *cols, b.column(3))

    return every.select("doc_id", "n_words", "r", "items").mapInArrow(unite, DDL)


def _pass(docs: DataFrame, items, window: int) -> DataFrame:
    def run(batches):
        matcher = matcher_of(items, window)
        for b in C.packed(batches):
            n_words, found = _match(matcher, C.texts(b.column(1)))
            at = [found.get(d, ((), (), ())) for d in range(b.num_rows)]
            yield C.batch(SCHEMA, b.column(0), n_words, [[x for x, _ in a[0]] for a in at], [[x for _, x in a[0]] for a in at], [[x for x, _ in a[1]] for a in at], [[x for _, x in a[1]] for a in at], [list(a[2]) for a in at])

    return docs.mapInArrow(run, DDL)


def report(found: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """matches() with n_hit, n_items and contaminated: n_hit > 0 and coverage * n_hit >= n_words."""
    n_hit = F.aggregate(F.zip_with("end_words", "first_words", lambda e, f: e - f), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, action: str = "drop", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with all its columns, without its contaminated documents (action "drop"), or with the
    spans hit cut out of them, each for one line break (action "cut"). Other documents stay as
    they are, nulls and empty texts among them.

    With one block of items this is one pass without a shuffle. With several, the documents that
    the bitmap lets through are joined to their united ranges by row number; both give the same rows.
    """
    spark, table = docs.sparkSession, item_table(items, item_col, item_text)
    blocks = block_count(table, block_words)
    C.small_batches(spark)
    at = docs.columns.index(text_col)
    if blocks > 1:
        numbered = C.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
        texts = numbered.select(F.col("__row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        some = C.materialize(probed(texts, Bitmap.of(table, window)).where(F.col("text").isNotNull()).select("row", "text"))
        found = report(_united(some, table, blocks, window), coverage).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"), F.col("ends").alias("__ends"))
        if action == "drop":
            return numbered.join(found, F.col("__row") == F.col("__id"), "left_anti").select(*docs.columns)
        joined = numbered.join(found, F.col("__row") == F.col("__id"), "left").select(*docs.columns, "__starts", "__ends")

        def cut(batches):
            for b in C.packed(batches, at):
                rows = zip(b.column(at).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)
                clean = pa.array([_cut(t.encode(), zip(s, e, strict=True)).decode() if s else t for t, s, e in rows], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*b.columns[:at], clean, *b.columns[at + 1 : -2]], names=b.schema.names[:-2])

        return joined.mapInArrow(cut, docs.schema)
    block = spark.sparkContext.broadcast(item_block(table, 1, 0))

    def run(batches):
        matcher = matcher_of(block, window)
        for b in C.packed(batches, at):
            text = C.texts(b.column(at))
            n_words, found = _match(matcher, text)
            bad = {d for d, (hits, _, _) in found.items() if coverage * sum(y - x for x, y in hits) >= n_words[d]}
            if action == "drop":
                yield b.filter(pa.array([d not in bad for d in range(b.num_rows)]))
            elif bad:
                clean = [_cut(t, found[d][1]).decode() if d in bad else v for d, (t, v) in enumerate(zip(text, b.column(at).to_pylist(), strict=True))]
                yield b.set_column(at, b.schema.field(at), pa.array(clean, b.schema.field(at).type))
            else:
                yield b

    return docs.mapInArrow(run, docs.schema)


def _cut(text: bytes, spans) -> bytes:
    out, last = [], 0
    for s, e in spans:
        out.append(text[last:s])
        last = e
    return b"\n".join([*out, text[last:]])
