"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier (in a document of
smaller id, or earlier in the same one). Positions are ranked by ever longer strings, and those
that prove unique leave:

1. Rank by ``GRAM`` bytes. Not all positions need sorting: of the grams inside a string of LENGTH
   bytes the one with the smallest hash (the leftmost, on ties) is its anchor, and equal strings
   have equal anchors at equal places. So only anchors, one for a run of neighbouring positions,
   are sorted; a run whose gram is unique cannot repeat.
2. Rank by the whole run: the bytes of all its strings. All but the first of equal runs are
   repeated throughout. First runs that share their gram with another run stay.
3. Rank each remaining position by the pair of its two halves' ranks, which makes LENGTH bytes.
   All but the first of equal pairs are repeated.

Ranks are 64-bit fingerprints of the bytes; equality means equal fingerprints of gram and run, or
of both halves. Rows travel as packed numpy blocks. Each task drops what it can decide alone
before it sends, so groups of copies shrink to one entry for each task. Grams that one task
meets in many different runs are hot: their runs are dealt by their own fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

U = np.uint64
LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
HALF = LENGTH // 2
#: A task sends its runs when it holds so many; a gram with HOT different runs among them is hot.
HELD, HOT = 400_000, 256
#: Bytes of text whose positions are ranked at once.
SCAN = 400_000
#: Texts are taken in pieces of so many positions (the strings of a piece overlap the next).
PIECE = 1_000_000
INDEX_BITS = U(23)
#: Bytes of text for each bucket, and at most two to this power buckets (about 130,000, of some
#: 800 MB each at 100 TB).
SHARE, MOST_BITS = 8_000_000, 17
SEEN, BY_GRAM, BY_RUN, MARK = 0, 1, 2, 3  # kinds of blocks


# --- positions to runs ------------------------------------------------------------------------


class Runs:
    """Arrays of runs: gram, run fingerprint, doc, first position, anchor's offset, positions - 1."""

    def __init__(self, gram, run, doc, start, offset, more):
        self.gram, self.run, self.doc, self.start, self.offset, self.more = gram, run, doc, start, offset, more

    def __len__(self):
        return len(self.gram)

    def at(self, k) -> Runs:
        return Runs(*(x[k] for x in self.columns()))

    def columns(self):
        return self.gram, self.run, self.doc, self.start, self.offset, self.more

    @staticmethod
    def of(parts: list[Runs]) -> Runs:
        kinds = (U, U, np.int64, np.int64, np.uint8, np.uint8)
        return Runs(*(np.concatenate([np.zeros(0, t), *(p.columns()[k] for p in parts)]) for k, t in enumerate(kinds)))

    def pack(self) -> bytes:
        """By columns; the leading bits of grams and ids are alike within a block and compress."""
        g = self.gram >> U(24)
        cols = (g.astype(np.uint32), (g >> U(32)).astype(np.uint8), self.run, self.doc, self.start, self.offset, self.more)
        return np.int64(len(self)).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in cols)

    @staticmethod
    def unpack(raw: bytes) -> Runs:
        n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
        for t in (np.uint32, np.uint8, U, np.int64, np.int64, np.uint8, np.uint8):
            out.append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
        gram = (out[0].astype(U) | (out[1].astype(U) << U(32))) << U(24)
        return Runs(gram, *out[2:])

    def sort(self) -> tuple[Runs, np.ndarray, np.ndarray]:
        """By gram, run, document and place, one entry for a place; the first of each gram and run."""
        out = self.at(np.lexsort((self.start, self.doc, self.run, self.gram)))
        # the same place comes again with an equal row, and is no repeat of itself
        new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (out.start, out.doc, out.run, out.gram)]))[: len(out)]
        out = out if new.all() else out.at(new)
        gram = np.concatenate(([True], out.gram[1:] != out.gram[:-1])) if len(out) else np.zeros(0, bool)
        run = gram | np.concatenate(([True], out.run[1:] != out.run[:-1])) if len(out) else gram
        return out, gram, run


def pieces(doc_ids: list, docs: list[bytes], piece: int = PIECE):
    """(ids, texts, first positions) of texts in pieces of bounded size."""
    for d, t in zip(doc_ids, docs, strict=True):
        for at in range(0, max(1, len(t) - LENGTH + 1), piece):
            yield d, t[at : at + piece + LENGTH - 1], at


def runs(doc: np.ndarray, base: np.ndarray, docs: list[bytes]) -> Runs:
    """Runs of positions with equal anchors of all texts of LENGTH bytes or more."""
    buf, off = C.joined(docs)
    if len(buf) < LENGTH:
        return Runs.of([])
    prefix = C.prefix_hash(buf)
    at = np.arange(len(buf) - GRAM + 1)
    gram = C.span_hash(prefix, at, at + GRAM)
    least = ((gram >> INDEX_BITS) << INDEX_BITS) | at.astype(U)
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    anchor = (least & ((U(1) << INDEX_BITS) - U(1))).astype(np.int64)
    n = np.maximum(np.diff(off) - LENGTH + 1, 0)
    own = np.repeat(np.arange(len(docs)), n)
    place = C.ragged(off[:-1], n)
    anchor = anchor[place]
    head = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))) if len(own) else np.zeros(0, int)
    count = np.diff(np.append(head, len(own)))
    start, a, own = place[head], anchor[head], own[head]
    run = C.mix64(C.span_hash(prefix, start, start + count - 1 + LENGTH) + (a - start).astype(U))
    # anchors have small hashes: mixed again, they spread evenly over the buckets
    return Runs(C.mix64(gram[a]), run, doc[own], start - off[own] + base[own], (a - start).astype(np.uint8), (count - 1).astype(np.uint8))


# --- blocks -----------------------------------------------------------------------------------

BLOCK_DDL = "kind int, bucket int, data binary"
BLOCK = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
SPAN_DDL = "doc_id long, spans binary, left binary"
SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary()), ("left", pa.binary())])


def dealt(kind: int, key: np.ndarray, r: Runs, bits: int, buckets: list, data: list, kinds: list) -> None:
    b = (key >> U(64 - bits)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange((1 << bits) + 1))
    for k in np.flatnonzero(np.diff(cut)):
        kinds.append(kind)
        buckets.append(int(k))
        data.append(r.at(order[cut[k] : cut[k + 1]]).pack())


def send(held: list[Runs], bits: int, least_hot: int = HOT):
    """Blocks of a task's runs: those that repeat within the task, the first ones by gram, and the
    first ones of hot grams by run, with a mark for the gram's bucket."""
    r, gram, run = Runs.of(held).sort()
    if not len(r):
        return
    kinds, buckets, data = [], [], []
    again = r.at(~run)
    dealt(SEEN, C.mix64(again.doc.astype(U)), again, bits, buckets, data, kinds)
    first = r.at(run)
    number = np.cumsum(gram[run]) - 1
    hot = (np.bincount(number) >= least_hot)[number]
    dealt(BY_GRAM, first.gram[~hot], first.at(~hot), bits, buckets, data, kinds)
    if hot.any():
        dealt(BY_RUN, first.run[hot], first.at(hot), bits, buckets, data, kinds)
        mark = np.flatnonzero(hot & np.concatenate(([True], number[1:] != number[:-1])))
        dealt(MARK, first.gram[mark], first.at(mark), bits, buckets, data, kinds)
    yield C.batch(BLOCK, kinds, buckets, pa.array(data, pa.binary()))


def by_doc(doc: np.ndarray, *columns: np.ndarray):
    """(doc, rows of the columns) for each document."""
    order = np.argsort(doc, kind="stable")
    d, table = doc[order], np.stack(columns, 1)[order] if len(doc) else np.zeros((0, len(columns)), np.int64)
    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1], [True]))) if len(d) else np.zeros(1, int)
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        yield int(d[s]), table[s:e]


def decide(kinds: dict[int, list[Runs]]):
    """Spans that repeat, and runs left to rank by position, of one bucket, by document."""
    seen = [Runs.of(kinds.get(SEEN, []))]
    left, hot_flag = [], []
    marks = Runs.of(kinds.get(MARK, []))
    for kind in (BY_GRAM, BY_RUN):
        r, gram, run = Runs.of(kinds.get(kind, [])).sort()
        if not len(r):
            continue
        seen.append(r.at(~run))
        first = r.at(run)
        number = np.cumsum(gram[run]) - 1
        # anything left of a hot gram is ranked with the hot ones
        hot = np.isin(first.gram, marks.gram) if kind == BY_GRAM else np.ones(len(first), bool)
        stay = (np.bincount(number) > 1)[number] | hot
        left.append(first.at(stay))
        hot_flag.append(hot[stay])
    s, rest = Runs.of(seen), Runs.of(left)
    flag = np.concatenate([np.zeros(0, bool), *hot_flag]).astype(np.int64)
    docs: dict[int, list[bytes]] = {}
    for d, t in by_doc(s.doc, s.start, s.start + s.more + LENGTH):
        docs.setdefault(d, [b"", b""])[0] = t.astype(np.int64).tobytes()
    for d, t in by_doc(rest.doc, rest.start, rest.offset.astype(np.int64), rest.more.astype(np.int64), flag):
        docs.setdefault(d, [b"", b""])[1] = t.astype(np.int64).tobytes()
    if docs:
        yield C.batch(SPANS, list(docs), pa.array([x[0] for x in docs.values()], pa.binary()), pa.array([x[1] for x in docs.values()], pa.binary()))


def grouped(batches, finish):
    """Runs finish(kinds) for each bucket of blocks that come sorted by bucket."""
    at, kinds = None, {}
    for b in batches:
        for kind, bucket, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if at is not None and bucket != at:
                yield from finish(kinds)
                kinds = {}
            at = bucket
            kinds.setdefault(kind, []).append(data)
    if at is not None:
        yield from finish(kinds)
    C.trim()


# --- the last ranking -------------------------------------------------------------------------


class Places:
    """Single positions with the ranks of their two halves."""

    def __init__(self, one, two, doc, at):
        self.one, self.two, self.doc, self.at = one, two, doc, at

    def take(self, k) -> Places:
        return Places(self.one[k], self.two[k], self.doc[k], self.at[k])

    def pack(self) -> bytes:
        return np.stack([self.one.astype(np.int64), self.two.astype(np.int64), self.doc, self.at]).tobytes()

    @staticmethod
    def unpack(raw: list[bytes]) -> Places:
        x = np.concatenate([np.zeros((4, 0), np.int64), *(np.frombuffer(r, np.int64).reshape(4, -1) for r in raw)], 1)
        return Places(x[0].astype(U), x[1].astype(U), x[2], x[3])

    def split(self) -> tuple[Places, Places]:
        """First of each pair of ranks, and the others; places of equal rows count once."""
        p = self.take(np.lexsort((self.at, self.doc, self.two, self.one)))
        new = np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in (p.at, p.doc, p.two, p.one)]))[: len(p.one)]
        p = p if new.all() else p.take(new)
        first = np.concatenate(([True], (p.one[1:] != p.one[:-1]) | (p.two[1:] != p.two[:-1]))) if len(p.one) else np.zeros(0, bool)
        return p.take(first), p.take(~first)


def places(data: bytes | np.ndarray, begin: np.ndarray, more: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Places:
    """Positions of runs: run k has more[k] + 1 of them, from byte begin[k] of data."""
    prefix = C.prefix_hash(np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data)
    n = more + 1
    p = C.ragged(begin, n)
    at = p - np.repeat(begin - start, n)
    return Places(C.span_hash(prefix, p, p + HALF), C.span_hash(prefix, p + HALF, p + LENGTH), np.repeat(doc, n), at)


def position_spans(p: Places):
    """By document, spans of LENGTH bytes from each position, neighbours united."""
    if not len(p.doc):
        return
    order = np.lexsort((p.at, p.doc))
    doc, at = p.doc[order], p.at[order]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
    tail = np.append(head[1:], len(doc)) - 1
    rows = list(by_doc(doc[head], at[head], at[tail] + LENGTH))
    yield C.batch(SPANS, [d for d, _ in rows], pa.array([t.astype(np.int64).tobytes() for _, t in rows], pa.binary()), pa.array([b""] * len(rows), pa.binary()))


CONTEXT, POSITION, DONE = 0, 1, 2


def open_runs(batches, bits: int):
    """(doc_id, text, left) to blocks: bytes of runs by gram; positions of hot runs by rank."""
    for b in C.packed(batches, limit=SCAN):
        text = C.texts(b.column(1))
        buf, off = C.joined(text)
        rows, doc, of = [], [], []
        for k, (d, parts) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            t = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 4)
            rows.append(t)
            doc.append(np.full(len(t), d))
            of.append(np.full(len(t), off[k]))
        rows, doc, of = np.concatenate(rows), np.concatenate(doc), np.concatenate(of)
        start, offset, more, hot = rows.T
        kinds, buckets, data = [], [], []
        cold = np.flatnonzero(hot == 0)
        if len(cold):
            begin = start[cold] + of[cold]
            size = more[cold] + LENGTH
            anchors = begin + offset[cold]
            gram = C.mix64(C.span_hash(C.prefix_hash(buf), anchors, anchors + GRAM))
            bucket = (gram >> U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            for k in np.flatnonzero(np.diff(cut)):
                own = order[cut[k] : cut[k + 1]]
                head = np.stack([doc[cold[own]], start[cold[own]], more[cold[own]]])
                kinds.append(CONTEXT)
                buckets.append(int(k))
                data.append(np.int64(len(own)).tobytes() + head.tobytes() + buf[C.ragged(begin[own], size[own])].tobytes())
        warm = np.flatnonzero(hot == 1)
        if len(warm):
            first, again = places(buf, start[warm] + of[warm], more[warm], doc[warm], start[warm]).split()
            for kind, p, key in ((POSITION, first, first.one), (DONE, again, C.mix64(again.doc.astype(U)))):
                bucket = (key >> U(64 - bits)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    kinds.append(kind)
                    buckets.append(int(k))
                    data.append(p.take(order[cut[k] : cut[k + 1]]).pack())
        if kinds:
            yield C.batch(BLOCK, kinds, buckets, pa.array(data, pa.binary()))


def rank_positions(kinds: dict[int, list[bytes]]):
    """Spans of the positions of one bucket that repeat."""
    heads, raw = [np.zeros((3, 0), np.int64)], []
    for x in kinds.get(CONTEXT, []):
        n = int(np.frombuffer(x[:8], np.int64)[0])
        heads.append(np.frombuffer(x, np.int64, 3 * n, 8).reshape(3, n))
        raw.append(x[8 + 24 * n :])
    doc, start, more = np.concatenate(heads, 1)
    size = more + LENGTH
    if len(doc):
        yield from position_spans(places(b"".join(raw), np.cumsum(size) - size, more, doc, start).split()[1])
    yield from position_spans(Places.unpack(kinds.get(POSITION, [])).split()[1])
    yield from position_spans(Places.unpack(kinds.get(DONE, [])))


# --- whole tables -----------------------------------------------------------------------------


def repeated(docs: DataFrame, bits: int | None = None, most_held: int = HELD, hot: int = HOT, piece: int = PIECE) -> DataFrame:
    """(doc_id, spans: packed start and end pairs) of what repeats, several rows for a document;
    for (doc_id, text) with unique non-null ids, or equal rows."""
    C.small_batches(docs.sparkSession)
    bits = bits or max(4, min(MOST_BITS, int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0] // SHARE).bit_length()))
    tasks = C.tasks(bits, 8)

    def scan(batches):
        held, n = [], 0
        for b in C.packed(batches, limit=SCAN):
            group, size = [], 0
            rows = list(pieces(b.column(0).to_pylist(), C.texts(b.column(1)), piece))
            for k, r in enumerate(rows):
                group.append(r)
                size += len(r[1])
                if size >= SCAN or k == len(rows) - 1:
                    held.append(runs(np.array([x[0] for x in group], np.int64), np.array([x[2] for x in group], np.int64), [x[1] for x in group]))
                    n += len(held[-1])
                    group, size = [], 0
            if n > most_held:
                yield from send(held, bits, hot)
                held, n = [], 0
        yield from send(held, bits, hot)

    def first(batches):
        return grouped(batches, lambda kinds: decide({k: [Runs.unpack(x) for x in v] for k, v in kinds.items()}))

    sent = docs.mapInArrow(scan, BLOCK_DDL)
    found = C.materialize(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(first, SPAN_DDL))
    left = found.where(F.length("left") > 0).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("left").alias("left"))
    opened = docs.join(left, docs.doc_id == left.id).select("doc_id", "text", "left").mapInArrow(lambda batches: open_runs(batches, bits), BLOCK_DDL)
    last = opened.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: grouped(batches, rank_positions), SPAN_DDL)
    return C.materialize(found.where(F.length("spans") > 0).select("doc_id", "spans").unionByName(last.select("doc_id", "spans")))


def united(parts: list[bytes]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch united."""
    t = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
    t = t[np.argsort(t[:, 0], kind="stable")]
    if not len(t):
        return []
    end = np.maximum.accumulate(t[:, 1])
    head = np.concatenate(([True], t[1:, 0] > end[:-1]))
    return list(zip(t[head, 0].tolist(), end[np.append(np.flatnonzero(head)[1:], len(t)) - 1].tolist(), strict=True))


OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string, kept binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, **kw) -> DataFrame:
    """Per row of docs: n_bytes, n_removed, n_spans (maximal runs removed), their byte offsets
    (starts, ends), the SHA-256 of the bytes kept and, with with_kept, these bytes.

    Null texts are empty; texts of fewer than LENGTH bytes lose nothing. Different texts must have
    different ids: equal rows count as one document and get equal results. Rows with a null id
    are left whole and make nothing repeated.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = repeated(own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)), **kw)
    spans = spans.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("spans").alias("spans"))

    def cut(batches):
        for b in C.packed(batches):
            rows = []
            for t, parts in zip(C.texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                s = united(parts) if parts else []
                last, keep = 0, []
                for a, e in s:
                    keep.append(t[last:a])
                    last = e
                kept = b"".join([*keep, t[last:]])
                rows.append((len(t), len(t) - len(kept), len(s), [a for a, _ in s], [e for _, e in s], hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            yield C.batch(OUT, b.column(0), *map(list, zip(*rows, strict=True)))

    return own.join(spans, own.doc_id == spans.id, "left").select("doc_id", "text", "spans").mapInArrow(cut, OUT_DDL)
