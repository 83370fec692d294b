"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type vocabulary joins neighbouring symbols, best piece first (on ties, leftmost). Every
candidate merge that comes up during the agenda's processing is skipped if a hash keyed by the
seed, the document, the unit's number and text, the merge's place and the piece falls below the
dropout rate. So every occurrence of a word is segmented by draws of its own, reproducibly; all
segmentations decode to the same text.

Texts are taken in units, a run of spaces with the characters up to the next space, since no
piece has a space after another character. Units whose draws come out alike share work: equal
units of a chunk are first encoded without skips, and each occurrence draws for the candidates
that came up. Those that skip none are done; the others go on by the set of merges they skip,
alone or with those of an equal set, until nothing new is skipped. All units of a round are
merged side by side in numpy; units that are longer than ``LONG`` symbols go through a heap,
which takes n log n steps.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20
LONG = 200
SPACE = "▁"
U = np.uint64
NEVER = np.iinfo(np.int64).max

DDL = "doc_id long, ids binary, n_tokens long"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64())])


class Draws:
    """Which candidate merges of units are skipped. A unit with ``alone`` draws by its key; any other
    skips just the candidates of its set, and those that come up are listed in ``met``."""

    def __init__(self, key: np.ndarray, alone: np.ndarray, skipped: np.ndarray, dropout: float):
        self.key, self.alone, self.dropout = key, alone, dropout
        self.skipped, self.met = C.Lookup(np.unique(skipped)), []

    def skips(self, unit: np.ndarray, merge: np.ndarray) -> np.ndarray:
        out = drawn(self.key[unit], merge, self.dropout)
        at = np.flatnonzero(~self.alone[unit])
        unit, merge = unit[at], merge[at]
        out[at] = self.skipped(in_unit(unit, merge)) >= 0
        self.met.append((unit[~out[at]], merge[~out[at]]))
        return out


def drawn(key: np.ndarray, merge: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the occurrence with that key skips the merge."""
    return (C.mix64(key ^ merge) >> U(11)).astype(np.float64) / 2.0**53 < dropout


def in_unit(unit: np.ndarray, merge: np.ndarray) -> np.ndarray:
    return C.mix64(merge + C.mix64(unit.astype(U) + U(1)))


class Pieces:
    """Tables of a merge-type model with byte fallback and no normalisation."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        special = np.array([sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)])
        names = [sp.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.byte = np.zeros(256, np.int32)
        raw = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][1:-1], 16)] = i
                raw[i] = bytes([int(names[i][1:-1], 16)])
            elif not special[i]:
                raw[i] = names[i].replace(SPACE, " ").encode()
        #: symbol of each code point: its piece, or n + code point if it has none
        self.symbol = (np.arange(0x110000) + n).astype(np.int32)
        for p, i in ids.items():
            if len(p) == 1 and p != SPACE:
                self.symbol[ord(p)] = i
        self.symbol[32] = ids[SPACE]
        score = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        left, right, merged = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        key = self._pair(np.array(left, np.int64), np.array(right, np.int64))
        order = np.argsort(key)
        self.pairs, self.merged = C.Lookup(key[order]), np.array(merged, np.int32)[order]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return C.mix64((a.astype(np.int64) * 2_000_003 + b).astype(U))

    def candidate(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray, unit: np.ndarray, draws: Draws) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if none, or skipped) and piece of merging symbols a and b, which span the
        characters start to end of their unit."""
        k = self.pairs(self._pair(a, b))
        piece = self.merged[np.maximum(k, 0)]
        rank = np.where(k >= 0, self.rank[piece], NEVER)
        if draws.dropout:
            at = np.flatnonzero(k >= 0)
            rank[at[draws.skips(unit[at], C.mix64(((start[at] << 42) ^ (end[at] << 20) ^ piece[at]).astype(U)))]] = NEVER
        return rank, piece

    # --- a unit by a heap

    def agenda(self, symbols: list[int], unit: int, draws: Draws) -> list[int]:
        """Symbols of one unit after merging, in n log n steps."""
        n = len(symbols)
        sym, nxt, prv, end = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(lefts):
            lefts = [i for i in lefts if i >= 0 and nxt[i] < n]
            if not lefts:
                return
            a = np.array(lefts)
            rights = [nxt[i] for i in lefts]
            rank, piece = self.candidate(np.array([sym[i] for i in lefts]), np.array([sym[j] for j in rights]), a, np.array([end[j] for j in rights]), np.full(len(a), unit), draws)
            for i, j, r, p in zip(lefts, rights, rank.tolist(), piece.tolist(), strict=True):
                if r != NEVER:
                    heapq.heappush(heap, (r, i, end[j], p))

        push(range(n))
        while heap:
            _, i, stop, piece = heapq.heappop(heap)
            j = nxt[i] if sym[i] >= 0 else n
            # the candidate is stale if either side has changed since
            if j >= n or end[j] != stop or not self._joins(sym[i], sym[j], piece):
                continue
            sym[i], end[i], sym[j] = piece, end[j], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push([prv[i], i])
        return [s for s in sym if s >= 0]

    def _joins(self, a: int, b: int, piece: int) -> bool:
        k = self.pairs(self._pair(np.array([a]), np.array([b])))[0]
        return k >= 0 and self.merged[k] == piece

    # --- many units side by side

    def merge(self, sym: np.ndarray, first: np.ndarray, draws: Draws) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all units (unit k: sym[first[k]:first[k + 1]]) after merging, and first."""
        count = np.diff(first)
        done_unit, done_sym = [], []
        for k in np.flatnonzero(count > LONG):
            out = self.agenda(sym[first[k] : first[k + 1]].tolist(), int(k), draws)
            done_unit.append(np.full(len(out), k))
            done_sym.append(np.array(out, np.int64))
        keep = np.repeat(count <= LONG, count)
        unit, sym = np.repeat(np.arange(len(count)), count)[keep], sym[keep].astype(np.int64)
        start = (np.arange(len(keep)) - np.repeat(first[:-1], count))[keep]
        end = start + 1
        rank, piece = np.full(len(sym), NEVER), np.zeros(len(sym), np.int32)
        fresh = np.flatnonzero(unit[:-1] == unit[1:]) if len(sym) else np.zeros(0, int)
        while len(sym):
            rank[fresh], piece[fresh] = self.candidate(sym[fresh], sym[fresh + 1], start[fresh], end[fresh + 1], unit[fresh], draws)
            head = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(unit)))
            live = np.repeat(best != NEVER, size)
            if not live.all():
                done_unit.append(unit[~live])
                done_sym.append(sym[~live])
                if not live.any():
                    break
                unit, sym, start, end, rank, piece = unit[live], sym[live], start[live], end[live], rank[live], piece[live]
                size, best = size[best != NEVER], best[best != NEVER]
            at = np.flatnonzero(rank == np.repeat(best, size))
            at = at[np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))]  # the leftmost of each unit
            sym[at], end[at] = piece[at], end[at + 1]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            rank[at] = NEVER
            rest = ~gone
            unit, sym, start, end, rank, piece, changed = unit[rest], sym[rest], start[rest], end[rest], rank[rest], piece[rest], changed[rest]
            last = np.append(unit[1:] != unit[:-1], True)
            rank[changed & last] = NEVER
            fresh = np.flatnonzero(changed & ~last)
        unit, sym = np.concatenate([*done_unit, np.zeros(0, int)]), np.concatenate([*done_sym, np.zeros(0, np.int64)])
        order = np.argsort(unit, kind="stable")
        return sym[order], np.searchsorted(unit[order], np.arange(len(count) + 1))

    def fall_back(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the pieces of their UTF-8 bytes."""
        cp = sym - self.n
        odd = cp >= 0
        n = np.where(odd, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
        out = np.repeat(sym, n)
        place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        c, size, odd = np.repeat(cp, n), np.repeat(n, n), np.repeat(odd, n)
        c, size, place = c[odd], size[odd], place[odd]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        low = (c >> (6 * (size - 1 - place))) & 0x3F
        byte = np.where(size == 1, c, np.where(place == 0, lead | (c >> (6 * (size - 1))), 0x80 | low))
        out[odd] = self.byte[byte]
        return out, np.concatenate(([0], np.cumsum(n)))[first]

    # --- equal units together

    def segment(self, sym: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encodings of units (sym[start:end], hash of the text, key of the occurrence): ids, the
        first one of each encoding, and the encoding of each unit."""
        ids, size, which = [], [], np.zeros(len(start), np.int64)
        todo, state, skipped, own, n = np.arange(len(start)), word, np.zeros(0, U), np.zeros(0, np.int64), 0
        while len(todo):
            # one class for each text and set of skipped merges; own: the units the merges belong to
            _, at, cls, many = np.unique(state, return_index=True, return_inverse=True, return_counts=True)
            unit = todo[at]
            alone = many == 1
            place = np.full(len(start), -1)
            place[unit] = np.arange(len(unit))
            known = place[own] >= 0
            draws = Draws(key[unit], alone, in_unit(place[own[known]], skipped[known]), dropout)
            count = end[unit] - start[unit]
            out, cut = self.fall_back(*self.merge(sym[C.ragged(start[unit], count)], np.concatenate(([0], np.cumsum(count))), draws))
            ids.append(out)
            size.append(np.diff(cut))
            which[todo] = n + cls
            n += len(unit)
            if not dropout:
                break
            # the occurrences of classes draw for the candidates that came up
            met = [np.concatenate([np.zeros(0, t), *(m[k] for m in draws.met)]) for k, t in ((0, np.int64), (1, U))]
            order = np.argsort(met[0], kind="stable")
            first = np.searchsorted(met[0][order], np.arange(len(unit) + 1))
            more = np.diff(first)[cls]
            merge = met[1][order][C.ragged(first[:-1][cls], more)]
            place = np.repeat(np.arange(len(todo)), more)
            new = drawn(key[todo][place], merge, dropout)
            place, merge = place[new], merge[new]
            if not len(place):
                break
            # a candidate may come up twice in one unit, but is skipped once
            _, once = np.unique(in_unit(place, merge), return_index=True)
            place, merge = place[once], merge[once]
            add = np.zeros(len(todo), U)
            np.add.at(add, place, C.mix64(merge + U(1)))
            stay = np.unique(place)
            # what the unit's class skipped before it skips again
            of = own[known]
            old = np.argsort(of, kind="stable")
            begin = np.searchsorted(of[old], unit[cls[stay]])
            long = np.searchsorted(of[old], unit[cls[stay]], side="right") - begin
            inherited = skipped[known][old][C.ragged(begin, long)]
            own = np.concatenate([todo[place], np.repeat(todo[stay], long)])
            skipped = np.concatenate([merge, inherited])
            state = (state + add)[stay]
            todo = todo[stay]
        return np.concatenate([np.zeros(0, np.int64), *ids]), np.cumsum(np.concatenate([[0], *size])).astype(np.int64), which

    # --- whole texts

    def encode(self, texts: list[str], keys: list[int], dropout: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and the end of each text's ids. An empty text has none."""
        padded = [" " + t if t else "" for t in texts]
        cp = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
        off = np.concatenate(([0], np.cumsum([len(t) for t in padded]))).astype(np.int64)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space = cp == 32
        head = space & np.concatenate(([True], ~space[:-1]))
        head[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(cp))
        first = np.searchsorted(start, off)
        word = C.mix64(C.span_hash(C.prefix_sums(C.mix64(cp.astype(U) + U(1))), start, end))
        number = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
        own = np.repeat(C.mix64(np.array([k & (2**64 - 1) for k in keys], U) + U(seed)), np.diff(first))
        key = C.mix64(word ^ C.mix64(own ^ C.mix64(number.astype(U))))
        sym, cut, which = self.segment(self.symbol[cp], start, end, word, key, dropout)
        n = np.diff(cut)[which]
        ids = sym[C.ragged(cut[:-1][which], n)].astype(np.int32)
        return ids, np.concatenate(([0], np.cumsum(n)))[first[1:]]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each run of ids, without the space that encoding puts before a text."""
        n = self.length[ids]
        raw = self.raw[C.ragged(self.first[ids], n)].tobytes()
        cut = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], ends))]
        return [raw[s + 1 : e] if raw[s : s + 1] == b" " else raw[s:e] for s, e in zip(cut[:-1], cut[1:], strict=True)]


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def document_key(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, keep_text: bool = False, check: bool = False) -> DataFrame:
    """Per row of docs: doc_id, ids (32-bit little-endian integers) and n_tokens of the whole text.

    Null and empty texts have no ids. The id is the document's key; rows with equal ids and texts
    get equal ids of pieces. With dropout 0 this is the model's own encoding. keep_text adds the
    column text; check decodes in the same pass and adds the column lossless.
    """
    schema = SCHEMA.append(pa.field("text", pa.string())) if keep_text else SCHEMA
    schema = schema.append(pa.field("lossless", pa.bool_())) if check else schema

    def run(batches):
        p = pieces(model)
        for b in C.packed(batches, limit=C.CHUNK // 2):
            ids, ends = p.encode([t or "" for t in b.column(1).to_pylist()], [document_key(k) for k in b.column(0).to_pylist()], dropout, seed)
            out = [b.column(0), C.binary_column(ids.astype("<i4"), ends * 4), np.diff(np.concatenate(([0], ends)))]
            same = [[x == y for x, y in zip(p.decode(ids, ends), C.texts(b.column(1)), strict=True)]] if check else []
            yield C.batch(schema, *out, *([b.column(1)] if keep_text else []), *same)

    return C.id_text(docs, id_col, text_col).mapInArrow(run, DDL + ", text string" * keep_text + ", lossless boolean" * check)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded, all columns, with the text that its ids stand for; null ids: empty. Bytes that are
    not UTF-8 (no encoding here has them) become U+FFFD."""
    at = encoded.columns.index(ids_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{to}` string"])

    def run(batches):
        p = pieces(model)
        for b in C.packed(batches, at):
            raw = C.texts(b.column(at))
            ids = np.frombuffer(b"".join(raw), "<i4")
            out = [t.decode("utf-8", "replace") for t in p.decode(ids, np.cumsum([len(r) // 4 for r in raw]))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, to])

    return encoded.mapInArrow(run, schema)
