"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def removed(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256 of what is left)}"""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def hits(text, items, window=13):
    """(n_words, n_hit, item ids with a window that occurs)"""
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1) if n else ():
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows, threshold=0.8):
    """{doc_id: (class_id, rep_id, n_copies, n_links)}"""
    sets = {i: shingles(t) for i, t in rows}
    same = defaultdict(list)
    for i, s in sets.items():
        same[s].append(i)
    reps = {s: min(v) for s, v in same.items() if s}
    parent, links = {i: i for i in sets}, Counter()

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    every = list(reps.items())
    for k, (s, i) in enumerate(every):
        for t, j in every[:k]:
            if len(s & t) >= threshold * len(s | t) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (find(reps.get(s, i)), reps.get(s, i), len(same[s]) if s else 1, links[reps.get(s, i)]) for i, s in sets.items()}


class ContextTree:
    """Context-tree weighting by its definition, byte contexts up to five, binary decisions."""

    def __init__(self, texts, depth=5):
        self.depth, self.n, self.kids, self.memo = depth, Counter(), defaultdict(set), {}
        for t in texts:
            b = b"\xff" * depth + t.encode() + b"\xff"
            for i in range(depth, len(b)):
                for j in range(8):
                    node, bit = (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1
                    for d in range(depth + 1):
                        ctx = b[i - d : i]
                        self.n[ctx, node, bit] += 1
                        if d:
                            self.kids[ctx[1:], node].add(ctx)

    def kt(self, ctx, node):
        a, b = self.n[ctx, node, 0], self.n[ctx, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            own = self.kt(ctx, node)
            if len(ctx) < self.depth:
                below = sum(self.weighted(c, node) for c in self.kids[ctx, node])
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            self.memo[ctx, node] = own
        return self.memo[ctx, node]

    def bit(self, ctx, full, node, bit):
        a, b = self.n[ctx, node, 0], self.n[ctx, node, 1]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if len(ctx) == self.depth:
            return own
        w = math.exp(self.kt(ctx, node) - math.log(2) - self.weighted(ctx, node))
        return w * own + (1 - w) * self.bit(full[self.depth - len(ctx) - 1 :], full, node, bit)

    def log10(self, text):
        b = b"\xff" * self.depth + text.encode() + b"\xff"
        return sum(math.log10(self.bit(b"", b[i - self.depth : i], (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1)) for i in range(self.depth, len(b)) for j in range(8))
