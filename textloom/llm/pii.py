"""Personal data by weak supervision.

1. Base spans (email, ip, card, phone) are found by fixed patterns and always stay.
2. Wider patterns propose further candidates. For every span, labelers of three sorts vote yes,
   no or nothing: pattern labelers (strict form, check sum, variety of characters), gazetteers
   (key names, given names, mail providers) and context labelers (words before it).
3. Expectation-maximisation over the counts of vote patterns in the whole corpus (a bounded
   number of patterns) estimates each labeler's reliability and each pattern's probability.
4. A logistic span classifier, trained on these probabilities over a bounded sample of spans,
   decides on the candidates.

Spans hold code-point offsets. The texts are read once; spans go through a written table.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textloom.llm import common as C

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "secret", "ssn")
#: Most spans that the span classifier learns from; a hash of their features picks them.
MAX_TRAIN = 4000
FEATURES = 512

# --- base spans -------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that fails from the first digit of a run fails from all of them: hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start; leftmost and non-overlapping within a kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- candidates and labelers ------------------------------------------------------------------

_WIDE = {
    "email": re.compile(r"[A-Za-z0-9_+-]{1,40}(?:\.[A-Za-z0-9_+-]{1,40}){0,4} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,40}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,12}){1,3}"),
    "phone": re.compile(r"(?<![0-9+.-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?:(?:sk|pk|rk|xox[a-z])-(?:[a-z]++-)*+)?(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{12,}+"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora|Sra?)\.? [A-Z]\w{1,20}(?: [A-Z]\w{1,20}){0,2}"),
}
#: A cheap test that says whether a wide pattern can match at all.
_HINTS = {
    "email": re.compile(r"[\[( ]dot[\]) ]"),
    "phone": re.compile(r"[0-9][ .-][0-9]{4}"),
    "ssn": re.compile(r"[0-9]-[0-9]{2}-[0-9]"),
    "secret": re.compile(r"[A-Za-z0-9_]{11}"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señora?|Sra?)\b"),
}
_KEY_NAMES = re.compile(r"(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|key|auth|bearer|credential)s?\W{0,6}$", re.I)
_GIVEN_NAMES = frozenset("anna maria john james mary robert michael david peter paul thomas hans klaus jean pierre marie luis carlos juan jose ana elena laura sofia martin julia".split())
_PROVIDERS = ("mail", "gmail", "yahoo", "outlook", "proton", "web", "gmx", "example", "company")
_KEY_PREFIXES = ("AKIA", "ASIA", "sk", "ghp", "xox", "AIza", "eyJ")
_CALL = re.compile(r"(?:phone|tel|telefon|teléfono|téléphone|call|mobile|fax|contact|reach|whatsapp)\W{0,4}(?:\w{1,4}\W{1,2})?$", re.I)
_WRITE = re.compile(r"(?:e-?mail|mail|correo|courriel|contact|write|from|to)\W{0,4}$", re.I)
_HOST = re.compile(r"(?:ip|host|server|address|addr|from)\W{0,4}$", re.I)
_PAY = re.compile(r"(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)\W{0,4}(?:\w{1,6}\W{1,2})?$", re.I)
_NUMBERING = re.compile(r"(?:version|ver|v|fig|figure|page|section|chapter|no|isbn|issn|doi|id|sha|md5|commit|build|release)\W{0,3}$", re.I)
_OWN_CONTEXT = {"email": _WRITE, "ip": _HOST, "card": _PAY, "phone": _CALL, "ssn": re.compile(r"(?:ssn|social security|sozialversicherung)\W{0,6}$", re.I), "secret": _KEY_NAMES, "name": re.compile(r"(?:name|nom|nombre|signed|by|dear|von|de)\W{0,4}$", re.I)}


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _strict(kind: str, s: str, base: bool) -> int:
    if base:
        return 1
    if kind == "secret":
        return 1 if re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}|(?:AKIA|ASIA)[0-9A-Z]{12,}", s) else 0
    if kind == "ssn":
        return 0 if s[:3] not in ("000", "666") and s[4:6] != "00" and s[7:] != "0000" else -1
    return 0


def _variety(kind: str, s: str) -> int:
    """Do the characters vary as random keys and numbers do?"""
    if kind == "secret":
        h = _entropy(s)
        return 1 if h >= 3.0 and sum(c.isdigit() for c in s) >= 2 else -1 if h < 2.2 or s.isdigit() else 0
    if kind in ("card", "phone", "ssn"):
        return -1 if len(set(_digits(s))) <= 2 else 0
    return 0


def _checksum(kind: str, s: str) -> int:
    return (1 if luhn(_digits(s)) else -1) if kind == "card" else 0


def _gazetteer(kind: str, s: str) -> int:
    if kind == "name":
        return 1 if any(w.lower() in _GIVEN_NAMES for w in s.split()) else 0
    if kind == "email":
        return 1 if any(x in s.lower().partition("@")[2] or x in s.lower().partition(" at ")[2] for x in _PROVIDERS) else 0
    if kind == "secret":
        return 1 if s.startswith(_KEY_PREFIXES) else 0
    return 0


def _context(kind: str, before: str) -> int:
    return 1 if _OWN_CONTEXT[kind].search(before) else 0


def _numbering(kind: str, before: str) -> int:
    return -1 if _NUMBERING.search(before) else 0


LABELERS = ("strict", "variety", "checksum", "gazetteer", "context", "numbering")


def votes(kind: str, s: str, before: str, base: bool) -> list[int]:
    return [_strict(kind, s, base), _variety(kind, s), _checksum(kind, s), _gazetteer(kind, s), _context(kind, before), _numbering(kind, before)]


def span_features(kind: str, s: str, before: str) -> list[int]:
    """Numbers of the features of a span, from its form and the two words before it."""
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", s[:160]))))[:12]
    words = re.findall(r"\w+|[^\w\s]", before.lower())[-2:]
    digits = sum(c.isdigit() for c in s) * 8 // max(1, len(s))
    names = [f"k={kind}", f"n={kind}{min(9, len(s) // 6)}", f"d={kind}{digits}", f"s={kind}{shape}", f"h={kind}{int(_entropy(s[:160]) * 2)}", *(f"w={w}" for w in words)]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in names})


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the wider patterns that overlap no base span and no candidate of an earlier kind."""
    out: list[tuple[str, int, int]] = []
    for kind, wide in _WIDE.items():
        if _HINTS[kind].search(text):
            taken = Taken([*base, *out])
            out += [(kind, m.start(), m.end()) for m in wide.finditer(text) if not taken.overlaps(m.start(), m.end())]
    return out


class Taken:
    """Spans, for tests of overlap: the furthest end of those that start before a place decides."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        by_start = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in by_start]
        self.ends = list(itertools.accumulate((e for _, e in by_start), max))

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(SPAN))])
DDL = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean, votes: string, features: array<int>>>"


def _spans(text: str) -> list[dict]:
    base = base_spans(text)
    out = []
    for is_base, (kind, s, e) in [*((True, x) for x in base), *((False, x) for x in candidates(text, base))]:
        before = text[max(0, s - 40) : s]
        v = votes(kind, text[s:e], before, is_base)
        out.append({"kind": kind, "start": s, "end": e, "base": is_base, "votes": ",".join(map(str, v)), "features": span_features(kind, text[s:e], before)})
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its base spans and candidates with votes and features (step 1 and 2)."""

    def run(batches):
        for b in C.packed(batches):
            yield C.batch(SCHEMA, b.column(0), [_spans(t.decode()) for t in C.texts(b.column(1))])

    return C.id_text(docs, id_col, text_col).mapInArrow(run, DDL)


# --- expectation-maximisation and the span classifier -----------------------------------------


class LabelModel:
    """Reliabilities of the labelers: P(vote | personal data or not), by EM over vote patterns."""

    def __init__(self, patterns: dict[str, int], rounds: int = 50):
        self.v = np.array([[int(x) for x in p.split(",")] for p in patterns], int).reshape(len(patterns), len(LABELERS)) + 1
        n = np.array(list(patterns.values()), float)
        q = 1 / (1 + np.exp(-1.5 * (self.v - 1).sum(1)))  # start: weighted majority
        for _ in range(rounds):
            self.fit(q, n)
            q = self.posterior(self.v)
        self.q = dict(zip(patterns, q, strict=True))

    def fit(self, q: np.ndarray, n: np.ndarray) -> None:
        self.prior = float(np.clip((q * n).sum() / n.sum(), 0.02, 0.45))  # without votes, rather not
        self.p = np.empty((2, len(LABELERS), 3))
        for c, w in ((1, q * n), (0, (1 - q) * n)):
            for k in range(len(LABELERS)):
                x = np.bincount(self.v[:, k], weights=w, minlength=3) + 0.5
                # a labeler is never better than chance in the wrong direction
                self.p[c, k] = x / x.sum()
        for k in range(len(LABELERS)):
            for vote, better in ((2, 1), (0, 0)):
                if self.p[better, k, vote] < self.p[1 - better, k, vote]:
                    self.p[:, k, vote] = self.p[:, k, vote].mean()

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.array([[math.log(1 - self.prior)], [math.log(self.prior)]]) + np.zeros((2, len(v)))
        for k in range(len(LABELERS)):
            said = v[:, k] != 1  # a labeler that says nothing says nothing
            log[:, said] += np.log(self.p[:, k][:, v[said, k]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))

    def reliability(self) -> dict[str, float]:
        """Of each labeler: how often its votes agree with the estimated truth."""
        out = {}
        for k, name in enumerate(LABELERS):
            right = self.prior * self.p[1, k, 2] + (1 - self.prior) * self.p[0, k, 0]
            wrong = self.prior * self.p[1, k, 0] + (1 - self.prior) * self.p[0, k, 2]
            out[name] = float(right / (right + wrong))
        return out


class SpanClassifier:
    """Logistic regression on the span features, by Newton-like gradient steps."""

    def __init__(self, rows: list[list[int]], q: np.ndarray, steps: int = 400, rate: float = 2.0, decay: float = 1e-3):
        x = np.zeros((len(rows), FEATURES))
        for k, f in enumerate(rows):
            x[k, f] = 1
        self.w, self.b = np.zeros(FEATURES), 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x @ self.w + self.b)))
            d = (p - q) / len(q)
            self.w -= rate * (x.T @ d + decay * self.w)
            self.b -= rate * d.sum()

    def probability(self, features: list[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.w[features].sum()) + self.b))))


def train(found: DataFrame, max_train: int = MAX_TRAIN) -> tuple[LabelModel, SpanClassifier] | None:
    """Models from the spans that find() wrote; None if there are none."""
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    patterns = {r["votes"]: r["count"] for r in spans.groupBy("votes").count().collect()}
    if not patterns:
        return None
    labels = LabelModel(dict(sorted(patterns.items())))
    total = sum(patterns.values())
    h = F.xxhash64("kind", "votes", "features", "start")
    rows = spans.select("votes", "features", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < min(1.0, 1.5 * max_train / total) * (1 << 30)).orderBy("h", "votes", "features").limit(max_train).collect()
    if not rows:
        return None
    return labels, SpanClassifier([r["features"] for r in rows], np.array([labels.q[r["votes"]] for r in rows]))


OUT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))])
OUT_DDL = "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>"


def decide(spans: list[dict], model, threshold: float) -> list[tuple[str, int, int, bool]]:
    """Base spans and the candidates that the classifier accepts, by kind as listed, then start."""
    kept = [(s["kind"], s["start"], s["end"], s["base"]) for s in spans if s["base"] or (model and model[1].probability(s["features"]) >= threshold)]
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row of docs all its spans (kind, start, end in code points, base), by kind, then start.

    Null and empty texts have none. Repeated rows give repeated rows. The spans found go through
    a table in the shared folder, so that the texts are read once.
    """
    found = C.materialize(find(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(train(found))

    def run(batches):
        for b in batches:
            out = [[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in decide(s, shared.value, threshold)] for s in b.column(1).to_pylist()]
            yield C.batch(OUT, b.column(0), out)

    return found.mapInArrow(run, OUT_DDL)


def masked(text: str, spans) -> str:
    """The text with each span (overlaps united) replaced by its kind in angle brackets."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"<{kind}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, with the personal data of each text masked; null texts stay null.

    Spans are found once: docs go through the shared folder with them, and documents are not
    shuffled.
    """
    C.small_batches(docs.sparkSession)
    at, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField("__spans", StructType.fromDDL(DDL)["spans"].dataType)])

    def mark(batches):
        for b in C.packed(batches, at):
            spans = pa.array([_spans(t.decode()) for t in C.texts(b.column(at))], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays([*b.columns, spans], names=[*b.schema.names, "__spans"])

    marked = C.materialize(docs.mapInArrow(mark, schema))
    shared = docs.sparkSession.sparkContext.broadcast(train(marked.select(F.col("__spans").alias("spans"))))

    def clean(t: str | None, found: list[dict]) -> str | None:
        spans = decide(found, shared.value, threshold) if t else []
        return masked(t, [x[:3] for x in spans]) if spans else t

    def run(batches):
        for b in C.packed(batches, at):
            text = [clean(*x) for x in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(text, b.schema.field(at).type), *b.columns[at + 1 : -1]], names=b.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)
