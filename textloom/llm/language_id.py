"""Language identification in two steps: first the family, then one-versus-one linear support
vector machines between the languages of that family.

Features are the shares of hashed byte n-grams (1 to 3 bytes, ASCII letters lower-cased) in the
whole text. All machines (one-versus-rest for families, one-versus-one within them) are columns
of one weight table, so a text's margins are sums of table rows over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

#: Families of related languages (fixed values). A language that is not listed forms a family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
}
FEATURES = 1 << 12
#: Most labelled texts to learn from, shared evenly by the languages; a hash of the text picks them.
MAX_TRAIN = 2400
UNDETERMINED = "und"
DDL = "doc_id long, lang_pred string, score double, family string"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("family", pa.string())])


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature number at every byte (2 and 3 bytes that end there, in two columns), and offsets;
    n-grams do not cross documents, as a line break stands between them."""
    sep = [d + b"\n" for d in docs]
    buf, off = C.joined(sep)
    x = C.LOWER[buf].astype(np.uint32)
    x[C.byte_class((0x30, 0x39))[buf]] = 0x30
    prev = np.concatenate(([10], x[:-1])).astype(np.uint32) if len(x) else x
    prev2 = np.concatenate(([10], prev[:-1])).astype(np.uint32) if len(x) else x
    starts = off[:-1]
    prev[starts] = prev2[starts] = 10
    two = starts[np.diff(off) > 1] + 1
    prev2[two] = 10
    h2 = (x + prev * 256) * np.uint32(2654435761)
    h3 = (x + prev * 256 + prev2 * 65536) * np.uint32(2246822519)
    shift = np.uint32(32 - int(FEATURES).bit_length() + 1)
    return np.stack([h2 >> shift, (h3 >> shift) + np.uint32(FEATURES)]), off


def _shares(docs: list[bytes]) -> np.ndarray:
    """Square roots of feature shares: one dense float32 row of 2 * FEATURES per document."""
    out = np.zeros((len(docs), 2 * FEATURES), np.float32)
    f, off = features(docs)
    for d in range(len(docs)):
        s, e = off[d], off[d + 1]
        out[d] = np.bincount(f[:, s:e].ravel(), minlength=2 * FEATURES) / (e - s)
    return out


def _svm(x: np.ndarray, y: np.ndarray, steps: int = 120, lam: float = 1e-5) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated full-gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb, t = w.copy(), b, 1.0
    step = 1.0 / (2 * float((weight * ((x * x).sum(1) + 1)).sum()) + lam)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v + vb))
        g = -2 * weight * y * slack
        w2, b2 = v - step * (g @ x + lam * v), vb - step * float(g.sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


class Model:
    """Weight table (features x machines), biases, and which machine is which."""

    def __init__(self, families: dict[str, list[str]], machines: list[tuple], weights: np.ndarray, bias: np.ndarray):
        self.families, self.machines, self.weights, self.bias = families, machines, weights, bias

    def margins(self, docs: list[bytes]) -> np.ndarray:
        f, off = features(docs)
        n = np.diff(off)
        total = np.zeros((len(docs), len(self.machines)))
        for k in range(len(self.machines)):
            table = self.weights[:, k]
            total[:, k] = np.add.reduceat(table[f[0]] + table[f[1]], off[:-1], dtype=np.float64)
        return total / n[:, None] + self.bias

    def predict(self, docs: list[bytes]) -> tuple[list[str], np.ndarray, list[str]]:
        m = self.margins(docs) if self.machines else np.zeros((len(docs), 0))
        names = list(self.families)
        where = {k: i for i, k in enumerate(self.machines)}
        if len(names) == 1:
            family, sure = np.zeros(len(docs), int), np.ones(len(docs))
        else:
            s = m[:, [where["family", x] for x in names]]
            family = s.argmax(1)
            top = np.sort(s, axis=1)
            sure = 1 / (1 + np.exp(-2 * np.clip(top[:, -1] - top[:, -2], 0, 30)))
        langs, score = np.empty(len(docs), object), sure.copy()
        for k, name in enumerate(names):
            at = np.flatnonzero(family == k)
            own = self.families[name]
            if len(own) == 1 or not len(at):
                langs[at] = own[0]
                continue
            votes, margin = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for i, a in enumerate(own):
                for j in range(i + 1, len(own)):
                    x = m[at, where[name, a, own[j]]]
                    votes[:, i] += x >= 0
                    votes[:, j] += x < 0
                    margin[:, i] += x
                    margin[:, j] -= x
            best = (votes + 1e-3 * np.tanh(margin)).argmax(1)
            langs[at] = np.array(own, object)[best]
            score[at] *= 1 / (1 + np.exp(-2 * np.clip(np.abs(margin[np.arange(len(at)), best]), 0, 30)))
        return list(langs), score, [names[k] for k in family]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Model | None:
    """Learns from at most max_train texts with a letter and a language, each text once; None if
    there is no such row."""
    t = F.col(text_col).cast("string")
    rows = rows.select(t.alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & t.rlike(r"\p{L}"))
    sample = C.hash_sample(rows, "lang", max_train)
    if not sample:
        return None
    lang = np.array([x for x, _ in sample], object)
    families: dict[str, list[str]] = {}
    for x in sorted(set(lang)):
        families.setdefault(family_of(x), []).append(x)
    family = np.array([family_of(x) for x in lang], object)
    x = _shares([t for _, t in sample])
    used = np.flatnonzero(x.any(0))
    mean = x[:, used].std(0) + 1e-4
    x = x[:, used] / mean / len(used) ** 0.5
    jobs = []
    if len(families) > 1:
        jobs += [(("family", f), np.ones(len(lang), bool), family == f) for f in families]
    for f, own in families.items():
        jobs += [((f, a, b), (lang == a) | (lang == b), lang == a) for i, a in enumerate(own) for b in own[i + 1 :]]
    weights, bias = np.zeros((2 * FEATURES, len(jobs)), np.float32, order="F"), np.zeros(len(jobs))
    for k, (_, at, yes) in enumerate(jobs):
        w, bias[k] = _svm(x[at], np.where(yes[at], 1, -1).astype(np.float32))
        weights[used, k] = w / mean / len(used) ** 0.5
    return Model(families, [j[0] for j in jobs], weights, bias)


def has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(c.isalpha() for c in text.decode())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: lang_pred, score (0 to 1) and family.

    Null texts and texts without a letter get ``und`` and score 0; so do all texts if there was
    nothing to learn from. Other columns of docs are never looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in C.packed(batches, limit=C.CHUNK // 2):
            text = C.texts(b.column(1))
            lang, score, family = [UNDETERMINED] * len(text), np.zeros(len(text)), [UNDETERMINED] * len(text)
            at = [k for k, t in enumerate(text) if has_letter(t)] if model else []
            if at:
                a, score[at], c = model.predict([text[k] for k in at])
                for k, x, y in zip(at, a, c, strict=True):
                    lang[k], family[k] = x, y
            yield C.batch(SCHEMA, b.column(0), lang, score, family)

    return C.id_text(docs, id_col, text_col).mapInArrow(run, DDL)


def held_out(id_col: str = "doc_id") -> Column:
    return C.crc_mod(id_col, 3) == 1
