import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import common as C
from textloom.llm import context_tree, decontaminate, jaccard_join, language_id, pieces, pii, quality_classifier, quality_rules, suffix_dedup, token_counts

from . import brute

SCHEMA = "doc_id long, text string"
#: Extra columns whose names clash with those that operators make.
CLASHING = "doc_id long, text string, score double, kept string, spans string, n_words int, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(spark):
    rows = [(1, None, None, None, None, None, None), (2, "", 0.1, "x", "", 1, 1), (3, "a b c " * 40, 0.2, None, "y", 2, 0), (3, "a b c " * 40, 0.2, None, "y", 2, 0), (4, "é" * 9000, 0.0, "", "", 0, 0)]
    return spark.createDataFrame(rows, CLASHING)


def words(r, n, vocabulary="abcdefgh"):
    return " ".join(r.choice(vocabulary) * r.randrange(1, 4) for _ in range(n))


# --- operator 1 -------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [10**6, 9])
def test_context_tree_is_the_definition(spark, chunk):
    rows = [(1, "abab abba"), (2, "abcab"), (3, "abad é"), (4, None), (5, "")]
    tree = brute.ContextTree(["abab abba", "abcab"])
    out = {r.doc_id: r for r in context_tree.score(frame(spark, rows), F.col("doc_id") < 3, chunk=chunk).collect()}
    for i, t in rows:
        assert out[i].score == pytest.approx(tree.log10(t or ""), rel=1e-5)
    assert out[3].n_tokens == 3 and out[3].n_known == 1 and out[3].train_tokens == 5
    # tokens abab, abba, abcab and two ends; four of them distinct
    assert out[1].base_score == pytest.approx(math.log10(2 / 10) * 2 + math.log10(3 / 10))


def test_context_tree_without_training(spark):
    r = context_tree.score(frame(spark, [(1, "ab")]), F.lit(False)).first()
    assert r.score == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-6) and r.base_score == 0 and r.n_known == 0
    assert context_tree.score(frame(spark, []), F.lit(True)).count() == 0


def test_context_tree_buckets_follow_the_text_and_split_pairs_of_bytes(spark, monkeypatch):
    keys = np.array([[int.from_bytes(bytes([101, 32, c, 97, 98, d])) for d in range(97, 110)] for c in range(97, 123)], np.uint64).reshape(-1)
    buckets = context_tree.bucket_of(context_tree.GRAM, keys, 8).reshape(26, -1)
    assert len(np.unique(buckets)) > 13 and (buckets == buckets[:, :1]).all()
    cuts = list(context_tree.slices(np.sort(keys), 30))
    assert sum(len(keys[x]) for x in cuts) == len(keys) and all(len(keys[x]) % 13 == 0 and len(keys[x]) <= 52 for x in cuts) and len(cuts) > 8
    seen, gather = [], context_tree.gather
    monkeypatch.setattr(context_tree, "gather", lambda chunks, bits: seen.append(bits) or gather(chunks, bits))
    monkeypatch.setattr(context_tree, "SHARE", 10, raising=False)
    rows = [(k, words(random.Random(k), 40)) for k in range(20)]
    out = {r.doc_id: r.score for r in context_tree.score(frame(spark, rows).coalesce(1), F.col("doc_id") < 15).collect()}
    tree = brute.ContextTree([t for k, t in rows if k < 15])
    assert seen[0] >= 7 and all(out[k] == pytest.approx(tree.log10(t), rel=1e-5) for k, t in rows)


# --- operator 2 -------------------------------------------------------------------------------


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination_matches_brute_force(spark, block_words):
    r = random.Random(2)
    items = [(k, words(r, r.choice([0, 1, 3, 12, 13, 14, 30]))) for k in range(12)] + [(99, None)]
    rows = []
    for i in range(60):
        parts = [words(r, r.randrange(0, 30))]
        if r.random() < 0.7:
            w = (r.choice(items)[1] or "").split()
            parts.append(" ".join(w[r.randrange(0, 3) :]).upper())
        rows.append((i, None if i == 7 else "-- ".join(parts)))
    found = decontaminate.matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    out = {x.doc_id: x for x in decontaminate.report(found).collect()}
    for i, t in rows:
        n, hit, names = brute.hits(t, items)
        assert (out[i].n_words, out[i].n_hit, list(out[i]["items"])) == (n, hit, names), t
        assert out[i].contaminated == (hit > 0 and 20 * hit >= n)
        for s, e in zip(out[i].starts, out[i].ends, strict=True):
            assert t.encode()[s:e].decode().strip()


def test_decontamination_drops_and_cuts(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"before it {item} after it"), (2, "clean"), (3, None)]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame(spark, rows), items).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, rows), items, action="cut").collect()}
    assert cut == {1: "before it \n after it", 2: "clean", 3: None}


# --- operator 3 -------------------------------------------------------------------------------


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_match_plain_patterns():
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choice("aZ9.@-+ ( )1023 45_%é\n") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("9" * 50_000 + "@" + "a" * 50_000) == []


@pytest.mark.parametrize("action", ["drop", "cut"])
def test_blocks_of_items_keep_rows_with_null_and_equal_ids(spark, action):
    r = random.Random(22)
    item = [words(r, 20, "abcdefgh") for _ in range(4)]
    items = spark.createDataFrame(list(enumerate(item)), "item_id long, text string")
    rows = [(None, item[0]), (None, "clean"), (1, item[1]), (1, "clean too"), (2, item[2] + " " + item[3]), (2, item[2] + " " + item[3]), (None, None)]
    df = frame(spark, rows)
    one = decontaminate.decontaminate(df, items, action)
    many = decontaminate.decontaminate(df, items, action, block_words=30)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))
    assert many.count() == (3 if action == "drop" else 7)
    assert sorted(map(repr, decontaminate.matches(df, items, block_words=30).collect())) == sorted(map(repr, decontaminate.matches(df, items).collect()))



def test_secret_candidates_are_whole_runs():
    r = random.Random(33)
    long = "".join(r.choice("abcXYZ019") for _ in range(5000))
    for key in ("a" * 70 + "7" * 90, long, "ghp_" + "a1B2" * 9, "sk_live_" + "9zY8" * 6):
        assert [m.group() for m in pii._WIDE["secret"].finditer(f"x {key}, y")] == [key]
    key = "sk-proj-" + "aB3d" * 10
    assert [m.group() for m in pii._WIDE["secret"].finditer(f"well-known-thing {key}")] == [key]
    assert not pii._WIDE["secret"].search("only_letters_in_here " + "1" * 40 + " __________________ " + "z" * 100_000)


def test_overlap_is_exact():
    r = random.Random(34)
    for _ in range(300):
        spans = [("x", s, s + r.choice([1, 3, 40, 200])) for s in (r.randrange(300) for _ in range(r.randrange(20)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            s = r.randrange(320)
            e = s + r.randrange(1, 9)
            assert taken.overlaps(s, e) == any(a < e and b > s for _, a, b in spans)


def test_personal_data(spark):
    secret = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [(k, f"mail é{k} to a{k}@b.example or +1 (555) 123-45{k:02}") for k in range(20)] + [(50, f'token = "{secret}" here'), (51, "nothing here"), (52, None), (53, "")]
    out = {r.doc_id: r.spans for r in pii.personal_data(frame(spark, rows)).collect()}
    assert [(s.kind, s.start, s.end) for s in out[3]] == plain_base(rows[3][1])
    assert [(s.kind, s.base) for s in out[50]] == [("secret", False)]
    assert out[51] == out[52] == out[53] == []
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[50] == 'token = "<secret>" here' and clean[51] == "nothing here" and clean[52] is None
    assert "@" not in clean[3]


def test_label_model_finds_the_bad_labeler():
    good, bad = "1,1,1,1,0,0", "-1,-1,-1,1,0,0"
    model = pii.LabelModel({good: 50, bad: 50, "1,1,1,-1,0,0": 50, "-1,-1,-1,-1,0,0": 50})
    assert model.q[good] > 0.9 and model.q[bad] < 0.1
    assert model.reliability()["gazetteer"] < model.reliability()["strict"]


# --- operators 4 and 6 ------------------------------------------------------------------------


def test_quality_gradient_is_right():
    r = np.random.default_rng(0)
    docs = [bytes(r.integers(97, 110, n, dtype=np.uint8)) for n in (0, 5, 300, 900)]
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    net = quality_classifier.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["hidden_bias"] += r.normal(0, 0.1, len(net.p["hidden_bias"]))  # off the kink of empty texts

    def loss():
        p = net.forward(docs)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradient(docs, y, w)
    for key, at in (("out", 3), ("out", 20), ("hidden", (2, 3)), ("bias", 1), ("filters", (5, 2))):
        old, e = net.p[key][at], 1e-4
        net.p[key][at] = old + e
        up = loss()
        net.p[key][at] = old - e
        down = loss()
        net.p[key][at] = old
        assert g[key][at] == pytest.approx((up - down) / 2 / e, rel=0.05, abs=2e-4), key


def test_quality_forward_pass_is_the_definition():
    r = np.random.default_rng(2)
    docs = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 120, 128, 129, 255, 256, 700, 2000)]
    net = quality_classifier.Network(seed=4)
    p, Q = net.p, quality_classifier
    for d, got in zip(docs, net.score(docs), strict=True):
        n = max(2, -(-(len(d) + Q.WIDTH) // Q.HALF))
        bits = lambda byte: np.zeros(8) if byte == 0 else np.array([1.0 if byte >> k & 1 else -1.0 for k in range(8)])
        padded = [bits(x) for x in d + bytes(n * Q.HALF - len(d))]
        respond = lambda at: np.concatenate(padded[at : at + Q.WIDTH]) @ p["filters"]
        features = []
        for chunk in range(n - 1):
            places = [at for at in range(chunk * Q.HALF, chunk * Q.HALF + Q.CHUNK, Q.STRIDE) if at + Q.WIDTH <= len(padded)]
            pool = np.max([respond(at) for at in places], axis=0) + p["bias"]
            seen = np.append(np.tanh(pool / 4), min(1, len(d) / Q.CHUNK))
            features.append(np.maximum(0, seen @ p["hidden"] + p["hidden_bias"]))
        both = np.concatenate([np.mean(features, axis=0), np.max(features, axis=0)])
        assert got == pytest.approx(1 / (1 + math.exp(-float(both @ p["out"] + p["out_bias"][0]))), abs=1e-5), len(d)


def test_quality_learns_from_whole_texts(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "river", "and", "stone", "lamp", "went", "over"]) for _ in range(r.randrange(5, 120)))
    bad = lambda: " ".join(r.choice(["$$$", "###", "%%%"]) + r.choice("XYZ") for _ in range(r.randrange(60, 120)))
    rows = [(k, good() if k % 3 else bad()) for k in range(240)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(160)], "doc_id long, quality int")
    model = quality_classifier.train(frame(spark, rows), labels)
    out = {x.doc_id: x.score for x in quality_classifier.classify(frame(spark, [*rows, (900, None)]), model).collect()}
    assert sum((out[k] >= 0.5) == (k % 3 > 0) for k in range(160, 240)) >= 76
    assert 0 <= out[900] <= 1
    assert quality_classifier.train(frame(spark, rows), labels.where("quality = 1")) is None
    assert {x.score for x in quality_classifier.classify(frame(spark, rows), None).collect()} == {0.5}


def test_language_families_then_pairs(spark):
    r = random.Random(3)
    vocab = {"en": ["the", "thing", "with", "house"], "de": ["der", "schön", "und", "zeit"], "fr": ["le", "été", "avec", "eau"], "es": ["el", "niño", "con", "ción"], "xx": ["qqz", "zzq"]}
    rows = [(k, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang) for k in range(100) for lang in [list(vocab)[k % 5]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert set(model.families) == {"germanic", "romance", "xx"}
    out = {x.doc_id: x for x in language_id.identify(df.select("doc_id", "text").unionByName(frame(spark, [(900, None), (901, "12 !?"), (902, "")])), model).collect()}
    assert all(out[k].lang_pred == lang for k, _, lang in rows)
    assert [out[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and out[901].score == 0
    assert language_id.train(df.where("false")) is None
    assert {x.lang_pred for x in language_id.identify(df, None).collect()} == {"und"}


def test_language_votes_are_the_definition(spark):
    r = random.Random(31)
    vocab = {"en": "abcde", "de": "cdefg", "nl": "bcdfg", "fr": "xyzab", "es": "wxyza"}
    rows = [(k, " ".join("".join(r.choice(vocab[lang]) for _ in range(4)) for _ in range(12)), lang) for k in range(100) for lang in [list(vocab)[k % 5]]]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = [t.encode() for _, t, _ in rows[:20]] + [b"a", b"ab 12"]
    langs, score, family = model.predict(docs)
    where = {k: i for i, k in enumerate(model.machines)}
    shift = 32 - int(language_id.FEATURES).bit_length() + 1
    for d, lang, s, f in zip(docs, langs, score, family, strict=True):
        x = [10, 10, *(0x30 if 48 <= c <= 57 else c for c in d.lower()), 10]
        margin = np.array(model.bias, float)
        for k in range(2, len(x)):
            two = (x[k] + x[k - 1] * 256) * 2654435761 % 2**32 >> shift
            three = ((x[k] + x[k - 1] * 256 + x[k - 2] * 65536) * 2246822519 % 2**32 >> shift) + language_id.FEATURES
            margin += (model.weights[two].astype(float) + model.weights[three]) / (len(d) + 1)
        sides = {n: margin[where["family", n]] for n in model.families}
        best = max(sides, key=sides.get)
        assert f == best
        order = sorted(sides.values())
        sure = 1 / (1 + math.exp(-2 * (order[-1] - order[-2])))
        own = model.families[best]
        votes, total = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                m = margin[where[best, a, b]]
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
        first = max(own, key=lambda a: votes[a] + 1e-3 * math.tanh(total[a]))
        assert lang == first and s == pytest.approx(sure * (1 / (1 + math.exp(-2 * abs(total[first]))) if len(own) > 1 else 1), rel=1e-3)


# --- operator 5 -------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [400, 3])
def test_join_loses_no_link(spark, block):
    r = random.Random(6)
    rows, base = [], [[r.choice("abcdefghijklmnop") * 3 + str(r.randrange(40)) for _ in range(r.randrange(20, 90))] for _ in range(6)]
    for i in range(110):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(5))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "one  TWO"), (204, " \n")]
    expect = brute.classes(rows)
    out = jaccard_join.join(frame(spark, rows), block_docs=block, block_signed=block).collect()
    assert len(out) == len(rows)
    for x in out:
        assert (x.class_id, x.rep_id, x.n_copies, x.n_links) == expect[x.doc_id], x
    kept = {x.doc_id for x in jaccard_join.one_of_each(frame(spark, rows)).collect()}
    assert kept == {c for c, *_ in expect.values()}


def test_one_row_of_each_class_is_kept(spark):
    r = random.Random(25)
    a, b, c = (words(r, 60, "abcdefgh") for _ in range(3))
    rows = [(5, a), (5, a), (5, a), (7, a), (9, a), (9, b), (None, a), (None, a), (11, ""), (11, ""), (12, c), (3, c)]
    kept = sorted(map(repr, map(tuple, jaccard_join.one_of_each(frame(spark, rows).select("doc_id", "text")).collect())))
    assert kept == sorted(map(repr, [(5, a), (9, b), (None, a), (None, a), (11, ""), (11, ""), (3, c)]))


def test_posterior_bound():
    least = jaccard_join.least_matches(0.8, 1e-7, 160, 32)
    for n, m in least.items():
        tail = sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail >= 1e-7 and (m == 0 or tail - math.comb(n + 1, m) * 0.8**m * 0.2 ** (n + 1 - m) < 1e-7)


# --- operator 7 -------------------------------------------------------------------------------


def test_rules_match_brute_force(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(words(r, r.randrange(0, 12), "ab#") for _ in range(r.randrange(0, 6)))) for i in range(80)] + [(900, None), (901, ""), (902, "x" * 100_000)]
    for x in quality_rules.measures(frame(spark, rows)).collect():
        t = dict(rows)[x.doc_id] or ""
        w = brute.SPACED.findall(t)
        g = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        cover = {k + j for k, y in enumerate(g) if g.count(y) > 1 for j in range(5)}
        lines = [y for y in t.split("\n") if brute.SPACED.search(y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), len(lines) - len(set(lines)), len(cover))
    plan = quality_rules.apply_rules(frame(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- operator 8 -------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"hot": 2, "most_held": 50}, {"hot": 3, "piece": 150, "bits": 6}])
def test_repeats_match_brute_force(spark, options):
    r = random.Random(8)
    base = ["".join(r.choice("abc é") for _ in range(r.randrange(60, 400))) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(r.choice(base)[r.randrange(40) :][: r.randrange(50, 400)] if r.random() < 0.7 else r.choice(["a" * r.randrange(1, 400), "xy" * r.randrange(1, 150)]) for _ in range(r.randrange(0, 5)))
        rows.append((i, t if i % 17 else None))
    expect = brute.removed(rows)
    out = suffix_dedup.remove_repeats(frame(spark, rows), **options).collect()
    assert len(out) == len(rows)
    for x in out:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == expect[x.doc_id], x.doc_id


@pytest.mark.parametrize("options", [{}, {"hot": 2, "most_held": 50}, {"hot": 3, "piece": 150, "bits": 6}])
def test_repeated_rows_lose_only_what_starts_earlier(spark, options):
    r = random.Random(18)
    base = ["".join(r.choice("abc é") for _ in range(300)) for _ in range(4)]
    rows = [(i, r.choice(base)[r.randrange(100) :] + r.choice(base)[: r.randrange(50, 300)] + "xy" * r.randrange(80)) for i in range(24)]
    rows += [(100, "".join(r.choice("defg") for _ in range(250))), (101, "ab" * 120)]
    expect = brute.removed(rows)
    assert expect[100][1] == 0
    df = frame(spark, rows + rows[5:9] + rows[-2:] + rows[-2:]).repartition(5)
    out = suffix_dedup.remove_repeats(df, **options).collect()
    assert len(out) == len(rows) + 8
    for x in out:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == expect[x.doc_id], x.doc_id


def test_buckets_of_repeats_follow_the_text(spark, monkeypatch):
    r, seen, grouped = random.Random(28), [], C.tasks
    rows = [(k, "".join(r.choice("abc") for _ in range(400)) * r.randrange(1, 3)) for k in range(40)]
    monkeypatch.setattr(suffix_dedup, "SHARE", 100, raising=False)
    monkeypatch.setattr(C, "tasks", lambda bits, each: seen.append((bits, grouped(bits, each))) or grouped(bits, each))
    out = suffix_dedup.remove_repeats(frame(spark, rows).coalesce(1)).collect()
    assert seen == [(int(sum(len(t) for _, t in rows) // 100).bit_length(), 64)]
    expect = brute.removed(rows)
    assert all((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == expect[x.doc_id] for x in out) and len(out) == 40
    assert [grouped(bits, 8) for bits in (1, 6, 7, 11)] == [2, 64, 64, 256]


# --- operator 9 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.MODEL)


def test_pieces_without_dropout_are_the_models(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice([" ", "  ", "     ", "th", "e", "\n", "é", "漢", "😀", "ing", "the", "\t", "<s>", "\x00", "0"]) for _ in range(r.randrange(40)))
        ids, _ = model.encode([t], [1], 0.0)
        assert ids.tolist() == sp.encode(t)


def test_dropout_is_lossless_seeded_and_varied(model):
    texts = ["the theorem of the things  that ▁ were said " * 3, "", " ", "x" * 5000 + " é漢", "a\nb"]
    for rate in (0.1, 0.5, 1.0):
        ids, ends = model.encode(texts, list(range(5)), rate)
        assert [t.decode() for t in model.decode(ids, ends)] == texts
        again, _ = model.encode(texts, list(range(5)), rate)
        assert ids.tolist() == again.tolist()
    a, b = (model.encode(["the theorem of all things " * 5], [1], 0.3, seed=s)[0].tolist() for s in (1, 2))
    assert a != b


def test_heap_and_rounds_agree(model, monkeypatch):
    r = random.Random(10)
    for _ in range(60):
        t = "".join(r.choice(["the", "ing", "a", "é", "tion", "x"]) for _ in range(r.randrange(1, 40)))
        ids, _ = model.encode([t], [3], 0.3)
        monkeypatch.setattr(pieces, "LONG", 0)
        assert model.encode([t], [3], 0.3)[0].tolist() == ids.tolist()
        monkeypatch.setattr(pieces, "LONG", 200)


def every_one(unique):
    """np.unique that takes every unit for a class of its own."""
    return lambda x, **kw: (x, np.arange(len(x)), np.arange(len(x)), np.ones(len(x), int)) if "return_counts" in kw else unique(x, **kw)


def test_dropout_draws_for_every_occurrence(model):
    n = 4000
    for w in ("the", "thing", "theorem"):
        ids, ends = model.encode([w] * n, list(range(n)), 0.1)
        whole = model.encode([w], [0], 0.0)[0].tolist()
        got = [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        assert len({tuple(x) for x in got}) > 4
        # at least one merge makes the piece, and each is skipped at the rate
        assert 0.05 < sum(x != whole for x in got) / n < 0.95
    inside = model.encode(["the " * n], [1], 0.1)[0]
    assert len(set(inside.tolist())) > 4


def test_shared_draws_equal_those_of_each_unit_alone(model, monkeypatch):
    r = random.Random(12)
    texts = [" ".join(r.choice(["the", "things", "é漢x", "theorem", "mathematical", "a", "aaaaaaaaa", "in" * 120]) for _ in range(60)) for _ in range(12)]
    for rate in (0.05, 0.3, 0.9):
        ids, ends = model.encode(texts, list(range(12)), rate)
        together = [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        assert together == [model.encode([t], [k], rate)[0].tolist() for k, t in enumerate(texts)]
        with monkeypatch.context() as m:
            m.setattr(pieces.np, "unique", every_one(np.unique))
            assert together == [model.encode([t], [k], rate)[0].tolist() for k, t in enumerate(texts)]


# --- operator 10 ------------------------------------------------------------------------------


def test_fields_share_the_tokens_of_the_whole(spark):
    rows = [(1, "a title", "the body\n\nof it", None), (2, None, "", ""), (3, "", "é漢 x", "end")]
    df = spark.createDataFrame(rows, "doc_id long, title string, text string, note string")
    encode, length = token_counts.encoder(token_counts.VOCABULARY)
    for rule in token_counts.RULES:
        for x in token_counts.field_counts(df, ["title", "text", "note"], rule=rule).collect():
            parts = [(p or "").encode() for p in rows[x.doc_id - 1][1:]]
            whole = b"\n\n".join(parts)
            ids = encode.encode_ordinary(whole.decode())
            expect, at = [0, 0, 0], 0
            bounds = [0, len(parts[0]) + 2, len(parts[0]) + len(parts[1]) + 4, len(whole)]
            for i in ids:
                span = range(at, at + int(length[i]))
                at = span.stop
                share = [sum(bounds[k] <= b < bounds[k + 1] for b in span) for k in range(3)]
                place = {"start": lambda: next(k for k in range(3) if bounds[k] <= span[0] < bounds[k + 1]), "end": lambda: next(k for k in range(3) if bounds[k] <= span[-1] < bounds[k + 1]), "majority": lambda: share.index(max(share))}[rule]()
                expect[place] += 1
            assert (x.n_tokens, x.field_tokens) == (len(ids), expect), (rule, x)
    with pytest.raises(ValueError):
        token_counts.field_counts(df, [])


def test_section_counts_match_brute_force(spark):
    r = random.Random(41)
    rows = [(k, "".join(r.choice(["word ", "é漢", "\n", "\n\n", "  ", "x1", "!"]) for _ in range(r.randrange(60)))) for k in range(40)]
    encode, length = token_counts.encoder(token_counts.VOCABULARY)
    out = {x.doc_id: x for x in token_counts.token_counts(frame(spark, rows)).collect()}
    for i, t in rows:
        b = t.encode()
        owner, section = [], 0
        for k, c in enumerate(b):
            owner.append(section)
            section += c == 10 and k + 1 < len(b) and b[k + 1] != 10
        expect, at, crossing = [0] * (max(owner) + 1 if owner else 0), 0, 0
        for token in encode.encode_ordinary(t):
            own = owner[at : at + int(length[token])]
            at += int(length[token])
            crossing += own[0] != own[-1]
            expect[max(sorted(set(own)), key=own.count)] += 1
        assert [s.n_tokens for s in out[i].sections] == expect and out[i].n_crossing == crossing, t


def test_tokens_are_attributed_by_rule(spark):
    ends, stops = np.array([2, 5, 9]), np.array([3, 4, 9])
    assert [token_counts.allocate(ends, stops, r)[0].tolist() for r in ("start", "end", "majority")] == [[0, 0, 2], [0, 2, 2], [0, 0, 2]]
    rows = [(1, "one two\n\nthree é\nfour"), (2, ""), (3, None), (4, "\n")]
    out = {x.doc_id: x for x in token_counts.token_counts(frame(spark, rows)).collect()}
    encode, _ = token_counts.encoder(token_counts.VOCABULARY)
    for i, t in rows:
        assert out[i].n_tokens == len(encode.encode_ordinary(t or "")) == sum(s.n_tokens for s in out[i].sections)
        assert "".join((t or "")[s.start_char : s.end_char] for s in out[i].sections) == (t or "")
    with pytest.raises(ValueError):
        token_counts.token_counts(frame(spark, rows), rule="other")


# --- all of them on odd tables ----------------------------------------------------------------


def test_clashing_names_nulls_and_repeats(spark):
    df = clashing(spark)
    items = spark.createDataFrame([(1, None)], "item_id long, text string")
    labels = spark.createDataFrame([(2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    for out in (
        context_tree.score(df, F.col("doc_id") > 1),
        decontaminate.report(decontaminate.matches(df, items)),
        decontaminate.decontaminate(df, items),
        pii.personal_data(df),
        pii.redact(df),
        quality_classifier.classify(df, quality_classifier.train(df, labels)),
        jaccard_join.join(df),
        language_id.identify(df, None),
        quality_rules.apply_rules(df),
        suffix_dedup.remove_repeats(df),
        pieces.decode(pieces.encode(df, keep_text=True)),
        token_counts.token_counts(df),
    ):
        assert out.count() == 5


def test_empty_tables(spark):
    df = spark.createDataFrame([], CLASHING)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.train(df, labels) is None
    for out in (
        decontaminate.matches(df, items),
        pii.personal_data(df),
        jaccard_join.join(df),
        quality_rules.apply_rules(df),
        suffix_dedup.remove_repeats(df),
        pieces.encode(df),
        token_counts.token_counts(df),
    ):
        assert out.count() == 0


def test_rows_of_null_ids_ties_and_repeats_are_the_same_as_alone(spark):
    """Whatever stands beside it, a row gets the result of its text; rows that come again as well."""
    r = random.Random(51)
    long = " ".join(r.choice(["river", "stone", "lamp", "q@b.example", "1234"]) for _ in range(60_000))
    rows = [(None, "mail a@b.example now"), (None, None), (5, "mail a@b.example now"), (5, "mail a@b.example now"), (6, ""), (7, long)]
    df = frame(spark, rows)
    items = spark.createDataFrame([(1, "mail a b example now"), (None, "river stone")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 0), (None, 1)], "doc_id long, quality int")
    model = quality_classifier.train(df, labels)
    for run, key in (
        (lambda x: decontaminate.matches(x, items), lambda y: (y.n_words, tuple(y.first_words), tuple(y.end_words), tuple(y["items"]))),
        (lambda x: decontaminate.matches(x, items, block_words=3), lambda y: (y.n_words, tuple(y.first_words), tuple(y.end_words), tuple(y["items"]))),
        (lambda x: quality_classifier.classify(x, model), lambda y: round(y.score, 5)),
        (lambda x: quality_rules.apply_rules(x), lambda y: (y.n_words, y.n_repeat_words, y.kept)),
        (lambda x: token_counts.token_counts(x), lambda y: (y.n_tokens, y.n_sections)),
        (lambda x: pieces.encode(x, dropout=0.0), lambda y: bytes(y.ids)),
    ):
        out = run(df).collect()
        assert len(out) == len(rows)
        by_id = {}
        for y in out:
            by_id.setdefault(y.doc_id, []).append(key(y))
        assert by_id[5][0] == by_id[5][1] and by_id[5][0] in by_id[None] and by_id[6][0] in by_id[None]
    n = decontaminate.matches(df, items).where("doc_id = 7").first()
    assert n.n_words == len(brute.ALNUM.findall(long))
    kept = decontaminate.decontaminate(df, items).collect()
    assert sorted(repr(x.doc_id) for x in kept) == ["6", "7", "None"]


def test_empty_tables_of_all_operators(spark):
    df = spark.createDataFrame([], CLASHING)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        quality_classifier.classify(df, None),
        quality_classifier.keep(df, None),
        language_id.identify(df, None),
        pii.redact(df),
        jaccard_join.one_of_each(df),
        decontaminate.decontaminate(df, items),
        decontaminate.decontaminate(df, items, "cut", block_words=1),
        pieces.decode(pieces.encode(df, keep_text=True)),
        token_counts.field_counts(df, ["text", "kept"]),
        context_tree.score(df, F.lit(True)),
    ):
        assert out.count() == 0
    rows = frame(spark, [(1, "a b"), (None, None)])
    for block in (1, 10**6):
        assert decontaminate.matches(rows, items, block_words=block).count() == decontaminate.decontaminate(rows, items, block_words=block).count() == 2


def test_lookup():
    keys = np.unique(C.mix64(np.arange(1000, dtype=np.uint64)))
    found = C.Lookup(keys)
    assert (found(keys) == np.arange(1000)).all()
    assert (found(C.mix64(np.arange(1000, 2000, dtype=np.uint64))) == -1).all()
    assert C.Lookup(keys[:0])(keys).max() == -1
