import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe, dedup, diagnostics, grammar, mutate, splits, stats, verify
from textloom.plans import corpus
from textloom.sources import io
from textloom.streaming import sessions as S


def test_first_seen_keeps_smallest_and_nulls(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "i long, k string")
    assert sorted(r.i for r in dedup.keep_first(df, F.col("k"), "i").collect()) == [1, 2, 4, 5]
    assert [tuple(r) for r in dedup.duplicate_details(df, F.col("k"), "i", "x").collect()] == [("x", 3, 1)]


def test_leakage(spark):
    rows = [("s1", "a", "TRAIN"), ("s1", "a", "TEST"), ("s2", "b", None)]
    r = dedup.leakage(spark.createDataFrame(rows, "s string, k string, split string"), F.col("s"), T.structure_fingerprint(F.col("k"), F.col("k")), F.col("split")).first()
    assert (r.exact_duplicates, r.test_train_overlap, r.ok) == (1, 1, False)
    clean = spark.createDataFrame([("a", "x", "TRAIN"), ("b", "y", "TRAIN"), ("c", None, "TEST")], "s string, k string, split string")
    assert dedup.leakage(clean, F.col("s"), F.col("k"), F.col("split")).first().ok


@pytest.mark.parametrize("n, sizes", [(50, (40, 5, 5)), (53, (42, 5, 6)), (0, (0, 0, 0))])
def test_split_sizes_and_repeatability(spark, n, sizes):
    a = splits.split(spark.range(n), "id", 5)
    b = splits.split(spark.range(n).repartition(7), "id", 5)
    got = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("TRAIN", "VALIDATION", "TEST")) == sizes
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_split_of_many_files_with_payload_is_exact(spark, tmp_path):
    from collections import Counter

    spark.range(100_000).repartition(9).select("id", F.repeat(F.lit("payload "), 3).alias("text"), (F.col("id") % 7).alias("g")).write.parquet(str(tmp_path / "t"))
    out = splits.split(spark.read.parquet(str(tmp_path / "t")), "id", 3)
    rows = out.select("id", "split").collect()
    assert Counter(r.split for r in rows) == {"TRAIN": 80_000, "VALIDATION": 10_000, "TEST": 10_000}
    import hashlib

    place = {r.id: hashlib.sha256(f"3:{r.id}".encode()).hexdigest() for r in rows}
    order = sorted(place, key=place.get)
    expect = {i: "TRAIN" if k < 80_000 else "VALIDATION" if k < 90_000 else "TEST" for k, i in enumerate(order)}
    assert {r.id: r.split for r in rows} == expect


def test_split_keeps_equal_and_null_ids_together(spark):
    df = spark.createDataFrame([(None,)] * 30 + [(1,)] * 30 + [(k,) for k in range(40)], "id long")
    out = splits.split(df, "id", 1).collect()
    assert len(out) == 100 and all(len({r.split for r in out if r.id == i}) == 1 for i in (None, 1))
    hashes = df.select(splits.hash_order("id", 1).alias("h"))
    every = sorted(r.h for r in hashes.collect())
    for few in (1, 5, 10_000):
        assert [splits.cut_at(hashes, k, few=few) for k in (1, 17, 50, 100)] == [every[k - 1] for k in (1, 17, 50, 100)]


def test_first_seen_with_ties(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b"), (5, "b"), (None, "c"), (None, "c"), (None, None), (3, None)], "i long, k string")
    kept = dedup.keep_first(df, F.col("k"), "i").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(1, "a"), (2, "b"), (None, "c"), (None, None), (3, None)]))


def test_latency_nearest_rank(spark):
    r = stats.latency(spark.createDataFrame([("a", float(x)) for x in range(10)], "g string, v double"), "v", ["g"]).first()
    assert (r.n, r.p50_s, r.p95_s, r.max_s) == (10, 4.0, 9.0, 9.0)
    assert stats.latency(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0


def test_diagnostics_islands(spark):
    text = "noise\nC:/x/a.lean:3:4: error: m\n  more\n\nb:1:0: warning: w"
    rows = diagnostics.parse(spark.createDataFrame([(1, text)], "i long, t string"), "i", "t").orderBy("number").collect()
    assert [(r.severity, r.line, r.column, r.message) for r in rows] == [("error", 3, 4, "m\n  more"), ("warning", 1, 0, "w")]


def test_grammar_sizes_and_synthesis(spark):
    assert [grammar.props(spark, d).count() for d in (1, 2)] == [9, 163]
    assert [grammar.inhabited(spark, d).distinct().count() for d in (1, 2)] == [6, 145]
    q = grammar.inhabited(spark, 2)
    assert q.where("prop = 'false'").count() == 0
    samples = spark.createDataFrame([("(and true true)", "(MAnd.intro MTrue.intro MTrue.intro)"), ("false", "MTrue.intro")], "prop_structure string, proof_structure string")
    assert {r.prop_structure: r.status for r in grammar.check(samples, q).collect()} == {"(and true true)": "SUCCESS", "false": "FAIL_TYPECHECK"}
    assert grammar.s0(spark).count() == 56


def test_mutations():
    assert mutate.parse("(and true (or false true))") == ("and", "true", ("or", "false", "true"))
    assert mutate.parse("(and true") is None and mutate.parse("") is None
    got = {mutate.mutated_tree("(and true false)", str(k), 1) for k in range(60)}
    assert {"(or true false)", "(and false true)"} <= got


def test_staged_verification(spark):
    rows = [(1, "sorry", None, None), (2, "import X\n", None, None), (3, "ok", "true", "MTrue.intro"), (4, "ok", "true", "x"), (5, "ok", None, None)]
    df = spark.createDataFrame(rows, "i int, source string, prop_structure string, proof_structure string")
    out = {r.i: (r.status, r.failure_class) for r in verify.staged(df, "source", verify.relation_checker(grammar.inhabited(spark, 0))).collect()}
    assert out == {1: ("FAIL_SAFETY", "INVALID_ACTION"), 2: ("FAIL_SAFETY", "INVALID_ACTION"), 3: ("SUCCESS", None), 4: ("FAIL_TYPECHECK", "MODEL_FAILURE"), 5: ("RESOURCE_LIMIT", "RESOURCE_FAILURE")}


def test_process_checker(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "a:1:2: error: unexpected token"), (3, None)], "i int, source string")
    command = ["sh", "-c", 'if grep -q error "$0"; then cat "$0"; exit 1; fi']
    out = {r.i: r.status for r in verify.process_checker(command, "source")(df).collect()}
    assert out == {1: "SUCCESS", 2: "FAIL_PARSE", 3: "SUCCESS"}
    gone = verify.process_checker(["/no/such/program"], "source")(df).collect()
    assert {r.status for r in gone} == {"RESOURCE_LIMIT"}


def test_bpe_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("the theme of the theorem é 12  x",), (None,), ("",)], "t string")
    merges = bpe.train(df, "t", 300)
    assert (b"h", b"e") in merges
    bpe.save(spark, merges, str(tmp_path / "m"))
    assert bpe.load(spark, str(tmp_path / "m")) == merges
    ids = df.withColumn("i", bpe.encode(spark, F.col("t"), merges))
    for r in ids.withColumn("d", bpe.decode(spark, F.col("i"), merges)).collect():
        assert r.d == r.t


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", None, "é "), ("a", 1, "")], "z string, a long, t string")
    io.write_jsonl(df, str(tmp_path / "j"))
    back = io.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert '{"a":null,"t":"é ","z":"b"}' in [r.value for r in spark.read.text(str(tmp_path / "j"), lineSep="\n").collect()]


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("seed: 1\nallowed_prefixes: [Base]\nforbidden_tokens: [sorry]\nforbidden_declarations: []\nrestricted: []\n")
    assert io.load_config(str(path)).seed == 1
    path.write_text("seed: 1\n")
    with pytest.raises(KeyError):
        io.load_config(str(path))


def test_session_steps():
    names, status, _ = S.step([], "submit", "def a : MUnit := MUnit.mk")
    assert (names, status) == (["a"], "SUCCESS")
    assert S.step(names, "submit", "#check a")[1] == "SUCCESS"
    assert S.step(names, "submit", "#check b")[1:] == ("FAIL_TYPECHECK", "MODEL_FAILURE")
    assert S.step(names, "crash", None) == ([], "RESOURCE_LIMIT", "INFRASTRUCTURE_FAILURE")
    assert S.step(names, "reset", None)[0] == []


def test_corpus_build(spark):
    rows = corpus.build(spark, 20, 10, 1).collect()
    assert {r.level for r in rows} == {"S0", "S1", "S2"}
    assert all(r.status == "SUCCESS" for r in rows if r.level == "S2" and r.mutation_type is None)
    assert {r.mode for r in rows if r.split == "TEST"} <= {"batch"}
    assert len({r.sample_id for r in rows}) == len(rows)
    assert json.dumps([r.split for r in rows])


def test_bpe_learns_from_all_words_in_both_ways(spark):
    import random

    r = random.Random(11)
    head = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 7))) for _ in range(30)]
    tail = ["".join(r.choice("wxyz") for _ in range(r.randrange(3, 9))) + "qu" for _ in range(600)]
    rows = [(" ".join([*head * 12, "aaaaa", "aaaa"]),), (" ".join(tail),), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    counts = [(x["word"].encode(), x["n"]) for x in bpe.word_counts(df, "text").collect()]
    expect = bpe.learn(counts, 340)
    assert (b"q", b"u") in expect[:5]
    assert bpe.train(df, "text", 340) == expect
    assert bpe.train(df, "text", 340, on_driver=40) == expect
    kept = lambda: set(os.listdir(f"{io.shared_dir(spark)}/textloom"))
    io.materialize(df)  # the folder exists
    before = kept()
    assert bpe.learn_in_spark(bpe.word_counts(df, "text"), 340, block=50, renew=5) == expect
    assert bpe.learn_in_spark(bpe.word_counts(df.limit(0), "text"), 340) == []
    assert kept() == before
