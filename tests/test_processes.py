"""Child programs, the reports that time them, sinks and the command line."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from textloom import __main__ as cli
from textloom.operators import audit, verify
from textloom.plans import corpus, reports
from textloom.sources import io, process

CHILD = """
import json, sys, time
names = set()
print(json.dumps({"ready": True}), flush=True)
for line in sys.stdin:
    r = json.loads(line)
    if r["op"] == "imports":
        print(json.dumps({"status": "success", "messages": []}), flush=True)
        continue
    s = r["source"]
    if "die" in s:
        sys.exit(3)
    if "sleep" in s:
        time.sleep(60)
    if "import" in s:
        print(json.dumps({"error": "an import line came through"}), flush=True)
        continue
    if s.startswith("#check "):
        ok = s.split()[1] in names
        said = [{"severity": "information" if ok else "error", "data": s[7:]}]
    else:
        ok, said = "bad" not in s, [{"severity": "error", "data": "no"}] if "bad" in s else []
        if ok and r["update_env"] and len(s.split()) > 1:
            names.add(s.split()[1])
    print(json.dumps({"status": "success" if ok else "error", "messages": said}), flush=True)
"""


@pytest.fixture(scope="module")
def child(tmp_path_factory):
    path = tmp_path_factory.mktemp("child") / "child.py"
    path.write_text(CHILD)
    return [sys.executable, "-u", str(path)]


def test_session_states(child):
    with process.LineClient(child, seconds=20) as client:
        s = process.Session(client, ("Base",))
        r = s.submit("import Base\ndef a : X := y")
        assert (r["previous_state"], r["next_state"], r["status"]) == ("ready", "success", "SUCCESS") or r["previous_state"] == "fresh"
        assert s.submit("#check a")["infos"] == ["a"]
        bad = s.submit("theorem bad : X")
        assert (bad["status"], bad["failure_class"], s.errors) == ("FAIL_TYPECHECK", "MODEL_FAILURE", ["no"])
        s.reset()
        assert s.submit("#check a")["status"] == "FAIL_TYPECHECK"
        s.load(("Base", "More"))
        assert s.state == "fresh" and s.submit("def b : X")["status"] == "SUCCESS" and client.starts == 3
        client.close()
        client.close()


def test_dead_and_late_children_are_no_verdict(child):
    with process.LineClient(child, seconds=1.5) as client:
        s = process.Session(client)
        for source in ("die", "sleep"):
            r = s.submit(source)
            assert (r["status"], r["failure_class"], r["next_state"]) == ("RESOURCE_LIMIT", process.CHILD, "crashed")
            assert s.submit("def a : X")["status"] == "SUCCESS"
    with process.LineClient(["/no/such/program"]) as client:
        assert process.Session(client).submit("x")["failure_class"] == process.INFRASTRUCTURE


def test_session_checker_replaces_children(spark, child):
    rows = [(0, "def a : X"), (1, "die"), (2, "bad"), (3, None), (4, "def c : X")]
    df = spark.createDataFrame(rows, "i int, source string").coalesce(1)
    out = {r.i: r.status for r in verify.staged(df, "source", verify.session_checker(child, "source")).collect()}
    assert out == {0: "SUCCESS", 1: "RESOURCE_LIMIT", 2: "FAIL_TYPECHECK", 3: "SUCCESS", 4: "SUCCESS"}


def test_output_is_bounded_and_the_environment_passed():
    code, said = process.run_once([sys.executable, "-c", "import os; print(os.environ['WHO'] * 1000000)"], 30, 1000, {"WHO": "me"})
    assert code == 0 and said == "me" * 500
    assert process.run_once(["sleep", "60"], 0.3, 10)[0] == process.TIMED_OUT
    assert process.run_once(["/no/such/program"], 1, 10)[0] == process.NOT_RUN


def test_python_sources_are_audited_outside_literals(spark, tmp_path):
    clean = "x = 'unsafe' # axiom\n" + "d = " + '"' * 3 + "sorry\nelab" + '"' * 3 + "\ny = 'it\\'s admit'\nz = ''  # opaque\n"
    (tmp_path / "clean.py").write_text(clean)
    (tmp_path / "dirty.py").write_text("z = ''\nunsafe = 1 # x\nsyntax = 'a'\n")
    out = audit.audit_files(spark, [str(tmp_path / n) for n in ("clean.py", "dirty.py", "none.py")])
    got = {(r.file.split("/")[-1], r.violation) for r in out.collect()}
    assert got == {("dirty.py", "forbidden marker 'unsafe'"), ("dirty.py", "forbidden declaration 'syntax'"), ("none.py", "generator file missing")}


def test_timings(spark, child, tmp_path):
    source = {"good": "def a : X", "bad": "bad"}
    warm = {r.name: r for r in reports.warm_timings(spark, child, source, 3).collect()}
    assert (warm["good"].n, warm["good"].success_rate, warm["bad"].success_rate) == (3, 1.0, 0.0)
    cold = {r.name: r for r in reports.cold_timings(spark, child, source).collect()}
    assert cold["good"].status == "SUCCESS" and cold["good"].total_s >= cold["good"].startup_s > 0
    (tmp_path / "f").write_text("x")
    assert reports.batch_timings(spark, ["cat"], {"f": str(tmp_path / "f")}, 2).first().n == 2
    one, statuses = reports.action_timings(spark, child, 12)
    assert one.first().actions_per_sec > 0 and sum(r.n for r in statuses.collect()) == 12


def test_tokenizer_report(spark):
    df = spark.createDataFrame([("theorem t : MTrue := MTrue.intro", "type mismatch"), ("def a : X := y", None), (None, ""), ("", None)], "t string, e string")
    rows = {r.tokenizer: r for r in reports.tokenizer_report(spark, df, "t", "e", 300, timed=True).collect()}
    assert (rows["bpe"].n_texts, rows["bpe"].n_proofs, rows["bpe"].n_errors) == (3, 2, 1)
    assert rows["lexer"].tokens_per_error == 3 and rows["bpe"].vocabulary <= 300 and rows["bpe"].chars_per_sec > 0
    gain = (rows["lexer"].compression_ratio - rows["bpe"].compression_ratio) / rows["bpe"].compression_ratio
    assert rows["bpe"].decision == ("lexer" if gain >= 0.2 else "bpe")


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(2, None, ["b"])], "z int, a string, l array<string>")
    text = io.write_summary(one, str(tmp_path / "s"), stamp=True)
    back = json.loads(text)
    assert back["z"] == 2 and back["a"] is None and back["timestamp_utc"].endswith("+00:00")
    assert list(back)[:3] == ["a", "l", "timestamp_utc"]
    (tmp_path / "one.txt").write_text("line\nline é")
    whole = io.read_whole(spark, str(tmp_path / "one.txt")).first()
    assert whole.value == "line\nline é" and whole.path.endswith("one.txt")
    import hashlib

    assert io.file_fingerprints(spark, str(tmp_path / "one.txt")).first().sha256 == hashlib.sha256("line\nline é".encode()).hexdigest()


def test_command_line_builds_and_gates(spark, tmp_path, monkeypatch):
    (tmp_path / "generator.py").write_text("unsafe = 1\n")
    out = str(tmp_path / "corpus")
    assert cli.main(["build", "--output", out, "--per-level", "5", "--mutations", "3", "--audit", str(tmp_path / "generator.py")]) == 1
    assert cli.main(["build", "--output", out, "--per-level", "5", "--mutations", "3"]) in (0, 1)
    rows = io.read_jsonl(spark, out, io.sample_schema()).collect()
    assert {r.level for r in rows} == {"S0", "S1", "S2"}
    assert all(r.generator_provenance.origin == ("synthetic" if r.parent_id is None else "synthetic_mutation") for r in rows)
    assert all(r.validation_provenance.verdict in ("verified", "rejected") and len(r.validation_provenance.source_hash) == 64 for r in rows)
    assert all(r.prop_lean and f" : {r.prop_lean} := {r.proof_lean}" in r.source for r in rows)
    cli.main(["tokenizers", "--input", out, "--output", str(tmp_path / "report"), "--vocabulary", "300"])
    assert corpus.summary(corpus.originals(spark, 3, 1).withColumn("split", F.lit("TRAIN")), 1).count() == 1
