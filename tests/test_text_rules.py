from pyspark.sql import functions as F

from textloom.functions import lexer as L
from textloom.functions import rules as R
from textloom.functions import text as T


def one(spark, expr, **values):
    cols = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or (None,)], cols).select(expr.alias("r")).first()["r"]


def test_normalize_ignores_names_and_space(spark):
    n = lambda s: one(spark, T.normalize(F.col("s")), s=s)
    assert n("theorem foo : MTrue := MTrue.intro") == n("theorem  bar\n: MTrue  := MTrue.intro ")
    assert n("theorem foo (a : B) : C") == "theorem foo (a : B) : C"
    assert n(n("a   b")) == "a b"


def test_structure_fingerprint_nulls(spark):
    df = spark.createDataFrame([("p", "q"), ("p", None), (None, "q"), (None, None)], "p string, q string")
    out = [r[0] for r in df.select(T.structure_fingerprint(F.col("p"), F.col("q"))).collect()]
    assert out[3] is None and len(set(out)) == 4


def test_strip_code(spark):
    s = lambda x: one(spark, T.strip_code(F.col("s")), s=x)
    assert s("a /- b -/ c -- d\ne") == "a   c  \ne"
    assert s("a /- open") == "a  "
    assert s('x "a \\" b" y') == 'x "" y'


def test_safety_offsets_and_tokens(spark):
    v = lambda s: one(spark, R.safety_violations(F.col("s")), s=s)
    assert v("theorem t : MTrue := sorry") == ["forbidden token 'sorry' at offset 21"]
    assert v("sorry SORRY") == ["forbidden token 'sorry' at offset 6"]
    assert v("Foo.sorry -- sorry") == []
    assert v("axiom a") == ["forbidden declaration/keyword 'axiom' at offset 0"]
    assert v("x Lean.ofReduceBool") == ["restricted pattern 'Lean.ofReduceBool' used"]
    assert v("") == []


def test_audit_is_case_sensitive_by_word(spark):
    v = lambda s: one(spark, R.audit_violations(F.col("s")), s=s)
    assert any("sorry" in x for x in v("Foo.sorry"))
    assert any("Nat" in x for x in v("theorem t : Nat := zero"))
    assert v("theorem t : MTrue := MTrue.intro") == []
    assert v("/- import Hidden -/ x") == []
    assert v("import Std.Data\nx")[0] == "disallowed import 'Std.Data'"


def test_classification_order(spark):
    c = lambda *m: one(spark, R.classify_failure(F.array(*[F.lit(x) for x in m]))) if m else one(spark, R.classify_failure(F.array().cast("array<string>")))
    assert c("(kernel) type mismatch") == "FAIL_KERNEL"
    assert c("Type mismatch: expected x") == "FAIL_TYPECHECK"
    assert c("unexpected token") == "FAIL_PARSE"
    assert c("odd") == c() == "FAIL_TYPECHECK"
    assert one(spark, R.failure_class(F.lit("SUCCESS"))) is None


def test_error_normalisation(spark):
    n = lambda m: one(spark, R.normalize_error(F.col("m"), F.lit(1), F.lit(0)), m=m)
    r = n("Type mismatch\n  rfl\nhas type\n  ?m.8 = ?m.8\nbut is expected to have type\n  1 = 2")
    assert (r.error_type, r.actual_type, r.expected_type, r.line, r.column) == ("type_mismatch", "?m.8 = ?m.8", "1 = 2", 1, 0)
    r = n("Function expected at\n  f\nHint: a\nb")
    assert (r.error_type, r.hint, r.message) == ("function_expected", "a\nb", "Function expected at")
    assert n("unknown identifier 'MAndx'").error_type == "unknown_identifier"
    assert n("expected token").error_type == "parse_error"
    r = n("strange")
    assert (r.error_type, r.raw_message) == ("unclassified", "strange")


def test_lexer(spark):
    t = lambda s: one(spark, L.tokenize(F.col("s")), s=s)
    assert t("theorem t1 : MTrue := MTrue.intro") == ["theorem", " ", "t1", " ", ":", " ", "MTrue", " ", ":=", " ", "MTrue.intro"]
    assert t("<GOAL> a\n\n<ACTION>") == ["<GOAL>", " ", "a", " ", "<ACTION>"]
    assert t("λx <|> ∧12") == ["λx", " ", "<|>", " ", "∧", "12"]
    assert L.vocabulary_size() == 89
    assert one(spark, L.encode(F.array(F.lit("<PAD>"), F.lit("zzz"), F.lit("theorem")))) == [11, 3, 14]


def test_axioms(spark):
    text = "'t' depends on axioms: [propext, sorryAx]\n'u' does not depend on any axioms"
    r = one(spark, R.axiom_report(F.col("s")), s=text)
    assert [(x.declaration, x.axioms) for x in r] == [("t", ["propext", "sorryAx"])]
    assert one(spark, R.axiom_violations(R.axiom_report(F.col("s"))), s=text) == ["'t' depends on non-trusted axiom 'sorryAx'"]
