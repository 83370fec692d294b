"""Rule tables and the column functions that apply them: safety, imports, content audit,
failure classes, error types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as T

# Fixed values.
FORBIDDEN_TOKENS = ("sorry", "admit", "unsafe", "native_decide")
FORBIDDEN_DECLARATIONS = ("axiom", "opaque", "implemented_by", "extern", "macro_rules", "syntax", "elab", "set_option")
RESTRICTED = ("Lean.ofReduceBool", "Lean.ofReduceNat")
AUDIT_MARKERS = ("sorry", "admit", "native_decide", "unsafe")
AUDIT_DECLARATIONS = ("axiom", "opaque", "macro_rules", "set_option", "elab", "syntax")
AUDIT_CONTENT = (r"\bNat\b", r"\bInt\b", r"\bReal\b", r"\bList\b", r"\bArray\b", r"\bGroup\b", r"\bRing\b", r"\bField\b", r"[+\-*/^%]", r"\bzero\b", r"\bsucc\b", r"\bplus\b", r"\bmult\b")
TRUSTED_AXIOMS = ("Classical.choice", "propext", "Quot.sound")
KERNEL_WORDS = ("kernel", "deep recursion was detected", "excessive memory consumption", "deterministic timeout", "maximum number of heartbeats")
TYPECHECK_WORDS = ("type mismatch", "unknown identifier", "unknown constant", "unknown variable", "failed to synthesize", "type class instance", "invalid 'theorem'", "invalid 'def'", "invalid 'inductive'", "invalid 'instance'", "has type", "but it is expected to have type", "cannot find synthesis order")
PARSE_WORDS = ("expected", "unexpected token", "invalid occurrence", "maximum recursion depth", "unterminated string", "invalid character")
FAILURE_CLASS = {"FAIL_PARSE": "MODEL_FAILURE", "FAIL_TYPECHECK": "MODEL_FAILURE", "FAIL_KERNEL": "MODEL_FAILURE", "FAIL_SAFETY": "INVALID_ACTION", "TIMEOUT": "TIMEOUT", "RESOURCE_LIMIT": "RESOURCE_FAILURE"}
#: Phrases of messages.
MISMATCH, HAS_TYPE, NAMED, EXPECTED, HINT, DEPENDS = "type mismatch", "has type", ("has type", "term"), ("but is expected to have type", "but expected to have type"), "Hint:", "depends on axioms:"
#: In order of precedence.
ERROR_TYPES = (
    ("type_mismatch", "type mismatch"),
    ("definitional_equality", "not a definitional equality"),
    ("unknown_identifier", "unknown identifier"),
    ("unknown_constant", "unknown constant"),
    ("unknown_variable", "unknown variable"),
    ("synthesis_failure", "failed to synthesize"),
    ("function_expected", "function expected"),
    ("invalid_field", "invalid field notation"),
    ("parse_error", "expected token|unexpected token|invalid character"),
    ("unsolved_goals", "unsolved goals"),
    ("arity_error", "has been used in"),
)


@dataclass(frozen=True)
class Policy:
    """What sources may contain. The import prefixes have no default of their own."""

    allowed_prefixes: tuple[str, ...] = ("Base",)
    tokens: tuple[str, ...] = FORBIDDEN_TOKENS
    declarations: tuple[str, ...] = FORBIDDEN_DECLARATIONS
    restricted: tuple[str, ...] = RESTRICTED


def _present(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def safety_violations(source: Column, policy: Policy = Policy(), clean: Column | None = None) -> Column:
    """Messages, in rule order: forbidden tokens, declarations (offsets in the stripped text, last
    occurrence), restricted substrings. Each rule is tested by a substring search first. ``clean``:
    the stripped source, where it is a column already."""
    clean = T.strip_code(source) if clean is None else clean
    low = F.lower(clean)

    def found(word: str, what: str) -> Column:
        at = T.last_offset(clean, word)
        return F.when(low.contains(word) & at.isNotNull(), F.concat(F.lit(f"forbidden {what} '{word}' at offset "), at.cast("string")))

    rules = [found(w, "token") for w in policy.tokens] + [found(w, "declaration/keyword") for w in policy.declarations]
    return _present(rules + [F.when(clean.contains(p), F.lit(f"restricted pattern '{p}' used")) for p in policy.restricted])


def restricted_uses(source: Column, policy: Policy = Policy()) -> Column:
    clean = T.strip_code(source)
    return _present([F.when(clean.contains(p), F.lit(p)) for p in policy.restricted])


def _disallowed(modules: Column, prefixes: tuple[str, ...]) -> Column:
    def allowed(m: Column) -> Column:
        ok = F.lit(False)
        for p in prefixes:
            ok = ok | (m == p) | m.startswith(p + ".")
        return ok

    return F.filter(modules, lambda m: ~allowed(m))


def import_violations(source: Column, policy: Policy = Policy()) -> Column:
    """One message for each imported module outside the allowed prefixes, in order."""
    return F.transform(_disallowed(T.imports(source), policy.allowed_prefixes), lambda m: F.concat(F.lit("disallowed import '"), m, F.lit("'")))


def audit_violations(source: Column, policy: Policy = Policy(), content: tuple[str, ...] = AUDIT_CONTENT, clean: Column | None = None) -> Column:
    """Content audit of a generated source: imports, markers, declarations, content patterns
    (case-sensitive, whole words by regular expression). ``clean`` as in safety_violations()."""
    clean = T.strip_code(source) if clean is None else clean

    def hit(pattern: str, what: str, shown: str) -> Column:
        # most texts lack the word: a substring search comes before the pattern
        word = pattern[2:-2] if pattern.startswith(r"\b") and pattern.endswith(r"\b") else ""
        found = clean.rlike(pattern)
        return F.when(clean.contains(word) & found if word.isalnum() else found, F.lit(f"{what} '{shown}'"))

    rules = [hit(rf"\b{w}\b", "forbidden marker", w) for w in AUDIT_MARKERS] + [hit(rf"\b{w}\b", "forbidden declaration", w) for w in AUDIT_DECLARATIONS]
    return F.concat(import_violations(source, policy), _present(rules + [hit(p, "mathematical content pattern", p) for p in content]))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def classify_failure(messages: Column) -> Column:
    """Status of a failed check from its error messages (array): kernel, then typing, then parsing
    words; typing if nothing matches or there is no error."""
    text = F.lower(F.array_join(messages, "\n"))
    return F.when(_any(text, KERNEL_WORDS), "FAIL_KERNEL").when(_any(text, TYPECHECK_WORDS), "FAIL_TYPECHECK").when(_any(text, PARSE_WORDS), "FAIL_PARSE").otherwise("FAIL_TYPECHECK")


def failure_class(status: Column) -> Column:
    """Class of a status; null for SUCCESS and unknown statuses."""
    table = F.create_map(*[F.lit(x) for pair in FAILURE_CLASS.items() for x in pair])
    return F.try_element_at(table, status)


def error_type(message: Column) -> Column:
    out = None
    for name, pattern in ERROR_TYPES:
        hit = message.rlike(f"(?i){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unclassified")


def _told_types(message: Column) -> Column:
    """struct(actual, expected) of a message whose lines name a type, then the expected one.

    The expected type is what follows the first line of EXPECTED. The actual one is what stands
    between a line HAS_TYPE alone and that line, if the message is a type mismatch; else the rest
    of the first line with one of NAMED or, if that is blank, the line after it.
    """
    lines = F.split(message, "\n")
    out = F.transform(F.array(lines), lambda a: _cut(a))[0]  # binds the array once
    return out


def _cut(lines: Column) -> Column:
    bare = F.transform(lines, _trim)
    at = lambda found: F.coalesce(F.try_element_at(F.filter(F.transform(lines, lambda x, i: F.when(found(x), i + 1)), lambda i: i.isNotNull()), F.lit(1)), F.lit(0))
    holds = lambda x, marks: F.coalesce(*[F.when(x.contains(m), True) for m in marks], F.lit(False))
    tail = at(lambda x: holds(x, EXPECTED))
    rest = lambda x, marks: F.coalesce(*[F.when(F.locate(m, x) > 0, F.substr(x, F.locate(m, x) + len(m))) for m in marks])
    from_here = lambda k: F.slice(lines, k, F.greatest(F.size(lines) - k + 1, F.lit(0)))
    expected = F.when(tail > 0, _trim(F.array_join(F.concat(F.array(rest(F.element_at(lines, F.greatest(tail, F.lit(1))), EXPECTED)), from_here(F.greatest(tail, F.lit(1)) + 1)), "\n")))
    alone = F.array_position(bare, HAS_TYPE).cast("int")
    whole = F.array_join(lines, "\n").contains(MISMATCH) & (alone > 0) & (alone < tail - 1)
    between = _trim(F.array_join(F.slice(lines, F.greatest(alone, F.lit(0)) + 1, F.greatest(tail - alone - 1, F.lit(0))), "\n"))
    first = at(lambda x: holds(x, NAMED))
    same = _trim(rest(F.element_at(lines, F.greatest(first, F.lit(1))), NAMED))
    after = F.element_at(bare, F.least(first + 1, F.size(lines)))
    loose = F.when((first > 0) & (first < tail), F.when(same != "", same).when(first + 1 < tail, after))
    actual = F.when(whole, between).otherwise(loose)
    return F.struct(F.when(actual != "", actual).alias("actual"), F.when((actual != "") & (expected != ""), expected).alias("expected"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{T.WS}+|{T.WS}+$", "")


def normalize_error(message: Column, line: Column, column: Column) -> Column:
    """struct: error_type, line, column, expected_type, actual_type, message (first line), hint, raw_message."""
    m = F.coalesce(message, F.lit(""))
    types = F.when(_any(m, EXPECTED), _told_types(m))  # other messages name no types
    return F.struct(
        error_type(m).alias("error_type"),
        line.alias("line"),
        F.when(line.isNotNull(), column).alias("column"),
        types["expected"].alias("expected_type"),
        types["actual"].alias("actual_type"),
        _trim(F.element_at(F.split(m, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", 2), 1)).alias("message"),
        F.when(m.contains(HINT), _trim(F.substr(m, F.locate(HINT, m) + len(HINT)))).otherwise("").alias("hint"),
        m.alias("raw_message"),
    )


def axiom_report(output: Column) -> Column:
    """array<struct<declaration, axioms>> of what declarations depend on: the text is cut at the
    phrase between a quoted name and its bracketed list."""
    parts = F.split(output, "' " + DEPENDS)
    told = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.substring_index(F.element_at(parts, k), "'", -1).alias("declaration"), _trim(F.element_at(parts, k + 1)).alias("body")),
    )
    told = F.filter(told, lambda x: (x["declaration"] != "") & x["body"].startswith("[") & x["body"].contains("]"))
    names = F.transform(told, lambda x: x["declaration"])
    axioms = F.transform(told, lambda x: F.regexp_extract_all(F.substring_index(x["body"], "]", 1), F.lit(r"[A-Za-z_][A-Za-z0-9_.']*"), F.lit(0)))
    every = F.zip_with(names, axioms, lambda d, a: F.struct(d.alias("declaration"), a.alias("axioms")))
    # of repeated declarations the last list counts, at the first one's place
    last = lambda e, d: F.element_at(F.filter(e, lambda y: y["declaration"] == d), -1)["axioms"]
    return F.transform(F.array_distinct(names), lambda d: F.struct(d.alias("declaration"), last(every, d).alias("axioms")))


def trusted_axioms(report: Column) -> Column:
    flat = F.flatten(F.transform(report, lambda r: r["axioms"]))
    return F.array_distinct(F.filter(flat, lambda a: a.isin(*TRUSTED_AXIOMS)))


def axiom_violations(report: Column) -> Column:
    pairs = F.flatten(F.transform(report, lambda r: F.transform(F.filter(r["axioms"], lambda a: ~a.isin(*TRUSTED_AXIOMS)), lambda a: F.concat(F.lit("'"), r["declaration"], F.lit("' depends on non-trusted axiom '"), a, F.lit("'")))))
    return pairs
