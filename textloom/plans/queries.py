"""Queries of the engine's own operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexer as L
from textloom.functions import rules as R
from textloom.functions import text as T
from textloom.operators import audit, bpe, dedup, diagnostics, grammar, mutate, random_trees, sessions, splits, stats, verify
from textloom.registry import ORACLE, QUERIES, query
from textloom.sources import io

SEED = 42
POLICY = R.Policy(allowed_prefixes=("Base",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL fragments (DuckDB) -------------------------------------------------------------------

class _Template(str):
    """SQL with one place, {}, to fill; other braces stay."""

    def format(self, x: str) -> str:
        return self.replace("{}", x)


_WS = r"[\s\x0b\x85\p{Z}\x1c-\x1f]"
_NWS = r"[^\s\x0b\x85\p{Z}\x1c-\x1f]"
_NORMAL = _Template(rf"trim(regexp_replace(regexp_replace({{}}, 'theorem{_WS}+{_NWS}+{_WS}*:', 'theorem _ :', 'g'), '{_WS}+', ' ', 'g'))")
_STRIP = _Template(r"""regexp_replace(regexp_replace(regexp_replace({}, '(?s)/-.*?(-/|$)', ' ', 'g'), '--[^\n]*', ' ', 'g'), '(?s)"(?:[^"\\]|\\.)*"', '""', 'g')""")
_IMPORTS = _Template(rf"regexp_extract_all({{}}, '(?m)^{_WS}*import{_WS}+([A-Za-z_][A-Za-z0-9_.]*)', 1)")
_STRUCTURE = "sha256(coalesce(lang, 'None') || '|' || coalesce(source, 'None'))"
_SPLIT = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents),
split AS (SELECT *, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'TRAIN' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM ranked)"""


def _q(s: str) -> str:
    return s.replace("'", "''")


# --- fingerprints, de-duplication, splits -----------------------------------------------------


@query("fingerprints", f"SELECT doc_id, sha256(text) AS exact, sha256({_NORMAL.format('text')}) AS normalized, {_STRUCTURE} AS structure FROM documents")
def fingerprints(spark, d):
    """S1-S4 over whole documents in one projection."""
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("exact"), T.normalized_fingerprint(F.col("text")).alias("normalized"), T.structure_fingerprint(F.col("lang"), F.col("source")).alias("structure"))


@query("joined_fingerprint", "SELECT conv_id, sha256(string_agg(text, chr(10) || chr(0) || chr(10) ORDER BY turn)) AS fingerprint FROM conversations GROUP BY conv_id")
def joined_fingerprint(spark, d):
    """One fingerprint of the ordered texts of a conversation."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", T.fingerprint_all(F.transform("t", lambda x: x["text"])).alias("fingerprint"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS fingerprint FROM documents GROUP BY text")
def exact_dedup(spark, d):
    out = dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), T.fingerprint(F.col("text")), "doc_id", F.col("text").isNull(), "fingerprint")
    return out.select("doc_id", "fingerprint")


@query("normalized_dedup", f"SELECT min(doc_id) AS doc_id, sha256({_NORMAL.format('text')}) AS fingerprint FROM documents GROUP BY 2")
def normalized_dedup(spark, d):
    out = dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), T.normalized_fingerprint(F.col("text")), "doc_id", F.col("text").isNull(), "fingerprint")
    return out.select("doc_id", "fingerprint")


@query(
    "duplicate_details",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, doc_id AS dup_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {key}) AS first_id FROM documents) WHERE doc_id > first_id"
        for kind, key in (("exact", "text"), ("normalized", _NORMAL.format("text")), ("structure", _STRUCTURE))
    ),
)
def duplicate_details(spark, d):
    docs = table(spark, d, "documents")
    keys = (("exact", T.fingerprint(F.col("text"))), ("normalized", T.normalized_fingerprint(F.col("text"))), ("structure", T.structure_fingerprint(F.col("lang"), F.col("source"))))
    out = [dedup.duplicate_details(docs, key, "doc_id", kind) for kind, key in keys]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("hash_split", f"WITH {_SPLIT} SELECT doc_id, split FROM split")
def hash_split(spark, d):
    return splits.split(table(spark, d, "documents").select("doc_id"), "doc_id", SEED)


@query("split_counts", f"WITH {_SPLIT}, kept AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORMAL.format('text')}), {_SPLIT.replace('ranked', 'ranked2').replace('split AS', 'split2 AS').replace('FROM documents', 'FROM kept')} SELECT split AS split, count(*) AS n FROM split2 GROUP BY split")
def split_counts(spark, d):
    """The flagship: fingerprint, first-seen de-duplication, split by hash, counts."""
    docs = dedup.keep_first(table(spark, d, "documents").select("doc_id", "text"), T.normalized_fingerprint(F.col("text")), "doc_id", F.col("text").isNull()).select("doc_id")
    docs = io.materialize(docs)
    return stats.counts(splits.split(docs, "doc_id", SEED), F.col("split"), "split")


@query("group_split", f"SELECT doc_id, source, CASE WHEN x < 0.8 THEN 'TRAIN' WHEN x < 0.9 THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (SELECT doc_id, source, ('0x' || substr(sha256('{SEED}:' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM documents)")
def group_split(spark, d):
    return splits.split_groups(table(spark, d, "documents").select("doc_id", "source"), "source", SEED)


_LEAK = f"""WITH {_SPLIT}, k AS (SELECT text AS e, {_NORMAL.format('text')} AS n, {_STRUCTURE} AS s, split FROM split)
SELECT (count(*) - count(DISTINCT e))::BIGINT AS exact_duplicates, (count(*) - count(DISTINCT n))::BIGINT AS normalized_duplicates, (count(*) - count(DISTINCT s))::BIGINT AS structure_duplicates,
(SELECT count(*) FROM (SELECT s FROM k WHERE split = 'TEST' INTERSECT SELECT s FROM k WHERE split = 'TRAIN'))::BIGINT AS test_train_overlap,
(SELECT count(*) FROM (SELECT s FROM k WHERE split = 'TEST' INTERSECT SELECT s FROM k WHERE split = 'VALIDATION'))::BIGINT AS test_validation_overlap FROM k"""


@query("leakage_summary", f"SELECT *, exact_duplicates = 0 AND normalized_duplicates = 0 AND test_train_overlap = 0 AND test_validation_overlap = 0 AS ok, exact_duplicates = 0 AND normalized_duplicates = 0 AND structure_duplicates = 0 AND test_train_overlap = 0 AND test_validation_overlap = 0 AS gate_ok FROM ({_LEAK})")
def leakage_summary(spark, d):
    docs = splits.split(table(spark, d, "documents"), "doc_id", SEED)
    return dedup.leakage(docs, F.col("text"), T.structure_fingerprint(F.col("lang"), F.col("source")), F.col("split"))


@query("unseen_documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id))")
def unseen_documents(spark, d):
    """Documents without a label whose text no labelled document has."""
    docs = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("f"))
    labelled = table(spark, d, "labels").select("doc_id")
    seen = docs.join(labelled, "doc_id", "left_semi")
    return dedup.anti(docs.join(labelled, "doc_id", "left_anti"), seen, "f").select("doc_id")


@query("shared_structures", "SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def shared_structures(spark, d):
    docs = table(spark, d, "documents")
    return dedup.overlap(docs.where("lang = 'en'"), docs.where("lang = 'de'"), "source")


# --- counts -----------------------------------------------------------------------------------


@query("level_counts", "SELECT coalesce(lang, '?') AS level, count(*) AS n FROM documents GROUP BY 1")
def level_counts(spark, d):
    return audit.level_counts(table(spark, d, "documents").withColumnRenamed("lang", "level"))


@query("verdict_counts", "SELECT CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' ELSE '?' END AS verdict, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def verdict_counts(spark, d):
    v = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "rejected")
    return stats.counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), v, "verdict")


@query("mutation_counts", "SELECT event_type AS mutation_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY 1")
def mutation_counts(spark, d):
    return audit.mutation_counts(table(spark, d, "events").withColumnRenamed("event_type", "mutation_type"))


@query("status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return stats.counts(table(spark, d, "orders"), F.col("o_orderstatus"), "status")


@query("success_rate", "SELECT event_type, count(*) AS n, avg((event_type <> 'error' AND value > 50)::INT) AS success_rate FROM events GROUP BY 1")
def success_rate(spark, d):
    return stats.success_rate(table(spark, d, "events"), (F.col("event_type") != "error") & (F.col("value") > 50), ["event_type"])


@query("throughput", "SELECT event_type, count(*) AS n, round_even(count(*) / sum(1 + event_id % 7), 3) AS per_sec FROM events GROUP BY 1")
def throughput(spark, d):
    return stats.throughput(table(spark, d, "events"), 1 + F.col("event_id") % 7, ["event_type"])


_NEAREST = "list_sort(list(value))[round_even({} * (count(*) - 1), 0)::BIGINT + 1]"


@query(
    "latency_stats",
    f"""SELECT event_type, count(*) AS n, round_even(sum(value) / count(*), 6) AS mean_s, {", ".join(f"round_even({_NEAREST.format(p)}, 6) AS p{round(p * 100)}_s" for p in (0.5, 0.95, 0.99))},
    round_even(min(value), 6) AS min_s, round_even(max(value), 6) AS max_s, round_even(count(*) / sum(value), 3) AS checks_per_sec FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def latency_stats(spark, d):
    return stats.latency(table(spark, d, "events"), "value", ["event_type"])


# --- text rules over generated sources --------------------------------------------------------

_K = len(grammar.BENCH)
_PROP = "CASE i % 6 " + " ".join(f"WHEN {k} THEN '{p}'" for k, (p, _) in enumerate(grammar.BENCH)) + " END"
_PROOF = "CASE i % 6 " + " ".join(f"WHEN {k} THEN '{q}'" for k, (_, q) in enumerate(grammar.BENCH)) + " END"
_THEOREM = f"'theorem bench_t' || CAST(i AS STRING) || ' : ' || {_PROP} || CASE WHEN i % 10 = 9 THEN ' := by exact ' ELSE ' := ' END || {_PROOF}"
#: What is put before or after a statement, by index.
_EXTRA = (
    ("''", "''"),
    ("'import Base.Core' || chr(10)", "''"),
    ("'import Std.Data.HashMap' || chr(10)", "''"),
    ("''", "' -- sorry'"),
    ("''", "' sorry'"),
    ("'/- axiom ' || chr(10) || ' -/ '", "''"),
    ("'axiom a' || CAST(i AS STRING) || ' : False' || chr(10)", "' Foo.sorry'"),
    ("'set_option x true' || chr(10)", "' \"admit -- x\" SORRY, 9unsafe'"),
    ("''", "' /- unterminated native_decide'"),
    ("'/- import Hidden.Mod' || chr(10) || 'import Base' || chr(10) || '-/'", "''"),
    ("''", "' Lean.ofReduceBool Nat + zero'"),
    ("'  import Base' || chr(10) || 'import Basement.X' || chr(10)", "' native_decide!'"),
    ("'sorry, admit. sorry' || chr(10)", "''"),
)
_SOURCE = "(CASE i % 13 " + " ".join(f"WHEN {k} THEN {a}" for k, (a, _) in enumerate(_EXTRA)) + f" END) || {_THEOREM} || (CASE i % 13 " + " ".join(f"WHEN {k} THEN {b}" for k, (_, b) in enumerate(_EXTRA)) + " END)"
N_SOURCES = 3000
_SOURCES = f"sources AS (SELECT i, {_SOURCE} AS source FROM range({N_SOURCES}) t(i))"


def sources(spark: SparkSession, d: str | None = None) -> DataFrame:
    """Statements with injected rule breaks."""
    return spark.range(N_SOURCES).withColumnRenamed("id", "i").withColumn("source", F.expr(_SOURCE))


#: The same statements, each after the whole text of a document.
_DOCUMENT_SOURCES = f"sources AS (SELECT i, coalesce(text, '') || chr(10) || {_SOURCE} AS source FROM (SELECT doc_id AS i, text FROM documents))"


def document_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"), "text")
    return docs.select("i", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(_SOURCE)).alias("source"))


@query("bench_theorems", f"SELECT i, {_THEOREM} AS source FROM range(5000) t(i)")
def bench_theorems(spark, d):
    return spark.range(5000).select(F.col("id").alias("i"), grammar.bench_theorem(F.col("id")).alias("source"))


@query("bench_source", f"SELECT sha256('import Base' || chr(10) || string_agg(s, chr(10) ORDER BY j) || chr(10)) AS fingerprint FROM (SELECT j, {_THEOREM} AS s FROM (SELECT j, (j + 3 * 7919) % 1000003 AS i FROM range(100) t(j)))")
def bench_source(spark, d):
    return grammar.bench_source(spark, 100, 3, "import Base").select(T.fingerprint(F.col("source")).alias("fingerprint"))


@query(
    "action_sequence",
    """SELECT i, CASE i % 6 WHEN 0 THEN 'def bench_chain' || i || ' : MUnit := MUnit.mk' WHEN 1 THEN 'theorem bench_c' || i || ' : MTrue := MAnd.intro MTrue.intro MTrue.intro'
    WHEN 2 THEN 'theorem bench_c' || i || ' : MTrue := MTrue.intro' WHEN 3 THEN 'theorem bench_d' || i || ' : MAnd MTrue MTrue := MAnd.intro MTrue.intro MTrue.intro'
    WHEN 4 THEN '#check bench_chain' || (i - 4) ELSE 'theorem bench_e' || i || ' : MOr MTrue (MAnd MTrue MTrue) := MOr.inl MTrue.intro' END AS action FROM range(3000) t(i)""",
)
def action_sequence(spark, d):
    return spark.range(3000).select(F.col("id").alias("i"), grammar.action(F.col("id")).alias("action"))


@query("strip_comments", f"WITH {_SOURCES} SELECT i, {_STRIP.format('source')} AS clean FROM sources")
def strip_comments(spark, d, rows=sources):
    return rows(spark, d).select("i", T.strip_code(F.col("source")).alias("clean"))


def _tok(word):
    return f"(?is)^((?:.*[^A-Za-z0-9_.!])?[0-9.!]*){word}(?:[^A-Za-z0-9_.!].*)?\\z"


_SAFETY = ", ".join(
    [f"CASE WHEN regexp_matches(c, '{_tok(w)}') THEN 'forbidden token ''{w}'' at offset ' || length(regexp_extract(c, '{_tok(w)}', 1)) END" for w in R.FORBIDDEN_TOKENS]
    + [f"CASE WHEN regexp_matches(c, '{_tok(w)}') THEN 'forbidden declaration/keyword ''{w}'' at offset ' || length(regexp_extract(c, '{_tok(w)}', 1)) END" for w in R.FORBIDDEN_DECLARATIONS]
    + [f"CASE WHEN contains(c, '{p}') THEN 'restricted pattern ''{p}'' used' END" for p in R.RESTRICTED]
)


@query("safety_scan", f"WITH {_SOURCES}, c AS (SELECT i, {_STRIP.format('source')} AS c FROM sources) SELECT i, concat_ws('; ', {_SAFETY}) AS violations FROM c")
def safety_scan(spark, d, rows=sources):
    clean = rows(spark, d).withColumn("clean", T.strip_code(F.col("source")))
    return clean.select("i", F.array_join(R.safety_violations(F.col("source"), POLICY, F.col("clean")), "; ").alias("violations"))


_ALLOWED = "(m = 'Base' OR starts_with(m, 'Base.'))"
_FOREIGN = f"list_transform(list_filter({_IMPORTS.format('source')}, lambda m: NOT {_ALLOWED}), lambda m: 'disallowed import ''' || m || '''')"


@query("import_allowlist", f"WITH {_SOURCES} SELECT i, array_to_string({_IMPORTS.format('source')}, ',') AS imports, array_to_string({_FOREIGN}, '; ') AS violations FROM sources")
def import_allowlist(spark, d, rows=sources):
    return rows(spark, d).select("i", F.array_join(T.imports(F.col("source")), ",").alias("imports"), F.array_join(R.import_violations(F.col("source"), POLICY), "; ").alias("violations"))


@query("drop_imports", f"WITH {_SOURCES} SELECT i, array_to_string(list_filter(string_split(source, chr(10)), lambda x: NOT starts_with(ltrim(x), 'import ')), chr(10)) AS source FROM sources")
def drop_imports(spark, d, rows=sources):
    return rows(spark, d).select("i", T.drop_imports(F.col("source")).alias("source"))


@query("proof_extract", f"WITH {_SOURCES} SELECT i, trim(substr(source, instr(source, ':=') + 2)) AS proof FROM sources WHERE contains(source, ':=')")
def proof_extract(spark, d, rows=sources):
    return rows(spark, d).select("i", T.proof_of(F.col("source")).alias("proof")).where(F.col("proof").isNotNull())


_AUDIT_HITS = [(rf"\b{w}\b", f"forbidden marker '{w}'") for w in R.AUDIT_MARKERS] + [(rf"\b{w}\b", f"forbidden declaration '{w}'") for w in R.AUDIT_DECLARATIONS] + [(p, f"mathematical content pattern '{p}'") for p in R.AUDIT_CONTENT]


def _audit_sql(rel: str, key: str, text: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(c, '{p}') THEN '{_q(said)}' END" for p, said in _AUDIT_HITS)
    foreign = _FOREIGN.replace("source", text)
    return f"audit AS (SELECT {key}, list_concat({foreign}, list_filter([{hits}], lambda x: x IS NOT NULL)) AS v FROM (SELECT *, {_STRIP.format(text)} AS c FROM {rel}))"


@query("text_audit", f"WITH {_SOURCES}, {_audit_sql('sources', 'i', 'source')} SELECT i, array_to_string(v, '; ') AS violations FROM audit")
def text_audit(spark, d, rows=sources):
    clean = rows(spark, d).withColumn("clean", T.strip_code(F.col("source")))
    return clean.select("i", F.array_join(R.audit_violations(F.col("source"), POLICY, clean=F.col("clean")), "; ").alias("violations"))


@query("audit_rule_counts", f"WITH {_audit_sql('documents', 'doc_id', 'text')} SELECT violation, count(*) AS n FROM (SELECT unnest(v) AS violation FROM audit) GROUP BY 1")
def audit_rule_counts(spark, d):
    return audit.rule_counts(table(spark, d, "documents"), "doc_id", "text", POLICY)


@query(
    "audit_summary",
    f"""WITH {_SOURCES}, {_audit_sql('sources', 'i', 'source')}, m AS (SELECT DISTINCT unnest({_IMPORTS.format('source')}) AS m FROM sources)
    SELECT count(*) AS n_samples, sum(len(v))::BIGINT AS n_violations, (SELECT string_agg(m, ',' ORDER BY m) FROM m) AS imports_seen,
    (SELECT bool_and({_ALLOWED}) FROM m) AS all_imports_allowed, sum(len(v)) = 0 AS ok FROM audit""",
)
def audit_summary(spark, d, rows=sources):
    return audit.summary(rows(spark, d), "source", POLICY).withColumn("imports_seen", F.array_join("imports_seen", ",")).withColumn("n_violations", F.col("n_violations").cast("long"))


@query("word_offsets", f"WITH {_SOURCES}, p AS (SELECT i, unnest(regexp_extract_all(source, '[A-Za-z_][A-Za-z0-9_.!]*|[^A-Za-z_]+')) AS word, generate_subscripts(regexp_extract_all(source, '[A-Za-z_][A-Za-z0-9_.!]*|[^A-Za-z_]+'), 1) AS k FROM sources) SELECT i AS id, word, \"offset\" FROM (SELECT i, word, coalesce(sum(length(word)) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM p) WHERE regexp_matches(word, '^[A-Za-z_]')")
def word_offsets(spark, d, rows=sources):
    return diagnostics.word_offsets(rows(spark, d), "i", "source")


# --- lexer and tokenizer metrics --------------------------------------------------------------


def _lex(text: str) -> str:
    p = L.pattern(whitespace=_WS + "+", digits=r"\p{Nd}+").replace("Ͱ", r"\x{370}").replace("Ͽ", r"\x{3ff}").replace("'", "''")
    return f"list_transform(regexp_extract_all({text}, '(?s){p}'), lambda t: CASE WHEN regexp_matches(t, '^{_WS}') THEN ' ' ELSE t END)"


_IDS = "MAP {" + ", ".join(f"'{_q(k)}': {v}" for k, v in L.IDS.items()) + "}"


@query("lexer_counts", f"SELECT doc_id, len({_lex('text')})::BIGINT AS n_tokens FROM documents")
def lexer_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(L.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query("lexer_encode", f"WITH {_SOURCES} SELECT i, array_to_string(list_transform({_lex('source')}, lambda t: coalesce({_IDS}[t], 3)), ' ') AS ids FROM sources")
def lexer_encode(spark, d, rows=sources):
    return rows(spark, d).select("i", F.array_join(L.encode(L.tokenize(F.col("source"))).cast("array<string>"), " ").alias("ids"))


@query("lexer_decode", f"WITH {_SOURCES} SELECT i, array_to_string(list_transform({_lex('source')}, lambda t: CASE WHEN {_IDS}[t] IS NULL THEN '<UNK>' ELSE t END), '') AS decoded FROM sources")
def lexer_decode(spark, d, rows=sources):
    return rows(spark, d).select("i", L.decode(L.encode(L.tokenize(F.col("source")))).alias("decoded"))


@query("lexer_encode_unk", f"SELECT lang, sum(len(list_filter(t, lambda x: {_IDS}[x] IS NULL)))::BIGINT AS unknown, sum(len(t))::BIGINT AS tokens FROM (SELECT lang, {_lex('text')} AS t FROM documents) GROUP BY lang")
def lexer_encode_unk(spark, d):
    ids = table(spark, d, "documents").select("lang", L.encode(L.tokenize(F.col("text"))).alias("ids"))
    return ids.groupBy("lang").agg(F.sum(F.size(F.filter("ids", lambda x: x == L.UNKNOWN))).cast("long").alias("unknown"), F.sum(F.size("ids")).cast("long").alias("tokens"))


_RATIO = f"SELECT lang, sum(length(text))::BIGINT AS chars, sum(len(t))::BIGINT AS tokens, round_even(sum(length(text)) / sum(len(t)), 3) AS compression_ratio, round_even(avg(len(t)), 3) AS tokens_per_text FROM (SELECT lang, text, {_lex('text')} AS t FROM documents) GROUP BY lang"


@query("compression_ratio", _RATIO)
def compression_ratio(spark, d):
    docs = table(spark, d, "documents").select("lang", F.length("text").alias("c"), F.size(L.tokenize(F.col("text"))).alias("t"))
    return stats.compression(docs, F.col("c"), F.col("t"), ["lang"])


@query("tokenizer_decision", f"SELECT lang, w AS words_ratio, compression_ratio AS lexer_ratio, round_even((compression_ratio - w) / w * 100, 1) AS improvement_pct, CASE WHEN (compression_ratio - w) / w >= 0.2 THEN 'other' ELSE 'base' END AS decision FROM ({_RATIO}) JOIN (SELECT lang, round_even(sum(length(text)) / sum(len(string_split(text, ' '))), 3) AS w FROM documents GROUP BY lang) USING (lang)")
def tokenizer_decision(spark, d):
    docs = table(spark, d, "documents").select("lang", F.length("text").alias("c"), F.size(L.tokenize(F.col("text"))).alias("t"), F.size(F.split("text", " ")).alias("w"))
    lexer = stats.compression(docs, F.col("c"), F.col("t"), ["lang"]).select("lang", F.col("compression_ratio").alias("lexer_ratio"))
    both = stats.compression(docs, F.col("c"), F.col("w"), ["lang"]).select("lang", F.col("compression_ratio").alias("words_ratio")).join(lexer, "lang")
    gain, decision = stats.tokenizer_decision(F.col("words_ratio"), F.col("lexer_ratio"))
    return both.select("lang", "words_ratio", "lexer_ratio", gain.alias("improvement_pct"), decision.alias("decision"))


@query("bpe_encode")
def bpe_encode(spark, d):
    """K5, K6: learned on the corpus' word counts; rows only, as merging is iterative."""
    docs = table(spark, d, "conversations")
    merges = bpe.train(docs, "text", 1200)
    ids = docs.select("conv_id", "turn", "text", bpe.encode(spark, F.col("text"), merges).alias("ids"))
    return ids.select("conv_id", "turn", F.size("ids").cast("long").alias("n_tokens"), (bpe.decode(spark, F.col("ids"), merges) == F.col("text")).alias("lossless"))


@query("bpe_word_counts", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[A-Za-z\x{80}-\x{10ffff}]+| ?[0-9]+| ?[^\sA-Za-z0-9\x{80}-\x{10ffff}]+|\s+')) AS word FROM conversations) GROUP BY 1")
def bpe_word_counts(spark, d):
    return bpe.word_counts(table(spark, d, "conversations"), "text")


# --- diagnostics ------------------------------------------------------------------------------

#: Compiler output by event: header, continuation lines and noise.
_MESSAGES = (
    "'Type mismatch' || chr(10) || '  h' || chr(10) || 'has type' || chr(10) || '  MTrue' || chr(10) || 'but is expected to have type' || chr(10) || '  MAnd MTrue MTrue'",
    "'unknown identifier ''x' || CAST(event_id AS STRING) || ''''",
    "'unexpected token ''end''; expected term'",
    "'(kernel) declaration has metavariables'",
    "'Function expected at' || chr(10) || '  f' || chr(10) || 'Hint: check the arity' || chr(10) || 'of f'",
    "'failed to synthesize' || chr(10) || '  Inhabited A' || chr(10) || chr(10) || 'more'",
    "'unsolved goals' || chr(10) || 'a : MTrue'",
    "'something unusual happened'",
    "'type mismatch' || chr(10) || '  h' || chr(10) || 'has type' || chr(10) || '  MTrue' || chr(10) || 'but is expected to have type' || chr(10) || '  MFalse'",
)
_M = "CASE event_id % 9 " + " ".join(f"WHEN {k} THEN {m}" for k, m in enumerate(_MESSAGES)) + " END"
_OUTPUT = f"'before any header' || chr(10) || 'C:/work/a' || CAST(user_id AS STRING) || '.lean:' || CAST(event_id % 50 AS STRING) || ':' || CAST(event_id % 7 AS STRING) || ': ' || CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'info' ELSE 'warning' END || ': ' || {_M} || chr(10) || '   ' || chr(10) || 'b.lean:1:2: error: ' || CASE event_id % 4 WHEN 0 THEN 'has type problem' WHEN 1 THEN 'invalid character' WHEN 2 THEN 'maximum number of heartbeats' ELSE 'odd' END"
_HEADER = r"^(.+?):(\d+):(\d+): (error|warning|info): ?(.*)$"
_PARSED = rf"""out AS (SELECT event_id AS id, {_OUTPUT} AS output FROM events),
lines AS (SELECT id, unnest(string_split(output, chr(10))) AS line, generate_subscripts(string_split(output, chr(10)), 1) AS pos FROM out),
marked AS (SELECT *, regexp_matches(line, '{_HEADER}') AS head FROM lines WHERE trim(line) <> ''),
island AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY pos) AS number FROM marked),
parsed AS (SELECT id, number::BIGINT AS number, max(CASE WHEN head THEN regexp_extract(line, '{_HEADER}', 4) END) AS severity, max(CASE WHEN head THEN regexp_extract(line, '{_HEADER}', 2)::INT END) AS line,
    max(CASE WHEN head THEN regexp_extract(line, '{_HEADER}', 3)::INT END) AS "column", string_agg(CASE WHEN head THEN trim(regexp_extract(line, '{_HEADER}', 5)) ELSE line END, chr(10) ORDER BY pos) AS message
    FROM island WHERE number > 0 GROUP BY id, number)"""


def compiler_output(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(_OUTPUT).alias("output"))


def parsed(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.parse(compiler_output(spark, d), "id", "output")


@query("diag_parse", f"WITH {_PARSED} SELECT * FROM parsed")
def diag_parse(spark, d):
    return parsed(spark, d)


def _any(words):
    return " OR ".join(f"contains(t, '{_q(w)}')" for w in words)


_CLASS = f"CASE WHEN {_any(R.KERNEL_WORDS)} THEN 'FAIL_KERNEL' WHEN {_any(R.TYPECHECK_WORDS)} THEN 'FAIL_TYPECHECK' WHEN {_any(R.PARSE_WORDS)} THEN 'FAIL_PARSE' ELSE 'FAIL_TYPECHECK' END"


@query("diag_classify", f"WITH {_PARSED}, e AS (SELECT id, lower(string_agg(message, chr(10) ORDER BY number)) AS t FROM parsed WHERE severity = 'error' GROUP BY id) SELECT id, {_CLASS} AS status, 'MODEL_FAILURE' AS failure_class FROM e")
def diag_classify(spark, d):
    e = diagnostics.error_messages(parsed(spark, d)).withColumn("status", R.classify_failure(F.col("messages")))
    return e.select("id", "status", R.failure_class(F.col("status")).alias("failure_class"))


@query("failure_classes", "SELECT o_orderkey, status, CASE WHEN status LIKE 'FAIL_%' AND status <> 'FAIL_SAFETY' THEN 'MODEL_FAILURE' WHEN status = 'FAIL_SAFETY' THEN 'INVALID_ACTION' WHEN status = 'TIMEOUT' THEN 'TIMEOUT' WHEN status = 'RESOURCE_LIMIT' THEN 'RESOURCE_FAILURE' END AS failure_class FROM (SELECT o_orderkey, ['SUCCESS', 'FAIL_PARSE', 'FAIL_TYPECHECK', 'FAIL_KERNEL', 'FAIL_SAFETY', 'TIMEOUT', 'RESOURCE_LIMIT'][o_orderkey % 7 + 1] AS status FROM orders)")
def failure_classes(spark, d):
    names = F.array(*[F.lit(x) for x in ("SUCCESS", "FAIL_PARSE", "FAIL_TYPECHECK", "FAIL_KERNEL", "FAIL_SAFETY", "TIMEOUT", "RESOURCE_LIMIT")])
    s = F.element_at(names, (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", s.alias("status"), R.failure_class(s).alias("failure_class"))


_TYPE = "CASE " + " ".join(f"WHEN regexp_matches(message, '(?i){p}') THEN '{n}'" for n, p in R.ERROR_TYPES) + " ELSE 'unclassified' END"
def _line_with(marks):
    return "coalesce(list_position(list_transform(l, lambda x: " + " OR ".join(f"contains(x, '{m}')" for m in marks) + "), true), 0)"


def _after(x, marks):
    return "CASE " + " ".join(f"WHEN contains({x}, '{m}') THEN substr({x}, instr({x}, '{m}') + {len(m)})" for m in marks) + " END"


def _bare(x):
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_TOLD = f"""lined AS (SELECT *, string_split(message, chr(10)) AS l FROM parsed),
placed AS (SELECT *, {_line_with(R.EXPECTED)} AS tail, {_line_with(R.NAMED)} AS named, coalesce(list_position(list_transform(l, lambda x: {_bare('x')}), '{R.HAS_TYPE}'), 0) AS alone FROM lined),
told AS (SELECT *, CASE WHEN tail > 0 THEN {_bare(f"array_to_string(list_concat([{_after('l[tail]', R.EXPECTED)}], l[tail + 1:]), chr(10))")} END AS expected,
    CASE WHEN contains(message, '{R.MISMATCH}') AND alone > 0 AND alone < tail - 1 THEN {_bare("array_to_string(l[alone + 1:tail - 1], chr(10))")}
    WHEN named > 0 AND named < tail THEN CASE WHEN {_bare(_after('l[named]', R.NAMED))} <> '' THEN {_bare(_after('l[named]', R.NAMED))} WHEN named + 1 < tail THEN {_bare('l[named + 1]')} END END AS actual FROM placed)"""


@query("error_normalize", f"WITH {_PARSED}, {_TOLD} SELECT id, number, {_TYPE} AS error_type, line, \"column\", CASE WHEN actual <> '' AND expected <> '' THEN expected END AS expected_type, CASE WHEN expected <> '' AND actual <> '' THEN actual END AS actual_type, trim(l[1]) AS message, CASE WHEN contains(message, 'Hint:') THEN {_bare("substr(message, instr(message, 'Hint:') + 5)")} ELSE '' END AS hint, message AS raw_message FROM told")
def error_normalize(spark, d):
    return parsed(spark, d).select("id", "number", R.normalize_error(F.col("message"), F.col("line"), F.col("column")).alias("e")).select("id", "number", "e.*")


@query("error_type_counts", f"WITH {_PARSED} SELECT {_TYPE} AS error_type, count(*) AS n FROM parsed WHERE severity = 'error' GROUP BY 1")
def error_type_counts(spark, d):
    return parsed(spark, d).where("severity = 'error'").groupBy(R.error_type(F.col("message")).alias("error_type")).agg(F.count("*").alias("n"))


@query("first_error", f"WITH {_PARSED} SELECT id, arg_min(coalesce(nullif(trim(string_split(message, chr(10))[1]), ''), nullif(message, '')), number) AS text FROM parsed WHERE severity = 'error' GROUP BY id")
def first_error(spark, d):
    """K8: the first error's text of each sample: its first line, or all of it."""
    errors = parsed(spark, d).where("severity = 'error'").select("id", "number", R.normalize_error(F.col("message"), F.col("line"), F.col("column")).alias("e"))
    return diagnostics.first_error(errors.select("id", "number", "e.message", "e.raw_message"))


_AXIOMS = "CASE event_id % 4 WHEN 0 THEN '''t' || CAST(event_id AS STRING) || ''' depends on axioms: [propext, Classical.choice]' WHEN 1 THEN '''t'' depends on axioms: [sorryAx,' || chr(10) || ' Quot.sound]' || chr(10) || '''u'' depends on axioms: [my.ax''1, propext]' WHEN 2 THEN '''t'' does not depend on any axioms' ELSE '''t'' depends on axioms: []' END"
_LISTS = f"""cut AS (SELECT event_id, string_split(o, ''' {R.DEPENDS}') AS p FROM o),
    told AS (SELECT event_id, k, string_split(p[k], '''')[-1] AS decl, ltrim(p[k + 1]) AS body FROM (SELECT event_id, p, unnest(range(1, len(p))) AS k FROM cut)),
    a AS (SELECT event_id, decl, k, unnest(x) AS ax, generate_subscripts(x, 1) AS j FROM (SELECT *, regexp_extract_all(string_split(body, ']')[1], '[A-Za-z_][A-Za-z0-9_.'']*') AS x FROM told WHERE starts_with(body, '[') AND contains(body, ']')))"""


@query(
    "axiom_inspect",
    rf"""WITH o AS (SELECT event_id, {_AXIOMS} AS o FROM events), {_LISTS}
    SELECT o.event_id, coalesce(string_agg(DISTINCT ax, ',' ORDER BY ax) FILTER (WHERE ax IN ('Classical.choice', 'propext', 'Quot.sound')), '') AS trusted,
    coalesce(string_agg('''' || decl || ''' depends on non-trusted axiom ''' || ax || '''', '; ' ORDER BY k, j) FILTER (WHERE ax NOT IN ('Classical.choice', 'propext', 'Quot.sound')), '') AS violations,
    coalesce(string_agg(DISTINCT ax, ',' ORDER BY ax), '') AS axioms FROM o LEFT JOIN a USING (event_id) GROUP BY o.event_id""",
)
def axiom_inspect(spark, d):
    o = table(spark, d, "events").select("event_id", R.axiom_report(F.expr(_AXIOMS)).alias("r"))
    every = stats.sorted_distinct(F.transform("r", lambda x: x["axioms"]))
    return o.select("event_id", F.array_join(F.array_sort(R.trusted_axioms(F.col("r"))), ",").alias("trusted"), F.array_join(R.axiom_violations(F.col("r")), "; ").alias("violations"), F.array_join(every, ",").alias("axioms"))


@query("repl_messages", "SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS line, 'm' || k AS message FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)")
def repl_messages(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, d, "events").select("event_id", k.alias("k"))
    raw = F.to_json(F.struct(F.lit("error").alias("severity"), F.when(F.col("k") % 3 == 0, 0).otherwise(F.col("k")).alias("line"), F.lit(0).alias("column"), F.concat(F.lit("m"), F.col("k").cast("string")).alias("message")))
    return e.select("event_id", diagnostics.repl_message(raw).alias("m")).select("event_id", "m.line", "m.message")


# --- generation, checking, mutation -----------------------------------------------------------


def _props_sql(depth: int, leaves: str) -> str:
    zero = "SELECT 'true' AS key, 'true' AS op, NULL::VARCHAR AS l, NULL::VARCHAR AS r" + (" UNION ALL SELECT 'false', 'false', NULL, NULL" if leaves != "true" else "")
    leaf = "SELECT 'true', 'true', NULL, NULL" + (" UNION ALL SELECT 'false', 'false', NULL, NULL" if leaves == "both" else "")
    out = [f"p0 AS ({zero})"]
    for k in range(1, depth + 1):
        out.append(f"p{k} AS ({leaf} UNION ALL SELECT '(' || o || ' ' || a.key || ' ' || b.key || ')', o, a.key, b.key FROM p{k - 1} a, p{k - 1} b, (VALUES ('and'), ('or')) v(o))".replace("SELECT 'true', 'true', NULL, NULL", "SELECT 'true' AS key, 'true' AS op, NULL::VARCHAR AS l, NULL::VARCHAR AS r", 1))
    return ", ".join(out)


def _inhabited_sql(depth: int) -> str:
    base = "SELECT 'true' AS prop, 'MTrue.intro' AS proof"
    out = [f"q0 AS ({base})"]
    for k in range(1, depth + 1):
        p, q = f"p{k - 1}", f"q{k - 1}"
        out.append(
            f"q{k} AS ({base} UNION ALL SELECT '(and ' || a.prop || ' ' || b.prop || ')', '(MAnd.intro ' || a.proof || ' ' || b.proof || ')' FROM {q} a, {q} b "
            f"UNION ALL SELECT '(or ' || a.prop || ' ' || p.key || ')', '(MOr.inl ' || a.proof || ')' FROM {q} a, {p} p UNION ALL SELECT '(or ' || p.key || ' ' || a.prop || ')', '(MOr.inr ' || a.proof || ')' FROM {q} a, {p} p)"
        )
    return ", ".join(out)


_S0 = f"(SELECT (a.i * 7 + b.j)::BIGINT AS \"index\", prop_lean, proof_lean FROM (SELECT unnest({list(grammar.S0_PROPS)}) AS prop_lean, unnest(range(8)) AS i) a, (SELECT unnest({list(grammar.S0_PROOFS)}) AS proof_lean, unnest(range(7)) AS j) b)"


@query("s0_enumerate", f"SELECT \"index\", prop_lean, proof_lean, 'theorem s0_t' || \"index\" || ' : ' || prop_lean || ' := ' || proof_lean AS source, (prop_lean, proof_lean) IN ({', '.join(str(x) for x in grammar.S0_VALID)}) AS valid FROM {_S0}")
def s0_enumerate(spark, d):
    return grammar.s0(spark)


@query("prop_enumerate", f"WITH {_props_sql(3, 'deepest')} SELECT key, op, l AS left_key, r AS right_key FROM p3")
def prop_enumerate(spark, d):
    return grammar.props(spark, 3)


@query("inhabitation", f"WITH {_props_sql(2, 'deepest')}, {_inhabited_sql(3)} SELECT DISTINCT prop, proof FROM q3")
def inhabitation(spark, d):
    return grammar.inhabited(spark, 3).distinct()


_RENDER = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\btrue\\b', 'MTrue', 'g'), '\\bfalse\\b', 'MFalse', 'g'), '\\band\\b', 'MAnd', 'g'), '\\bor\\b', 'MOr', 'g'), '^\\((.*)\\)$', '\\1')"


@query("rendered_props", f"WITH {_props_sql(2, 'deepest')} SELECT key, {_RENDER.format('key')} AS prop_lean FROM p2")
def rendered_props(spark, d):
    return grammar.props(spark, 2).select("key", grammar.rendered(F.col("key")).alias("prop_lean"))


@query("synthesized_proofs", f"WITH {_props_sql(1, 'deepest')}, {_inhabited_sql(2)} SELECT prop, min(proof) AS proof, count(*) AS n FROM (SELECT DISTINCT prop, proof FROM q2) GROUP BY prop")
def synthesized_proofs(spark, d):
    """A proof for each provable proposition of depth two."""
    return grammar.inhabited(spark, 2).distinct().groupBy("prop").agg(F.min("proof").alias("proof"), F.count("*").alias("n"))


_PAIRS = "pairs AS (SELECT p.key AS prop_structure, q.proof AS proof_structure FROM p2 p, (SELECT DISTINCT proof FROM q2) q)"


@query("verify_s1", f"WITH {_props_sql(2, 'deepest')}, {_inhabited_sql(2)}, {_PAIRS} SELECT prop_structure, CASE WHEN EXISTS (SELECT 1 FROM q2 WHERE prop = prop_structure AND proof = proof_structure) THEN 'SUCCESS' ELSE 'FAIL_TYPECHECK' END AS status, count(*) AS n FROM pairs GROUP BY 1, 2")
def verify_s1(spark, d):
    """Every proposition against every proof of depth two, checked by join."""
    q = grammar.inhabited(spark, 2)
    pairs = grammar.props(spark, 2).select(F.col("key").alias("prop_structure")).crossJoin(F.broadcast(q.select(F.col("proof").alias("proof_structure")).distinct()))
    return grammar.check(pairs, q).groupBy("prop_structure", "status").agg(F.count("*").alias("n"))


@query(
    "staged_verification",
    f"""WITH {_SOURCES}, c AS (SELECT i, source, {_STRIP.format('source')} AS c FROM sources), v AS (SELECT i, concat_ws('; ', {_SAFETY}) AS s, array_to_string({_FOREIGN}, '; ') AS m FROM c)
    SELECT i, CASE WHEN s <> '' OR m <> '' THEN 'FAIL_SAFETY' WHEN i % 6 < 3 THEN 'SUCCESS' WHEN i % 6 < 5 THEN 'FAIL_TYPECHECK' ELSE 'RESOURCE_LIMIT' END AS status,
    CASE WHEN s <> '' OR m <> '' THEN 'INVALID_ACTION' WHEN i % 6 < 3 THEN NULL WHEN i % 6 < 5 THEN 'MODEL_FAILURE' ELSE 'RESOURCE_FAILURE' END AS failure_class,
    CASE WHEN s <> '' THEN s WHEN m <> '' THEN m WHEN i % 6 IN (3, 4) THEN 'type mismatch' ELSE '' END AS messages FROM v""",
)
def staged_verification(spark, d, rows=sources):
    """V1, V2: rules first, then the relation on what is left (structures by index: right, wrong, none)."""
    prop = F.when(F.col("i") % 6 < 5, F.lit("(and true true)"))
    proof = F.when(F.col("i") % 6 < 3, "(MAnd.intro MTrue.intro MTrue.intro)").otherwise("MTrue.intro")
    told = rows(spark, d).withColumn("prop_structure", prop).withColumn("proof_structure", proof)
    out = verify.staged(told, "source", verify.relation_checker(grammar.inhabited(spark, 1)), POLICY)
    return out.select("i", "status", "failure_class", F.array_join("messages", "; ").alias("messages"))


@query("sample_ids", f"SELECT 'S' || i % 3 || CASE WHEN i % 2 = 1 THEN '_m' ELSE '_t' END || i || '_seed{SEED}' AS sample_id FROM range(100) t(i)")
def sample_ids(spark, d):
    i, level = F.col("id"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string"))
    return spark.range(100).select(F.when(i % 2 == 1, grammar.sample_id(level, i, SEED, True)).otherwise(grammar.sample_id(level, i, SEED)).alias("sample_id"))


@query("bounded_sample", f"SELECT lang, source FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || source), source) AS k FROM (SELECT DISTINCT lang, source FROM documents)) WHERE k <= 3")
def bounded_sample(spark, d):
    """N different rows of each level, by seeded order."""
    return grammar.first_of_each(table(spark, d, "documents").select("lang", "source"), "lang", 3, SEED, "source")


_P2 = f"WITH {_props_sql(2, 'both')}"


@query("mutate_swap", f"{_P2} SELECT key, '(' || op || ' ' || r || ' ' || l || ')' AS mutant FROM p2 WHERE l IS NOT NULL")
def mutate_swap(spark, d):
    return grammar.props(spark, 2, "both").select("key", mutate.swap_arguments(F.col("op"), F.col("left_key"), F.col("right_key")).alias("mutant")).where("mutant IS NOT NULL")


@query("mutate_operator", f"{_P2} SELECT key, '(' || CASE op WHEN 'and' THEN 'or' ELSE 'and' END || ' ' || l || ' ' || r || ')' AS mutant, 'operator_replacement' AS label FROM p2 WHERE l IS NOT NULL")
def mutate_operator(spark, d):
    m = mutate.swap_operator(F.col("op"), F.col("left_key"), F.col("right_key"))
    return grammar.props(spark, 2, "both").select("key", m.alias("mutant"), mutate.label(F.col("key"), m).alias("label")).where("mutant IS NOT NULL")


@query("mutate_tactic", f"SELECT i, s[:instr(s, 'by exact') - 1] || 'by apply' || s[instr(s, 'by exact') + 8:] AS replaced, s[:instr(s, 'by exact ') - 1] || 'by ' || s[instr(s, 'by exact ') + 9:] AS deleted FROM (SELECT i, {_THEOREM} AS s FROM range(3000) t(i)) WHERE contains(s, 'by exact ')")
def mutate_tactic(spark, d):
    s = spark.range(3000).select(F.col("id").alias("i"), grammar.bench_theorem(F.col("id")).alias("s"))
    return s.select("i", mutate.replace_tactic(F.col("s")).alias("replaced"), mutate.delete_tactic(F.col("s")).alias("deleted")).where("replaced IS NOT NULL")


def _draw_sql(k):
    return f"(('0x' || substr(sha256('{SEED}:' || i || ':{k}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_PICKS = " ".join(
    f"WHEN contains(s, '{old}') AND {_draw_sql(f'd{k}')} < {mutate.IDENTIFIER}::DOUBLE THEN s[:instr(s, '{old}') - 1] || {list(new)}[floor({_draw_sql(f'n{k}')} * {len(new)})::INT + 1] || s[instr(s, '{old}') + {len(old)}:]"
    for k, (old, new) in enumerate(mutate.REPLACEMENTS)
)


@query("mutate_identifier", f"SELECT i, CASE {_PICKS} END AS mutant FROM (SELECT i, {_THEOREM} AS s FROM range(3000) t(i))")
def mutate_identifier(spark, d):
    s = spark.range(3000).select(F.col("id").alias("i"), grammar.bench_theorem(F.col("id")).alias("s"))
    return s.select("i", mutate.replace_identifier(F.col("s"), F.col("i"), SEED).alias("mutant"))


@query("mutate_tree")
def mutate_tree(spark, d):
    """M2: nested edits need trees, so this one runs in Arrow batches; rows only."""
    p = grammar.props(spark, 3, "both").select("key", mutate.tree(F.col("key"), F.col("key"), SEED).alias("mutant"))
    return p.select("key", "mutant", mutate.label(F.col("key"), F.col("mutant")).alias("label"), mutate.exact_label(F.col("key"), F.col("mutant")).alias("exact_label"))


@query("mutant_parent_join", f"SELECT m.doc_id AS sample_id, p.doc_id AS parent_id, p.lang AS parent_lang FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORMAL.format('text')}) AS parent_id FROM documents) m JOIN documents p ON m.parent_id = p.doc_id WHERE m.doc_id > m.parent_id")
def mutant_parent_join(spark, d):
    """Documents that repeat an earlier one, with that one's row."""
    docs = table(spark, d, "documents")
    repeats = dedup.duplicate_details(docs, T.normalized_fingerprint(F.col("text")), "doc_id", "normalized")
    mutants = repeats.select(F.col("dup_id").alias("sample_id"), F.col("first_id").alias("parent_id"))
    return dedup.parent_join(mutants, docs.select(F.col("doc_id").alias("sample_id"), "lang")).select("sample_id", "parent_id", "parent_lang")


@query("mutant_verification", f"WITH {_props_sql(2, 'both')}, {_inhabited_sql(2)}, o AS (SELECT DISTINCT prop, proof FROM q2), m AS (SELECT '(' || op || ' ' || r || ' ' || l || ')' AS prop_structure, o.proof AS proof_structure FROM o JOIN p2 ON o.prop = p2.key WHERE l IS NOT NULL) SELECT CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.prop = prop_structure AND o.proof = proof_structure) THEN 'SUCCESS' ELSE 'FAIL_TYPECHECK' END AS status, count(*) AS n FROM m GROUP BY 1")
def mutant_verification(spark, d):
    """Mutants keep their parents' proofs and are checked against the same relation."""
    q = grammar.inhabited(spark, 2, "both").distinct()
    p = grammar.props(spark, 2, "both").where("left_key IS NOT NULL")
    m = q.join(p, q.prop == p.key).select(mutate.swap_arguments(F.col("op"), F.col("left_key"), F.col("right_key")).alias("prop_structure"), F.col("proof").alias("proof_structure"))
    return grammar.check(m, q).groupBy("status").agg(F.count("*").alias("n"))


# --- random trees, records, stages ------------------------------------------------------------


def _tree_sql(level: str, n: int) -> str:
    a, b = random_trees.structures(level, lambda path: random_trees.draw(SEED, path, sha="sha256({})", number="('0x' || {})::BIGINT::DOUBLE").replace("4294967296.0", "4294967296.0::DOUBLE"))
    return f"SELECT i, {a} AS prop_structure, {b} AS proof_structure FROM range({n}) t(i)"


N_TREES = 20_000


@query("random_s1", _tree_sql("S1", N_TREES))
def random_s1(spark, d):
    """Proposition and proof drawn alone."""
    return random_trees.generate(spark, "S1", N_TREES, SEED).select(F.col("index").alias("i"), "prop_structure", "proof_structure")


@query("random_s2", _tree_sql("S2", N_TREES))
def random_s2(spark, d):
    """A proposition with a proof of it."""
    return random_trees.generate(spark, "S2", N_TREES, SEED).select(F.col("index").alias("i"), "prop_structure", "proof_structure")


_S0_DRAWN = f"SELECT i AS \"index\", 'theorem s0_t' || i || ' : ' || {list(grammar.S0_PROPS)}[floor({{p}} * 8)::INT + 1] || ' := ' || {list(grammar.S0_PROOFS)}[floor({{q}} * 7)::INT + 1] AS source FROM range({N_TREES}) t(i)"


@query("random_s0", _S0_DRAWN.replace("{p}", "(('0x' || substr(sha256('42:' || i || ':p'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)").replace("{q}", "(('0x' || substr(sha256('42:' || i || ':q'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"))
def random_s0(spark, d):
    return random_trees.generate(spark, "S0", N_TREES, SEED).select("index", "source")


@query("random_s2_verified", f"SELECT 'SUCCESS' AS status, {N_TREES}::BIGINT AS n")
def random_s2_verified(spark, d):
    """Every drawn S2 sample is right, by the relation of all right pairs."""
    samples = random_trees.generate(spark, "S2", N_TREES, SEED)
    return grammar.check(samples, grammar.inhabited(spark, 3, "true")).groupBy("status").agg(F.count("*").alias("n"))


_KIND = f"['identifier_replacement', 'tactic_replacement', 'tactic_deletion'][floor({_draw_sql('kind')} * 3)::INT + 1]"


@query(
    "mutate_dispatch",
    f"""SELECT i, mutation_type, mutant FROM (SELECT i, s, {_KIND} AS mutation_type, CASE {_KIND} WHEN 'identifier_replacement' THEN (CASE {_PICKS} END)
    WHEN 'tactic_replacement' THEN CASE WHEN contains(s, 'by exact') THEN s[:instr(s, 'by exact') - 1] || 'by apply' || s[instr(s, 'by exact') + 8:] END
    ELSE CASE WHEN contains(s, 'by exact ') THEN s[:instr(s, 'by exact ') - 1] || 'by ' || s[instr(s, 'by exact ') + 9:] END END AS mutant FROM (SELECT i, {_THEOREM} AS s FROM range(20000) t(i))) WHERE mutant IS NOT NULL AND mutant <> s""",
)
def mutate_dispatch(spark, d):
    """M1: an edit drawn for each statement, where it applies."""
    s = spark.range(20000).select(F.col("id").alias("i"), F.lit("S0").alias("level"), grammar.bench_theorem(F.col("id")).alias("source"), *[F.lit(None).cast("string").alias(c) for c in ("prop_structure", "proof_structure")])
    return mutate.dispatch(s, "i", SEED).select("i", "mutation_type", "mutant")


def _python_sql() -> str:
    """A few lines of Python by document, then its text."""
    quote = "chr(39)"
    parts = {0: f"'    ' || {quote} || {quote} || {quote} || 'admit' || chr(10) || 'it' || {quote} || {quote} || {quote}", 1: "'    unsafe = 1'", 2: f"'    y = ' || {quote} || 'native_decide'", 3: f"'    elab(' || {quote} || 'a' || chr(92) || {quote} || 'sorry' || {quote} || ')'"}
    return "'x = \"axiom # no\" # sorry' || chr(10) || CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in parts.items()) + " END || chr(10) || coalesce(text, '')"


@query("strip_python", f"SELECT doc_id, regexp_replace({_python_sql()}, '{_q(T.PYTHON_NOISE)}', ' ', 'g') AS clean FROM documents")
def strip_python(spark, d):
    """S12 over whole documents, each after some lines of Python."""
    return table(spark, d, "documents").select("doc_id", T.strip_python(F.expr(_python_sql())).alias("clean"))


_REPORT = f"{_audit_sql('documents', 'doc_id', 'text')}, lines AS (SELECT doc_id AS id, k - 1 AS position, doc_id || ': ' || v[k] AS line FROM (SELECT doc_id, v, unnest(range(1, len(v) + 1)) AS k FROM audit))"


@query("audit_report", f"WITH {_REPORT} SELECT id, position::INT AS position, line FROM lines")
def audit_report(spark, d):
    """A4: the violations of all documents as lines."""
    return audit.report_lines(table(spark, d, "documents"), "doc_id", "text", POLICY)


@query("audit_report_fingerprint", f"WITH {_REPORT}, s AS (SELECT count(*) AS n_violations, coalesce(sum(('0x' || substr(sha256(position || '|' || line), 1, 12))::BIGINT::HUGEINT), 0) AS digest FROM lines) SELECT n AS n_samples, n_violations, sha256(n || '|' || n_violations || '|' || digest) AS fingerprint FROM s, (SELECT count(*) AS n FROM documents)")
def audit_report_fingerprint(spark, d):
    """S8."""
    return audit.report_fingerprint(table(spark, d, "documents"), "doc_id", "text", POLICY)


@query("trusted_base", f"SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'FAIL_SAFETY' ELSE 'SUCCESS' END AS status, CASE WHEN event_id % 4 = 1 THEN 'INVALID_ACTION' END AS failure_class, CASE event_id % 4 WHEN 1 THEN '''t'' depends on non-trusted axiom ''sorryAx''; ''u'' depends on non-trusted axiom ''my.ax''1''' ELSE '' END AS messages, CASE event_id % 4 WHEN 0 THEN 'Classical.choice,propext' WHEN 1 THEN 'Quot.sound,my.ax''1,propext,sorryAx' ELSE '' END AS kernel_axioms FROM events")
def trusted_base(spark, d):
    """V2: what the checker says the proofs rest on decides."""
    e = table(spark, d, "events").select("event_id", F.lit("theorem t : MTrue := MTrue.intro").alias("source"))
    checker = lambda df: df.select("*", F.lit("SUCCESS").alias("status"), F.array().cast("array<string>").alias("messages"), F.expr(_AXIOMS).alias("axioms_output"))
    out = verify.staged(e, "source", checker, POLICY)
    return out.select("event_id", "status", "failure_class", F.array_join("messages", "; ").alias("messages"), F.array_join("kernel_axioms", ",").alias("kernel_axioms"))


@query("two_tier_verdicts", f"WITH {_SPLIT} SELECT doc_id, split, CASE WHEN split = 'TEST' THEN 'batch' ELSE 'interactive' END AS mode, CASE WHEN length(text) % 2 = 0 OR split = 'TEST' THEN 'verified' ELSE 'rejected' END AS verdict FROM split")
def two_tier_verdicts(spark, d):
    """V9: a warm checker for all rows but those of TEST, which a fresh one decides."""
    docs = splits.split(table(spark, d, "documents"), "doc_id", SEED)
    warm = lambda df: df.withColumn("status", F.when(F.length("text") % 2 == 0, "SUCCESS").otherwise("FAIL_TYPECHECK"))
    fresh = lambda df: df.withColumn("status", F.lit("SUCCESS"))
    out = verify.two_tier(docs, warm, fresh)
    return out.select("doc_id", "split", "mode", verify.verdict(F.col("status"), "any")["verdict"].alias("verdict"))


@query("split_by_lang", f"WITH {_SPLIT} SELECT lang, split, count(*) AS n, sum(length(text))::BIGINT AS chars FROM split GROUP BY 1, 2")
def split_by_lang(spark, d):
    """W2 with the whole rows carried along."""
    return splits.split(table(spark, d, "documents"), "doc_id", SEED).groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("sample_records", "SELECT CAST(doc_id AS VARCHAR) AS sample_id, CASE WHEN doc_id > parent THEN 'synthetic_mutation' ELSE 'synthetic' END AS origin, 42::BIGINT AS seed, lang AS level, CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'rejected' END AS verdict, CASE WHEN quality IS NOT NULL THEN sha256(text) END AS source_hash, CASE WHEN quality = 0 THEN 'low' END AS first_error FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS parent FROM documents) LEFT JOIN labels USING (doc_id)")
def sample_records(spark, d):
    """The stored form of samples, with where they come from and how they were checked."""
    docs = table(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("parent"))
    rows = docs.join(first, "text").join(table(spark, d, "labels"), "doc_id", "left")
    null = F.lit(None).cast("string")
    rows = rows.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("level"),
        F.col("text").alias("source"),
        *[null.alias(c) for c in ("prop_structure", "proof_structure", "mutation_type", "split", "mode")],
        F.when(F.col("doc_id") > F.col("parent"), F.col("parent").cast("string")).alias("parent_id"),
        F.when(F.col("quality") == 1, "SUCCESS").when(F.col("quality") == 0, "FAIL_TYPECHECK").alias("status"),
        F.when(F.col("quality") == 0, F.array(F.lit("low"))).alias("messages"),
        F.array().cast("array<string>").alias("kernel_axioms"),
    )
    r = io.sample_records(rows, "1", SEED, "env")
    v = F.col("validation_provenance")
    return r.select("sample_id", "generator_provenance.origin", "generator_provenance.seed", "level", v["verdict"].alias("verdict"), v["source_hash"].alias("source_hash"), F.try_element_at(v["errors"], F.lit(1))["message"].alias("first_error"))


@query("jsonl_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def jsonl_round_trip(spark, d):
    """IO1, IO2, IO3: whole documents written as JSON lines and read again."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    path = f"{io.shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    io.write_jsonl(docs, path)
    return io.read_jsonl(spark, path, docs.schema).select("doc_id", "text", "lang", "source")


@query("tokenizer_report")
def tokenizer_report(spark, d):
    """K7, K9: byte pairs learned from the turns against the rule lexer, on turns, proofs and errors."""
    from textloom.plans import reports

    turns = table(spark, d, "conversations").select("text", F.when(F.col("role") == "assistant", F.col("text")).alias("error"))
    return reports.tokenizer_report(spark, turns, "text", "error", 1200)


# --- sessions, configuration ------------------------------------------------------------------


@query("action_log", "SELECT user_id, event_id, event_type AS next_state, lag(event_type) OVER w AS previous_state, row_number() OVER w AS seq FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def action_log(spark, d):
    out = sessions.action_log(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))
    return out.select("user_id", "event_id", "next_state", "previous_state", "seq")


@query("conversation_log", "SELECT conv_id, turn, role AS next_state, lag(role) OVER w AS previous_state, row_number() OVER w AS seq FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_log(spark, d):
    out = sessions.action_log(table(spark, d, "conversations"), "conv_id", ["turn"], F.col("role"))
    return out.select("conv_id", "turn", "next_state", "previous_state", "seq")


@query("session_declarations", "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_type = 'signup' THEN event_id % 5 END AS declares, CASE WHEN event_type = 'purchase' THEN event_id % 5 END AS uses FROM events) SELECT user_id, event_id, uses IS NULL OR EXISTS (SELECT 1 FROM a b WHERE b.user_id = a.user_id AND b.declares = a.uses AND b.seq < a.seq) AS ok FROM a")
def session_declarations(spark, d):
    e, name = table(spark, d, "events"), F.col("event_id") % 5
    out = sessions.declared_before(e, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", name), F.when(F.col("event_type") == "purchase", name))
    return out.select("user_id", "event_id", "ok")


@query("session_stream")
def session_stream(spark, d):
    """V10 as a stream: the events' users are sessions; available input is read to its end."""
    from textloom.streaming import sessions as S

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d) if not _is_folder(spark, f"{d}/events.parquet") else spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    requests = stream.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "reset").when(F.col("event_type") == "error", "crash").otherwise("submit").alias("op"), grammar.action(F.col("event_id")).alias("source"))
    where = f"{io.shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    q = S.replies(requests).writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(once=True).start()  # with timeouts on, availableNow would never end
    q.awaitTermination()
    return spark.read.schema(S.REPLY).parquet(f"{where}/out")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("config_fingerprint")
def config_fingerprint(spark, d):
    config = io.Config(SEED, POLICY.allowed_prefixes, R.FORBIDDEN_TOKENS, R.FORBIDDEN_DECLARATIONS, R.RESTRICTED)
    return spark.createDataFrame([(io.config_fingerprint(config), io.environment_fingerprint(spark, io.sample_schema()))], "config string, environment string")


@query("sample_json", "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"missing\":null,\"source\":\"' || source || '\"}' AS json FROM documents")
def sample_json(spark, d):
    """IO2: the sink's line of a row: keys sorted, nulls kept."""
    docs = table(spark, d, "documents").select("source", "doc_id", "lang", F.lit(None).cast("string").alias("missing"))
    return docs.select("doc_id", F.to_json(io.sorted_struct(docs), {"ignoreNullFields": "false"}).alias("json"))


@query("corpus_build")
def corpus_build(spark, d):
    """The whole build, generated rows to split and verified samples (see plans.corpus)."""
    from textloom.plans import corpus

    return corpus.build(spark, per_level=200, mutations=100, seed=SEED).select("sample_id", "level", "split", "status", "mutation_type", "parent_id", "source")


# --- the statement queries over whole documents -----------------------------------------------

OVER_DOCUMENTS = (
    "strip_comments",
    "safety_scan",
    "import_allowlist",
    "drop_imports",
    "proof_extract",
    "text_audit",
    "audit_summary",
    "word_offsets",
    "lexer_encode",
    "lexer_decode",
    "staged_verification",
)
for _name in OVER_DOCUMENTS:
    query(f"{_name}_documents", ORACLE[_name].replace(_SOURCES, _DOCUMENT_SOURCES))(partial(QUERIES[_name], rows=document_sources))
