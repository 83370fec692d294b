"""The registered opN_ queries: thin wrappers that derive the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import oracle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import common, context_tree

    out = context_tree.score(table(spark, sf_dir, "documents"), common.crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (common.crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.decontaminate import matches, report

    out = report(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.quality_rules import apply_rules

    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.jaccard_join import join

    return join(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import language_id as L

    docs = table(spark, sf_dir, "documents")
    model = L.train(docs.where(~L.held_out()))
    return L.identify(docs, model).select("doc_id", L.held_out().alias("held_out"), "lang_pred", "score", "family")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.token_counts import token_counts

    out = token_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", "n_sections", "n_crossing", F.transform("sections", lambda x: x["n_tokens"]).alias("section_tokens"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import pii

    out = pii.personal_data(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import quality_classifier as Q

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = Q.train(docs, labels.where(~Q.held_out()))
    out = Q.classify(docs, model)
    return out.select("doc_id", Q.held_out().alias("held_out"), "score", (F.col("score") >= Q.THRESHOLD).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes and compares; NULL texts count as empty."""
    from textloom.llm import pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.decode(pieces.encode(docs, keep_text=True))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), (F.col("decoded") == F.col("text")).alias("lossless"))


QUERIES = {
    "op8_suffix_dedup": op8_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op1_context_tree": op1_context_tree,
    "op9_pieces": op9_pieces,
    "op3_pii": op3_pii,
    "op4_quality_classifier": op4_quality_classifier,
    "op6_language_id": op6_language_id,
    "op10_token_counts": op10_token_counts,
    "op2_decontaminate": op2_decontaminate,
    "op7_quality_rules": op7_quality_rules,
}
ORACLE = {
    "op2_decontaminate": oracle.DECONTAMINATE,
    "op7_quality_rules": oracle.QUALITY_RULES,
}
