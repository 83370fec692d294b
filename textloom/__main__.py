"""Command line: python -m textloom COMMAND, or spark-submit with this file.

    build --output PATH [--per-level N] [--mutations N] [--seed N] [--config YAML] [--audit FILE ...]
    tokenizers --input JSONL --output PATH [--vocabulary N]
    actions --command PROGRAM [--n N]

``build`` audits the generators' sources first, writes the corpus and its summary, and exits with 1
if an audit fails.
"""

from __future__ import annotations

import argparse
import shlex
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions import rules as R
from textloom.operators import audit
from textloom.plans import corpus, reports
from textloom.sources import io


def build(spark: SparkSession, a) -> int:
    seed, policy = a.seed, R.Policy()
    if a.config:
        config = io.load_config(a.config)
        policy = R.Policy(config.allowed_prefixes, config.forbidden_tokens, config.forbidden_declarations, config.restricted)
    if a.audit and not (bad := audit.audit_files(spark, a.audit)).isEmpty():
        bad.show(100, truncate=False)
        return 1
    samples = io.materialize(corpus.build(spark, a.per_level, a.mutations, seed, policy))
    print(corpus.write(samples, a.output, seed))
    return 0 if corpus.summary(samples, seed).select("audit_ok").first()[0] else 1


def tokenizers(spark: SparkSession, a) -> int:
    samples = io.read_jsonl(spark, a.input, io.sample_schema())
    first = F.try_element_at(F.col("validation_provenance.errors"), F.lit(1))["message"]
    report = io.materialize(reports.tokenizer_report(spark, samples.select("source", first.alias("error")), "source", "error", a.vocabulary, timed=True))
    print(io.write_summary(report.groupBy().agg(F.collect_list(F.struct("*")).alias("tokenizers")), a.output, stamp=True))
    return 0


def actions(spark: SparkSession, a) -> int:
    for table in reports.action_timings(spark, shlex.split(a.command), a.n):
        table.show(truncate=False)
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(required=True)
    b = sub.add_parser("build")
    b.set_defaults(run=build)
    b.add_argument("--output", required=True)
    b.add_argument("--per-level", type=int, default=30)
    b.add_argument("--mutations", type=int, default=10)
    b.add_argument("--seed", type=int, default=42)
    b.add_argument("--config")
    b.add_argument("--audit", nargs="*", default=[])
    t = sub.add_parser("tokenizers")
    t.set_defaults(run=tokenizers)
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--vocabulary", type=int, default=8000)
    c = sub.add_parser("actions")
    c.set_defaults(run=actions)
    c.add_argument("--command", required=True)
    c.add_argument("--n", type=int, default=100)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
