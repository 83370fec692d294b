"""Sources and sinks: JSON lines, text files, summaries, configuration."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tempfile
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = (
    "generator_provenance STRUCT<extra: MAP<STRING,STRING>, generator_version: STRING, level: STRING, mutation_type: STRING, origin: STRING, parent_id: STRING, seed: BIGINT>, "
    "level STRING, mutation_type STRING, parent_id STRING, proof_lean STRING, proof_structure STRING, prop_lean STRING, prop_structure STRING, sample_id STRING, source STRING, split STRING, "
    "validation_provenance STRUCT<environment_hash: STRING, errors: ARRAY<STRUCT<column: INT, line: INT, message: STRING, severity: STRING>>, kernel_axioms: ARRAY<STRING>, lean_version: STRING, mode: STRING, source_hash: STRING, status: STRING, verdict: STRING>"
)


def sample_schema() -> T.StructType:
    return T.StructType.fromDDL(SAMPLE)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir says. Where none is set, a local
    one, made once, if the master is local; on a cluster executors could not read each other's."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back, so that what follows does not
    compute it again and does not depend on the order in which rows come."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, malformed ones fail (or as ``mode`` says)."""
    reader = spark.read.option("mode", mode)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def sorted_struct(df: DataFrame):
    """All columns in one struct, fields in alphabetical order at every level."""

    def shape(c, t):
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[shape(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: shape(x, t.elementType))
        return c

    return F.struct(*[shape(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def sample_records(df: DataFrame, version: str, seed: int, environment: str) -> DataFrame:
    """Samples (sample_id, level, source, structures, split, status, messages, kernel_axioms, mode,
    parent_id, mutation_type) in the stored form, with where each comes from and how it was
    checked; rows without a status have no validation_provenance."""
    null = lambda t: F.lit(None).cast(t)
    body = F.element_at(F.split("source", " : ", 2), 2)
    made = F.struct(
        F.create_map().cast("map<string,string>").alias("extra"),
        F.lit(version).alias("generator_version"),
        "level",
        "mutation_type",
        F.when(F.col("parent_id").isNull(), "synthetic").otherwise("synthetic_mutation").alias("origin"),
        "parent_id",
        F.lit(seed).cast("long").alias("seed"),
    )
    errors = F.transform(F.coalesce("messages", F.array().cast("array<string>")), lambda m: F.struct(null("int").alias("column"), null("int").alias("line"), m.alias("message"), F.lit("error").alias("severity")))
    checked = F.struct(
        F.lit(environment).alias("environment_hash"),
        errors.alias("errors"),
        "kernel_axioms",
        null("string").alias("lean_version"),
        "mode",
        F.sha2("source", 256).alias("source_hash"),
        "status",
        F.when(F.col("status") == "SUCCESS", "verified").otherwise("rejected").alias("verdict"),
    )
    out = df.withColumn("generator_provenance", made).withColumn("validation_provenance", F.when(F.col("status").isNotNull(), checked))
    out = out.withColumn("prop_lean", F.substring_index(body, " := ", 1)).withColumn("proof_lean", F.element_at(F.split(body, " := ", 2), 2))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in sample_schema()])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with sorted keys, nulls kept and text unescaped, one part for each partition."""
    df.select(F.to_json(sorted_struct(df), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_summary(one: DataFrame, path: str, stamp: bool = False) -> str:
    """The only row of a table as indented JSON with sorted keys; a time stamp in UTC if asked."""
    row = json.loads(one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    if stamp:
        row["timestamp_utc"] = datetime.now(timezone.utc).isoformat()
    text = json.dumps(row, indent=2, sort_keys=True, ensure_ascii=False)
    one.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


# --- configuration ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    batch_seconds: float = 60.0
    action_seconds: float = 30.0
    startup_seconds: float = 120.0
    max_output_bytes: int = 1_000_000


@dataclass(frozen=True)
class Config:
    seed: int
    allowed_prefixes: tuple[str, ...]
    forbidden_tokens: tuple[str, ...]
    forbidden_declarations: tuple[str, ...]
    restricted: tuple[str, ...]
    train: float = 0.8
    validation: float = 0.1
    limits: Limits = field(default_factory=Limits)


def load_config(path: str) -> Config:
    """From YAML; unknown keys and missing ones without a default raise."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    tuples = {k: tuple(raw[k]) for k in ("allowed_prefixes", "forbidden_tokens", "forbidden_declarations", "restricted")}
    rest = {k: v for k, v in raw.items() if k not in tuples and k != "limits"}
    return Config(**tuples, **rest, limits=Limits(**raw.get("limits", {})))


def config_fingerprint(config: Config) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(config), sort_keys=True).encode()).hexdigest()


def environment_fingerprint(spark: SparkSession, schema: T.StructType, extra: dict | None = None) -> str:
    """Of what results depend on: Spark's version, SQL settings that matter, the schema."""
    keys = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")
    what = {"version": spark.version, "schema": schema.json(), "conf": {k: spark.conf.get(k) for k in keys}, "extra": extra or {}}
    return hashlib.sha256(json.dumps(what, sort_keys=True).encode()).hexdigest()
