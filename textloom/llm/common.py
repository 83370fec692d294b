"""What the operators share: bounded Arrow batches, the shared folder, byte kernels.

Texts reach numpy as concatenated UTF-8 bytes with document offsets; every kernel works on
chunks of about ``CHUNK`` bytes, so a worker's memory does not depend on the table's size
(one text is never split, so it must fit in memory).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = 1_000_000
U = np.uint64


# --- Spark side -------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set and the master is
    local, as executors of a cluster could not read each other's."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(bits: int, each: int) -> int:
    """Partitions for two to the power of ``bits`` buckets: ``each`` buckets to one where this makes
    64 or more of them, as a partition writes a file."""
    return max(min(1 << bits, 64), (1 << bits) // each)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


#: Arrow batches, which otherwise hold 10,000 texts or 64 MB: rows, and bytes unless set lower.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, for this session; lower settings stay. Lists are read
    by rows: read by columns, 4,096 rows of some MB (packed texts) are in memory at once."""
    spark.conf.set("spark.sql.parquet.enableNestedColumnVectorizedReader", "false")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def hash_sample(rows: DataFrame, label_col: str, most: int) -> list[tuple[object, bytes]]:
    """At most ``most`` (label, UTF-8 text) pairs, shared evenly by the labels, in a fixed order.

    A hash of the text picks them: labels are counted, rows below a hash bound for some more than
    the share are kept, and of these, distinct by text, the first ones by hash.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    if not counts:
        return []
    share = max(1, most // len(counts))
    bound = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * share + 20) / n))]), F.col(label_col))
    h = F.xxhash64("text")
    some = rows.select(label_col, "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 30)) < bound * (1 << 30)).dropDuplicates([label_col, "h"])
    first = some.withColumn("k", F.row_number().over(Window.partitionBy(label_col).orderBy("h"))).where(F.col("k") <= share)
    return sorted(((r[0], r[1].encode()) for r in first.select(label_col, "text").collect()), key=lambda x: (str(x[0]), x[1]))


# --- Arrow side -------------------------------------------------------------------------------


def packed(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text (column number ``text``) each."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes + 16) - 1) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for s, e in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield b.slice(s, e - s)
    trim()


def trim() -> None:
    """Gives freed memory back to the system: workers are reused, and what one task has freed would
    stay with its worker while the next stage's tasks run."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes and the offsets of the documents (one more than documents)."""
    off = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=off[1:])
    return np.frombuffer(b"".join(docs), np.uint8), off


def planes(x: np.ndarray) -> bytes:
    """The bytes of an array by significance, which compress far better if neighbours are alike."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- byte kernels -----------------------------------------------------------------------------


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


_BASE = 0x5851F42D4C957F2D
_VALUE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_POW = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse, at least n of them."""
    if _POW["n"] < n:
        n = max(n, 1 << 20)
        for name, b in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, b, U)
            x[0] = 1
            _POW[name] = np.cumprod(x, dtype=U)
        _POW["n"] = n
    return _POW["pow"], _POW["inv"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the fingerprint of any byte span."""
    return prefix_sums(_VALUE[buf])


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """prefix_hash() over a sequence of 64-bit values."""
    power, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes start[k], start[k] + 1, ... (count[k] of them), for each k in turn."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over the bytes of data, cut at the ends (byte offsets)."""
    off = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the spans; equal bytes give equal fingerprints anywhere."""
    return mix64((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] + (end - start).astype(U))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space; words of letters, digits and non-ASCII (after lower-casing).
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, none across documents, and for
    each document the index of its first word (one more than documents)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = inside[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, off)


class Lookup:
    """Positions of 64-bit fingerprints in a sorted array, by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length())
        self.shift = U(64 - self.bits)
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U) << self.shift).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Index of each fingerprint, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at, todo, n = self.first[(h >> self.shift).astype(np.int64)], None, len(self.keys)
        while len(h):
            found = self.keys[np.minimum(at, n - 1)]
            hit = (found == h) & (at < n)
            if todo is None:
                out[hit] = at[hit]
                todo = np.flatnonzero((found < h) & (at < n))
                h, at = h[todo], at[todo] + 1
            else:
                out[todo[hit]] = at[hit]
                more = (found < h) & (at < n)
                todo, h, at = todo[more], h[more], at[more] + 1
        return out
