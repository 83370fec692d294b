"""Token counts by section: each document is encoded once, whole, and its tokens are attributed
to sections through their character offsets.

The byte-level vocabulary makes tokens partition the text's bytes, so token ends are the running
sums of token lengths. Sections partition the same bytes. The interval join is a merge of the two
sorted lists of ends (searchsorted), linear in the text, without a row per token.

Rule for a token that crosses section boundaries (``rule``):
  "majority"  the section with most of its bytes; on a tie, the earliest of them (default)
  "start"     the section of its first byte
  "end"       the section of its last byte
Every token counts in exactly one section, so section counts add up to the document's count.
"""

from __future__ import annotations

import base64
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits a text before merging (fixed value, public).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "start", "end")
#: A section ends after each run of line breaks.
SECTION_END = rb"\n+"

DDL = "doc_id long, n_tokens long, n_sections long, n_crossing long, sections array<struct<start: long, end: long, start_char: long, end_char: long, n_tokens: long>>"
SPAN = pa.struct([(c, pa.int64()) for c in ("start", "end", "start_char", "end_char", "n_tokens")])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_sections", pa.int64()), ("n_crossing", pa.int64()), ("sections", pa.list_(SPAN))])

_ENCODERS: dict[str, tuple] = {}


def encoder(vocabulary: str):
    """The encoding and the byte length of each token id; loaded once in each worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            length[i] = len(token)
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _ENCODERS[vocabulary]


def line_sections(text: bytes) -> np.ndarray:
    """Ends of the sections of a text: after each run of line breaks, and at the end."""
    ends = [m.end() for m in re.finditer(SECTION_END, text)]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return np.array(ends, np.int64)


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Section of each token, and how many tokens cross a boundary. Tokens and sections partition
    the same bytes; both are given by their ends."""
    starts = np.concatenate(([0], token_ends))[:-1].astype(np.int64)
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    crossing = np.flatnonzero(first != last)
    at = last.copy() if rule == "end" else first.copy()
    if rule == "majority":
        for k in crossing:
            s, e, a, b = starts[k], token_ends[k], first[k], last[k]
            edges = np.clip(np.concatenate(([s], section_ends[a : b + 1])), s, e)
            at[k] = a + int(np.argmax(np.diff(edges)))
    return at, len(crossing)


FIELD_END = "\n\n"


def field_counts(docs: DataFrame, fields: list[str], id_col: str = "doc_id", vocabulary: str = VOCABULARY, rule: str = "majority") -> DataFrame:
    """Per row of docs: doc_id, n_tokens and field_tokens, one number for each of the text columns.

    The columns are joined by FIELD_END and encoded once; what separates two fields belongs to the
    former. Null fields are empty; they still have their separator, so counts keep their places.
    """
    if not fields:
        raise ValueError("fields must not be empty")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    ends = F.array(*[F.octet_length(F.concat(p, F.lit(FIELD_END) if k < len(parts) - 1 else F.lit(""))).cast("long") for k, p in enumerate(parts)])
    C.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws(FIELD_END, *parts).alias("text"), ends.alias("sizes"))
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("field_tokens", pa.list_(pa.int64()))])

    def run(batches):
        encode, length = encoder(vocabulary)
        for b in C.packed(batches):
            out = []
            for text, sizes in zip(C.texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                stops = np.cumsum(np.array(sizes, np.int64))
                token_ends = np.cumsum(length[np.array(encode.encode_ordinary(text.decode()), np.int64)])
                at, crossing = allocate(token_ends, stops, rule)
                out.append((len(token_ends), crossing, np.bincount(at, minlength=len(sizes)).tolist()))
            yield C.batch(schema, b.column(0), *map(list, zip(*out, strict=True)))

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_crossing long, field_tokens array<long>")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "majority", sections=line_sections) -> DataFrame:
    """Per row of docs: n_tokens of the whole text, n_sections, n_crossing (tokens that cross a
    boundary) and the sections (byte and character offsets, tokens by the rule).

    Null and empty texts have no tokens and no sections. Strings of special tokens are ordinary
    text. Other columns of docs are not looked at; repeated rows give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        encode, length = encoder(vocabulary)
        for b in C.packed(batches):
            n_tokens, n_crossing, offsets = [], [], [0]
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for text in C.texts(b.column(1)):
                ends = np.cumsum(length[np.array(encode.encode_ordinary(text.decode()), np.int64)])
                stops = sections(text)
                at, crossing = allocate(ends, stops, rule)
                chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
                begin = np.concatenate(([0], stops[:-1])).astype(np.int64)[: len(stops)]
                for col, v in zip(columns, (begin, stops, chars[begin], chars[stops], np.bincount(at, minlength=len(stops))), strict=True):
                    col.append(v)
                n_tokens.append(len(ends))
                n_crossing.append(crossing)
                offsets.append(offsets[-1] + len(stops))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], fields=list(SPAN))
            yield C.batch(SCHEMA, b.column(0), n_tokens, np.diff(offsets), n_crossing, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat))

    return C.id_text(docs, id_col, text_col).mapInArrow(run, DDL)
