"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts longer than ``CHUNK`` characters are split where no match of the pattern can
span: before a white-space character that follows another character.  What is left
without such a place (a very long run) is split into the pattern's own matches, each
of which is encoded by itself, as the library does.

Defined cases: null encodes as the empty text (no ids, no bytes); control strings of
other vocabularies are ordinary text; ids decode to raw bytes, which need not be
UTF-8; null ids decode to no bytes.  Extra columns pass through; the added column's
name is a parameter, and it replaces a column of that name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.text import slices

CHUNK = 20_000
#: Bytes of text whose ids a worker holds at once.
SLICE = 1_000_000

_IDS = T.ArrayType(T.IntegerType(), False)


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _splitters(pattern: str):
    import regex

    spaces = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})"), regex.compile(spaces)


def encode_text(enc, pattern: str, text: str | None, chunk: int = CHUNK) -> list[int]:
    if not text:
        return []
    if len(text) <= chunk:
        return enc.encode_ordinary(text)
    boundary, matches = _splitters(pattern)
    ids: list[int] = []
    at = 0
    while at < len(text):
        cut = boundary.search(text, at + chunk) if at + chunk < len(text) else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        if len(part) <= 4 * chunk:
            ids += enc.encode_ordinary(part)
        else:
            for m in matches.finditer(part):
                ids += enc._encode_single_piece(m.group())
        at = end
    return ids


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _encoder(rank_file: str, pattern: str, text: str, out: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in (piece for whole in batches for piece in slices(whole, text, SLICE)):
            parts = [pa.array(encode_text(enc, pattern, value.as_py()), pa.int32()) for value in batch.column(text)]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [ids], names=[*keep, out])

    return run


def _decoder(rank_file: str, pattern: str, ids: str, out: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            texts = pa.array([enc.decode_bytes(v.values.to_numpy().tolist() if v.is_valid else []) for v in batch.column(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [texts], names=[*keep, out])

    return run


def _others(names: list[str], out: str) -> list[str]:
    return [c for c in names if c != out]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with the ids of ``text`` as an int array."""
    keep = _others(docs.columns if keep is None else keep, out)
    schema = _with(docs.select(*keep).schema, out, _IDS)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_encoder(rank_file, pattern, text, out, keep), schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of ``ids``."""
    return df.mapInArrow(_decoder(rank_file, pattern, ids, out, _others(df.columns, out)), _with(df.schema, out, T.BinaryType()))


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one pass: a task keeps one worker and one set of ranks, and ids don't go through the JVM in between."""
    keep = _others(_others(docs.columns if keep is None else keep, ids), out)
    to_ids, to_bytes = _encoder(rank_file, pattern, text, ids, keep), _decoder(rank_file, pattern, ids, out, [*keep, ids])
    schema = _with(_with(docs.select(*keep).schema, ids, _IDS), out, T.BinaryType())
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lambda batches: to_bytes(to_ids(batches)), schema)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    return round_trip(docs, rank_file, pattern, keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
