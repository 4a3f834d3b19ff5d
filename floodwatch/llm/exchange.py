"""Asking all documents about keys that one bucket of documents holds.

Buckets hold a bounded amount of text each. A bucket sends its distinct 64-bit
keys, sorted and cut into parts by their leading bits, as packed arrays; a part
meets in one task, which answers every bucket in the order of its keys. A key
that a third of all texts hold is one entry per bucket, so no part is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, staged_folder, text_bytes

BUCKET = "_bucket"
#: Text bytes per bucket and packed bytes per part, about.
BUCKET_BYTES = 8 << 20
PART_BYTES = 8 << 20
#: Files of the bucketed table; buckets beyond them share files.
FILES = 20_000


def bucketed_table(docs: DataFrame, text: str, keys: list[str], bucket_bytes: int | None = None) -> tuple[DataFrame, int]:
    """``docs`` with an int BUCKET column, written so that Spark finds a bucket's rows without a shuffle; and the bytes of text."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    buckets = max(1, -(-size // (bucket_bytes or BUCKET_BYTES)))
    name = f"llm_{uuid.uuid4().hex}"
    path = f"{staged_folder(spark)}/{name}"
    dealt = bucketed(docs, [F.col(k) for k in keys], buckets, BUCKET)
    files = min(buckets, FILES)
    (dealt.repartition(files, BUCKET).write.option("compression", "zstd").option("path", path).bucketBy(files, BUCKET).format("parquet").saveAsTable(name))
    return spark.table(name), size


def bits_of(total: int) -> int:
    """Leading bits that name a part, so that parts have about PART_BYTES."""
    return max(1, int(max(1, total // PART_BYTES)).bit_length())


def pack(keys: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each 64-bit key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def planes(values: np.ndarray) -> bytes:
    """Bytes of an array, first all lowest bytes, then the next: small numbers compress to little."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def questions(keys: np.ndarray, bits: int, width: int, values: np.ndarray) -> pa.Table:
    """Rows (part, keys, v0) of sorted distinct keys with a value each."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, np.int64)
    edges = [*begin.tolist(), len(part)]
    spans = list(zip(edges, edges[1:]))
    return pa.table({"part": pa.array(part[begin], pa.int64()), "keys": pa.array([pack(keys[a:b], width) for a, b in spans], pa.binary()),
                     "v0": pa.array([planes(np.ascontiguousarray(values[a:b])) for a, b in spans], pa.binary())})


SCHEMA = f"{BUCKET} int, round string, part long, keys binary, v0 binary"


def labelled(bucket: int, tables: dict[str, pa.Table]) -> pa.Table:
    """The questions of a bucket, by round, as rows of SCHEMA."""
    out = [pa.table({BUCKET: pa.array(np.full(t.num_rows, bucket), pa.int32()), "round": pa.array([r] * t.num_rows, pa.string()),
                     **{c: t.column(c) for c in t.column_names}}) for r, t in tables.items()]
    return pa.concat_tables(out)


def ask(asked: DataFrame, rounds: dict[str, tuple[int, Callable, str]], name: str) -> DataFrame:
    """Answers (BUCKET, round, part, answer, sums) to rows of SCHEMA.

    ``rounds`` has for each round the bytes of a packed key, an answer function
    and the type of the values. ``answer(key numbers, number of distinct keys,
    values)`` gets, for all entries of a part, the number of the entry's key
    among the part's distinct keys, and gives one array with an entry's answer
    each (bool arrays are packed), or that and a list of whole numbers, which
    stands in the column sums once per part.
    """
    def run(key, table):
        width, answer, kind = rounds[key[0].as_py()]
        keys = [unpack(x, width) for x in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
        got = np.concatenate([from_planes(x, kind) for x in table.column("v0").to_pylist()])
        out, sums = answer(number.ravel(), len(distinct), got), None
        if isinstance(out, tuple):
            out, sums = out
        edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        back = [np.packbits(out[a:b]).tobytes() if out.dtype == bool else planes(out[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table({BUCKET: table.column(BUCKET), "round": table.column("round"), "part": table.column("part"), "answer": pa.array(back, pa.binary()),
                         "sums": pa.array([sums, *[None] * (len(back) - 1)], pa.list_(pa.int64()))})
    return cut(asked.groupBy("round", "part").applyInArrow(run, f"{BUCKET} int, round string, part long, answer binary, sums array<bigint>"), name)


def answered(keys: np.ndarray, bits: int, rows: dict[int, bytes], dtype) -> np.ndarray:
    """Answers in the order of the bucket's sorted distinct keys."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, np.int64)
    edges = [*begin.tolist(), len(part)]
    out = []
    for a, b in zip(edges, edges[1:]):
        data = rows[int(part[a])]
        out.append(np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool) if dtype is bool else from_planes(data, dtype))
    return np.concatenate(out) if out else np.empty(0, dtype)


def by_round(answers: pa.Table) -> dict[str, dict[int, bytes]]:
    out: dict[str, dict[int, bytes]] = {}
    for r, p, a in zip(answers.column("round").to_pylist(), answers.column("part").to_pylist(), answers.column("answer").to_pylist()):
        out.setdefault(r, {})[p] = a
    return out
