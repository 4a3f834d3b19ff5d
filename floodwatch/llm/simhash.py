"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Each text has a 64-bit fingerprint; texts whose fingerprints differ in at most
``radius`` bits are linked. Equal fingerprints are merged first. For the rest,
fingerprints are sharded by block agreement: of ``radius + 3`` bit blocks two
linked fingerprints agree in at least three, so each goes to one shard per
choice of three blocks and every link is inside some shard. In a shard

* the pivot table holds every fingerprint's Hamming distances to reference
  fingerprints; rows are sorted by the first;
* by the triangle inequality no coordinate of two linked rows differs by more
  than the radius, so the first bounds a window and the largest difference of
  the others discards pairs;
* survivors are verified on the fingerprints.

(Pivot distances alone cannot shard: distances to a random reference lie
between 24 and 40 for nearly all fingerprints, so one coordinate discards only
half of all pairs and every pair would have to be looked at.)

A shard gives a spanning forest, not its pairs. Components follow in Spark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, mix, pieces, schema_with, with_columns
from .components import connected
from .toxicity import texts_of

PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Shingles hashed at once, so that a very long text needs bounded memory.
RUN = 50_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space, ``width``-word shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = ends - [len(w) + 1 for w in words]
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, RUN):
        pairs = zip(begins[at:min(n, at + RUN)].tolist(), (ends[at + k - 1:min(n, at + RUN) + k - 1] - 1).tolist())
        h = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 3) -> DataFrame:
    """Add ``out`` (long, the 64 bits as a signed number). Null texts have no words: fingerprint 0."""
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            prints = np.array([fingerprint(t, width) for t in texts_of(piece, text)], np.uint64)
            yield with_columns(piece, {out: pa.array(prints.view(np.int64), pa.int64())})
    return docs.mapInArrow(run, schema_with(docs, f"`{out}` long"))


def choices(blocks: int, agree: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``agree`` of ``blocks`` bit blocks: their (first bit, bits)."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in itertools.combinations(spans, agree)]


def shards(prints: DataFrame, name: str, radius: int) -> DataFrame:
    """(shard, fp) rows: one for each choice of three blocks."""
    keys = []
    for number, chosen in enumerate(choices(radius + 3, 3)):
        key = F.lit(number).cast("long")
        for first, bits in chosen:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col(name), first).bitwiseAND(F.lit((1 << bits) - 1).cast("long")))
        keys.append(key)
    return prints.select(F.explode(F.array(*keys)).alias("shard"), F.col(name).alias("fp"))


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ PIVOTS).astype(np.int16)


def linked(fp: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (left, right) are linked: pivot coordinates first, one after another, then the bits themselves."""
    keep = np.arange(len(left))
    for c in range(table.shape[1]):
        if not len(keep):
            break
        keep = keep[np.abs(table[left[keep], c] - table[right[keep], c]) <= radius]
    keep = keep[np.bitwise_count(fp[left[keep]] ^ fp[right[keep]]) <= radius]
    return keep


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one shard: breadth-first, each row compared with the rows not yet reached in its window."""
    order = np.argsort(pivot_table(fp)[:, 0], kind="stable")
    fp = fp[order]
    table = pivot_table(fp)
    first = table[:, 0]
    lo, hi = np.searchsorted(first, first - radius), np.searchsorted(first, first + radius, "right")
    waiting = np.ones(len(fp), bool)
    a, b = [], []
    for seed in range(len(fp)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            rest = lo[i] + np.flatnonzero(waiting[lo[i]:hi[i]])
            found = rest[linked(fp, table, np.full(len(rest), i), rest, radius)]
            waiting[found] = False
            queue += found.tolist()
            a.append(np.full(len(found), fp[i]))
            b.append(fp[found])
    return np.concatenate(a), np.concatenate(b)


def links_of(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many shards, whose rows lie together; small ones all at once."""
    begin = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
    size = np.diff(np.append(begin, len(shard)))
    a, b = [], []
    small = begin[(size > 1) & (size <= 24)]
    sizes = size[(size > 1) & (size <= 24)]
    table = pivot_table(fp) if len(small) else None
    for gap in range(1, int(sizes.max()) if len(sizes) else 0):  # row k against row k + gap of its shard
        times = np.maximum(sizes - gap, 0)
        left = np.repeat(small - (np.cumsum(times) - times), times) + np.arange(times.sum())
        hit = linked(fp, table, left, left + gap, radius)
        a.append(fp[left[hit]])
        b.append(fp[left[hit] + gap])
    for at, n in zip(begin[size > 24].tolist(), size[size > 24].tolist()):
        x, y = forest(fp[at:at + n], radius)
        a.append(x)
        b.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, name: str = "fingerprint", radius: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever is connected by differences of at most ``radius`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                shard = np.concatenate([shard, batch.column(0).to_numpy()])
                fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(shard) or batch is not None and (len(shard) < 200_000 or shard[0] == shard[-1]):
                continue
            whole = len(shard) if batch is None else int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            a, b = links_of(shard[:whole], fp[:whole], radius)
            shard, fp = shard[whole:], fp[whole:]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
    dealt = shards(prints.select(name).distinct(), name, radius)
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long").distinct()


def add_component(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component, component_id) per row of ``docs``.

    component is the smallest fingerprint reachable over links, component_id the
    smallest doc_id of the component (null ids are passed over; null if all are).
    Texts without words share fingerprint 0 and are linked like any other.
    Repeated rows stay. Only ids and fingerprints are shuffled, never texts.
    """
    spark = docs.sparkSession
    rows = cut(add_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text")), "_text", width=width).drop("_text"), "prints")
    prints = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = connected(links(prints, radius=radius))
    named = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("root", "fingerprint"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.select("fingerprint", "component").join(smallest, "component")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each component: the one with the smallest doc_id; of rows that share it, any one.

    The ids that go are found on narrow rows. Whole rows are only shuffled to part rows that share an id.
    """
    found = cut(add_component(docs, text, doc_id, **options), "components")
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    mark, print_, group = free_name(docs, "_first"), free_name(docs, "_print"), free_name(docs, "_component")
    winners = first.groupBy(F.col("component").alias(group)).agg(F.min("fingerprint").alias("_at"), F.first("doc_id").alias(mark))
    own = add_fingerprint(docs, text, print_)
    joined = own.join(winners, own[doc_id].eqNullSafe(winners[mark]) & (own[print_] == winners["_at"]))
    return joined.dropDuplicates([group]).select(*(own[c] for c in docs.columns))
