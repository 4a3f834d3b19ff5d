"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A string is repeated if it is ``length`` (200) bytes long and also starts at any
other place of any text. The classic difference-cover algorithm sorts sampled
suffixes, names them, recurses on the names, merges the rest and compares
adjacent prefixes. Here suffixes need to be told apart only up to ``length``
bytes, so each of its steps becomes one exchange of names:

1. Sample: the places of a text whose number modulo 133 is in a difference
   cover (12 of 133 residues; two places always have a common shift below 133
   that brings both into the sample). Their first 64 bytes are named; the names
   of all texts are sorted and a name that stands beside an equal one is flagged.
2. Recursion on names: flagged places get the name of their first ``length``
   bytes; equal neighbours in the sorted order are repeats.
3. Merge: what is left open, places less than 133 before a flagged sample, is
   joined to the classes of samples that some open place depends on.
4. The remaining suffixes of these classes are named over ``length`` bytes,
   sorted and compared with their neighbours.

Two equal strings have a sampled place at a common shift, whose 64 bytes lie in
both, so both are flagged; if one of them is not covered by step 2, its class is
open and both take part in step 4. No repeat is lost. Names are 64-bit hashes;
names of 64 bytes only choose candidates. Only names travel, grouped by leading
bits, never texts; no rank of the whole corpus is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, free_name, mix, put_back, ranges_of, set_aside
from .exchange import BUCKET, SCHEMA, answered, ask, bits_of, bucketed_table, by_round, labelled, questions

PERIOD = 133
#: A perfect difference set modulo 133.
COVER = np.array([0, 1, 3, 17, 21, 58, 65, 73, 100, 105, 111, 124])
SEED_BYTES = 64


def names_at(raw: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` bytes (a multiple of 8) from each place on."""
    if not len(places):
        return np.empty(0, np.uint64)
    words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    h = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(0, length, 8):
        h = (h ^ words[places + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


class Texts:
    """The texts of a bucket, one after another, and what the rounds have found about them."""

    def __init__(self, column, length: int):
        self.raw, self.rows = buffer_of(column)
        self.raw = np.ascontiguousarray(self.raw)
        self.length = length
        begin, size = self.rows[:-1], np.diff(self.rows)
        self.long = size >= length
        begin, size = begin[self.long], size[self.long]
        periods = -(-size // PERIOD)
        base = np.repeat(begin, periods) + PERIOD * ranges_of(np.zeros(len(periods), np.int64), periods)
        end = np.repeat(begin + size, periods)
        places = (base[:, None] + COVER).ravel()
        end = np.repeat(end, len(COVER))
        self.samples = places[places + SEED_BYTES <= end]
        self.begin, self.size = begin, size
        self.covered = np.zeros(len(self.raw) + 1, bool)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names of the samples, the name's number of each sample, and how often each occurs."""
        return np.unique(names_at(self.raw, self.samples, SEED_BYTES), return_inverse=True, return_counts=True)

    def whole(self) -> np.ndarray:
        """For every place, whether ``length`` bytes follow in its text."""
        ok = np.zeros(len(self.raw) + 1, bool)
        ok[ranges_of(self.begin, self.size - self.length + 1)] = True
        return ok

    def cover(self, places: np.ndarray) -> None:
        """Mark the ``length`` bytes from each place on."""
        if len(places):
            step = np.zeros(len(self.raw) + self.length + 1, np.int32)
            np.add.at(step, places, 1)
            np.add.at(step, places + self.length, -1)
            self.covered |= np.cumsum(step[:len(self.raw) + 1]) > 0

    def before(self, marks: np.ndarray) -> np.ndarray:
        """Number of marks before each place."""
        out = np.zeros(len(marks) + 1, np.int32)
        np.cumsum(marks, out=out[1:])
        return out


class Rounds:
    """One bucket's way through the rounds, as far as answers are there."""

    def __init__(self, column, length: int, bits: int, seed_bits: int, answers: dict[str, dict[int, bytes]]):
        self.t = t = Texts(column, length)
        self.bits = bits
        self.seed_names, number, self.seed_counts = t.seeds()
        if "seeds" not in answers:
            return
        flagged = answered(self.seed_names, seed_bits, answers["seeds"], bool)
        keep = flagged[number.ravel()]
        self.samples, self.classes = t.samples[keep], number.ravel()[keep]
        whole = t.whole()
        at = self.samples[whole[self.samples]]
        self.long_names, number, self.long_counts = np.unique(names_at(t.raw, at, length), return_inverse=True, return_counts=True)
        if "names" not in answers:
            return
        t.cover(at[answered(self.long_names, bits, answers["names"], bool)[number.ravel()]])
        # samples on which an uncovered string may depend: one begins less than PERIOD before
        bare = t.before(~t.covered)
        ends = np.minimum(np.arange(len(whole)) + length, len(t.raw))
        open_ = whole & (bare[ends] > bare[:-1])
        count = t.before(open_)
        depends = count[self.samples + 1] > count[np.maximum(self.samples - PERIOD + 1, 0)]
        self.flag_names = self.seed_names[flagged]
        place = np.cumsum(flagged) - 1
        self.open_classes = np.zeros(len(self.flag_names), bool)
        self.open_classes[place[self.classes[depends]]] = True
        if "open" not in answers:
            return
        wanted = answered(self.flag_names, seed_bits, answers["open"], bool)
        near = np.zeros(len(whole) + 1, np.int32)  # places less than PERIOD before a sample of an open class
        live = self.samples[wanted[place[self.classes]]]
        np.add.at(near, np.maximum(live - PERIOD + 1, 0), 1)
        np.add.at(near, live + 1, -1)
        at = np.flatnonzero(whole & (np.cumsum(near[:-1]) > 0))
        self.rest_names, number, self.rest_counts = np.unique(names_at(t.raw, at, length), return_inverse=True, return_counts=True)
        if "rest" not in answers:
            return
        t.cover(at[answered(self.rest_names, bits, answers["rest"], bool)[number.ravel()]])


def _repeated(number: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    return (np.bincount(number, counts, n) > 1)[number]


def _any(number: np.ndarray, n: int, marks: np.ndarray) -> np.ndarray:
    return (np.bincount(number, marks, n) > 0)[number]


def find_repeats(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), length: int = 200) -> DataFrame:
    """Add removed_spans (byte start and end of each maximal run of repeated bytes) and kept (the other bytes).

    Texts are taken as UTF-8; null texts are empty. Matches never cross texts;
    strings are judged on the input. ``keys`` and the text deal rows to buckets.
    Columns of these names are replaced. ``length`` is a multiple of 8 from 200 on.
    """
    if length % 8 or length < PERIOD + SEED_BYTES:
        raise ValueError(f"length must be a multiple of 8 and at least {PERIOD + SEED_BYTES}")
    docs, aside = set_aside(docs.drop("removed_spans", "kept"), BUCKET)
    body = free_name(docs, "_body")
    rest = [c for c in docs.columns if c != text]
    table, size = bucketed_table(docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit(""))).drop(text), body, [*keys, body])
    seed_width, seed_bits, bits = 5, bits_of(size * len(COVER) // PERIOD * 5), bits_of(size)
    # a seed's name is cut to 40 bits and the bits of its part; the cut happens here, so that all rounds agree
    short = table.select(BUCKET, body)
    answers: DataFrame | None = None

    def asked(which: str, key_bits: int, width: int):
        def run(key, left, right):
            r = Rounds(left.column(body), length, bits, seed_bits, by_round(right) if right is not None else {})
            names, values = {"seeds": lambda: (r.seed_names, np.minimum(r.seed_counts, 2)), "names": lambda: (r.long_names, np.minimum(r.long_counts, 2)),
                             "open": lambda: (r.flag_names, r.open_classes), "rest": lambda: (r.rest_names, np.minimum(r.rest_counts, 2))}[which]()
            return labelled(key[0].as_py(), {which: questions(names, key_bits, width, values.astype(np.uint8))})
        if answers is None:
            return short.groupBy(BUCKET).applyInArrow(lambda key, left: run(key, left, None), SCHEMA)
        return short.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(run, SCHEMA)

    for which, key_bits, width, how in (("seeds", seed_bits, seed_width, _repeated), ("names", bits, 8, _repeated), ("open", seed_bits, seed_width, _any), ("rest", bits, 8, _repeated)):
        got = ask(asked(which, key_bits, width), {which: (width, how, "u1")}, which).drop("sums")
        answers = got if answers is None else answers.unionByName(got)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        r = Rounds(left.column(body), length, bits, seed_bits, by_round(right))
        raw, rows, gone = r.t.raw, r.t.rows, r.t.covered
        edge = np.diff(gone[:-1].astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        # a run that reaches over the end of a text is two
        inner = rows[1:-1]
        split = inner[(inner > 0) & (inner < len(raw))]
        split = split[gone[split] & gone[split - 1]]
        begin, end = np.unique(np.concatenate([begin, split])), np.unique(np.concatenate([end, split]))
        owner = np.searchsorted(rows, begin, "right") - 1
        spans: list[list[dict]] = [[] for _ in range(len(rows) - 1)]
        for o, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
            spans[o].append({"start": a - int(rows[o]), "end": b - int(rows[o])})
        kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(rows.tolist(), rows[1:].tolist())]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        extra = {"removed_spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}
        out = pa.table({**{c: left.column(c) for c in rest}, body: left.column(body), **extra})
        return out
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(text).schema), f"`{body}` string", "removed_spans array<struct<start:bigint,end:bigint>>", "kept binary"])
    done = table.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(finish, ddl)
    return put_back(done.withColumnRenamed(body, text), aside)


def digests(text: str = "text") -> dict:
    """Columns n_bytes, n_removed, n_spans and kept_sha256 of :func:`find_repeats`."""
    return {"n_bytes": F.octet_length(text).cast("long"), "n_removed": F.octet_length(text).cast("long") - F.octet_length("kept"),
            "n_spans": F.size("removed_spans").cast("long"), "kept_sha256": F.sha2("kept", 256)}
