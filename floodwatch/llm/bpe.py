"""Byte-level BPE encoding and decoding by forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so
it marks a certain cut. These cuts and the cuts of the pre-tokenizer (found with
array operations over a whole batch) part a text into short fragments. A merge
never crosses a cut, so each fragment is encoded on its own, once while it is in
the cache, and the parts are concatenated.

The vocabulary is the JSON file of the ``tokenizers`` library: byte-level BPE
with the library's own splitting pattern. Other settings (normalizer, prefix
space, dropout, ...) are refused rather than ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffer_of, pieces, schema_with, with_columns

#: Fragments a worker keeps encoded.
CACHE = 100_000
#: Text bytes split at once; the fragments of a piece are Python objects, so pieces are short.
PIECE = 1 << 20
LETTER, NUMBER, OTHER, SPACE = range(4)
#: The endings that the splitting pattern parts from a word.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else 256 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.lru_cache(1)
def character_classes() -> bytes:
    """Letter, number, other or white space for every code point, as the library's own splitter tells them apart."""
    from tokenizers.pre_tokenizers import ByteLevel
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)

    def kinds(points: list[int]) -> None:
        # "a", c, "1", c, "!", c in one string: c joins the letter, the number or the sign it follows, or none
        for c in points:
            ch = chr(c)
            for kind, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(split(sign + ch)) == 1:
                    out[c] = kind
                    break
            else:
                out[c] = SPACE

    step = 64
    for base in range(0, 0x110000, step):
        block = [c for c in range(base, base + step) if not 0xD800 <= c < 0xE000]
        if not block:
            continue
        run = "".join(map(chr, block))
        for kind, sign in ((LETTER, "a"), (OTHER, "!")):
            if base > 0x100 and len(split(sign + run)) == 1:
                out[block] = kind
                break
        else:
            kinds(block)
    return zlib.compress(out.tobytes())


class Codec:
    """A vocabulary with its merges, cuts and fragment cache."""

    def __init__(self, model: str, classes: bytes):
        spec = json.loads(model)
        pre, core = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [spec.get("normalizer"), core.get("dropout"), core.get("unk_token"), core.get("continuing_subword_prefix"),
               core.get("end_of_word_suffix"), core.get("ignore_merges"), core.get("byte_fallback"), core.get("fuse_unk"),
               pre.get("add_prefix_space"), *(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))]
        if core["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or any(odd):
            raise ValueError("a byte-level BPE vocabulary with the plain splitting pattern is needed")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        raw = {t: bytes(map(to_byte.__getitem__, t)) for t in core["vocab"]}
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        self.tokens = {i: raw[t] for t, i in core["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.byte_id = [core["vocab"][c] for c in byte_characters()]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(core["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[core["vocab"][a], core["vocab"][b]] = (rank, core["vocab"][a + b])
        inside = np.zeros(65536, bool)
        for t in raw.values():
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = True
        self.never = ~inside
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.cache: dict[bytes, bytes] = {}

    # splitting

    def cuts(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Byte positions at which a fragment begins. ``rows``: offsets of the texts, which are cuts too."""
        data = raw.tobytes()
        hard = np.zeros(len(raw) + 1, bool)
        hard[rows] = True
        spans = []
        for literal in self.special:
            at = data.find(literal)
            while at >= 0:
                spans.append((at, at + len(literal)))
                at = data.find(literal, at + len(literal))
        ends = np.searchsorted(rows, [a for a, _ in spans], "right")
        spans = [s for s, k in zip(spans, ends) if rows[k] >= s[1]]  # not over the border of two texts
        for a, b in spans:
            hard[[a, b]] = True
        ascii_only = not len(raw) or raw.max() < 128
        if ascii_only:
            place, code = None, raw
            first = hard[:-1]
        else:
            place = np.flatnonzero((raw & 0xC0) != 0x80)
            code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
            first = hard[place]
        starts = self._starts(code, first)
        cut = self._never(raw)
        cut[starts if place is None else place[starts]] = True
        cut |= hard[:-1]
        for a, b in spans:
            cut[a + 1:b] = False
        return np.flatnonzero(cut)

    def _never(self, raw: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw), bool)
        if len(raw) > 1:
            cut[1:] = self.never[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        return cut

    def _starts(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indices of characters that begin a piece of the splitting pattern; ``first`` begins a text."""
        n = len(code)
        if not n:
            return np.empty(0, np.int64)
        kind = self.classes[code]
        space = kind == SPACE
        start = first.copy()
        start[1:] |= kind[1:] != kind[:-1]
        start[1:] &= ~((code[:-1] == 32) & ~space[1:]) | first[1:]  # a blank before a word belongs to it
        last = np.zeros(n, bool)  # the last white space before a word stands apart from the others
        last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        start |= last
        for i in np.flatnonzero(start & (code == 39)):
            tail = []
            for j in range(i + 1, min(i + 3, n)):
                if first[j]:
                    break
                tail.append(chr(code[j]))
            word = "".join(tail)
            end = next((k for k in CONTRACTIONS if word.startswith(k)), "")
            if end:
                start[i + 1:i + 1 + len(end)] = False
                if i + 1 + len(end) < n:
                    start[i + 1 + len(end)] = True
        return np.flatnonzero(start)

    # merging

    def encode_fragment(self, fragment: bytes) -> bytes:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        if fragment in self.special:
            return np.array([self.special[fragment]], "<u4").tobytes()
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > 40:
            return self._merge_long(ids)
        merge = self.merge
        while len(ids) > 1:
            best, at, new = None, -1, -1
            for k in range(len(ids) - 1):
                m = merge.get((ids[k], ids[k + 1]))
                if m is not None and (best is None or m[0] < best):
                    best, at, new = m[0], k, m[1]
            if best is None:
                break
            ids[at:at + 2] = [new]
        return np.array(ids, "<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same with a heap over a linked list, for fragments of any length."""
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merge.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if m := merge.get((new, ids[after[k]])):
                    heapq.heappush(heap, (m[0], k, new, ids[after[k]], m[1]))
            if before[k] >= 0:
                p = before[k]
                if m := merge.get((ids[p], new)):
                    heapq.heappush(heap, (m[0], p, ids[p], new, m[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode(self, raw: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        at = self.cuts(raw, rows)
        data, cache = raw.tobytes(), self.cache
        edges = [*at.tolist(), len(raw)]
        parts = [data[a:b] for a, b in zip(edges, edges[1:])]
        if len(cache) > CACHE:
            cache.clear()
        get, coded = cache.get, []
        for p in parts:
            ids = get(p)
            if ids is None:
                ids = self.encode_fragment(p)
                if len(p) <= 64:
                    cache[p] = ids
            coded.append(ids)
        borders = np.searchsorted(at, rows).tolist()
        return [b"".join(coded[a:b]) for a, b in zip(borders, borders[1:])]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def codec(model: str, classes: bytes) -> Codec:
    key = hash(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, classes)
    return _CODECS[key]


def load(spark: SparkSession, path: str):
    """Read the vocabulary on the driver and send it to the workers; a vocabulary file is bounded (64 MB here)."""
    with open(path, encoding="utf-8") as f:
        model = f.read(64 << 20 | 1)
    if len(model) > 64 << 20:
        raise ValueError("the vocabulary file has more than 64 MB")
    return spark.sparkContext.broadcast((model, character_classes()))


def encode(docs: DataFrame, vocabulary, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``: the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    Null texts encode as empty. ``vocabulary`` comes from :func:`load`. A column
    named ``out`` is replaced. Rows, their order inside a partition and all other columns stay; nothing is shuffled.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary.value)
        for piece in pieces(batches, text, PIECE):
            ids = own.encode(*buffer_of(piece.column(text)))
            yield with_columns(piece, {out: pa.array(ids, pa.binary())})
    return docs.mapInArrow(run, schema_with(docs, f"`{out}` binary"))


def decode(coded: DataFrame, vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of packed ids. Null ids decode as empty; bytes that are no UTF-8 become U+FFFD."""
    coded = coded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocabulary.value)
        for piece in pieces(batches, ids, 4 * PIECE):
            texts = [own.decode(x or b"") for x in piece.column(ids).to_pylist()]
            yield with_columns(piece, {out: pa.array(texts, pa.string())})
    return coded.mapInArrow(run, schema_with(coded, f"`{out}` string"))


def digests(coded: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> dict:
    """Columns n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return {"n_tokens": F.shiftright(F.octet_length(ids), 2).cast("long"), "ids_sha256": F.sha2(F.col(ids), 256),
            "decoded_sha256": F.sha2(F.col(decoded).cast("binary"), 256)}
