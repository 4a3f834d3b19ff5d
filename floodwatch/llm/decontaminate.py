"""Benchmark decontamination with suffix arrays over shards of the training text.

The benchmark is the query side: it is cut into blocks of bounded size and each
block is sent to all tasks, one after another. The training text stays where it
is read: a shard is a piece of a partition, so nothing is shuffled. In a shard,

* words get numbers by the block's vocabulary (0: a word no item has);
* the suffix array holds the suffixes that begin with words some item has in
  this order, sorted by up to DEPTH words;
* every suffix of every item is binary-searched, which gives its longest
  verbatim match and the interval of suffixes that share it;
* an interval of a window's length or more marks the words of all its places.

Rows keep their place, so results of several blocks are joined without a key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, pieces, put_back, ranges_of, schema_with, set_aside, with_columns

#: Text bytes of the benchmark that are sent to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Words by which suffixes are sorted, at least a window; longer matches grow from there.
DEPTH = 64
MADE = ("n_words", "hit_words", "items", "longest")
MATCH = pa.struct([("words", pa.int32()), ("at", pa.int32()), ("item", pa.string())])


def _word_table() -> bytes:
    """A-Z to a-z; ASCII that is no letter or digit to a blank; other bytes as they are."""
    return bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


WORD_TABLE = _word_table()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Block:
    """Suffixes of some benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number, seqs, self.names = self.vocabulary, [], []
        for name, text in items:
            w = words_of(text)
            if w:
                self.names.append(name)
                seqs.append([number.setdefault(x, len(number) + 1) for x in w])
        sizes = np.array([len(s) for s in seqs], np.int64)
        self.depth = max(window, min(DEPTH, int(sizes.max()))) if len(sizes) else 0
        self.bits = max(1, len(number).bit_length())
        self.per_key = 62 // self.bits
        flat = np.array([i for s in seqs for i in s], np.int64)
        ends = np.cumsum(sizes)
        self.item = np.repeat(np.arange(len(seqs)), sizes)
        self.left = np.repeat(ends, sizes) - np.arange(len(flat))  # words from here to the item's end
        self.need = np.repeat(np.minimum(sizes, window), sizes)
        self.flat = flat  # a suffix is named by its place here
        # the first words of every window, for choosing the suffixes of a shard worth sorting
        self.heads = {}
        starts = self.left >= self.need
        for n in sorted(set(self.need.tolist())):
            k = min(n, self.per_key)
            rows = np.flatnonzero(starts & (self.need == n))
            key = np.zeros(len(rows), np.int64)
            for j in range(k):
                key = key << self.bits | flat[rows + j]
            self.heads[k] = np.unique(np.concatenate([self.heads.get(k, np.empty(0, np.int64)), key]))


def suffix_array(ids: np.ndarray, block: Block) -> np.ndarray:
    """Places of ``ids`` (ended by enough zeros) whose next words begin some window, sorted by up to ``depth`` words."""
    n = len(ids) - block.depth - block.per_key
    chosen = np.zeros(n, bool)
    for k, heads in block.heads.items():
        at = np.flatnonzero(ids[:n])
        key = np.zeros(len(at), np.int64)
        for j in range(k):  # the key grows word by word, and only places without a foreign word go on
            nxt = ids[at + j]
            keep = nxt > 0
            if not keep.all():
                at, key, nxt = at[keep], key[keep], nxt[keep]
            key = key << block.bits | nxt
            if j in (1, 3):
                known = np.unique(heads >> (block.bits * (k - 1 - j)))
                spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
                keep = known[spot] == key
                at, key = at[keep], key[keep]
        spot = np.minimum(np.searchsorted(heads, key), len(heads) - 1)
        chosen[at[heads[spot] == key]] = True
    places = np.flatnonzero(chosen)
    keys = []
    for base in range(0, block.depth, block.per_key):
        key = np.zeros(len(places), np.int64)
        for j in range(base, base + block.per_key):
            key = key << block.bits | (ids[places + j] if j < block.depth else 0)
        keys.append(key)
    return places[np.lexsort(keys[::-1])] if len(places) else places


def search(ids: np.ndarray, order: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every item suffix: the length of its longest match in the shard, up to the sorted depth, and the interval of ``order`` that has it.

    All suffixes are searched together, one word deeper per step; each step
    halves its way through the intervals that are left.
    """
    n = len(block.flat)
    low, high, length = np.zeros(n, np.int64), np.full(n, len(order), np.int64), np.zeros(n, np.int64)
    live = np.arange(n if len(order) else 0)
    for k in range(block.depth):
        live = live[block.left[live] > k]
        if not len(live):
            break
        want = block.flat[live + k]
        lo = _bound(ids, order, k, low[live], high[live], want, False)
        hi = _bound(ids, order, k, lo, high[live], want, True)
        found = hi > lo
        live = live[found]
        low[live], high[live], length[live] = lo[found], hi[found], k + 1
    return length, low, high


def _bound(ids, order, depth, lo, hi, want, after) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        seen = ids[order[mid] + depth]
        right = seen <= want[open_] if after else seen < want[open_]
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def extended(ids, block: Block, begins, row, at, doc, run) -> tuple[np.ndarray, ...]:
    """Matches that cannot grow to the left, grown to the right beyond the sorted depth."""
    before = np.maximum(row - 1, 0)
    inner = (row > 0) & (block.item[before] == block.item[row]) & (at > begins[doc]) & (ids[np.maximum(at - 1, 0)] == block.flat[before])
    row, at, doc, run = row[~inner], at[~inner], doc[~inner], run[~inner].copy()
    live = np.flatnonzero((run >= block.depth) & (block.left[row] > run))
    while len(live):
        live = live[ids[at[live] + run[live]] == block.flat[row[live] + run[live]]]
        run[live] += 1
        live = live[block.left[row[live]] > run[live]]
    return row, at, doc, run


def window_shard(texts: list[bytes], block: Block) -> tuple[list[int], list[list[int]], list[list[str]], list[dict | None]]:
    """Per text: its number of words, the numbers of the words hit, the items found, and the longest match."""
    get = block.vocabulary.get
    numbered, sizes = [], []
    for t in texts:
        w = [get(x, 0) for x in words_of(t)]
        w.append(0)  # no window reaches over the end of a text
        numbered += w
        sizes.append(len(w))
    ids = np.array(numbered + [0] * (block.depth + block.per_key), np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    order = suffix_array(ids, block)
    n = len(texts)
    places, items, longest = [np.empty(0, np.int64)] * n, [[] for _ in range(n)], [None] * n
    if len(order):
        length, low, high = search(ids, order, block)
        rows = np.flatnonzero((length >= block.need) & (block.left >= block.need))
        at = order[ranges_of(low[rows], high[rows] - low[rows])]
        row = np.repeat(rows, high[rows] - low[rows])
        doc = np.searchsorted(begins, at, "right") - 1
        row, at, doc, run = extended(ids, block, begins, row, at, doc, length[row])
        best = np.lexsort((row, at, -run, doc))  # the longest first, then the first place, then the first item
        for k in best[np.flatnonzero(np.diff(doc[best], prepend=-1))].tolist():
            d = int(doc[k])
            longest[d] = {"words": int(run[k]), "at": int(at[k] - begins[d]), "item": block.names[int(block.item[row[k]])]}
        for n_words in sorted(set(block.need.tolist())):
            rows = np.flatnonzero((block.need == n_words) & (block.left >= n_words) & (length >= n_words))
            if not len(rows):
                continue
            # the interval that shares the whole window, which the longest match may only be a part of
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order), np.int64)
            for k in range(n_words):
                want = block.flat[rows + k]
                lo = _bound(ids, order, k, lo, hi, want, False)
                hi = _bound(ids, order, k, lo, hi, want, True)
            times = hi - lo
            at = order[ranges_of(lo, times)]
            item = np.repeat(block.item[rows], times)
            doc = np.searchsorted(begins, at, "right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d
                first = np.unique(at[own] - begins[d])
                cover = (first[:, None] + np.arange(n_words)).ravel()
                places[d] = np.union1d(places[d], cover)
                items[d] += [block.names[i] for i in np.unique(item[own]).tolist()]
    return [s - 1 for s in sizes], [p.tolist() for p in places], [sorted(set(x)) for x in items], longest


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in bounded lists, read partition by partition."""
    own, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").distinct()
    for r in rows.toLocalIterator():
        t = r.t.encode()
        if own and size + len(t) > limit:
            yield own
            own, size = [], 0
        own.append((r.i if r.i is not None else "", t))
        size += len(t)
    if own:
        yield own


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                 window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, hit_words (numbers of the words inside any window's occurrence, from 0), items (ids as strings) and
    longest (the longest verbatim match of a window's length or more: its words, first word and item; else null).

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. A null text has no words. An empty benchmark
    matches nothing. Repeated items count once; items of one text and different
    ids are all named. Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop(*MADE)
    spark = docs.sparkSession
    out = docs.withColumns({"n_words": F.lit(None).cast("int"), "hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>"),
                            "longest": F.lit(None).cast("struct<words:int,at:int,item:string>")})
    schema = schema_with(docs, "`n_words` int, `hit_words` array<int>, `items` array<string>, `longest` struct<words:int,at:int,item:string>")
    for items in itertools.chain([[]], blocks_of(benchmark, item, item_text, block_bytes)):
        sent = spark.sparkContext.broadcast(items)
        out = out.mapInArrow(_step(sent, text, window), schema)
    return out


_BLOCKS: dict[int, Block] = {}


def _step(sent, text: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((window, tuple(sent.value)))
        if key not in _BLOCKS:
            if len(_BLOCKS) > 4:
                _BLOCKS.clear()
            _BLOCKS[key] = Block(sent.value, window)
        block = _BLOCKS[key]
        for piece in pieces(batches, text):
            raw, rows = buffer_of(piece.column(text))
            data = raw.tobytes()
            edges = rows.tolist()
            n, hits, items, longest = window_shard([data[a:b] for a, b in zip(edges, edges[1:])], block)
            hits = [sorted({*a, *b}) if a else b for a, b in zip(piece.column("hit_words").to_pylist(), hits)]
            items = [sorted({*a, *b}) if a else b for a, b in zip(piece.column("items").to_pylist(), items)]
            longest = [a if b is None or a is not None and (-a["words"], a["at"]) <= (-b["words"], b["at"]) else b for a, b in zip(piece.column("longest").to_pylist(), longest)]
            rest = piece.select([c for c in piece.schema.names if c not in MADE])
            yield with_columns(rest, {"n_words": pa.array(n, pa.int32()), "hit_words": pa.array(hits, pa.list_(pa.int32())),
                                      "items": pa.array(items, pa.list_(pa.string())), "longest": pa.array(longest, MATCH)})
    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Keep the rows of ``docs`` in which no window of the benchmark occurs; own columns of the names made on the way stay as they are."""
    columns = docs.columns
    docs, back = set_aside(docs, *MADE)
    return put_back(find_matches(docs, benchmark, **options).filter(F.size("hit_words") == 0).drop(*MADE), back).select(*columns)


def digests() -> dict:
    """Columns n_words, n_hit, n_items, items_sha256 and contaminated of :func:`find_matches`."""
    n_hit = F.size("hit_words").cast("long")
    return {"n_words": F.col("n_words").cast("long"), "n_hit": n_hit, "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256), "contaminated": n_hit > 0}
