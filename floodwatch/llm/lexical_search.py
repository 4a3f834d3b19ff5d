"""Ranked lexical search by branch and bound over FP-trees of documents.

The items are the queries. A document is the vector of its terms that some item
has, with counts, sorted by how many documents hold each term, the commonest
first. Vectors with the same beginning share a path of a prefix tree, one tree
per shard; a shard is a bounded stretch of a partition, so documents never move.
Documents are laid out in the order of their paths: a node's documents are an
interval, and a term's nodes are disjoint intervals in this order.

A node knows the largest count of its term and the smallest length norm m below
it, so what its term adds to any document below is bounded. For an item only the
nodes of its terms count. Each gets the largest sum of such bounds on a way down
from it; the search goes depth-first, best subtree first, skips every subtree
whose bound is under the item's k-th score so far, and scores the documents it
meets exactly. An item's k-th score goes with it from shard to shard of a task.

Every task returns at most k documents per item; a salted and then a last top-k
leave k. The only things sent to tasks are one block of items of bounded size
and its terms' weights; a larger item table takes several passes.

Rows, as defined here: a null text has no terms; documents without a term count
nowhere, items without one return nothing. Every row is a document, so repeated
rows are ranked next to each other; a null doc_id comes before all others.
Repeated items count once; two texts of one item id are two items. A very long
text is one vector. All other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import buffer_of, cut, pieces, ranges_of
from .decontaminate import words_of

#: Bytes of item text that are sent to the tasks at once.
BLOCK_BYTES = 4 << 20
#: Term counts (documents x distinct terms) in one tree; one document may have more.
SHARD_COUNTS = 1 << 20
#: Subtrees taken from the stack at a time.
STRIDE = 64
#: Parts of an item's candidates before the last top-k.
SALTS = 64
NO_ID = np.iinfo(np.int64).min


def blocks_of(items: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """(item, text) pairs, each once, in lists of bounded text."""
    own, size = [], 0
    for row in items.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").distinct().toLocalIterator():
        if own and size + len(row.t) > limit:
            yield own
            own, size = [], 0
        own.append((row.i, row.t))
        size += len(row.t)
    if own:
        yield own


def numbered(block: list[tuple]) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of the block's terms, and each item's terms with their repeats."""
    number: dict[bytes, int] = {}
    rows = [np.unique(np.array([number.setdefault(w, len(number)) for w in words_of(t.encode())], np.int64), return_counts=True) for _, t in block]
    return number, rows


def vectors(docs: DataFrame, sent, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a text are counted in n; those of the block are listed, as packed numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for piece in pieces(batches, "text"):
            raw, rows = buffer_of(piece.column("text"))
            data, edges = raw.tobytes(), rows.tolist()
            size, terms, counts = [], [], []
            for a, b in zip(edges, edges[1:]):
                w = words_of(data[a:b])
                found = np.fromiter((number[x] for x in w if x in number), np.int64)
                own, times = np.unique(found, return_counts=True)
                size.append(len(w))
                terms.append(own.astype("<i4").tobytes())
                counts.append(times.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "n", "terms", "counts"])
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, terms binary, counts binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(buffer_of(batch.column("terms"))[0].view("<i4"), minlength=size)
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(total[terms])], names=["term", "df"])
    rows = found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return df


@dataclass
class Queries:
    """A block of items over terms ranked by document frequency (0: the commonest)."""

    rank: np.ndarray                            # of each term number
    terms: list[np.ndarray]                     # an item's ranks, ascending
    weights: list[np.ndarray]                   # their repeats times w
    n_docs: int
    n_terms: int


def queries_of(rows: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int, n_terms: int) -> Queries:
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[order] = np.arange(len(df))
    w = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    terms, weights = [], []
    for own, times in rows:
        own, times = own[df[own] > 0], times[df[own] > 0]
        by = np.argsort(rank[own])
        terms.append(rank[own][by])
        weights.append((times * w[own])[by])
    return Queries(rank, terms, weights, n_docs, n_terms)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds per weight: grows with its count, shrinks with the document's m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """FP-tree of a shard: per node its term, interval of documents, largest count and smallest m; documents in path order."""

    def __init__(self, n_terms: int, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray):
        by = np.lexsort((term, doc))
        doc, term, tf = doc[by], term[by], tf[by]
        length = np.bincount(doc, minlength=len(m))
        start = np.cumsum(length) - length
        at = np.full(len(m), -1)                # node each document has come to
        alive, level = np.flatnonzero(length), 0
        parts, ends, low = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
        size_above, base, above = np.array([len(m)]), 0, 0
        while len(alive):
            here = start[alive] + level
            key, node = np.unique((at[alive] - above if level else np.zeros(len(alive), np.int64)) * n_terms + term[here], return_inverse=True)
            parent = key // n_terms
            size = np.bincount(node)
            most, least = np.zeros(len(key), np.int64), np.full(len(key), np.iinfo(np.int64).max)
            np.maximum.at(most, node, tf[here])
            np.minimum.at(least, node, m[alive])
            below = np.bincount(parent, size, len(size_above)).astype(np.int64)
            ends = size_above - below           # documents whose path stops at the parent come first
            offset = np.cumsum(size) - size
            first = np.searchsorted(parent, parent)
            lo = low[parent] + ends[parent] + offset - offset[first]
            parts.append((key % n_terms, lo, lo + size, most, least))
            at[alive] = base + node
            above, low, size_above = base, lo, size
            base += len(key)
            level += 1
            alive = alive[length[alive] > level]
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 5
        place = np.where(at >= 0, columns[1][at], -1) if len(columns[1]) else at
        self.order = np.argsort(place, kind="stable")   # documents by path; those without a term first
        by = np.lexsort((columns[1], columns[0]))
        self.term, self.lo, self.hi, self.most, self.least = (c[by] for c in columns)
        self.header = np.searchsorted(self.term, np.arange(n_terms + 1))
        self.m = m[self.order]
        length = length[self.order]
        take = ranges_of(start[self.order], length)
        self.doc_term, self.doc_tf = term[take], tf[take]
        self.doc_start = np.append(0, np.cumsum(length))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of documents (in path order), ``weight`` by term."""
        length = self.doc_start[docs + 1] - self.doc_start[docs]
        take = ranges_of(self.doc_start[docs], length)
        owner = np.repeat(np.arange(len(docs)), length)
        w = weight[self.doc_term[take]]
        used = np.flatnonzero(w)
        take, owner = take[used], owner[used]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner, w[used] * gain(self.doc_tf[take], self.m[docs[owner]]))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, weight: np.ndarray) -> None:
        """Bring the best documents of one item into ``best``; ``weight`` holds the item's weights by term."""
        spans = [(self.header[t], self.header[t + 1], w) for t, w in zip(terms.tolist(), weights.tolist()) if self.header[t] < self.header[t + 1]]
        if not spans:
            return
        take = np.concatenate([np.arange(a, b) for a, b, _ in spans])
        edge = np.cumsum([0, *(b - a for a, b, _ in spans)])
        own = np.repeat(np.array([w for *_, w in spans]), np.diff(edge)) * gain(self.most[take], self.least[take])
        lo, hi = self.lo[take], self.hi[take]
        # the nearest node of the item above each node, and above each document
        parent, cover, path = np.empty(len(take), np.int64), np.full(len(self.m), -1), np.empty(len(take), np.int64)
        for a, b in zip(edge, edge[1:]):
            parent[a:b] = cover[lo[a:b]]
            path[a:b] = own[a:b] + np.where(parent[a:b] >= 0, path[parent[a:b]], 0)
            size = hi[a:b] - lo[a:b]
            cover[ranges_of(lo[a:b], size)] = np.repeat(np.arange(a, b), size)
        bound = path.copy()                      # of the best document in the subtree
        for a, b in zip(edge[-2::-1], edge[:0:-1]):
            inner = parent[a:b] >= 0
            np.maximum.at(bound, parent[a:b][inner], bound[a:b][inner])
        kids = np.lexsort((bound, parent))       # a node's children, the best last: it is on top of the stack
        first = np.searchsorted(parent[kids], np.arange(-1, len(take) + 1))
        held = np.argsort(cover, kind="stable")  # documents by the last item node on their path
        from_ = np.searchsorted(cover[held], np.arange(len(take) + 1))
        stack = kids[first[0]:first[1]]
        while len(stack):
            nodes, stack = stack[-STRIDE:], stack[:-STRIDE]
            nodes = nodes[bound[nodes] >= best.least()]
            leaf = nodes[path[nodes] >= best.least()]
            docs = held[ranges_of(from_[leaf], from_[leaf + 1] - from_[leaf])]
            if len(docs):
                best.add(self.scores(docs, weight), ids[docs])
            below = kids[ranges_of(first[nodes + 1], first[nodes + 2] - first[nodes + 1])]
            stack = np.concatenate([stack, below[bound[below] >= best.least()]])


class Best:
    """The k best (score, doc_id) so far: the higher score first, then the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def least(self) -> int:
        """A document under this score cannot come in."""
        return max(1, int(self.score[-1])) if len(self.score) >= self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.least()
        score, ids = np.concatenate([self.score, score[keep]]), np.concatenate([self.ids, ids[keep]])
        by = np.lexsort((ids, -score))[:self.k]
        self.score, self.ids = score[by], ids[by]


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Batches of vectors joined up to ``limit`` counts."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += int(buffer_of(batch.column("terms"))[1][-1]) // 4
        if size >= limit:
            yield pa.Table.from_batches(own)
            own, size = [], 0
    if own:
        yield pa.Table.from_batches(own)


def search_shards(batches: Iterator[pa.RecordBatch], q: Queries, k: int, limit: int) -> list[Best]:
    best = [Best(k) for _ in q.terms]
    weight = np.zeros(len(q.rank), np.int64)
    for table in shards(batches, limit):
        flat, edges = buffer_of(table["terms"])
        tf = buffer_of(table["counts"])[0].view("<i4").astype(np.int64)
        doc = np.repeat(np.arange(table.num_rows), np.diff(edges) // 4)
        m = 25 + (75 * table["n"].to_numpy() * q.n_docs) // max(q.n_terms, 1)
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        tree = Tree(len(q.rank), doc, q.rank[flat.view("<i4")], tf, m)
        ids = ids[tree.order]
        for terms, weights, own in zip(q.terms, q.weights, best):
            weight[terms] = weights
            tree.search(terms, weights, own, ids, weight)
            weight[terms] = 0
    return best


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", *,
         k: int = 10, block_bytes: int = BLOCK_BYTES, shard_counts: int = SHARD_COUNTS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: (item, rank, doc_id, score). ``doc_id`` is read as long."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    schema = f"no long, i {kind.simpleString()}, doc_id long, score long"
    found = [spark.createDataFrame([], schema)]
    for number, block in enumerate(blocks_of(items, item, item_text, block_bytes)):
        vocabulary, rows = numbered(block)
        if not vocabulary:
            continue
        own = cut(vectors(docs, spark.sparkContext.broadcast(vocabulary), doc_id, text), "vectors")
        total = own.filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        queries = queries_of(rows, document_frequencies(own, len(vocabulary)), total.docs, total.terms)
        found.append(own.mapInArrow(_search(spark.sparkContext.broadcast((queries, pa.array([i for i, _ in block], to_arrow_type(kind)))), number, k, shard_counts), schema))
    every = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("no", "salt").orderBy(*order))).filter(F.col("rank") <= k)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).filter(F.col("rank") <= k)
    return last.select(F.col("i").alias(item), "rank", "doc_id", "score")


def _search(sent, number: int, k: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = sent.value
        best = search_shards(batches, queries, k, limit)
        size = np.array([len(b.ids) for b in best])
        no = np.repeat(np.arange(len(best)), size)
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(no + (number << 32)), names.take(pa.array(no)), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([b.score for b in best]))],
                                         names=["no", "i", "doc_id", "score"])
    return run
