"""Toxicity by the nearest labelled examples under TF-IDF cosine over all words.

1. A bounded sample of labelled rows (``per_class`` toxic and ``per_class``
   clean ones, in the order of a hash of doc_id) is joined to the documents; the
   first ``indexed`` of each class are the examples.
2. Every word counts: its weight is (1 + log count) * idf * class factor. The
   document frequencies are counted over all documents. The factor is
   1 + chi-square / CHI of the word's counts in the two classes of the sample, so
   a word that tells nothing keeps its plain TF-IDF; no word is left out.
   Words of the examples have exact counts. Any other word can meet no example
   and is only part of its text's length; its counts come from a table of
   OTHERS hashed entries.
3. The examples' unit vectors go into an inverted index cut into blocks. For
   each term and block the index keeps the largest weight, so a query bounds
   every block's best cosine and opens only blocks that can still reach its
   nearest neighbours. The search is exact: no block that could matter is skipped.
4. Neighbours vote with their cosine, together with a prior of the base rate;
   an isotonic fit on the sample (each row without itself) makes the vote a
   probability.

Only the text is an input of a score. The index is bounded by the sample, so it
is sent to all tasks; documents are read where they are and never shuffled.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, cut, pieces, ranges_of, schema_with, with_columns
from .decontaminate import words_of

#: Hashed entries for words that no example has.
OTHERS = 1 << 20
#: Chi-square that doubles a word's weight.
CHI = 16.0
#: Weight of the base rate beside the neighbours' votes.
PRIOR = 0.05
EVIDENCE = 3


def held_out(doc_id: str, parts: int = 5, part: int = 0) -> Column:
    """Rows whose crc32(doc_id as text) mod ``parts`` is ``part``: not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


class Index:
    """Unit vectors of labelled examples in blocks, with block maxima.

    ``weights`` has one entry for each of ``terms`` and OTHERS more for all other words.
    """

    def __init__(self, terms: dict[bytes, int], weights: np.ndarray, names: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]],
                 rate: float, neighbours: int = 25, block: int = 64):
        self.terms, self.weights, self.idf, self.rate, self.k, self.block = terms, weights, weights[:len(terms)], rate, neighbours, block
        unit = [self.unit(i, n) for i, n in vectors]
        keep = [j for j, (i, _) in enumerate(unit) if len(i)]
        keep.sort(key=lambda j: (int(unit[j][0][np.argmax(unit[j][1])]), bool(labels[j])))  # like beside like: tighter maxima
        self.names, self.labels = [names[j] for j in keep], labels[keep]
        self.place = {n: j for j, n in enumerate(self.names)}
        unit = [unit[j] for j in keep]
        self.n = len(unit)
        self.blocks = (self.n + block - 1) // block
        term = np.concatenate([i for i, _ in unit]) if unit else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in unit]) if unit else np.empty(0)
        owner = np.repeat(np.arange(self.n), [len(i) for i, _ in unit]) if unit else np.empty(0, np.int64)
        place = owner // block
        # postings by block, then by term; a run is the postings of one term in one block
        order = np.lexsort((owner, term, place))
        term, place = term[order], place[order]
        self.post_term, self.post_weight, self.post_owner = term, weight[order], owner[order] - place * block
        self.begin = np.searchsorted(place, np.arange(self.blocks + 1))
        runs = np.flatnonzero(np.diff(place * max(1, len(terms)) + term, prepend=-1))
        top = np.maximum.reduceat(self.post_weight, runs) if len(runs) else np.empty(0)
        size = np.diff(np.append(runs, len(term)))
        by_term = np.argsort(term[runs], kind="stable")
        self.run, self.run_size, self.run_top, self.run_block = runs[by_term], size[by_term], top[by_term], place[runs][by_term]
        self.run_at = np.searchsorted(term[runs][by_term], np.arange(len(terms) + 1))
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def unit(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text and their weights in its unit vector, of which other words are a part."""
        w = (1 + np.log(counts)) * self.weights[ids]
        norm = np.sqrt((w * w).sum())
        known = ids < len(self.idf)
        return (ids[known], w[known] / norm) if norm > 0 else (ids[:0], w[:0])

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.unit(*counts_of(self.terms, text))

    def nearest(self, ids: np.ndarray, weights: np.ndarray, without=None) -> tuple[np.ndarray, np.ndarray]:
        """Examples of the largest positive cosine, best first; of equal ones the first in the index."""
        best, score = np.empty(0, np.int64), np.empty(0)
        if not len(ids) or not self.n:
            return best, score
        times = self.run_at[ids + 1] - self.run_at[ids]
        runs, weight = ranges_of(self.run_at[ids], times), np.repeat(weights, times)
        block = self.run_block[runs]
        bound = np.bincount(block, self.run_top[runs] * weight, self.blocks)
        waiting = bound > 0
        opened = np.zeros(self.blocks, bool)
        opened[np.argsort(-bound, kind="stable")[:max(4, self.blocks // 4)]] = True  # these give the score to reach
        opened &= waiting
        dots = np.zeros(self.n)
        while opened.any():
            own = opened[block]
            r, size = runs[own], self.run_size[runs[own]]
            at = ranges_of(self.run[r], size)
            dots += np.bincount(self.post_owner[at] + np.repeat(block[own] * self.block, size), self.post_weight[at] * np.repeat(weight[own], size), self.n)
            if without in self.place:
                dots[self.place[without]] = 0
            waiting &= ~opened
            least = np.partition(dots, -self.k)[-self.k] if self.n > self.k else 0.0
            opened = waiting & (bound >= least - 1e-9)
        hit = np.flatnonzero((dots > 0) & (dots >= least - 1e-9))
        score = np.round(dots[hit], 12)
        order = np.lexsort((hit, -score))[:self.k]
        hit, score = hit[order], score[order]
        return hit[score > 0], score[score > 0]

    def vote(self, best: np.ndarray, score: np.ndarray) -> float:
        return float((score @ self.labels[best] + PRIOR * self.rate) / (score.sum() + PRIOR)) if len(best) else self.rate * 0.5

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Isotonic regression (pool adjacent violators) of the labels on the votes, with a little smoothing."""
        pools: list[list[float]] = []
        for v in np.unique(votes):
            own = votes == v
            pools.append([v, (labels[own] * weights[own]).sum(), weights[own].sum(), v])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                _, a, n, hi = pools.pop()
                pools[-1][1] += a
                pools[-1][2] += n
                pools[-1][3] = hi
        x, y = [], []
        for lo, a, n, hi in pools:
            p = (a + 0.5 * self.rate) / (n + 0.5)
            x += [lo, hi + 1e-12]
            y += [p, p]
        if x:
            self.knots = (np.array(x), np.maximum.accumulate(np.array(y)))

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.knots), 0.0, 1.0))


def lower_words(text: bytes) -> list[bytes]:
    return words_of(text if text.isascii() else text.decode("utf-8", "replace").lower().encode())


def counts_of(terms: dict[bytes, int], text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's distinct words, those of other words hashed beyond the terms, and how often each occurs."""
    found = Counter(lower_words(text))
    return numbers_of(terms, found), np.fromiter(found.values(), np.float64, len(found))


def numbers_of(terms: dict[bytes, int], words) -> np.ndarray:
    ids = np.array([terms.get(w, -1) for w in words], np.int64)
    other = np.flatnonzero(ids < 0)
    if len(other):
        ids[other] = [zlib.crc32(w) for w, i in zip(words, ids.tolist()) if i < 0]
        ids[other] = len(terms) + (ids[other] & (OTHERS - 1))
    return ids


def count_rows(df: DataFrame, terms, classes: int) -> np.ndarray:
    """Rows that have a word, by class (column _label, if classes are two) and number; the last number counts all rows."""
    width = len(terms.value) + OTHERS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * width, np.int64)
        for piece in pieces(batches, "_text"):
            seen = [Counter() for _ in range(classes)]
            for t, y in zip(texts_of(piece, "_text"), piece.column("_label").to_pylist() if classes > 1 else [0] * piece.num_rows):
                seen[y].update(set(lower_words(t)))
                total[(y + 1) * width - 1] += 1
            for y, words in enumerate(seen):
                np.add.at(total, y * width + numbers_of(terms.value, words), np.fromiter(words.values(), np.int64, len(words)))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[k:k + 50_000]), pa.array(total[at[k:k + 50_000]])], names=["at", "n"])
    got = df.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most one row a number
    out = np.zeros(classes * width)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, width)


def class_factor(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 + chi-square / CHI of every word but the last entry, which counts the rows."""
    a, b, rows_a, rows_b = toxic[:-1], clean[:-1], toxic[-1], clean[-1]
    below = (a + b) * (rows_a + rows_b - a - b) * max(1.0, rows_a * rows_b)
    return 1 + np.divide((rows_a + rows_b) * (a * (rows_b - b) - b * (rows_a - a)) ** 2, below, out=np.zeros(len(a)), where=below > 0) / CHI


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", learnable: Column | None = None,
          per_class: int = 4000, indexed: int = 1000, neighbours: int = 25):
    """Fit the index; returns a broadcast :class:`Index`.

    ``learnable`` is a condition on ``labels`` rows. Labels of a row that is
    labelled twice count by their largest value; null labels and ids are no
    labels. Of several texts of one id the first in order is the example. Without any toxic or any clean label every score is the base rate.
    """
    spark = docs.sparkSession
    rows = (labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")) if learnable is None else
            labels.filter(learnable).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")))
    rows = rows.filter("_id is not null and _label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    ahead = [F.xxhash64("_id"), F.col("_id")]
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    sample = (rows.filter("_label = 1").orderBy(*ahead).limit(per_class)).unionByName(rows.filter("_label = 0").orderBy(*ahead).limit(per_class))
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    own = cut(own.join(F.broadcast(sample), "_id"), "labelled")  # at most 2 * per_class ids are broadcast

    ids = [(r["_id"], r["_label"]) for r in own.select("_id", "_label").distinct().orderBy(*ahead).collect()]
    examples = [i for y in (1, 0) for i in [i for i, label_ in ids if label_ == y][:indexed]]
    sampled = [i for y in (1, 0) for i in [i for i, label_ in ids if label_ == y][:2 * indexed]]  # these calibrate
    kind = own.schema["_id"].dataType
    chosen = spark.createDataFrame([(i, i in some) for some in [set(examples)] for i in sampled], f"_id {kind.simpleString()}, _example boolean")
    # an id with several texts is taken with the first of them in order, so that every run takes the same
    own_chosen = own.join(F.broadcast(chosen), "_id").groupBy("_id", "_example").agg(F.max("_label").alias("_label"), F.min("_text").alias("_text"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array(set().union(*map(lower_words, texts_of(piece, "_text"))), pa.binary())], names=["term"])
    own_chosen = cut(own_chosen, "chosen")
    words = own_chosen.filter("_example").select("_text").mapInArrow(distinct_words, "term binary").distinct().toArrow().column("term").to_pylist()
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted(words))})
    clean, toxic = count_rows(own.select("_text", "_label"), number, 2)
    df = count_rows(docs.select(F.col(text).cast("string").alias("_text")), number, 1)[0]
    weights = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1e-3) * class_factor(clean, toxic)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            found = [counts_of(number.value, t) for t in texts_of(piece, "_text")]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_label"), pa.array([i.tobytes() for i, _ in found], pa.binary()),
                                              pa.array([n.tobytes() for _, n in found], pa.binary())], names=["_id", "_label", "ids", "counts"])
    coded = own_chosen.select("_id", "_label", "_text").mapInArrow(vectors, f"_id {kind.simpleString()}, _label int, ids binary, counts binary")
    got = {r["_id"]: (r["_label"], (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["counts"]))) for r in coded.collect()}  # a row for each that calibrates
    y = np.array([got[i][0] for i in sampled], np.float64)
    toxic, clean = int((y == 1).sum()), int((y == 0).sum())
    index = Index(number.value, weights, examples, np.array([got[i][0] for i in examples], np.float64), [got[i][1] for i in examples], rate, neighbours)
    votes = np.array([index.vote(*index.nearest(*index.unit(*got[i][1]), i)) for i in sampled])
    share = np.where(y == 1, rate / max(1, toxic), (1 - rate) / max(1, clean)) * len(y) if len(y) else y
    if toxic and clean:
        index.calibrate(votes, y, share)
    else:
        index.knots = (np.array([0.0, 1.0]), np.array([rate, rate]))
    return spark.sparkContext.broadcast(index)


def texts_of(piece: pa.RecordBatch, text: str) -> list[bytes]:
    raw, rows = buffer_of(piece.column(text))
    data, edges = raw.tobytes(), rows.tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def score(docs: DataFrame, index, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add score (0 to 1), predicted (1 from 0.5 on) and evidence (nearest examples: doc_id as text, label, similarity).

    Null and empty texts, and texts without any word of an example, have no neighbours:
    their score is that of rows like them in the sample. Columns of these names are replaced.
    """
    docs = docs.drop("score", "predicted", "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for piece in pieces(batches, text):
            scores, evidence = [], []
            for t in texts_of(piece, text):
                best, near = own.nearest(*own.vector(t))
                scores.append(own.score(own.vote(best, near)))
                evidence.append([{"doc_id": str(own.names[i]), "label": int(own.labels[i]), "similarity": float(s)} for i, s in zip(best[:EVIDENCE], near)])
            kind = pa.list_(pa.struct([("doc_id", pa.string()), ("label", pa.int32()), ("similarity", pa.float64())]))
            yield with_columns(piece, {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                                       "evidence": pa.array(evidence, kind)})
    return docs.mapInArrow(run, schema_with(docs, "score double, predicted int, evidence array<struct<doc_id:string,label:int,similarity:double>>"))
