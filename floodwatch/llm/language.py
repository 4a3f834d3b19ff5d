"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
A text is scored by the sum over all ways to write it as pieces of the product
of their probabilities, found by the forward algorithm; Bayes' rule over the
languages gives the posterior, which is the score.

Text is lower-cased and its white space read as single blanks, one before every
word. No piece holds a blank behind another byte, so every segmentation cuts
before each blank: the sum over a text's segmentations is the product of its
words' sums. A word's sum is therefore computed once for all its occurrences,
and the result is still exact.

The probabilities come from expectation-maximisation over all learnable rows:
words are counted per language before they are shuffled, and each round sums
posterior piece counts, in whole numbers of 2**-16, so that the model does not
depend on the order of tasks. What reaches the driver is languages x pieces.

Rows, as defined here: a null text, or one without a letter, is ``und`` with
score 0; so is every row if nothing could be learned. Ties go to the language
first in the alphabet. Repeated rows count once each and get equal results. A
word of any length is scored whole. An own column of an output's name is
replaced; others are kept, whatever their names. Empty tables give empty ones.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pieces, schema_with, with_columns

#: Bytes of distinct words that are worked on together.
WORD_BYTES = 1 << 19
#: Distinct words whose sums a Python worker keeps.
KEPT_WORDS = 200_000
#: Posterior counts are added in units of this.
UNIT = 2.0 ** -16
LETTER = regex.compile(r"\p{L}")
MADE = ("lang_pred", "score")


class Vocabulary:
    """Byte pieces as a prefix tree in sorted arrays."""

    def __init__(self, parts: list[bytes]):
        if {bytes([b]) for b in range(256)} - set(parts):
            raise ValueError("every single byte must be a piece")
        if any(regex.search(rb"[^\s] ", p) for p in parts):
            raise ValueError("a piece may hold a blank only behind white space")
        self.size, self.lengths = len(parts), np.array([len(p) for p in parts])
        state, edges, self.piece = {b"": 0}, [], [-1]
        for number, part in enumerate(parts):
            for k in range(1, len(part) + 1):
                if part[:k] not in state:
                    state[part[:k]] = len(self.piece)
                    edges.append((state[part[:k - 1]] << 8 | part[k - 1], len(self.piece)))
                    self.piece.append(-1)
            self.piece[state[part]] = number
        edges.sort()
        self.keys, self.next = (np.array(x, np.int64) for x in zip(*edges))
        self.piece = np.array(self.piece, np.int64)
        self.first = np.array([state[bytes([b])] for b in range(256)])

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces inside words, as (word, first byte, bytes, piece)."""
        word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        end = offsets[1:][word]
        at = np.arange(len(raw))
        state, length = self.first[raw], 1
        found = []
        while len(at):
            piece = self.piece[state]
            hit = np.flatnonzero(piece >= 0)
            found.append((word[at[hit]], at[hit], np.full(len(hit), length), piece[hit]))
            more = np.flatnonzero(at + length < end[at])
            at = at[more]
            key = state[more] << 8 | raw[at + length]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[spot] == key)
            at, state, length = at[known], self.next[spot[known]], length + 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def load(path: str) -> list[bytes]:
    """Pieces of a file with one base64 piece and its number a line; the path is a parameter, as the file is not ours."""
    with open(path, "rb") as lines:
        rows = [line.split() for line in lines if line.strip()]
    return [base64.b64decode(piece) for piece, _ in sorted(rows, key=lambda r: int(r[1]))]


class Lattice:
    """The pieces of some words as edges between nodes; node p + w stands before byte p of word w, and each word has one more at its end."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        word, at, length, piece = vocabulary.matches(np.frombuffer(b"".join(words), np.uint8), self.offsets)
        self.nodes = self.offsets + np.arange(len(self.offsets))
        end = at + word + length
        order = self._order(end, end - self.nodes[word])
        self.word, self.length, self.piece, self.end = word[order], length[order], piece[order], end[order]
        self.begin = self.end - self.length

    def _order(self, into: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.argsort(depth * self.nodes[-1] + into, kind="stable")

    def sums(self, weight: np.ndarray, log: bool, backward: bool = False) -> np.ndarray:
        """At every node the sum over all ways from the word's start to it (``backward``: from it to the word's end) of the product of their weights.

        ``weight`` has one column or several. With ``log`` all numbers are logarithms. All words go one node further at a step.
        """
        into, out_of = (self.begin, self.end) if backward else (self.end, self.begin)
        edge = self.nodes[1:] - 1 if backward else self.nodes[:-1]
        depth = np.abs(into - edge[self.word])
        total = np.full((self.nodes[-1], *weight.shape[1:]), -np.inf if log else 0.0)
        total[edge] = 0.0 if log else 1.0
        if backward:
            order = self._order(into, depth)
            into, out_of, depth, weight = into[order], out_of[order], depth[order], weight[order]
        groups = np.flatnonzero(np.diff(into, prepend=-1))  # a node's edges lie together
        steps = np.flatnonzero(np.diff(depth[groups], prepend=0))
        bounds = np.append(groups, len(into))
        for a, b in zip(steps, np.append(steps[1:], len(groups))):
            lo, hi = bounds[a], bounds[b]
            before = total[out_of[lo:hi]]
            total[into[groups[a:b]]] = (np.logaddexp.reduceat(before + weight[lo:hi], groups[a:b] - lo, axis=0) if log
                                        else np.add.reduceat(before * weight[lo:hi], groups[a:b] - lo, axis=0))
        return total


#: Products of probabilities are taken times this for each byte, which keeps those of words of up to LONG bytes near one.
PER_BYTE = 64.0
LONG = 64
#: A sum below this may have lost digits and is taken again in logarithms, as those of longer words are.
TINY = 1e-250


def lattices(words: list[str], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, Lattice, bool]]:
    """Numbers of words, their lattice, and whether they are long; bounded bytes, or one word, at a time."""
    coded = [b" " + w.encode() for w in words]
    size = np.array([len(w) for w in coded], np.int64)
    for log in (False, True):
        which = np.flatnonzero((size > LONG) == log)
        ends, a = np.cumsum(size[which]), 0
        while a < len(which):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORD_BYTES, "right")))
            yield which[a:b], Lattice([coded[k] for k in which[a:b]], vocabulary), log
            a = b


def word_scores(words: list[str], vocabulary: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word under each language (``logp``: pieces x languages)."""
    out = np.empty((len(words), logp.shape[1]))
    scaled = np.exp(logp) * PER_BYTE ** vocabulary.lengths[:, None]
    for which, lattice, log in lattices(words, vocabulary):
        if log:
            out[which] = lattice.sums(logp[lattice.piece], True)[lattice.nodes[1:] - 1]
            continue
        total = lattice.sums(scaled[lattice.piece], False)[lattice.nodes[1:] - 1]
        with np.errstate(divide="ignore"):
            out[which] = np.log(total) - np.diff(lattice.offsets)[:, None] * np.log(PER_BYTE)
        for k in which[(total < TINY).any(1)].tolist():
            own = Lattice([b" " + words[k].encode()], vocabulary)
            out[k] = own.sums(logp[own.piece], True)[-1]
    return out


def shares(lattice: Lattice, logp: np.ndarray, log: bool) -> np.ndarray:
    """Posterior of every edge of the lattice: the part of its word's sum that runs over it. ``logp`` is the edges'."""
    last = lattice.nodes[:-1][lattice.word]
    if log:
        ahead, behind = lattice.sums(logp, True), lattice.sums(logp, True, backward=True)
        return np.exp(ahead[lattice.begin] + logp + behind[lattice.end] - behind[last])
    weight = np.exp(logp) * PER_BYTE ** lattice.length
    ahead, behind = lattice.sums(weight, False), lattice.sums(weight, False, backward=True)
    return ahead[lattice.begin] * weight * behind[lattice.end] / np.maximum(behind[last], TINY)


def expected(words: list[str], times: np.ndarray, lang: np.ndarray, vocabulary: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Posterior counts of every piece in every language, in units, for words seen so many times in one language each."""
    counts = np.zeros(logp.shape[1] * vocabulary.size)

    def add(which: np.ndarray, lattice: Lattice, log: bool) -> None:
        own = lang[which][lattice.word]
        share = shares(lattice, logp[lattice.piece, own], log)
        if not log:                              # the pieces of a sum that was too small do not fill their word
            size = np.diff(lattice.offsets)
            poor = ~(np.abs(np.bincount(lattice.word, share * lattice.length, len(size)) - size) < 1e-6 * size)
            share[poor[lattice.word]] = 0.0
            for k in which[poor].tolist():
                add(np.array([k]), Lattice([b" " + words[k].encode()], vocabulary), True)
        counts[:] += np.bincount(own * vocabulary.size + lattice.piece, np.rint(share * times[which][lattice.word] / UNIT), len(counts))
    for which, lattice, log in lattices(words, vocabulary):
        add(which, lattice, log)
    return counts.reshape(logp.shape[1], vocabulary.size)


@dataclass
class Model:
    langs: list[str]
    parts: list[bytes]
    logp: np.ndarray  # pieces x languages
    prior: np.ndarray


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) over all rows; rows of a task are counted before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            seen: dict[str, Counter] = {}
            for name, t in zip(piece.column(lang).to_pylist(), piece.column(text).to_pylist()):
                seen.setdefault(name, Counter()).update(words_of(t))
            for name, counts in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(counts)), pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
    return docs.select(lang, text).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, parts: list[bytes], learnable: Column, text: str = "text", lang: str = "lang", *, rounds: int = 3,
          smoothing: float = 200.0) -> Model:
    """Fit piece probabilities on all rows that are learnable and have a text and a language.

    ``smoothing`` pieces of every language are taken to follow the pieces of all
    languages together, where each piece counts once more than seen.
    """
    spark: SparkSession = docs.sparkSession
    taken = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), learnable.alias("use")).filter("use and lang is not null and text is not null")
    shares = {r.lang: r.n for r in taken.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(shares)
    if not langs:
        return Model([], parts, np.zeros((len(parts), 0)), np.zeros(0))
    counted = cut(word_counts(taken, "text", "lang"), "words")
    logp = np.full((len(parts), len(langs)), -np.log(len(parts)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((langs, parts, logp))
        found = counted.mapInArrow(_round(sent), "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(langs), len(parts)))
        counts[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy() * UNIT
        pooled = counts.sum(0) + 1.0
        p = (counts + smoothing * pooled / pooled.sum()) / (counts.sum(1, keepdims=True) + smoothing)
        logp = np.log(p).T.copy()
        sent.unpersist()
    prior = np.log(np.array([shares[x] for x in langs], float) / sum(shares.values()))
    return Model(langs, parts, logp, prior)


def _round(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, parts, logp = sent.value
        vocabulary = vocabulary_of(parts)
        number = {x: k for k, x in enumerate(langs)}
        total = np.zeros((len(langs), len(parts)))

        def add(rows: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(rows)
            own = np.array([number[x] for x in table["lang"].to_pylist()])
            total[:] += expected(table["word"].to_pylist(), table["n"].to_numpy(), own, vocabulary, logp)
        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.nbytes
            if size > 8 * WORD_BYTES:
                add(rows)
                rows, size = [], 0
        if rows:
            add(rows)
        lang, piece = np.nonzero(total)
        for a in range(0, len(lang), 50_000):
            part = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[part], pa.int32()), pa.array(piece[part], pa.int32()), pa.array(total[lang[part], piece[part]].astype(np.int64))], names=["lang", "piece", "n"])
    return run


_VOCABULARIES: dict[int, Vocabulary] = {}


def vocabulary_of(parts: list[bytes]) -> Vocabulary:
    """A worker's vocabulary; the tree is built once per process and list of pieces."""
    key = hash(tuple(parts))
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = Vocabulary(parts)
    return _VOCABULARIES[key]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred (string) and score (double, the posterior of that language)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in MADE and c != text])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        vocabulary = vocabulary_of(own.parts)
        place: dict[str, int] = {}
        known = np.empty((0, len(own.langs)))
        for piece in pieces(batches, text):
            texts = [t if t and own.langs and LETTER.search(t) else "" for t in piece.column(text).to_pylist()]
            if len(place) > KEPT_WORDS:
                place, known = {}, known[:0]
            before = len(place)
            rows = [[place.setdefault(w, len(place)) for w in words_of(t)] for t in texts]
            if len(place) > before:
                fresh = list(place)[before:]
                known = np.concatenate([known, word_scores(fresh, vocabulary, own.logp)])
            langs, scores = [], []
            for row in rows:
                if not row:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                log = own.prior + known[row].sum(0)
                best = int(np.argmax(log))
                langs.append(own.langs[best])
                scores.append(float(1.0 / np.exp(log - log[best]).sum()))
            yield with_columns(piece, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())})
    return docs.mapInArrow(run, schema_with(docs, "`lang_pred` string, `score` double"))
