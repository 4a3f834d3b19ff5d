"""Language-model scores from an n-gram trie of Elias-Fano levels.

The model is an interpolated bigram model over words and text ends with absolute
discounting:

    P(w | v) = max(c(v w) - D, 0) / c(v) + D * T(v) / c(v) * P(w)
    P(w)     = (c(w) + 1) / (N + V + 1)

c are counts in the learned texts, N all tokens, V distinct ones, T(v) the
distinct successors of v, D = n1 / (n1 + 2 n2) from the pairs seen once and
twice. P sums to one with one unseen token.

The counts of a corpus do not fit one machine, and no machine needs all of them.
Texts lie in buckets of bounded size; a bucket sends its distinct words and pairs
with their counts to the parts of the key space (:mod:`exchange`), where totals
are formed, and gets back the totals of just these. Each bucket then builds the
trie of what its own texts can ask for:

* level 1: per word, quantised log P(w) and log backoff, and an Elias-Fano list
  of pointers to its successors;
* level 2: successors as one monotone sequence (context number times words, plus
  word), Elias-Fano coded, with quantised log probabilities. A pair is found by
  successor search among the values that share its upper bits.

Levels are flat arrays in one memory-mapped file that is unlinked at once, so a
lost executor leaves nothing and a retry builds it again. Log probabilities are
quantised on a fixed grid (1/4096), so a score does not depend on the bucket.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, free_name, mix, put_back, set_aside
from .exchange import BUCKET, SCHEMA, answered, ask, bits_of, bucketed_table, by_round, labelled, questions

GRID = 4096
BUCKET_BYTES = 8 << 20
#: Names of the two that are no words.
END, START = mix(np.array([1], np.uint64)), mix(np.array([2], np.uint64))
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class EliasFano:
    """A sorted sequence of whole numbers: lower bits packed, upper bits in unary, with a directory for select."""

    def __init__(self, values: np.ndarray, universe: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, min(48, int(universe // max(1, n)).bit_length() - 1))
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.uppers = int(universe >> self.low_bits) + 1
        bits = np.zeros(-(-(n + self.uppers + 1) // 512) * 512, bool)
        bits[upper + np.arange(n)] = True
        self.unary = np.packbits(bits, bitorder="little").view("<u8")
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        chunks = [np.packbits(((values[a:a + 65536, None] >> shifts) & np.uint64(1)).astype(bool).ravel(), bitorder="little") for a in range(0, n, 65536)]
        packed = np.concatenate(chunks) if chunks else np.empty(0, np.uint8)
        self.low = np.concatenate([packed, np.zeros(16, np.uint8)])
        zeros = 512 - np.bitwise_count(self.unary).reshape(-1, 8).sum(1, dtype=np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])

    def arrays(self) -> list[str]:
        return ["unary", "low", "zeros"]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def first_of(self, upper: np.ndarray) -> np.ndarray:
        """Number of values whose upper bits are smaller than ``upper`` (0 to the number of uppers): zeros before, by select."""
        out = np.zeros(len(upper), np.int64)
        ask_ = np.flatnonzero(upper > 0)
        rank = upper[ask_] - 1  # the zero with this number ends the values below
        block = np.searchsorted(self.zeros, rank, "right") - 1
        rest = rank - self.zeros[block]
        word = block * 8
        for _ in range(7):
            here = 64 - np.bitwise_count(self.unary[word]).astype(np.int64)
            on = rest >= here
            rest = np.where(on, rest - here, rest)
            word = np.where(on, word + 1, word)
        left, place = ~self.unary[word], np.zeros(len(word), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = left & np.uint64((1 << width) - 1)
            here = np.bitwise_count(part).astype(np.int64)
            on = rest >= here
            rest = np.where(on, rest - here, rest)
            place = np.where(on, place + width, place)
            left = np.where(on, left >> np.uint64(width), part)
        out[ask_] = word * 64 + place - rank
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values at sorted or unsorted places, by binary search over the uppers' borders."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.uppers, np.int64)
        while np.any(hi - lo > 1):
            mid = (lo + hi) >> 1
            on = self.first_of(mid) <= at
            lo, hi = np.where(on, mid, lo), np.where(on, hi, mid)
        return (lo.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def borders(self) -> np.ndarray:
        """first_of of every number of uppers at once: the zeros' places in the unary vector, for many searches."""
        zeros = np.flatnonzero(np.unpackbits(self.unary.view(np.uint8), bitorder="little")[:self.n + self.uppers + 1] == 0)[:self.uppers]
        return np.concatenate([[0], zeros - np.arange(len(zeros))])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value by successor search, -1 where the sequence lacks it."""
        values = values.astype(np.uint64)
        upper = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.minimum(upper, self.uppers - 1)
        if len(values) * 8 > self.n:
            borders = self.borders()
            place, end = borders[inside], borders[inside + 1]
        else:
            place, end = self.first_of(inside), self.first_of(inside + 1)
        end = np.where(upper < self.uppers, end, place)
        want = values & np.uint64((1 << self.low_bits) - 1)
        low, high = place.copy(), end.copy()
        live = np.flatnonzero(low < high)
        while len(live):  # halve the values that share the upper bits
            mid = (low[live] + high[live]) >> 1
            after = self.lows(mid) < want[live]
            low[live[after]], high[live[~after]] = mid[after] + 1, mid[~after]
            live = live[low[live] < high[live]]
        found = np.full(len(values), -1, np.int64)
        live = np.flatnonzero(low < end)
        live = live[self.lows(low[live]) == want[live]]
        found[live] = low[live]
        return found


class Trie:
    """Two levels over local word numbers, memory-mapped."""

    def __init__(self, words: int, word_log: np.ndarray, backoff: np.ndarray, context: np.ndarray, successor: np.ndarray, pair_log: np.ndarray):
        """Pairs are sorted by (context, successor)."""
        self.words = words
        self.pointers = EliasFano(np.searchsorted(context, np.arange(words + 1)), len(context) + 1)
        self.successors = EliasFano(context * words + successor, words * words)
        self.quantised = {"word_log": quantise(word_log), "backoff": quantise(backoff), "pair_log": quantise(pair_log)}
        self._map()

    def _map(self) -> None:
        owned = [(self.quantised, k) for k in self.quantised] + [(o.__dict__, k) for o in (self.pointers, self.successors) for k in o.arrays()]
        size = sum(-(-d[k].nbytes // 8) * 8 for d, k in owned)
        file = tempfile.TemporaryFile()
        file.truncate(max(8, size))
        memory, at = np.memmap(file, np.uint8, "r+", shape=(max(8, size),)), 0
        for d, k in owned:
            a = d[k]
            memory[at:at + a.nbytes] = a.view(np.uint8).ravel()
            d[k] = memory[at:at + a.nbytes].view(a.dtype)
            at += -(-a.nbytes // 8) * 8
        self.file = file

    def log10(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | context) of pairs of local numbers."""
        at = self.successors.find(context * self.words + word)
        known = at >= 0
        q = self.quantised
        out = (q["backoff"][context].astype(np.int64) + q["word_log"][word]).astype(np.float64)
        out[known] = q["pair_log"][at[known]]
        return -out / GRID


def quantise(log: np.ndarray) -> np.ndarray:
    """Minus the logarithm on the grid, in 16 bits (down to 10^-15.99)."""
    return np.clip(np.rint(-log * GRID), 0, 65535).astype(np.uint16)


def word_spans(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, bytes and text of each word, and the lower-cased bytes. Words end at white space and at the end of a text."""
    word = np.concatenate([~SPACES[raw], [False]])
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = rows[:-1][rows[:-1] < len(raw)]
    first[edge] = word[edge]
    begins = np.flatnonzero(first)
    last = word[:-1] & ~word[1:]
    inner = rows[(rows > 0)] - 1
    last[inner] = word[inner]
    sizes = np.flatnonzero(last) + 1 - begins
    return begins, sizes, np.searchsorted(rows, begins, "right") - 1, LOWER[raw]


def word_names(lower: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time for all words that are long enough."""
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at = np.arange(len(begins)), 0
    while len(live):
        rest = np.minimum(sizes[live] - at, 8)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - rest) * 8).astype(np.uint64)
        x = (h[live] ^ (eight[begins[live] + at] & keep)) * np.uint64(0xD6E8FEB86659FD93)
        h[live] = x ^ (x >> np.uint64(32))
        at += 8
        live = live[sizes[live] > at]
    return mix(h)


class Bucket:
    """Words and pairs of a bucket's texts. Number 0 is the end of a text, the last number its start."""

    def __init__(self, column, learned: np.ndarray):
        begins, sizes, owner, lower = word_spans(*buffer_of(column))
        names = word_names(lower, begins, sizes)
        del lower, begins
        order = np.argsort(names)
        ordered = names[order]
        fresh = np.diff(ordered, prepend=np.uint64(0)) != 0
        if len(fresh):
            fresh[0] = True
        number = np.empty(len(names), np.int64)
        number[order] = np.cumsum(fresh)  # 1 and on: 0 is the end
        self.hash = np.concatenate([END, ordered[fresh], START])
        self.words = len(self.hash)
        self.sizes = np.bincount(owner, minlength=len(learned)) + 1
        self.ids = np.zeros(int(self.sizes.sum()), np.int64)
        self.ids[np.arange(len(number)) + owner] = number  # every text before has one end
        del names, ordered, order, number, owner
        context = np.empty_like(self.ids)
        context[1:] = self.ids[:-1]
        context[np.cumsum(self.sizes) - self.sizes] = self.words - 1
        self.codes = context * self.words + self.ids
        self.learned = np.repeat(learned, self.sizes)
        ordered = np.sort(self.codes)
        self.pairs = ordered[np.flatnonzero(np.diff(ordered, prepend=-1))]
        self.context, self.successor = self.pairs // self.words, self.pairs % self.words
        key = mix(self.hash[self.context] * np.uint64(0x9E3779B97F4A7C15) + mix(self.hash[self.successor]))
        self.pair_order = np.argsort(key)
        self.pair_keys = key[self.pair_order]
        self.word_order = np.argsort(self.hash[:-1])
        self.word_keys = self.hash[self.word_order]
        self.all_order = np.argsort(self.hash)

    def pair_index(self) -> np.ndarray:
        """The pair of every token."""
        order = np.argsort(self.codes)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(np.diff(self.codes[order], prepend=-1) != 0) - 1
        return out

    def word_counts(self) -> np.ndarray:
        """Learned counts in the order of word_keys."""
        return np.bincount(self.ids[self.learned], minlength=self.words)[self.word_order]

    def pair_counts(self) -> np.ndarray:
        """Learned counts in the order of pair_keys."""
        own = np.sort(self.codes[self.learned])
        return (np.searchsorted(own, self.pairs, "right") - np.searchsorted(own, self.pairs))[self.pair_order]


def _totals(number: np.ndarray, n: int, counts: np.ndarray):
    """Total of the entry's key, twice, plus one on the first entry that has learned it; sums: keys learned, tokens, keys of 1 and of 2."""
    total = np.bincount(number, counts, n).astype(np.int64)
    have = np.flatnonzero(counts)
    first = np.zeros(len(number), np.int64)
    first[have[np.unique(number[have], return_index=True)[1]]] = 1
    return (total[number] * 2 + first).astype("<u8"), [int((total > 0).sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum())]


def _sum(number: np.ndarray, n: int, counts: np.ndarray) -> np.ndarray:
    return np.bincount(number, counts, n).astype("<u8")[number]


def score_texts(docs: DataFrame, learn: Column, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score; learn from the rows where ``learn`` is true.

    A-Z is lower-cased; tokens are the words between ASCII white space and one
    end per text. Null texts have the end only. base_score sums log10 of
    (c + 1) / (N + V + 1), score the model's log10 probability of words and end.
    Nothing learned: every token has the chance of an unseen one.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs, aside = set_aside(docs.drop(*(m for m in made if m != text)), BUCKET)
    body, learned = free_name(docs, "_body"), free_name(docs, "_learned")
    own = docs.withColumns({learned: F.coalesce(learn, F.lit(False)), body: F.coalesce(F.col(text).cast("string"), F.lit(""))}).drop(text)
    table, size = bucketed_table(own, body, [*keys, body], BUCKET_BYTES)
    bits, width = bits_of(size), 5
    short = table.select(BUCKET, body, learned)

    def load(left) -> Bucket:
        return Bucket(left.column(body), left.column(learned).to_numpy(zero_copy_only=False).astype(bool))

    def counts_of(key, left):
        b = load(left)
        return labelled(key[0].as_py(), {"words": questions(b.word_keys, bits, 8, b.word_counts().astype("<u4")),
                                         "pairs": questions(b.pair_keys, bits, width, b.pair_counts().astype("<u4"))})
    totals = ask(short.groupBy(BUCKET).applyInArrow(counts_of, SCHEMA), {"words": (8, _totals, "<u4"), "pairs": (width, _totals, "<u4")}, "totals")
    sums = {r["round"]: r for r in totals.filter("sums is not null").groupBy("round").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(4))).collect()}
    distinct, tokens = (sums["words"]["s0"], sums["words"]["s1"]) if sums else (0, 0)
    ones, twos = (sums["pairs"]["s2"], sums["pairs"]["s3"]) if sums else (0, 0)
    discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    totals = totals.drop("sums")

    def successors(key, left, right):
        b, got = load(left), by_round(right)
        first = np.empty(len(b.pair_keys), np.int64)
        first[b.pair_order] = answered(b.pair_keys, bits, got["pairs"], "<u8").astype(np.int64) & 1
        types = np.bincount(b.context, first, b.words)
        return labelled(key[0].as_py(), {"types": questions(b.hash[b.all_order], bits, 8, types[b.all_order].astype("<u4"))})
    asked = short.groupBy(BUCKET).cogroup(totals.filter("round = 'pairs'").groupBy(BUCKET)).applyInArrow(successors, SCHEMA)
    answers = totals.unionByName(ask(asked, {"types": (8, _sum, "<u4")}, "types").drop("sums"))
    rest = [c for c in own.columns if c not in (body, learned)]

    def finish(key, left, right):
        b, got = load(left), by_round(right)
        counts, types = np.zeros(b.words), np.zeros(b.words)
        counts[b.word_order] = (answered(b.word_keys, bits, got["words"], "<u8") >> np.uint64(1)).astype(np.float64)
        types[b.all_order] = answered(b.hash[b.all_order], bits, got["types"], "<u8")
        pair_total = np.empty(len(b.pair_keys))
        pair_total[b.pair_order] = (answered(b.pair_keys, bits, got["pairs"], "<u8") >> np.uint64(1)).astype(np.float64)
        chance = (counts + 1) / (tokens + distinct + 1)
        seen = counts.copy()
        seen[-1] = counts[0]  # as many texts begin as end
        with np.errstate(divide="ignore", invalid="ignore"):
            backoff = np.where((seen > 0) & (types > 0), discount * types / seen, 1.0)
        known = pair_total > 0
        c, w = b.context[known], b.successor[known]
        chances = np.maximum(pair_total[known] - discount, 0) / np.maximum(seen[c], 1) + backoff[c] * chance[w]
        trie = Trie(b.words, np.log10(chance), np.log10(np.minimum(backoff, 1)), c, w, np.log10(np.minimum(chances, 1)))
        log = trie.log10(b.context, b.successor)[b.pair_index()]
        ends = np.cumsum(b.sizes)
        total = lambda x: np.add.reduceat(x, ends - b.sizes) if len(ends) else np.empty(0)
        extra = {"n_tokens": b.sizes, "n_known": total((counts[b.ids] > 0).astype(np.int64)), "train_tokens": np.full(len(ends), tokens, np.int64),
                 "base_score": total(np.log10(chance)[b.ids]), "score": total(log)}
        return pa.table({**{c: left.column(c) for c in rest}, body: left.column(body), **{k: pa.array(v) for k, v in extra.items()}})
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*rest).schema), f"`{body}` string",
                     "n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    done = table.groupBy(BUCKET).cogroup(answers.groupBy(BUCKET)).applyInArrow(finish, ddl).withColumnRenamed(body, text)
    return put_back(done, aside)
