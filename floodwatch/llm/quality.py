"""Document quality by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good, bad or abstain. Their votes are
counted by pattern over all documents; with m rules there are at most 3^m
patterns, however many documents. Expectation-maximisation on these counts
estimates how often each rule votes how for good and for bad documents, without
labels. A document's posterior probability of being good is then an expression
over its votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

SPACES = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def add_counts(docs: DataFrame, text: str = "text", window: int = 3) -> DataFrame:
    """Replace ``text`` by counts of the whole text: COUNTS and n_lines, n_upper, n_distinct, n_ended (lines that end a sentence).

    Null texts have no words. Words stand between ASCII white space; a word is
    repeated if a window of ``window`` words around it occurs twice or more. The
    windows' 64-bit hashes are sorted with their places inside the row, so a
    long text takes n log n steps.
    """
    body, words, lines, hashes, ranked, twice = (free_name(docs, n) for n in ("_body", "_words", "_lines", "_hashes", "_ranked", "_twice"))
    c = F.col
    rest = [x for x in docs.columns if x != text]
    docs = docs.withColumn(body, F.coalesce(c(text).cast("string"), F.lit(""))).drop(text)
    bare = F.btrim(c(body), F.lit(SPACES))
    split = docs.select(*rest, body, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x09-\\x0D\\x20]+")).alias(words),
                        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias(lines))

    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *(F.get(c(words), i + k) for k in range(1, window)))
    hashed = split.select(
        *rest, F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), F.size(lines).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(body, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        F.size(F.filter(lines, lambda x: F.substring(F.btrim(x, F.lit(SPACES)), -1, 1).isin(".", "!", "?", ":", ";", '"', "…"))).cast("long").alias("n_ended"),
        F.when(F.size(words) >= window, F.slice(F.transform(words, window_hash), F.lit(1), F.size(words) - (window - 1))).alias(hashes))
    known = [x for x in hashed.columns if x != hashes]
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    sort = hashed.select(*known, F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), F.sort_array(pairs)).alias(ranked))
    same = lambda s, k: F.coalesce(s["h"] == F.get(c(ranked), k)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(ranked, lambda s, k: same(s, k + 1) | F.when(k > 0, same(s, k - 1)).otherwise(False)), lambda s: s["i"]))
    marked = sort.select(*known, places.alias(twice))
    covered = F.transform(twice, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(c(twice), k + 1) - i, F.lit(window))))
    return marked.select(*known, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part) / F.nullif(F.col(whole).cast("double"), F.lit(0.0)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """Votes of the rules: 1 good, -1 bad, 0 abstains.

    One fault is enough to make a text bad, so a rule that looks for a fault
    abstains where it finds none; a text vouches for itself by reading as prose.
    """
    repeats, symbols, upper, mean = share("n_repeat_words", "n_words"), share("n_symbols", "word_chars"), share("n_upper", "word_chars"), share("word_chars", "n_words")
    ended, again = share("n_ended", "n_lines"), share("n_dup_lines", "n_lines")
    bad = lambda c: F.when(c, -1).otherwise(0)
    prose = (repeats < 0.25) & (symbols < 0.02) & (upper < 0.25) & (again < 0.5) & (mean >= 2) & (mean <= 14)
    return {
        "repeats": bad(repeats > 0.3), "symbols": bad(symbols > 0.04), "upper": bad(upper > 0.4), "lines": bad((again >= 0.5) & (F.col("n_lines") > 3)),
        "word_length": bad((mean < 2) | (mean > 14)), "variety": bad((F.col("n_words") >= 50) & (F.col("n_distinct") < 0.12 * F.least("n_words", F.lit(2000)))),
        "endings": bad((ended < 0.1) & (F.col("n_lines") > 3)), "prose": F.when(prose, 1).otherwise(0)}


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, least_move: float = 1e-9) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on counted vote patterns: the share of good documents, and each rule's chances of a vote for (bad, good) ones.

    Starts from the balance of votes. Chances are smoothed by one document, so no vote decides alone.
    """
    m = len(patterns[0][0]) if patterns else 0
    good = [1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns]
    prior, chances, before = 0.5, [], -math.inf
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = sum(g * n for g, (_, n) in zip(good, patterns))
        prior = (mass + 1) / (total + 2)
        chances = []
        for j in range(m):
            seen = {v: [1.0, 1.0] for v in (-1, 0, 1)}
            for g, (p, n) in zip(good, patterns):
                seen[p[j]][0] += (1 - g) * n
                seen[p[j]][1] += g * n
            chances.append({v: (a / (total - mass + 3), b / (mass + 3)) for v, (a, b) in seen.items()})
        likelihood = 0.0
        for k, (p, n) in enumerate(patterns):
            a = math.log(1 - prior) + sum(math.log(chances[j][v][0]) for j, v in enumerate(p))
            b = math.log(prior) + sum(math.log(chances[j][v][1]) for j, v in enumerate(p))
            top = max(a, b)
            norm = top + math.log(math.exp(a - top) + math.exp(b - top))
            likelihood += n * norm
            good[k] = math.exp(b - norm)
        if likelihood - before < least_move * max(1, total):
            break
        before = likelihood
    return prior, chances


def posterior(votes: dict[str, Column], prior: float, chances: list[dict[int, tuple[float, float]]]) -> Column:
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, chance in zip(votes.values(), chances):
        gain = {k: math.log(b / a) for k, (a, b) in chance.items()}
        odds = odds + F.when(v == 1, gain[1]).when(v == -1, gain[-1]).otherwise(gain[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, fail_words: int = 50, fail_repeats: float = 0.5) -> DataFrame:
    """``docs`` without its text, with COUNTS, base_failed, p_good and kept.

    base_failed: fewer than ``fail_words`` words, or more than ``fail_repeats``
    of them repeated; such documents are never kept. Empty tables give no rows.
    Columns of these names are replaced. One row comes out per row that goes in.
    """
    made = ("n_lines", "n_upper", "n_distinct", "n_ended", *COUNTS, "base_failed", "p_good", "kept")
    docs = docs.drop(*(x for x in made if x != text))
    rest = [x for x in docs.columns if x != text]
    counted = cut(add_counts(docs, text), "counts")
    votes = rules()
    patterns = [(tuple(r[k] for k in votes), r["n"]) for r in counted.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).agg(F.count("*").alias("n")).collect()]
    patterns.sort()
    prior, chances = fit(patterns) if patterns else (0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)}] * len(votes))
    failed = (F.col("n_words") < fail_words) | (F.col("n_repeat_words") > fail_repeats * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "p_good": posterior(votes, prior, chances)})
    return judged.select(*rest, *COUNTS, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))
