"""Personal data by generated candidates and boosted trees, in DataFrame functions only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) follow fixed
formats and always stay. Generators of high recall propose further spans:
anything like an address, a number or a key, overlaps included. Boosted trees
(Spark ML) judge a candidate by its format and its context; they are learned
from the candidates themselves, where a checksum, a range or a telling context
gives the label. Per kind, a threshold calibrated on candidates kept from the
learning selects what is added.

The fitted trees become a column expression, so candidates are judged inside
their row: texts are neither exploded nor shuffled. Spans count code points.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

KINDS = ("email", "ip", "card", "phone")
MORE = ("address", "number", "secret")
#: Stands for a sign between two digits or domain characters, so that a match is one run of a character class.
JOIN, CLEAR = "\x01", "\x02"
SPAN = "array<struct<start:int,end:int,text:string>>"
#: Words before a secret. Fixed values.
KEYWORDS = "(?i)(token|secret|passw|pwd|api.?key|access.?key|credential|bearer)"
CALLS = "(?i)(phone|tel|call|fax|mobile|cell|handy|tél|teléf)"
NUMBERS = "(?i)(card|visa|iban|account|konto|ssn|passport|tax|customer|id)"
FEATURES = ("chars", "digits", "letters", "uppers", "signs", "groups", "longest", "at", "dots", "plus", "luhn", "octets", "mixed", "key_before", "call_before", "number_before",
            "joined_before", "joined_after", "kind")


def joined(text: Column, left: str, signs: str, right: str) -> Column:
    """``signs`` between characters of two classes replaced by JOIN; every text keeps its length."""
    return F.regexp_replace(F.translate(text, JOIN, CLEAR), f"(?<={left}){signs}(?={right})", JOIN)


def spans_of(text: Column, pattern: str, original: Column) -> Column:
    """All matches as (start, end, text), leftmost and non-overlapping; the text is taken from ``original``, of equal length."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.substr(original, start + 1, end - start).alias("text")))).alias("out"))
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    return F.when(F.size(matches) > 0, F.aggregate(both, begin, step)["out"]).otherwise(F.array().cast(SPAN))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of up to 19 digits holds."""
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1))
    single = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(single, value), F.lit(0), lambda a, x: a + x) % 10 == 0


OCTETS = "^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\\.|$)){4}$"
LOCAL, DOMAIN = "[A-Za-z0-9._%+\\x01-]", "[A-Za-z0-9-]"


def base_spans(text: str) -> dict[str, Column]:
    """Spans of the fixed formats; a match that fails its check goes, without another try inside it."""
    c = F.col(text)
    none = F.array().cast(SPAN)
    digit = c.rlike("[0-9]")
    address = spans_of(joined(c, DOMAIN, "\\.", DOMAIN), f"(?:\\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++\\x01[A-Za-z0-9\\x01-]++", c)
    number = spans_of(joined(c, "[0-9]", "[ -]", "[0-9]"), "[0-9][0-9\\x01]++", c)
    size = lambda s: F.length(digits_of(s["text"]))
    return {
        "email": F.when(c.contains("@"), address).otherwise(none),
        "ip": F.when(digit, F.filter(spans_of(c, "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", c), lambda s: s["text"].rlike(OCTETS))).otherwise(none),
        "card": F.when(digit, F.filter(number, lambda s: F.when(size(s).between(13, 19), luhn(digits_of(s["text"]))).otherwise(False))).otherwise(none),
        "phone": F.when(c.contains("+"), F.filter(spans_of(c, "\\+[0-9][ ().0-9-]+[0-9]", c), lambda s: size(s).between(9, 15))).otherwise(none)}


def candidate_spans(text: str) -> dict[str, Column]:
    """What the generators propose: addresses in any spelling, numbers of nine digits or more, long keys."""
    c = F.col(text)
    none = F.array().cast(SPAN)
    digit = c.rlike("[0-9]")
    address = "(?:\\G|(?<![^\\s<>\"',;]))[^\\s<>\"',;@]{1,64}+(?:@| ?[\\[({]at[\\])}] ?)[^\\s<>\"',;@]{3,}+"
    number = spans_of(joined(c, "[0-9)]", "[ ().-]", "[0-9( ]"), "\\+?[0-9][0-9\\x01() ]{7,}+", c)
    key = "(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+"
    return {
        "address": F.when(c.contains("@") | c.contains("at]") | c.contains("at)"), spans_of(c, address, c)).otherwise(none),
        "number": F.when(digit, number).otherwise(none),
        "secret": F.when(digit, F.filter(spans_of(c, key, c), lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))).otherwise(none)}


def described(span: Column, kind: int, text: Column) -> Column:
    """A candidate with its features."""
    t = span["text"]
    digits = digits_of(t)
    before = F.substr(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))
    after = F.substr(text, span["end"] + 1, F.lit(1))
    n = lambda x: x.cast("double")
    length = lambda p: n(F.length(F.regexp_replace(t, p, "")))
    few = F.length(digits).between(9, 19)
    values = {
        "chars": n(F.length(t)), "digits": n(F.length(digits)), "letters": length("[^A-Za-z]+"), "uppers": length("[^A-Z]+"), "signs": length("[A-Za-z0-9 ]+"),
        "groups": n(F.size(F.split(t, "[^0-9A-Za-z]+"))), "longest": n(F.array_max(F.transform(F.split(t, "[^0-9]+"), lambda x: F.length(x)))),
        "at": n(t.contains("@")), "dots": length("[^.]+"), "plus": n(t.startswith("+")), "luhn": n(F.when(few, luhn(digits)).otherwise(False)), "octets": n(t.rlike(OCTETS)),
        "mixed": n(F.size(F.array_distinct(F.split(t, "")))), "key_before": n(before.rlike(KEYWORDS)), "call_before": n(before.rlike(CALLS)), "number_before": n(before.rlike(NUMBERS)),
        "joined_before": n(before.rlike("[A-Za-z0-9]\\z")), "joined_after": n(after.rlike("[A-Za-z0-9]")), "kind": F.lit(float(kind))}
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), *(values[f].alias(f) for f in FEATURES))


def _each(spans: Column, make, value) -> Column:
    return F.transform(spans, lambda s: make(s, value))


def _count(kind: str):
    return lambda n, s: n + F.when(s["kind"] == kind, 1).otherwise(0)


def add_candidates(docs: DataFrame, text: str, base: str, found: str, proposed: str) -> DataFrame:
    """Add ``base`` (struct of span arrays by kind) and ``found`` (described candidates)."""
    with_base = docs.withColumns({base: F.struct(*(v.alias(k) for k, v in base_spans(text).items())), proposed: F.struct(*(v.alias(k) for k, v in candidate_spans(text).items()))})
    lists = [_each(F.col(proposed)[k], lambda s, i: described(s, i, F.col(text)), i) for i, k in enumerate(MORE)]
    return with_base.withColumn(found, F.concat(*lists))


def weak_label(x: Column) -> Column:
    """The label that a candidate's own check or context gives: 1 personal, 0 not."""
    address = (x["kind"] == 0) & (x["at"] == 1) & (x["dots"] >= 1) & (x["letters"] >= 4) & (x["joined_after"] == 0)
    number = (x["kind"] == 1) & (((x["luhn"] == 1) & x["digits"].between(13, 19)) | ((x["plus"] == 1) & x["digits"].between(9, 15)) | ((x["call_before"] == 1) & x["digits"].between(9, 15)))
    secret = (x["kind"] == 2) & (x["key_before"] == 1) & (x["digits"] >= 4) & (x["letters"] >= 4) & (x["mixed"] >= 10)
    return (address | number | secret).cast("double")


def tree_column(lines: list[str], values: dict[str, Column]) -> Column:
    """A fitted tree, as Spark prints it, as a column."""
    def parse(at: int) -> tuple[Column, int]:
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1])), at + 1
        m = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line)
        yes, at = parse(at + 1)
        no, at = parse(at + 1)
        return F.when(values[FEATURES[int(m[1])]] <= float(m[2]), yes).otherwise(no), at
    return parse(0)[0]


class Judge:
    """Fitted trees and a threshold per kind."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, x: Column) -> Column:
        values = {f: x[f] for f in FEATURES}
        total = F.lit(0.0)
        for weight, lines in self.trees:
            total = total + weight * tree_column(lines, values)
        return 1 / (1 + F.exp(-2 * total))

    def accepts(self, x: Column) -> Column:
        if not self.trees:
            return F.lit(False)
        least = F.element_at(F.array(*(F.lit(t) for t in self.thresholds)), x["kind"].cast("int") + 1)
        return self.probability(x) >= least


def learn(docs: DataFrame, text: str = "text", sample: int | None = None, rounds: int = 12, depth: int = 3, precision: float = 0.95) -> Judge:
    """Fit the trees on all different candidates (by features and place) and calibrate thresholds on a fourth of them.

    With ``sample`` at most that many are taken, in the order of a hash.

    A threshold is the smallest with at least ``precision`` among the held-back
    candidates of its kind. Without candidates of both labels nothing is added.
    """
    body, base, found, proposed = "_text", "_base", "_found", "_proposed"
    own = add_candidates(docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(body)).filter(F.col(body).rlike("[0-9@]|at[\\])]")), body, base, found, proposed)
    rows = own.select(F.explode(found).alias("x")).select("x.*")
    rows = rows.withColumn("label", weak_label({f: F.col(f) for f in FEATURES})).withColumn("h", F.xxhash64(*FEATURES, "start", "end"))
    rows = rows.distinct()
    rows = cut(rows if sample is None else rows.orderBy("h", *FEATURES).limit(sample), "candidates")
    held = F.pmod(F.col("h"), F.lit(4)) == 0
    fit, kept = rows.filter(~held), rows.filter(held)
    if fit.select("label").distinct().count() < 2:
        return Judge([], [2.0] * len(MORE))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fit).select("features", "label")
    data = data if sample is None else data.coalesce(2)   # a bounded sample is small
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=7, maxMemoryInMB=64).fit(data)
    trees = []
    for line in model.toDebugString.splitlines()[1:]:
        if m := re.match(r"\s*Tree \d+ \(weight ([-0-9.eE]+)\)", line):
            trees.append((float(m[1]), []))
        elif line.strip():
            trees[-1][1].append(line)
    judge = Judge(trees, [])
    columns = {f: F.col(f) for f in FEATURES}
    scored = kept.select(F.col("kind").cast("int").alias("kind"), "label", F.round(judge.probability(columns), 3).alias("p")).groupBy("kind", "p").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("kind", F.desc("p")).collect()  # at most 1001 rows a kind
    for kind in range(len(MORE)):
        best, n, good = 2.0, 0, 0.0
        for r in scored:
            if r["kind"] == kind:
                n, good = n + r["n"], good + r["good"]
                if good >= precision * (n + 1):
                    best = max(0.5, r["p"] - 0.0005)
        judge.thresholds.append(best)
    return judge


def find_spans(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """Add pii: array of (kind, start, end), base spans first by kind and start, then the added ones likewise.

    Added spans overlap no base span. Null texts have none. A column named pii is replaced.
    """
    docs = docs.drop("pii") if text != "pii" else docs
    body, base, found, proposed, listed = (free_name(docs, n) for n in ("_body", "_base", "_found", "_proposed", "_listed"))
    own = add_candidates(docs.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit(""))), body, base, found, proposed)
    flat = F.concat(*(_each(F.col(base)[k], lambda s, k: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")), k) for k in KINDS))
    own = own.select(*docs.columns, found, flat.alias(listed))
    free = lambda x: ~F.exists(F.col(listed), lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    added = F.transform(F.filter(found, lambda x: judge.accepts(x) & free(x)), lambda x: F.struct(
        F.element_at(F.array(*(F.lit(k) for k in MORE)), x["kind"].cast("int") + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return own.select(*docs.columns, F.concat(F.col(listed), F.when(F.size(found) > 0, added).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("pii"))


def redact(found: DataFrame, text: str = "text", spans: str = "pii") -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first one's kind."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(part)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(F.col(text), acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, begin, step, done)).otherwise(F.col(text))


def digests(spans: str = "pii") -> dict:
    """Columns n_email, n_ip, n_card, n_phone, base_sha256 and spans of :func:`find_spans`."""
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = {f"n_{k}": F.aggregate(spans, F.lit(0).cast("long"), _count(k)) for k in KINDS}
    return counts | {"base_sha256": F.sha2(text(F.filter(spans, lambda s: s["kind"].isin(*KINDS))).cast("binary"), 256), "spans": text(F.col(spans))}
