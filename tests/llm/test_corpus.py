"""Operators that compare texts with the whole corpus, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from floodwatch.llm import exchange, ngram_trie, simhash, suffix_repeats, toxicity
from floodwatch.llm.components import connected
from tests.llm.data import empty, table, texts


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 400)}


def prints_of(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, seed=42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(prints, radius=3):
    values = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(values)):
        for b in (np.flatnonzero(np.bitwise_count(values[a] ^ values[a + 1:]) <= radius) + a + 1).tolist():
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {int(v): find(i) for i, v in enumerate(values)}


def test_simhash(spark):
    rng = random.Random(4)
    rows = texts(rows=80)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(2000)).split()
    for k in range(40):  # near copies
        w = list(long)
        w[rng.randint(0, 1999)] = "edit"
        rows.append((3000 + k, " ".join(w)))
    got = simhash.add_component(table(spark, rows)).collect()
    want = [prints_of(t) for _, t in rows]
    assert Counter((r.doc_id, r.fingerprint % (1 << 64)) for r in got) == Counter((i, p) for (i, _), p in zip(rows, want))
    number = classes(want)
    smallest = {}
    for (i, _), p in zip(rows, want):
        if i is not None:
            smallest[number[p]] = min(i, smallest.get(number[p], i))
    for r in got:
        assert r.component_id == smallest.get(number[r.fingerprint % (1 << 64)])
    kept = simhash.keep_one(table(spark, rows)).collect()
    assert len(kept) == len(set(number.values())) and {r.doc_id for r in kept if r.doc_id is not None} == set(smallest.values())
    assert simhash.add_component(empty(spark)).count() == simhash.keep_one(empty(spark)).count() == 0


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(6)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) % (1 << 64) for _ in range(150)}
    signed = [int(np.uint64(p % (1 << 64)).view(np.int64)) for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in connected(links).collect()}
    want = classes([p % (1 << 64) for p in prints])
    groups = Counter(want.values())
    assert set(roots) | {r for r in roots.values()} == {p for p, c in want.items() if groups[c] > 1}
    for p, r in roots.items():
        assert want[p] == want[r]
    assert len(set(roots.values())) == sum(n > 1 for n in groups.values())


def test_repeated_strings(spark, monkeypatch):
    rows = texts(rows=120) + [(1, "ab" * 150), (2, "x" * 200), (3, "x" * 200), (4, "y" * 201), (5, "z" * 199), (6, "z" * 199), (8, "q" * 1000)]
    where = {}
    coded = [(t or "").encode() for _, t in rows]
    for k, x in enumerate(coded):
        for i in range(len(x) - 199):
            where.setdefault(x[i:i + 200], []).append((k, i))
    gone = [np.zeros(len(x), bool) for x in coded]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i:i + 200] = True
    want = Counter((i, x[:50], bytes(np.frombuffer(x, np.uint8)[~g]), int((np.diff(g.astype(int), prepend=0) > 0).sum())) for (i, _), x, g in zip(rows, coded, gone))
    for size in (1 << 20, 20_000):
        monkeypatch.setattr(exchange, "BUCKET_BYTES", size)
        monkeypatch.setattr(exchange, "PART_BYTES", size)
        got = suffix_repeats.find_repeats(table(spark, rows)).collect()
        assert Counter((r.doc_id, (r.text or "").encode()[:50], bytes(r.kept), len(r.removed_spans)) for r in got) == want
        assert all(r["_bucket"] == "own _bucket" and sum(s.end - s.start for s in r.removed_spans) == len((r.text or "").encode()) - len(r.kept) for r in got)
    assert suffix_repeats.find_repeats(empty(spark)).count() == 0


def test_cover_has_every_difference():
    c = suffix_repeats.COVER
    assert {int(a - b) % suffix_repeats.PERIOD for a in c for b in c} == set(range(suffix_repeats.PERIOD))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 5), (1000, 5000), (5000, 10**9), (3000, 3000), (70_000, 10**11)):
        v = np.unique(rng.integers(0, u, n)) if n else np.empty(0, np.int64)
        coded = ngram_trie.EliasFano(v, u)
        asked = np.concatenate([rng.integers(0, u, 3000), v])
        place = {int(x): i for i, x in enumerate(v)}
        assert coded.find(asked).tolist() == [place.get(int(x), -1) for x in asked]
        assert not len(v) or (coded.access(np.arange(len(v))) == v).all()


def test_language_model(spark, monkeypatch):
    rows = texts(rows=150)
    learn = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False))
    tokens = [((t or "").encode().lower().split() + [b" "], i is not None and i % 7 != 2) for i, t in rows]
    c = Counter(w for ws, on in tokens if on for w in ws)
    pairs = Counter(p for ws, on in tokens if on for p in zip([b"^"] + ws, ws))
    n, v, types = sum(c.values()), len(c), Counter(a for a, _ in pairs)
    ones, twos = (sum(x == k for x in pairs.values()) for k in (1, 2))
    d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
    want = Counter()
    for (i, _), (ws, _) in zip(rows, tokens):
        score = 0.0
        for a, b in zip([b"^"] + ws, ws):
            low, seen = (c[b] + 1) / (n + v + 1), c[b" "] if a == b"^" else c[a]
            score += math.log10((max(pairs[a, b] - d, 0) if pairs[a, b] else 0) / seen + d * types[a] / seen * low if seen else low)
        want[i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
        want[i, len(ws), "score"] += score
    for size in (1 << 20, 20_000):
        monkeypatch.setattr(ngram_trie, "BUCKET_BYTES", size)
        monkeypatch.setattr(exchange, "PART_BYTES", size)
        got = ngram_trie.score_texts(table(spark, rows), learn).collect()
        have = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
        assert have == Counter({k: x for k, x in want.items() if k[2] != "score"})
        sums = Counter()
        for r in got:
            sums[r.doc_id, r.n_tokens, "score"] += r.score
        for k, s in sums.items():
            assert abs(s - want[k]) <= k[1] * 3 / ngram_trie.GRID
    assert ngram_trie.score_texts(empty(spark), learn).count() == 0


def test_no_learned_text(spark):
    got = ngram_trie.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (got.n_known, got.train_tokens, got.base_score) == (0, 0, 0.0)


def labelled(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["scum", "idiot", "trash", "moron"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled(1, 600)
    docs = table(spark, rows + [(9000, None), (9001, ""), (None, "scum idiot trash"), (9002, "idiot " * 20_000), (3, rows[3][1])])
    marks = spark.createDataFrame(labels + [(5, 1, 1), (8000, 1, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    index = toxicity.learn(docs, marks, learnable=~toxicity.held_out("doc_id"))
    got = toxicity.score(docs, index).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.kept == "own kept" for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 600]
    assert sum((r.doc_id % 5 == 0) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    assert all(r.evidence[0].label == 1 for r in held if r.doc_id % 5 == 0)
    assert not any(r.predicted for r in got if r.doc_id in (9000, 9001))
    # the block-max search finds what brute force finds
    own = index.value
    dense = np.zeros((own.n, len(own.idf)))
    for b in range(own.blocks):
        s = slice(own.begin[b], own.begin[b + 1])
        dense[own.post_owner[s] + b * own.block, own.post_term[s]] = own.post_weight[s]
    for r in held[:60]:
        ids, weights = own.vector(r.text.encode())
        q = np.zeros(len(own.idf))
        q[ids] = weights
        dots = np.round(dense @ q, 12)
        order = np.lexsort((np.arange(own.n), -dots))[:own.k]
        best, near = own.nearest(ids, weights)
        assert best.tolist() == order[dots[order] > 0].tolist() and np.allclose(near, dots[order][dots[order] > 0])
    none = toxicity.learn(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty(spark), toxicity.learn(empty(spark), marks)).count() == 0


def test_few_labels_and_all_words(spark):
    rows, labels = labelled(2, 60)  # 12 toxic rows: no word's counts tell much
    docs = table(spark, rows)
    index = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    assert sum(got[i].predicted for i in range(0, 60, 5)) >= 10 and not any(got[i].predicted for i in range(60) if i % 5)
    own, counts = index.value, {i: Counter(t.split()) for i, t in rows}
    seen = Counter(w for c in counts.values() for w in c)
    toxic = Counter(w for i, c in counts.items() if i % 5 == 0 for w in c)
    assert set(own.terms) == {w.encode() for w in seen}

    def weight(w):
        a, b = toxic[w], seen[w] - toxic[w]
        return (math.log(61 / (1 + seen[w])) + 1e-3) * (1 + 60 * (a * (48 - b) - b * (12 - a)) ** 2 / ((a + b) * (60 - a - b) * 12 * 48) / toxicity.CHI)
    for (i, x), (j, y) in zip(list(counts.items())[:20], list(counts.items())[20:]):
        u, v = ({w: (1 + math.log(n)) * weight(w) for w, n in c.items()} for c in (x, y))
        want = sum(u[w] * v[w] for w in u.keys() & v.keys()) / math.sqrt(sum(a * a for a in u.values()) * sum(a * a for a in v.values()))
        ids, weights = own.vector(dict(rows)[i].encode())
        q = dict(zip(ids.tolist(), weights.tolist()))
        at = own.place[j]
        s = slice(own.begin[at // own.block], own.begin[at // own.block + 1])
        mine = own.post_owner[s] + at // own.block * own.block == at
        assert abs(sum(q.get(t, 0) * p for t, p in zip(own.post_term[s][mine].tolist(), own.post_weight[s][mine].tolist())) - want) < 1e-9
    # words that no example has lengthen a text
    assert np.linalg.norm(own.vector(b"scum unheard of words")[1]) < 0.99
