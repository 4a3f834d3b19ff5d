"""Operators that see one row at a time, against libraries and brute force."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodwatch.llm import bpe, chat, decontaminate, html_text, pii, quality
from tests.llm.data import empty, table, texts

TOKENIZER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.json"


def collected(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r.get("text") or ""))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files")
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    rows = texts() + [(1, "a'll 's't '  '\n x\n\n y\t z  <|endoftext|> '<|endoftext|>'s  "), (2, "日本語 ١٢٣ ½² 🙂🙂 \x85 　x"), (3, "ab" * 4000), (4, "!" * 999 + "'re"), (5, " " * 2000)]
    vocabulary = bpe.load(spark, TOKENIZER)
    got = bpe.decode(bpe.encode(table(spark, rows), vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want
        assert r.decoded == tok.decode(want, skip_special_tokens=False) == (r.text or "")
        assert r.kept == "own kept"
    assert bpe.decode(bpe.encode(empty(spark), vocabulary), vocabulary).count() == 0


def test_chat_round_trip(spark):
    marks = [chat.START, chat.TEXT, chat.NEXT, chat.END, *chat.FOREIGN, "<\\|end|>", "<\\\\|end|>", "[\\INST]", "<", "\\"]
    rows = [(1, 0, "user", "a" + "".join(marks)), (1, 1, "assistant", m := "".join(m * 2 for m in marks)), (1, 2, "assistant", None), (1, 2, "assistant", None), (1, 3, None, "x"),
            (None, None, "assistant", "b"), (2, 5, "assistant", "<|end|>"), (2, 5, "assistant", "<|end|>"), (3, 1, "a<|text|>b", ""), (4, 1, "user", "é" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"_conv": F.lit(1), "_turn": F.lit(2), "formatted": F.lit("own")})
    got = {r.conv_id: r for r in chat.format_chats(df).withColumns({"turns": chat.read_back(F.col("formatted")), **chat.digests()}).collect()}
    key = lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [tuple(t) for t in got[conv].turns] == own
        learned = "".join(t for role, t in own if role == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(learned)
        assert got[conv].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    assert got[1].formatted.count(chat.START) == 3 and m
    assert chat.format_chats(df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
<div class="site-header">Logo</div><div id=wrap><article><div class="post-header"><h1>Head &amp; tail</h1></div><p>One   <b>two</b>
three&nbsp;four.<p>Unclosed <br>five<ul><li>x<li>y</ul><aside>Side</aside><form><p>Mail</p></form>
<table><tr><td>c1<td>c2</table><div class="ad">Buy</div><p>Last &lt;p&gt; &eacute;</article><div id="comments"><p>First!</p></div></div>
<footer>&copy; us</footer></body></html>"""


def test_html(spark):
    want = ["Head & tail", "One two three four.", "Unclosed", "five", "x", "y", "c1", "c2", "Last <p> é"]
    assert html_text.extract(PAGE).split("\n\n") == want
    body = "".join(f"<div><p>{'long words of prose here ' * 9}{i}</p></div>" for i in range(5))
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(30))
    plain = f"<html><body><div><ul>{links}</ul></div><div id='main'>{body}</div><div>{links}</div></body></html>"
    assert html_text.extract(plain).split("\n\n") == [("long words of prose here " * 9 + str(i)) for i in range(5)]
    rows = [(1, PAGE), (2, None), (3, ""), (4, "no tags & more"), (5, "<" * 500), (6, "<div>" * 20_000 + "deep"), (7, "<p>a" * 20_000), (8, "<a href=\"x"), (9, PAGE), (9, PAGE)]
    df = spark.createDataFrame(rows, "doc_id long, html string").withColumn("text", F.lit("own"))
    got = [r.text for r in html_text.extract_text(df).orderBy("doc_id").collect()]
    assert len(got) == len(rows) and got[0] == got[-1] == "\n\n".join(want) and got[1] == got[2] == "" and got[3] == "no tags & more"
    assert got[5] == "deep" and got[6].count("a") == 20_000
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_in_sibling_parts():
    said = [f"{'long words of prose here ' * 9}{i}" for i in range(25)]
    p = [f"<p>{x}</p>" for x in said]
    links = "<div><ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(30)) + "</ul></div>"
    two = f"<html><body><div>{''.join(p[:10])}</div>{links}<div>{''.join(p[10:18])}</div><div>Logo</div></body></html>"
    assert html_text.extract(two).split("\n\n") == said[:18]
    beside = f"<body>{links}{p[0]}<div>{''.join(p[1:12])}</div>{p[12]}<div><div>{''.join(p[13:16])}</div></div><div class='related'>{p[20]}</div></body>"
    assert html_text.extract(beside).split("\n\n") == said[:16]


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def test_decontamination(spark):
    rows = texts(rows=120)
    bench = [(k, " ".join(x.decode() for x in words(rows[k][1])[:n])) for k, n in ((0, 30), (1, 10), (2, 4), (3, 60), (5, 11), (8, 1))]
    bench += [(80, " ".join(x.decode() for x in words(next(t for i, t in rows if i == 2005))[1000:1300])), (90, ""), (91, None), (92, "..."), (None, bench[0][1]), (0, bench[0][1]), (94, "never seen words in any of these texts at all here")]
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("n_words", F.lit(1))
    for limit in (1 << 20, 60):  # one block, and several
        got = collected(decontaminate.find_matches(table(spark, rows), items, block_bytes=limit))
        assert len(got) == len(rows)
        for r in got:
            w, hit, names, top = words(r["text"]), set(), set(), 0
            for item, text in bench:
                b = words(text)
                n = min(10, len(b))
                for a in range(len(b) - n + 1 if n else 0):
                    for i in range(len(w) - n + 1):
                        if w[i:i + n] == b[a:a + n]:
                            hit |= set(range(i, i + n))
                            names.add("" if item is None else str(item))
                            run = n
                            while i + run < len(w) and a + run < len(b) and w[i + run] == b[a + run]:
                                run += 1
                            top = max(top, run)
            assert (r["n_words"], r["hit_words"], r["items"]) == (len(w), sorted(hit), sorted(names))
            assert (r["longest"]["words"] if r["longest"] else 0) == top
    kept = decontaminate.remove_contaminated(table(spark, rows), items)
    assert kept.count() == sum(not r["hit_words"] for r in got)
    assert decontaminate.find_matches(empty(spark), items).count() == 0
    assert decontaminate.find_matches(table(spark, rows), items.limit(0)).filter("size(items) > 0 or size(hit_words) > 0").count() == 0


def test_quality_counts(spark):
    rows = texts() + [(1, "a b c a b c\n\nx y\nx y\n"), (2, "w " * 5000), (3, "### $ | <b>")]
    got = collected(quality.judge(table(spark, rows)).withColumnRenamed("kept", "verdict"))
    assert len(got) == len(rows)
    want = Counter()
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        cover = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert want == Counter((r["doc_id"], *(r[k] for k in quality.COUNTS), r["base_failed"]) for r in got)
    assert not any(r["verdict"] and r["base_failed"] for r in got)
    assert quality.judge(empty(spark)).count() == 0


def test_quality_finds_junk(spark):
    import random
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))).capitalize() + "." for _ in range(rng.randint(6, 40)))) for i in range(200)]
    clean = prose
    junk = [(5000 + i, " ".join(w + "###" for w in t.split())) for i, t in prose[:20]] + [(6000 + i, t.upper() + "!!") for i, t in prose[20:40]]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(kept[i] for i, _ in clean) and not any(kept[i] for i, _ in junk)


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))
    return [(k, *m.span()) for k, p, ok in tests for m in re.finditer(p, text or "") if ok(m.group())]


def test_personal_data(spark):
    import random
    rng = random.Random(5)
    parts = ["a", "b@", "@", "a.b", "x.", "1", "23", "4111 1111 1111 1111", "-", " ", "..", ".", "+1", "+44 20", "(0)", "555", "255", "256", "1.2.3.4", "é", "\n", "_", "a@b.c", "d@e-f.gh", "\x01", "00", "--", "12345",
             'token = "0a1b2c3d4e5f6a7b8c9d"', "[at]"]
    rows = texts() + [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(1, "1 " * 20_000), (2, "a." * 20_000 + "@a.b"), (3, "a@" + "b." * 20_000 + "c"), (4, "9" * 50_000), (5, "+1" + " " * 30_000 + "1"), (6, "😀 a@b.cd 1.2.3.4")]
    df = table(spark, rows)
    judge = pii.learn(df)
    assert judge.trees
    got = pii.find_spans(df, judge).withColumn("red", pii.redact(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s.kind, s.start, s.end) for s in r.pii]
        fixed = [s for s in spans if s[0] in pii.KINDS]
        assert fixed == base(r.text)
        for _, a, b in spans[len(fixed):]:
            assert not any(a < e and s < b for _, s, e in fixed)
    assert pii.find_spans(empty(spark), pii.learn(empty(spark))).count() == 0
    one = spark.createDataFrame([(1, "mail a@b.cd now, 1.2.3.4!")], "doc_id long, text string")
    found = pii.find_spans(one, judge)
    assert found.select(pii.redact(found)).first()[0] == "mail <EMAIL> now, <IP>!"


def test_copies_of_a_candidate_count_once(spark, monkeypatch):
    said = [f"call +49 30 55{i:05d} now" if i % 2 else f"order {9 * '1'}{i:05d} came" for i in range(10)]
    rows = [(i, said[i % 10] if i < 1000 else f"{'x ' * (i % 90)}mail a{i}@b{i % 7}.cd or number 12345{i:06d}") for i in range(1300)]
    taken = []
    monkeypatch.setattr(pii, "cut", lambda df, name: taken.append(df.cache()) or taken[-1])
    judge = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"), sample=200, rounds=2)
    assert taken[0].count() == taken[0].distinct().count() == 200 and judge.trees
