"""Fill-in-the-middle examples against a plain regular expression and exact restoring."""

import hashlib
import re

from pyspark.sql import functions as F

from floodwatch.llm import fill_middle
from tests.llm.data import empty, table, texts


def brute(doc_id, text):
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return text, "plain", n, None, None
    return (f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)) if h[3] % 100 < 80 else (f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m))


def test_forms_cuts_and_restoring(spark):
    odd = ["<", "<<S", "P>S>M>", "a<P>b", "<S>", "<M> x", "\x00 \x1c\x1d a\x85b  c", " " * 9000, "a " * 20_000, "\n\n x\v\f\r", "🙂 é́ 日本", "<P", "<M<S<P >"]
    rows = texts() + [(5000 + 17 * k + j, t) for k, t in enumerate(odd) for j in range(12)]
    df = table(spark, rows)
    made = fill_middle.fill_middle(df)
    assert made.columns == [*df.columns, "fim"]
    got = made.withColumn("back", fill_middle.restore(F.col("fim.text"), F.col("fim.form"))).collect()
    assert len(got) == len(rows) and {r.fim.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        assert tuple(r.fim) == brute(r.doc_id, r.text or "")
        assert r.back == (r.text or "") and r.kept == "own kept"
    assert fill_middle.fill_middle(empty(spark)).count() == 0


def test_an_own_column_of_the_name_is_replaced(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("FIM", F.lit("own"))
    assert fill_middle.fill_middle(df).columns == ["doc_id", "text", "fim"]
    assert fill_middle.fill_middle(df, out="made").columns == ["doc_id", "text", "FIM", "made"]


def test_shares_follow_the_settings(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    n = {r.form: r["count"] for r in fill_middle.fill_middle(df, fim_percent=90, spm_percent=25).groupBy("fim.form").count().collect()}
    assert abs(n["plain"] - 400) < 80 and abs(n["spm"] - 900) < 120 and abs(n["psm"] - 2700) < 150
