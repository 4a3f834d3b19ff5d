"""Small awkward tables: nulls, empty and long texts, repeated rows, clashing column names."""

import random

from pyspark.sql import functions as F

CLASHES = ("_bucket", "score", "component", "fingerprint", "n_words", "items", "pii", "token_ids", "decoded", "kept", "label", "_body", "part", "term")


def texts(seed: int = 1, rows: int = 150) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["A", "ÉA", "don't", "12", "x@y.zz", "&"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(rng.randint(12, 90)) for _ in range(8)]
    out = []
    for i in range(rows):
        parts = [prose(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:a + rng.randint(80, 600)], prose(rng.randint(0, 30))]
        out.append((i, rng.choice([" ", "\n"]).join(parts)))
    copies = [(1000 + k, out[k][1]) for k in range(10)]
    odd = [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "a"), (2004, "a" * 30_000), (2005, prose(6000)), (None, out[3][1]), (None, None), (7, out[7][1]), (7, out[7][1])]
    return out + copies + odd


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def empty(spark):
    return table(spark, [])
