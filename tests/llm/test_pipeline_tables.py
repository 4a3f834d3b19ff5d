"""The pipeline's stages on awkward tables: nulls, empty and long texts, repeated rows, clashing names, no rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from floodwatch.llm.queries import TOKENIZERS
from tests.llm.data import table, texts

OWN = ("score", "predicted", "evidence", "items", "n_words", "hit_words", "longest", "pii", "fingerprint", "component", "lang", "source")


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")
def test_stages_keep_own_columns_and_awkward_rows(spark, tmp_path):
    rows = texts(rows=40) + [(600 + k, f"you stupid idiot scum {k}") for k in range(6)]
    docs = table(spark, rows).drop(*OWN).withColumns({c: F.lit(f"own {c}") for c in OWN}).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    spark.createDataFrame([(i, 1, int(i >= 600)) for i in [*range(30), *range(600, 606)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a passage that no text here holds at all in any place of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, df in (("some", docs), ("none", docs.filter("false"))):
        left = df
        for stage, run in corpus_pipeline.STAGES:
            run(spark, left, str(tmp_path)).write.parquet(f"{tmp_path}/{name}-{stage}")
            left = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "bpe":
                assert left.columns == df.columns and left.dtypes == df.dtypes
                assert all(r[c] == f"own {c}" for r in left.collect() for c in OWN)
        kept = left.collect()
        assert (len(kept) == 0) == (name == "none") and all(r.round_trip for r in kept)
        if kept:
            ids = [r.doc_id for r in kept]
            assert ids.count(7) <= 1 and 2005 in ids and not {i for i in range(1000, 1010)} & set(ids)   # copies go, long texts stay
