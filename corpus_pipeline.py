"""Training-corpus pipeline over the table ``documents``: each stage is one operator of floodwatch.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
reread as the next one's docs. All but the last return the columns of documents.

1. toxicity: rows scored 0.5 or more go (labels are read from ``sf_dir``).
2. SimHash near-duplicates: one row of each group stays.
3. Benchmark decontamination: rows that hold a window of a benchmark item go.
4. Personal data: every span is replaced by its kind in angle brackets; n_chars follows the text.
5. BPE: the texts' token ids, with the ids decoded again.

Own columns, whatever their names, pass through the first four stages untouched,
but for text and n_chars in the fourth. A null or empty text is clean, holds no
window and no personal data and has no tokens; such texts are near-duplicates of
each other. A null text stays null until the last stage. Of rows with
equal texts, ids or both one stays. An empty table gives an empty one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodwatch.llm import bpe, decontaminate, pii, simhash, toxicity
from floodwatch.llm.common import put_back, read, set_aside, short_batches, staged_folder

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    index = toxicity.learn(docs, read(spark, sf_dir, "labels"), learnable=~toxicity.held_out("doc_id"))
    columns, made = docs.columns, ("score", "predicted", "evidence")
    docs, back = set_aside(docs, *made)
    return put_back(toxicity.score(docs, index).filter("predicted = 0").drop(*made), back).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, back = set_aside(docs, "pii")
    found = pii.find_spans(docs, pii.learn(docs))
    clean = found.withColumn("text", pii.redact(found)).drop("pii")
    return put_back(clean, back).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    vocabulary = bpe.load(spark, f"{TOKENIZERS}/byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", "lang", "source", F.shiftright(F.octet_length("token_ids"), 2).cast("long").alias("n_tokens"), "token_ids",
                        F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact_personal_data), ("bpe", encode_tokens)]

#: The stages' models, links and encodings are beyond SQL; the tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{staged_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
