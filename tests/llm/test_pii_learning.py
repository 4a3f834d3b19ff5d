"""The candidates that personal data is learned from."""

import inspect

from floodwatch.llm import pii


def test_every_candidate_is_learned_from(spark, monkeypatch):
    seen, cut = [], pii.cut

    def counted(df, name):
        out = cut(df, name)
        seen.append(out.count())
        return out
    monkeypatch.setattr(pii, "cut", counted)
    assert inspect.signature(pii.learn).parameters["sample"].default is None
    docs = spark.createDataFrame([(k, " " * k + ("call " if k % 2 else "") + str(1000000000 + 7919 * k)) for k in range(60)], "doc_id long, text string")
    judge = pii.learn(docs, rounds=1, depth=1)
    assert seen == [60] and judge.trees
