import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.models.iforest import Forest, average_path, choose_threshold, draw_samples, fit_forest, grow, score_forest
from floodwatch.models.rf import fit_classes, predict_classes
from floodwatch.models.scaling import apply_scaling, fit_scaling

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    calm = rng.normal(0, 1, (3000, 3))
    flood = rng.normal(6, 0.3, (60, 3))
    pdf = pd.DataFrame(np.vstack([calm, flood]), columns=COLS)
    pdf.insert(0, "id", range(len(pdf)))
    pdf["flood"] = pdf["id"] >= 3000
    return spark.createDataFrame(pdf).repartition(6)


def auc(scores, truth):
    order = pd.Series(scores).rank().to_numpy()
    pos = truth.sum()
    return (order[truth].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


@pytest.mark.parametrize("scaled", [False, True])
def test_forest_separates_planted_floods(points, scaled):
    calm = points.filter("NOT flood")
    model = fit_forest(calm, COLS, ["id"], trees=60, sample=128, seed=3, scaling=fit_scaling(calm, COLS) if scaled else None)
    out = score_forest(points, model, 0.6).toPandas()
    assert out["if_score"].between(0, 1, inclusive="right").all()
    assert auc(out["if_score"].to_numpy(), out["flood"].to_numpy()) > (0.9 if scaled else 0.99)
    thr = choose_threshold(score_forest(calm, model, 1.0), 0.99)
    assert 0.3 < thr < 1.0


def test_forest_is_deterministic(points):
    calm = points.filter("NOT flood")
    one = fit_forest(calm, COLS, ["id"], trees=5, sample=64, seed=9)
    two = fit_forest(calm.repartition(3), COLS, ["id"], trees=5, sample=64, seed=9)
    for a, b in zip(one.threshold, two.threshold):
        np.testing.assert_array_equal(a, b)


def test_samples_have_the_asked_size(points):
    drawn = draw_samples(points, COLS, ["id"], trees=4, sample=64, seed=1).groupBy("tree").count().collect()
    assert {r["count"] for r in drawn} == {64} and len(drawn) == 4
    small = draw_samples(points.filter("id < 40"), COLS, ["id"], trees=4, sample=64, seed=1)
    assert {r["count"] for r in small.groupBy("tree").count().collect()} == {40}


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_scaling_is_uniform_on_its_own_data(points):
    calm = points.filter("NOT flood")
    out = np.vstack(apply_scaling(calm, fit_scaling(calm, COLS)).select("scaled").toPandas()["scaled"])
    assert out.min() >= 0 and out.max() <= 1
    np.testing.assert_allclose(np.quantile(out, [0.25, 0.5, 0.75], axis=0), [[.25] * 3, [.5] * 3, [.75] * 3], atol=0.02)


def test_classes_and_gate(spark):
    rng = np.random.default_rng(1)
    rows = [(float(rng.normal(k * 5, 0.5)), float(rng.normal(-k, 0.5)), C.CLASS_NAMES[k]) for k in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "a double, b double, attack_class string")
    model = fit_classes(df, ["a", "b"], trees=10, depth=4)
    out = predict_classes(df.withColumnRenamed("attack_class", "truth"), model)
    assert out.filter("truth = attack_class").count() > 230
    unsure = predict_classes(df.withColumnRenamed("attack_class", "truth"), model, gate=1.01)
    assert unsure.filter("attack_class <> 'Uncertain'").count() == 0
    assert unsure.agg(F.min("confidence")).first()[0] > 0


def test_trees_give_each_row_the_path_of_its_leaf():
    """All levels at once, for trees of any shape; a value that is no number goes right, a leaf ends the walk."""
    rng = np.random.default_rng(5)
    nodes = [grow(rng.random((40, 3)), np.random.default_rng([5, t]), 6) for t in range(4)] + [[(-1, 0.0, -1, -1, 3.5)]]
    pick = lambda k: [np.array([n[k] for n in tree]) for tree in nodes]
    model = Forest(tuple(COLS), None, 40, *[pick(k) for k in range(5)])
    x = rng.random((200, 3))
    x[0, 1], x[1, 2], x[2] = np.nan, np.inf, nodes[0][0][1]

    def walk(tree, row):
        at = 0
        while tree[at][0] >= 0:
            at = tree[at][2] if row[tree[at][0]] < tree[at][1] else tree[at][3]
        return tree[at][4]

    def depths(tree, at=0, depth=0):
        yield depth
        if tree[at][0] >= 0:
            yield from depths(tree, tree[at][2], depth + 1)
            yield from depths(tree, tree[at][3], depth + 1)

    want = np.power(2.0, -np.array([sum(walk(t, r) for t in nodes) / len(nodes) for r in x]) / average_path(40))
    np.testing.assert_allclose(model.score(x), want, rtol=1e-12)
    assert [levels for levels, *_ in model.steps] == [max(depths(t)) for t in nodes]
