"""Attack classes with the built-in random forest, and the two-stage cascade."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodwatch import config as C
from floodwatch.models.iforest import Forest, score_forest
from floodwatch.operators.fusion import gate_confidence
from floodwatch.plans.stage import cut


def fit_classes(labelled: DataFrame, columns: Sequence[str], label: str = "attack_class", *, trees: int = 30,
                depth: int = 8, seed: int = 7) -> PipelineModel:
    """Train on rows of the three named classes."""
    index = StringIndexerModel.from_labels(list(C.CLASS_NAMES), inputCol=label, outputCol="_label", handleInvalid="skip")
    return Pipeline(stages=[index, VectorAssembler(inputCols=list(columns), outputCol="_vector"),
                            RandomForestClassifier(featuresCol="_vector", labelCol="_label", numTrees=trees,
                                                   maxDepth=depth, seed=seed)]).fit(labelled)


@dataclass(frozen=True)
class ClassTrees:
    """A class forest given as it stands: per tree, nodes (column, threshold, left, right) and leaves with the classes' probabilities.

    A value up to the threshold goes left. A row's probabilities are the mean over the trees.
    It is a column expression, so nothing leaves the JVM; bounded by the nodes of a forest one would write down.
    """

    trees: tuple[tuple, ...]

    def probabilities(self) -> list[Column]:
        def value(node: tuple, k: int) -> Column:
            if isinstance(node[0], str):
                column, threshold, left, right = node
                return F.when(F.col(column) <= threshold, value(left, k)).otherwise(value(right, k))
            return F.lit(float(node[k]))
        return [reduce(Column.__add__, [value(t, k) for t in self.trees]) / float(len(self.trees)) for k in range(len(C.CLASS_NAMES))]


def predict_classes(df: DataFrame, model: PipelineModel | ClassTrees, gate: float = C.RF_CONFIDENCE_GATE) -> DataFrame:
    """Add class and confidence; below the gate the class is Uncertain and the confidence stays."""
    if isinstance(model, ClassTrees):
        out = df.withColumn("_p", F.array(*model.probabilities()))
    else:
        out = df
        for stage in model.stages[1:]:
            out = stage.transform(out)
        out = out.withColumn("_p", vector_to_array("probability"))
    out = out.withColumn("confidence", F.array_max("_p"))
    names = F.array(*[F.lit(c) for c in C.CLASS_NAMES])
    top = F.element_at(names, F.array_position("_p", F.col("confidence")).cast("int"))
    return (out.withColumn("attack_class", gate_confidence(top, F.col("confidence"), gate))
            .drop("_p", "_vector", "rawPrediction", "probability", "prediction"))


def class_inputs(model: PipelineModel | ClassTrees) -> list[str]:
    """The columns that a class model reads."""
    if not isinstance(model, ClassTrees):
        return list(model.stages[1].getInputCols())
    found, todo = [], list(model.trees)
    while todo:
        node = todo.pop()
        if isinstance(node[0], str):
            found.append(node[0])
            todo += node[2:]
    return list(dict.fromkeys(found))


def split_by_score(flows: DataFrame, forest: Forest, *, threshold: float, low_rate: str | None = None,
                   keep: Sequence[str] | None = None, classes: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Score every flow, write the scores once, and give (anomalous, normal) flows; a low-rate flow is normal with score 0 and never scored.

    With ``keep`` only those columns are written, and the ``classes`` columns for the anomalous flows alone.
    """
    scored = score_forest(flows.drop("attack_class", "confidence"), forest, threshold, skip=low_rate)
    hit = F.coalesce(F.col("is_anomaly") == 1, F.lit(False))
    if keep is not None:
        kept = list(dict.fromkeys([*keep, *([low_rate] if low_rate else []), "if_score", "is_anomaly"]))
        scored = scored.select(*kept, *[F.when(hit, F.col(c)).alias(c) for c in classes if c not in kept])
    scored = cut(scored, "scores")
    return scored.filter(hit), scored.filter(~hit).withColumns({"attack_class": F.lit("Normal"), "confidence": F.lit(0.0)})


def cascade(flows: DataFrame, forest: Forest, classes: PipelineModel | ClassTrees, *, threshold: float,
            gate: float = C.RF_CONFIDENCE_GATE, low_rate: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Score every flow and name the class of the anomalous ones; only those go through the class forest.

    ``keep`` names the columns of ``flows`` to give back, all by default; the others are not written.
    """
    hits, calm = split_by_score(flows, forest, threshold=threshold, low_rate=low_rate, keep=keep, classes=class_inputs(classes))
    return predict_classes(hits, classes, gate).unionByName(calm)
