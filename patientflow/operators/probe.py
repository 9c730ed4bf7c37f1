"""A linear probe on fixed feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import Registry
from ..plans.runtime import table
from .metrics import pr_auc, roc_auc


def linear_probe(train: DataFrame, test: DataFrame, features: str, label: str, folds: int = 0, grid: tuple[float, ...] = (0.01, 0.1)) -> DataFrame:
    """``label, score`` of the test rows by logistic regression on array features; with ``folds`` the penalty is chosen by cross-validation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    shaped = lambda d: d.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=50, regParam=grid[0])
    if folds:
        cv = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, list(grid)).build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=0)
        model = cv.fit(shaped(train))
    else:
        model = lr.fit(shaped(train))
    return model.transform(shaped(test)).select("label", vector_to_array("probability")[1].alias("score"))


R = Registry()


@R.query("linear_probe")
def linear_probe_query(spark, sf_dir: str) -> DataFrame:
    """Areas under the curves of a probe that tells labels below 5 from the vectors; its penalty is chosen by cross-validation."""
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") < 5).cast("int"))
    test = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    p = linear_probe(e.where(~test), e.where(test), "embedding", "y", folds=3)
    return roc_auc(p, "score", "label").withColumn("k", F.lit(0)).join(pr_auc(p, "score", "label").withColumn("k", F.lit(0)), "k").drop("k")
