"""A frame-level scorer: logistic regression with balanced class weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Rows of the two classes weigh the same in total."""
    share = df.agg(F.avg(F.col(label).cast("double"))).scalar()
    positive = F.try_divide(F.lit(0.5), share)
    negative = F.try_divide(F.lit(0.5), 1 - share)
    return df.withColumn(out, F.coalesce(F.when(F.col(label) == 1, positive).otherwise(negative), F.lit(1.0)))


def fit_scorer(df: DataFrame, features: Sequence[str], label: str, iterations: int = 20) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    regression = LogisticRegression(
        featuresCol="_features", labelCol=label, weightCol="weight", maxIter=iterations, regParam=1e-4,
        probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
    )
    return Pipeline(stages=[assembler, regression]).fit(balanced_weights(df, label))


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the active probability and the confidence ``p1 - p0``."""
    p = vector_to_array("_probability")[1]
    scored = model.transform(df).withColumn("probability", p).withColumn("confidence", 2 * p - 1)
    return scored.drop("_features", "_probability", "_raw", "_prediction")
