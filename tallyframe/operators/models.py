"""The three classifiers, scoring and feature importances."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expressions import ellipsize, prediction_text
from tallyframe.operators.boosting import BoostedTrees
from tallyframe.operators.forest import RandomForest
from tallyframe.session import quoted

# Split points per feature that trees may choose from.
MAX_BINS = 256
LOGISTIC, FOREST, BOOSTED = "Logistic Regression", "Random Forest", "Gradient Boosted Trees"


def logistic(n_train: int, label: str = "target", max_iter: int = 1000) -> LogisticRegression:
    """L2 penalty of strength 1 on the summed loss; Spark averages the loss, hence 1 / n."""
    return LogisticRegression(
        labelCol=label, maxIter=max_iter, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False
    )


def forest(label: str = "target", num_trees: int = 200, max_depth: int = 0, seed: int = 42, max_bins: int = MAX_BINS, key: str = "") -> RandomForest:
    """Trees on bootstrap draws, by a unique key if one is named, that grow to pure leaves or to `max_depth` levels if it isn't 0."""
    return RandomForest(labelCol=label, trees=num_trees, maxDepth=max_depth, seed=seed, maxBins=max_bins, keyCol=key)


def boosted(label: str = "target", rounds: int = 200, max_depth: int = 6, seed: int = 42, max_bins: int = MAX_BINS) -> BoostedTrees:
    """Second-order boosting with row and column shares of 0.8 per tree."""
    return BoostedTrees(labelCol=label, rounds=rounds, maxDepth=max_depth, seed=seed, maxBins=max_bins)


def score(model, df: DataFrame) -> DataFrame:
    """Input columns with the class `prediction` and `probability_high`, the probability of class 1."""
    scored = model.transform(df)
    return scored.select(
        *[quoted(c) for c in df.columns],
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability_high"),
    )


def label_prediction(df: DataFrame) -> DataFrame:
    """Text of the predicted class; the confidence is P(class 1) in percent for either class."""
    return df.withColumns({
        "predicted_income": prediction_text(F.col("prediction")),
        "confidence_pct": F.col("probability_high") * 100,
    })


def score_customers(model, df: DataFrame, education: str = "education") -> DataFrame:
    """Score new rows for display, with the education text cut to 28 characters."""
    scored = label_prediction(score(model, df))
    if education in df.columns:
        scored = scored.withColumn("education_short", ellipsize(quoted(education), 28, always=True))
    return scored


def feature_importance(spark, classifier, names: list[str]) -> DataFrame:
    """Normalised importances, largest first: `feature`, `importance`."""
    rows = list(zip(names, classifier.featureImportances.toArray().tolist()))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def with_preprocessor(preprocessor: PipelineModel, classifier) -> PipelineModel:
    return PipelineModel(stages=[*preprocessor.stages, classifier])
