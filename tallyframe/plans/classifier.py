"""The classifier job: clean, balance, split, train three models, compare, keep the best."""

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import clean, metrics, models, sampling
from tallyframe.operators.features import build_preprocessor, feature_names
from tallyframe.operators.profile import available, columns_by_role
from tallyframe.session import checkpointed, quoted

# The feature columns, the money columns and the column whose zeros are invalid.
FEATURES = [
    "age", "education", "marital stat", "sex", "race", "weeks worked in year", "capital gains", "capital losses",
    "class of worker", "major occupation code", "num persons worked for employer",
]
MONEY = ["capital gains", "capital losses"]
NO_ZERO = "age"


def prepare(
    df: DataFrame, key: str, label: str = "label", features: list[str] = FEATURES, money: list[str] = MONEY,
    no_zero: str | None = NO_ZERO, pattern: str = clean.LOW_LABEL_PATTERN, **text,
) -> DataFrame:
    """Target, cleaned text, selected columns, filled money columns and replaced outliers; all rows kept.

    Cutoffs and modes come from the whole table, before the split. `text` holds the options of `clean.clean_text`.
    """
    df = clean.with_target(df, label, pattern)
    df = clean.clean_text(df, **text)
    df = clean.select_features(df, features, keep=("target", key))
    money = [c for c in money if c in df.columns]
    df = clean.fill_nulls(df, {c: 0 for c in money})
    if no_zero in df.columns:
        df = clean.replace_invalid_with_mode(df, no_zero, 0)
    return clean.cap_extreme_with_mode(df, money) if money else df


def train_classifiers(
    df: DataFrame, key: str, target: str = "target", features: list[str] = FEATURES, scaler: str = "quantile",
    seed: int = 42, num_trees: int = 200, forest_depth: int = 0, rounds: int = 200,
) -> dict:
    """Balance, split, preprocess once, train and compare the three classifiers on a prepared table.

    Returns `table` (metrics per model), `best`, `model` (pipeline of the best), `meta`, `reports`, `confusion`
    and `importance`.
    """
    spark = df.sparkSession
    chosen = available(df, features)
    hashed = "_hash_of_key"
    while hashed in df.columns:
        hashed += "_"
    balanced = checkpointed(sampling.downsample(df, target, key, seed, hashed))
    train, test = (part.drop(hashed) for part in sampling.stratified_split(balanced, target, key, 0.3, seed, hashed))
    roles = columns_by_role(balanced.select(*[quoted(c) for c in chosen]))
    fitted_on = train.select(*[quoted(c) for c in chosen]).persist()  # the fit reads these several times
    preprocessor = build_preprocessor(roles["numeric"], roles["categorical"], scaler).fit(fitted_on)
    fitted_on.unpersist()
    names = feature_names(preprocessor)
    columns = [quoted(target).cast("int").alias(target), F.col("features")]
    # Read from disk as a stream: partitions held in memory would leave too little of it to the estimators.
    train_x = preprocessor.transform(train).select(*columns, quoted(key)).persist(StorageLevel.DISK_ONLY)
    test_x = preprocessor.transform(test).select(*columns).persist(StorageLevel.DISK_ONLY)
    estimators = {
        models.LOGISTIC: models.logistic(train_x.count(), target),
        models.FOREST: models.forest(target, num_trees, forest_depth, seed, key=key),
        models.BOOSTED: models.boosted(target, rounds, seed=seed),
    }
    results, fitted, reports, confusion, importance = {}, {}, {}, {}, {}
    for name, estimator in estimators.items():
        fitted[name] = estimator.fit(train_x)
        scored = models.score(fitted[name], test_x).select(target, "prediction", "probability_high").persist()
        ranking = metrics.ranking_metrics(scored, target, "probability_high").first()
        results[name] = {
            "accuracy": metrics.accuracy(scored, target).first()[0],
            "roc_auc": ranking["roc_auc"], "pr_auc": ranking["pr_auc"],
        }
        reports[name] = metrics.classification_report(scored, target)
        confusion[name] = metrics.confusion_matrix(scored, target)
        if name != models.LOGISTIC:
            importance[name] = models.feature_importance(spark, fitted[name], names)
    train_x.unpersist()
    test_x.unpersist()
    table, best = metrics.compare_models(spark, results)
    meta = {
        "model_name": best, "selected_features": chosen, "performance": results[best],
        "scaler_mode": scaler, "feature_names_out": names,
    }
    return {
        "table": table, "best": best, "model": models.with_preprocessor(preprocessor, fitted[best]),
        "models": {n: models.with_preprocessor(preprocessor, m) for n, m in fitted.items()},
        "meta": meta, "reports": reports, "confusion": confusion, "importance": importance,
    }
