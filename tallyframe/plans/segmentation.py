"""The segmentation job: profile the groups, scale, choose k, cluster, band."""

from pyspark.sql import DataFrame

from tallyframe.operators import clean, cluster, groups
from tallyframe.operators.features import scale
from tallyframe.operators.profile import describe_numeric
from tallyframe.plans.classifier import FEATURES as COLUMNS
from tallyframe.session import checkpointed, quoted

# The group key, the statistics per column and the feature table made from them.
KEY = "major occupation code"
STATS = {
    "age": ["mean", "std", "count"],
    "weeks worked in year": ["mean", "std"],
    "capital gains": ["mean", "median"],
    "capital losses": ["mean", "median"],
    "target": ["mean", "count"],
    "num persons worked for employer": ["mean", "std"],
}
FEATURES = {
    "avg_age": "age_mean", "avg_weeks_worked": "weeks worked in year_mean", "high_income_rate": "target_mean",
    "avg_capital_gains": "capital gains_mean", "sample_size": "target_count",
}
CLUSTER_ON = ["avg_age", "avg_weeks_worked", "high_income_rate"]


def prepare(df: DataFrame, label: str = "label", features: list[str] = COLUMNS, **text) -> DataFrame:
    """Target, cleaned text and the feature columns. `text` holds the options of `clean.clean_text`."""
    return clean.select_features(clean.clean_text(clean.with_target(df, label), **text), features)


def group_features(
    df: DataFrame, key: str = KEY, stats: dict = STATS, features: dict = FEATURES, size: str = "target_count",
    min_rows: int = 100,
) -> DataFrame:
    """Rounded statistics per group, groups below `min_rows` dropped, renamed to the feature columns."""
    profile = groups.group_profile(df, key, stats)
    return groups.segment_features(groups.min_group_size(profile, size, min_rows), key, features)


def cluster_groups(
    features: DataFrame, key: str = KEY, cols: list[str] = CLUSTER_ON, scaler: str = "quantile", ks=range(2, 7),
    n_init: int = 10, seed: int = 42,
) -> tuple[DataFrame, DataFrame, int]:
    """(features with `cluster`, quality per k, best k) from clustering the scaled feature columns."""
    scaled = scale(features.select(quoted(key), *[quoted(c) for c in cols]), cols, scaler)
    table, best, labelled = cluster.choose_k(scaled, key, cols, ks, n_init, seed)
    return features.join(labelled.select(quoted(key), "cluster"), key, "inner"), table, best


def segment(df: DataFrame, key: str = KEY, stats: dict = STATS, features: dict = FEATURES, size: str = "target_count",
            min_rows: int = 100, cols: list[str] = CLUSTER_ON, rate: str = "high_income_rate", **options) -> dict:
    """All segmentation tables. The heavy group-by runs once; the group table is stored and reused."""
    table = checkpointed(group_features(df, key, stats, features, size, min_rows))
    clustered, quality, best = cluster_groups(table, key, cols, **options)
    return {
        "features": clustered, "quality": quality, "best_k": best,
        "clusters": groups.cluster_summary(clustered, cols),
        "members": groups.cluster_members(clustered, key),
        "ranked": groups.rank_groups(clustered, rate, key),
        "bands": groups.quartile_bands(clustered, rate).orderBy(quoted(rate).desc_nulls_last(), quoted(key)),
        "summary": groups.round_stats(describe_numeric(clustered, [*cols, *[c for c in features if c not in cols and c != "sample_size"]]), 3),
        "plot": groups.segment_plot_data(clustered, key, *cols[:3]),
    }
