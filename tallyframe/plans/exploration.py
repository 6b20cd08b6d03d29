"""The exploration job: every profile of a labelled table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import profile, scores
from tallyframe.operators.clean import with_target
from tallyframe.operators.cube import CountCube
from tallyframe.functions.expressions import LOW_LABEL_PATTERN_ONE_SPACE
from tallyframe.session import checkpointed, quoted


def insights(
    df: DataFrame, target: str = "target", label: str = "label", threshold: float = 0.7,
    encoded: DataFrame | None = None, key: str | None = None,
) -> DataFrame:
    """One row: rows, features, class sizes, categoricals, correlated pairs and the top five features.

    `encoded` may carry the label-encoded table if the caller has it already.
    """
    roles = profile.columns_by_role(df, (label, target, *([key] if key else [])))
    if encoded is None:
        encoded = scores.label_encode(df, roles["categorical"])
    features = [c for c in df.columns if c in roles["categorical"] or c in roles["numeric"]]
    pairs = scores.high_corr_pairs(encoded, [*features, target], threshold).agg(F.count("*")).scalar()
    best = scores.target_correlation(encoded, features, target, 5).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("abs_corr")).alias("r"), "feature"))), lambda s: s["feature"]
    )).scalar()
    t = quoted(target)
    return df.agg(
        F.count("*").alias("rows"), F.lit(len(features)).alias("features"),
        F.count_if(t == 0).alias("class_0"), F.count_if(t == 1).alias("class_1"),
    ).select(
        "*", F.lit(len(roles["categorical"])).alias("categoricals"),
        pairs.alias("correlated_pairs"), best.alias("top_features"),
    )


def _mutual_info(
    encoded: DataFrame, text: list[str], numeric: list[str], key: str | None, bins: int | None, cube: CountCube | None = None,
) -> DataFrame:
    """Plug-in scores of the coded columns, nearest-neighbour scores of the numeric ones, largest first."""
    if not numeric and cube is not None and not bins:
        return cube.mutual_info()
    if bins or not numeric:
        return scores.mutual_info(encoded, [c for c in encoded.columns if c in text or c in numeric], bins=bins)
    if key is None:
        key = "_row"
        while key in encoded.columns:
            key += "_"
        encoded = checkpointed(encoded.withColumn(key, F.monotonically_increasing_id()))
    found = scores.nearest_mutual_info(encoded, numeric, key)
    if text:
        found = found.unionByName(scores.mutual_info(encoded, text) if cube is None else cube.mutual_info())
    return found.orderBy(F.desc_nulls_last("mutual_info"), "feature")


def explore(
    df: DataFrame, label: str = "label", shares_by: tuple[str, ...] = ("education", "marital stat", "race", "sex"),
    pattern: str = LOW_LABEL_PATTERN_ONE_SPACE, mi_bins: int | None = None, histogram_columns: list[str] | None = None,
    key: str | None = None,
) -> dict[str, DataFrame]:
    """All exploration tables of a labelled table, by name. What counts words reads one stored count cube.

    `key`, a unique column, is no feature; it breaks the ties of the nearest-neighbour mutual information, which numeric
    columns get unless `mi_bins` asks for quantile bins. Without a key the rows are numbered as they lie.
    """
    out = {
        "shape": profile.shape(df), "types": profile.dtype_counts(df),
        "nulls": profile.null_counts(df), "sentinels": profile.sentinel_counts(df),
    }
    df = with_target(df, label, pattern)
    roles = profile.columns_by_role(df, (label, "target", *([key] if key else [])))
    text, numeric = roles["categorical"], roles["numeric"]
    cube = CountCube(df, text) if text else None
    out["classes"] = cube.class_balance() if cube else profile.class_balance(df)
    if cube:
        out["top_values"] = cube.value_counts(top=5)
        out["distinct"] = cube.distinct_counts()
    for c in shares_by:
        if c in df.columns:
            out[f"share_by_{c}"] = cube.crosstab_rate(c) if c in text else profile.crosstab_rate(df, c)
    if numeric:
        out["describe"] = profile.describe_numeric(df, numeric)
        out["outliers"] = profile.iqr_outliers(df, numeric)
        out["histograms"] = profile.density_histogram(df, histogram_columns or numeric)
    encoded = scores.label_encode(df, text)
    features = [c for c in df.columns if c in text or c in numeric]
    out["high_correlations"] = scores.high_corr_pairs(encoded, [*features, "target"])
    out["heat_map"] = scores.corr_lower_triangle(encoded, [*features, "target"])
    out["target_correlation"] = scores.target_correlation(encoded, features)
    out["chi2"] = scores.chi2_scores(encoded, features)
    out["f"] = scores.f_scores(encoded, features)
    out["mutual_info"] = _mutual_info(encoded, text, numeric, key, mi_bins, cube)
    out["insights"] = insights(df, label=label, encoded=encoded, key=key)
    return out
