"""Label encoding, correlation and feature scores."""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.expressions import double_text, n_log_n, number, numbers, sql_text
from tallyframe.functions.tails import chi2_p_value, digamma, f_p_value
from tallyframe.operators.groups import running_number
from tallyframe.operators.quantiles import numbered_in_ranges, quantile_values
from tallyframe.session import SMALL_BYTES, SMALL_ROWS, checkpointed, quoted

UNKNOWN = "Unknown"
# More pairs than these are added up in Arrow batches, since so many aggregates make generated code too long.
MAX_PAIRS_IN_ONE_AGGREGATE = 12
# Deviations below this share of the column's largest value are rounding, not variation.
ROUNDING = 1e-14
MAX_LITERAL_VALUES = 100


def label_encode(df: DataFrame, cols: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """Replace every value by its 0-based rank among the column's sorted values; nulls count as `unknown`.

    Every column goes its own way by the measured number and size of its values: a short list becomes a literal array, a
    longer one a broadcast join. The codes of other columns come from a distributed sort and a regular join, in which
    adaptive execution splits hot values.
    """
    if not cols:
        return df
    spark = df.sparkSession
    out = df.withColumns({c: F.coalesce(quoted(c), F.lit(unknown)) for c in cols})
    values = out.select(*[quoted(c) for c in cols]).unpivot(
        [], [quoted(c) for c in cols], "column", "value").distinct().persist()
    sizes = values.groupBy("column").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).collect()
    short, rows, size = [], 0, 0  # the columns whose values fit the bounds together, fewest first
    for r in sorted(sizes, key=lambda r: (r["n"], r["column"])):
        rows, size = rows + r["n"], size + r["bytes"]
        if rows <= SMALL_ROWS and size <= SMALL_BYTES:
            short.append(r["column"])
    words = {c: [] for c in short}
    for r in values.where(F.col("column").isin(short)).collect():
        words[r["column"]].append(r["value"])
    words = {c: sorted(w, key=lambda v: v.encode()) for c, w in words.items()}
    out = out.withColumns({
        c: (F.array_position(F.array(*[F.lit(v) for v in w]), quoted(c)) - 1).cast("int")
        for c, w in words.items() if len(w) <= MAX_LITERAL_VALUES
    })
    joins = {
        c: F.broadcast(spark.createDataFrame([(v, i) for i, v in enumerate(w)], "_value string, _code int"))
        for c, w in words.items() if len(w) > MAX_LITERAL_VALUES
    }
    joins |= {
        c: checkpointed(running_number(
            values.where(F.col("column") == c).select(F.col("value").alias("_value")), [F.col("_value")], "_code", start=0,
        )) for c in (r["column"] for r in sizes) if c not in words
    }
    seen = {r["column"] for r in sizes}
    out = out.withColumns({c: F.lit(None).cast("int") for c in cols if c not in seen})  # an empty table
    values.unpersist()
    for c, codes in joins.items():
        out = out.join(codes, quoted(c) == F.col("_value"), "left")
        out = out.withColumn(c, F.col("_code").cast("int")).drop("_value", "_code")
    return out.select(*[quoted(c) for c in df.columns])


def _moments_in_spark(x: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """Variances and covariance of every pair over the rows where both are known, in one aggregate."""
    pairs = [
        f"struct({i} AS i, {j} AS j, var_pop(x{i}) FILTER (WHERE x{j} IS NOT NULL) AS vx, "
        f"var_pop(x{j}) FILTER (WHERE x{i} IS NOT NULL) AS vy, covar_pop(x{i}, x{j}) AS cov)" for i, j in wanted]
    largest = [f"max(abs(x{i}))" for i in sorted({i for pair in wanted for i in pair})]
    places = {i: place for place, i in enumerate(sorted({i for pair in wanted for i in pair}))}
    found = x.agg(F.expr(f"array({', '.join(pairs)}) AS pairs"), F.expr(f"array({', '.join(largest)}) AS largest"))
    place = F.create_map(*[F.lit(v) for item in places.items() for v in item])
    return found.select("largest", F.inline("pairs")).select(
        "i", "j", "vx", "vy", "cov", F.get("largest", place[F.col("i")]).alias("ax"), F.get("largest", place[F.col("j")]).alias("ay"))


def _batch_moments(x: np.ndarray) -> np.ndarray:
    """Seven matrices over pairs of columns, each over the rows where both are known: n, means and squared deviations of the
    first and second column, products of deviations; and the largest absolute value of the first column."""
    known = ~np.isnan(x)
    k = known.astype(float)
    filled = np.where(known, x, 0.0)
    centre = filled.sum(axis=0) / np.maximum(k.sum(axis=0), 1)
    largest = np.abs(filled).max(axis=0)
    d = np.where(known, x - centre, 0.0)
    n = k.T @ k
    share = 1 / np.maximum(n, 1)
    s, q = d.T @ k, (d * d).T @ k
    left = q - s * s * share
    left[left <= ROUNDING * q] = 0.0
    mean = np.where(n > 0, centre[:, None] + s * share, 0.0)
    return np.stack([n, mean, mean.T, left, left.T, d.T @ d - s * s.T * share, np.broadcast_to(largest[:, None], n.shape)])


def _merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows together; no sums of squares that would cancel."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy, weight = b[1] - a[1], b[2] - a[2], a[0] * share
    dx, dy = np.where(a[0] * b[0] > 0, dx, 0.0), np.where(a[0] * b[0] > 0, dy, 0.0)
    means = [np.where(a[0] > 0, a[i] + step * share, b[i]) for i, step in ((1, dx), (2, dy))]
    return np.stack([n, *means, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight,
                     a[5] + b[5] + dx * dy * weight, np.maximum(a[6], b[6])])


def _moments_in_arrow(x: DataFrame, width: int) -> DataFrame:
    """The same for wide tables: tasks merge the moments of their batches, then of each other, as a stream of small matrices."""
    def merged(parts):
        total = None
        for part in parts:
            total = part if total is None else _merged_moments(total, part)
        return total

    def of_rows(batches):
        total = merged(_batch_moments(b.to_numpy(dtype="float64")) for b in batches if len(b))
        if total is not None:
            yield pd.DataFrame({"task": [int(total[0, 0, 0])], "moments": [total.tobytes()]})

    def of_tasks(batches):
        total = merged(np.frombuffer(m).reshape(7, width, width) for b in batches for m in b["moments"])
        if total is not None:
            yield pd.DataFrame({"task": [0], "moments": [total.tobytes()]})

    def by_pair(batches):
        total = merged(np.frombuffer(m).reshape(7, width, width) for b in batches for m in b["moments"])
        total = np.zeros((7, width, width)) if total is None else total
        i, j = np.triu_indices(width, 1)
        n = np.where(total[0] > 0, total[0], np.nan)
        vx, vy, cov = (total[m] / n for m in (3, 4, 5))
        yield pd.DataFrame({"i": i, "j": j, "vx": vx[i, j], "vy": vy[i, j], "cov": cov[i, j], "ax": total[6][i, j], "ay": total[6][j, i]})

    tasks = x.mapInPandas(of_rows, "task long, moments binary").withColumn("task", F.spark_partition_id())
    few = tasks.repartition("task").mapInPandas(of_tasks, "task long, moments binary")
    return few.repartition(1).mapInPandas(by_pair, "i int, j int, vx double, vy double, cov double, ax double, ay double")


def _pairs(df: DataFrame, cols: list[str], max_pairs: int, with_last: bool = False) -> DataFrame:
    """Correlations of all pairs of columns, or of every column with the last one, from one scan of the table."""
    last = len(cols) - 1
    wanted = [(i, j) for i, j in combinations(range(len(cols)), 2) if j == last or not with_last]
    if not wanted:
        return df.sparkSession.createDataFrame([], "i int, j int, feature1 string, feature2 string, corr double")
    x = numbers(df, cols)
    if len(wanted) <= max_pairs:
        moments = _moments_in_spark(x, wanted)
    else:
        moments = _moments_in_arrow(x, len(cols))
        if with_last:
            moments = moments.where(F.col("j") == last)
    varies = (F.sqrt("vx") > ROUNDING * F.col("ax")) & (F.sqrt("vy") > ROUNDING * F.col("ay"))
    corr = F.when(varies, F.try_divide(F.col("cov"), F.sqrt("vx") * F.sqrt("vy")))
    names = F.array(*[F.lit(c) for c in cols])
    return moments.select(
        "i", "j", F.get(names, F.col("i")).alias("feature1"), F.get(names, F.col("j")).alias("feature2"),
        F.when(~F.isnan(corr), corr).alias("corr"),
    )


def correlation_pairs(df: DataFrame, cols: list[str], max_pairs: int = MAX_PAIRS_IN_ONE_AGGREGATE) -> DataFrame:
    """Pearson correlation of every pair i < j over the rows where both are known; null if one is constant.

    One scan: means and deviations are merged, so that the products do not cancel.
    """
    return _pairs(df, cols, max_pairs)


def correlation_matrix(df: DataFrame, cols: list[str], max_pairs: int = MAX_PAIRS_IN_ONE_AGGREGATE) -> DataFrame:
    """The full matrix in long form: `i`, `j`, `feature1`, `feature2`, `corr`."""
    mirrored = F.expr(
        "inline(array(struct(i, j, feature1, feature2, corr), "
        "struct(j AS i, i AS j, feature2 AS feature1, feature1 AS feature2, corr)))")
    own = numbers(df, cols).agg(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.lit(c).alias("feature1"), F.lit(c).alias("feature2"),
                 F.when(F.min(f"x{i}") < F.max(f"x{i}"), 1.0).alias("corr")) for i, c in enumerate(cols)])))
    return _pairs(df, cols, max_pairs).select(mirrored).unionByName(own)


def high_corr_pairs(df: DataFrame, cols: list[str], threshold: float = 0.7) -> DataFrame:
    return correlation_pairs(df, cols).where(F.abs("corr") > threshold).select(
        "feature1", "feature2", F.col("corr").alias("correlation"))


def corr_lower_triangle(df: DataFrame, cols: list[str]) -> DataFrame:
    """The cells a heat map shows when the diagonal and the upper triangle are masked."""
    return correlation_pairs(df, cols).select(
        F.col("feature2").alias("row"), F.col("feature1").alias("col"), "corr")


def target_correlation(df: DataFrame, cols: list[str], target: str = "target", k: int | None = None) -> DataFrame:
    """|corr| of every column with the target, largest first: `feature`, `abs_corr`."""
    both = [*cols, target]
    pairs = _pairs(df, both, MAX_PAIRS_IN_ONE_AGGREGATE, with_last=True)
    out = pairs.select(F.col("feature1").alias("feature"), F.abs("corr").alias("abs_corr"))
    return _top(out, "abs_corr", k)


def _top(scores: DataFrame, score: str, k: int | None) -> DataFrame:
    scores = scores.orderBy(F.col(score).desc_nulls_last(), "feature")
    return scores if k is None else scores.limit(k)


def _per_class(df: DataFrame, cols: list[str], target: str, stats: str) -> DataFrame:
    """Aggregates of every column within every class, `{x}` standing for the column: one row per class and feature."""
    t = quoted(target)
    structs = [
        F.expr(f"struct({sql_text(c)} AS feature, {stats.format(x=f'x{i}')}) AS v{i}") for i, c in enumerate(cols)
    ]
    return (
        numbers(df.where(t.isNotNull()), cols, t.alias("class")).groupBy("class").agg(*structs)
        .selectExpr("class", f"inline(array({', '.join(f'v{i}' for i in range(len(cols)))}))")
    )


def chi2_scores(df: DataFrame, cols: list[str], target: str = "target", k: int | None = None) -> DataFrame:
    """Per-class sums against sums expected from the class shares: `feature`, `chi2_score`, `chi2_pval`.

    Defined for non-negative columns; a negative value is an error.
    """
    sums = _per_class(
        df, cols, target, "cast(count(*) AS double) AS n, coalesce(sum({x}), 0D) AS observed, min({x}) AS least")
    total = F.struct(F.sum("n").alias("n"), F.sum("observed").alias("observed"), F.min("least").alias("least"),
                     F.collect_list(F.struct("n", "observed")).alias("classes"), F.count("*").alias("k"))
    t = F.col("t")

    def term(c):
        expected = c["n"] / t["n"] * t["observed"]
        return F.try_divide((c["observed"] - expected) * (c["observed"] - expected), expected)

    score = F.aggregate(F.transform(t["classes"], term), F.lit(0.0), lambda a, b: a + b)
    checked = F.when(t["least"] < 0, F.raise_error(F.concat(F.col("feature"), F.lit(" has negative values"))).cast("double")).otherwise(score)
    scores = sums.groupBy("feature").agg(total.alias("t")).select(
        "feature", checked.alias("chi2_score"), (t["k"] - 1).cast("double").alias("df"))
    return _top(scores, "chi2_score", k).select("feature", "chi2_score", chi2_p_value("chi2_score", "df").alias("chi2_pval"))


def f_scores(df: DataFrame, cols: list[str], target: str = "target", k: int | None = None) -> DataFrame:
    """One-way analysis of variance: `feature`, `f_score`, `f_pval`."""
    moments = _per_class(
        df, cols, target, "cast(count({x}) AS double) AS n, avg({x}) AS mean, var_pop({x}) AS var").where("n > 0")
    sums = moments.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.collect_list(F.struct("n", "mean")).alias("classes"), F.count("*").cast("double").alias("k"),
    )
    between = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * F.pow(c["mean"] - F.col("mean"), 2))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    score = F.try_divide(F.try_divide(between, df1), F.try_divide(F.col("within"), df2))
    scores = sums.select("feature", score.alias("f_score"), df1.alias("df1"), df2.alias("df2"))
    return _top(scores, "f_score", k).select("feature", "f_score", f_p_value("f_score", "df1", "df2").alias("f_pval"))


def mutual_info(df: DataFrame, cols: list[str], target: str = "target", bins: int | None = None, k: int | None = None) -> DataFrame:
    """Plug-in mutual information with the target, whatever its classes, in nats: `feature`, `mutual_info`.

    For coded columns, which are taken value by value; with `bins` the columns are first cut at their quantiles. For
    continuous columns use `nearest_mutual_info`: by single values a near-unique column knows every target.
    """
    cuts = quantile_values(df, cols, [i / bins for i in range(1, bins)]) if bins else {}

    def level(i, c):
        if not bins:
            return f"x{i}"
        steps = [f"CASE WHEN x{i} > {double_text(cut)} THEN 1D ELSE 0D END" for cut in sorted(set(cuts[c]) - {None})]
        return f"CASE WHEN x{i} IS NOT NULL THEN {' + '.join(steps) or '0D'} END"

    t = quoted(target)
    levels = [f"struct({sql_text(c)} AS feature, {level(i, c)} AS value)" for i, c in enumerate(cols)]
    long = numbers(df.where(t.isNotNull()), cols, t.alias("_class")).selectExpr(
        "_class", f"inline(array({', '.join(levels)}))").where("value IS NOT NULL")
    return plug_in_information(long.groupBy("feature", "value", "_class").agg(F.count("*").alias("n")), k)


def plug_in_information(joint: DataFrame, k: int | None = None) -> DataFrame:
    """Mutual information from the counts `n` per `feature`, `value` and `_class`."""
    # with g(n) = n ln n:  N * I = sum g(n_value_class) - sum g(n_value) - sum g(n_class) + g(N)

    def term(counts, name):
        return counts.groupBy("feature").agg(F.sum(n_log_n(F.col("n"))).alias(name), F.sum("n").alias(f"{name}_n"))

    by_value = term(joint.groupBy("feature", "value").agg(F.sum("n").alias("n")), "value_term")
    by_class = term(joint.groupBy("feature", "_class").agg(F.sum("n").alias("n")), "class_term")
    sums = term(joint, "joint_term").join(by_value, "feature").join(by_class, "feature")
    n = F.col("joint_term_n")
    info = (F.col("joint_term") - F.col("value_term") - F.col("class_term") + n_log_n(n)) / n
    return _top(sums.select("feature", info.alias("mutual_info")), "mutual_info", k)


def jittered(value: Column, key: Column, column: str, seed: int = 42) -> Column:
    """The value moved by a tiny repeatable amount, so that equal values have an order."""
    draw = F.pmod(F.xxhash64(key, F.lit(f"{column}|{seed}")), F.lit(1 << 40)) / float(1 << 40)
    return value + (draw - 0.5) * 1e-10 * F.greatest(F.abs(value), F.lit(1.0))


def nearest_mutual_info(
    df: DataFrame, cols: list[str], key: str, target: str = "target", neighbours: int = 3, k: int | None = None,
    range_rows: int = 100_000,
) -> DataFrame:
    """Nearest-neighbour mutual information of continuous columns with a class, in nats: `feature`, `mutual_info`.

    For every row: the distance to its `neighbours`-th neighbour within its class, then the rows of any class nearer than
    that. With psi the digamma function, I = psi(N) + mean(psi(k) - psi(n_class) - psi(m)), not below 0; classes of one row
    are left out, smaller classes use all the neighbours they have. Ties are broken by a jitter that follows `key`. Values
    are cut into ranges; counts inside a radius are differences of running numbers, found by a merge of interval ends
    with values, so no task holds a column.
    """
    t = quoted(target)
    spread = [F.struct(F.lit(c).alias("feature"), jittered(number(df, c), quoted(key).cast("string"), c).alias("x")) for c in cols]
    rows = df.where(t.isNotNull()).select(t.alias("c"), quoted(key).cast("string").alias("id"), F.inline(F.array(*spread))) \
        .where("x IS NOT NULL")
    sizes = rows.groupBy("feature", "c").agg(F.count("*").alias("n_c")).where("n_c > 1")
    rows = checkpointed(rows.join(sizes, ["feature", "c"]))
    ranked = numbered_in_ranges(rows, ["feature", "c"], "x", "place", range_rows)
    # The k-th neighbour of the i-th of the sorted values lies within i - k .. i + k.
    within = ranked.select("feature", "c", "id", "x", "n_c", "place", F.least(F.lit(neighbours), F.col("n_c") - 1).alias("k"))
    steps = F.array(*[F.lit(s) for s in range(-neighbours, neighbours + 1) if s])
    seen = within.select("feature", "c", "x", F.explode(steps).alias("s"), "place").select(
        "feature", "c", (F.col("place") + F.col("s")).alias("place"), F.col("x").alias("other"))
    radius = within.join(seen, ["feature", "c", "place"]).groupBy("feature", "c", "id", "x", "n_c", "k").agg(
        F.array_sort(F.collect_list(F.abs(F.col("x") - F.col("other")))).alias("d")).withColumn("r", F.element_at("d", F.col("k").cast("int")))
    radius = checkpointed(radius.drop("d"))
    # Interval ends count the values at or before them: strictly inside is below x + r and above x - r. The radius is
    # shortened by the rounding of x + r, which would else let the neighbour at its end in or out at random.
    radius = radius.withColumn("r", F.col("r") - 1e-15 * (F.abs("x") + F.col("r")))
    ends = radius.select("feature", "id", "k", "n_c", F.inline(F.array(
        F.struct((F.col("x") + F.col("r")).alias("x"), F.lit(0).alias("kind")),
        F.struct((F.col("x") - F.col("r")).alias("x"), F.lit(2).alias("kind")))))
    values = rows.select("feature", F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("k"),
                         F.lit(None).cast("long").alias("n_c"), "x", F.lit(1).alias("kind"))
    merged = checkpointed(ends.withColumn("k", F.col("k").cast("long")).unionByName(values))
    counted = numbered_in_ranges(merged, ["feature"], "x", "before", range_rows, also="kind", weight=(F.col("kind") == 1).cast("long"))
    m = counted.where("kind <> 1").groupBy("feature", "id", "k", "n_c").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("before")).otherwise(-F.col("before"))).alias("m"))
    total = rows.groupBy("feature").agg(F.count("*").alias("n"))
    found = m.groupBy("feature").agg(F.avg(digamma(F.col("k")) - digamma(F.col("n_c")) - digamma(F.greatest("m", F.lit(1)))).alias("mean"))
    info = found.join(total, "feature").select("feature", F.greatest(F.lit(0.0), F.col("mean") + digamma(F.col("n"))).alias("mutual_info"))
    return _top(info, "mutual_info", k)
