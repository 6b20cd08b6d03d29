"""Encoding, correlation and feature scores."""

from itertools import combinations

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.operators import scores
from tallyframe.operators.clean import with_target
from tallyframe.plans.exploration import insights

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
FEATURES = [*NUMBERS, "l_linestatus", "l_returnflag", "l_quantity_twice", "flat"]
CODED = ["l_linestatus", "l_returnflag"]

CODED_SQL = """
SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0.02) AS l_tax,
  l_linenumber::DOUBLE AS l_linenumber, dense_rank() OVER (ORDER BY l_linestatus) - 1.0::DOUBLE AS l_linestatus,
  dense_rank() OVER (ORDER BY coalesce(nullif(l_returnflag, 'A'), 'Unknown')) - 1.0::DOUBLE AS l_returnflag,
  2 * l_quantity + l_discount AS l_quantity_twice, 7.0::DOUBLE AS flat,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target
FROM lineitem"""


def coded_lines(spark, d):
    li = with_target(table(spark, d, "lineitem"), "l_returnflag", "[AN]").withColumns({
        "l_tax": F.nullif("l_tax", F.lit(0.02)), "l_returnflag": F.nullif("l_returnflag", F.lit("A")),
        "l_quantity_twice": 2 * F.col("l_quantity") + F.col("l_discount"), "flat": F.lit(7.0),
    }).select(*FEATURES, "target")
    return scores.label_encode(li, CODED)


def _corr(a, b):
    """Centred Pearson correlation over the rows where both columns are known; null if one is constant."""
    return (f"(SELECT round(sum((x - mx) * (y - my)) / nullif(sqrt(sum((x - mx) ** 2)) * sqrt(sum((y - my) ** 2)), 0), 6) "
            f"FROM (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM "
            f"(SELECT {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))")


def _pairs_sql(cols):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS f1, '{b}' AS f2, {i} AS i, {j} AS j, {_corr(a, b)} AS corr"
        for (i, a), (j, b) in combinations(enumerate(cols), 2))


ALL = [*FEATURES, "target"]
WITH_PAIRS = f"WITH t AS ({CODED_SQL}), p AS ({_pairs_sql(ALL)})"


@query("""
WITH t AS (SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INT) AS o_orderpriority,
       CAST(dense_rank() OVER (ORDER BY s) - 1 AS INT) AS o_orderstatus FROM t""")
def label_encode_orders(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_orderstatus")
    return scores.label_encode(o, ["o_orderpriority", "o_orderstatus"])


@query(f"""{WITH_PAIRS}
SELECT f1 AS feature1, f2 AS feature2, i::INT AS i, j::INT AS j, corr FROM p
UNION ALL SELECT f2, f1, j, i, corr FROM p
UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', '{c}', {i}, {i}, {'NULL' if c == 'flat' else '1.0::DOUBLE'}" for i, c in enumerate(ALL)))
def correlation_matrix_lineitem(spark, d):
    return rounded(scores.correlation_matrix(coded_lines(spark, d), ALL))


@query(f"{WITH_PAIRS} SELECT f1 AS feature1, f2 AS feature2, corr AS correlation FROM p WHERE abs(corr) > 0.7")
def high_corr_pairs_lineitem(spark, d):
    return rounded(scores.high_corr_pairs(coded_lines(spark, d), ALL))


@query(f'{WITH_PAIRS} SELECT f2 AS "row", f1 AS col, corr FROM p')
def corr_lower_triangle_lineitem(spark, d):
    return rounded(scores.corr_lower_triangle(coded_lines(spark, d), ALL))


@query(f"{WITH_PAIRS} SELECT f1 AS feature, abs(corr) AS abs_corr FROM p WHERE f2 = 'target' ORDER BY abs_corr DESC NULLS LAST, f1 LIMIT 5")
def target_correlation_lineitem(spark, d):
    return rounded(scores.target_correlation(coded_lines(spark, d), FEATURES, "target", 5))


def _long_sql(cols):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS x, target FROM t" for c in cols)


# erfc by the series of erf; beyond z = 4.5 it is below a billionth.
def _erfc(z):
    return (f"(CASE WHEN {z} > 4.5 THEN 0.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), "
            f"lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(greatest({z}, 1e-30)) - lgamma(n + 1.0)) / (2 * n + 1))) END)")


@query(f"""WITH t AS ({CODED_SQL}), l AS ({_long_sql(FEATURES)}),
c AS (SELECT feature, target, count(*)::DOUBLE AS n, coalesce(sum(x), 0) AS o FROM l GROUP BY ALL),
e AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) * sum(o) OVER (PARTITION BY feature) AS e FROM c),
s AS (SELECT feature, sum((o - e) ** 2 / e) AS x FROM e GROUP BY 1)
SELECT feature, round(x, 6) AS chi2_score, round({_erfc("sqrt(x / 2)")}, 6) AS chi2_pval FROM s""")
def chi2_scores_lineitem(spark, d):
    """Two classes leave one degree of freedom, whose tail is an error function."""
    return rounded(scores.chi2_scores(coded_lines(spark, d), FEATURES))


@query(f"""WITH t AS ({CODED_SQL}), l AS ({_long_sql([c for c in FEATURES if c != 'flat'])}),
c AS (SELECT feature, target, count(x)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM l WHERE x IS NOT NULL GROUP BY ALL),
g AS (SELECT feature, sum(n * m) / sum(n) AS gm FROM c GROUP BY 1),
s AS (SELECT feature, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f, sum(n) - count(*) AS nu
FROM c JOIN g USING (feature) GROUP BY 1)
SELECT feature, round(f, 4) AS f_score, round({_erfc("(sqrt(f) * (1 - 1 / (4 * nu)) / sqrt(1 + f / (2 * nu)) / sqrt(2.0::DOUBLE))")}, 4) AS f_pval FROM s""")
def f_scores_lineitem(spark, d):
    """With two classes and thousands of rows the root of F is nearly normal; the correction leaves an error below 1e-7."""
    cols = [c for c in FEATURES if c != "flat"]
    return rounded(scores.f_scores(coded_lines(spark, d), cols), 4)


MI_SQL = """
j AS (SELECT feature, v, target, count(*)::DOUBLE AS n FROM l WHERE v IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY feature, v) AS nv, sum(n) OVER (PARTITION BY feature, target) AS nt,
      sum(n) OVER (PARTITION BY feature) AS total FROM j)
SELECT feature, round(sum(n / total * ln(n * total / (nv * nt))), 6) AS mutual_info FROM m GROUP BY 1"""


@query(f"WITH t AS ({CODED_SQL}), l AS (SELECT feature, x AS v, target FROM ({_long_sql(FEATURES)})), {MI_SQL}")
def mutual_info_lineitem(spark, d):
    return rounded(scores.mutual_info(coded_lines(spark, d), FEATURES))


def _binned_sql(c):
    cuts = [f"quantile_cont({c}::DOUBLE, {i / 10})" for i in range(1, 10)]
    return f"""SELECT '{c}' AS feature, target, CASE WHEN {c} IS NOT NULL THEN
len(list_filter(list_distinct((SELECT [{', '.join(cuts)}] FROM t)), lambda q: {c} > q)) END AS v FROM t"""


@query(f"WITH t AS ({CODED_SQL}), l AS ({' UNION ALL '.join(_binned_sql(c) for c in NUMBERS)}), {MI_SQL}")
def mutual_info_binned_lineitem(spark, d):
    return rounded(scores.mutual_info(coded_lines(spark, d), NUMBERS, bins=10))


@query(f"""{WITH_PAIRS}, n AS (SELECT count(*) AS rows, count(*) FILTER (target = 0) AS class_0,
count(*) FILTER (target = 1) AS class_1 FROM t)
SELECT rows, 9 AS features, class_0, class_1, 2 AS categoricals,
  (SELECT count(*) FROM p WHERE abs(corr) > 0.7) AS correlated_pairs,
  (SELECT string_agg(f1, ', ' ORDER BY abs(corr) DESC, f1) FROM
    (SELECT f1, corr FROM p WHERE f2 = 'target' ORDER BY abs(corr) DESC NULLS LAST, f1 LIMIT 5)) AS top_features
FROM n""")
def insights_lineitem(spark, d):
    li = with_target(table(spark, d, "lineitem"), "l_returnflag", "[AN]").withColumns({
        "l_tax": F.nullif("l_tax", F.lit(0.02)), "l_returnflag": F.nullif("l_returnflag", F.lit("A")),
        "l_quantity_twice": 2 * F.col("l_quantity") + F.col("l_discount"), "flat": F.lit(7.0),
    }).select(*FEATURES, "target")
    return insights(li).withColumn("top_features", F.concat_ws(", ", "top_features"))
