"""Group profiles, ranks, bands, plot data and clustering."""

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.operators import cluster, groups
from tallyframe.operators.clean import with_target
from tallyframe.plans import segmentation
from tallyframe.session import checkpointed

# The segmentation job on line items: suppliers play the groups, returned lines the positive class.
SUPPLIER_STATS = {
    "l_quantity": ["mean", "std", "count"], "l_tax": ["mean", "std"], "l_extendedprice": ["mean", "median"],
    "l_discount": ["mean", "median"], "target": ["mean", "count"], "l_linenumber": ["mean", "std"],
}
SUPPLIER_FEATURES = {
    "avg_age": "l_quantity_mean", "avg_weeks_worked": "l_linenumber_mean", "high_income_rate": "target_mean",
    "avg_capital_gains": "l_extendedprice_mean", "sample_size": "target_count",
}
PROFILE_SQL = """
SELECT l_suppkey, round_even(avg(l_quantity), 2) AS l_quantity_mean, round_even(stddev_samp(l_quantity), 2) AS l_quantity_std,
  count(l_quantity) AS l_quantity_count, round_even(avg(l_tax), 2) AS l_tax_mean, round_even(stddev_samp(l_tax), 2) AS l_tax_std,
  round_even(avg(l_extendedprice), 2) AS l_extendedprice_mean,
  round_even(quantile_cont(l_extendedprice, 0.5), 2) AS l_extendedprice_median,
  round_even(avg(l_discount), 2) AS l_discount_mean, round_even(quantile_cont(l_discount, 0.5), 2) AS l_discount_median,
  round_even(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 2) AS target_mean, count(*) AS target_count,
  round_even(avg(l_linenumber), 2) AS l_linenumber_mean, round_even(stddev_samp(l_linenumber), 2) AS l_linenumber_std
FROM lineitem GROUP BY l_suppkey"""
FEATURES_SQL = f"""
SELECT l_suppkey, l_quantity_mean AS avg_age, l_linenumber_mean AS avg_weeks_worked, target_mean AS high_income_rate,
       l_extendedprice_mean AS avg_capital_gains, target_count AS sample_size
FROM ({PROFILE_SQL}) WHERE target_count >= 100"""


def supplier_lines(spark, d):
    return with_target(table(spark, d, "lineitem"), "l_returnflag", "[AN]")


def supplier_features(spark, d):
    """The group table, stored once as in the segmentation job, since the operators below read it several times."""
    return checkpointed(segmentation.group_features(
        supplier_lines(spark, d), "l_suppkey", SUPPLIER_STATS, SUPPLIER_FEATURES, "target_count", 100))


@query(PROFILE_SQL)
def group_profile_lineitem(spark, d):
    return groups.group_profile(supplier_lines(spark, d), "l_suppkey", SUPPLIER_STATS)


@query(f"SELECT * FROM ({PROFILE_SQL}) WHERE target_count >= 600")
def min_group_size_lineitem(spark, d):
    profile = groups.group_profile(supplier_lines(spark, d), "l_suppkey", SUPPLIER_STATS)
    return groups.min_group_size(profile, "target_count", 600)


@query(FEATURES_SQL)
def segment_features_lineitem(spark, d):
    return segmentation.group_features(
        supplier_lines(spark, d), "l_suppkey", SUPPLIER_STATS, SUPPLIER_FEATURES, "target_count", 100)


@query("""SELECT p_brand, round_even(avg(p_size), 3) AS p_size_mean, count(p_size) AS p_size_count,
round_even(avg(p_retailprice), 3) AS p_retailprice_mean, round_even(quantile_cont(p_retailprice, 0.5), 3) AS p_retailprice_median
FROM part GROUP BY 1""")
def round_stats_part(spark, d):
    stats = {"p_size": ["mean", "count"], "p_retailprice": ["mean", "median"]}
    return groups.group_profile(table(spark, d, "part"), "p_brand", stats, digits=3)


@query("SELECT DISTINCT p_brand FROM part")
def distinct_keys_part(spark, d):
    return groups.distinct_keys(table(spark, d, "part"), "p_brand")


@query(f"""SELECT *, row_number() OVER (ORDER BY high_income_rate DESC, l_suppkey) AS rank FROM ({FEATURES_SQL})""")
def rank_groups_lineitem(spark, d):
    return groups.rank_groups(supplier_features(spark, d), "high_income_rate", "l_suppkey")


@query("""SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders""")
def rank_all_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return groups.rank_groups(o, "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_orders(spark, d):
    return groups.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey")


@query(f"SELECT * FROM ({FEATURES_SQL}) ORDER BY high_income_rate DESC, l_suppkey LIMIT 1")
def best_supplier(spark, d):
    return groups.best_by(supplier_features(spark, d), "high_income_rate", "l_suppkey")


@query(f"""
WITH f AS ({FEATURES_SQL}),
q AS (SELECT quantile_cont(high_income_rate, 0.25) AS lo, quantile_cont(high_income_rate, 0.75) AS hi FROM f)
SELECT f.*, 'high' AS band FROM f, q WHERE high_income_rate >= hi
UNION ALL SELECT f.*, 'mid' FROM f, q WHERE high_income_rate < hi AND high_income_rate > lo
UNION ALL SELECT f.*, 'low' FROM f, q WHERE high_income_rate <= lo""")
def quartile_bands_lineitem(spark, d):
    return groups.quartile_bands(supplier_features(spark, d), "high_income_rate")


@query(f"""SELECT a.l_suppkey, a.avg_age, b.sample_size FROM ({FEATURES_SQL}) a JOIN ({FEATURES_SQL}) b USING (l_suppkey)""")
def attach_size_lineitem(spark, d):
    features = supplier_features(spark, d)
    return groups.attach_size(features.select("l_suppkey", "avg_age"), features, "l_suppkey")


@query("""
WITH p AS (SELECT 'Number ' || p_brand || ' of the parts' AS key, round_even(avg(p_size), 2) AS avg_age,
  round_even(avg(p_retailprice), 2) AS avg_weeks_worked,
  round_even(avg(CASE WHEN p_type = 'PROMO' THEN 0::DOUBLE ELSE 1 END), 2) AS high_income_rate,
  count(*) * 100 AS sample_size FROM part GROUP BY p_brand)
SELECT key, avg_age AS x, avg_weeks_worked AS y, high_income_rate AS z, sample_size,
  round(log10(sample_size::DOUBLE) * 50, 6) AS size_3d, round(log10(sample_size::DOUBLE) * 30, 6) AS size_2d,
  CASE WHEN length(key) > 20 THEN left(key, 20) || '...' ELSE key END AS legend_3d,
  CASE WHEN length(key) > 15 THEN left(key, 15) || '...' ELSE key END AS legend_2d,
  CASE WHEN sample_size > 5000 THEN left(key, 15) || '...' END AS label_3d,
  CASE WHEN sample_size > 8000 THEN left(key, 12) || '...' END AS label_2d,
  row_number() OVER (ORDER BY key) - 1 AS color_index FROM p""")
def segment_plot_data_part(spark, d):
    profile = groups.group_profile(
        with_target(table(spark, d, "part"), "p_type", "PROMO"), "p_brand",
        {"p_size": ["mean"], "p_retailprice": ["mean"], "target": ["mean", "count"]})
    features = profile.select(
        F.concat(F.lit("Number "), "p_brand", F.lit(" of the parts")).alias("key"), F.col("p_size_mean").alias("avg_age"),
        F.col("p_retailprice_mean").alias("avg_weeks_worked"), F.col("target_mean").alias("high_income_rate"),
        (F.col("target_count") * 100).alias("sample_size"))
    return rounded(groups.segment_plot_data(features, "key"))


CLUSTERED_SQL = f"""SELECT *, CAST(CASE WHEN avg_capital_gains > 50000 THEN 0 WHEN high_income_rate > 0.33 THEN 1 ELSE 2 END AS INT)
  AS cluster FROM ({FEATURES_SQL})"""


def clustered_suppliers(spark, d):
    number = F.when(F.col("avg_capital_gains") > 50000, 0).when(F.col("high_income_rate") > 0.33, 1).otherwise(2)
    return supplier_features(spark, d).withColumn("cluster", number)


@query(f"""SELECT cluster, count(*) AS size, round(avg(avg_age), 6) AS mean_avg_age,
round(avg(avg_weeks_worked), 6) AS mean_avg_weeks_worked, round(avg(high_income_rate), 6) AS mean_high_income_rate
FROM ({CLUSTERED_SQL}) GROUP BY 1""")
def cluster_summary_lineitem(spark, d):
    return rounded(groups.cluster_summary(
        clustered_suppliers(spark, d), ["avg_age", "avg_weeks_worked", "high_income_rate"]))


@query(f"SELECT cluster, l_suppkey AS member FROM ({CLUSTERED_SQL})")
def cluster_members_lineitem(spark, d):
    return groups.cluster_members(clustered_suppliers(spark, d), "l_suppkey")


@query(f"""
WITH p AS ({CLUSTERED_SQL}),
pairs AS (SELECT a.l_suppkey AS key, a.cluster AS mine, b.cluster AS theirs,
  sqrt((a.avg_age - b.avg_age) ** 2 + (a.avg_weeks_worked - b.avg_weeks_worked) ** 2) AS dist FROM p a, p b),
n AS (SELECT cluster, count(*) AS n FROM p GROUP BY 1),
s AS (SELECT key, mine, theirs, sum(dist) AS total, any_value(n) AS n FROM pairs JOIN n ON n.cluster = theirs GROUP BY ALL),
ab AS (SELECT key, max(CASE WHEN mine = theirs THEN n END) AS size,
  max(CASE WHEN mine = theirs AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN mine <> theirs THEN total / n END) AS b
  FROM s GROUP BY key)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette_lineitem(spark, d):
    return rounded(cluster.silhouette(
        clustered_suppliers(spark, d), "l_suppkey", ["avg_age", "avg_weeks_worked"], "cluster"))


@query()
def choose_k_part(spark, d):
    """Inertia and silhouette for k = 2..6 over the brands' scaled features."""
    features = checkpointed(segmentation.group_features(
        with_target(table(spark, d, "part"), "p_type", "PROMO"), "p_brand",
        {"p_size": ["mean"], "p_retailprice": ["mean"], "target": ["mean", "count"]},
        {"avg_age": "p_size_mean", "avg_weeks_worked": "p_retailprice_mean", "high_income_rate": "target_mean",
         "sample_size": "target_count"}, "target_count", 1))
    return segmentation.cluster_groups(features, "p_brand")[1]


# On a line the best clusters are ranges of neighbours, so SQL can try all cuts into two and three.
LINE_SQL = """
WITH r AS (SELECT p_brand, round_even(avg(p_retailprice), 2) AS x, row_number() OVER (ORDER BY round_even(avg(p_retailprice), 2), p_brand) AS i,
  count(*) OVER () AS n FROM part GROUP BY 1),
s AS (SELECT l.i AS lo, h.i AS hi, any_value(l.n) AS n, var_pop(m.x) * count(*) AS cost
  FROM r l JOIN r h ON l.i <= h.i JOIN r m ON m.i BETWEEN l.i AND h.i GROUP BY 1, 2),
cuts AS (
  SELECT 2 AS k, a.hi AS c1, a.n AS c2, a.cost + b.cost AS cost FROM s a JOIN s b ON b.lo = a.hi + 1 AND b.hi = a.n WHERE a.lo = 1
  UNION ALL
  SELECT 3, a.hi, b.hi, a.cost + b.cost + c.cost
  FROM s a JOIN s b ON b.lo = a.hi + 1 JOIN s c ON c.lo = b.hi + 1 AND c.hi = c.n WHERE a.lo = 1),
best AS (SELECT k, arg_min(c1, cost) AS c1, arg_min(c2, cost) AS c2, min(cost) AS cost FROM cuts GROUP BY 1),
p AS (SELECT k, i, x, (i > c1)::INT + (i > c2)::INT AS c FROM r, best),
d AS (SELECT a.k, a.i, a.c AS mine, b.c AS theirs, sum(abs(a.x - b.x)) AS total, count(*) AS n FROM p a JOIN p b USING (k) GROUP BY ALL),
ab AS (SELECT k, i, max(CASE WHEN mine = theirs THEN n END) AS size,
  max(CASE WHEN mine = theirs AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN mine <> theirs THEN total / n END) AS b
  FROM d GROUP BY k, i),
q AS (SELECT k, avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM ab GROUP BY 1)
SELECT k, round(cost, 6) AS inertia, round(s, 6) AS silhouette, s = max(s) OVER () AS chosen FROM best JOIN q USING (k)"""


@query(LINE_SQL)
def choose_k_line_part(spark, d):
    """Choice between two and three clusters of the brands on one measure, where the best clustering is known."""
    features = checkpointed(groups.group_profile(table(spark, d, "part"), "p_brand", {"p_retailprice": ["mean"]}))
    found, best, _ = cluster.choose_k(features, "p_brand", ["p_retailprice_mean"], ks=(2, 3), n_init=20)
    return rounded(found).withColumn("chosen", F.col("k") == best)


@query()
def segment_lineitem(spark, d):
    """The whole segmentation job: every supplier with its cluster."""
    return segmentation.segment(
        supplier_lines(spark, d), "l_suppkey", SUPPLIER_STATS, SUPPLIER_FEATURES, "target_count", 100
    )["features"]
