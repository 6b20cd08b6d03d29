"""Metrics on a deterministic score, model training and scoring."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.operators import metrics, models
from tallyframe.operators.boosting import BoostedTrees
from tallyframe.operators.clean import with_target
from tallyframe.operators.features import build_preprocessor, feature_names
from tallyframe.plans.classifier import train_classifiers

SCORED_SQL = """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, round(l_discount * 10, 1) AS score,
CASE WHEN l_discount * 10 > 0.55 THEN 1 ELSE 0 END AS prediction FROM lineitem"""


def scored_lines(spark, d):
    li = with_target(table(spark, d, "lineitem"), "l_returnflag", "[AN]", "label")
    s = F.col("l_discount") * 10
    return li.select("label", F.round(s, 1).alias("score"), F.when(s > 0.55, 1).otherwise(0).alias("prediction"))


@query(f"SELECT round(avg((label = prediction)::INT), 9) AS accuracy FROM ({SCORED_SQL})")
def accuracy_lineitem(spark, d):
    return rounded(metrics.accuracy(scored_lines(spark, d)), 9)


@query(f"""SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM ({SCORED_SQL})""")
def confusion_matrix_lineitem(spark, d):
    return metrics.confusion_matrix(scored_lines(spark, d))


@query(f"""
WITH s AS ({SCORED_SQL}), k AS (
  SELECT c, count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (prediction = c), 0)::DOUBLE AS p,
         count(*) FILTER (label = c AND prediction = c) / nullif(count(*) FILTER (label = c), 0)::DOUBLE AS r,
         count(*) FILTER (label = c) AS support FROM s, (VALUES (0), (1)) v(c) GROUP BY c),
f AS (SELECT c, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, support FROM k),
a AS (SELECT avg((label = prediction)::INT) AS acc, count(*) AS n FROM s),
u AS (SELECT c::VARCHAR AS class, p, r, f, support FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM a
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), sum(support) FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support::BIGINT AS support FROM u""")
def classification_report_lineitem(spark, d):
    return rounded(metrics.classification_report(scored_lines(spark, d)))


STEPS_SQL = """g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (ORDER BY score DESC))"""
AUC = "round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE, 6)"
AP = "round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6)"


@query(f"WITH s AS ({SCORED_SQL}), {STEPS_SQL} SELECT {AUC} AS roc_auc FROM c")
def roc_auc_lineitem(spark, d):
    return rounded(metrics.roc_auc(scored_lines(spark, d)))


@query(f"WITH s AS ({SCORED_SQL}), {STEPS_SQL} SELECT {AP} AS pr_auc FROM c")
def average_precision_lineitem(spark, d):
    return rounded(metrics.average_precision(scored_lines(spark, d)))


@query(f"""WITH s AS (SELECT CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label, value AS score FROM events),
{STEPS_SQL} SELECT {AUC} AS roc_auc, {AP} AS pr_auc FROM c""")
def ranking_metrics_events(spark, d):
    e = with_target(table(spark, d, "events"), "event_type", "^(click|view|error|signup)$", "label")
    return rounded(metrics.ranking_metrics(e, "label", "value"))


@query(f"""SELECT *, CASE WHEN prediction = 1 THEN '>$50K' ELSE '≤$50K' END AS predicted_income,
round(probability_high * 100, 6) AS confidence_pct
FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS prediction,
      o_totalprice / 500000 AS probability_high FROM orders)""")
def label_prediction_orders(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("prediction"),
        (F.col("o_totalprice") / 500000).alias("probability_high"))
    return models.label_prediction(o).withColumn("confidence_pct", F.round("confidence_pct", 6))


# Orders as customers: the target is a large order, the features are known columns of the order.
ORDER_FEATURES = ["day", "custkey", "o_orderstatus", "o_orderpriority", "education"]


def order_rows(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).alias("target"),
        F.dayofyear("o_orderdate").alias("day"), F.col("o_custkey").alias("custkey"), "o_orderstatus",
        "o_orderpriority", F.concat(F.lit("Priority "), "o_orderpriority", F.lit(" and more words")).alias("education"))


# Trees grow to their full depth on a target with noise, 200 of them for minutes: fewer show the same.
NOISY_TREES = 40


def line_rows(spark, d):
    """Line items as training rows: the positive class are the dear ones, which the features tell with noise."""
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        key.alias("line"), F.when(F.col("l_extendedprice") > 60000, 1).otherwise(0).alias("target"),
        "l_quantity", "l_discount", "l_linestatus", "l_returnflag")


@query()
def logistic_scores_orders(spark, d):
    """Preprocess and fit a logistic model on all orders, then score them for display."""
    rows = order_rows(spark, d)
    prep = build_preprocessor(["day", "custkey"], ["o_orderstatus", "o_orderpriority"]).fit(rows)
    x = prep.transform(rows).select("target", "features").persist()
    model = models.with_preprocessor(prep, models.logistic(x.count()).fit(x))
    return models.score_customers(model, rows)


@query()
def forest_importance_lineitem(spark, d):
    """Feature importances of a forest on all line items."""
    rows = line_rows(spark, d)
    prep = build_preprocessor(["l_quantity", "l_discount"], ["l_linestatus", "l_returnflag"]).fit(rows)
    model = models.forest(num_trees=NOISY_TREES).fit(prep.transform(rows).select("target", "features"))
    return models.feature_importance(spark, model, feature_names(prep))


@query()
def compare_models_lineitem(spark, d):
    """The whole classifier job: metrics of the three models on a target that no feature decides."""
    return rounded(train_classifiers(
        line_rows(spark, d), "line", features=["l_quantity", "l_discount", "l_linestatus", "l_returnflag"],
        num_trees=NOISY_TREES, rounds=NOISY_TREES)["table"])


def _split_sql(feature, x):
    cuts = ", ".join(f"{i / 256}" for i in range(256))
    return f"""SELECT '{feature}' AS feature, c AS cut, sum(0.5 - target) FILTER (x <= c) AS gl, 0.25 * count(*) FILTER (x <= c) AS hl,
  sum(0.5 - target) AS g, 0.25 * count(*) AS h FROM (SELECT {x}::DOUBLE AS x, target FROM t),
  (SELECT DISTINCT unnest(quantile_cont({x}::DOUBLE, [{cuts}])) AS c FROM t) WHERE c < (SELECT max({x}) FROM t) GROUP BY c"""


@query(f"""WITH t AS (SELECT dayofyear(o_orderdate) AS day, o_totalprice AS price, (o_orderpriority = '1-URGENT' OR o_totalprice > 300000)::INT AS target
  FROM orders), s AS ({_split_sql("day", "day")} UNION ALL {_split_sql("price", "price")}),
g AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM s WHERE hl >= 1 AND h - hl >= 1)
SELECT feature, round(cut, 6) AS cut, round(gain, 6) AS gain, round(-gl / (hl + 1) * 0.1, 9) AS left_weight,
  round(-(g - gl) / (h - hl + 1) * 0.1, 9) AS right_weight FROM g ORDER BY gain DESC, feature, cut LIMIT 1""")
def boosted_first_split_orders(spark, d):
    """The first split of boosted trees on all orders: feature, cut, gain and the weights of its leaves."""
    rows = table(spark, d, "orders").select(
        F.dayofyear("o_orderdate").alias("day"), F.col("o_totalprice").alias("price"),
        F.when((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 300000), 1).otherwise(0).alias("target"))
    names = ["day", "price"]
    x = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    (tree,) = BoostedTrees(labelCol="target", rounds=1, maxDepth=1, rowShare=1.0, featureShare=1.0).fit(x).all_trees()
    row = (names[tree["feature"][0]], tree["cut"][0], tree["gain"][0], tree["value"][tree["left"][0]], tree["value"][tree["right"][0]])
    found = spark.createDataFrame([row], "feature string, cut double, gain double, left_weight double, right_weight double")
    return found.select("feature", F.round("cut", 6).alias("cut"), F.round("gain", 6).alias("gain"),
                        F.round("left_weight", 9).alias("left_weight"), F.round("right_weight", 9).alias("right_weight"))
