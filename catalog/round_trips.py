"""Operators that write and read back, and models on targets that one column determines, so that SQL knows the result."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.functions.expressions import strict_number
from tallyframe.operators import cluster, metrics, models, profile, scores
from tallyframe.operators.clean import with_target
from tallyframe.operators.features import build_preprocessor, feature_names
from tallyframe.plans.classifier import train_classifiers
from tallyframe.session import shared_folder
from tallyframe.sources.stored_models import load_model, save_model
from tallyframe.sources.tables import convert_headerless, read_column_names, read_table, write_segments


@query("""SELECT column_name AS "column", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'bigint' END AS dtype,
(SELECT count(*) FROM part) AS "rows" FROM information_schema.columns WHERE table_name = 'part'""")
def converted_part(spark, d):
    """A headerless file and its column list become a headed table whose types are inferred again."""
    part, folder = table(spark, d, "part"), shared_folder(spark)
    names = spark.createDataFrame([(n,) for n in part.columns], "value string")
    names.coalesce(1).write.text(f"{folder}/names")
    part.select(F.concat_ws(",", *[F.col(c).cast("string") for c in part.columns])).write.text(f"{folder}/lines")
    assert read_column_names(spark, f"{folder}/names") == part.columns
    convert_headerless(spark, f"{folder}/names", f"{folder}/lines", f"{folder}/table")
    back = read_table(spark, f"{folder}/table")
    types = spark.createDataFrame(back.dtypes, "column string, dtype string")
    return types.crossJoin(back.agg(F.count("*").alias("rows")))  # six rows and one


@query("SELECT o_orderstatus, ord, o_orderpriority || CASE WHEN ord = 1 THEN ',surplus' ELSE '' END AS line FROM ("
       "SELECT o_orderstatus, o_orderkey % 2 AS ord, o_orderpriority FROM orders)")
def ragged_lines_orders(spark, d):
    """Lines with a surplus field pass the conversion unchanged."""
    o, folder = table(spark, d, "orders"), shared_folder(spark)
    odd = F.col("o_orderkey") % 2
    spark.createDataFrame([("status",), ("ord",), ("priority",)], "value string").coalesce(1).write.text(f"{folder}/names")
    o.select(F.concat_ws(",", "o_orderstatus", odd.cast("string"), F.concat("o_orderpriority", F.when(odd == 1, ",surplus").otherwise("")))) \
        .write.text(f"{folder}/lines")
    convert_headerless(spark, f"{folder}/names", f"{folder}/lines", f"{folder}/table")
    fields = F.split("value", ",", 3)
    return spark.read.text(f"{folder}/table").where("value <> 'status,ord,priority'").select(
        fields[0].alias("o_orderstatus"), fields[1].cast("long").alias("ord"), fields[2].alias("line"))


@query("""SELECT CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'bigint' END AS dtype, count(*) AS columns
FROM information_schema.columns WHERE table_name = 'supplier' GROUP BY 1""")
def dtype_counts_supplier(spark, d):
    """Types of all columns as they are inferred from the text of every row."""
    folder = shared_folder(spark)
    table(spark, d, "supplier").write.option("header", True).csv(f"{folder}/supplier")
    return profile.dtype_counts(read_table(spark, f"{folder}/supplier"))


NATION_SQL = """SELECT s_nationkey::BIGINT AS nation, round(avg(s_acctbal), 2) AS rate, count(*) AS n FROM supplier GROUP BY 1"""


@query(f"SELECT 'by_key' AS file, nation, rate, n FROM ({NATION_SQL}) UNION ALL SELECT 'ranked', nation, rate, n FROM ({NATION_SQL})")
def segment_files_supplier(spark, d):
    """The two segment files, read back."""
    folder = shared_folder(spark)
    groups = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.round(F.avg("s_acctbal"), 2).alias("rate"), F.count("*").alias("n"))
    write_segments(groups, folder, "nation", "rate")
    one, two = (read_table(spark, f"{folder}/{name}", schema="nation long, rate double, n long") for name in ("by_key", "ranked"))
    return one.select(F.lit("by_key").alias("file"), "*").union(two.select(F.lit("ranked").alias("file"), "*"))


def urgent(spark, d):
    """Orders whose target the priority determines, with a column that says nothing about it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return with_target(o, "o_orderpriority", "^[2-5]-")


URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END"


def _fitted(rows, estimator):
    prep = build_preprocessor(["o_totalprice"], ["o_orderpriority"], "standard").fit(rows)
    return prep, models.with_preprocessor(prep, estimator(rows.count()).fit(prep.transform(rows).select("target", "features")))


@query(f"""SELECT o_orderkey, {URGENT} AS prediction, CASE WHEN {URGENT} = 1 THEN '>$50K' ELSE '≤$50K' END AS predicted_income,
true AS unchanged, row_number() OVER (ORDER BY o_orderkey) AS position FROM orders""")
def saved_logistic_orders(spark, d):
    """A logistic model is stored, loaded, and scores every order, numbered, as it did before."""
    from tallyframe.operators.groups import running_number

    rows, folder = urgent(spark, d), shared_folder(spark)
    _, model = _fitted(rows, models.logistic)
    save_model(model, {"model_name": models.LOGISTIC}, folder)
    loaded, meta = load_model(spark, folder)
    assert meta["model_name"] == models.LOGISTIC
    before = models.score(model, rows).select("o_orderkey", F.col("probability_high").alias("before"))
    after = running_number(models.score_customers(loaded, rows), [F.col("o_orderkey")], "position")
    return after.join(before, "o_orderkey").select(
        "o_orderkey", "prediction", "predicted_income", (F.abs(F.col("before") - F.col("probability_high")) < 1e-12).alias("unchanged"), "position")


@query(f"""SELECT o_orderkey, {URGENT} AS target, {URGENT} AS forest, {URGENT} AS boosted, 'o_orderpriority_1-URGENT' AS leading FROM orders""")
def trees_orders(spark, d):
    """Forest and boosted trees with their full settings find the indicator that decides."""
    rows = urgent(spark, d)
    prep, forest = _fitted(rows, lambda n: models.forest())
    _, boosted = _fitted(rows, lambda n: models.boosted())
    best = models.feature_importance(spark, boosted.stages[-1], feature_names(prep)).first()["feature"]
    first = models.score(forest, rows).withColumnRenamed("prediction", "forest").drop("probability_high")
    return models.score(boosted, first).select("o_orderkey", "target", "forest", F.col("prediction").alias("boosted"), F.lit(best).alias("leading"))


@query("SELECT unnest([0, 1, 2]) AS trained, unnest(['Logistic Regression', 'Random Forest', 'Gradient Boosted Trees']) AS model, "
       "1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS roc_auc, 1.0::DOUBLE AS pr_auc")
def compare_models_orders(spark, d):
    """The whole classifier job with its full settings, on all orders, whose classes can be told apart."""
    return rounded(train_classifiers(urgent(spark, d), "o_orderkey", features=["o_orderpriority", "o_totalprice"])["table"])


@query("""WITH m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS price, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent,
       (o_orderpriority = '5-LOW')::INT::DOUBLE AS low FROM orders, m""")
def preprocessed_orders(spark, d):
    """Slots of the assembled feature vector by their names."""
    rows = urgent(spark, d)
    prep = build_preprocessor(["o_totalprice"], ["o_orderpriority"], "standard").fit(rows)
    names, x = feature_names(prep), vector_to_array("features")
    slot = lambda name: x[names.index(name)]
    return rounded(prep.transform(rows).select(
        "o_orderkey", slot("o_totalprice").alias("price"), slot("o_orderpriority_1-URGENT").alias("urgent"),
        slot("o_orderpriority_5-LOW").alias("low")))


@query("""
WITH b AS (SELECT p_brand, round(avg(p_retailprice), 4) AS x FROM part GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY x, p_brand) AS i, count(*) OVER () AS n FROM b),
c AS (SELECT k.i AS cut, var_pop(o.x) FILTER (o.i <= k.i) * k.i + var_pop(o.x) FILTER (o.i > k.i) * (any_value(o.n) - k.i) AS inertia
      FROM o, (SELECT i FROM o WHERE i < n) k GROUP BY k.i),
best AS (SELECT cut, inertia FROM c ORDER BY inertia LIMIT 1),
s AS (SELECT p_brand, i <= cut AS low, inertia FROM o, best),
z AS (SELECT low, row_number() OVER (ORDER BY count(*) DESC, min(p_brand)) - 1 AS cluster FROM s GROUP BY 1)
SELECT p_brand, cluster::INT AS cluster, round(inertia, 6) AS inertia FROM s JOIN z USING (low)""")
def kmeans_part(spark, d):
    """Two clusters of brands on one measure, where SQL tries every cut."""
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("x"))
    labelled, inertia = cluster.kmeans(brands, "p_brand", ["x"], 2)
    return labelled.select("p_brand", "cluster", F.round(F.lit(inertia), 6).alias("inertia"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 100000.0 WHEN 3 THEN 7.0
WHEN 4 THEN NULL ELSE value END AS x FROM events""")
def strict_numbers_events(spark, d):
    """Type suffixes and words are no numbers, exponents and blanks around a number are allowed."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, "12d").when(k == 1, "3F").when(k == 2, "1e5").when(k == 3, " 7 ").when(k == 4, "x7").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", strict_number(text).alias("x"))


def _digamma(x):
    """The recurrence up to x + 8, then the asymptotic series."""
    y = f"({x} + 8.0::DOUBLE)"
    return (f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8)"
            + "".join(f" - 1 / ({x} + {i}.0::DOUBLE)" for i in range(8)) + ")")


@query(f"""WITH e AS (SELECT event_id, (event_type = 'purchase')::INT AS c, value + event_id * 1e-7::DOUBLE AS x FROM events),
s AS (SELECT c, x, count(*) OVER (PARTITION BY c) AS nc, count(*) OVER () AS n,
  list_sort(list_filter([{", ".join(f"abs(x - {f}(x, {i}) OVER o)" for f in ("lag", "lead") for i in (1, 2, 3))}], lambda d: d IS NOT NULL))[3] AS r
  FROM e WINDOW o AS (PARTITION BY c ORDER BY x)),
k AS (SELECT *, r - 1e-15 * (abs(x) + r) AS q FROM s),
m AS (SELECT any_value(k.n) AS n, any_value(k.nc) AS nc, count(*) AS m FROM k JOIN e ON e.x > k.x - k.q AND e.x < k.x + k.q GROUP BY k.c, k.x)
SELECT 'value' AS feature, round(greatest(0.0::DOUBLE, any_value({_digamma("n")}) + avg({_digamma("3")} - {_digamma("nc")} - {_digamma("m")})), 4) AS mutual_info
FROM m""")
def nearest_mutual_info_events(spark, d):
    """What an event's value tells about its being a purchase; values are set apart by their event, so that none are equal."""
    e = with_target(table(spark, d, "events"), "event_type", "^(click|view|error|signup)$").select(
        "event_id", "target", (F.col("value") + F.col("event_id") * F.lit(1e-7)).alias("value"))
    return rounded(scores.nearest_mutual_info(e, ["value"], "event_id"), 4)


@query("""SELECT 0.5::DOUBLE AS roc_auc, round(avg((l_returnflag = 'R')::INT), 6) AS pr_auc FROM lineitem""")
def constant_score_lineitem(spark, d):
    """One score for all rows: half of the pairs, and the share of the positive class."""
    li = with_target(table(spark, d, "lineitem"), "l_returnflag", "[AN]", "label").withColumn("score", F.lit(0.25))
    return rounded(metrics.ranking_metrics(li))
