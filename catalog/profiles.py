"""Profiles: shapes, nulls, counts, quantiles, outliers, histograms."""

from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.operators import profile
from tallyframe.operators.clean import with_target
from tallyframe.operators.quantiles import quantiles
from tallyframe.sources.tables import infer_types, read_headerless, write_table
from tallyframe.session import shared_folder

URGENT = r"^[2-5]-"  # every other priority is the low class, so target 1 = urgent


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape_lineitem(spark, d):
    return profile.shape(table(spark, d, "lineitem"))


@query("""
SELECT * FROM (
  SELECT 'l_discount' AS "column", count(*) FILTER (l_discount = 0.0) AS nulls FROM lineitem
  UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax = 0.02) FROM lineitem
  UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag = 'R') FROM lineitem
) WHERE nulls > 0""")
def null_counts_lineitem(spark, d):
    li = table(spark, d, "lineitem").withColumns({
        "l_discount": F.nullif("l_discount", F.lit(0.0)), "l_tax": F.nullif("l_tax", F.lit(0.02)),
        "l_returnflag": F.nullif("l_returnflag", F.lit("R")),
    })
    return profile.null_counts(li)


@query("""
SELECT 'o_orderpriority' AS "column", count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS cnt,
       round(100.0 * count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') / count(*)::DOUBLE, 6) AS pct
FROM orders""")
def sentinel_counts_orders(spark, d):
    return rounded(profile.sentinel_counts(table(spark, d, "orders"), "4-NOT SPECIFIED"))


@query("""
WITH v AS (SELECT 'lang' AS "column", lang AS value FROM documents
           UNION ALL SELECT 'source', source FROM documents)
SELECT "column", value, count(*) AS cnt,
       round(100.0 * count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS pct
FROM v GROUP BY ALL""")
def value_counts_documents(spark, d):
    return rounded(profile.value_counts(table(spark, d, "documents"), ["lang", "source"]))


@query("""
WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value FROM part
           UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_name', p_name FROM part),
c AS (SELECT "column", value, count(*) AS cnt FROM v GROUP BY ALL)
SELECT "column", value, cnt, round(100.0 * cnt / (SELECT count(*) FROM part)::DOUBLE, 6) AS pct FROM c
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) <= 5""")
def top_values_part(spark, d):
    return rounded(profile.value_counts(table(spark, d, "part"), ["p_brand", "p_type", "p_name"], top=5))


@query("""
SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS n_distinct FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT nullif(o_orderpriority, '5-LOW')) FROM orders
UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders""")
def distinct_counts_orders(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return profile.distinct_counts(o, ["o_orderstatus", "o_orderpriority", "o_custkey"])


CLASS_BALANCE_SQL = """
WITH t AS (SELECT CASE WHEN regexp_matches(o_orderpriority, '^[2-5]-') THEN 0 ELSE 1 END AS target FROM orders),
s AS (SELECT count(*) AS n, sum((target = 0)::INT) AS n0, sum((target = 1)::INT) AS n1 FROM t)
SELECT target, count(*) AS cnt, round(100.0 * count(*) / any_value(n)::DOUBLE, 6) AS pct,
       round(any_value(n0)::DOUBLE / any_value(n1), 6) AS imbalance_ratio
FROM t, s GROUP BY target"""


@query(CLASS_BALANCE_SQL)
def class_balance_orders(spark, d):
    return rounded(profile.class_balance(with_target(table(spark, d, "orders"), "o_orderpriority", URGENT)))


def _describe_sql(table_name, cols):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
       round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75,
       max({c})::DOUBLE AS max FROM {table_name}""" for c in cols)


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query(_describe_sql("lineitem", LINE_NUMBERS))
def describe_lineitem(spark, d):
    return rounded(profile.describe_numeric(table(spark, d, "lineitem"), LINE_NUMBERS))


@query(_describe_sql("(SELECT nullif(p_size, 11) AS p_size, p_retailprice FROM part)", ["p_size", "p_retailprice"]))
def describe_part_with_nulls(spark, d):
    part = table(spark, d, "part").withColumn("p_size", F.nullif("p_size", F.lit(11)))
    return rounded(profile.describe_numeric(part, ["p_size", "p_retailprice"]))


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value FROM {t}"
    for t, c in (("events", "value"),) for p in (0.01, 0.25, 0.5, 0.75, 0.99)))
def quantiles_events(spark, d):
    return rounded(quantiles(table(spark, d, "events"), ["value"], [0.01, 0.25, 0.5, 0.75, 0.99]))


def _iqr_sql(table_name, cols):
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
       count(*) FILTER ({c} < lo OR {c} > hi) AS cnt,
       round(100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count(*)::DOUBLE, 6) AS pct,
       count(*) FILTER ({c} < lo OR {c} > hi) / count(*)::DOUBLE > 0.05 AS flagged
FROM {table_name}, (SELECT q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM (
  SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table_name}))"""
                             for c in cols)


@query(_iqr_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def iqr_outliers_lineitem(spark, d):
    return rounded(profile.iqr_outliers(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query(_iqr_sql("events", ["value"]))
def iqr_outliers_events(spark, d):
    return rounded(profile.iqr_outliers(table(spark, d, "events"), ["value"]))


@query("""
SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus <> 'F') / count(*)::DOUBLE, 6) AS share_0,
       round(count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE, 6) AS share_1
FROM orders GROUP BY 1""")
def crosstab_rate_orders(spark, d):
    o = with_target(table(spark, d, "orders"), "o_orderstatus", "[OP]")
    return rounded(profile.crosstab_rate(o, "o_orderpriority"))


@query("""
WITH t AS (SELECT value AS x, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS "by" FROM events),
l AS (SELECT "by", min(x) AS lo, (max(x) - min(x)) / 50 AS width, count(*) AS n FROM t GROUP BY "by"),
b AS (SELECT t."by", least(CAST(floor((x - lo) / width) AS INT), 49) AS bin, count(*) AS found
      FROM t JOIN l ON t."by" = l."by" GROUP BY 1, 2)
SELECT 'value' AS "column", l."by", g.bin::INT AS bin, round(lo + g.bin * width, 6) AS lower_edge,
       round(lo + (g.bin + 1) * width, 6) AS upper_edge, coalesce(found, 0) AS cnt,
       round(coalesce(found, 0) / (n * width), 9) AS density
FROM l CROSS JOIN generate_series(0, 49) AS g(bin) LEFT JOIN b ON b."by" = l."by" AND b.bin = g.bin""")
def density_histogram_events(spark, d):
    e = with_target(table(spark, d, "events"), "event_type", "^(click|view|error|signup)$")
    out = profile.density_histogram(e, ["value"])
    return out.withColumns({
        "lower_edge": F.round("lower_edge", 6), "upper_edge": F.round("upper_edge", 6),
        "density": F.round("density", 9),
    })


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def headerless_part(spark, d):
    """Write the part table as plain headerless lines, read it back by its column names, infer the types."""
    part = table(spark, d, "part")
    folder = shared_folder(spark)
    lines = part.select(F.concat_ws(",", *[F.col(c).cast("string") for c in part.columns]))
    lines.write.text(f"{folder}/lines")
    rows = read_headerless(spark, f"{folder}/lines", part.columns).drop("_ragged")
    return infer_types(rows, rows.columns)


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, "
       "nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer")
def headed_csv_customer(spark, d):
    """Write the customer table as headed CSV and read it back with a sentinel as null token."""
    from tallyframe.sources.tables import read_table

    folder = shared_folder(spark)
    write_table(table(spark, d, "customer"), f"{folder}/customer", "csv")
    return read_table(spark, f"{folder}/customer", null_tokens=("", "MACHINERY"))
