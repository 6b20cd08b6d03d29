"""Row-wise cleaning, text helpers, outlier replacement, scaling and encoding."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.registry import query, rounded, table
from tallyframe.functions.expressions import ellipsize, marker_size, percentage, title_label
from tallyframe.operators import clean, features


@query("SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '-\\s*URGENT') THEN 0 ELSE 1 END AS target FROM orders")
def target_flag_orders(spark, d):
    return clean.with_target(table(spark, d, "orders"), "o_orderpriority", r"-\s*URGENT").select("o_orderkey", "target")


@query("SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders")
def sentinel_to_null_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return clean.sentinel_to_null(o, "4-NOT SPECIFIED")


@query("SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'nan' ELSE p_type END AS p_type, p_brand FROM part")
def normalize_strings_part(spark, d):
    padded = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("p_type"), "p_brand")
    return clean.normalize_strings(padded, null_token="nan", sentinel="PROMO")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS target FROM orders")
def select_features_orders(spark, d):
    o = clean.with_target(table(spark, d, "orders"), "o_orderpriority", "^[2-5]-")
    return clean.select_features(o, ["o_orderkey", "no such column", "o_totalprice", "o_orderstatus"])


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_id::DOUBLE END AS code FROM events")
def coerce_numeric_events(spark, d):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    e = table(spark, d, "events").select("event_id", text.alias("code"))
    return clean.coerce_numeric(e, ["event_id", "code"])


@query("""SELECT p_partkey, coalesce(nullif(p_size, 11), 0) AS p_size,
       coalesce(nullif(p_type, 'PROMO'), 'Unknown') AS p_type FROM part""")
def fill_nulls_part(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", F.nullif("p_size", F.lit(11)).alias("p_size"), F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return clean.fill_nulls(part, {"p_size": 0, "p_type": "Unknown", "absent": 1})


@query("""SELECT count(*) AS kept, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity > 0 AND (l_extendedprice < 5000 OR l_extendedprice > 80000)""")
def row_filters_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    kept = li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 0)
                    & ((F.col("l_extendedprice") < 5000) | (F.col("l_extendedprice") > 80000)))
    return kept.agg(F.count("*").alias("kept"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""SELECT count(*) FILTER (l_discount = 0) AS zero_discounts, bool_or(l_quantity > 49) AS any_large,
       count(*) FILTER (l_tax > 0.05 AND l_linestatus = 'O') AS taxed_open FROM lineitem""")
def mask_counts_lineitem(spark, d):
    return table(spark, d, "lineitem").agg(
        F.count_if(F.col("l_discount") == 0).alias("zero_discounts"),
        F.bool_or(F.col("l_quantity") > 49).alias("any_large"),
        F.count_if((F.col("l_tax") > 0.05) & (F.col("l_linestatus") == "O")).alias("taxed_open"))


@query("""
SELECT o_orderkey, upper(o_orderpriority) AS shouted,
       upper(left(o_orderstatus, 1)) || '_x' AS tag,
       CASE WHEN length(o_orderpriority) > 7 THEN left(o_orderpriority, 7) || '...' ELSE o_orderpriority END AS cut_if_long,
       left(o_orderpriority, 5) || '...' AS always_cut, 'Order Avg Price' AS title,
       o_orderstatus || ', ' || o_orderpriority AS joined
FROM orders""")
def text_helpers_orders(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.upper(p).alias("shouted"),
        F.concat(F.upper(F.substring("o_orderstatus", 1, 1)), F.lit("_x")).alias("tag"),
        ellipsize(p, 7).alias("cut_if_long"), ellipsize(p, 5, always=True).alias("always_cut"),
        title_label(F.lit("order_avg_price")).alias("title"), F.concat_ws(", ", "o_orderstatus", p).alias("joined"))


@query("""
SELECT c_nationkey, round(100.0 * count(*) / (SELECT count(*) FROM customer)::DOUBLE, 6) AS pct,
       round(log10(count(*)::DOUBLE) * 50, 6) AS size_3d, round(log10(count(*)::DOUBLE) * 30, 6) AS size_2d
FROM customer GROUP BY 1""")
def share_and_marker_size_customer(spark, d):
    c = table(spark, d, "customer")
    total = c.agg(F.count("*").alias("n")).scalar()
    n = F.count("*")
    return rounded(c.groupBy("c_nationkey").agg(n.alias("n")).select(
        "c_nationkey", percentage(F.col("n"), total).alias("pct"),
        marker_size(F.col("n"), 50).alias("size_3d"), marker_size(F.col("n"), 30).alias("size_2d")))


def _mode_sql(table_name, col, where="true"):
    return (f"(SELECT {col} FROM {table_name} WHERE {col} IS NOT NULL AND {where} "
            f"GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)")


@query(f"""
SELECT 'discount above 0' AS what, {_mode_sql('lineitem', 'l_discount', 'l_discount > 0')}::DOUBLE AS value
UNION ALL SELECT 'quantity', {_mode_sql('lineitem', 'l_quantity')}::DOUBLE
UNION ALL SELECT 'median without mode', (SELECT quantile_cont(l_tax::DOUBLE, 0.5) FROM lineitem)""")
def mode_or_median_lineitem(spark, d):
    li = table(spark, d, "lineitem")
    rows = [
        ("discount above 0", clean.mode_or_median(li, "l_discount", F.col("l_discount") > 0)),
        ("quantity", clean.mode_or_median(li, "l_quantity")),
        ("median without mode", clean.mode_or_median(li, "l_tax", F.col("l_tax") > 99)),
    ]
    return spark.createDataFrame(rows, "what string, value double")


@query(f"""
SELECT l_orderkey, l_partkey, l_linenumber, l_shipdate::VARCHAR AS shipped,
       CASE WHEN l_discount = 0 THEN {_mode_sql('lineitem', 'l_discount', 'l_discount > 0')} ELSE l_discount END AS l_discount
FROM lineitem""")
def replace_invalid_lineitem(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"),
        "l_discount")
    return clean.replace_invalid_with_mode(li, "l_discount", 0)


CAP_SQL = """
WITH q AS (SELECT quantile_cont(value::DOUBLE, 0.99) AS cutoff FROM events),
m AS (SELECT value AS mode FROM events, q WHERE value <= cutoff GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)
"""


@query(CAP_SQL + "SELECT event_id, CASE WHEN value > cutoff THEN mode ELSE value END AS value FROM events, q, m")
def cap_extreme_events(spark, d):
    return clean.cap_extreme_with_mode(table(spark, d, "events").select("event_id", "value"), ["value"])


@query(CAP_SQL + """SELECT 'value' AS "column", round(any_value(cutoff), 6) AS cutoff, any_value(mode) AS mode,
       count(*) FILTER (value > cutoff) AS replaced FROM events, q, m""")
def cap_extreme_report_events(spark, d):
    return rounded(clean.extreme_report(table(spark, d, "events"), ["value"]))


@query("""SELECT p_partkey, coalesce(nullif(p_size, 11)::DOUBLE,
       (SELECT quantile_cont(nullif(p_size, 11)::DOUBLE, 0.5) FROM part)) AS p_size FROM part""")
def impute_median_part(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(11)).alias("p_size"))
    return features.ColumnImputer(["p_size"], ["p_size"], "median").fit(part).transform(part)


@query("""
WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p FROM orders)
SELECT o_orderkey, coalesce(p, (SELECT p FROM t WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1))
       AS o_orderpriority FROM t""")
def impute_mode_orders(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"))
    return features.ColumnImputer(["o_orderpriority"], ["o_orderpriority"], "mode").fit(o).transform(o)


def _scale_sql(centre, spread):
    terms = ", ".join(
        f"round(({c} - {centre.format(c=c)}) / coalesce(nullif({spread.format(c=c)}, 0), 1), 6) AS {c}"
        for c in ("p_size", "p_retailprice", "flat"))
    return f"""WITH t AS (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice, 7::DOUBLE AS flat FROM part)
SELECT p_partkey, {terms} FROM t"""


def _scaled(spark, d, mode):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7).alias("flat"))
    return rounded(features.scale(part, ["p_size", "p_retailprice", "flat"], mode))


@query(_scale_sql("(SELECT avg({c}) FROM t)", "(SELECT stddev_pop({c}) FROM t)"))
def standard_scale_part(spark, d):
    return _scaled(spark, d, "standard")


@query(_scale_sql("(SELECT min({c}) FROM t)", "(SELECT max({c}) - min({c}) FROM t)"))
def minmax_scale_part(spark, d):
    return _scaled(spark, d, "minmax")


@query(_scale_sql("(SELECT quantile_cont({c}, 0.5) FROM t)",
                  "(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM t)"))
def robust_scale_part(spark, d):
    return _scaled(spark, d, "robust")


def _ratio(parts, r):
    """A quotient of two polynomials, highest power first."""
    def power(p):
        out = f"{p[0]!r}::DOUBLE"
        for c in p[1:]:
            out = f"({out} * {r} + {c!r}::DOUBLE)"
        return out
    return f"({power(parts[0])} / {power(parts[1])})"


# Between the landmarks i / (n - 1) a value takes the middle of the shares from below and from above.
@query(f"""WITH n AS (SELECT least(1000, count(*)) AS n, min(value) AS low, max(value) AS high FROM events),
m AS (SELECT list_transform(range(0, n), lambda i: i / (n - 1)::DOUBLE) AS p, n FROM n),
q AS (SELECT quantile_cont(value::DOUBLE, [{", ".join(repr(i / 999) for i in range(1000))}]) AS q FROM events),
j AS (SELECT event_id, value AS x, len(list_filter(q.q, lambda y: y <= value)) AS upto, len(list_filter(q.q, lambda y: y < value)) AS below, q.q, m.n, n.low, n.high
  FROM events, q, m, n),
s AS (SELECT event_id, CASE WHEN x + 1e-7 > high THEN 1.0::DOUBLE WHEN x - 1e-7 < low THEN 0.0 WHEN upto > below THEN (below + upto - 1) / 2.0::DOUBLE / (n - 1)
  ELSE (upto - 1 + (x - q[upto]) / (q[upto + 1] - q[upto])) / (n - 1) END AS p FROM j),
z AS (SELECT event_id, p, p - 0.5 AS c, sqrt(-ln(CASE WHEN p <= 0 OR p >= 1 THEN 0.5 WHEN p < 0.5 THEN p ELSE 1 - p END)) AS r FROM s)
SELECT event_id, round(CASE WHEN p <= 0 THEN -{features.EDGE_SCORE} WHEN p >= 1 THEN {features.EDGE_SCORE}
  ELSE least({features.EDGE_SCORE}, greatest(-{features.EDGE_SCORE}, CASE WHEN abs(c) <= 0.425 THEN c * {_ratio(features._MIDDLE, "(0.180625 - c * c)")}
  WHEN r <= 5 THEN sign(c) * {_ratio(features._SIDE, "(r - 1.6)")} ELSE sign(c) * {_ratio(features._TAIL, "(r - 5)")} END)) END, 6) AS value FROM z""")
def quantile_normal_scale_events(spark, d):
    return rounded(features.scale(table(spark, d, "events").select("event_id", "value"), ["value"], "quantile"))


@query("""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1),
f AS (SELECT p_brand FROM c WHERE n >= 0.04::DOUBLE * (SELECT count(*) FROM part))
SELECT p_partkey, CASE WHEN f.p_brand IS NULL THEN 'p_brand_infrequent' ELSE 'p_brand_' || f.p_brand END AS active,
       (SELECT count(*) FROM f) + CASE WHEN EXISTS (SELECT 1 FROM c WHERE p_brand NOT IN (SELECT p_brand FROM f))
       THEN 1 ELSE 0 END AS width
FROM part LEFT JOIN f ON part.p_brand = f.p_brand""")
def rare_one_hot_part(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    model = features.RareOneHot(["p_brand"], ["hot"], 0.04).fit(part)
    names = F.array(*[F.lit(n) for n in model.names()[0]])
    hot = vector_to_array("hot")
    return model.transform(part).select(
        "p_partkey", F.get(names, F.array_position(hot, F.lit(1.0)) - 1).alias("active"),
        F.size(hot).cast("long").alias("width"))
