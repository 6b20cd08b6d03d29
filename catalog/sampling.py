"""Exact samples, splits and unions."""

from pyspark.sql import functions as F

from catalog.registry import query, table
from tallyframe.operators import sampling
from tallyframe.operators.clean import with_target
from tallyframe.operators.groups import running_number


def _hash(key):
    return f"md5({key}::VARCHAR || '|42')"


def urgent_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return with_target(o, "o_orderpriority", "^[2-5]-")


URGENT_SQL = """SELECT o_orderkey, o_totalprice, o_orderpriority,
CASE WHEN regexp_matches(o_orderpriority, '^[2-5]-') THEN 0 ELSE 1 END AS target FROM orders"""


@query(f"""
WITH t AS ({URGENT_SQL}), n AS (SELECT count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM t)
SELECT o_orderkey, o_totalprice, o_orderpriority, target FROM t, n
QUALIFY target = 1 OR row_number() OVER (PARTITION BY target ORDER BY {_hash('o_orderkey')}, o_orderkey) <= least(n0, n1)""")
def downsample_orders(spark, d):
    return sampling.downsample(urgent_orders(spark, d), "target", "o_orderkey")


@query(f"""
WITH n AS (SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1 FROM labels)
SELECT doc_id, quality, toxic FROM labels, n
QUALIFY toxic = 1 OR row_number() OVER (PARTITION BY toxic ORDER BY {_hash('doc_id')}, doc_id) <= least(n0, n1)""")
def downsample_labels(spark, d):
    return sampling.downsample(table(spark, d, "labels"), "toxic", "doc_id")


@query(f"""
WITH t AS ({URGENT_SQL}), c AS (SELECT target, count(*) AS n_c FROM t GROUP BY 1),
s AS (SELECT *, ceil(sum(n_c) OVER () * 3 / 10::DOUBLE) AS total, sum(n_c) OVER () AS n FROM c),
f AS (SELECT *, floor(n_c * total / n) AS base, n_c * total / n - floor(n_c * total / n) AS frac FROM s),
k AS (SELECT target, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, target)
        <= total - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM f),
r AS (SELECT t.*, k, row_number() OVER (PARTITION BY t.target ORDER BY {_hash('o_orderkey')}, o_orderkey) AS rn
      FROM t JOIN k ON t.target = k.target)
SELECT o_orderkey, target, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split_orders(spark, d):
    train, test = sampling.stratified_split(urgent_orders(spark, d), "target", "o_orderkey")
    return (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
            .select("o_orderkey", "target", "part"))


@query(f"""SELECT event_id, event_type, row_number() OVER (ORDER BY {_hash('event_id')}, event_id) AS position FROM events""")
def shuffle_events(spark, d):
    """All rows with their place in the repeatable random order."""
    order = [sampling.row_hash("event_id", 42), F.col("event_id")]
    return running_number(table(spark, d, "events").select("event_id", "event_type"), order, "position")


@query(URGENT_SQL)
def union_classes_orders(spark, d):
    o = urgent_orders(spark, d)
    return o.where("target = 0").unionByName(o.where("target = 1"))


@query(f"""
WITH c AS (SELECT o_custkey, count(*) AS n_c FROM orders GROUP BY 1),
s AS (SELECT *, ceil(sum(n_c) OVER () * 3 / 10::DOUBLE) AS total, sum(n_c) OVER () AS n FROM c),
f AS (SELECT *, floor(n_c * total / n) AS base, n_c * total / n - floor(n_c * total / n) AS frac FROM s),
k AS (SELECT o_custkey, base + CASE WHEN row_number() OVER (ORDER BY frac DESC, o_custkey)
        <= total - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM f),
r AS (SELECT o_orderkey, o_custkey, k, row_number() OVER (PARTITION BY o_custkey ORDER BY {_hash('o_orderkey')}, o_orderkey) AS rn
      FROM orders JOIN k USING (o_custkey))
SELECT o_orderkey, o_custkey, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split_customers(spark, d):
    """As many classes as there are customers."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    train, test = sampling.stratified_split(orders, "o_custkey", "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
