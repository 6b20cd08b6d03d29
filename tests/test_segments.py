import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import cluster, features, groups
from tallyframe.plans import segmentation
from tallyframe.sources.tables import write_segments

# The published group table.
GOLDEN = [
    ("Adm support including clerical", 38.38, 45.36, 0.03, 242.74, 14837, 0, 10),
    ("Executive admin and managerial", 42.04, 49.04, 0.29, 1834.18, 12495, 1, 1),
    ("Farming forestry and fishing", 40.95, 40.94, 0.05, 455.12, 3146, 0, 8),
    ("Handlers equip cleaners etc", 32.84, 38.79, 0.02, 225.36, 4127, 0, 11),
    ("Machine operators assmblrs & inspctrs", 38.08, 44.57, 0.04, 237.4, 6379, 0, 9),
    ("Not in universe", 30.47, 1.93, 0.01, 108.32, 100684, 0, 12),
    ("Other service", 35.38, 39.8, 0.01, 180.08, 12099, 0, 13),
    ("Precision production craft & repair", 38.98, 46.11, 0.09, 479.05, 10518, 0, 6),
    ("Private household services", 37.64, 34.61, 0.0, 81.05, 780, 0, 14),
    ("Professional specialty", 40.59, 46.96, 0.25, 1696.42, 13940, 0, 2),
    ("Protective services", 39.01, 46.68, 0.16, 717.15, 1661, 0, 3),
    ("Sales", 37.34, 44.0, 0.13, 924.45, 11783, 0, 4),
    ("Technicians and related support", 37.3, 47.63, 0.12, 374.16, 3018, 0, 5),
    ("Transportation and material moving", 40.1, 45.29, 0.06, 315.83, 4020, 0, 7),
]
KEY = segmentation.KEY
COLS = segmentation.CLUSTER_ON


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame(
        GOLDEN, f"`{KEY}` string, avg_age double, avg_weeks_worked double, high_income_rate double, "
                "avg_capital_gains double, sample_size long, cluster int, rank long").persist()


def test_golden_clusters_and_quality(golden):
    clustered, quality, best = segmentation.cluster_groups(golden.drop("cluster", "rank"))
    assert best == 2
    found = {r["k"]: (r["inertia"], r["silhouette"]) for r in quality.collect()}
    expected = {2: (98.484, 0.6270), 3: (46.850, 0.5451), 4: (19.693, 0.5222), 5: (10.537, 0.3457), 6: (6.496, 0.2738)}
    for k, (inertia, silhouette) in expected.items():
        assert found[k][0] == pytest.approx(inertia, abs=2e-3) and found[k][1] == pytest.approx(silhouette, abs=2e-4)
    assert {r[KEY]: r["cluster"] for r in clustered.collect()} == {g[0]: g[6] for g in GOLDEN}


def test_golden_ranks_and_bands(golden):
    ranked = groups.rank_groups(golden.drop("rank"), "high_income_rate", KEY)
    assert {r[KEY]: r["rank"] for r in ranked.collect()} == {g[0]: g[7] for g in GOLDEN}
    bands = groups.quartile_bands(golden, "high_income_rate").groupBy("band").count()
    assert {r["band"]: r["count"] for r in bands.collect()} == {"high": 4, "mid": 6, "low": 4}


def test_golden_files(golden, tmp_path):
    write_segments(golden.drop("rank"), str(tmp_path), KEY)
    rows = []
    for part in sorted(glob.glob(f"{tmp_path}/ranked/*.csv")):
        with open(part) as f:
            rows += list(csv.reader(f))[1:]
    assert [r[0] for r in rows] == [g[0] for g in sorted(GOLDEN, key=lambda g: g[7])]
    assert rows[0] == ["Executive admin and managerial", "42.04", "49.04", "0.29", "1834.18", "12495", "1"]


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.125, 1), (0.375, 2), (-0.125, 3), (None, 4)], "x double, n int")
    assert [r["x"] for r in groups.round_stats(df, 2).collect()] == [0.12, 0.38, -0.12, None]


def test_a_row_may_fall_into_both_outer_bands(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, x double")
    assert sorted(tuple(r)[::2] for r in groups.quartile_bands(df, "x").collect()) == [
        ("a", "high"), ("a", "low"), ("b", "high"), ("b", "low")]


def test_numbering_without_one_big_window(spark, monkeypatch):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("x"))
    order = [F.desc("x"), F.col("id")]
    expected = sorted(tuple(r) for r in groups.running_number(df, order, start=0).collect())
    monkeypatch.setattr(groups, "is_small", lambda df: False)
    ranged = groups.running_number(df.repartition(6), order, start=0)
    assert sorted(tuple(r) for r in ranged.select("id", "x", "rank").collect()) == expected
    assert sorted(r[2] for r in expected) == list(range(500))


def test_silhouette_blocks_agree_with_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    label = [0] * 30 + [1] * 29 + [2]
    df = spark.createDataFrame([(i, *map(float, p), c) for i, (p, c) in enumerate(zip(x, label))], "id long, a double, b double, c int")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lab, s = np.array(label), []
    for i in range(60):
        same = lab == lab[i]
        if same.sum() == 1:
            s.append(0.0)
            continue
        a = dist[i, same].sum() / (same.sum() - 1)
        b = min(dist[i, lab == c].mean() for c in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    for block_rows in (7, 1000):
        assert cluster.silhouettes(df, "id", ["a", "b"], ["c"], block_rows)["c"] == pytest.approx(np.mean(s))


def test_cluster_numbers_by_size_then_key(spark):
    df = spark.createDataFrame([("b", 5), ("c", 5), ("a", 9), ("d", 2)], "k string, old int")
    out = cluster.stable_cluster_numbers(df, "k", "old")
    assert {r["k"]: r["cluster"] for r in out.collect()} == {"b": 0, "c": 0, "a": 1, "d": 2}


def test_summary_members_and_plot_data(golden):
    summary = {r["cluster"]: r for r in groups.cluster_summary(golden, COLS).collect()}
    assert summary[0]["size"] == 13 and summary[1]["mean_avg_age"] == 42.04
    members = [tuple(r) for r in groups.cluster_members(golden, KEY).collect()]
    assert members[-1] == (1, "Executive admin and managerial") and len(members) == 14
    plot = {r["key"]: r for r in groups.segment_plot_data(golden, KEY).collect()}
    assert plot["Sales"]["legend_2d"] == "Sales" and plot["Sales"]["label_2d"] == "Sales..."
    assert plot["Adm support including clerical"]["legend_3d"] == "Adm support includin..."
    assert plot["Protective services"]["label_3d"] is None and plot["Adm support including clerical"]["color_index"] == 0


def test_fewer_groups_than_clusters(spark):
    df = spark.createDataFrame([(c, float(i), float(i * i)) for i, c in enumerate("abcd")], "k string, x double, y double")
    table, best, chosen = cluster.choose_k(df, "k", ["x", "y"], n_init=2)
    assert [r["k"] for r in table.orderBy("k").collect()] == [2, 3] and chosen.count() == 4
    labelled, inertia = cluster.kmeans(df, "k", ["x", "y"], 4, n_init=3)
    assert inertia == pytest.approx(0) and labelled.select("cluster").distinct().count() == 4


def test_segmentation_job_on_raw_rows(census):
    df = segmentation.prepare(census, null_token="nan")
    out = segmentation.segment(df, n_init=2, ks=range(2, 4))
    keys = {r[KEY] for r in out["features"].collect()}
    assert keys == {"Sales", "Professional specialty", "Other service", "Not in universe"}  # Armed Forces: 50 rows
    pdf = df.where(F.col(KEY) == "Sales").toPandas()
    row = out["features"].where(F.col(KEY) == "Sales").first()
    assert row["avg_age"] == pytest.approx(round(pdf["age"].mean(), 2)) and row["sample_size"] == len(pdf)
    assert out["ranked"].count() == 4 and out["members"].count() == 4 and out["bands"].count() >= 4


def test_starts_see_a_small_far_cluster(spark):
    """Five points among 20,000, which a sample of 1,000 mostly lacks."""
    i = F.col("id")
    noise = [F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0 for s in "xy"]
    left = F.when(i < 5, 60.0).when(i % 2 == 0, 0.0).otherwise(6.0)
    for first in (0, 100_000, 200_000):
        df = spark.range(20_000).select((i + first).alias("id"), (left + noise[0]).alias("x"),
                                        (F.when(i < 5, 60.0).otherwise(0.0) + noise[1]).alias("y"))
        labelled, inertia = cluster.kmeans(df, "id", ["x", "y"], 3, n_init=3)
        assert sorted(r["count"] for r in labelled.groupBy("cluster").count().collect())[0] == 5 and inertia < 4000


def test_silhouette_skips_far_clusters_and_stays_exact(spark):
    """Separate clusters, so that most pairs of blocks are left out; also rows without a label."""
    rng = np.random.default_rng(9)
    lab = np.repeat(np.arange(6), 30)
    x = rng.normal(size=(180, 2)) + np.column_stack([lab * 25.0, (lab % 2) * 8.0])
    rows = [(i, float(p), float(q), f"c{c}") for i, ((p, q), c) in enumerate(zip(x, lab))] + [(999, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(180):
        a = dist[i, lab == lab[i]].sum() / 29
        b = min(dist[i, lab == c].mean() for c in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    one = df.withColumn("one", F.lit(1))
    found = cluster.silhouettes(one, "id", ["a", "b"], ["c", "one"], 8)
    assert found["c"] == pytest.approx(np.mean(s)) and found["one"] is None


def test_starts_take_a_fixed_number_of_passes(spark, monkeypatch):
    """Candidates are weighted by all points, and rounds don't grow with k."""
    df = spark.range(3000).select("id", F.array(F.pmod(F.xxhash64("id"), F.lit(977)).cast("double")).alias("_point"))
    for k in (2, 12):
        found, weights = cluster._candidates(df, "id", k, 1)
        assert weights.sum() == 3000 and len(found) <= 1 + cluster.START_ROUNDS * cluster.OVERSAMPLING * k
    few, weights = cluster._candidates(df.limit(9), "id", 6, 1)
    assert len(few) == 9 and weights.sum() == 9
    with pytest.raises(ValueError):
        cluster.kmeans(spark.createDataFrame([], "id long, x double"), "id", ["x"], 2)


def test_pairs_of_blocks_are_shared_out(spark, monkeypatch, tmp_path):
    real, folder = cluster._block_distances, str(tmp_path)

    def traced(sizes, width):
        distances = real(sizes, width)

        def run(pair):
            from pyspark import TaskContext
            open(f"{folder}/{TaskContext.get().partitionId()}", "w").close()
            return distances(pair)
        return run

    df = spark.range(400).select("id", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("x"), (F.col("id") % 2).alias("cluster"))
    before = cluster.silhouettes(df, "id", ["x"], ["cluster"])["cluster"]
    monkeypatch.setattr(cluster, "_block_distances", traced)
    after = cluster.silhouettes(df, "id", ["x"], ["cluster"], block_rows=20)["cluster"]
    assert abs(before - after) < 1e-9
    assert len(list(tmp_path.iterdir())) > 10  # 20 blocks, about 200 pairs


def test_points_spread_over_the_cores_give_the_same_clusters(spark, monkeypatch):
    df = spark.range(300).coalesce(1).select("id", (F.pmod(F.xxhash64("id"), F.lit(50)) + (F.col("id") % 3) * 200).cast("double").alias("x"))
    whole, cost = cluster.kmeans(df, "id", ["x"], 3, n_init=2)
    monkeypatch.setattr(cluster, "SPREAD_ROWS", 10)
    assert cluster._points(df, "id", ["x"]).rdd.getNumPartitions() >= 8
    spread, other = cluster.kmeans(df, "id", ["x"], 3, n_init=2)
    assert sorted(whole.collect()) == sorted(spread.collect()) and abs(cost - other) < 1e-6 * cost
