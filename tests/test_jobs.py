import pytest
from pyspark.sql import functions as F

from tallyframe.operators import models
from tallyframe.plans import classifier, exploration
from tallyframe.sources.stored_models import load_model, sample_customers, save_model
from tallyframe.sources.tables import write_table


@pytest.fixture(scope="module")
def trained(census):
    prepared = classifier.prepare(census, "id")
    return prepared, classifier.train_classifiers(prepared, "id", num_trees=5, forest_depth=5, rounds=3)


def test_preparation_keeps_all_rows(census, trained):
    prepared, _ = trained
    assert prepared.count() == census.count()
    assert prepared.where("age = 0").count() == 0
    cut = census.agg(F.percentile("capital gains", 0.99)).first()[0]
    assert prepared.agg(F.max("capital gains")).first()[0] <= cut
    assert prepared.where(F.col("id") == 17).first()["target"] == 1  # null label
    assert prepared.where(F.col("class of worker") == "?").count() == 0
    assert prepared.where(F.col("class of worker").isNull()).count() == census.where("trim(`class of worker`) = '?'").count()
    nan = classifier.prepare(census, "id", null_token="nan", padded_sentinel="keep")
    assert nan.where(F.col("class of worker") == "?").count() == census.where("trim(`class of worker`) = '?'").count()
    assert nan.where(F.col("marital stat") == "nan").count() == census.where(F.col("marital stat") == "?").count()


def test_three_models_are_compared(trained):
    _, out = trained
    table = {r["model"]: r for r in out["table"].collect()}
    assert list(table) == [models.LOGISTIC, models.FOREST, models.BOOSTED]
    assert all(r["roc_auc"] > 0.75 and 0 <= r["pr_auc"] <= 1 for r in table.values())
    assert out["best"] == max(table, key=lambda n: table[n]["pr_auc"])
    for importance in out["importance"].values():
        rows = importance.collect()
        assert sum(r["importance"] for r in rows) == pytest.approx(1) and len(rows) == len(out["meta"]["feature_names_out"])
        assert rows[0]["importance"] >= rows[-1]["importance"]
    matrix = out["confusion"][out["best"]].first()
    assert sum(matrix) == out["reports"][out["best"]].where("class = 'accuracy'").first()["support"]


def test_stored_model_scores_the_samples(spark, trained, tmp_path):
    _, out = trained
    for name, model in out["models"].items():
        path = str(tmp_path / name.replace(" ", "_"))
        save_model(model, {**out["meta"], "model_name": name}, path)
        again, meta = load_model(spark, path)
        assert meta["model_name"] == name and len(meta["selected_features"]) == 11
        first = models.score_customers(model, sample_customers(spark)).orderBy("customer").collect()
        second = models.score_customers(again, sample_customers(spark)).orderBy("customer").collect()
        assert first == second and [r["customer"] for r in first] == [1, 2, 3, 4]
        for r in first:
            assert r["confidence_pct"] == pytest.approx(100 * r["probability_high"])
            assert r["predicted_income"] == (">$50K" if r["prediction"] == 1 else "≤$50K")
        assert first[0]["education_short"] == "Bachelors degree(BA AB BS)..."


def test_exploration_tables(census):
    out = exploration.explore(census.drop("id"))
    for name, table in out.items():
        assert table.count() >= 0, name
    summary = out["insights"].first()
    assert (summary["rows"], summary["features"], summary["categoricals"]) == (6000, 12, 6)
    assert summary["class_0"] + summary["class_1"] == 6000 and len(summary["top_features"]) == 5
    assert summary["top_features"][0] == "weeks worked in year"


def test_near_unique_noise_does_not_lead_the_ranking(census):
    noise = F.pmod(F.xxhash64("id", F.lit("noise")), F.lit(1 << 40)) / float(1 << 40)
    df = census.select("id", "education", "weeks worked in year", "label", noise.alias("noise"))
    for key in ("id", None):
        found = {r["feature"]: r["mutual_info"] for r in exploration.explore(df if key else df.drop("id"), key=key)["mutual_info"].collect()}
        assert set(found) == {"education", "weeks worked in year", "noise"}
        assert found["noise"] < 0.02 < found["weeks worked in year"] and max(found, key=found.get) == "weeks worked in year"


def test_cleaning_and_scoring_run_on_streams(spark, census, trained, tmp_path):
    prepared, out = trained
    write_table(prepared.limit(200), str(tmp_path / "rows"))
    stream = spark.readStream.schema(prepared.schema).parquet(str(tmp_path / "rows"))
    query = (models.score_customers(out["model"], stream).writeStream.format("memory").queryName("scored")
             .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert spark.table("scored").count() == 200
