"""Stored models and the inline sample of rows to score."""

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

# The four sample customers.
SAMPLE_SCHEMA = (
    "customer int, age long, `class of worker` string, education string, `marital stat` string, "
    "`major occupation code` string, race string, sex string, `capital gains` long, `capital losses` long, "
    "`weeks worked in year` long, `num persons worked for employer` long"
)
SAMPLE_CUSTOMERS = [
    (1, 39, "Not in universe", "Bachelors degree(BA AB BS)", "Married-civilian spouse present",
     "Not in universe", "White", "Male", 0, 1000, 52, 1),
    (2, 20, "Not in universe", "Bachelors degree(BA AB BS)", "Never married",
     "Handlers equip cleaners etc", "Black", "Female", 1000, 0, 30, 0),
    (3, 45, "Self-employed-not incorporated", "Masters degree(MA MS MEng MEd MSW MBA)",
     "Married-civilian spouse present", "Professional specialty", "Asian or Pacific Islander", "Male",
     5178, 800, 50, 3),
    (4, 60, "Private", "Some college but no degree", "Divorced",
     "Adm support including clerical", "White", "Female", 0, 300, 48, 1),
]


def sample_customers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_CUSTOMERS, SAMPLE_SCHEMA)


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    """Store the fitted pipeline with its description (name, features, metrics, scaler mode, ...)."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/meta").first()["value"])
