import os
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, ids int, fp double, kept string"
MAIL = "Write to jane.doe@mail.example.com or call +1 (415) 555-2671 about the garden, the old house and its seven windows."
EDGES = [
    (9001, None, "en", "src0", None, "a", 1, 0.5, "x"), (9002, "", None, None, 0, None, None, None, None),
    (9003, " \n\t ", "en", "src1", 4, "b", 2, None, "y"), (9004, "One", "en", "src1", 3, "b", 2, 1.0, "y"),
    (9005, "Straße ÉCOLE 東京 😀 naïve\x1c İstanbul  two\n \nspaces", "de", "src2", 40, "b", 2, 1.0, "y"),
    (9006, "the quick brown fox jumps over one lazy dog near a river bank " * 4000, "en", "src0", 1, "b", 2, 1.0, "y"),
    (9007, MAIL, "en", "src3", 1, "c", 3, 2.0, "z"), (9007, MAIL, "en", "src3", 1, "c", 3, 2.0, "z"),
    (9007, MAIL, "en", "src3", 1, "c", 3, 2.0, "z"), (9008, MAIL + " Now.", None, "src3", 1, "c", 3, 2.0, "z"),
    (None, MAIL, "en", None, 1, "c", 3, 2.0, "z"), (9007, "another text under a number that was used before", "en", "s", 1, "c", 3, 2.0, "z"),
    (9009, "x" * 3000 + " " + "4" * 3000, "en", "src3", 1, "c", 3, 2.0, "z"),
]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Generated documents and edge rows, with columns whose names the operators also use."""
    path = str(tmp_path_factory.mktemp("documents"))
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMA) if f.name not in plain.columns}
    plain = plain.withColumns({n: F.lit(None).cast(t) for n, t in extra.items()})
    plain.unionByName(spark.createDataFrame(EDGES, SCHEMA)).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def docs(spark, folder):
    """(doc_id, text) of all rows."""
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    return [(r[0], r[1]) for r in rows]
