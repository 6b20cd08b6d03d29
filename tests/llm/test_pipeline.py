from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tallyframe.llm import language, pii, quality
from tallyframe.llm.common import documents, shared_folder, stored
from test_simhash import plain_components, plain_fingerprint
from test_tokens import packed_documents


def test_registered(spark):
    assert corpus_pipeline.STAGES and "pipeline" in contract.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in contract.queries() if n.startswith("op")) == list(range(1, 14))


def test_rows_equal_brute_force(spark, folder):
    """Stages with a learned model are asked for their verdict on single texts, the rest is recomputed without Spark."""
    df = documents(spark, folder)
    told = language.identify(df, df["text"], df["lang"], df["source"]).where("_language.accepted")
    rows = [(r.doc_id, r.text) for r in told.collect()]
    rules = list(quality.RULES)
    rows = [(d, t) for d, t in rows if quality.first_rejection(quality.Text(t), rules) is None]
    groups = defaultdict(list)
    for (d, t), root in zip(rows, plain_components([plain_fingerprint(t) for _, t in rows])):
        groups[root].append((d is None, d or 0, t))
    ids = Counter((None if n else d) for n, d, _ in (min(g) for g in groups.values()))

    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, folder))
        assert after.schema.names == df.schema.names
        if name == "simhash_near_dedup":
            assert Counter(r.doc_id for r in after.select("doc_id").collect()) == ids
        if name == "pii":
            assert {(r.doc_id, r.text) for r in pii.redact(docs, "text").collect()} == {(r.doc_id, r.text) for r in after.collect()}
        docs = after
    final = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(d for d, _ in final) == ids
    packed_documents(corpus_pipeline.run(spark, folder).collect(), final)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_tables(spark, empty, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, documents(spark, empty), empty).count() == 0


CLASHES = ["_text", "_cut", "_row", "_language", "_lid_text", "own", "row", "id", "key0", "verdict", "piece", "start", "node", "fp", "chunk", "a.b", "x`y"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_columns_of_any_name(spark, folder, stage):
    """Names that the operators use, a name with a dot, one with a quote, and a map, which has no hash or order."""
    df = documents(spark, folder).limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    wide = df.withColumns({n: F.lit(i) for i, n in enumerate(CLASHES)} | {"of": F.create_map(F.lit("k"), F.col("doc_id"))})
    run = corpus_pipeline.STAGES[stage][1]
    plain, after = run(spark, df, folder), run(spark, wide, folder)
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in plain.collect())
    if stage < 4:
        assert after.columns == wide.columns
        for r in after.collect():
            assert [r[n] for n in CLASHES] == list(range(len(CLASHES))) and r["of"] == {"k": r.doc_id}
        assert Counter(tuple(r[c] for c in df.columns) for r in after.collect()) == Counter(tuple(r) for r in plain.collect())


def test_shared_folder_is_needed_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        shared_folder(Session)
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        shared_folder(Session)
