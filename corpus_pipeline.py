"""From raw documents to packed training sequences, stage by stage.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of `docs`, in any case of nulls, empty
or long texts, repeated rows, empty tables and further columns; the operators' docstrings say what becomes of each.
"""

from tallyframe.llm import language, packing, pii, quality, simhash
from tallyframe.llm.common import stored


def identify_language(spark, docs, sf_dir):
    """Documents whose language is known go on; `lang` is taken as declared and `source` as the host."""
    return language.keep_identified(docs, "text", "lang", "source")


def apply_quality_rules(spark, docs, sf_dir):
    """Documents that no quality rule rejects go on."""
    return quality.keep_good(docs, "text")


def drop_near_duplicates(spark, docs, sf_dir):
    """The document of the least id goes on from every group that fingerprints within 3 bits link."""
    return simhash.drop_near_duplicates(docs, "doc_id", "text")


def redact_personal_data(spark, docs, sf_dir):
    """All documents go on, with personal data replaced by its kind."""
    return pii.redact(docs, "text")


def pack_sequences(spark, docs, sf_dir):
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.packed_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Hash functions and learned models have no SQL counterpart; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
