"""Language ID by Bayesian evidence: text, declared language, address suffix, and priors of hosts.

A class per declared language, and one more, `und`, for texts without language, under which all
letter triples are equally likely. Each evidence adds the logarithm of its likelihood:

* text: hashed triples of bytes, smoothed, worth EFFECTIVE triples at most since neighbours depend on each other;
* declared language and address suffix: how much more often the value goes with a class (guessed by the text alone) than
  with any row, drawn towards "no more often" by STRENGTH rows;
* host: the share of the classes among its rows, drawn towards the share in its domain, drawn towards that in all rows.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import bounded_batches, documents, forget_worker_state, packed, stored, utf8
from tallyframe.llm.registry import query
from tallyframe.session import quoted

UND = "und"
BUCKETS = 1 << 14
EFFECTIVE = 100
STRENGTH = 100.0
UND_PRIOR = 1e-3
MIN_CONFIDENCE = 0.5
# The text model learns from about so many rows per declared language.
TRAIN_ROWS = 1000
# With more classes than these the text model keeps only the buckets that a class has seen.
DENSE_CLASSES = 128

_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def triples(text: bytes) -> np.ndarray:
    """Buckets of the text's byte triples; letters are lower-cased and runs of other ASCII count as one space."""
    line = b" ".join(text.translate(_LETTERS).split())
    if not line:
        return np.zeros(0, np.uint32)
    a = np.frombuffer(b" " + line + b" ", np.uint8).astype(np.uint32)
    code = (a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]) * np.uint32(2654435761)
    return code >> np.uint32(32 - 14)


class TextModel:
    """Log likelihood of triples per class, `und` last."""

    def __init__(self, names: list[str], place: np.ndarray, bucket: np.ndarray, n: np.ndarray, dense_classes: int = DENSE_CLASSES):
        """From how often (n) the triples of a bucket stand in the sample of the language at a place of `names`."""
        self.names = [*names, UND]
        sums = np.bincount(place, weights=n, minlength=len(names))
        unseen = np.r_[np.log(0.1 / (sums + 0.1 * BUCKETS)), -3 * math.log(27)]
        more = np.log((n + 0.1) / 0.1)
        if len(self.names) <= dense_classes:
            self.table = np.repeat(unseen[None, :], BUCKETS, axis=0)
            self.table[bucket, place] += more
            self.table = self.table.astype(np.float32)
            return
        order = np.argsort(bucket, kind="stable")
        self.table, self.unseen = None, unseen
        self.place, self.more = place[order].astype(np.int32), more[order].astype(np.float32)
        self.starts = np.r_[0, np.cumsum(np.bincount(bucket, minlength=BUCKETS))]

    def scores(self, text: bytes) -> np.ndarray | None:
        """Weighted sums for each class, None for a text without letters."""
        at = triples(text)
        if not len(at):
            return None
        weight = min(1.0, EFFECTIVE / len(at))
        if self.table is not None:
            return self.table[at].sum(axis=0, dtype=np.float64) * weight
        bucket, times = np.unique(at, return_counts=True)
        sizes = self.starts[bucket + 1] - self.starts[bucket]
        here = np.repeat(self.starts[bucket] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        more = np.bincount(self.place[here], weights=self.more[here] * np.repeat(times, sizes), minlength=len(self.names))
        return (self.unseen * len(at) + more) * weight


def primary(declared):
    """`en` from ` EN-us `; empty becomes null."""
    tag = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(tag != "", tag)


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Fit the text model on rows (text, declared): a sample of about `train_rows` rows per language, by hash."""
    sizes = rows.where("declared IS NOT NULL").groupBy("declared").count().collect()  # a row per language
    names = sorted(r["declared"] for r in sizes)
    if not names:
        return TextModel([], *[np.zeros(0, np.int64)] * 3)
    draw = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) / float(1 << 30)
    large = [r for r in sizes if r["count"] > train_rows]
    kept = F.lit(True)
    if large:
        share = F.create_map(*[x for r in large for x in (F.lit(r["declared"]), F.lit(train_rows / r["count"]))])
        kept = draw < F.coalesce(F.try_element_at(share, F.col("declared")), F.lit(1.0))
    sample = rows.where(F.col("declared").isNotNull() & kept).select("declared", "text")

    def run(batches):
        found = Counter()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                at, n = np.unique(triples(text), return_counts=True)
                found.update({(name, int(i)): int(k) for i, k in zip(at, n)})
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array(found.values(), pa.int64())], names=["name", "bucket", "n"])

    summed = sample.mapInArrow(run, "name string, bucket int, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toArrow()  # at most BUCKETS numbers for each language
    coded = found.column("name").combine_chunks().dictionary_encode()
    places = {name: i for i, name in enumerate(names)}
    place = np.array([places[name] for name in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    return TextModel(names, place, found.column("bucket").to_numpy(), found.column("n").to_numpy())


def text_scores(model: TextModel, text):
    """Column array<double> of the classes' log likelihoods, null for texts without letters."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_worker_state()
        for texts in batches:
            rows = [model.scores(t) for t in utf8(texts)]
            yield pa.array([None if r is None else r.tolist() for r in rows], pa.list_(pa.float64()))

    return run(text)


def _best(scores):
    """Place of the largest score, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _per_class(seen: DataFrame, keys: list[str], classes: int) -> DataFrame:
    """(keys, by, all): rows of each class, in an array, and of all."""
    found = seen.groupBy(*keys, "guess").agg(F.sum("n").cast("double").alias("n")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("found"), F.sum("n").alias("all"))
    return found.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(
        F.try_element_at("found", i), F.lit(0.0))).alias("by"), "all")


def _lift(seen: DataFrame, value: str, totals: list[float]) -> DataFrame:
    """(value, lift): log of how much more often `value` goes with each class than with any row."""
    share = F.col("all") / sum(totals)
    by = _per_class(seen.where(F.col(value).isNotNull()), [value], len(totals))
    return by.select(value, F.zip_with("by", F.lit(totals), lambda b, t: F.log(
        (b + STRENGTH * share) / ((t + STRENGTH) * share))).alias(f"{value}_lift"))


def _priors(seen: DataFrame, totals: list[float]) -> DataFrame:
    """(host, host_prior): log shares of the classes, smoothed from the host to its domain to all rows."""
    n, classes = sum(totals), len(totals)
    overall = F.lit([(t + 1) / (n + classes) for t in totals])
    domains = _per_class(seen.where("domain IS NOT NULL"), ["domain"], classes).select(
        "domain", F.zip_with("by", overall, lambda b, p: (b + STRENGTH * p) / (F.col("all") + STRENGTH)).alias("parent"))
    hosts = _per_class(seen.where("host IS NOT NULL"), ["host", "domain"], classes)
    return hosts.join(domains, "domain").select("host", F.zip_with("by", "parent", lambda b, p: F.log(
        (b + STRENGTH * p) / (F.col("all") + STRENGTH))).alias("host_prior"))


def identify(df: DataFrame, text, declared=None, host=None, min_confidence: float = MIN_CONFIDENCE,
             train_rows: int = TRAIN_ROWS, out: str = "_language") -> DataFrame:
    """Add (or replace) the struct `out` (language, confidence, accepted) to the rows of `df`.

    `text`, `declared` and `host` are columns; null ones, and values seen nowhere, are no evidence. A host's suffix is its
    last label and its domain its last two; a host without a dot has no suffix and is its own domain. Accepted are rows
    whose text has letters, whose language isn't `und` and has a posterior of at least `min_confidence`. A null or empty
    text is `und` with confidence 0; with no declared language in the whole table all rows are. Repeated rows count as
    often as they stand; an empty table stays empty. Host counts are taken in one grouped aggregate; a host with a third
    of the rows is summed before the shuffle.
    """
    declared = F.lit(None).cast("string") if declared is None else primary(declared)
    host = F.lit(None).cast("string") if host is None else F.when(F.trim(host) != "", F.lower(F.trim(host)))
    labels = F.split(host, r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    domain = F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(host)
    evidence = {"text": F.coalesce(text, F.lit("")), "declared": declared, "host": host, "domain": domain, "suffix": suffix}
    df = packed(bounded_batches(df), **{f"_lid_{n}": c for n, c in evidence.items()})
    evidence = {n: F.col(f"_lid_{n}") for n in evidence}
    model = train(df.select(*[evidence[n].alias(n) for n in ("text", "declared")], F.xxhash64(*evidence.values()).alias("row")), train_rows)
    guess = df.select(*[c.alias(n) for n, c in evidence.items()]).withColumn("scores", text_scores(model, F.col("text")))
    seen = stored(guess.where("scores IS NOT NULL").withColumn("guess", _best(F.col("scores")))
                  .groupBy("host", "domain", "suffix", "declared", "guess").agg(F.count("*").alias("n")))
    counts = {r["guess"]: float(r["n"]) for r in seen.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    totals = [counts.get(i, 0.0) for i in range(len(model.names))]
    flat = [math.log((t + 1) / (sum(totals) + len(totals))) for t in totals]
    flat[-1] = min(flat[-1], math.log(UND_PRIOR))
    joined = df.drop("_lid_domain")
    for value, table in (("declared", _lift(seen, "declared", totals)), ("suffix", _lift(seen, "suffix", totals)),
                         ("host", _priors(seen, totals))):
        key, found = table.columns
        table = table.select(F.col(key).alias(f"_lid_{value}"), F.col(found).alias(f"_lid_{found}"))
        joined = joined.join(sized_arrays(table, len(totals)), f"_lid_{value}", "left")
    joined = joined.withColumn("_lid_scores", text_scores(model, F.col("_lid_text")))
    none, prior = F.array(*[F.lit(0.0)] * len(totals)), F.array(*[F.lit(p) for p in flat])
    total = F.col("_lid_scores")
    for part in (F.coalesce("_lid_declared_lift", none), F.coalesce("_lid_suffix_lift", none),
                 F.coalesce("_lid_host_prior", prior)):
        total = F.zip_with(total, part, lambda a, b: a + b)
    joined = joined.withColumn("_lid_total", total)
    best = F.array_max("_lid_total")
    mass = F.aggregate("_lid_total", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    name = F.element_at(F.array(*[F.lit(n) for n in model.names]), _best(F.col("_lid_total")) + 1)
    language, confidence = F.coalesce(name, F.lit(UND)), F.coalesce(1 / mass, F.lit(0.0))
    verdict = F.struct(language.alias("language"), confidence.alias("confidence"),
                       ((language != UND) & (confidence >= min_confidence)).alias("accepted"))
    fields = [n for n in df.schema["own"].dataType.names if n != out]
    return joined.select(*[F.col("own").getField(n).alias(n) for n in fields], verdict.alias(out))


def sized_arrays(table: DataFrame, width: int) -> DataFrame:
    """`table` of (key, array of `width` numbers) as a join side: measured by its keys, with the arrays' bytes as a unit."""
    return F.broadcast(table) if _fits(table, width) else table


def _fits(table: DataFrame, width: int) -> bool:
    key = table.columns[0]
    most = max(1, (32 << 20) // (8 * width + 64))
    return table.select(key).limit(most + 1).count() <= most


def keep_identified(df: DataFrame, text: str, declared: str | None = None, host: str | None = None) -> DataFrame:
    """Rows of accepted language, with all their columns."""
    verdict = "verdict"
    while verdict in df.columns:
        verdict += "_"
    found = identify(df, quoted(text), declared and quoted(declared), host and quoted(host), out=verdict)
    return found.where(F.col(verdict)["accepted"]).select(*[quoted(c) for c in df.columns])


@query()
def op5_language_id(spark, folder):
    """Documents: `lang` is the declared language and `source` the host."""
    docs = documents(spark, folder).select("doc_id", "text", "lang", "source")
    return identify(docs, F.col("text"), F.col("lang"), F.col("source")).select(
        "doc_id", "_language.language", F.round("_language.confidence", 6).alias("confidence"),
        F.col("_language.accepted").alias("kept"))


@query()
def language_id_pages(spark, folder):
    """Pages: the language declared in the markup, the address's host, and the text without markup."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return identify(pages, text, declared, F.try_parse_url(F.col("url"), F.lit("HOST"))).select(
        "page_id", "_language.language", F.round("_language.confidence", 6).alias("confidence"), "_language.accepted")
