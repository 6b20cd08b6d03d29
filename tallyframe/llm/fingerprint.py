"""Document fingerprints: every shingle hash below a fixed fraction of all hashes, in DataFrame functions only.

A sketch is a sorted array of 63-bit hashes of five-word shingles: all below 2 ** 63 / 2 ** BITS, and at least the LEAST
smallest ones, so that short texts are told apart too. It holds every hash of its text up to a limit that can be read from
it, hence two sketches are compared, and merged, below the smaller of their limits. A long text keeps a sketch in
proportion to its length, which makes containment estimates between very unequal documents possible.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import documents, ordered_cells
from tallyframe.llm.registry import query

SHINGLE = 5
BITS = 3
LEAST = 16
TOP = (1 << 63) - 1


def with_sketch(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Add the sketch of the whole text (null: empty) as column `name`: array<long>, empty for a text without words.

    Words are lower-cased and end at ASCII white space; a text of fewer words than a shingle is one shingle. Every step is
    a column of its own, since array functions evaluate what they refer to again for each element.
    """
    words, all_, low = f"{name}_words", f"{name}_all", f"{name}_low"
    df = df.withColumn(words, F.split(F.trim(F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\t\n\x0b\x0c\r", " " * 5)), " +"))
    w, n = F.col(words), F.size(words)
    at = F.sequence(F.lit(0), n - shingle)
    hashes = F.when((n == 1) & (w[0] == ""), F.array().cast("array<long>")) \
        .when(n < shingle, F.array(F.shiftrightunsigned(F.xxhash64(w), 1))) \
        .otherwise(F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]), 1)))
    df = df.withColumn(all_, hashes).drop(words)
    df = df.withColumn(low, F.array_distinct(F.filter(all_, lambda h: h < 1 << 63 - bits)))
    kept = F.when(F.size(low) >= LEAST, F.array_sort(low)).otherwise(F.slice(F.array_sort(F.array_distinct(all_)), 1, LEAST))
    return df.withColumn(name, kept).drop(all_, low)


def limit(sketch: Column, bits: int = BITS) -> Column:
    """Up to which hash the sketch is complete."""
    return F.when(F.size(sketch) < LEAST, F.lit(TOP)).otherwise(
        F.greatest(F.lit((1 << 63 - bits) - 1), F.element_at(sketch, -1)))


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    most = F.least(limit(a), limit(b))
    return F.filter(a, lambda h: h <= most), F.filter(b, lambda h: h <= most)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles, 0 to 1; two texts without words are alike."""
    x, y = _common(a, b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(union == 0, 0.0).otherwise(
        F.size(F.array_intersect(x, y)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; a text without words is contained in any."""
    x, y = _common(a, b)
    return F.when(F.size(x) == 0, F.when(F.size(a) == 0, 1.0).otherwise(0.0)).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(x))


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together, complete up to the smaller of the limits."""
    x, y = _common(a, b)
    return F.array_sort(F.array_union(x, y))


def written(sketch: Column) -> Column:
    """The sketch as text: 16 lowercase hex digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def with_next(df: DataFrame, key: str, carry: list[str], prepare) -> DataFrame:
    """Add `_next_<c>` for every column c of `carry` from the row that follows in descending `key`, the first after the last.

    Null keys come last; rows of one key follow the hash of their carried columns; a lone row follows itself. Rows meet in
    cells of neighbouring keys, and the first row of each cell is also laid at the end of the cell before it: at most
    MAX_CELLS marks are broadcast for that. `prepare` is applied to the rows of a cell after the shuffle, and may add
    columns to carry.
    """
    rank = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    cell, _ = ordered_cells(df.select(key), key)
    ranked = df.withColumns({"_rank": rank, "_cell": cell})
    heads = ranked.groupBy("_cell").agg(F.max("_rank").alias("_rank"))
    around = Window.orderBy("_cell")
    above = F.coalesce(F.lead("_cell").over(around), F.first("_cell").over(around))
    marks = heads.select("_rank", above.alias("_above"))
    laid = ranked.join(F.broadcast(marks), "_rank", "left")
    places = F.array(F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("copy")),
                     F.struct(F.col("_above").alias("cell"), F.lit(True).alias("copy")))
    laid = laid.withColumn("_place", F.explode(F.filter(places, lambda p: p["cell"].isNotNull()))) \
        .withColumns({"_cell": F.col("_place.cell"), "_copy": F.col("_place.copy")}).drop("_place", "_above")
    ready = prepare(laid.withColumn("_tie", F.xxhash64(*df.columns)).repartition("_cell"))
    order = Window.partitionBy("_cell").orderBy("_copy", F.desc("_rank"), "_tie")
    return ready.withColumns({f"_next_{c}": F.lead(c).over(order) for c in carry}).where("NOT _copy") \
        .drop("_cell", "_rank", "_copy", "_tie")


@query()
def op3_document_fingerprints(spark, folder):
    docs = documents(spark, folder).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(docs, "doc_id", ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next_text", F.lit(1), third))
    pairs = with_sketch(pairs.withColumn("edited", edited), "edited", "other")
    sketch, other, following = F.col("sketch"), F.col("other"), F.col("_next_sketch")
    return pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(sketch).alias("fingerprint"), written(other).alias("edited_fingerprint"),
        likeness(sketch, other).alias("near_edited"), likeness(sketch, following).alias("near_next"))
