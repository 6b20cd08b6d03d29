"""Counts of every text column's values within every class, taken once and read by many profiles."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import profile, scores
from tallyframe.session import checkpointed, quoted


class CountCube:
    """(column, value, class, n) of a table, stored; nulls of values and classes are counted too.

    One scan adds up partial counts per partition, so a value that fills most rows costs no more than any other. What is
    read from it equals the operator of the same name on the table.
    """

    def __init__(self, df: DataFrame, cols: list[str], target: str = "target"):
        if not cols:
            raise ValueError("a cube needs columns to count")
        self.cols = cols
        names = [f"v{i}" for i in range(len(cols))]
        words = df.select(quoted(target).alias("class"), *[quoted(c).cast("string").alias(n) for c, n in zip(cols, names)])
        label = F.element_at(F.array(*[F.lit(c) for c in cols]), F.substring("place", 2, 9).cast("int") + 1)
        self.table = checkpointed(
            words.unpivot(["class"], names, "place", "value").groupBy("place", "value", "class").agg(F.count("*").alias("n"))
            .select(label.alias("column"), "value", "class", "n"))

    def _of(self, column: str) -> DataFrame:
        return self.table.where(F.col("column") == column)

    def value_counts(self, top: int | None = None) -> DataFrame:
        counts = self.table.where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("n").alias("cnt"))
        return profile.with_shares(counts, self._of(self.cols[0]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), top)

    def distinct_counts(self) -> DataFrame:
        found = self.table.where("value IS NOT NULL").select("column", "value").distinct().groupBy("column").agg(F.count("*").alias("n"))
        all_columns = self.table.sparkSession.createDataFrame([(c,) for c in self.cols], "column string")
        return all_columns.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0).cast("long")).alias("n_distinct"))

    def class_balance(self) -> DataFrame:
        return profile.balance_of(self._of(self.cols[0]).groupBy(F.col("class").alias("target")).agg(F.sum("n").alias("cnt")))

    def crosstab_rate(self, cat: str) -> DataFrame:
        counts = self._of(cat).where("value IS NOT NULL AND class IS NOT NULL")
        return profile.class_shares(counts.select(F.col("value").alias(cat), F.col("class").alias("_t"), F.col("n").alias("_n")), cat)

    def mutual_info(self) -> DataFrame:
        """Of the coded columns, in which nulls are a value."""
        value = F.coalesce("value", F.lit(scores.UNKNOWN)).alias("value")
        joint = self.table.where("class IS NOT NULL").groupBy(F.col("column").alias("feature"), value, F.col("class").alias("_class")) \
            .agg(F.sum("n").alias("n"))
        return scores.plug_in_information(joint)
