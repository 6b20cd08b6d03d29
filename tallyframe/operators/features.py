"""Pipeline stages: imputation, numeric scaling and one-hot encoding with rare-value grouping.

Each fitted stage keeps a few numbers or words per column as parameters, so a pipeline of them is stored and
loaded like any other, and its transform is a projection.
"""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.expressions import number, numbers
from tallyframe.operators.clean import top_value
from tallyframe.operators.profile import value_counts
from tallyframe.operators.quantiles import interpolated, order_statistics, quantile_values, ranks_around
from tallyframe.session import quoted

SCALER_MODES = ("standard", "minmax", "robust", "quantile")

# Fixed values of the quantile-to-normal mapping: distance from the edge that counts as the edge,
# and the normal score at which the edges are clipped.
EDGE_DISTANCE = 1e-7
EDGE_SCORE = 5.199337582605575


class _Columns(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def _configured(self, inputCols=None, outputCols=None, **extra):
        self._set(**{k: v for k, v in dict(inputCols=inputCols, outputCols=outputCols, **extra).items() if v is not None})
        return self

    def _pairs(self):
        return list(zip(self.getInputCols(), self.getOutputCols()))


class ColumnImputer(Estimator, _Columns):
    """Fill nulls with the exact median or with the most frequent value (smallest on ties)."""

    strategy = Param(Params._dummy(), "strategy", "median or mode", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCols=None, strategy="median"):
        super().__init__()
        self._configured(inputCols, outputCols, strategy=strategy)

    def _fit(self, df):
        cols = self.getInputCols()
        if self.getOrDefault("strategy") == "median":
            fills = {c: v[0] for c, v in quantile_values(df, cols, [0.5]).items()}
        else:
            fills = top_value(df, cols)
        return ColumnImputerModel(cols, self.getOutputCols(), json.dumps([fills[c] for c in cols]))


class ColumnImputerModel(Model, _Columns):
    fills = Param(Params._dummy(), "fills", "JSON list of fill values", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCols=None, fills=None):
        super().__init__()
        self._configured(inputCols, outputCols, fills=fills)

    def _transform(self, df):
        def fill(c, v):
            x = quoted(c) if isinstance(v, str) or v is None else number(df, c)
            return x if v is None else F.coalesce(x, F.lit(v))

        values = json.loads(self.getOrDefault("fills"))
        return df.withColumns({out: fill(c, v) for (c, out), v in zip(self._pairs(), values)})


class LinearScaler(Estimator, _Columns):
    """(x - centre) / spread: standard (population deviation), minmax or robust; a zero spread counts as 1."""

    mode = Param(Params._dummy(), "mode", "standard, minmax or robust", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCols=None, mode="standard"):
        super().__init__()
        self._configured(inputCols, outputCols, mode=mode)

    def _fit(self, df):
        cols, mode = self.getInputCols(), self.getOrDefault("mode")
        if mode == "robust":
            quartiles = quantile_values(df, cols, [0.25, 0.5, 0.75])
            found = [(q[1], None if q[0] is None else q[2] - q[0]) for q in (quartiles[c] for c in cols)]
        else:
            def stats(x):
                return (F.avg(x), F.stddev_pop(x)) if mode == "standard" else (F.min(x), F.max(x) - F.min(x))

            row = df.agg(*[F.array(*stats(number(df, c))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
            found = [tuple(row[f"s{i}"]) for i in range(len(cols))]
        return LinearScalerModel(cols, self.getOutputCols(), [c or 0.0 for c, _ in found], [s or 1.0 for _, s in found])


class LinearScalerModel(Model, _Columns):
    centres = Param(Params._dummy(), "centres", "one per column", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "one per column", TypeConverters.toListFloat)

    def __init__(self, inputCols=None, outputCols=None, centres=None, spreads=None):
        super().__init__()
        self._configured(inputCols, outputCols, centres=centres, spreads=spreads)

    def _transform(self, df):
        fitted = zip(self._pairs(), self.getOrDefault("centres"), self.getOrDefault("spreads"))
        return df.withColumns({
            out: (number(df, c) - F.lit(centre)) / F.lit(spread) for (c, out), centre, spread in fitted
        })


class QuantileNormalScaler(Estimator, _Columns):
    """Map every column to normal scores through its empirical quantiles, taken from all rows."""

    nQuantiles = Param(Params._dummy(), "nQuantiles", "most landmarks per column", TypeConverters.toInt)

    def __init__(self, inputCols=None, outputCols=None, nQuantiles=1000):
        super().__init__()
        self._configured(inputCols, outputCols, nQuantiles=nQuantiles)

    def _fit(self, df):
        cols = self.getInputCols()
        n = max(1, min(self.getOrDefault("nQuantiles"), df.count()))
        found = quantile_values(df, cols, np.linspace(0, 1, n).tolist())
        landmarks = [[] if found[c][0] is None else found[c] for c in cols]
        return QuantileNormalScalerModel(cols, self.getOutputCols(), landmarks)


class QuantileNormalScalerModel(Model, _Columns):
    landmarks = Param(Params._dummy(), "landmarks", "quantiles per column", TypeConverters.toListListFloat)

    def __init__(self, inputCols=None, outputCols=None, landmarks=None):
        super().__init__()
        self._configured(inputCols, outputCols, landmarks=landmarks)

    def _transform(self, df):
        return df.withColumns({
            out: normal_score(marks)(number(df, c)) if marks else F.lit(None).cast("double")
            for (c, out), marks in zip(self._pairs(), self.getOrDefault("landmarks"))
        })


# Coefficients of the rational approximations (AS 241), highest power first.
_MIDDLE = ([2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
            1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0],
           [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
            5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0])
_SIDE = ([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
          3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0],
         [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
          6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0])
_TAIL = ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
          2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0],
         [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
          1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0])


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Normal quantiles of shares from 0 to 1, by rational approximation over whole arrays."""
    q = p - 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.sqrt(-np.log(np.where(q < 0, p, 1 - p)))
        ratio = lambda parts, r: np.polyval(parts[0], r) / np.polyval(parts[1], r)
        outer = np.sign(q) * np.where(far <= 5, ratio(_SIDE, far - 1.6), ratio(_TAIL, far - 5))
        outer = np.where(np.isinf(far), np.sign(q) * np.inf, outer)
        return np.where(np.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q), outer)


def normal_score(landmarks: list[float]):
    """Arrow-batched UDF from a value to the normal score of its position between the landmarks."""
    marks = np.array(landmarks)
    shares = np.linspace(0, 1, len(marks))

    @F.arrow_udf(T.DoubleType())
    def score(values: pa.Array) -> pa.Array:
        x = values.to_numpy(zero_copy_only=False)
        back, distinct = pd.factorize(x, use_na_sentinel=False)
        # the middle of both directions: a value that fills several landmarks gets the centre of its share
        share = (np.interp(distinct, marks, shares) + 1 - np.interp(-distinct, -marks[::-1], 1 - shares[::-1])) / 2
        share = np.where(distinct + EDGE_DISTANCE > marks[-1], 1.0, share)
        share = np.where(distinct - EDGE_DISTANCE < marks[0], 0.0, share)
        z = inverse_normal(share)
        z = np.where(np.isnan(distinct), np.nan, np.clip(z, -EDGE_SCORE, EDGE_SCORE))
        return pa.array(z[back], mask=np.isnan(x))

    return score


def make_scaler(mode: str, inputCols: list[str], outputCols: list[str]) -> Estimator:
    """Scaler by name: standard, minmax, robust or quantile."""
    name = mode.lower()
    if name not in SCALER_MODES:
        raise ValueError(f"unknown scaler mode: {mode}")
    if name == "quantile":
        return QuantileNormalScaler(inputCols, outputCols)
    return LinearScaler(inputCols, outputCols, name)


def scale(df: DataFrame, cols: list[str], mode: str = "quantile") -> DataFrame:
    """Replace the columns by their scaled values."""
    return make_scaler(mode, cols, cols).fit(df).transform(df)


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return scale(df, cols, "standard")


def minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return scale(df, cols, "minmax")


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return scale(df, cols, "robust")


class RareOneHot(Estimator, _Columns):
    """One indicator per frequent value in sorted order, then one for all rarer values together.

    At most 1 / minFrequency values of a column are frequent, which bounds what the fit keeps.
    """

    minFrequency = Param(Params._dummy(), "minFrequency", "least share of the rows", TypeConverters.toFloat)

    def __init__(self, inputCols=None, outputCols=None, minFrequency=0.01):
        super().__init__()
        if not 0 < minFrequency <= 1:
            raise ValueError("minFrequency must lie in (0, 1]")
        self._configured(inputCols, outputCols, minFrequency=minFrequency)

    def _fit(self, df):
        cols, least = self.getInputCols(), self.getOrDefault("minFrequency")
        rows = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        total = {c: rows[f"n{i}"] for i, c in enumerate(cols)}
        needed = F.coalesce(*[F.when(F.col("column") == c, F.lit(least * n)) for c, n in total.items()])
        kept = {c: {} for c in cols}
        for r in value_counts(df, cols).where(F.col("cnt") >= needed).collect():
            kept[r["column"]][r["value"]] = r["cnt"]
        values = [sorted(kept[c]) for c in cols]
        rare = [sum(kept[c].values()) < total[c] for c in cols]
        return RareOneHotModel(cols, self.getOutputCols(), json.dumps(values), json.dumps(rare))


class RareOneHotModel(Model, _Columns):
    values = Param(Params._dummy(), "values", "JSON lists of frequent values", TypeConverters.toString)
    rare = Param(Params._dummy(), "rare", "JSON list: does the column have rarer values", TypeConverters.toString)

    def __init__(self, inputCols=None, outputCols=None, values=None, rare=None):
        super().__init__()
        self._configured(inputCols, outputCols, values=values, rare=rare)

    def _fitted(self):
        return zip(self._pairs(), json.loads(self.getOrDefault("values")), json.loads(self.getOrDefault("rare")))

    def names(self) -> list[list[str]]:
        return [[f"{c}_{v}" for v in values] + [f"{c}_infrequent"] * rare for (c, _), values, rare in self._fitted()]

    def _transform(self, df):
        columns, metadata = {}, {}
        for ((c, out), values, rare), names in zip(self._fitted(), self.names()):
            x = quoted(c).cast("string")
            flags = [F.when(x == v, 1.0).otherwise(0.0) for v in values]
            if rare:
                flags.append(F.when(x.isNotNull() & ~(x.isin(*values) if values else F.lit(False)), 1.0).otherwise(0.0))
            columns[out] = array_to_vector(F.array(*flags).cast("array<double>"))
            attributes = [{"idx": i, "name": n} for i, n in enumerate(names)]
            metadata[out] = {"ml_attr": {"attrs": {"numeric": attributes}, "num_attrs": len(names)}}
        df = df.withColumns(columns)
        for out, m in metadata.items():
            df = df.withMetadata(out, m)
        return df


class Preprocessor(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Imputer, scaler and encoder fitted together; the model is a pipeline of their models and fits what they would fit
    one after the other.

    One aggregate takes rows and moments, one the counts of the words (mode, rare values), and the passes of one
    selection the medians and all quantiles: those of the filled column are values of the raw one at shifted ranks.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "text columns", TypeConverters.toListString)
    mode = Param(Params._dummy(), "mode", "standard, minmax, robust or quantile", TypeConverters.toString)
    minFrequency = Param(Params._dummy(), "minFrequency", "least share of the rows", TypeConverters.toFloat)
    nQuantiles = Param(Params._dummy(), "nQuantiles", "most landmarks per column", TypeConverters.toInt)

    def __init__(self, numeric=(), categorical=(), mode="quantile", minFrequency=0.01, nQuantiles=1000):
        super().__init__()
        if mode.lower() not in SCALER_MODES:
            raise ValueError(f"unknown scaler mode: {mode}")
        if not 0 < minFrequency <= 1:
            raise ValueError("minFrequency must lie in (0, 1]")
        self._set(numeric=list(numeric), categorical=list(categorical), mode=mode.lower(), minFrequency=minFrequency, nQuantiles=nQuantiles)

    def _fit(self, df):
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        x = numbers(df, numeric)
        seen = x.agg(F.count("*").alias("rows"), *[
            F.struct(F.avg(f"x{i}").alias("mean"), F.var_pop(f"x{i}").alias("var"), F.min(f"x{i}").alias("least"), F.max(f"x{i}").alias("most")
                     ).alias(f"c{i}") for i in range(len(numeric))]).first()
        stages, inputs = [], []
        if numeric:
            stages += self._numeric_stages(df, numeric, seen)
            inputs += stages[-1].getOutputCols()
        if categorical:
            stages += self._word_stages(df, categorical, seen["rows"])
            inputs += stages[-1].getOutputCols()
        return PipelineModel([*stages, VectorAssembler(inputCols=inputs, outputCol="features")])

    def _numeric_stages(self, df, cols, seen):
        filled, scaled = [f"{c}__filled" for c in cols], [f"{c}__scaled" for c in cols]
        mode, rows = self.getOrDefault("mode"), seen["rows"]
        landmarks = max(1, min(self.getOrDefault("nQuantiles"), rows))
        probs = {"robust": [0.25, 0.5, 0.75], "quantile": np.linspace(0, 1, landmarks).tolist()}.get(mode, [])

        def below(n):
            """How many of n known values stand before the nulls, which are filled with the median."""
            return (n - 1) // 2 + 1

        def ranks(_, n):
            wanted = ranks_around(rows, probs)
            own = np.r_[wanted[wanted < below(n)], wanted[wanted >= below(n) + rows - n] - (rows - n)]
            return np.r_[ranks_around(n, [0.5]), own]

        medians, fitted = [], []
        for i, (n, at) in enumerate(order_statistics(df, cols, ranks)):
            median = interpolated(n, [0.5], at.get)[0]

            def value_at(rank, n=n, at=at, median=median):
                return at[rank] if rank < below(n) else median if rank < below(n) + rows - n else at[rank - (rows - n)]

            medians.append(median)
            c = seen[f"c{i}"]
            if n == 0:
                fitted.append([] if mode == "quantile" else (0.0, 1.0))
            elif mode == "standard":
                mean = (n * c["mean"] + (rows - n) * median) / rows
                var = (n * (c["var"] + (c["mean"] - mean) ** 2) + (rows - n) * (median - mean) ** 2) / rows
                fitted.append((mean, var**0.5 or 1.0))
            elif mode == "minmax":
                fitted.append((c["least"], (c["most"] - c["least"]) or 1.0))
            else:
                q = interpolated(rows, probs, value_at)
                fitted.append(q if mode == "quantile" else (q[1], (q[2] - q[0]) or 1.0))
        imputer = ColumnImputerModel(cols, filled, json.dumps(medians))
        if mode == "quantile":
            return [imputer, QuantileNormalScalerModel(filled, scaled, fitted)]
        return [imputer, LinearScalerModel(filled, scaled, [a for a, _ in fitted], [b for _, b in fitted])]

    def _word_stages(self, df, cols, rows):
        filled, hot, least = [f"{c}__filled" for c in cols], [f"{c}__onehot" for c in cols], self.getOrDefault("minFrequency")
        if any(df.schema[c].dataType.simpleString() != "string" for c in cols):  # their fill has a type of its own
            imputer = ColumnImputer(cols, filled, "mode").fit(df)
            return [imputer, RareOneHot(filled, hot, least).fit(imputer.transform(df))]
        counts = value_counts(df, cols).select("column", "value", "cnt")
        often = F.when(F.col("cnt") >= F.lit(least * rows), F.struct("value", "cnt"))  # 1 / least words at most
        found = {r["column"]: r for r in counts.groupBy("column").agg(
            F.min(F.struct((-F.col("cnt")).alias("order"), "value")).alias("best"), F.sum("cnt").alias("known"),
            F.collect_list(often).alias("often")).collect()}
        fills, values, rare = [], [], []
        for c in cols:
            r = found.get(c)
            kept = {w["value"]: w["cnt"] for w in r["often"]} if r else {}
            if r:
                top = -r["best"]["order"] + rows - r["known"]
                if top >= least * rows:
                    kept[r["best"]["value"]] = top
            fills.append(r["best"]["value"] if r else None)
            values.append(sorted(kept))
            rare.append(bool(r) and sum(kept.values()) < rows)
        return [ColumnImputerModel(cols, filled, json.dumps(fills)), RareOneHotModel(filled, hot, json.dumps(values), json.dumps(rare))]


def build_preprocessor(
    numeric: list[str], categorical: list[str], mode: str = "quantile", min_frequency: float = 0.01
) -> Preprocessor:
    """Numeric: median, then scaler. Categorical: most frequent value, then one-hot. Result in `features`."""
    return Preprocessor(numeric, categorical, mode, min_frequency)


def feature_names(preprocessor: PipelineModel) -> list[str]:
    """Names of the positions of the `features` vector."""
    names = []
    for stage in preprocessor.stages:
        if isinstance(stage, (LinearScalerModel, QuantileNormalScalerModel)):
            names += [c.removesuffix("__filled") for c in stage.getInputCols()]
        elif isinstance(stage, RareOneHotModel):
            for (c, _), group in zip(stage._pairs(), stage.names()):
                names += [c.removesuffix("__filled") + n.removeprefix(c) for n in group]
    return names
