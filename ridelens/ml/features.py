"""Feature stages for Spark ML pipelines (M1–M8).

Everything is a standard ``pyspark.ml`` stage except three small Estimator/Model pairs, whose fitted state is
persisted as plain params so that ``PipelineModel.save/load`` works: :class:`LevelGrouper` groups infrequent categorical
levels and fills missing ones with the most frequent level (Spark's ``Imputer`` only handles numbers; the grouped levels
are bounded by ``MAX_LEVELS``); :class:`ExactRobustScaler` and :class:`ExactMedianImputer` use exact percentiles without
a task that holds a whole column.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import (
    Imputer,
    MinMaxScaler,
    OneHotEncoder,
    RobustScaler,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INFREQUENT = "__infrequent__"
MISSING = "__missing__"

NUMERIC_TYPES = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")


def feature_groups(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """Split columns into numeric / categorical by type (M7) – schema only."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        t = f.dataType.simpleString()
        (num if t.startswith(NUMERIC_TYPES) else cat).append(f.name)
    return num, cat


def level_counts(df: DataFrame, cols: list[str], min_frequency: float = 0.0, min_count: int = 0) -> DataFrame:
    """Rows per non-null level of each column and whether the level counts as
    infrequent (share < ``min_frequency`` or count < ``min_count``) (M5).

    The columns are stacked into ``(column_name, level)`` so one partial
    aggregate covers all of them. Each column's counts add up to the row count,
    so the total comes from that same table, not from a second pass.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("level")) for c in cols
    ])))
    g = long.groupBy("column_name", "level").agg(F.count(F.lit(1)).alias("n"))
    total = g.groupBy("column_name").agg(F.sum("n").alias("t")).agg(F.max("t")).scalar()
    small = F.lit(False)
    if min_frequency > 0:
        small = small | (F.col("n") < F.lit(min_frequency) * total)
    if min_count > 0:
        small = small | (F.col("n") < F.lit(min_count))
    # tied to the count, so that the filter stays above the aggregate both readers share
    there = F.when(F.col("level").isNotNull(), F.col("n")).otherwise(F.lit(0)) > 0
    return g.where(there).withColumn("is_infrequent", small)


class _LevelParams(HasInputCols, HasOutputCols):
    minFrequency = Param(Params._dummy(), "minFrequency",
                         "levels whose share of rows is below this are grouped (0 = off)",
                         typeConverter=TypeConverters.toFloat)
    minCount = Param(Params._dummy(), "minCount", "levels with fewer rows are grouped (0 = off)",
                     typeConverter=TypeConverters.toInt)
    imputeMode = Param(Params._dummy(), "imputeMode", "fill NULL with the most frequent level",
                       typeConverter=TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(minFrequency=0.0, minCount=0, imputeMode=False)


MAX_LEVELS = 100_000


class LevelGrouper(Estimator, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    """Group infrequent levels into ``__infrequent__`` (M5) and optionally impute the
    mode for NULLs (M6 for strings); a NULL that is not imputed is the level
    ``__missing__`` and counts like any other. A level that training never saw
    stays itself, so the encoder gives it the zero vector.

    Levels are counted in one aggregate over all input columns (stacked as
    ``(column, level)``); only the grouped levels and one mode per column come to
    the driver, and nothing is counted when neither is asked for. A column with
    more than ``MAX_LEVELS`` levels to group is no categorical column: fitting
    fails instead of collecting them."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, minFrequency=0.0, minCount=0, imputeMode=False):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LevelGrouperModel:
        cols, impute = self.getInputCols(), self.getOrDefault(self.imputeMode)
        min_f, min_c = self.getOrDefault(self.minFrequency), self.getOrDefault(self.minCount)
        grouped, mode = {c: [] for c in cols}, {}
        long = df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in cols
        ])))
        counts = long.groupBy("col", "level").agg(F.count(F.lit(1)).alias("n"))
        if impute:
            # most frequent first, smallest level on ties
            best = F.min_by("level", F.struct((-F.col("n")).alias("n"), "level"))
            for r in counts.where("level IS NOT NULL").groupBy("col").agg(best.alias("m")).collect():
                mode[r["col"]] = r["m"]
        if min_f > 0 or min_c > 0:
            total = df.count()
            filled = F.coalesce("level", *[F.when(F.col("col") == c, F.lit(m)) for c, m in mode.items()], F.lit(MISSING))
            whole = counts.groupBy("col", filled.alias("level")).agg(F.sum("n").alias("n"))
            small = whole.where((F.col("n") < F.lit(min_f * total)) | (F.col("n") < F.lit(min_c)))
            crowded = small.groupBy("col").count().where(F.col("count") > MAX_LEVELS).first()
            if crowded:
                raise ValueError(f"{crowded['col']}: {crowded['count']} infrequent levels, not a categorical column")
            for r in small.select("col", "level").collect():
                grouped[r["col"]].append(r["level"])
        m = LevelGrouperModel(inputCols=cols, outputCols=self.getOutputCols(),
                              grouped=json.dumps({c: sorted(v) for c, v in grouped.items()}),
                              modes=json.dumps(mode), imputeMode=impute)
        return self._copyValues(m)


class LevelGrouperModel(Model, _LevelParams, DefaultParamsReadable, DefaultParamsWritable):
    grouped = Param(Params._dummy(), "grouped", "JSON: column → infrequent levels",
                    typeConverter=TypeConverters.toString)
    modes = Param(Params._dummy(), "modes", "JSON: column → most frequent level",
                  typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, grouped="{}", modes="{}", minFrequency=0.0,
                 minCount=0, imputeMode=False):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        grouped = json.loads(self.getOrDefault(self.grouped))
        modes = json.loads(self.getOrDefault(self.modes))
        out = {}
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            # a missing value is its own level (as in the reference's encoder)
            x = F.coalesce(F.col(c).cast("string"), F.lit(modes.get(c, MISSING)))
            rare = grouped.get(c, [])
            out[o] = F.when(x.isin(*rare), F.lit(INFREQUENT)).otherwise(x) if rare else x
        return df.withColumns(out)


class _ExactParams(HasInputCols, HasOutputCols):
    """Input and output columns, and the fitted numbers as JSON."""

    fitted = Param(Params._dummy(), "fitted", "JSON: column → fitted numbers", typeConverter=TypeConverters.toString)

    def numbers(self) -> dict:
        return json.loads(self.getOrDefault(self.fitted))


def column_percentiles(df: DataFrame, cols: list[str], probs: dict[str, float]) -> dict[str, dict]:
    """Exact, linearly interpolated percentiles of several numeric columns in two passes over the rows; NULL and NaN
    are ignored. The columns are stacked as (column, value) and go through one bracket per column, so no task holds a
    whole column; only ``probs`` numbers per column come to the driver."""
    from ridelens.operators.common import exact_percentiles

    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("value")) for c in cols])))
    rows = exact_percentiles(long, "value", probs, by="col", bounded_groups=True, accuracy="auto").collect()
    got = {r["col"]: {n: r[n] for n in probs} for r in rows}
    return {c: got.get(c, dict.fromkeys(probs)) for c in cols}


class ExactRobustScaler(Estimator, _ExactParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x − median) / IQR with exact interpolated quartiles (M2).

    A column without spread is centred only; a column without any value stays as it is. NULL stays NULL.
    """

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactRobustScalerModel:
        q = column_percentiles(df, self.getInputCols(), {"q1": 0.25, "q2": 0.5, "q3": 0.75})
        fitted = {c: (v["q2"], (v["q3"] - v["q1"]) or 1.0) if v["q2"] is not None else (0.0, 1.0) for c, v in q.items()}
        return self._copyValues(ExactRobustScalerModel(
            inputCols=self.getInputCols(), outputCols=self.getOutputCols(), fitted=json.dumps(fitted)))


class ExactRobustScalerModel(Model, _ExactParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, fitted="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = self.numbers()
        return df.withColumns({o: (F.col(f"`{c}`").cast("double") - F.lit(fitted[c][0])) / F.lit(fitted[c][1])
                               for c, o in zip(self.getInputCols(), self.getOutputCols())})


class ExactMedianImputer(Estimator, _ExactParams, DefaultParamsReadable, DefaultParamsWritable):
    """NULL and NaN → the column's exact interpolated median (M6). A column without any value cannot be imputed: fitting fails."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ExactMedianImputerModel:
        fitted = {c: v["q2"] for c, v in column_percentiles(df, self.getInputCols(), {"q2": 0.5}).items()}
        empty = [c for c, m in fitted.items() if m is None]
        if empty:
            raise ValueError(f"no value to take a median of: {', '.join(empty)}")
        return self._copyValues(ExactMedianImputerModel(
            inputCols=self.getInputCols(), outputCols=self.getOutputCols(), fitted=json.dumps(fitted)))


class ExactMedianImputerModel(Model, _ExactParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, fitted="{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted, out = self.numbers(), {}
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            x = F.col(f"`{c}`").cast("double")
            out[o] = F.when(x.isNull() | F.isnan(x), F.lit(fitted[c])).otherwise(x)
        return df.withColumns(out)


def scaled_block(cols: list[str], kind: str, prefix: str, relative_error: float | None = None) -> tuple[list, str | None]:
    """Assemble ``cols`` and scale them: ``standard`` (mean 0, std 1), ``robust`` (median / IQR) or ``minmax`` (M1–M3).

    Quartiles are exact and interpolated (:class:`ExactRobustScaler`); with a ``relative_error`` they are values within
    that error of the rank (0: the value at the rank, for which Spark keeps every distinct value of a column in one task).
    """
    if not cols:
        return [], None
    raw, out = f"{prefix}_raw", f"{prefix}_vec"
    if kind == "robust" and relative_error is None:
        scaled = [f"{prefix}_{c}" for c in cols]
        return [ExactRobustScaler(inputCols=cols, outputCols=scaled),
                VectorAssembler(inputCols=scaled, outputCol=out, handleInvalid="keep")], out
    asm = VectorAssembler(inputCols=cols, outputCol=raw, handleInvalid="keep")
    if kind == "standard":
        sc = StandardScaler(inputCol=raw, outputCol=out, withMean=True, withStd=True)
    elif kind == "robust":
        sc = RobustScaler(inputCol=raw, outputCol=out, withCentering=True, withScaling=True,
                          relativeError=relative_error)
    elif kind == "minmax":
        sc = MinMaxScaler(inputCol=raw, outputCol=out)
    elif kind == "none":
        return [asm], raw
    else:
        raise ValueError(kind)
    return [asm, sc], out


def onehot_block(cols: list[str], prefix: str, unseen: str = "keep") -> tuple[list, list[str]]:
    """String-index then one-hot every column (M4).

    ``handleInvalid="keep"`` adds an extra "unseen" index which is exactly the
    one ``dropLast=True`` drops: every real level keeps its own slot and an
    unseen level becomes the all-zero vector. ``unseen="error"`` fails instead.
    """
    if not cols:
        return [], []
    idx = [f"{prefix}_{c}_idx" for c in cols]
    vec = [f"{prefix}_{c}_ohe" for c in cols]
    si = StringIndexer(inputCols=cols, outputCols=idx, handleInvalid=unseen, stringOrderType="alphabetAsc")
    # the encoder itself must keep its default "error": the indexer's extra slot
    # is then a regular last category, the one dropLast removes
    ohe = OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=unseen == "keep")
    return [si, ohe], vec


def preprocessor(standard=(), robust=(), minmax=(), onehot=(), min_frequency: float = 0.0,
                 min_count: int = 0, impute_numeric=(), impute_categorical: bool = False,
                 passthrough=(), output: str = "features", unseen: str = "keep",
                 relative_error: float | None = None) -> list:
    """Stages equivalent to the reference's column transformer (M1–M8).

    Numeric columns listed in ``impute_numeric`` get their median first (exact and interpolated, or within
    ``relative_error`` of the rank, see :func:`scaled_block`);
    categorical columns are cast to string, optionally mode-imputed and
    infrequent-grouped, then one-hot encoded; everything is assembled into
    ``output`` (other columns are ignored, i.e. ``remainder="drop"``).
    """
    stages, parts = [], []
    imp = list(impute_numeric)
    if imp and relative_error is None:
        stages.append(ExactMedianImputer(inputCols=imp, outputCols=imp))
    elif imp:
        stages.append(Imputer(inputCols=imp, outputCols=imp, strategy="median",
                              relativeError=relative_error))
    blocks = ((standard, "standard", "std"), (robust, "robust", "rob"), (minmax, "minmax", "mm"),
              (passthrough, "none", "num"))
    for cols, kind, pfx in blocks:
        st, out = scaled_block(list(cols), kind, pfx, relative_error)
        stages += st
        if out:
            parts.append(out)
    cat = list(onehot)
    if cat:
        grouped = [f"{c}__lvl" for c in cat]
        stages.append(LevelGrouper(inputCols=cat, outputCols=grouped, minFrequency=min_frequency,
                                   minCount=min_count, imputeMode=impute_categorical))
        st, vecs = onehot_block(grouped, "cat", unseen)
        stages += st
        parts += vecs
    stages.append(VectorAssembler(inputCols=parts, outputCol=output, handleInvalid="keep"))
    return stages
