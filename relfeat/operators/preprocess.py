"""Feature-frame preprocessing.

Each stage is fitted once on the (bounded) training feature frame and then applied as a
plain ``select`` -- or, for label codes, a join with a small code table -- so scoring a
large frame never leaves the JVM.  Stages follow the ``fit(df) -> fitted; transform(df)``
shape of ``pyspark.ml``; using a stage before ``fit`` raises.
"""
from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import (EPOCH_SUFFIX, epoch_ns, is_datetime_type, is_integral_type, sanitize_name)
from ..sources.rdb import _join, read_pointer, snapshot_name, write_pointer
from .ranking import dense_codes, planned_codes
from .textfeatures import TextFeatureGenerator


class NotFittedError(RuntimeError):
    pass


def _c(name: str):
    """Column by its literal name (names may contain dots or parentheses)."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---- T1 -------------------------------------------------------------------------------------------
class TypeCastTransformer:
    """Booleans -> float32 (null stays null); integral columns in which nulls were seen at
    fit -> float32 (the nullable-integer case).  Epoch-time columns are never narrowed to
    float32 (24-bit mantissa: nanosecond epochs would be off by minutes)."""

    def __init__(self):
        self.cast_columns_: list[str] | None = None

    def fit(self, df: DataFrame) -> "TypeCastTransformer":
        bools = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
        ints = [f.name for f in df.schema.fields if is_integral_type(f.dataType)
                and not isinstance(f.dataType, T.BooleanType) and EPOCH_SUFFIX not in f.name]
        nulls = set()
        if ints:
            row = df.agg(*[F.count(F.when(_c(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(ints)]).first()
            nulls = {c for i, c in enumerate(ints) if row[f"n{i}"] > 0}
        self.cast_columns_ = bools + [c for c in ints if c in nulls]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.cast_columns_ is None:
            raise NotFittedError("TypeCastTransformer is not fitted")
        cols = set(self.cast_columns_) & set(df.columns)  # P9
        return df.select(*[_c(c).cast("float").alias(c) if c in cols else _c(c) for c in df.columns])


# ---- T2 -------------------------------------------------------------------------------------------
@dataclass
class TemporalDiffConfig:
    enabled: bool = True
    exclude_columns: list = field(default_factory=list)


def _is_std_name(name: str) -> bool:
    """Q4 [DIV]: a ``std`` token, not any substring (``lastdate`` is not a deviation)."""
    return any(tok.lower() == "std" for tok in name.replace(".", "_").replace("(", "_").replace(")", "_").split("_"))


class TemporalDiffTransformer:
    """Epoch-time columns (name contains ``_epochtime``, not excluded) become
    ``<sanitised name>_diff`` = cutoff_ns - value as double, source dropped; standard
    deviations of epoch times are dropped (P3) -- also when there is no cutoff column."""

    def __init__(self, config: TemporalDiffConfig | None = None, cutoff_time_col: str | None = None,
                 std_columns: Sequence[str] | None = None):
        self.config = config or TemporalDiffConfig()
        self.cutoff_time_col = cutoff_time_col
        self.std_columns = None if std_columns is None else list(std_columns)
        self.timestamp_columns_: list[str] | None = None
        self.columns_to_drop_: list[str] | None = None

    def fit(self, df: DataFrame) -> "TemporalDiffTransformer":
        epoch = [c for c in df.columns if EPOCH_SUFFIX in c and c not in self.config.exclude_columns]
        if self.std_columns is not None:
            drop = [c for c in epoch if c in self.std_columns]
        else:
            drop = [c for c in epoch if _is_std_name(c)]
        self.columns_to_drop_ = drop
        self.timestamp_columns_ = [c for c in epoch if c not in drop]
        return self

    @property
    def is_fitted_(self) -> bool:
        return self.timestamp_columns_ is not None

    def transform(self, df: DataFrame) -> DataFrame:
        if self.timestamp_columns_ is None:
            raise NotFittedError("TemporalDiffTransformer is not fitted")
        df = df.drop(*[c for c in self.columns_to_drop_ if c in df.columns])
        if not self.timestamp_columns_ or self.cutoff_time_col is None or self.cutoff_time_col not in df.columns:
            return df
        cdt = df.schema[self.cutoff_time_col].dataType
        cut = epoch_ns(_c(self.cutoff_time_col), cdt) if is_datetime_type(cdt) else _c(self.cutoff_time_col).cast("long")
        todo = [c for c in self.timestamp_columns_ if c in df.columns]
        out = []
        for c in df.columns:
            if c in todo:
                out.append((cut - _c(c)).cast("double").alias(f"{sanitize_name(c)}_diff"))
            else:
                out.append(_c(c))
        return df.select(*out)


# ---- T3 -------------------------------------------------------------------------------------------
NULL_CLASS = "nan"  # a missing value is one ordinary class


def _as_class(c) -> "F.Column":
    return F.coalesce(_c(c).cast("string"), F.lit(NULL_CLASS))


class SafeLabelEncoderTransformer:
    """Each string column is replaced by the 0-based rank of its value among the sorted
    distinct values seen at fit.  Unseen values [DIV Q5]: seen codes never move; unseen
    values of one ``transform`` call get codes after them, in sorted order.  ``transform`` only
    plans: it runs no job, whether or not values are unseen.  Codes are joined to the distinct
    combinations of the string columns, and those to the rows: whole rows are shuffled once, however many
    string columns there are."""

    def __init__(self, exclude: Sequence[str] = ()):
        self.exclude = list(exclude)
        self.cat_columns_: list[str] | None = None
        self.codes_: DataFrame | None = None

    def fit(self, df: DataFrame, rows: int | None = None) -> "SafeLabelEncoderTransformer":
        """``rows``: a known bound on ``df``'s rows (e.g. the training sample size)."""
        self.cat_columns_ = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in self.exclude]
        if not self.cat_columns_:
            return self
        vals = self._unpivot(df, self.cat_columns_)
        bound = None if rows is None else rows * len(self.cat_columns_)
        self.codes_ = dense_codes(vals, "__col", "__val", bounded_rows=bound).checkpoint(eager=True)
        return self

    @staticmethod
    def _unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("__col"), _as_class(c).alias("__val"))
                                              for c in cols])).alias("__s")).select("__s.*")

    def transform(self, df: DataFrame) -> DataFrame:
        if self.cat_columns_ is None:
            raise NotFittedError("SafeLabelEncoderTransformer is not fitted")
        cols = [c for c in self.cat_columns_ if c in df.columns]  # P9
        if not cols:
            return df
        seen = self.codes_
        # values and codes meet in one aggregate: in a join Spark would judge the codes by the bytes of
        # their compressed files and hash them all in the driver
        keys = [f"__v{i}" for i in range(len(cols))]
        rows = df.select(*[_as_class(c).alias(k) for c, k in zip(cols, keys)]).distinct()
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(k).alias("__val")) for c, k in zip(cols, keys)])).alias("__s")
        vals = rows.select(each).select("__s.*").withColumn("__seen", F.lit(0)).unionByName(seen.select("__col", "__val", F.lit(1).alias("__seen")))
        unseen = vals.groupBy("__col", "__val").agg(F.max("__seen").alias("__seen")).where("__seen = 0").drop("__seen")  # P7
        base = seen.groupBy("__col").agg(F.count(F.lit(1)).alias("offset"))                   # a row a column
        table = seen.unionByName(planned_codes(unseen, "__col", "__val", base))               # U3
        # one row a value, with its code in each column: every column's join reads the same plan,
        # so the codes are made and shuffled, or broadcast, once for all columns
        codes = table.groupBy("__val").agg(F.map_from_entries(F.collect_list(F.struct("__col", "code"))).alias("__codes"))
        for i, c in enumerate(cols):                                                          # J8
            m = codes.select(F.col("__val").alias("__of"), F.col("__codes")[c].alias(f"__m{i}"))
            rows = rows.join(m, F.col(keys[i]) == F.col("__of"), "left").drop("__of")
        rows = rows.repartition(*keys)  # not by the last column alone, which may have few values
        same = [_as_class(c) == F.col(k) for c, k in zip(cols, keys)]
        out = df.join(rows, functools.reduce(lambda a, b: a & b, same), "left")
        idx = {c: i for i, c in enumerate(cols)}
        return out.select(*[F.col(f"__m{idx[c]}").alias(c) if c in idx else _c(c) for c in df.columns])

    def classes(self, df: DataFrame) -> DataFrame:
        """The frame this was fitted on with classes instead of their codes.  Each class has its own code,
        so a column has as many values as ``transform``'s, and finding them takes no join."""
        return df.select(*[_as_class(c).alias(c) if c in self.cat_columns_ else _c(c) for c in df.columns])


# ---- T4 -------------------------------------------------------------------------------------------
class DatetimeFeatureGenerator:
    """T4 (datetime part, F6) and constant-column drop.  Every remaining datetime column ``d``
    becomes ``d`` as int64 ns plus ``d_year``, ``d_month``, ``d_day``, ``d_dayofweek``
    (Monday = 0).  Columns constant on the fitted frame (one value, or all null) are dropped."""

    def __init__(self, enable_datetime_features: bool = True, drop_constant: bool = True):
        self.enable_datetime_features = enable_datetime_features
        self.drop_constant = drop_constant
        self.datetime_columns_: list[str] | None = None
        self.constant_columns_: list[str] | None = None

    def _expand(self, df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            if f.name in self.datetime_columns_:
                c = _c(f.name)
                cols += [epoch_ns(c, f.dataType).alias(f.name), F.year(c).cast("long").alias(f"{f.name}_year"),
                         F.month(c).cast("long").alias(f"{f.name}_month"), F.dayofmonth(c).cast("long").alias(f"{f.name}_day"),
                         F.weekday(c).cast("long").alias(f"{f.name}_dayofweek")]
            else:
                cols.append(_c(f.name))
        return df.select(*cols)

    def fit(self, df: DataFrame) -> "DatetimeFeatureGenerator":
        self.datetime_columns_ = [f.name for f in df.schema.fields if is_datetime_type(f.dataType)] \
            if self.enable_datetime_features else []
        self.constant_columns_ = []
        if self.drop_constant:
            x = self._expand(df)
            simple = [f.name for f in x.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.UserDefinedType))]
            aggs = []
            for i, c in enumerate(simple):
                aggs += [F.min(_c(c)).alias(f"a{i}"), F.max(_c(c)).alias(f"b{i}"), F.count(_c(c)).alias(f"n{i}")]
            aggs.append(F.count(F.lit(1)).alias("rows"))
            row = x.agg(*aggs).first()
            if row["rows"] > 0:
                for i, c in enumerate(simple):
                    all_null = row[f"n{i}"] == 0
                    one_val = row[f"n{i}"] == row["rows"] and row[f"a{i}"] == row[f"b{i}"]
                    if all_null or one_val:
                        self.constant_columns_.append(c)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.datetime_columns_ is None:
            raise NotFittedError("DatetimeFeatureGenerator is not fitted")
        x = self._expand(df)
        return x.drop(*[c for c in self.constant_columns_ if c in x.columns])


# fixed values: the reference's defaults of its generator's flags
GENERATOR_DEFAULTS = {"enable_datetime_features": True, "enable_raw_text_features": False, "enable_text_special_features": False,
                      "enable_text_ngram_features": False}
_TEXT_FLAGS = {"enable_text_ngram_features": "ngrams", "enable_text_special_features": "special", "enable_raw_text_features": "raw"}


# ---- T5 -------------------------------------------------------------------------------------------
class TabularPreprocessor:
    """T5: T1 -> T2 (if enabled) -> T3 -> T4, each fitted on the previous stage's output.

    ``ag_config`` is merged over ``GENERATOR_DEFAULTS``; it may also hold ``drop_constant`` and
    ``text_ngram_params`` (a dict of ``TextFeatureGenerator``'s options).  With a text flag on, T4's
    text part runs before T3, so that texts are not encoded as categories; else string columns are
    categories all."""

    def __init__(self, ag_config: dict | None = None, temporal_diff_config: TemporalDiffConfig | None = None,
                 cutoff_time: str | None = None, std_epoch_columns: Sequence[str] | None = None,
                 keep_columns: Sequence[str] = ()):
        self.ag_config = dict(ag_config or {})
        self.temporal_diff_config = temporal_diff_config
        self.cutoff_time = cutoff_time
        self.std_epoch_columns = std_epoch_columns
        self.keep_columns = list(keep_columns)
        self.steps: list[tuple[str, object]] | None = None
        self.is_fitted_ = False

    @property
    def temporal_transformer(self):
        return dict(self.steps or []).get("temporal")

    def fit(self, df: DataFrame, rows: int | None = None) -> "TabularPreprocessor":
        """``rows``: a known bound on ``df``'s rows, passed to the label encoder."""
        options = {**GENERATOR_DEFAULTS, **self.ag_config}
        flags = {name: bool(options.pop(flag)) for flag, name in _TEXT_FLAGS.items()}
        text_params = options.pop("text_ngram_params", None) or {}
        text = TextFeatureGenerator(**flags, **text_params)  # unknown options raise
        generator = DatetimeFeatureGenerator(**options)
        steps = [("type_cast", TypeCastTransformer())]
        if self.temporal_diff_config is not None and self.temporal_diff_config.enabled:
            steps.append(("temporal", TemporalDiffTransformer(self.temporal_diff_config, self.cutoff_time,
                                                              self.std_epoch_columns)))
        if any(flags.values()):
            steps.append(("text", text))
        steps.append(("label_encoder", SafeLabelEncoderTransformer()))
        steps.append(("datetime", generator))
        x = df.drop(*self.keep_columns)  # keep columns (ids) bypass the stages
        for _, st in steps:
            if isinstance(st, SafeLabelEncoderTransformer):
                st.exclude = text.raw_columns if any(flags.values()) else []
                st.fit(x, rows)
                x = st.classes(x)  # the last stage asks which columns are constant
            else:
                st.fit(x)
                x = st.transform(x)
        self.steps = steps
        self.is_fitted_ = True
        return self

    def transform(self, df: DataFrame, passthrough: Sequence[str] = ()) -> DataFrame:
        """Apply the fitted stages; ``keep_columns`` and ``passthrough`` columns bypass them."""
        if not self.is_fitted_:
            raise NotFittedError("TabularPreprocessor is not fitted")
        keep = [c for c in list(self.keep_columns) + list(passthrough) if c in df.columns]
        if keep:
            df = df.withColumn("__keep", F.struct(*[_c(k).alias(f"k{i}") for i, k in enumerate(keep)])).drop(*keep)
        for _, st in self.steps:
            df = st.transform(df)
        if keep:
            df = df.select(*[F.col(f"__keep.k{i}").alias(c) for i, c in enumerate(keep)],
                           *[_c(c) for c in df.columns if c != "__keep"])
        return df

    # ---- persistence ------------------------------------------------------------------------------
    #: What each fitted stage consists of, but for the label codes, which are a table.
    _STATE = {"type_cast": (TypeCastTransformer, ["cast_columns_"]),
              "temporal": (TemporalDiffTransformer, ["cutoff_time_col", "std_columns", "timestamp_columns_", "columns_to_drop_"]),
              "text": (TextFeatureGenerator, ["ngrams", "special", "raw", "min_words", "ngram_range", "min_df", "max_features", "text_columns_", "vocabulary_"]),
              "label_encoder": (SafeLabelEncoderTransformer, ["exclude", "cat_columns_"]),
              "datetime": (DatetimeFeatureGenerator, ["enable_datetime_features", "drop_constant", "datetime_columns_", "constant_columns_"])}

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted stages under ``path``: the label codes as Parquet in a new snapshot folder, all
        else in a manifest that is written last (see ``sources.rdb.write_pointer``)."""
        if not self.is_fitted_:
            raise NotFittedError("TabularPreprocessor is not fitted")
        folder, codes = snapshot_name(), dict(self.steps)["label_encoder"].codes_
        if codes is not None:
            codes.write.parquet(_join(path, folder, "codes"))
        temporal = self.temporal_diff_config
        write_pointer(spark, path, {
            "version": 1, "folder": folder, "has_codes": codes is not None, "ag_config": self.ag_config, "temporal_diff": None if temporal is None else vars(temporal),
            "cutoff_time": self.cutoff_time, "std_epoch_columns": None if self.std_epoch_columns is None else list(self.std_epoch_columns), "keep_columns": self.keep_columns,
            "steps": [[name, {a: getattr(step, a) for a in self._STATE[name][1]}] for name, step in self.steps]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TabularPreprocessor":
        """The stages that ``save`` wrote, in any application."""
        man = read_pointer(spark, path)
        if man.get("version") != 1:
            raise ValueError(f"{path}: unknown version {man.get('version')!r} of a saved preprocessor")
        temporal = None if man["temporal_diff"] is None else TemporalDiffConfig(**man["temporal_diff"])
        out = cls(man["ag_config"], temporal, man["cutoff_time"], man["std_epoch_columns"], man["keep_columns"])
        out.steps = []
        for name, state in man["steps"]:
            step = cls._STATE[name][0]()
            for attribute, value in state.items():
                setattr(step, attribute, value)
            if name == "temporal":
                step.config = temporal or TemporalDiffConfig()
            if name == "label_encoder" and man["has_codes"]:
                step.codes_ = spark.read.parquet(_join(path, man["folder"], "codes"))
            out.steps.append((name, step))
        out.is_fitted_ = True
        return out
