"""Feature preparation: every step learns from one table and is applied to any other.

The classes are pyspark.ml Estimators, so a Pipeline of them fits on training rows
only. What a step learns is either a few numbers or a DataFrame that is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslab.functions import scalar, text
from corpuslab.operators.relational import apply_counts, distinct_counts, fill_from_map, mode_by_group
from corpuslab.plans.quantiles import exact_quantiles
from corpuslab.plans.ranking import group_places, mark_first
from corpuslab.plans.skew import join_small_or_salted
from corpuslab.plans.storage import written


class _Columns(Model):
    """A fitted step that replaces or adds columns."""

    def __init__(self, columns: dict[str, Column], learned=None):
        super().__init__()
        self.columns = columns
        self.learned = learned

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns)


class MedianImputer(Estimator):
    """Fill NULLs with the exact median of the training rows."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> Model:
        found = exact_quantiles(df, {c: [0.5] for c in self.columns})
        medians = {c: v[0] for c, v in found.items()}
        return _Columns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}, medians)


class ConstantFill(Transformer):
    """Fill NULLs with ``unknown_<column>``."""

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.fillna({c: f"unknown_{c}" for c in self.columns})


class SuffixInference(Estimator):
    """Fill NULLs of ``target`` from the last word of ``text_col``.

    A last word counts when its most frequent target value occurs more than
    ``min_support`` times in the training rows.
    """

    def __init__(self, text_col: str, target: str, salt_by: list[str], min_support: int = 50):
        super().__init__()
        self.text_col, self.target, self.salt_by, self.min_support = text_col, target, salt_by, min_support

    def _fit(self, df: DataFrame) -> Model:
        known = df.select(text.last_token(F.col(self.text_col)).alias("__suffix"), self.target).filter("__suffix <> ''")
        return _SuffixModel(self, written(mode_by_group(known, "__suffix", self.target, self.min_support), "suffixes"))


class _SuffixModel(Model):
    def __init__(self, spec: SuffixInference, learned: DataFrame):
        super().__init__()
        self.spec, self.learned = spec, learned

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.spec
        rows = df.withColumn("__suffix", text.last_token(F.col(s.text_col)))
        filled = fill_from_map(rows, self.learned, "__suffix", s.target, s.salt_by, f"unknown_{s.target}")
        return filled.drop("__suffix")


class LowTailFlag(Estimator):
    """1 when a value is at or below the low quantile of the training rows, else 0."""

    def __init__(self, column: str, out: str, q: float = 0.02):
        super().__init__()
        self.column, self.out, self.q = column, out, q

    def _fit(self, df: DataFrame) -> Model:
        threshold = exact_quantiles(df, {self.column: [self.q]})[self.column][0]
        flag = F.coalesce((F.col(self.column) <= F.lit(threshold)).cast("int"), F.lit(0))
        return _Columns({self.out: flag}, threshold)


class CyclicTime(Transformer):
    """hour_sin, hour_cos, day_sin, day_cos of a timestamp; 0 when it is NULL."""

    def __init__(self, column: str):
        super().__init__()
        self.column = column

    def _transform(self, df: DataFrame) -> DataFrame:
        ts = F.col(self.column)
        hour_sin, hour_cos = scalar.cyclic(F.hour(ts), 24)
        day_sin, day_cos = scalar.cyclic(scalar.day_of_week(ts), 7)
        parts = {"hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos}
        return df.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in parts.items()})


class ActivityCount(Estimator):
    """How many training rows the key of a row has; ``default`` for a new key."""

    def __init__(self, key: str, out: str, salt_by: list[str], default: int = 1):
        super().__init__()
        self.key, self.out, self.salt_by, self.default = key, out, salt_by, default

    def _fit(self, df: DataFrame) -> Model:
        counts = df.groupBy(self.key).agg(F.count(F.lit(1)).alias(self.out))
        return _ActivityModel(self, written(counts, "activity"))


class _ActivityModel(Model):
    def __init__(self, spec: ActivityCount, learned: DataFrame):
        super().__init__()
        self.spec, self.learned = spec, learned

    def _transform(self, df: DataFrame) -> DataFrame:
        s = self.spec
        return apply_counts(df, self.learned, s.key, s.out, s.salt_by, s.default)


class OneHot(Estimator):
    """One-hot vectors per column, categories in alphabetical order; an unseen one or NULL is all zeros.

    Categories are numbered where they are: the dictionary of a column is a table (value, id) with ids
    from 0 without gaps, joined onto rows. Only the number of categories comes to the driver.
    """

    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _fit(self, df: DataFrame) -> Model:
        tables = {}
        for c in self.columns:
            values = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("value")).distinct()
            placed = group_places(values.withColumn("one", F.lit(1)), ["one"], [F.asc("value")])
            tables[c] = written(placed.select("value", (F.col("place") - 1).alias("id")), "dictionary")
        return _OneHotModel(tables, {c: t.count() for c, t in tables.items()})


class _OneHotModel(Model):
    """``tables``: (value, id) per column; ``sizes``: the number of categories."""

    def __init__(self, tables: dict[str, DataFrame], sizes: dict[str, int]):
        super().__init__()
        self.tables, self.sizes = tables, sizes

    def numbered(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_id``, NULL where the category was not seen."""
        for c, table in self.tables.items():
            known = table.select(F.col("value").alias("__value"), F.col("id").alias(f"{c}_id"))
            rows = df.withColumn("__value", F.col(c).cast("string"))
            df = join_small_or_salted(rows, known, ["__value"], [x for x in df.columns if x != c] or [c], "left").drop("__value")
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self.numbered(df)
        for c, size in self.sizes.items():
            if not size:
                raise ValueError(f"{c} had no category to learn")
            # unseen ones get the number after the last, which the encoder leaves out
            rows = rows.withColumn("__ix", F.coalesce(F.col(f"{c}_id"), F.lit(size)).cast("double"))
            encoder = OneHotEncoder(inputCol="__ix", outputCol=f"{c}_onehot", dropLast=True, handleInvalid="keep")
            ids = df.sparkSession.range(size).select(F.col("id").cast("double").alias("__ix"))
            rows = encoder.fit(ids).transform(rows).drop("__ix", f"{c}_id")
        return rows

    def names(self) -> DataFrame:
        """(column, id, name) of all vector entries."""
        parts = [t.select(F.lit(c).alias("column"), "id", F.concat(F.lit(f"{c}_"), "value").alias("name")) for c, t in self.tables.items()]
        return reduce(DataFrame.unionByName, parts)


class PopStandardScaler(Estimator):
    """(x - mean) / population deviation of the training rows; a constant column is only centred."""

    def __init__(self, columns: list[str], suffix: str = "_scaled"):
        super().__init__()
        self.columns, self.suffix = columns, suffix

    def _fit(self, df: DataFrame) -> Model:
        row = df.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.columns)],
        ).first()
        learned = {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(self.columns)}
        return _Columns({c + self.suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in learned.items()}, learned)


class MinMax(Estimator):
    """(x - min) / (max - min) of the training rows; a constant column gives 0."""

    def __init__(self, columns: list[str], suffix: str = "_scaled"):
        super().__init__()
        self.columns, self.suffix = columns, suffix

    def _fit(self, df: DataFrame) -> Model:
        row = df.agg(
            *[F.min(c).cast("double").alias(f"a{i}") for i, c in enumerate(self.columns)],
            *[F.max(c).cast("double").alias(f"z{i}") for i, c in enumerate(self.columns)],
        ).first()
        learned = {c: (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(self.columns)}
        return _Columns(
            {c + self.suffix: (F.col(c) - F.lit(a)) / F.lit((z - a) or 1.0) for c, (a, z) in learned.items()}, learned)


class TfIdf(Estimator):
    """L2-normalised tf-idf over the most frequent words, in long form (id, term, weight).

    Words have at least two characters and are not stop words; a word must occur
    in ``min_df`` rows; the ``max_features`` most frequent ones are kept (ties in
    alphabetical order); idf = ln((1 + n) / (1 + df)) + 1.
    """

    def __init__(self, id_col: str, text_col: str, max_features: int = 3000, min_df: int = 2):
        super().__init__()
        self.id_col, self.text_col, self.max_features, self.min_df = id_col, text_col, max_features, min_df

    def counted(self, df: DataFrame) -> DataFrame:
        stop = text.english_stop_words()
        found = F.filter(text.words(F.col(self.text_col)), lambda t: ~t.isin(*stop))
        return text.count_in_row(df.select(F.col(self.id_col).alias("id"), found.alias("t")), "t").select("id", "counts")

    def _fit(self, df: DataFrame) -> Model:
        return self._learn(written(self.counted(df), "word-counts"))

    def fit_transform(self, df: DataFrame) -> tuple[Model, DataFrame]:
        """The fitted step and its result on the same rows, which are tokenised once."""
        counted = written(self.counted(df), "word-counts")
        model = self._learn(counted)
        return model, model.weights(counted)

    def _learn(self, counted: DataFrame) -> Model:
        n = counted.count()
        terms = (
            counted.select(F.explode("counts").alias("c"))
            .groupBy("c.term").agg(F.count(F.lit(1)).alias("df"), F.sum("c.tf").alias("total"))
            .filter(F.col("df") >= self.min_df)
            .orderBy(F.desc("total"), "term").limit(self.max_features)
        )
        idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
        return _TfIdfModel(self, written(terms.select("term", "df", idf.alias("idf")), "vocabulary"))


class _TfIdfModel(Model):
    """``vocabulary``: (term, df, idf), at most ``max_features`` rows."""

    def __init__(self, spec: TfIdf, vocabulary: DataFrame):
        super().__init__()
        self.spec, self.vocabulary = spec, vocabulary

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.weights(self.spec.counted(df))

    def weights(self, counted: DataFrame) -> DataFrame:
        """(id, term, weight) from counts (id, counts) of the rows."""
        rows = counted.select("id", F.explode_outer("counts").alias("c")).filter("c IS NOT NULL")
        # the vocabulary has a fixed size limit, so it is always small
        raw = rows.select("id", "c.term", "c.tf").join(F.broadcast(self.vocabulary), "term").select(
            "id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
        # a row has at most max_features terms
        norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
        return raw.select("id", "term", (F.col("raw") / norm).alias("weight"))


class CountBinarizer(Transformer):
    """1.0 for array elements above 0, else 0.0."""

    def __init__(self, column: str, out: str):
        super().__init__()
        self.column, self.out = column, out

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.out, F.transform(self.column, lambda x: (x > 0).cast("double")))


def flatten(values: Column) -> Column:
    """Nested image rows to one flat array."""
    return F.flatten(values)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """One vector column, inputs in the given order."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def drop_uninformative(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns that have one value only, or a different one in every row."""
    n = df.count()
    found = {r["column"]: r["n_unique"] for r in distinct_counts(df, columns).collect()}  # one row per column
    return df.drop(*[c for c in columns if found.get(c, 0) <= 1 or found[c] == n])


def exact_split(df: DataFrame, key: str, ratio: float = 0.8, seed: int = 42, flag: str = "is_train") -> DataFrame:
    """Add ``flag``: true for exactly int(ratio * rows) random rows."""
    n = F.floor(F.col("__total") * F.lit(ratio))
    return mark_first(df, n, scalar.draw_order(key, seed), [key], flag)


# More distinct labels than this are an error, found before they are listed.
MAX_CLASSES = 1000


def class_labels(df: DataFrame, label: str) -> list:
    """The distinct labels in order, NULL left out."""
    n = df.agg(F.approx_count_distinct(label, 0.02)).first()[0]
    if n > MAX_CLASSES:
        raise ValueError(f"{label} has about {n} values; a label may have {MAX_CLASSES}")
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def stratified_sample(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` random rows, as even over the classes as the division allows.

    The first ``n % classes`` labels in order give one row more.
    """
    labels = class_labels(df, label)
    each, rest = divmod(n, len(labels))
    # quota of the label, as literals: one entry per class
    quota = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(each + (i < rest)))])
    order = Window.partitionBy(label).orderBy(scalar.draw_order(key, seed), key)
    ranked = df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= each + 1)
    return ranked.filter(F.col("__rn") <= F.element_at(quota, F.col(label))).drop("__rn")


def ratio_features(a: Column, b: Column, prefix: str) -> dict[str, Column]:
    """Generated columns of two numeric columns."""
    return {
        f"{prefix}_ratio": scalar.safe_ratio(a, b),
        f"{prefix}_sum": a + b,
        f"{prefix}_product": a * b,
        f"{prefix}_square": a * a,
        f"{prefix}_log1p": F.log1p(a),
    }
