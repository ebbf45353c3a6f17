"""Quality of predictions against true labels, one pass per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _scores(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
                  .withColumn("f1", _ratio(2 * p * r, p + r)))


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Matched and unmatched rows and their shares in percent; rows with a null count as neither."""
    t, p = F.col(truth), F.col(predicted)
    m, u = F.col("matched"), F.col("unmatched")
    return (df.agg(F.count_if(t == p).alias("matched"), F.count_if(t != p).alias("unmatched"))
              .withColumn("pct_matched", _ratio(m, m + u) * 100)
              .withColumn("pct_unmatched", _ratio(u, m + u) * 100))


def binary_metrics(df: DataFrame, positive, negative=None, truth: str = "label",
                   predicted: str = "predicted") -> DataFrame:
    """tp, fp, tn, fn, precision, recall and F1; without ``negative`` every other label is it."""
    t, p = F.col(truth), F.col(predicted)

    def no(c: Column) -> Column:
        return c != F.lit(positive) if negative is None else c == F.lit(negative)

    yes = F.lit(positive)
    return _scores(df.agg(
        F.count_if((t == yes) & (p == yes)).alias("tp"), F.count_if(no(t) & (p == yes)).alias("fp"),
        F.count_if(no(t) & no(p)).alias("tn"), F.count_if((t == yes) & no(p)).alias("fn")))


def _cells(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def _classes(df: DataFrame, column: str, classes: Sequence) -> DataFrame:
    """One row per class, typed as the column."""
    kind = df.schema[column].dataType
    values = F.array(*[F.lit(c).cast(kind) for c in classes])
    return df.sparkSession.range(1).select(F.explode(values).alias("class"))


def multiclass_metrics(df: DataFrame, classes: Sequence | None = None, truth: str = "label",
                       predicted: str = "predicted") -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each class from one count per (truth, predicted)."""
    cells = _cells(df, truth, predicted).filter("truth IS NOT NULL AND predicted IS NOT NULL")
    hit = F.col("truth") == F.col("predicted")
    zero, n = F.lit(0).cast("long"), F.col("n")
    part = cells.select(F.inline(F.array(
        F.struct(F.col("truth").alias("class"), F.when(hit, n).otherwise(zero).alias("tp"),
                 zero.alias("fp"), F.when(hit, zero).otherwise(n).alias("fn")),
        F.struct(F.col("predicted").alias("class"), zero.alias("tp"),
                 F.when(hit, zero).otherwise(n).alias("fp"), zero.alias("fn")))))
    counts = part.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if classes is not None:
        counts = _classes(df, truth, classes).join(counts, "class", "left").na.fill(0, ["tp", "fp", "fn"])
    return _scores(counts)


def confusion(df: DataFrame, classes: Sequence, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows per (true, predicted) class, with zero cells, in long form."""
    one = _classes(df, truth, classes).withColumnRenamed("class", "truth")
    kind = df.schema[predicted].dataType
    grid = one.select("truth", F.explode(F.array(*[F.lit(c).cast(kind) for c in classes])).alias("predicted"))
    return grid.join(_cells(df, truth, predicted), ["truth", "predicted"], "left").na.fill(0, ["n"])


def confusion_wide(df: DataFrame, classes: Sequence, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """The confusion matrix with one column per predicted class."""
    table = df.groupBy(F.col(truth).alias("class")).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return (_classes(df, truth, classes).join(table, "class", "left").na.fill(0)
            .withColumnRenamed("class", "truth").orderBy("truth"))


def class_counts(df: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows per class among the predictions and among the truth, ordered by class."""
    side = df.select(F.inline(F.array(
        F.struct(F.lit("predicted").alias("side"), F.col(predicted).alias("class")),
        F.struct(F.lit("truth").alias("side"), F.col(truth).alias("class")))))
    return side.groupBy("side", "class").agg(F.count(F.lit(1)).alias("n")).orderBy("side", "class")
