"""Counts and quality measures of classes and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def samples_per_class(rows: DataFrame, label: str = "route_type", by: str | None = None) -> DataFrame:
    """Classes in order with their index and counts, optionally by source too."""
    keys = [label, *([by] if by else [])]
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    classes = rows.select(label).distinct().withColumn("class_index", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint"))  # a row for each class
    return n.join(classes, label)


def confusion_matrix(predictions: DataFrame, by: tuple[str, ...] = (), label: str = "label", pred: str = "pred", normalize: bool = True) -> DataFrame:
    """(true, predicted) cells as counts and as shares of the true class."""
    cells = predictions.groupBy(*by, label, pred).agg(F.count("*").alias("n"))
    if not normalize:
        return cells
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, label)))


def classification_report(predictions: DataFrame, by: tuple[str, ...] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class seen as truth or prediction; 0 where undefined."""
    ends = predictions.select(*by, F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.lit(0).alias("b")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), (F.col(label) == F.col(pred)).cast("int").alias("b")))).alias("e"))
    sums = ends.groupBy(*by, F.col("e.class").alias("class")).agg(F.sum("e.t").alias("support"), F.sum("e.p").alias("predicted"), F.sum("e.b").alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = sums.withColumns({"precision": ratio(F.col("hits"), F.col("predicted")), "recall": ratio(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("predicted", "hits")


def overall_scores(predictions: DataFrame, by: tuple[str, ...] = (), label: str = "label", pred: str = "pred") -> DataFrame:
    """Accuracy (equal to micro F1), macro F1 and support-weighted F1."""
    per = classification_report(predictions, by, label, pred)
    f1 = per.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), F.lit(0.0)).alias("weighted_f1"))
    acc = predictions.groupBy(*by).agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"), F.count("*").alias("n"))
    return acc.join(f1, list(by)) if by else acc.crossJoin(F.broadcast(f1))  # one row each


def scorecard(report: DataFrame, row: str, column: str, values: list, metric: str = "f1") -> DataFrame:
    """One metric with classes down and models across."""
    return report.groupBy(row).pivot(column, values).agg(F.max(metric))


def route_distribution(ranked: DataFrame, by: tuple[str, ...] = ("video",)) -> DataFrame:
    """Weight of each class (a count of 1 for top-1 rows, else the confidence) and its share, by file and over all.

    ``ranked`` has a row for each candidate class: ``by``, class, weight.
    """
    per = ranked.groupBy(*by, "class").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight")
    return per.withColumns({"share": F.coalesce(F.try_divide(F.col("weight"), total.over(Window.partitionBy(*by))), F.lit(0.0))})


def mean_file_fraction(distribution: DataFrame, by: str = "video") -> DataFrame:
    """Mean over files of a class's share; a file without the class counts as 0.

    The sum over files is divided by their number, so no (file, class) grid is built.
    """
    files = distribution.select(by).distinct().agg(F.count("*").alias("files"))
    return distribution.groupBy("class").agg(F.sum("share").alias("s")).crossJoin(F.broadcast(files)).select("class", (F.col("s") / F.col("files")).alias("mean_share"))  # one row of files


def best_epoch(history: DataFrame, by: str = "model", metric: str = "accuracy") -> DataFrame:
    """Best value of each model and the first epoch that reached it."""
    return history.groupBy(by).agg(F.max(metric).alias("best"), F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("epoch"))


def batch_report(status: DataFrame) -> DataFrame:
    """Processed and failed items and the names of those that failed."""
    failed = F.col("error").isNotNull()
    return status.agg(F.count("*").alias("total"), F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"), F.sort_array(F.collect_list(F.when(failed, F.col("name")))).alias("failed_names"))
