"""Merging, comparing and describing rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_metrics(rules: DataFrame) -> DataFrame:
    """One rule for each (head, body): sums of counts, mean Jaccard, confidence of the sums, number merged."""
    rows = rules.groupBy("head", "body").agg(
        F.sum("support").alias("support"), F.sum("head_size").alias("head_size"), F.sum("body_size").alias("body_size"), F.avg("jaccard").alias("jaccard"), F.count("*").alias("size")
    )
    return rows.withColumn("confidence", F.col("support") / F.col("body_size"))


def merge_distinct(rules: DataFrame) -> DataFrame:
    """Merging for replicated parts: the instance with the largest support stands for all."""
    best = rules.groupBy("head", "body").agg(F.max_by(F.struct("support", "head_size", "body_size", "jaccard"), F.struct("support", "body_size")).alias("m"), F.count("*").alias("size"))
    return best.select("head", "body", "m.*", "size").withColumn("confidence", F.col("support") / F.col("body_size"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rules of each set: common, only in one, and the share of the second that the first covers."""
    key = ["head", "body"]
    tagged = a.select(*key).distinct().withColumn("in_a", F.lit(1)).join(b.select(*key).distinct().withColumn("in_b", F.lit(1)), key, "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    s = tagged.agg(F.count("*").alias("all_rules"), F.count_if(both).alias("common"), F.count_if(F.col("in_b").isNull()).alias("only_first"), F.count_if(F.col("in_a").isNull()).alias("only_second"))
    return s.withColumn("coverage", F.when(F.col("common") + F.col("only_second") > 0, F.col("common") / (F.col("common") + F.col("only_second"))))


def type_matrix(rules: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by two classes with margins called ``sum``."""
    cube = rules.cube(row, column).agg(F.count("*").alias("rules"))
    return cube.select(F.coalesce(F.col(row), F.lit("sum")).alias(row), F.coalesce(F.col(column), F.lit("sum")).alias(column), "rules")


def distribution(rules: DataFrame, by: str, value: str) -> DataFrame:
    """Count, extremes, mean, median and standard deviation of a metric."""
    v = F.col(value)
    return rules.groupBy(by).agg(
        F.count("*").alias("n"), F.min(v).alias("lowest"), F.max(v).alias("highest"), F.round(F.avg(v), 9).alias("mean"), F.round(F.percentile(v, 0.5), 9).alias("median"), F.round(F.stddev_pop(v), 9).alias("deviation")
    )


def histogram(rules: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): ``bins`` equal bins; the last one includes ``high``."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rules.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def first_of_class(rules: DataFrame, klass: str, n: int) -> DataFrame:
    """The ``n`` best rules of each class."""
    order = Window.partitionBy(klass).orderBy(F.desc("confidence"), F.desc("support"), "head", "body")
    return rules.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def sample_rules(rules: DataFrame, each: int = 3, most: int = 10) -> DataFrame:
    """Rules to show, of (head, body, level, arity, confidence, support): ``each`` of the binary ones of level L1 and of L2, binary ones up to ``most`` with what follows, and ``most`` unary ones."""
    best = [F.desc("confidence"), F.desc("support"), "head", "body"]
    rows = rules.withColumn("k", F.row_number().over(Window.partitionBy("arity", "level").orderBy(*best)))
    first = F.when((F.col("arity") == "binary") & F.col("level").isin("L1", "L2") & (F.col("k") <= each), 0).otherwise(1)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("arity").orderBy(first, F.when(F.col("arity") == "binary", F.col("level")), *best)))
    return rows.where(F.col("place") <= most).drop("k")


def level_counts(rules: DataFrame) -> DataFrame:
    """Rules by level (L0 for an empty body, L1, L2, ...) and arity."""
    return rules.groupBy("level", "arity").agg(F.count("*").alias("rules"))


def best_of(rows: DataFrame, by: str, name: str, value: str) -> DataFrame:
    """Names of the largest and smallest value in each group."""
    return rows.groupBy(by).agg(F.max_by(name, F.struct(value, name)).alias("best"), F.min_by(name, F.struct(value, name)).alias("worst"))


def normalised(rows: DataFrame, by: str, value: str) -> Column:
    """Min-max normalisation of a column within groups (0.5 where all are equal)."""
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.5))
