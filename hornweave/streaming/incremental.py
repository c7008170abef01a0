"""Streaming extension: relation statistics and merged rule metrics that follow arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRIPLES = "h string, r string, t string"
RULES = "head string, body string, support long, head_size long, body_size long, jaccard double"


def triple_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated triples of every file that appears in a folder."""
    return spark.readStream.schema(TRIPLES).option("sep", "\t").csv(folder)


def rule_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RULES).json(folder)


def relation_counts(stream: DataFrame) -> DataFrame:
    """Running number of triples and loops of each relation."""
    return stream.groupBy("r").agg(F.count_if(F.col("h") != F.col("t")).alias("triples"), F.count_if(F.col("h") == F.col("t")).alias("loops"))


def merged_metrics(stream: DataFrame) -> DataFrame:
    """Running merge of rule metrics: the merge is a sum, so files may come in any order."""
    sums = stream.groupBy("head", "body").agg(F.sum("support").alias("support"), F.sum("head_size").alias("head_size"), F.sum("body_size").alias("body_size"), F.avg("jaccard").alias("jaccard"), F.count("*").alias("size"))
    return sums.withColumn("confidence", F.col("support") / F.col("body_size"))


def to_memory(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there, then stops."""
    return stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
