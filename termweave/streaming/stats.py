"""Running statistics of a numeric variable, as a stream of Parquet files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import shared


def summaries(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, variance, stddev, least, most, total of each key's values; nulls don't count. For batches and streams.

    The state is one row of sums for each key. A key of nulls alone has n 0 and nulls; the variance of one value is null.
    """
    v = F.col(value)
    measures = {"n": F.count(v), "mean": F.avg(v), "variance": F.var_samp(v), "stddev": F.stddev_samp(v), "least": F.min(v), "most": F.max(v), "total": F.sum(v)}
    return rows.groupBy(key).agg(*[m.alias(k) for k, m in measures.items()])


def run_available(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Streams the Parquet files that match path, and returns the summaries once all that is there has been read.

    Each micro-batch replaces the written table of one row for each key, so a batch that is tried again does no harm.
    State and table stand in the session's shared checkpoint folder.
    """
    own = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).select(key, value).schema
    live = summaries(spark.readStream.schema(schema).parquet(path), key, value)

    def replace(table: DataFrame, _: int) -> None:
        table.write.mode("overwrite").parquet(f"{own}/table")

    replace(spark.createDataFrame([], live.schema), -1)
    live.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{own}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{own}/table")
