"""What the operators of this subpackage share: tables, shared storage, size-checked joins."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import shared

#: Separators of words in every operator here: the six ASCII white-space characters.
SEPARATORS = "\\x20\\x09-\\x0D"
#: Rows up to which a side of a join with a few fixed-width columns is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
#: Rows in an Arrow batch for operators that move whole texts to Python, so that a batch stays small.
TEXT_BATCH = "512"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where written tables lie, and for each thread those that wait to be removed by settled().
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope = threading.local()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared(spark)}/termweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    if getattr(_scope, "open", None):
        _scope.open[-1].append(path)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written as a table; the tables that were written on the way are removed."""
    _scope.open = getattr(_scope, "open", None) or []
    _scope.open.append([])
    try:
        out = make()
        spark = out.sparkSession
        out = materialise(out)
    finally:
        paths = _scope.open.pop()
    kept = _places[out]
    for path in paths:
        if path != kept:
            _remove(spark, path)
    if _scope.open:
        _scope.open[-1].append(kept)
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialise() or settled() wrote, once nothing reads it any more; other frames stay as they are."""
    if path := _places.pop(df, None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most this many texts at a time, unless the session asks for another number than Spark's own.

    The setting counts when a plan is run and not when it is made, so it stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, TEXT_BATCH)


def sized(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """side with a broadcast hint if it has at most limit rows; else as it is, for a shuffled join.

    side must be cheap to count: a written table or a small aggregate. Its rows must be narrow.
    """
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
