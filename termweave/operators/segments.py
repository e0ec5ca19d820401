"""An index that grows: each append writes an immutable segment; readers see the segments that the newest manifest names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import StoredIndex, cut, doc_stats, save, written_postings


class GrowingIndex(StoredIndex):
    """Segments under a folder. A name (a column of the documents) that a segment has isn't taken in again: the first document of a name wins.

    A manifest is a small folder of its own, written after its segments: a reader sees a whole append or none of it. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", name: str = "name", text: str = "text"):
        super().__init__(spark, folder)
        self.key, self.name, self.text = key, name, text
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.live = 0, []
        if files.exists(place):
            manifest = spark.read.schema("segment string, v long").parquet(f"{folder}/manifest")
            rows = manifest.filter(F.col("v") == manifest.agg(F.max("v")).first()[0]).collect()  # a row a segment
            self.version, self.live = rows[0]["v"], sorted(r["segment"] for r in rows)

    def table(self, name: str) -> DataFrame:
        if not self.live:
            raise ValueError("the index has no segment yet")
        return self.spark.read.parquet(*[f"{self.folder}/segments/{s}/{name}" for s in self.live])

    def terms(self) -> DataFrame:
        """term, cf, df summed over segments."""
        return self.table("terms").groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))

    def append(self, docs: DataFrame) -> GrowingIndex:
        """Writes the documents whose names are new as a segment; of a name that comes several times the document of the least key."""
        firsts = docs.groupBy(F.col(self.name).alias("__n")).agg(F.min(self.key).alias("__k"))
        if self.live:
            firsts = firsts.join(self.variables().select(F.col(self.name).alias("__n")), "__n", "left_anti")
        firsts = cut(firsts)
        new = cut(docs.join(firsts, (F.col(self.name) == F.col("__n")) & (F.col(self.key) == F.col("__k")), "left_semi"))
        segment = uuid.uuid4().hex
        kept = written_postings(new, self.key, self.text)
        stats = kept.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
        save({"postings": kept, "terms": stats, "lengths": doc_stats(new, self.key, self.text), "variables": new.drop(self.text)}, f"{self.folder}/segments/{segment}")
        return self._publish([*self.live, segment])

    def compact(self) -> GrowingIndex:
        """All segments as one, in ranges of terms. Documents of segments differ, so postings need no merging; counts of terms are summed. Old segments stay for readers that have them open."""
        segment = uuid.uuid4().hex
        save({"postings": self.table("postings"), "terms": self.terms(), "lengths": self.lengths(), "variables": self.variables()}, f"{self.folder}/segments/{segment}")
        return self._publish([segment])

    def _publish(self, segments: list[str]) -> GrowingIndex:
        self.version, self.live = self.version + 1, segments
        self.spark.createDataFrame([(s,) for s in segments], "segment string").write.parquet(f"{self.folder}/manifest/v={self.version}")
        return self
