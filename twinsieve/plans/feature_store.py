"""Features kept between scans, by path, time of change, size and method."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("path", "mtime", "size")


class FeatureStore:
    """A folder of Parquet, one partition for each method; rows are added and never changed."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, method: str) -> str:
        return f"{self.path}/method={method}"

    def stored(self, method: str) -> DataFrame | None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder(method))
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self._folder(method)) if there else None

    def missing(self, media: DataFrame, method: str) -> DataFrame:
        """The rows of ``media`` that are new or have changed: a changed file has another key."""
        known = self.stored(method)
        return media if known is None else media.join(known.select(*KEY), list(KEY), "left_anti")

    def features(self, media: DataFrame, method: str, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``id, f`` and what else ``extract`` gives, of all media (``ord, path, mtime, size``).

        ``extract`` (media to rows with ``path`` and ``f``) is called for the files that the store lacks, if there are
        any. Keys join by equality: no file that is known is read again.
        """
        new = self.missing(media, method)
        if not new.isEmpty():
            new.select(*KEY).join(extract(new), "path").write.mode("append").parquet(self._folder(method))
        rows = self.stored(method)
        if rows is None:
            return extract(media).withColumn("id", F.lit(None).cast("long")).drop("path").limit(0)
        own = media.select(F.col("ord").alias("id"), *KEY)
        return own.join(rows.dropDuplicates(list(KEY)), list(KEY)).drop(*KEY)
