"""New feature rows against a feature store, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_pairs(new: DataFrame, store: DataFrame, most: int, bands: int | None = None) -> DataFrame:
    """Pairs of new hashes (``id, f``) with stored ones within ``most`` bits, by an equi-join on bands; exact."""
    bands = bands or most + 1
    if bands <= most:
        raise ValueError("with so few bands close hashes could differ in all of them")
    cuts, at = [], 0
    for k in range(bands):
        width = 64 // bands + (k < 64 % bands)
        cuts.append((at, width))
        at += width

    def bands_of(f: str):
        return [F.shiftrightunsigned(F.col(f), s).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)) for s, w in cuts]

    def keyed(df: DataFrame, i: str, f: str) -> DataFrame:
        plain = df.where("f IS NOT NULL").select(F.col("id").alias(i), F.col("f").alias(f)).distinct()
        return plain.select(i, f, F.posexplode(F.array(*bands_of(f))).alias("band", "key"))

    joined = keyed(new, "id1", "f1").join(keyed(store, "id2", "f2"), ["band", "key"])
    distance = F.bit_count(F.col("f1").bitwiseXOR(F.col("f2")))
    # A pair counts only in the first band in which it agrees, so no pair has to be made distinct.
    first = F.coalesce(*[F.when(a == b, k) for k, (a, b) in enumerate(zip(bands_of("f1"), bands_of("f2"), strict=True))])
    return joined.where((distance <= most) & (first == F.col("band"))).select("id1", "id2", (1 - distance / F.lit(64.0)).alias("score"))


def match_stream(stream: DataFrame, store_path: str, out_path: str, checkpoint: str, most: int = 9):
    """Start a query that matches each micro-batch with the store and with itself, then adds it to the store.

    Batches are written under their number, so a batch that runs again replaces its own output.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("id", "f").write.mode("overwrite").parquet(f"{store_path}/batch={number}")
        new = spark.read.parquet(f"{store_path}/batch={number}")
        store = spark.read.option("basePath", store_path).parquet(store_path).where(F.col("batch") <= number).select("id", "f")
        found = store_pairs(new, store, most).where("id1 <> id2")
        found.select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), "score").distinct().write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
