"""Sizing rules as column expressions; at run time Spark's memory manager and AQE do this work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MEMORY = 8 * 1024**3


def keyframe_bytes(frames: Column, width: Column, height: Column) -> Column:
    return F.floor(frames.cast("double") * width * height * 3 * F.lit(1.05)).cast("long")


def feature_bytes(videos: Column, frames: Column, dimensions: Column) -> Column:
    return (videos.cast("long") * frames * dimensions * 4).cast("long")


def batch_size(limit: Column, each: Column, n: Column) -> Column:
    """Twice what the limit holds, at least 1 and at most n; 0 without items."""
    fits = F.when(each > 0, F.floor(limit / each).cast("long") * 2).otherwise(n)
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(fits, n))).cast("long")


def memory_limit(total: Column, share: float = 0.8) -> Column:
    """A share of the memory; a fixed amount where it is unknown."""
    return F.floor(F.coalesce(F.when(total > 0, total), F.lit(DEFAULT_MEMORY)) * F.lit(share)).cast("long")


def adapted_batch(ratios: Column, initial: Column) -> Column:
    """The batch size after a row of memory ratios (an array in order), starting from ``initial``.

    Over 0.95 it is halved, over 0.90 cut to three quarters (at least 1); under 0.70, once it has been reduced, it grows
    by a quarter up to the initial size, which ends the reduction.
    """
    start = F.struct(initial.cast("long").alias("size"), F.lit(False).alias("reduced"))

    def step(state: Column, r: Column) -> Column:
        size, reduced = state["size"], state["reduced"]
        cut = F.when(r > 0.95, F.floor(size * 0.5)).when(r > 0.90, F.floor(size * 0.75)).cast("long")
        grown = F.least(F.greatest(F.floor(size * 1.25).cast("long"), size), initial.cast("long"))
        grows = reduced & (r < 0.70)
        new = F.when(r > 0.90, F.greatest(F.lit(1).cast("long"), cut)).when(grows, grown).otherwise(size)
        flag = F.when(r > 0.90, True).when(grows, grown < initial).otherwise(reduced)
        return F.struct(new.alias("size"), flag.alias("reduced"))

    return F.aggregate(ratios, start, step, lambda s: s["size"])


def worker_count(cores: int) -> int:
    return max(1, int(cores * 0.9))
