"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets: a source's share of the wanted total is its weight's; a source whose share exceeds ``max_epochs`` times its
size is held there and the excess goes to the others by weight, until none exceeds. The sources stay in a DataFrame:
each step is one small aggregation, and the steps end when no further source is held.

Sampling: every document of a source is taken floor(target / size) times, and a seeded selection of the documents once
more. The selection takes documents in the order of a seeded hash up to the remaining words. The cut is found with a
histogram of the hashes for each source (``BUCKETS`` sums, added up before the shuffle), so only the documents of one
histogram cell for each source are put in order. Then single documents are exchanged, ``EXCHANGES`` times for each
source, where that brings the words taken nearer to the target. Only whole documents are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm import storage

BUCKETS = 4096
EXCHANGES = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    """How many words a text column has; none for a null."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(text, WORD, "x")) - F.length(F.regexp_replace(text, WORD, ""))).cast("long")


def cyclic_weights(sources: DataFrame, work: storage.Workspace, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``source, weight`` for one row a source: the weights in turn, sources by code point, the null source last.

    Sources are numbered in range partitions whose counts are added up, so that no task needs to hold them all. The
    partitions are written first: evaluated once for the counts and once for the rows, they would not be the same.
    """
    key = F.encode(F.col("source"), "UTF-8")
    nulls = F.col("source").isNull()
    placed = sources.select("source").withColumn("missing", nulls.cast("int")).withColumn("key", key)
    placed = placed.repartitionByRange("missing", "key").sortWithinPartitions("missing", "key")
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    placed = placed.withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    placed = work.table(placed.select("source", "part", "row"), "placed")
    sizes = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    turn = F.pmod(F.col("start") + F.col("row"), F.lit(len(weights))).cast("int")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return placed.join(starts, "part").select("source", F.get(cycle, turn).alias("weight"))


def targets(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to ``source, source_size, weight``: the weights' shares of ``share`` times all sizes, capped.

    Weights are positive. If all sources are held, the total falls short of what was wanted.
    """
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    level, held = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        row = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"), F.count_if(over).alias("held")).first()
        if row["held"] == held or not row["free"]:
            break
        held = row["held"]
        level = (total - row["fixed"]) / row["free"]
    if level is None or not row["free"]:
        return sources.withColumn("target", cap.cast("double"))
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def mix(docs: DataFrame, work: storage.Workspace, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """The documents' columns plus ``size, source_size, target, copies``: how often the mix takes each document.

    Sizes are words; a null or empty text has none, and is taken as often as its source's whole repetitions say. A null
    source is a source of its own, after the others. Repeated rows are documents of their own. What is taken follows from
    the seed, the ids and the texts, not from how the table is laid out; rows alike in both may stand for one another. Columns named like the
    added ones are replaced. Words of whole texts count, however long. An empty table gives no rows. ``keep`` names the columns to return, all by default.
    """
    added = ["size", "source_size", "target", "copies"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # Row number, hash and histogram cell go under names that the documents' columns can't clash with.
    spare = "mix_" + "_" * max((len(c) for c in docs.columns), default=0)
    u, cell, row, src = f"{spare}u", f"{spare}b", f"{spare}r", f"{spare}s"
    base = docs.select(*own, words(F.col("text")).alias("size"), F.col("source").cast("string").alias(src), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias(u))
    base = base.withColumn(cell, F.shiftright(u, 52).cast("int") + BUCKETS // 2).withColumn(row, F.monotonically_increasing_id())
    base = work.table(base, "documents")
    small = base.select(F.col(src).alias("source"), "size", F.col(u).alias("u"), F.col(cell).alias("b"), F.col(row).alias("r"))
    per = work.table(small.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    weighed = work.table(_join(per, cyclic_weights(per, work, weights), "source"), "weighed")
    plan = targets(weighed, share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = work.table(plan.select("source", "source_size", "target", "whole", "rest"), "plan")
    # Cells of the histogram below the cut are taken whole (state 1), those above not (0); the cell of the cut (2) is put in order.
    cells = small.groupBy("source", "b").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = _join(cells.withColumn("upto", F.sum("words").over(up_to)), plan.select("source", "rest"), "source")
    state = F.when(F.col("rest") <= 0, 0).when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("words") >= F.col("rest"), 0).otherwise(2)
    cells = work.table(cells.select("source", "b", state.alias("state"), "rest", (F.col("upto") - F.col("words")).alias("below")), "cells")
    known = work.table(_join(small, cells, "source", "b"), "known")
    inside = _selected(known.where("state = 2"), work)
    chosen = known.where("state <> 2").withColumn("extra", F.col("state")).unionByName(inside)
    chosen = work.table(chosen.select("source", "size", "u", "r", "rest", "extra"), "chosen")
    gaps = chosen.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.col("extra"))).alias("gap"))
    swaps = work.table(gaps.withColumn("swapped", F.array().cast("array<long>")), "swaps0")
    for turn in range(EXCHANGES):
        swaps = work.table(_exchange(chosen, swaps), f"swaps{turn + 1}")
    swapped = _join(chosen, swaps.select("source", "swapped"), "source")
    extra = F.when(F.array_contains("swapped", F.col("r")), 1 - F.col("extra")).otherwise(F.col("extra"))
    taken = swapped.select(F.col("r").alias(row), extra.alias(f"{spare}x"))
    numbers = plan.select(F.col("source").alias(f"{spare}k"), "source_size", "target", F.col("whole").alias(f"{spare}w"))
    out = base.join(taken, row).join(numbers, F.col(src).eqNullSafe(F.col(f"{spare}k")))
    return out.select(*own, "size", "source_size", "target", (F.col(f"{spare}w") + F.col(f"{spare}x")).cast("int").alias("copies"))


def _selected(inside: DataFrame, work: storage.Workspace) -> DataFrame:
    """Add ``extra`` to the documents of the cut's cells: 1 for those up to where the words wanted are nearest.

    Alike documents follow one another in any order, so they are counted first: what counts is how many of them are
    taken. Only where that is some of them are they numbered, by input part.
    """
    alike = inside.groupBy("source", "u", "size", "rest", "below").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = F.col("rest") - F.col("below") - (F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size"))
    fitting = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).when(room >= 0, F.col("n")).otherwise(0)
    alike = work.table(alike.select("source", "u", "size", "n", F.greatest(F.lit(0), F.least(F.col("n"), fitting)).cast("long").alias("taken")), "alike")
    rows = _join(inside, alike, "source", "u", "size")
    settled = rows.where("taken = 0 OR taken = n").withColumn("extra", (F.col("taken") > 0).cast("int"))
    some = rows.where("taken > 0 AND taken < n").withColumn("part", F.shiftright("r", 33).cast("int"))
    counts = some.groupBy("source", "u", "size", "part").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("source", "u", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("source", "u", "size", "part", (F.sum("here").over(before) - F.col("here")).alias("first"))
    turn = F.row_number().over(Window.partitionBy("source", "u", "size", "part").orderBy("r")) - 1
    numbered = _join(some.withColumn("turn", turn), starts, "source", "u", "size", "part")
    numbered = numbered.withColumn("extra", (F.col("first") + F.col("turn") < F.col("taken")).cast("int"))
    return settled.select(*inside.columns, "extra").unionByName(numbered.select(*inside.columns, "extra"))


def _join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join on keys that may be null."""
    named = right.select(*[F.col(c).alias(f"right_of_{c}") if c in keys else F.col(c) for c in right.columns])
    on = None
    for k in keys:
        same = left[k].eqNullSafe(named[f"right_of_{k}"])
        on = same if on is None else on & same
    return left.join(named, on).drop(*[f"right_of_{k}" for k in keys])


def _exchange(chosen: DataFrame, swaps: DataFrame) -> DataFrame:
    """In each source, take up or give back the one document that brings its words nearest to what is wanted."""
    step = F.when(F.col("extra") == 0, F.col("size")).otherwise(-F.col("size"))
    gain = F.abs("gap") - F.abs(F.col("gap") - step)
    offered = _join(chosen, swaps, "source").where((gain > 0) & ~F.array_contains("swapped", F.col("r")))
    best = offered.groupBy("source").agg(F.max_by(F.struct(F.col("r"), step.alias("step")), F.struct(gain, F.col("u"), F.col("r"))).alias("best"))
    both = swaps.join(best.withColumnRenamed("source", "of"), swaps["source"].eqNullSafe(F.col("of")), "left")
    gap = F.col("gap") - F.coalesce(F.col("best.step"), F.lit(0))
    swapped = F.when(F.col("best").isNull(), F.col("swapped")).otherwise(F.array_append("swapped", F.col("best.r")))
    return both.select("source", gap.alias("gap"), swapped.alias("swapped"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(docs, storage.Workspace(spark, "mixing"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
