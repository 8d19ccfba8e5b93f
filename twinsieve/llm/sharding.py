"""Sharding with a consistent-hash ring, virtual nodes and bounded loads.

A shard owns many virtual nodes on a ring of 64-bit positions; a row's arc is the one between two virtual nodes in
which the hash of its ``doc_id`` lies, and its shards, in order of preference, are the owners met clockwise from there.
A full shard passes rows on clockwise. Rows of one arc have the same preferences, so the loads are settled on the arcs'
row counts alone, and each row then takes the shard that its rank within its arc falls to. Arcs are cut into cells of
about ``CELL_ROWS`` rows, by a hash of id and text: different texts of a ``doc_id`` that a third of all rows share are
spread too, and the layout of the table decides nothing. Rows alike in id and text have one hash; they are counted by
input part before anything is put in order, and numbered part by part, so that no task has to hold them all.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm import storage

SHARDS = 8
VIRTUAL_NODES = 128
#: Rows that a cell of an arc holds, more or less; the driver sees a number for each cell.
CELL_ROWS = 1 << 20


def ring(shards: int, virtual_nodes: int) -> tuple[list[int], list[int]]:
    """Positions of the virtual nodes in ascending order, as signed 64-bit integers, and their owners."""
    nodes = []
    for shard in range(shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big", signed=True), shard))
    nodes.sort()
    return [p for p, _ in nodes], [s for _, s in nodes]


def preferences(owners: list[int], arc: int, shards: int) -> list[int]:
    """The distinct shards met clockwise from an arc's end. Arc i ends at node i; the last one wraps to node 0."""
    found: list[int] = []
    for k in range(len(owners)):
        shard = owners[(arc + k) % len(owners)]
        if shard not in found:
            found.append(shard)
            if len(found) == shards:
                break
    return found


def settle(counts: dict[int, int], owners: list[int], capacities: list[int]) -> dict[int, list[tuple[int, int]]]:
    """For each arc, (shard, rows) in the order in which its rows are dealt out.

    In each round the rows left over in each arc try the next shard clockwise, which takes them up to its capacity,
    arcs in ring order. With capacities that hold all rows, every row has a shard after one round for each shard.
    """
    room, left, dealt = list(capacities), dict(counts), {arc: [] for arc in counts}
    wish = {arc: preferences(owners, arc, len(capacities)) for arc in counts}
    for turn in range(len(capacities)):
        for arc in sorted(left):
            shard = wish[arc][turn]
            take = min(left[arc], room[shard])
            if take:
                dealt[arc].append((shard, take))
                room[shard] -= take
                left[arc] -= take
    if any(left.values()):
        raise ValueError("the capacities don't hold all rows")
    return dealt


def shard(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Assign every row to a shard; returns ``doc_id, size, text_crc32, shard, slot`` (slots gapless from 0).

    A shard holds at most ``(1 + slack)`` times the mean row count, rounded; with no slack, counts are at most one
    apart. ``size`` is the text's UTF-8 bytes plus 1; a null text counts as none, with crc32 0. A null ``doc_id`` has
    a place on the ring like any other. Of long texts only size and checksum are kept. Repeated rows each get a slot. Other columns are ignored. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    positions, owners = ring(shards, virtual_nodes)
    work = storage.Workspace(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.xxhash64(F.lit("ring"), F.col("doc_id"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        place.alias("place"),
        F.xxhash64(F.lit("row"), F.col("doc_id"), text).alias("g"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )
    top = F.shiftright(F.col("place"), 52).cast("int") + 2048
    edges = [bisect.bisect_left(positions, (cell - 2048) << 52) for cell in range(4096)] + [len(positions)]
    near = [(cell, edges[cell], positions[edges[cell] : edges[cell + 1]]) for cell in range(4096)]
    nodes = spark.createDataFrame(near, "top int, base int, within array<long>")
    # The arc: how many virtual nodes lie before the position. 4096 rows, made from the parameters alone, are broadcast.
    rows = rows.withColumn("top", top).join(F.broadcast(nodes), "top")
    rows = rows.withColumn("arc", F.pmod(F.col("base") + F.size(F.filter("within", lambda p: p < F.col("place"))), F.lit(len(positions))))
    rows = work.table(rows.select("doc_id", "size", "text_crc32", "g", "arc", "part", "at"), "rows")
    arcs = [(r["arc"], -(-r["count"] // CELL_ROWS)) for r in rows.groupBy("arc").count().collect()]  # shards * virtual_nodes rows
    salts = F.broadcast(spark.createDataFrame(arcs, "arc int, salts int"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col("g")), F.col("salts")).cast("int")
    rows = rows.join(salts, "arc").withColumn("salt", salt).drop("salts")
    groups = work.table(rows.groupBy("arc", "salt", "g", "part").agg(F.count(F.lit(1)).alias("n")), "groups")
    cells: dict[int, dict[int, int]] = {}
    for row in groups.groupBy("arc", "salt").agg(F.sum("n").alias("n")).collect():  # arcs, and one for each CELL_ROWS rows
        cells.setdefault(row["arc"], {})[row["salt"]] = row["n"]
    counts = {arc: sum(by.values()) for arc, by in cells.items()}
    total = sum(counts.values())
    least, more = divmod(total, shards)
    capacities = [max(least + (s < more), int((1 + slack) * total / shards)) for s in range(shards)]
    slots, plan = [0] * shards, []
    for arc, dealt in sorted(settle(counts, owners, capacities).items()):
        dealt = list(dealt)
        for salt in sorted(cells[arc]):
            rank, n = 0, cells[arc][salt]
            while rank < n:
                to, room = dealt[0]
                take = min(room, n - rank)
                plan.append((arc, salt, rank, rank + take, to, slots[to]))
                slots[to] += take
                rank += take
                dealt[0] = (to, room - take)
                if room == take:
                    dealt.pop(0)
    # At most cells + arcs * shards rows.
    plan_df = spark.createDataFrame(plan, "arc int, salt int, lo long, hi long, shard int, first long")
    in_cell = Window.partitionBy("arc", "salt").orderBy("g", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = groups.select("arc", "salt", "g", "part", (F.sum("n").over(in_cell) - F.col("n")).alias("start"))
    own = Window.partitionBy("arc", "salt", "g", "part").orderBy("at")  # alike rows of one input part
    ranked = rows.withColumn("turn", F.row_number().over(own) - 1).join(starts, ["arc", "salt", "g", "part"]).withColumn("rank", F.col("start") + F.col("turn"))
    dealt = ranked.join(F.broadcast(plan_df), ["arc", "salt"]).filter("rank >= lo AND rank < hi")
    return dealt.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"))


def op4_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
