"""Best-fit-decreasing packing of tokenised documents into sequences.

Lengths are integers up to the capacity, so the packing only needs to know how many pieces have each length. Those
counts (at most ``capacity`` of them for each salt) go to the driver, which runs best-fit decreasing over runs of equal
pieces: a segment tree over remaining capacities gives the tightest open bins in logarithmic time, and one step places
a whole run in bins that are alike. The outcome equals the outcome of placing the pieces one by one. It is a table of
rules (a length, a range of ranks, the first bin, the offset), whose size follows from the capacity and not from the
number of documents. Pieces get their ranks within their length by counting within salted cells, so a length that a
third of all rows share doesn't meet in one task.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm import storage, tokens

CAPACITY = 4096


class OpenCapacities:
    """Segment tree over capacities 0..n: which of them have open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [False] * (2 * self.size)

    def put(self, capacity: int, has: bool) -> None:
        i = self.size + capacity
        self.tree[i] = has
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has open bins."""
        i = self.size + least
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first rank, last rank + 1, first bin, offset) for pieces given as length -> how many.

    Of the pieces of a length, those with ranks in the range go to consecutive bins at the offset.
    """
    tree, bins, rules, opened = OpenCapacities(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tree.tightest(length)
            fill = (capacity if c is None else c) // length
            if c is None:
                c = capacity
                bins[c] = [(opened, -(-left // fill))]
                opened += -(-left // fill)
            first, n = bins[c].pop()
            # A bin takes pieces of this length until they don't fit, for it stays the tightest.
            full = min(n, left // fill)
            parts = [(first, full, fill)] if full else []
            if full < n and left > full * fill:
                parts.append((first + full, 1, left - full * fill))
            used = 0
            for start, many, each in parts:
                for j in range(each):
                    rules.append((length, rank, rank + many, start, capacity - c + j * length))
                    rank += many
                left -= many * each
                used += many
                rest = c - each * length
                bins.setdefault(rest, []).append((start, many))
                if rest:
                    tree.put(rest, True)
            if used < n:
                bins[c].append((first + used, n - used))
            if c != 0:
                tree.put(c, bool(bins[c]))
    return rules


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int | None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, and ``part, at``, the input part and the place in it, of each piece."""
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def cut(batches):
        encode = tokens.encoder(path).encode
        seen, here = 0, TaskContext.get().partitionId()
        for batch in batches:
            out = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode(text.as_py()) + tail
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    seen += 1
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), here, seen), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, at long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int | None = 1, work: storage.Workspace | None = None) -> DataFrame:
    """Pack all rows' tokens into sequences of at most ``capacity``.

    Only documents longer than the capacity are cut. Null and empty texts are packed as ``end_id`` alone (without an
    ``end_id`` they have no piece). Repeated rows are each packed; a null ``doc_id`` stays null; other columns are
    ignored; an empty table gives no rows. Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    spark = docs.sparkSession
    work = work or storage.Workspace(spark, "packing")
    pieces = work.table(pieces_of(docs, path or tokens.default_path(), capacity, end_id), "pieces")
    counts = work.table(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rules = best_fit_decreasing(totals, capacity)
    rule_df = spark.createDataFrame(rules, "length long, lo long, hi long, bin long, offset long")
    # Pieces of a length are numbered part by part: no task holds more of them than an input part has.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("length", "part", (F.sum("n").over(before) - F.col("n")).alias("first"))
    own = Window.partitionBy("length", "part").orderBy("at")
    ranked = pieces.withColumn("turn", F.row_number().over(own) - 1).join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("turn"))
    near = F.broadcast(rule_df) if len(rules) <= 64 * capacity else rule_df
    placed = ranked.join(near, ["length"]).filter("rank >= lo AND rank < hi")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
