"""Pair joins: every pair of rows i < j of a feature table whose score reaches a threshold.

The exact joins are block nested loops. Rows are dealt into blocks of bounded size, each block is packed once, and a
task gets two blocks and scores all their pairs tile by tile. A block is sent to as many tasks as there are blocks.
There are up to ``BLOCKS`` of them, which grow with the table, so the shuffle grows with the rows until a block has
``BLOCK_BYTES``; from there on the number of blocks grows. Nothing is broadcast, and no task holds more than two blocks.
Hash joins at strict thresholds use banding, an equi-join that loses no pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import kernels
from twinsieve.plans.workspace import Workspace

#: Rows that are scored at once, and the fewest that a block is meant to have.
BLOCK_ROWS = 2000
#: So many blocks are enough work for a cluster, two to a task; blocks grow with the table up to ``BLOCK_BYTES``.
BLOCKS, BLOCK_BYTES = 24, 32 << 20
PAIRS = "id1 long, id2 long, score double"

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def with_order(df: DataFrame, *keys: str, name: str = "ord", work: Workspace | None = None) -> DataFrame:
    """Number rows from 0 by keys; no task sees all rows. Rows with equal keys are numbered in any order.

    The rows are sorted over range partitions and written once; a partition's first number is the sum of the counts of
    those before it, and one count for each partition is what the driver sees.
    """
    work = work or Workspace(df.sparkSession, "order")
    at = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", at)
    placed = work.table(placed, f"order-{uuid.uuid4().hex}").withColumns({"_part": F.shiftright("_at", 33).cast("int"), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    starts, before = [], 0
    for part, count in sorted(placed.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += count
    first = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return placed.join(F.broadcast(first), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start", "_at")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return column.to_numpy(zero_copy_only=False)


def _payload(table: pa.Table) -> bytes:
    """A block's rows as one value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows_of(payload: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(payload.as_buffer()).read_all()


def rows_in_block(rows: int, row_bytes: int, least: int = BLOCK_ROWS) -> int:
    """Rows that a block of a table has: a share of the table, at least ``least``, at most what ``BLOCK_BYTES`` hold."""
    return max(least, min(-(-rows // BLOCKS), BLOCK_BYTES // max(1, row_bytes)))


def numbers_of(df: DataFrame, column: str) -> Column:
    """A vector column as numbers that blocks carry: single precision stays, which halves them, the rest is double."""
    return F.col(column) if df.schema[column].dataType == T.ArrayType(T.FloatType()) else F.col(column).cast("array<double>")


def vector_bytes(df: DataFrame, column: str) -> int:
    """Bytes of one value of a column of numbers or of vectors of one length; 8 if there is no row."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        return 8
    size = df.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return max(8, size[0] * (4 if kind.elementType == T.FloatType() else 8)) if size else 8


def block_pairs(rows: DataFrame, block: Column, blocks: int, keys: tuple[str, ...], score, schema: str, first: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Call ``score(a, b, left, right)`` for all pairs a <= b of blocks of ``rows``; with a = b both tables are the same.

    Each block becomes one value, which is sent once to every task that needs it. ``keys`` are columns that both blocks
    of a pair have to agree in. Only pairs in which b is ``first`` or later are looked at. ``columns`` are what a block
    carries, all if not given.
    """
    named = rows.withColumn("_block", block.cast("int"))
    columns = columns or rows.columns

    def pack(key, table):
        return pa.table({**{k: [v] for k, v in zip(keys, key[:-1], strict=True)}, "_block": [key[-1]], "payload": pa.array([_payload(table.select(columns))], pa.binary())}, schema=packed_schema)

    kinds = [named.schema[k] for k in keys]
    shape = T.StructType([*kinds, T.StructField("_block", T.IntegerType()), T.StructField("payload", T.BinaryType())])
    packed_schema = pa.schema([*((k.name, _ARROW_KEYS[k.dataType.typeName()]) for k in kinds), ("_block", pa.int32()), ("payload", pa.binary())])
    packed = named.groupBy(*keys, "_block").applyInArrow(pack, shape)
    ends = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("_block", k).alias("a"), F.greatest("_block", k).alias("b")))
    ends = F.filter(ends, lambda p: p["b"] >= first)
    sent = packed.select(*keys, "_block", "payload", F.explode(ends).alias("p")).select(*keys, "_block", "payload", "p.a", "p.b")
    empty = pa.schema([]).empty_table()

    def pair(key, table):
        a, b = key[-2].as_py(), key[-1].as_py()
        found = dict(zip(table["_block"].to_pylist(), table["payload"], strict=True))
        if len(found) < 1 + (a != b):
            return score(a, b, empty, empty)
        left = _rows_of(found[a])
        return score(a, b, left, left if a == b else _rows_of(found[b]))

    return sent.groupBy(*keys, "a", "b").applyInArrow(pair, schema)


_ARROW_KEYS = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64()}
_NO_PAIRS = pa.table({"id1": pa.array([], pa.int64()), "id2": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def blocked_pairs(
    features: DataFrame, scorer: Scorer, threshold: float, block_rows: int | None = None, rows: int | None = None, asymmetric: bool = False, fresh: str | None = None
) -> DataFrame:
    """Pairs of ``features`` (``id`` long, ``f`` number or array of one length, optional ``kind``) that score enough.

    ``scorer(a, b)`` gives the scores of all rows of a with all rows of b. Rows with a null feature or id are left out;
    null elements aren't allowed. Where ``kind`` exists only rows of one kind are paired. ``id1 < id2`` always, and with
    ``asymmetric`` scores are those of the smaller id against the larger. ``fresh`` names a boolean column: pairs of two
    rows that aren't are not looked at. ``scorer`` gets up to ``BLOCK_ROWS`` rows a side; blocks have ``block_rows`` rows,
    or as many as ``rows_in_block`` says.
    """
    fine = features.where(F.col("id").isNotNull() & F.col("f").isNotNull())
    kind = (F.col("kind").cast("string") if "kind" in features.columns else F.lit("")).alias("kind")
    old = 0
    if fresh is not None:
        rows, old = fine.agg(F.count(F.lit(1)), F.count_if(~F.col(fresh))).first()
        block_rows = block_rows or rows_in_block(rows, 8 + vector_bytes(fine, "f"))
        old = -(-old // block_rows)
        blocks = old + max(1, -(-rows // block_rows) - old)
        block = F.when(F.col(fresh), F.pmod(F.xxhash64("id"), F.lit(blocks - old)) + old).otherwise(F.pmod(F.xxhash64("id"), F.lit(max(1, old))))
    else:
        rows = fine.count() if rows is None else rows
        block_rows = block_rows or rows_in_block(rows, 8 + vector_bytes(fine, "f"))
        blocks = max(1, -(-rows // block_rows))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    fine = fine.select("id", "f", kind, block.cast("int").alias("own"))

    def score(a, b, left, right):
        if not left.num_rows:
            return _NO_PAIRS
        x, f = left["id"].to_numpy(), _matrix(left["f"])
        if a == b:  # in order of ids, a tile below the diagonal has no pair
            order = np.argsort(x, kind="stable")
            x, f = x[order], f[order]
        y, g = (x, f) if a == b else (right["id"].to_numpy(), _matrix(right["f"]))
        i, j, v = [], [], []
        for at in range(0, len(x), BLOCK_ROWS):
            for to in range(at if a == b else 0, len(y), BLOCK_ROWS):
                xs, fs, ys, gs = x[at : at + BLOCK_ROWS], f[at : at + BLOCK_ROWS], y[to : to + BLOCK_ROWS], g[to : to + BLOCK_ROWS]
                s = scorer(fs, gs)
                found = [(s, np.less)]
                if a != b:
                    found.append((scorer(gs, fs).T if asymmetric else s, np.greater))
                for values, side in found:
                    p, q = np.nonzero(values >= threshold)
                    own = side(xs[p], ys[q])
                    p, q = p[own], q[own]
                    i.append(np.minimum(xs[p], ys[q]))
                    j.append(np.maximum(xs[p], ys[q]))
                    v.append(values[p, q])
        return pa.table({"id1": np.concatenate(i), "id2": np.concatenate(j), "score": np.concatenate(v).astype(np.float64)})

    return block_pairs(fine, F.col("own"), blocks, ("kind",), score, PAIRS, old, ["id", "f"])


def cosine_pairs(features: DataFrame, threshold: float, **options) -> DataFrame:
    """Cosines in 0..1, clipped; a zero vector scores 0.5 with everything."""
    return blocked_pairs(features.withColumn("f", numbers_of(features, "f")), lambda a, b: kernels.cosine_score(a.astype(np.float64), b.astype(np.float64)), threshold, **options)


def histogram_pairs(features: DataFrame, threshold: float, **options) -> DataFrame:
    """Correlations of histograms, 0 where negative."""
    return blocked_pairs(features.withColumn("f", numbers_of(features, "f")), lambda a, b: kernels.correlation(a.astype(np.float64), b.astype(np.float64)), threshold, **options)


def hash_score(a: Column, b: Column, bits: int = 64) -> Column:
    """1 - Hamming distance / bits; 0 where a hash is missing."""
    return F.coalesce(1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits)), F.lit(0.0))


def _ball(width: int, radius: int) -> list[int]:
    """All patterns of ``width`` bits with up to ``radius`` set."""
    return [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(width), r)]


def band_plan(most: int, bits: int = 64) -> tuple[int, int, float]:
    """(bands, radius, share): how close hashes are best found, and the share of all pairs of random hashes that meet.

    Hashes within ``most`` bits differ by ``most // bands`` or fewer in one of the bands. Fewer, wider bands are more
    selective, but a row has to look up all values within the radius. The smallest radius that lets few pairs meet is
    taken, or the most selective of those tried.
    """
    plans = []
    for radius in (0, 1, 2):
        bands = min(most // (radius + 1) + 1, bits)
        share = sum(len(_ball(width, radius)) / 2.0**width for _, width in _bands(bands, bits))
        plans.append((bands, radius, share))
        if share < 0.02:
            break
    return min(plans, key=lambda p: p[2])


def _bands(bands: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each band."""
    cuts, at = [], 0
    for k in range(bands):
        width = bits // bands + (k < bits % bands)
        cuts.append((at, width))
        at += width
    return cuts


def _close_pairs(features: DataFrame, most: int, bits: int, fresh: str | None = None) -> DataFrame:
    """Pairs within a Hamming distance, by pigeonhole: close pairs differ little in one of the bands (``band_plan``)."""
    bands, radius, _ = band_plan(most, bits)
    cuts = _bands(bands, bits)
    keys = [F.shiftrightunsigned("f", s).bitwiseAND(F.lit((1 << min(w, 63)) - 1 if w < 64 else -1)) for s, w in cuts]
    masks = [[m - (1 << 64) if m >> 63 else m for m in _ball(w, radius)] for _, w in cuts]
    new = F.col(fresh) if fresh is not None else F.lit(True)
    rows = features.where("f IS NOT NULL AND id IS NOT NULL").select("id", "f", new.alias("new"), F.array(*keys).alias("bands"))
    left = rows.select("id", "f", "new", "bands", F.posexplode("bands").alias("band", "key"))
    near = F.array(*[F.array(*[F.col("bands")[k].bitwiseXOR(F.lit(m)) for m in own]) for k, own in enumerate(masks)])
    right = rows.select(F.col("id").alias("id2"), F.col("f").alias("f2"), F.col("new").alias("new2"), F.col("bands").alias("bands2"), F.posexplode(near).alias("band", "keys"))
    right = right.select("id2", "f2", "new2", "bands2", "band", F.explode("keys").alias("key"))
    found = left.join(right, ["band", "key"]).where((F.col("id") < F.col("id2")) & (F.col("new") | F.col("new2")))
    # A pair counts only in the first band in which it is near, so no pair needs to be made distinct.
    first = F.array_position(F.zip_with("bands", "bands2", lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius), True) - 1
    close = F.bit_count(F.col("f").bitwiseXOR(F.col("f2"))) <= most
    return found.where(close & (first == F.col("band"))).select(F.col("id").alias("id1"), "id2", hash_score(F.col("f"), F.col("f2"), bits).alias("score"))


#: Up to this share of all pairs, those that meet in a band are fewer than blocks compare in the same time.
BAND_SHARE = 0.1


def hash_pairs(features: DataFrame, threshold: float, bits: int = 64, band_from: float | None = None, missing_as_zero: bool = False, **options) -> DataFrame:
    """Pairs of hashes (``f`` long) that agree in enough bits.

    At strict thresholds bands are selective and the join is an equi-join on them; where too many pairs would meet, or
    below ``band_from`` if that is given, blocks are compared whole. Missing hashes are left out, or, as in a comparison
    of precomputed hashes, score 0 with every row, which matters at a threshold of 0 only.
    """
    if missing_as_zero and threshold <= 0:
        options.pop("fresh", None)  # all pairs score
        filled = features.withColumn("f", F.array(F.coalesce("f", F.lit(0)), F.col("f").isNotNull().cast("long")))

        def score(a, b):
            return np.where(np.multiply.outer(a[:, 1], b[:, 1]) > 0, kernels.hamming_score(a[:, 0], b[:, 0], bits), 0.0)

        return blocked_pairs(filled, score, threshold, **options)
    most = int(np.floor((1 - threshold) * bits + 1e-9))
    banded = band_plan(most, bits)[2] <= BAND_SHARE if band_from is None else threshold >= band_from
    if banded and 0 <= most < bits and "kind" not in features.columns:
        return _close_pairs(features, most, bits, options.get("fresh"))
    return blocked_pairs(features, lambda a, b: kernels.hamming_score(a, b, bits), threshold, **options)


def ordered(pairs: DataFrame) -> DataFrame:
    """Best score first, ties by ids."""
    return pairs.orderBy(F.desc("score"), "id1", "id2")


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Descriptors as rows of bytes: from binary values, numbers, or arrays of 64-bit words, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.ascontiguousarray(_matrix(column).reshape(len(column), -1).astype("<i8")).view(np.uint8)


#: Distances that a task holds at once.
TILE = 1 << 21


def _nearest_in_groups(left: np.ndarray, right: np.ndarray, starts: np.ndarray, left_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a side and each group of consecutive rows of the other one: distance * rows + place of the nearest.

    The first result is (left rows, right groups), the second (left groups, right rows). Ties go to the earlier place.
    """
    n, m = len(left), len(right)
    words = max(1, left.shape[1] // 8) if left.shape[1] % 8 == 0 else 0
    x, y = (v.view(np.uint64) if words else v for v in (left, right))
    forward = np.empty((n, len(starts)), np.int64)
    backward = np.full((len(left_starts), m), np.iinfo(np.int64).max)
    group = np.searchsorted(left_starts, np.arange(n), side="right") - 1
    for at in range(0, n, max(1, TILE // max(1, m))):
        part = x[at : at + max(1, TILE // max(1, m))]
        distance = np.zeros((len(part), m), np.int64)
        for k in range(x.shape[1]):
            distance += np.bitwise_count(part[:, k, None] ^ y[None, :, k])
        forward[at : at + len(part)] = np.minimum.reduceat(distance * m + np.arange(m), starts, axis=1)
        own = group[at : at + len(part)]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        best = np.minimum.reduceat(distance * n + np.arange(at, at + len(part))[:, None], first, axis=0)
        backward[own[first]] = np.minimum(backward[own[first]], best)
    return forward, backward


def descriptor_pairs(descriptors: DataFrame, below: int = 50, block_rows: int = BLOCK_ROWS, work: Workspace | None = None) -> DataFrame:
    """Picture pairs by mutual nearest descriptors: ``id1, id2, score`` for ``image_id, idx, h``.

    ``h`` is binary, a number, or an array of 64-bit words, of one length for all (256 bits are usual). Score: mutual
    nearest pairs closer than ``below`` bits, over the smaller descriptor count. Ties go to the lower ``idx``. Pairs of
    pictures without any have no row. Rows with a null are left out.

    Descriptors are numbered by picture and dealt into blocks of bounded size, so a picture with many lies in several.
    A task compares two blocks and keeps, for each descriptor and each picture of the other block, the nearest one that
    is close enough; a grouping merges these over blocks, and an equi-join finds those that are mutual.
    """
    work = work or Workspace(descriptors.sparkSession, "descriptors")
    fine = descriptors.where("image_id IS NOT NULL AND idx IS NOT NULL AND h IS NOT NULL").select(F.col("image_id").cast("long"), F.col("idx").cast("long"), "h")
    rows = with_order(fine, "image_id", "idx", work=work)
    blocks = max(1, -(-rows.count() // block_rows))

    def score(a, b, left, right):
        out = [np.empty(0, np.int64)] * 5
        if left.num_rows:
            sides = []
            for table in (left, right):
                table = table.sort_by([("image_id", "ascending"), ("idx", "ascending")])
                image = table["image_id"].to_numpy()
                sides.append((image, table["idx"].to_numpy(), _words(table["h"]), np.flatnonzero(np.diff(image, prepend=image[0] - 1))))
            (image, idx, words, starts), (other, other_idx, other_words, other_starts) = sides
            forward, backward = _nearest_in_groups(words, other_words, other_starts, starts)
            found = [(image[:, None], other[other_starts][None, :], idx, other_idx, forward, len(other))]
            if a != b:
                found.append((other[:, None], image[starts][None, :], other_idx, idx, backward.T, len(image)))
            parts = []
            for own, theirs, own_idx, their_idx, best, n in found:
                d, place = best // n, best % n
                r, c = np.nonzero((d < below) & (own != theirs))
                parts.append((own[r, 0], theirs[0, c], own_idx[r], their_idx[place[r, c]], d[r, c]))
            out = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return pa.table(dict(zip(("p", "q", "x", "y", "d"), out, strict=True)))

    close = block_pairs(rows.select("image_id", "idx", "h", "ord"), F.floor(F.col("ord") / block_rows), blocks, (), score, "p long, q long, x long, y long, d long")
    nearest = work.table(close.groupBy("p", "q", "x").agg(F.min(F.struct("d", "y")).alias("m")).select("p", "q", "x", "m.y"), "nearest")
    forward = nearest.where("p < q").select(F.col("p").alias("id1"), F.col("q").alias("id2"), "x", "y")
    backward = nearest.where("p > q").select(F.col("q").alias("id1"), F.col("p").alias("id2"), F.col("y").alias("x"), F.col("x").alias("y"))
    matches = forward.join(backward, ["id1", "id2", "x", "y"]).groupBy("id1", "id2").agg(F.count("*").alias("n"))
    counts = rows.groupBy("image_id").agg(F.count("*").alias("c"))
    scored = matches.join(counts.select(F.col("image_id").alias("id1"), F.col("c").alias("c1")), "id1").join(counts.select(F.col("image_id").alias("id2"), F.col("c").alias("c2")), "id2")
    return scored.select("id1", "id2", (F.col("n") / F.least("c1", "c2")).alias("score"))
