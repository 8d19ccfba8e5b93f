"""Video operators over frame rows (``video_id, frame_idx, v``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import kernels
from twinsieve.operators import pairs as pair_ops
from twinsieve.plans.workspace import Workspace


def target_frames(duration: Column, rate: float = 1.0, least: int = 4, most: int = 32) -> Column:
    least = max(1, least)
    most = max(least, most)
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(duration * F.lit(float(rate))))).cast("int")


def keyframe_indices(total: Column, target: Column) -> Column:
    """All frames if there are no more than wanted, else evenly spaced ones; none for a video without frames."""
    evenly = F.transform(F.sequence(F.lit(0), target - 1), lambda i: F.least(F.floor(i * (total / target)).cast("int"), total.cast("int") - 1))
    every = F.sequence(F.lit(0), total.cast("int") - 1)
    return F.when(total <= 0, F.array().cast("array<int>")).when(target >= total, every).otherwise(evenly)


def duration_seconds(frames: Column, fps: Column) -> Column:
    return F.when((frames > 0) & (fps > 0), frames / fps).otherwise(0.0)


def flattened(videos: DataFrame) -> DataFrame:
    """One row a frame for ``video_id, frames`` (an array); videos without frames have none."""
    return videos.select("video_id", F.posexplode("frames").alias("frame_idx", "v"))


def average_resolution(videos: DataFrame) -> DataFrame:
    """One row: ``width, height``, cut means over the first three videos with a size; 1920x1080 without any."""
    first = videos.where("width > 0 AND height > 0").orderBy("ord").limit(3)
    return first.agg(*[F.coalesce(F.floor(F.avg(c)), F.lit(d)).cast("int").alias(c) for c, d in (("width", 1920), ("height", 1080))])


#: Frames that are scored at once, more or less, which a block has at least, and that a piece of a video holds; longer
#: videos are cut into pieces.
BLOCK_FRAMES, PIECE_FRAMES = 2048, 512
_BEST = "id1 long, id2 long, piece int, total double, frames long, best array<double>"
_BEST_ARROW = pa.schema([("id1", pa.int64()), ("id2", pa.int64()), ("piece", pa.int32()), ("total", pa.float64()), ("frames", pa.int64()), ("best", pa.list_(pa.float64()))])


class _Pieces:
    """Frames of a block in order, and where their pieces begin."""

    def __init__(self, table: pa.Table):
        ids, piece = table["video_id"].to_numpy(), table["piece"].to_numpy()
        change = (np.diff(ids) != 0) | (np.diff(piece) != 0)
        self.starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        self.ids, self.piece, self.pieces = ids[self.starts], piece[self.starts], table["pieces"].to_numpy()[self.starts]
        self.counts = np.diff(np.append(self.starts, len(ids)))
        self.v = kernels.unit(pair_ops._matrix(table["v"]).astype(np.float64))


def _tiles(table: pa.Table) -> list[_Pieces]:
    """A block's frames in tiles of whole pieces."""
    table = table.sort_by([(c, "ascending") for c in ("video_id", "piece", "frame_idx", "tie")])
    starts = np.append(_Pieces(table).starts, table.num_rows)
    cuts = [0]
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if end - cuts[-1] > BLOCK_FRAMES and begin > cuts[-1]:
            cuts.append(begin)
    return [_Pieces(table.slice(lo, hi - lo)) for lo, hi in zip(cuts, [*cuts[1:], table.num_rows], strict=True)]


class _Merged:
    """What the tiles of two blocks found; best scores with several pieces of a video are merged as they come."""

    def __init__(self):
        self.rows: list[dict] = []
        self.best: dict[tuple, np.ndarray] = {}

    def add(self, found: list[dict]) -> None:
        for row in found:
            if "best" not in row:
                self.rows.append(row)
                continue
            key = (row["id1"], row["id2"], row["piece"])
            self.best[key] = np.maximum(self.best[key], row["best"]) if key in self.best else row["best"]

    def table(self) -> pa.Table:
        merged = [{"id1": i, "id2": j, "piece": piece, "best": best} for (i, j, piece), best in self.best.items()]
        return pa.Table.from_pylist(self.rows + merged, schema=_BEST_ARROW)


def _merge_best(key, table):
    """The sum of the best scores of a piece's frames with all pieces of another video."""
    best = np.maximum.reduce(pair_ops._matrix(table["best"]))
    return pa.table({"id1": [key[0]], "id2": [key[1]], "total": [float(best.sum())], "frames": [len(best)]})



def _best_frames(own: _Pieces, other: _Pieces, best: np.ndarray, threshold: float) -> list[dict]:
    """What the pieces of ``own`` add to its videos' scores with larger ids; ``best`` is (own frames, other pieces)."""
    best = (np.clip(best, -1, 1) + 1) / 2
    totals = np.add.reduceat(best, own.starts, axis=0)
    less = own.ids[:, None] < other.ids
    whole = other.pieces[None, :] == 1
    settled = whole & (own.pieces == 1)[:, None]
    out = []
    for i, j in zip(*np.nonzero(less & whole & (~settled | (totals / own.counts[:, None] >= threshold))), strict=True):
        out.append({"id1": own.ids[i], "id2": other.ids[j], "total": totals[i, j], "frames": own.counts[i]})
    for i, j in zip(*np.nonzero(less & ~whole), strict=True):
        at = own.starts[i]
        out.append({"id1": own.ids[i], "id2": other.ids[j], "piece": own.piece[i], "best": best[at : at + own.counts[i], j]})
    return out


def mean_max_pairs(frames: DataFrame, threshold: float = 0.90, block_frames: int | None = None, piece_frames: int | None = None) -> DataFrame:
    """Pairs of videos by the mean, over the frames of the smaller id, of the best cosine score (0..1) with the other.

    Videos are dealt into blocks, long ones in pieces, and a task scores the frames of two blocks tile by tile. Where the
    other video is whole, a piece adds up its frames' best scores at once; where it is cut, the frames' best scores with
    each of its pieces are merged first, in the task and then between tasks. No task holds more than two blocks, whatever
    the length of a video; blocks grow with the table as those of ``pairs`` do, unless ``block_frames`` is given. Videos
    without frames take no part; null frames are left out.
    """
    piece_frames = piece_frames or PIECE_FRAMES
    fine = frames.where(F.col("video_id").isNotNull() & F.col("v").isNotNull())
    fine = fine.select(F.col("video_id").cast("long"), F.col("frame_idx").cast("long"), pair_ops.numbers_of(fine, "v").alias("v"))
    counts = fine.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    block_frames = block_frames or pair_ops.rows_in_block(total, 32 + pair_ops.vector_bytes(fine, "v"), BLOCK_FRAMES)
    blocks = max(1, -(-total // block_frames))
    pieces = F.ceil(F.col("n") / piece_frames).cast("int")
    tie = F.xxhash64("v")
    cut = fine.join(counts, "video_id").withColumns({"pieces": pieces, "tie": tie, "piece": F.pmod(F.xxhash64("frame_idx", tie), pieces).cast("int")}).drop("n")
    block = F.pmod(F.xxhash64("video_id", "piece"), F.lit(blocks))

    def score(a, b, left, right):
        if not left.num_rows:
            return _BEST_ARROW.empty_table()
        found, mine = _Merged(), _tiles(left)
        theirs = mine if a == b else _tiles(right)
        for i, x in enumerate(mine):
            for k, y in enumerate(theirs[i:] if a == b else theirs):
                similar = x.v @ y.v.T
                found.add(_best_frames(x, y, np.maximum.reduceat(similar, y.starts, axis=1), threshold))
                if a != b or k:
                    found.add(_best_frames(y, x, np.maximum.reduceat(similar, x.starts, axis=0).T, threshold))
        return found.table()

    found = Workspace(frames.sparkSession, "frames").table(pair_ops.block_pairs(cut, block, blocks, (), score, _BEST), "best")
    merged = found.where("best IS NOT NULL").groupBy("id1", "id2", "piece").applyInArrow(_merge_best, "id1 long, id2 long, total double, frames long")
    parts = found.where("best IS NULL").select("id1", "id2", "total", "frames").unionByName(merged)
    means = parts.groupBy("id1", "id2").agg((F.sum("total") / F.sum("frames")).alias("score"))
    return means.where(F.col("score") >= threshold)
