"""Blocks of pair joins grow with the table, so that what is sent does not grow with its square."""

import itertools

import numpy as np
import pytest

from twinsieve.functions import kernels
from twinsieve.operators import pairs, video


@pytest.fixture
def blocks(monkeypatch):
    """The number of blocks of each join, in the order of the joins."""
    seen, join = [], pairs.block_pairs
    monkeypatch.setattr(pairs, "block_pairs", lambda rows, block, blocks, *rest: seen.append(blocks) or join(rows, block, blocks, *rest))
    return seen


def test_rows_in_a_block():
    assert pairs.rows_in_block(100, 264) == pairs.BLOCK_ROWS
    assert [-(-n // pairs.rows_in_block(n, 264)) for n in (100_000, 600_000, 2_400_000)] == [24, 24, 24]
    assert pairs.rows_in_block(10**9, 264) == pairs.BLOCK_BYTES // 264


@pytest.mark.parametrize("kind", ["float", "double"])
def test_ten_times_the_rows_are_sent_as_often(spark, monkeypatch, blocks, kind):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 4)
    monkeypatch.setattr(pairs.rows_in_block, "__defaults__", (4,))
    v = np.random.default_rng(8).normal(size=(800, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"id long, f array<{kind}>")
    for n in (100, 800):
        score = kernels.cosine_score(v[:n].astype(np.float64), v[:n].astype(np.float64))
        want = {(i, j): score[i, j] for i, j in itertools.combinations(range(n), 2) if score[i, j] >= 0.8}
        assert {(r["id1"], r["id2"]): r["score"] for r in pairs.cosine_pairs(df.where(f"id < {n}"), 0.8).collect()} == pytest.approx(want) and want
    assert max(blocks) <= pairs.BLOCKS


def test_long_videos_are_merged_in_their_blocks(spark, monkeypatch, blocks):
    rng = np.random.default_rng(9)
    frames = [(int(i % 3), i, rng.normal(size=4).tolist()) for i in range(3000)]
    by = [np.array([v for i, _, v in frames if i == k]) for k in range(3)]
    want = {(a, b): kernels.mean_max(kernels.cosine_score(by[a], by[b])) for a, b in itertools.combinations(range(3), 2)}
    monkeypatch.setattr(video, "BLOCK_FRAMES", 50)
    df = spark.createDataFrame(frames, "video_id long, frame_idx long, v array<double>")
    found, table = [], video.Workspace.table
    monkeypatch.setattr(video.Workspace, "table", lambda self, rows, name: found.append(table(self, rows, name)) or found[-1])
    got = {(r["id1"], r["id2"]): r["score"] for r in video.mean_max_pairs(df, 0.0, piece_frames=10).collect()}
    assert got == pytest.approx(want)
    # Each of the 3 x 100 pieces has one list with a later video for each pair of blocks, not one for each of its pieces.
    assert blocks[0] <= pairs.BLOCKS and found[0].where("best IS NOT NULL").count() <= 300 * blocks[0]
