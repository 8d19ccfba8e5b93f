"""Keyframes of videos, through a reader that the user brings: which frames, how they are read, and their features."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import closing
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.plans.models import BatchModel, batched

FRAMES = "video_id long, frame_idx int, v array<float>"
#: Frames that a model sees at a time.
FRAME_BATCH = 64


class FrameReader(Protocol):
    """An open video. ``read`` gives the next frame as BGR bytes (height, width, 3), or None where it can't."""

    fps: float
    frames: int

    def seek(self, index: int) -> None: ...

    def read(self) -> np.ndarray | None: ...

    def close(self) -> None: ...


Opener = Callable[[str], FrameReader]


def chosen_frames(total: int, fps: float, rate: float = 1.0, least: int = 4, most: int = 32) -> list[int]:
    """The frames to read: ``rate`` a second within limits, evenly spaced; all of them if there are no more."""
    if total <= 0 or fps <= 0:
        return []
    least = max(1, least)
    target = max(least, min(max(least, most), int(total / fps * rate)))
    if target >= total:
        return list(range(total))
    return [min(int(i * (total / target)), total - 1) for i in range(target)]


def reads_through(wanted: int, total: int) -> bool:
    """Whether reading through beats seeking: more than half of the frames are wanted."""
    return wanted / total > 0.5


def read_frames(reader: FrameReader, indices: list[int]) -> Iterator[np.ndarray]:
    """The frames at ascending indices. Reading through stops at the first failure; after a seek one is passed over."""
    if not indices:
        return
    if reads_through(len(indices), reader.frames):
        wanted = set(indices)
        for at in range(indices[-1] + 1):
            frame = reader.read()
            if frame is None:
                return
            if at in wanted:
                yield frame
    else:
        for at in indices:
            reader.seek(at)
            frame = reader.read()
            if frame is not None:
                yield frame


def keyframes_of(opener: Opener, path: str, rate: float = 1.0, least: int = 4, most: int = 32) -> Iterator[np.ndarray]:
    """A video's keyframes. One that can't be opened, or has no frames or no rate, has none; an error ends it."""
    try:
        reader = opener(path)
    except Exception:  # noqa: BLE001  a broken video is one without frames
        return
    with closing(reader):
        try:
            yield from read_frames(reader, chosen_frames(int(reader.frames), float(reader.fps), rate, least, most))
        except Exception:  # noqa: BLE001  what was read before stays
            return


def keyframe_features(media: DataFrame, opener: Opener, model: BatchModel, rate: float = 1.0, least: int = 4, most: int = 32, batch_rows: int = FRAME_BATCH) -> DataFrame:
    """``video_id, frame_idx, v``: the model's vectors of the keyframes of listed videos (``ord, path, media_type``).

    Videos are dealt over tasks one by one, as reading them is what takes long. Frames of several videos fill a batch
    together and are let go with it, so a task holds one batch of frames. Videos without frames have no rows; a frame
    that can't be prepared is a row of zeros. ``frame_idx`` counts a video's frames that were read.
    """

    def run(batches):
        def frames():
            for batch in batches:
                for ident, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for at, frame in enumerate(keyframes_of(opener, path, rate, least, most)):
                        yield (ident, at), frame

        for keys, vectors in batched(frames(), model, batch_rows):
            ids, places = zip(*keys, strict=True)
            flat = pa.array(vectors.ravel(), pa.float32())
            cuts = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.ListArray.from_arrays(cuts, flat)], names=["video_id", "frame_idx", "v"])

    videos = media.where((F.col("media_type") == "video") & F.col("path").isNotNull()).select("ord", "path")
    return videos.repartition(_tasks(media), "ord").mapInArrow(run, FRAMES)


def _tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
