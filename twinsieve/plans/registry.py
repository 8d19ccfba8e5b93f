"""Comparison methods: how a picture becomes a feature, and how features are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import kernels
from twinsieve.operators import pairs
from twinsieve.plans.models import BatchModel, Predict, batched


@dataclass(frozen=True)
class Method:
    extract: Callable[[np.ndarray], object] | None  # a BGR picture to a feature; None with a model
    feature: str  # Spark type of the feature
    join: Callable[..., DataFrame]  # (features, threshold, **options) to pairs
    model: BatchModel | None = None  # turns batches of pictures to vectors


def _ssim_join(features: DataFrame, threshold: float, **options) -> DataFrame:
    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return kernels.ssim_scores(*(v.astype(np.uint8).reshape(-1, 256, 256, 3) for v in (a, b)))

    return pairs.blocked_pairs(features, score, threshold, **({"block_rows": 32} | options))


def _orb_join(features: DataFrame, threshold: float, **options) -> DataFrame:
    """Pairs by mutual nearest descriptors; at a threshold of 0 and below also those that have none.

    With ``fresh`` all pictures are compared and pairs without a fresh one left out.
    """
    if fresh := options.pop("fresh", None):
        found = _orb_join(features, threshold, **options)
        new = features.where(fresh).select("id")
        either = [found.join(new.withColumnRenamed("id", end), end, "left_semi") for end in ("id1", "id2")]
        return either[0].unionByName(either[1]).distinct()
    places = F.sequence(F.lit(0), F.floor(F.length("f") / 32).cast("int") - 1)
    cut = F.transform(F.when(F.length("f") > 0, places), lambda i: F.substring(F.col("f"), i * 32 + 1, F.lit(32)))
    found = pairs.descriptor_pairs(features.select(F.col("id").alias("image_id"), F.posexplode(cut).alias("idx", "h")), **options)
    if threshold > 0:
        return found.where(F.col("score") >= threshold)
    every = pairs.blocked_pairs(features.where("f IS NOT NULL").select("id", F.lit(0.0).alias("f")), lambda a, b: np.zeros((len(a), len(b))), threshold)
    return every.unionByName(found).groupBy("id1", "id2").agg(F.max("score").alias("score"))


def thumbnail_vector(bgr: np.ndarray) -> np.ndarray:
    """A plain stand-in for a network's features: the picture at 16x16, centred. It is not a network, and not as good."""
    v = kernels.resize(bgr, 16, 16).astype(np.float64).ravel()
    return v - v.mean()


METHODS: dict[str, Method] = {
    **{m: Method(lambda bgr, m=m: kernels.image_hash(bgr, m), "bigint", pairs.hash_pairs) for m in ("phash", "dhash", "ahash", "whash")},
    "histogram": Method(lambda bgr: kernels.colour_histogram(bgr).tolist(), "array<double>", pairs.histogram_pairs),
    "ssim": Method(lambda bgr: kernels.resize(bgr, 256, 256).ravel().astype(np.int16).tolist(), "array<smallint>", _ssim_join),
    "orb": Method(lambda bgr: kernels.key_points(kernels.gray(kernels.resize(bgr, 512, 512)))[1].tobytes(), "binary", _orb_join),
    "gpu": Method(lambda bgr: thumbnail_vector(bgr).tolist(), "array<double>", pairs.cosine_pairs),
}


def register_method(name: str, extract: Callable[[np.ndarray], object], feature: str, join: Callable[..., DataFrame]) -> None:
    """Add or replace a method that takes one picture at a time."""
    METHODS[name] = Method(extract, feature, join)


def register_model(
    name: str,
    load: Callable[[], Predict],
    width: int = 2048,
    prepare: Callable[[list[np.ndarray]], np.ndarray] = kernels.network_input,
    batch_rows: int = 128,
    join: Callable[..., DataFrame] = pairs.cosine_pairs,
) -> None:
    """Add or replace a method whose features a network gives, for example ``gpu``.

    ``load`` is called once in each Python worker and returns a function from a batch of input (n, 3, 224, 224), or what
    ``prepare`` makes of the pictures, to n vectors of ``width`` numbers.
    """
    METHODS[name] = Method(None, "array<float>", join, BatchModel(load, width, prepare, batch_rows))


def vector_model(name: str) -> BatchModel:
    """A method's model, or its extractor as a model of one picture after another; its features have to be vectors."""
    how = method(name)
    if how.model is not None:
        return how.model
    if not how.feature.startswith("array<"):
        raise ValueError(f"features of {name} are not vectors")
    extract = how.extract
    width = len(extract(np.zeros((64, 64, 3), np.uint8)))
    return BatchModel(lambda: np.asarray, width, lambda pictures: np.stack([np.asarray(extract(p), np.float32) for p in pictures]), key=f"extract-{name}")


def method(name: str) -> Method:
    if name not in METHODS:
        raise ValueError(f"unknown method: {name}")
    return METHODS[name]


def as_bgr(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., :3]


_ARROW = {"bigint": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<smallint>": pa.list_(pa.int16()), "binary": pa.binary()}


def _pictures(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray | None]]:
    """What is kept of a row, and its picture; the first four columns are the picture's."""
    for batch in batches:
        for i in range(len(batch)):
            data, height, width, channels, *kept = (column[i].as_py() for column in batch.columns)
            try:
                yield tuple(kept), as_bgr(data, height, width, channels) if data else None
            except ValueError:  # fewer bytes than the size says
                yield tuple(kept), None


def features(images: DataFrame, name: str, id_col: str = "ord", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, f`` and the columns in ``keep`` (not data) for decoded images.

    Where there is no picture, or it can't be taken, the feature is null with an extractor and zeros with a model, whose
    batches are of a set size and loaded once a worker.
    """
    how = method(name)
    kind = _ARROW[how.feature]

    def one_by_one(batches):
        for batch in batches:
            out = []
            for _, picture in _pictures([batch]):
                try:
                    out.append(how.extract(picture) if picture is not None else None)
                except (ValueError, IndexError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(out, kind)], names=names)

    def by_batches(batches):
        kinds: list[pa.DataType] = []

        def seen():
            for batch in batches:
                kinds[:] = [column.type for column in batch.columns[4:]]
                yield batch

        for kept, vectors in batched(_pictures(seen()), how.model):
            cuts = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1]), pa.int32())
            columns = [pa.array(column, kinds[i]) for i, column in enumerate(zip(*kept, strict=True))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cuts, pa.array(vectors.ravel(), pa.float32()))], names=names)

    own = images.select(F.col(id_col).alias("id"), *keep)
    names = [*own.columns, "f"]
    shape = T.StructType([*own.schema.fields, *T.StructType.fromDDL(f"f {how.feature}").fields])
    plain = images.select("data", "height", "width", "channels", F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    found = plain.mapInArrow(by_batches if how.model is not None else one_by_one, shape)
    return found.select("id", "f", *keep)
