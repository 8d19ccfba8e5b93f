"""Models that take pictures by the batch: loaded once a worker, fed whole batches, rows kept in line."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np

from twinsieve.functions import kernels

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class BatchModel:
    """How pictures become vectors: ``load`` makes the model, ``prepare`` its input from BGR pictures of any size."""

    load: Callable[[], Predict]
    width: int = 2048
    prepare: Callable[[list[np.ndarray]], np.ndarray] = kernels.network_input
    batch_rows: int = 128
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


#: This worker's model; another one takes its place, so that a worker holds one at a time.
_LOADED: dict[str, Predict] = {}


def loaded(model: BatchModel) -> Predict:
    if model.key not in _LOADED:
        _LOADED.clear()
        _LOADED[model.key] = model.load()
    return _LOADED[model.key]


#: Raw pictures that wait to be prepared hold this many bytes at most, or are a single one.
RAW_BYTES = 64 << 20


class _Batch:
    """Rows and the different pictures among them, prepared as they come."""

    def __init__(self, model: BatchModel):
        self.model = model
        self.keys, self.slots, self.known = [], [], {}
        self.raw, self.raw_bytes, self.inputs, self.fine, self.count = [], 0, [], [], 0

    def slot_of(self, picture: np.ndarray) -> int | None:
        return self.known.get(_name(picture))

    def add(self, key, picture: np.ndarray | None) -> None:
        slot = -1  # the row of zeros
        if picture is not None:
            slot = self.known.setdefault(_name(picture), self.count)
            if slot == self.count:
                self.count += 1
                self.raw.append(picture)
                self.raw_bytes += picture.nbytes
                if self.raw_bytes >= RAW_BYTES:
                    self.prepare()
        self.keys.append(key)
        self.slots.append(slot)

    def prepare(self) -> None:
        """Turn what waits into input; a picture that can't be prepared is left out."""
        first = self.count - len(self.raw)
        try:
            if self.raw:
                self.inputs.append(self.model.prepare(self.raw))
                self.fine += range(first, self.count)
        except Exception:  # noqa: BLE001  one of them is broken: find out which
            for i, picture in enumerate(self.raw):
                try:
                    self.inputs.append(self.model.prepare([picture]))
                    self.fine.append(first + i)
                except Exception:  # noqa: BLE001
                    continue
        self.raw, self.raw_bytes = [], 0

    def vectors(self) -> np.ndarray:
        self.prepare()
        out = np.zeros((self.count + 1, self.model.width), np.float32)
        if self.fine:
            found = np.asarray(loaded(self.model)(np.concatenate(self.inputs)), np.float32)
            if found.shape != (len(self.fine), self.model.width):
                raise ValueError(f"the model gave {found.shape} for {len(self.fine)} pictures, {self.model.width} numbers each were expected")
            out[self.fine] = found
        return out[self.slots]


def _name(picture: np.ndarray) -> tuple:
    return picture.shape, blake2b(np.ascontiguousarray(picture).data, digest_size=16).digest()


def batched(rows: Iterable[tuple[object, np.ndarray | None]], model: BatchModel, batch_rows: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """(keys, vectors) of (key, picture) rows, in their order.

    The model sees ``batch_rows`` different pictures at a time, however the rows arrive; only the last batch is smaller,
    or one that many repeats fill. A picture that repeats within a batch is computed once. Missing and broken pictures
    are rows of zeros. Pictures are prepared as they come, so that large ones don't pile up.
    """
    most, batch = batch_rows or model.batch_rows, _Batch(model)
    for key, picture in rows:
        if batch.keys and (len(batch.keys) >= 32 * most or (picture is not None and batch.count == most and batch.slot_of(picture) is None)):
            yield batch.keys, batch.vectors()
            batch = _Batch(model)
        batch.add(key, picture)
    if batch.keys:
        yield batch.keys, batch.vectors()
