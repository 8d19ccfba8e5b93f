"""Packed exchanges between parts of a table and blocks of hash values.

Rows are (key, origin, payload): payloads hold packed arrays, so a million hashes are one row to Spark. ``key`` is the
part or block that the row goes to, each of which is one task, and ``origin`` the one that it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "key int, origin int, payload binary"
NULL_ID = np.iinfo(np.int64).min


def payload_rows(batches) -> dict[int, list[tuple[int, bytes]]]:
    """The (origin, payload) of Arrow batches by key."""
    found: dict[int, list] = {}
    for batch in batches:
        for key, origin, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found.setdefault(key, []).append((origin, payload))
    return found


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "origin", "payload"])


def pack(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays of plain numbers as compressed bytes, with their kinds and lengths."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    raw = len(head).to_bytes(4, "little") + head + b"".join([a.tobytes() for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = pa.decompress(payload[8:], decompressed_size=int.from_bytes(payload[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    found = []
    for kind in raw[4:at].decode().split(","):
        found.append(np.frombuffer(raw, kind[:3], int(kind[3:]), at))
        at += found[-1].nbytes
    return found


def gathered(payloads: list[bytes], columns: int) -> list[np.ndarray]:
    """The columns of several packed payloads, one after another; none of them gives empty columns."""
    parts = [unpack(p) for p in payloads]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(columns)]


def split(blocks: np.ndarray, count: int):
    """(block, indices) for each block that occurs."""
    order = np.argsort(blocks, kind="stable")
    cuts = np.searchsorted(blocks[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h % np.uint64(blocks)).astype(np.int64)


def short_key(h: np.ndarray, blocks: int) -> np.ndarray:
    """What the exchange keeps of a hash: its block and its upper 32 bits."""
    return (h & ~np.uint64(0xFFFFFFFF)) | (h % np.uint64(blocks))


def blocks_for(df: DataFrame) -> int:
    """How many blocks of hashes: as many as shuffle partitions or input parts, so blocks don't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def marks(spark: SparkSession, parts: int) -> DataFrame:
    """A row for each part, so that parts to which nothing is sent have their task too."""
    return spark.range(parts).select(F.col("id").cast("int").alias("key"), F.lit(-1).alias("origin"), F.lit(b"").alias("payload"))


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    column = column.fill_null(b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def send_hashes(h: np.ndarray, owners: np.ndarray, origin: int, blocks: int) -> pa.RecordBatch:
    """The distinct hashes of a part, each with a flag that several owners have it, as rows for the blocks."""
    order = np.lexsort((owners, h))
    h, owners = h[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    several, h = owners[first] != owners[last], h[first]
    rows = []
    for b, at in split(block_of(h, blocks), blocks):
        rows.append((b, origin, len(at).to_bytes(4, "little") + (h[at] >> np.uint64(32)).astype("<u4").tobytes() + np.packbits(several[at]).tobytes()))
    return batch_of(rows)


def shared_hashes(batches):
    """Answers to ``send_hashes``: for each part, which of its hashes others, or several owners of its own, have."""
    for key, rows in payload_rows(batches).items():
        lists, flags = [], []
        for _, payload in rows:
            n = int.from_bytes(payload[:4], "little")
            lists.append(np.frombuffer(payload, "<u4", n, 4))
            flags.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=4 + 4 * n), count=n).astype(bool))
        values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        wanted = np.zeros(len(values), bool)
        wanted[inverse[(counts[inverse] > 1) | np.concatenate(flags)]] = True
        at = 0
        for (origin, _), own in zip(rows, lists, strict=True):
            mine = own[wanted[inverse[at : at + len(own)]]]
            at += len(own)
            if len(mine):
                yield batch_of([(origin, key, mine.astype("<u4").tobytes())])


def known_keys(rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The sorted short keys that ``shared_hashes`` answered with."""
    found = [(np.frombuffer(payload, "<u4").astype(np.uint64) << np.uint64(32)) | np.uint64(b) for b, payload in rows if b >= 0]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values
