"""Token-id output: flat unsigned integer files plus 64-bit document offsets.

Layout under a folder, for shards 00000, 00001, ... that follow one another in document order:

- ``NNNNN.bin``: the ids of the shard's documents in a row, little-endian unsigned 16-bit integers, or 32-bit where
  the vocabulary needs them.
- ``NNNNN.idx``: little-endian signed 64-bit integers: the documents' starts as id counts over the whole output, and
  the shard's end; then as many document ids as there are starts; then a 0/1 null flag for each.

Shards come from a range partitioning by document id. A shard's place in the output is the sum of the id counts of the
shards before it: one number for each shard reaches the driver. Readers map the files into memory where the file system
is local, and read them otherwise.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import storage, tokens


def _narrow(raw: bytes) -> bytes:
    ids = np.frombuffer(raw, dtype="<u4")
    if len(ids) and ids.max() > 0xFFFF:
        raise ValueError("an id needs more than 16 bits: write wide files")
    return ids.astype("<u2").tobytes()


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int | None = 1, wide: bool = False) -> list[tuple[int, int, int, int]]:
    """Encode ``text`` of all rows and write it in ascending ``doc_id`` order (nulls first; equal ids by a hash of the text).

    Null and empty texts give ``end_id`` alone, or nothing if it is None. Repeated rows are each written. Other columns
    are ignored. Texts are whole, however long; a shard's ids are written text by text. Returns (shard, documents, ids, ids before the shard) for each shard; no shards for an empty table.
    """
    path = path or tokens.default_path()
    spark = docs.sparkSession
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    dtype = "<u4" if wide else "<u2"

    def write(batches):
        encode = tokens.encoder(path).encode
        shard = TaskContext.get().partitionId()
        lengths, ids, nulls = [], [], []

        def chunks():
            for batch in batches:
                numbers = batch.column(0)
                nulls.append(np.asarray(numbers.is_null()).astype("<i8"))
                ids.append(numbers.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for text in batch.column(1):
                    raw = encode(text.as_py()) + tail
                    lengths.append(len(raw) // 4)
                    yield raw if wide else _narrow(raw)

        first = next(stream := chunks(), None)
        if first is None and not lengths:
            return

        def all_chunks():
            yield first
            yield from stream

        storage.write_file(f"{out}/{shard:05d}.bin", all_chunks())
        local = np.concatenate([[0], np.cumsum(np.array(lengths, dtype="<i8"))]).astype("<i8")
        storage.write_file(f"{out}/{shard:05d}.local", [local.tobytes(), *(x.tobytes() for x in ids), *(x.tobytes() for x in nulls)])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(lengths)], "ids": [int(local[-1])]}, schema=counts)

    counts = pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tie"))
    placed = plain.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    found = placed.select("doc_id", "text").mapInArrow(write, "shard int, docs long, ids long").collect()
    shards, base = [], 0
    for row in sorted(found):
        shards.append((row["shard"], row["docs"], row["ids"], base))
        base += row["ids"]

    def index(batches):
        for batch in batches:
            for shard, n, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, name = storage.open_fs(f"{out}/{shard:05d}.local")
                with fs.open_input_file(name) as file:
                    raw = np.frombuffer(file.read(), dtype="<i8")
                storage.write_file(f"{out}/{shard:05d}.idx", [(raw[: n + 1] + start).tobytes(), raw[n + 1 :].tobytes()])
                fs.delete_file(name)
            yield batch.select(["shard"])

    if shards:
        _of_shards(spark, shards).select("shard", "docs", "base").mapInArrow(_once(index, out), "shard int").collect()
    return shards


def _once(index, out: str):
    """A task that runs again finds its index written and the local counts gone."""

    def run(batches):
        for batch in batches:
            shard = batch.column(0)[0].as_py()
            fs, name = storage.open_fs(f"{out}/{shard:05d}.idx")
            if fs.get_file_info(name).type == pafs.FileType.File:
                yield batch.select(["shard"])
            else:
                yield from index([batch])

    return run


def _of_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """One row for each shard, each in a task of its own."""
    rows = [(i, int(s), int(d), int(n), int(b)) for i, (s, d, n, b) in enumerate(shards)]
    df = spark.createDataFrame(rows, "place int, shard int, docs long, ids long, base long")
    return df.repartitionById(len(rows), F.col("place"))


def _mapped(uri: str):
    fs, path = storage.open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(path).read_buffer()
    with fs.open_input_file(path) as file:
        return file.read_buffer()


def read_tokens(spark: SparkSession, out: str, shards: list[tuple], wide: bool = False) -> DataFrame:
    """One row for each document in the files: ``doc_id, start, n_tokens, ids_crc32``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    dtype = "<u4" if wide else "<u2"

    def read(batches):
        for batch in batches:
            for shard, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = np.frombuffer(_mapped(f"{out}/{shard:05d}.idx"), dtype="<i8")
                ids = np.frombuffer(_mapped(f"{out}/{shard:05d}.bin"), dtype=dtype)
                starts, doc_ids, null = index[: n + 1], index[n + 1 : 2 * n + 1], index[2 * n + 1 :]
                for lo in range(0, n, 8192):
                    hi = min(n, lo + 8192)
                    local = starts[lo : hi + 1] - starts[0]
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(local[:-1], local[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[lo:hi], mask=null[lo:hi] != 0), pa.array(starts[lo:hi]), pa.array(np.diff(local)), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return _of_shards(spark, shards).select("shard", "docs").mapInArrow(read, schema)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = storage.Workspace(spark, "tokens").path
    return read_tokens(spark, out, write_tokens(docs, out))
