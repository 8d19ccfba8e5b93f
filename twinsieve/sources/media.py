"""Media files: listing, decoding, metadata, and the blocklist file."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.functions import scalars
from twinsieve.operators import video
from twinsieve.operators.pairs import with_order
from twinsieve.plans.workspace import Workspace
from twinsieve.sources import containers, files
from twinsieve.sources.listing import list_files

def list_media(spark: SparkSession, folders: str | list[str], recursive: bool = True, kind: str | None = None, work: Workspace | None = None) -> DataFrame:
    """``path, name, ext, media_type, size, mtime, ctime, ord`` of the media files below some folders.

    Tasks list the files (``listing``). Of several listings of one absolute path the first counts. ``ord`` numbers the
    files in path order within the folders' order. ``kind`` is image or video; both by default.
    """
    folders = [folders] if isinstance(folders, str) else list(folders)
    return media_of(list_files(spark, folders, recursive), kind, work)


def media_of(files: DataFrame, kind: str | None = None, work: Workspace | None = None) -> DataFrame:
    """Media among listed files (``folder, path, name, size, mtime, ctime``), first listings only, numbered."""
    typed = files.withColumn("ext", scalars.extension(F.col("name"))).withColumn("media_type", scalars.media_type(F.col("name")))
    typed = typed.where(F.col("media_type") == kind if kind else F.col("media_type").isNotNull())
    return with_order(first_by_path(typed), "folder", "path", work=work).drop("folder")


def first_by_path(files: DataFrame, order: str = "folder") -> DataFrame:
    """One row for each absolute path, the first in order."""

    def absolute(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: os.path.normcase(os.path.abspath(p)))

    first = Window.partitionBy(F.pandas_udf(absolute, T.StringType())("path")).orderBy(order)
    return files.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def plain_path(origin):
    """A path without scheme and URI escapes: the image source gives file:///a%20b.png, binaryFile file:/a b.png."""

    def plain(values: pd.Series) -> pd.Series:
        return values.map(lambda s: unquote(urlparse(s).path) if s.startswith("file:///") else s.removeprefix("file:"))

    return F.pandas_udf(plain, T.StringType())(origin)


#: So many files are named to Spark one by one; of more, the folders are named and what isn't asked for is passed over.
NAMED_FILES = 10_000
_PICTURES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in ext[1:]) for ext in scalars.IMAGE_EXTENSIONS) + "}"


def _escaped(path: str) -> str:
    """A path whose characters a file source doesn't take for a pattern."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def _copied(hidden: DataFrame, folder: str) -> DataFrame:
    """``shown, path``: copies, under plain names, of files with a hidden name, in the shared folder."""

    def run(batches):
        fs, target = files.open_fs(folder)
        fs.create_dir(target, recursive=True)
        for batch in batches:
            shown = []
            for path in batch.column(0).to_pylist():
                name = f"{uuid.uuid4().hex}{os.path.splitext(path)[1]}"
                with files.open_seekable(path) as source, fs.open_output_stream(f"{target}/{name}", compression=None) as out:
                    shutil.copyfileobj(source, out)
                shown.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), batch.column(0)], names=["shown", "path"])

    return hidden.mapInArrow(run, "shown string, path string")


def decode_images(spark: SparkSession, media: DataFrame, folders: list[str] | None = None, work: Workspace | None = None) -> DataFrame:
    """``path, width, height, channels, data`` for listed images; data is BGR rows, null where a file can't be decoded.

    Spark's image source decodes what the JVM can (JPEG, PNG, BMP, GIF); other formats come out with 0x0. ``folders``
    are those that the files lie below: with many files they are read as a whole, so that no list of paths is made.
    Files with a hidden name, which Spark passes over, are copied to the shared folder under plain ones.
    """
    asked = media.where("media_type = 'image'").select("path")
    hidden = F.col("path").rlike(r"(^|/)[._][^/]*")
    named = [r["path"] for r in asked.where(~hidden).limit(NAMED_FILES + 1).collect()]
    found = []
    if len(named) > NAMED_FILES and folders:
        there = [_escaped(os.path.abspath(f)) for f in folders if os.path.isdir(f)]
        every = _decoded(spark.read.format("image").options(dropInvalid=False, recursiveFileLookup=True, pathGlobFilter=_PICTURES).load(there), plain_path)
        found.append(every.dropDuplicates(["path"]).join(asked.where(~hidden), "path", "left_semi"))
    elif named:
        named = named if len(named) <= NAMED_FILES else [r["path"] for r in asked.where(~hidden).collect()]
        found.append(_decoded(spark.read.format("image").option("dropInvalid", False).load([_escaped(p) for p in named]), plain_path))
    if not asked.where(hidden).isEmpty():
        work = work or Workspace(spark, "images")
        copies = work.table(_copied(asked.where(hidden), f"{work.path}/shown"), "copies")
        shown = _decoded(spark.read.format("image").option("dropInvalid", False).load(f"{work.path}/shown"), lambda origin: F.element_at(F.split(origin, "/"), -1))
        found.append(copies.join(shown.withColumnRenamed("path", "shown"), "shown").drop("shown"))
    if not found:
        return spark.createDataFrame([], "path string, width int, height int, channels int, data binary")
    return reduce(DataFrame.unionByName, found)


def decode_bytes(rows: DataFrame, work: Workspace, id_col: str = "id") -> DataFrame:
    """``<id_col>, width, height, channels, data`` for encoded pictures in memory (``<id_col>``, ``content``).

    Pictures pass through files in the shared folder, which Spark's image source decodes; ids come out as text.
    """
    folder = f"{work.path}/bytes"

    def run(batches):
        fs, target = files.open_fs(folder)
        fs.create_dir(target, recursive=True)
        for batch in batches:
            shown = []
            for content in batch.column(1).to_pylist():
                shown.append(f"{uuid.uuid4().hex}.png")  # the decoder looks at the bytes, not at the name
                with fs.open_output_stream(f"{target}/{shown[-1]}", compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), batch.column(0)], names=["shown", "id"])

    named = work.table(rows.select(F.col(id_col).cast("string").alias("id"), "content").mapInArrow(run, "shown string, id string"), "named")
    images = rows.sparkSession.read.format("image").option("dropInvalid", False).load(folder)
    decoded = _decoded(images, lambda origin: F.element_at(F.split(origin, "/"), -1)).withColumnRenamed("path", "shown")
    return named.join(decoded, "shown").select(F.col("id").alias(id_col), "width", "height", "channels", "data")


def _decoded(images: DataFrame, path) -> DataFrame:
    i, fine = F.col("image"), F.col("image.height") > 0
    return images.select(
        path(i["origin"]).alias("path"), F.when(fine, i["width"]).otherwise(0).alias("width"), F.when(fine, i["height"]).otherwise(0).alias("height"),
        F.when(fine, i["nChannels"]).otherwise(0).alias("channels"), F.when(fine, i["data"]).alias("data"),
    )


def image_metadata(media: DataFrame, images: DataFrame) -> DataFrame:
    """``path, width, height, size``: sizes in bytes are the listing's; pixels are 0x0 where decoding fails."""
    known = images.select("path", "width", "height")
    return media.where("media_type = 'image'").join(known, "path", "left").select("path", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "size")


def video_metadata(media: DataFrame) -> DataFrame:
    """``path, width, height, fps, frames, duration, size`` of listed videos, from their containers' headers.

    Tasks read the headers alone. Containers that aren't known, and headers that are broken, give zeros; the size in
    bytes is the listing's. The duration is frames by frame rate, 0 where either is missing.
    """

    def run(batches):
        for batch in batches:
            found = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with files.open_seekable(path) as file:
                        found.append(containers.video_info(file, size or 0))
                except OSError:
                    found.append(containers.VideoInfo())
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int64())
            columns = [pa.array([info[i] for info in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(1)], names=["path", "width", "height", "fps", "frames", "size"])

    videos = media.where("media_type = 'video'").select("path", "size")
    known = videos.mapInArrow(run, "path string, width int, height int, fps double, frames long, size long")
    return known.withColumn("duration", video.duration_seconds(F.col("frames"), F.col("fps")))


Decoder = Callable[[str], Iterable[tuple[int, list[float]]]]


def decode_frames(media: DataFrame, decoder: Decoder) -> DataFrame:
    """``video_id, frame_idx, v`` for videos, with a decoder that yields (index, vector) for a path.

    For vectors that are had elsewhere; pictures of frames go through ``keyframes``. A decoder that raises gives no
    frames for that video.
    """

    def run(batches):
        for pdf in batches:
            for ident, path in zip(pdf["ord"], pdf["path"], strict=True):
                try:
                    rows = [(ident, k, v) for k, v in decoder(path)]
                except Exception:  # noqa: BLE001  a broken video is one without frames
                    rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "v"])

    shape = T.StructType([T.StructField("video_id", T.LongType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])
    return media.where("media_type = 'video'").select("ord", "path").mapInPandas(run, shape)


ENTRIES = "entry_id long, paths array<string>, timestamp double"


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """``entry_id, paths, timestamp`` of a blocklist file; none where the file is missing or broken."""
    return spark.createDataFrame([(i, e["paths"], e["timestamp"]) for i, e in enumerate(read_blocklist(path))], ENTRIES)


def read_blocklist(path: str) -> list[dict]:
    try:
        with open(path, encoding="utf-8") as file:
            listed = json.load(file).get("blocklist", [])
        return [{"paths": [str(p) for p in e["paths"]], "timestamp": float(e.get("timestamp", 0.0))} for e in listed]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return []


def save_blocklist(path: str, entries: list[dict]) -> None:
    """Replace the file in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as file:
        json.dump({"version": 1, "blocklist": entries}, file, ensure_ascii=False, indent=2)
    os.replace(file.name, path)
