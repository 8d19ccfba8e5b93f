"""Reports of pairs and groups."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass

from pyarrow.fs import FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from twinsieve.functions import scalars
from twinsieve.sources import files


def report_rows(pairs: DataFrame) -> DataFrame:
    """``image1, image2, similarity`` (4 decimals), best first."""
    named = pairs.orderBy(F.desc("score"), "id1", "id2")
    return named.select(F.col("id1").alias("image1"), F.col("id2").alias("image2"), scalars.rounded(F.col("score"), 4).alias("similarity"))


def report_json(pairs: DataFrame, threshold: float, method: str) -> DataFrame:
    """One row, the report as JSON text. For reports that someone reads; ``write_report`` writes larger ones."""
    item = F.struct(F.col("id1").alias("image1"), F.col("id2").alias("image2"), scalars.rounded(F.col("score"), 4).alias("similarity"))
    listed = pairs.agg(F.count("*").alias("total_pairs"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("id1").alias("a"), F.col("id2").alias("b"), item.alias("item")))).alias("d"))
    return listed.select(F.to_json(F.struct(F.lit(threshold).alias("threshold"), F.lit(method).alias("method"), "total_pairs", F.transform("d", lambda x: x["item"]).alias("duplicates"))).alias("report"))


class JsonReport(DataSource):
    """A sink for a report's rows, sorted over the input's partitions: tasks write parts, one commit makes the file."""

    @classmethod
    def name(cls) -> str:
        return "twinsieve_report"

    def schema(self) -> str:
        return "image1 string, image2 string, similarity double"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], float(self.options["threshold"]), self.options["method"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    rows: int
    name: str


class ReportWriter(DataSourceWriter):
    """Parts lie beside the report under names of their attempt's own, so one that runs again disturbs nothing.

    The commit joins them, as bytes, in the order of the partitions, under a temporary name that is changed at the end.
    When a task fails for good, or the commit does, the parts go and an earlier report stays.
    """

    def __init__(self, path: str, threshold: float, method: str):
        self.path, self.threshold, self.method = path, threshold, method
        self.parts = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator) -> Part:
        number = TaskContext.get().partitionId()
        fs, folder = files.open_fs(self.parts)
        fs.create_dir(folder, recursive=True)
        name, rows = f"{number:08d}-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for row in iterator:
                item = json.dumps({"image1": row[0], "image2": row[1], "similarity": row[2]}, ensure_ascii=False)
                out.write(((",\n    " if rows else "\n    ") + item).encode())
                rows += 1
        return Part(number, rows, name)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number)
        fs, folder = files.open_fs(self.parts)
        _, path = files.open_fs(self.path)
        head = json.dumps({"threshold": self.threshold, "method": self.method, "total_pairs": sum(m.rows for m in parts)}, indent=2, ensure_ascii=False)
        try:
            with fs.open_output_stream(f"{folder}/whole", compression=None) as out:
                out.write((head[:-2] + ',\n  "duplicates": [').encode())
                for i, part in enumerate(parts):
                    out.write(b"," if i else b"")
                    with fs.open_input_stream(f"{folder}/{part.name}", compression=None) as source:
                        shutil.copyfileobj(source, out)
                out.write(b"\n  ]\n}\n" if parts else b"]\n}\n")
            fs.move(f"{folder}/whole", path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = files.open_fs(self.parts)
        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


def write_report(pairs: DataFrame, path: str, threshold: float, method: str) -> int:
    """Write the report as one JSON file, on any file system that Arrow knows; returns the number of pairs.

    Tasks format and write their rows; the driver joins their files and sees one message for each.
    """
    spark, path = pairs.sparkSession, path if "://" in path else os.path.abspath(path)
    spark.dataSource.register(JsonReport)
    fs, plain = files.open_fs(path)
    fs.create_dir(os.path.dirname(plain), recursive=True)
    seen = Observation("report")
    rows = report_rows(pairs.select(F.col("id1").cast("string"), F.col("id2").cast("string"), "score")).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.format(JsonReport.name()).mode("append").options(path=path, threshold=threshold, method=method).save()
    return seen.get["rows"]


def console_pairs(pairs: DataFrame) -> DataFrame:
    """``line``: the two files and their similarity."""
    return pairs.orderBy(F.desc("score"), "id1", "id2").select(F.concat_ws("  ", scalars.format_similarity(F.col("score")), F.col("id1").cast("string"), F.col("id2").cast("string")).alias("line"))


def result_items(members: DataFrame) -> DataFrame:
    """Members with the labels that a result shows."""
    m = members.withColumn("size_formatted", scalars.format_size(F.col("size"))).withColumn("resolution", scalars.resolution_label(F.col("width"), F.col("height")))
    if "duration" in members.columns:
        m = m.withColumn("duration_formatted", F.when(F.col("duration").isNotNull(), scalars.format_duration(F.col("duration")))).withColumn("duration", scalars.rounded(F.col("duration"), 1))
    return m
