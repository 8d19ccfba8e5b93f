"""Pairs and groups kept between scans, so that a scan compares only what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.operators.components import connected_components
from twinsieve.operators.pairs import PAIRS, with_order
from twinsieve.plans.feature_store import KEY
from twinsieve.plans.registry import Method
from twinsieve.plans.workspace import Workspace

_FILES = "node long, path string, mtime double, size long"
_LABELS = "node long, root long"


class GroupStore:
    """The files, pairs and groups of the last scan for a method and threshold, as one version of three tables.

    A file keeps its number (``node``) as long as its key is the same. A scan numbers new files behind the others and
    compares them with all that are there, never old ones with old ones. Pairs of files that have gone or changed go.
    Groups are taken over where nothing happened to them. The others come out of a contraction of the new pairs, a star
    for each old group that they touch, and the old pairs of groups that have lost a file and may have fallen apart.

    A version is whole before its name is written; a scan that fails leaves the last one, and the next scan goes on from
    it. One scan at a time may write.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Files, new files and pairs compared by the last update.
        self.counts: dict[str, int] = {}

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _versions(self, name: str) -> list[str]:
        """Names of whole versions, the last one at the end."""
        fs, place = self._fs(self._folder(name))
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(n.removesuffix(".done") for n in names if n.endswith(".done"))

    def _read(self, name: str, table: str, schema: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self._folder(name)}/{versions[-1]}/{table}")

    def update(self, files: DataFrame, how: Method, method: str, threshold: float, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
        """``id1, id2, score`` and ``root, id`` of all files (``ord, path, mtime, size, f``), as a full scan gives them.

        Ids are ``ord``; a group's root is its smallest. Rows without a feature are in no pair.
        """
        name, work = f"{method}-{threshold}", work or Workspace(self.spark, "groups")
        known = self._read(name, "files", _FILES)
        present = work.table(files.select("ord", *KEY, "f").join(known, list(KEY), "left"), "present")
        offset = (known.agg(F.max("node")).first()[0] if self._versions(name) else None) or 0
        new = with_order(present.where("node IS NULL").select("path"), "path", work=work).select("path", (F.col("ord") + offset + 1).alias("_node"))
        all_files = present.join(new, "path", "left").withColumn("fresh", F.col("node").isNull()).withColumn("node", F.coalesce("node", "_node")).drop("_node")
        all_files = work.table(all_files, "all")
        here = all_files.select("node")
        made = how.join(all_files.select(F.col("node").alias("id"), "f", "fresh"), threshold, fresh="fresh")
        fresh_pairs = work.table(made, "fresh_pairs")
        old_pairs = self._read(name, "pairs", PAIRS)
        kept = work.table(old_pairs.join(here.withColumnRenamed("node", "id1"), "id1", "left_semi").join(here.withColumnRenamed("node", "id2"), "id2", "left_semi"), "kept")

        labels = self._read(name, "labels", _LABELS)
        hurt = labels.join(here, "node", "left_anti").select("root").distinct()
        whole = work.table(labels.join(hurt, "root", "left_anti"), "whole")
        ends = fresh_pairs.select(F.col("id1").alias("node")).unionByName(fresh_pairs.select(F.col("id2").alias("node"))).distinct()
        touched = work.table(whole.join(ends, "node").select("root").distinct(), "touched")
        stars = whole.join(touched, "root").where("node <> root").select(F.col("root").alias("id1"), F.col("node").alias("id2"))
        broken = labels.join(hurt, "root").select("node")
        inside = kept.join(broken.withColumnRenamed("node", "id1"), "id1", "left_semi").select("id1", "id2")
        edges = fresh_pairs.select("id1", "id2").unionByName(stars).unionByName(inside)
        merged = connected_components(edges, work).select("node", "root")
        now = whole.join(touched, "root", "left_anti").select("node", "root").unionByName(merged)

        pairs = kept.unionByName(fresh_pairs)
        self._write(name, {"files": all_files.select("node", *KEY), "pairs": pairs, "labels": now})
        self.counts = dict(zip(("files", "new"), all_files.agg(F.count(F.lit(1)), F.count_if("fresh")).first(), strict=True)) | {"fresh_pairs": fresh_pairs.count()}
        return self._numbered(name, all_files)

    def _write(self, name: str, tables: dict[str, DataFrame]) -> None:
        versions = self._versions(name)
        version = f"{(int(versions[-1].split('-')[0]) if versions else 0) + 1:08d}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self._folder(name)}/{version}/{table}")
        fs, done = self._fs(f"{self._folder(name)}/{version}.done")
        fs.create(done).close()
        for old in versions[:-1]:  # the one before stays for those who read it
            for path in (f"{old}.done", old):
                fs.delete(self._fs(f"{self._folder(name)}/{path}")[1], True)

    def _numbered(self, name: str, all_files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The version's pairs and groups with this scan's numbers."""
        number = all_files.select("node", "ord")
        a, b = (number.select(F.col("node").alias(f"id{i}"), F.col("ord").alias(f"o{i}")) for i in (1, 2))
        pairs = self._read(name, "pairs", PAIRS).join(a, "id1").join(b, "id2").select(F.least("o1", "o2").alias("id1"), F.greatest("o1", "o2").alias("id2"), "score")
        members = self._read(name, "labels", _LABELS).join(number, "node")
        least = members.groupBy("root").agg(F.min("ord").alias("first"))
        return pairs, members.join(least, "root").select(F.col("first").alias("root"), F.col("ord").alias("id"))
