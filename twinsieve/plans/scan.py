"""The whole query: files to features, pairs, groups, keepers, plan and report."""

from __future__ import annotations

import errno
import hashlib
import os
import shutil
import warnings
from collections.abc import Callable

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinsieve.config import ScanConfig
from twinsieve.operators import blocklist, groups, video
from twinsieve.operators.pairs import ordered
from twinsieve.plans import registry, report
from twinsieve.plans.control import Cancelled, Phases, Progress, Run
from twinsieve.plans.feature_store import KEY, FeatureStore
from twinsieve.plans.group_store import GroupStore
from twinsieve.plans.workspace import Workspace
from twinsieve.sources import files
from twinsieve.sources import media as media_source
from twinsieve.sources.keyframes import Opener, keyframe_features

NO_PAIRS = "id1 long, id2 long, score double"


class DuplicateScan:
    """Find, group and resolve near duplicates below some folders.

    ``opener`` opens videos for reading frames (``sources.keyframes``), whose features are those of the configured video
    method; ``decoder`` gives frame vectors directly instead. Without either, videos are listed and measured, not
    compared. With a ``store``, files whose features it has are not decoded again; with a ``group_store``, images that
    it knows are not compared with one another again. All jobs run under ``run``: cancelling
    it from another thread ends the scan with ``Cancelled`` and removes its tables; ``progress`` is told of the phases.
    """

    def __init__(
        self,
        spark: SparkSession,
        config: ScanConfig,
        decoder: media_source.Decoder | None = None,
        opener: Opener | None = None,
        store: FeatureStore | None = None,
        group_store: GroupStore | None = None,
        run: Run | None = None,
        progress: Callable[[Progress], None] | None = None,
    ):
        registry.method(config.method)
        self.spark, self.config, self.decoder, self.opener = spark, config, decoder, opener
        self.store, self.group_store = store, group_store
        self.run, self.phases = run or Run(spark), Phases(progress)
        self.work = Workspace(spark, "scan")
        #: Rows of each stage, and how many of them failed.
        self.counts: dict[str, dict[str, int]] = {}
        self._tables: dict[str, DataFrame] = {}
        if config.video_enabled:
            if opener is not None:
                registry.vector_model(config.video_method)
            elif decoder is None:
                warnings.warn("videos are not compared without a reader of frames", stacklevel=2)

    def __enter__(self) -> DuplicateScan:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove the scan's tables."""
        self._tables.clear()
        self.work.drop()

    def _once(self, name: str, make: Callable[[], DataFrame], phase: str | None = None, failed=None) -> DataFrame:
        """A stage is computed once and written: features in particular are never computed below a pair join."""
        if name not in self._tables:

            def write() -> DataFrame:
                seen = Observation(name)
                counted = [F.count(F.lit(1)).alias("rows"), F.count_if(failed if failed is not None else F.lit(False)).alias("failed")]
                table = self.work.table(make().observe(seen, *counted), name)
                self.counts[name] = dict(seen.get)
                return table

            try:
                self._tables[name] = self.run(write, self.phases.watcher(phase) if phase else None)
            except Cancelled:
                self.close()
                raise
        return self._tables[name]

    def media(self) -> DataFrame:
        """All media files with ``ord``; videos carry what their headers say."""

        def listed() -> DataFrame:
            found = media_source.list_media(self.spark, list(self.config.folders), self.config.recursive, work=self.work)
            known = media_source.video_metadata(found).drop("size")
            return found.join(known, "path", "left")

        table = self._once("media", listed)
        self.phases.total = self.counts["media"]["rows"]
        return table

    def _extracted(self, media: DataFrame, method: str) -> DataFrame:
        images = media_source.decode_images(self.spark, media, list(self.config.folders) if self.config.recursive else None, self.work)
        return registry.features(images, method, "path", ("width", "height")).withColumnRenamed("id", "path")

    def features(self, method: str | None = None) -> DataFrame:
        """``id, f, width, height`` of images; pictures are decoded once for both and never written."""
        method = method or self.config.method

        def made() -> DataFrame:
            pictures = self.media().where("media_type = 'image'").drop("width", "height")
            if self.store is not None:
                return self.store.features(pictures, method, lambda new: self._extracted(new, method))
            return pictures.select("path", F.col("ord").alias("id")).join(self._extracted(pictures, method), "path").select("id", "f", "width", "height")

        return self._once(f"features_{method}", made, "features", F.col("height") <= 0)

    def find_duplicates(self, method: str | None = None, threshold: float | None = None) -> DataFrame:
        """``id1, id2, score`` of images, ids being ``ord``, best first."""
        return ordered(self._image_pairs(method, threshold))

    def _image_pairs(self, method: str | None = None, threshold: float | None = None) -> DataFrame:
        method = method or self.config.method
        threshold = self.config.threshold if threshold is None else threshold
        features = self.features(method)
        if self.group_store is not None:
            return self._stored_groups(method, threshold)[0]
        return self._once(f"pairs_{method}_{threshold}", lambda: registry.method(method).join(features.select("id", "f"), threshold), "pairs")

    def _stored_groups(self, method: str, threshold: float) -> tuple[DataFrame, DataFrame]:
        """Pairs and groups of images, from the store and what is new."""
        names = [f"{kind}_{method}_{threshold}" for kind in ("pairs", "groups")]
        if names[0] not in self._tables:
            keys = self.media().select("ord", *KEY)
            known = self.features(method).select(F.col("id").alias("ord"), "f").join(keys, "ord")
            found: list[DataFrame] = []

            def pairs() -> DataFrame:
                found.extend(self.group_store.update(known, registry.method(method), method, threshold, self.work))
                return found[0]

            self._once(names[0], pairs, "pairs")
            self._once(names[1], lambda: found[1])
        return self._tables[names[0]], self._tables[names[1]]

    def frames(self) -> DataFrame:
        """``video_id, frame_idx, v`` of the videos' keyframes."""
        c, media = self.config, self.media()
        least, most = c.frames()
        if self.opener is not None:
            return self._once("frames", lambda: keyframe_features(media, self.opener, registry.vector_model(c.video_method), c.video_fps, least, most), "frames")
        return self._once("frames", lambda: media_source.decode_frames(media, self.decoder), "frames")

    def find_video_duplicates(self) -> DataFrame:
        """``id1, id2, score`` of videos; none where videos aren't asked for or there is no reader."""
        if not self.config.video_enabled or (self.decoder is None and self.opener is None):
            return self.spark.createDataFrame([], NO_PAIRS)
        frames = self.frames()
        return self._once("video_pairs", lambda: video.mean_max_pairs(frames, self.config.video_threshold), "pairs")

    find_video_duplicates_large = find_video_duplicates

    def members(self, entries: DataFrame | None = None) -> DataFrame:
        """Members of all groups with metadata; images and videos never meet. Blocked groups are left out.

        Groups and entries are compared by their files' absolute paths without links.
        """
        pictures, films = self._image_pairs(), self.find_video_duplicates()

        def members() -> DataFrame:
            if self.group_store is None:
                return groups.group_members(pictures.unionByName(films), self.work)
            return self._stored_groups(self.config.method, self.config.threshold)[1].unionByName(groups.group_members(films, self.work))

        found = self._once("members", members).withColumnRenamed("id", "ord")
        sizes = self.features().select(F.col("id").alias("ord"), F.col("width").alias("w"), F.col("height").alias("h"))
        known = self.media().join(sizes, "ord", "left").withColumns({"width": F.coalesce("w", "width", F.lit(0)), "height": F.coalesce("h", "height", F.lit(0))}).drop("w", "h")
        found = found.join(known, "ord").withColumn("type", F.col("media_type")).withColumn("id", F.col("ord"))
        if entries is not None:
            listed = blocklist.path_rows(blocklist.resolved(entries.select("entry_id", "paths")), "entry_id")
            blocked = blocklist.blocked_keys(blocklist.resolved_rows(found.select("root", "path")), listed)
            found = found.join(blocked, "root", "left_anti")
        return found

    def group_similar(self, entries: DataFrame | None = None, kind: str | None = None) -> DataFrame:
        """Ranked members with labels; ``kind`` leaves the groups of images or of videos."""
        found = self.members(entries)
        return report.result_items(groups.preselected(groups.ranked(groups.of_type(found, kind) if kind else found)))

    def plan(self, output: str | None = None, strategy: str | None = None) -> DataFrame:
        """``action, src, dest``; nothing is moved or removed."""
        found, strategy = self.members(), strategy or self.config.strategy
        if strategy == "keep_first":
            keepers = groups.keep_first(found)
        elif strategy == "keep_best":
            pictures, films = groups.of_type(found, "image"), groups.of_type(found, "video")
            keepers = groups.keep_best_image(pictures).unionByName(groups.keep_best_video(films))
        else:
            raise ValueError(f"unknown strategy: {strategy}")
        return groups.action_plan(found, keepers, output)

    def named_pairs(self) -> DataFrame:
        """Image and video pairs with paths for ids."""
        names = self.media().select("ord", "path")
        pairs = self._image_pairs().unionByName(self.find_video_duplicates())
        named = pairs.join(names.select(F.col("ord").alias("id1"), F.col("path").alias("p1")), "id1").join(names.select(F.col("ord").alias("id2"), F.col("path").alias("p2")), "id2")
        return named.select(F.col("p1").alias("id1"), F.col("p2").alias("id2"), "score")

    def export_report(self, path: str) -> int:
        return report.write_report(self.named_pairs(), path, self.config.threshold, self.config.method)


def compare(spark: SparkSession, first: str, second: str, method: str = "phash") -> float:
    """Score of two picture files; 0 where a hash can't be had."""
    how = registry.method(method)
    paths = [os.path.abspath(p) for p in (first, second)]
    for path in paths:
        os.stat(path)  # a missing file is an error
    if paths[0] == paths[1]:
        return 1.0
    listed = spark.createDataFrame([(p, i, "image") for i, p in enumerate(paths)], "path string, ord long, media_type string")
    images = media_source.decode_images(spark, listed).join(listed.select("path", "ord"), "path")
    return _only_score(how, registry.features(images, method).select("id", "f"))


def compare_bytes(spark: SparkSession, first: bytes, second: bytes, method: str = "phash") -> float:
    """Score of two encoded pictures in memory; they pass through files in the shared folder."""
    work = Workspace(spark, "bytes")
    try:
        rows = spark.createDataFrame([(0, first), (1, second)], "ord long, content binary")
        images = media_source.decode_bytes(rows, work, "ord").select(F.col("ord").cast("long").alias("ord"), "width", "height", "channels", "data")
        return _only_score(registry.method(method), registry.features(images, method).select("id", "f"))
    finally:
        work.drop()


def _only_score(how: registry.Method, features: DataFrame) -> float:
    found = how.join(features, -1.0).collect()
    return found[0]["score"] if found else 0.0


def is_similar(spark: SparkSession, first: str, second: str, method: str = "phash", threshold: float = 0.85) -> bool:
    """An explicit threshold of 0 counts as 0."""
    return compare(spark, first, second, method) >= threshold


DONE, FAILED, MISSING = "done", "failed", "missing"


def executed(plan: DataFrame, work: Workspace, confirm: bool = False) -> DataFrame:
    """Carry out a plan by tasks, which have to see the files: ``action, src, dest, outcome, error``, written to a table.

    Only with ``confirm``. Files to keep have no rows. Only existing regular files are touched; a path that is gone is
    missing. A move never replaces a file. A task that runs again finds, for what it had done before, a mark in the
    shared folder, and tells the same.
    """
    if not confirm:
        raise ValueError("a plan is carried out only when that is confirmed")
    marks = f"{work.path}/marks"

    def run(batches):
        fs, folder = files.open_fs(marks)
        fs.create_dir(folder, recursive=True)
        for batch in batches:
            told = [_carried_out(fs, folder, *row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in zip(*told, strict=True))], names=["action", "src", "dest", "outcome", "error"])

    todo = work.table(plan.where("action <> 'keep'").select("action", "src", "dest"), "todo")
    return work.table(todo.mapInArrow(run, "action string, src string, dest string, outcome string, error string"), "outcomes")


def _carried_out(fs, folder: str, action: str, src: str, dest: str | None) -> tuple[str, str | None]:
    mark = f"{folder}/{hashlib.sha256(src.encode('utf-8', 'surrogateescape')).hexdigest()}"
    if not os.path.isfile(src):
        done = fs.get_file_info(mark).type == FileType.File
        return (DONE if done else MISSING), None
    try:
        fs.open_output_stream(mark, compression=None).close()
        if action == "move":
            if os.path.exists(dest):
                raise FileExistsError(errno.EEXIST, "the destination exists", dest)
            os.makedirs(os.path.dirname(dest), exist_ok=True)
            shutil.move(src, dest)
        else:
            os.unlink(src)
        return DONE, None
    except OSError as error:
        fs.delete_file(mark)
        return FAILED, str(error)


def execute(plan: DataFrame, confirm: bool = False) -> tuple[list[str], list[str]]:
    """Carry out a plan for someone to look at: the paths that were done, and those that failed, in order."""
    if not confirm:
        raise ValueError("a plan is carried out only when that is confirmed")
    work = Workspace(plan.sparkSession, "execute")
    try:
        told = executed(plan, work, confirm).select("src", "outcome").collect()
    finally:
        work.drop()
    return tuple(sorted(r["src"] for r in told if r["outcome"] == outcome) for outcome in (DONE, FAILED))
