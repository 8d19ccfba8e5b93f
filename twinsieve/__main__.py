"""Command line: compare two files, or find, group and resolve duplicates below a folder."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from twinsieve.config import ScanConfig
from twinsieve.plans import registry, report, scan
from twinsieve.plans.control import Progress
from twinsieve.plans.feature_store import FeatureStore
from twinsieve.plans.group_store import GroupStore


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinsieve", description=__doc__)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--method", default="phash", help="a built-in method or one that a plug-in registers")
    shared.add_argument("--plugin", action="append", default=[], metavar="MODULE", help="a module to import, which registers methods")
    shared.add_argument("--decoder", metavar="MODULE:FUNCTION", help="opens a video for reading its frames")
    shared.add_argument("--store", metavar="FOLDER", help="keep features and groups there, so that known files are not decoded and compared again")
    shared.add_argument("--threshold", type=float, default=0.85)
    shared.add_argument("--no-progress", action="store_true")
    shared.add_argument("--video-enabled", action="store_true")
    shared.add_argument("--video-method", default="gpu")
    shared.add_argument("--video-threshold", type=float, default=0.90)
    shared.add_argument("--video-fps", type=float, default=1.0)
    shared.add_argument("--video-max-frames", type=int, default=32)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("compare", parents=[shared])
    c.add_argument("first")
    c.add_argument("second")
    for name in ("find", "group", "dedup"):
        c = commands.add_parser(name, parents=[shared])
        c.add_argument("directory")
        c.add_argument("-r", "--recursive", action="store_true")
        if name == "find":
            c.add_argument("--report")
        if name == "dedup":
            c.add_argument("--output")
            c.add_argument("--strategy", choices=("keep_first", "keep_best"), default="keep_first")
            c.add_argument("--execute", action="store_true", help="carry out the plan instead of showing it")
    return top


def _named(place: str):
    """The object at module:name."""
    module, _, name = place.partition(":")
    found = importlib.import_module(module)
    for step in name.split("."):
        found = getattr(found, step)
    return found


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    try:
        for plugin in a.plugin:
            importlib.import_module(plugin)
        opener = _named(a.decoder) if a.decoder else None
        registry.method(a.method)
    except (ImportError, AttributeError, ValueError) as error:
        top.error(str(error))
    if a.video_enabled and opener is None:
        top.error("--video-enabled needs --decoder: no video decoder is included")
    spark = SparkSession.builder.appName("twinsieve").config("spark.ui.showConsoleProgress", str(not a.no_progress).lower()).getOrCreate()
    if a.command == "compare":
        score = scan.compare(spark, a.first, a.second, a.method)
        print(f"{score * 100:.2f}% {'similar' if score >= a.threshold else 'different'}")
        return 0
    config = ScanConfig((a.directory,), a.recursive, a.method, a.threshold, getattr(a, "strategy", "keep_first"), a.video_enabled, a.video_method, a.video_threshold, a.video_fps, a.video_max_frames)
    kept = f"file://{os.path.abspath(a.store)}" if a.store and "://" not in a.store else a.store
    store, group_store = (FeatureStore(spark, f"{kept}/features"), GroupStore(spark, f"{kept}/groups")) if kept else (None, None)
    with scan.DuplicateScan(spark, config, opener=opener, store=store, group_store=group_store, progress=None if a.no_progress else _show) as job:
        return _COMMANDS[a.command](job, a)


def _show(told: Progress) -> None:
    print(f"{told.stage}: {told.percent}%", file=sys.stderr)


def _find(job: scan.DuplicateScan, a: argparse.Namespace) -> int:
    for row in report.console_pairs(job.named_pairs()).toLocalIterator():
        print(row["line"])
    if a.report:
        job.export_report(a.report)
    return 0


def _group(job: scan.DuplicateScan, a: argparse.Namespace) -> int:
    for row in job.group_similar().orderBy("type", "root", "rank").toLocalIterator():
        print(row["root"], row["rank"], row["path"], row["resolution"], row["size_formatted"], row["duration_formatted"] or "")
    return 0


def _dedup(job: scan.DuplicateScan, a: argparse.Namespace) -> int:
    plan = job.plan(a.output)
    if a.execute:
        told = dict(scan.executed(plan, job.work, confirm=True).groupBy("outcome").count().collect())
        print(f"{told.get(scan.DONE, 0)} done, {told.get(scan.FAILED, 0)} failed, {told.get(scan.MISSING, 0)} missing")
    else:
        for row in plan.toLocalIterator():
            print(row["action"], row["src"], row["dest"] or "")
    return 0


_COMMANDS = {"find": _find, "group": _group, "dedup": _dedup}


if __name__ == "__main__":
    raise SystemExit(main())
