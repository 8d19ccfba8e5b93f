import threading
import time

import pytest
from pyspark.sql import functions as F

from twinsieve.plans.control import Cancelled, Progress, Run
from twinsieve.plans.feature_store import FeatureStore


def test_progress_percent():
    assert Progress("x", 5, 10).percent == 50 and Progress("x", 20, 10).percent == 100 and Progress("x", 1, 0).percent == 0


def test_run_reports_and_returns(spark):
    seen = []
    assert Run(spark)(lambda: spark.range(10).count(), seen.append, 0.05) == 10
    assert seen[-1].percent == 100


def test_run_can_be_cancelled(spark):
    run = Run(spark)
    slow = spark.range(0, 4, 1, 4).select(F.udf(lambda x: time.sleep(20) or x, "long")("id").alias("x"))
    threading.Timer(3, run.cancel).start()
    with pytest.raises(Cancelled):
        run(lambda: slow.collect())
    with pytest.raises(Cancelled):
        run(lambda: 1)


def test_feature_store_extracts_new_files_only(spark, tmp_path):
    store, asked = FeatureStore(spark, f"file://{tmp_path}/store"), []

    def extract(new):
        rows = [(r["path"], len(r["path"])) for r in new.collect()]
        asked.append(sorted(r["ord"] for r in new.collect()))
        return spark.createDataFrame(rows, "path string, f long")

    media = spark.createDataFrame([(0, "/a", 1.0, 5), (1, "/bb", 1.0, 6)], "ord long, path string, mtime double, size long")
    assert {tuple(r) for r in store.features(media, "m", extract).collect()} == {(0, 2), (1, 3)}
    later = spark.createDataFrame([(0, "/a", 1.0, 5), (1, "/bb", 2.0, 6), (2, "/ccc", 1.0, 1)], media.schema)
    assert {tuple(r) for r in store.features(later, "m", extract).collect()} == {(0, 2), (1, 3), (2, 4)}
    assert {tuple(r) for r in store.features(later, "m", extract).collect()} == {(0, 2), (1, 3), (2, 4)}
    assert asked == [[0, 1], [1, 2]]  # nothing is asked for where all is known
    assert store.features(media.limit(0), "other", extract).collect() == []
