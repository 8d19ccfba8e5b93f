import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.config import ScanConfig, slider_to_threshold, threshold_to_slider
from twinsieve.functions import scalars
from twinsieve.operators import blocklist, components, groups, pairs, video
from twinsieve.operators.components import connected_components
from twinsieve.plans import report, resources, scan
from twinsieve.plans.workspace import Workspace
from twinsieve.sources import media
from twinsieve.streaming import incremental


def png(path, rgb):
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    rng = np.random.default_rng(1)
    noisy = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((16, 16, 1)))
    large = np.kron(noisy, np.ones((2, 2, 1)))
    other = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((16, 16, 1)))
    png(root / "a b.png", noisy)
    png(root / "sub" / "_same.PNG", noisy)
    png(root / "sub" / ".big (1).png", large)
    png(root / "_dir" / "other.png", other)
    (root / "broken.jpg").write_bytes(b"no picture")
    (root / "notes.txt").write_text("x")
    (root / "x.tif").write_bytes(b"")
    return root


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_labels(spark):
    got = values(spark, [(0.0,), (65.0,), (3661.0,), (-1.0,), (59.9,), (360000.0,)], "s double", scalars.format_duration(F.col("s")))
    assert got == ["00:00", "01:05", "1:01:01", "00:00", "00:59", "100:00:00"]
    got = values(spark, [(0,), (1023,), (1024,), (1536,), (1024**2,), (5 * 1024**3,), (9000 * 1024**3,)], "s long", scalars.format_size(F.col("s")))
    assert got == ["0.0 B", "1023.0 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB", "9000.0 GB"]
    got = values(spark, [(0,), (2 * 1024**4,), (3 * 1024**5,)], "s long", scalars.format_bytes(F.col("s")))
    assert got == ["0.0 B", "2.0 TB", "3.0 PB"]
    scores = [0.00125, 0.5, 0.98765, 1.0, 0.12345, 0.125 / 100, 0.333335]
    got = values(spark, [(s,) for s in scores], "s double", scalars.format_similarity(F.col("s")))
    assert got == [f"{s * 100:.2f}%" for s in scores]
    assert values(spark, [(6100000,), (59999,)], "s long", scalars.format_milliseconds(F.col("s"))) == ["101:40", "00:59"]
    assert values(spark, [("a", ""), ("", ""), ("a", "b")], "x string, y string", scalars.meta_label(F.col("x"), F.col("y"))) == ["a", "", "a · b"]
    assert values(spark, [(5, 3), (0, 3)], "x int, y int", scalars.resolution_label(F.col("x"), F.col("y"))) == ["5x3", scalars.UNKNOWN_RESOLUTION]
    assert values(spark, [(5, 10), (20, 10), (1, 0)], "x int, y int", scalars.progress_percent(F.col("x"), F.col("y"))) == [50, 100, 0]


def test_extensions(spark):
    names = ["a.JPG", "b.tif", ".png", "..gif", "c.d.mkv", "e", ".f.Png", "x.ts"]
    assert values(spark, [(n,) for n in names], "n string", scalars.extension(F.col("n"))) == [".jpg", ".tif", "", "", ".mkv", "", ".png", ".ts"]
    assert values(spark, [(n,) for n in names], "n string", scalars.media_type(F.col("n"))) == ["image", None, None, None, "video", None, "image", "video"]
    assert values(spark, [("/a\\b/c (3).png",)], "n string", scalars.base_name(F.col("n"))) == ["c (3).png"]


def test_settings():
    c = ScanConfig(("a",), method="ahash", video_max_frames=2)
    assert ScanConfig.from_json(c.to_json()) == c and c.frames() == (4, 4)
    assert all(threshold_to_slider(slider_to_threshold(i)) == i for i in range(50, 101))
    for bad in ({"method": "x"}, {"threshold": 2.0}, {"video_fps": 0}):
        with pytest.raises(ValueError):
            ScanConfig(**bad)


def _grid(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 16))
    v[5] = v[9]
    v[7] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, None)]
    return v, spark.createDataFrame(rows, "id long, f array<double>")


@pytest.mark.parametrize("block_rows", [1000, 7])
def test_cosine_pairs(spark, block_rows):
    v, df = _grid(spark)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(norm == 0, 1, norm)
    score = (np.clip(u @ u.T, -1, 1) + 1) / 2
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if score[i, j] >= 0.5 - 1e-12}
    got = {(r["id1"], r["id2"]) for r in pairs.cosine_pairs(df, 0.5 - 1e-12, block_rows=block_rows).collect()}
    assert got == want and (5, 9) in got and (0, 7) in got
    assert pairs.cosine_pairs(df.limit(0), 0.5).count() == 0


def test_pairs_of_one_kind_only(spark):
    df = spark.createDataFrame([(1, [1.0], "image"), (2, [1.0], "video"), (3, [1.0], "image")], "id long, f array<double>, kind string")
    assert [(r["id1"], r["id2"]) for r in pairs.cosine_pairs(df, 0.9).collect()] == [(1, 3)]


@pytest.mark.parametrize("threshold", [0.0, 0.6, 0.85, 1.0])
def test_hash_pairs(spark, threshold):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    base[20:] = base[:20] ^ (np.int64(1) << rng.integers(0, 63, 20)) ^ (np.int64(1) << rng.integers(0, 63, 20))
    df = spark.createDataFrame([(i, int(h)) for i, h in enumerate(base)] + [(40, None)], "id long, f long")
    d = np.bitwise_count(base[:, None].astype(np.uint64) ^ base[None, :].astype(np.uint64))
    want = {(i, j, 1 - d[i, j] / 64) for i in range(40) for j in range(i + 1, 40) if 1 - d[i, j] / 64 >= threshold}
    for band_from in (0.0, 2.0):
        assert {tuple(r) for r in pairs.hash_pairs(df, threshold, band_from=band_from).collect()} == want
    assert pairs.hash_pairs(df, 0.0, missing_as_zero=True).count() == 41 * 40 // 2


def test_asymmetric_scores_take_the_smaller_id_first(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, f double")
    got = pairs.blocked_pairs(df, lambda a, b: a[:, None] * 100 + b[None, :], 0.0, block_rows=3, asymmetric=True).collect()
    assert len(got) == 190 and all(r["score"] == r["id1"] * 100 + r["id2"] for r in got)


def test_with_order(spark):
    df = spark.createDataFrame([(f"k{i:03}",) for i in range(100)], "k string").repartition(5)
    assert {r["k"]: r["ord"] for r in pairs.with_order(df, "k").collect()} == {f"k{i:03}": i for i in range(100)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (200, 201), (201, 200), (300, 300), (None, 5)]
    df = spark.createDataFrame(edges, "id1 long, id2 long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert connected_components(df.limit(0)).count() == 0


def _members(spark):
    rows = [(1, 1, 10, 2, 2, "/m/a.jpg", "a.jpg", 5.0), (1, 2, 10, 3, 3, "/n/a.jpg", "a.jpg", 4.0), (1, 3, 10, 3, 3, "/m/a (1).jpg", "a (1).jpg", 1.0), (4, 4, 7, 1, 1, "/m/b.jpg", "b.jpg", 1.0), (4, 5, 9, 1, 1, "/m/c.jpg", "c.jpg", 1.0)]
    return spark.createDataFrame(rows, "root long, id long, size long, width long, height long, path string, name string, ctime double").withColumn("ord", F.col("id"))


def test_keepers_and_ranks(spark):
    m = _members(spark)
    as_dict = lambda df: {r["root"]: r["keeper"] for r in df.collect()}
    assert as_dict(groups.keep_first(m)) == {1: 1, 4: 4}
    assert as_dict(groups.keep_best_image(m)) == {1: 2, 4: 4}
    assert as_dict(groups.keep_best_video(m)) == {1: 1, 4: 5}
    ranks = {r["id"]: (r["rank"], r["selected"]) for r in groups.preselected(groups.ranked(m)).collect()}
    assert ranks == {2: (1, False), 3: (2, True), 1: (3, True), 5: (1, False), 4: (2, True)}
    plan = sorted(tuple(r) for r in groups.action_plan(m, groups.keep_first(m), "/out").collect())
    assert ("move", "/n/a.jpg", "/out/a.jpg") in plan and sum(p[0] == "keep" for p in plan) == 2
    assert {r["action"] for r in groups.action_plan(m, groups.keep_first(m)).collect()} == {"keep", "remove"}
    assert [r["size"] for r in groups.collected(m.select("root", "id")).orderBy("root").collect()] == [3, 2]
    assert groups.larger_than_one(m.where("id <> 5")).count() == 3


def test_moves_do_not_share_a_name(spark):
    m = _members(spark).withColumn("root", F.lit(1)).where("name = 'a.jpg'").unionByName(_members(spark).where("id = 4").withColumn("root", F.lit(1)).withColumn("path", F.lit("/o/a.jpg")))
    plan = groups.action_plan(m, groups.keep_first(m), "/out").where("action = 'move'").collect()
    assert sorted(r["dest"] for r in plan) == ["/out/a (1).jpg", "/out/a.jpg"]


def test_blocklist(spark):
    g = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d", "e"]), (3, ["f", "g"]), (4, ["h", "i"])], "root long, paths array<string>")
    e = spark.createDataFrame([(0, ["a", "b", "z"], 0.0), (1, ["c", "d"], 0.0), (2, ["", ""], 0.0), (3, ["f", "x"], 0.0)], media.ENTRIES)
    assert [r["root"] for r in blocklist.unblocked(g, e).orderBy("root").collect()] == [3, 4]
    assert tuple(blocklist.blocked_count(g, e).first()) == (2, 2)
    assert {r["root"]: r["status"] for r in blocklist.classify(g, e).collect()} == {1: "covered", 2: "replaced", 3: "added", 4: "added"}
    assert blocklist.removed(e, ["d", "c", "c"]).count() == 3
    assert blocklist.in_folders(e.withColumn("paths", F.array(F.lit("C:\\A\\foobar\\x"))), ["c:/a/foo"]).count() == 4
    assert blocklist.in_folders(e, []).count() == 4 and blocklist.hidden_count(e, ["a"]) == 3
    assert [r["entry_id"] for r in blocklist.page(e, 1, 3).collect()] == [0]


def test_blocklist_changes(tmp_path, spark):
    entries, status = blocklist.add([], ["a", "b"], 1.0)
    assert status == "added"
    assert blocklist.add(entries, ["a"], 2.0) == (entries, "covered")
    entries, status = blocklist.add(entries, ["a", "b", "c"], 3.0)
    assert status == "replaced" and entries == [{"paths": ["a", "b", "c"], "timestamp": 3.0}]
    with pytest.raises(ValueError):
        blocklist.add(entries, [""], 1.0)
    entries, counts = blocklist.add_all(entries, [["x", "y"], [], ["a"], ["x", "y"]], 4.0)
    assert counts == {"added": 1, "covered": 2, "replaced": 0, "total": 2}  # entries on the list
    path = str(tmp_path / "d" / "list.json")
    media.save_blocklist(path, entries)
    assert json.load(open(path))["version"] == 1
    assert [r["paths"] for r in media.load_blocklist(spark, path).orderBy("entry_id").collect()] == [["a", "b", "c"], ["x", "y"]]
    assert media.read_blocklist(str(tmp_path / "none")) == []
    (tmp_path / "bad").write_text("{")
    assert media.read_blocklist(str(tmp_path / "bad")) == []


def test_keyframes(spark):
    df = spark.createDataFrame([(100, 8), (3, 8), (0, 8), (10, 4), (7, 7)], "total int, target int")
    got = [r[0] for r in df.select(video.keyframe_indices(F.col("total"), F.col("target"))).collect()]
    want = [list(range(t)) if n >= t else [min(int(i * (t / n)), t - 1) for i in range(n)] for t, n in ((100, 8), (3, 8), (0, 8), (10, 4), (7, 7))]
    assert got == want
    got = values(spark, [(0.0,), (10.5,), (1000.0,)], "d double", video.target_frames(F.col("d"), 1.0))
    assert got == [4, 10, 32]
    assert values(spark, [(10, 4.0), (10, 0.0)], "n int, f double", video.duration_seconds(F.col("n"), F.col("f"))) == [2.5, 0.0]
    assert tuple(video.average_resolution(spark.createDataFrame([(0, 5, 1), (3, 6, 2), (4, 7, 3)], "width int, height int, ord int")).first()) == (3, 6)
    assert tuple(video.average_resolution(spark.createDataFrame([], "width int, height int, ord int")).first()) == (1920, 1080)


@pytest.mark.parametrize("block", [64, 1])
def test_mean_max_is_that_of_the_smaller_id(spark, block):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (3, 0, [1.0, 0.0]), (3, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "video_id long, frame_idx int, v array<double>")
    got = {(r["id1"], r["id2"]): r["score"] for r in video.mean_max_pairs(df, 0.0, block).collect()}
    assert got == {(1, 2): pytest.approx(0.75), (1, 3): pytest.approx(0.75), (2, 3): pytest.approx(1.0)}
    videos = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [])], "video_id long, frames array<array<double>>")
    assert video.flattened(videos).count() == 2


def test_resources(spark):
    got = spark.createDataFrame([(100, 10, 50), (100, 1000, 50), (100, 10, 0), (100, 10, 5)], "m long, e long, n long").select(resources.batch_size(F.col("m"), F.col("e"), F.col("n"))).collect()
    assert [r[0] for r in got] == [20, 1, 0, 5]
    got = values(spark, [([0.96, 0.5, 0.5, 0.5],), ([0.91],), ([0.99] * 20,), ([0.5],)], "r array<double>", resources.adapted_batch(F.col("r"), F.lit(64)))
    assert got == [62, 48, 1, 64]
    assert one(spark, resources.memory_limit(F.lit(None).cast("long")))[0] == int(8 * 1024**3 * 0.8)


def test_listing(spark, folder):
    got = {r["name"]: r for r in media.list_media(spark, [str(folder), f"{folder}/sub/../sub", "/no/such/folder"]).collect()}
    assert set(got) == {"a b.png", "_same.PNG", ".big (1).png", "other.png", "broken.jpg"}
    assert got["_same.PNG"]["ext"] == ".png" and sorted(r["ord"] for r in got.values()) == list(range(5))
    assert {r["name"] for r in media.list_media(spark, str(folder), recursive=False).collect()} == {"a b.png", "broken.jpg"}
    assert media.list_media(spark, "/no/such/folder").count() == 0


def test_decoding(spark, folder):
    listed = media.list_media(spark, str(folder))
    images = media.decode_images(spark, listed)
    got = {os.path.basename(r["path"]): (r["width"], r["height"], r["size"]) for r in media.image_metadata(listed, images).collect()}
    assert got["a b.png"][:2] == (128, 128) and got["broken.jpg"] == (0, 0, 10) and got[".big (1).png"][:2] == (256, 256)


@pytest.mark.parametrize("method", ["phash", "dhash", "ahash", "whash", "histogram", "ssim", "orb", "gpu"])
def test_scan_with_each_method(spark, folder, method):
    job = scan.DuplicateScan(spark, ScanConfig((str(folder),), method=method, threshold=0.95 if method != "orb" else 0.9))
    names = {r["ord"]: r["name"] for r in job.media().collect()}
    found = {frozenset((names[r["id1"]], names[r["id2"]])): r["score"] for r in job.find_duplicates().collect()}
    # Equal descriptors within a picture aren't mutual nearest to themselves.
    assert found[frozenset(("a b.png", "_same.PNG"))] == pytest.approx(1.0, abs=0.05 if method == "orb" else 1e-9)
    assert frozenset(("a b.png", "other.png")) not in found
    assert all(0 <= s <= 1 + 1e-12 for s in found.values())


def test_scan_groups_plan_and_report(spark, folder, tmp_path):
    job = scan.DuplicateScan(spark, ScanConfig((str(folder),), threshold=0.9))
    items = {r["name"]: r for r in job.group_similar().collect()}
    assert set(items) == {"a b.png", "_same.PNG", ".big (1).png"} and len({r["root"] for r in items.values()}) == 1
    assert items[".big (1).png"]["resolution"] == "256x256" and sum(not r["selected"] for r in items.values()) == 1
    plan = {os.path.basename(r["src"]): r["action"] for r in job.plan(strategy="keep_best").collect()}
    assert plan == {"a b.png": "remove", "_same.PNG": "remove", ".big (1).png": "keep"}
    path = str(tmp_path / "r.json")
    assert job.export_report(path) == 3
    told = json.load(open(path))
    assert told["total_pairs"] == 3 == len(told["duplicates"]) and told["duplicates"][0]["similarity"] == 1.0
    entries = spark.createDataFrame([(0, [r["path"] for r in items.values()], 0.0)], media.ENTRIES)
    assert job.group_similar(entries).count() == 0
    with pytest.raises(ValueError):
        job.plan(strategy="none")


def test_compare(spark, folder):
    a, b, c = str(folder / "a b.png"), str(folder / "sub" / "_same.PNG"), str(folder / "_dir" / "other.png")
    assert scan.compare(spark, a, b, "phash") == pytest.approx(1, abs=0.01)
    assert scan.compare(spark, a, c, "phash") < 1
    assert scan.is_similar(spark, a, b) and scan.is_similar(spark, a, c, threshold=0.0)
    with pytest.raises(ValueError):
        scan.compare(spark, a, b, "none")


def test_execution_needs_confirmation(spark, tmp_path):
    for n in ("a", "b", "c"):
        (tmp_path / n).write_text(n)
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b").write_text("there")
    plan = spark.createDataFrame([("keep", f"{tmp_path}/a", None), ("move", f"{tmp_path}/b", f"{tmp_path}/out/b"), ("remove", f"{tmp_path}/c", None), ("remove", f"{tmp_path}/gone", None)], "action string, src string, dest string")
    with pytest.raises(ValueError):
        scan.execute(plan)
    assert scan.execute(plan, confirm=True) == ([f"{tmp_path}/c"], [f"{tmp_path}/b"])
    assert (tmp_path / "a").exists() and (tmp_path / "b").exists() and (tmp_path / "out" / "b").read_text() == "there"


def test_video_scan(spark, tmp_path):
    for n in ("a.mp4", "b.mkv", "c.avi", "bad.mov"):
        (tmp_path / n).write_text(n)

    def decoder(path):
        if path.endswith("bad.mov"):
            raise OSError
        v = [0.0, 1.0] if path.endswith("c.avi") else [1.0, 0.0]
        return [(i, v) for i in range(3)]

    job = scan.DuplicateScan(spark, ScanConfig((str(tmp_path),), video_enabled=True), decoder)
    items = job.group_similar().collect()
    assert sorted(r["name"] for r in items) == ["a.mp4", "b.mkv"] and {r["type"] for r in items} == {"video"}


def test_stream_against_store(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "id long, f long").coalesce(1).write.parquet(f"file://{source}")
    paths = [f"file://{tmp_path}/{n}" for n in ("store", "out", "check")]
    stream = spark.readStream.schema("id long, f long").parquet(f"file://{source}")
    incremental.match_stream(stream, *paths).awaitTermination()
    spark.createDataFrame([(4, 3)], "id long, f long").write.mode("append").parquet(f"file://{source}")
    incremental.match_stream(spark.readStream.schema("id long, f long").parquet(f"file://{source}"), *paths).awaitTermination()
    got = {(r["id1"], r["id2"]) for r in spark.read.parquet(paths[1]).collect()}
    assert got == {(1, 2), (1, 4), (2, 4)}


def test_workspace(spark):
    w = Workspace(spark, "test")
    assert w.table(spark.range(4), "t").count() == 4
    w.drop("t")


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_by_contraction_and_in_one_task(spark, local, monkeypatch):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {tuple(r) for r in components.connected_components(spark.createDataFrame(chain, "id1 long, id2 long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_report_rounds_by_the_exact_value(spark):
    values = [0.12345, 0.99995, 0.5, 0.00005, 0.66665, 1.0]
    pairs = spark.createDataFrame([(str(i), "z", v) for i, v in enumerate(values)], "id1 string, id2 string, score double")
    assert {r["image1"]: r["similarity"] for r in report.report_rows(pairs).collect()} == {str(i): round(v, 4) for i, v in enumerate(values)}
