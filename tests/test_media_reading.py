"""Listing, decoding, container headers, keyframes and features by batch."""

import glob
import json
import os
import struct
import sys
import warnings
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

import media_plugins  # noqa: E402

from twinsieve import __main__ as cli  # noqa: E402
from twinsieve.config import ScanConfig  # noqa: E402
from twinsieve.functions import kernels  # noqa: E402
from twinsieve.operators import pairs, video  # noqa: E402
from twinsieve.plans import models, registry, scan  # noqa: E402
from twinsieve.plans.control import Cancelled, Run  # noqa: E402
from twinsieve.plans.feature_store import FeatureStore  # noqa: E402
from twinsieve.sources import containers, keyframes, listing, media  # noqa: E402


def png(path, bgr):
    h, w = bgr.shape[:2]
    raw = b"".join(b"\0" + bgr[i, :, ::-1].tobytes() for i in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    with open(path, "wb") as file:
        file.write(content)
    return content


# Network input ----------------------------------------------------------------------------------------------------


def plain_input(bgr, short=256, crop=224):
    """One picture, pixel by pixel: triangle filter, cut, scale, normalise."""
    h, w = bgr.shape[:2]
    tall, wide = (short, int(short * w / h)) if h <= w else (int(short * h / w), short)

    def weights(n_in, n_out, at):
        scale = n_in / n_out
        reach = max(scale, 1.0)
        x = np.array([max(0.0, 1 - abs((k + 0.5 - (at + 0.5) * scale) / reach)) for k in range(n_in)])
        return x / x.sum()

    top, left = round((tall - crop) / 2), round((wide - crop) / 2)
    rows, columns = np.array([weights(h, tall, top + i) for i in range(crop)]), np.array([weights(w, wide, left + j) for j in range(crop)])
    out = np.stack([rows @ bgr[..., 2 - c].astype(float) @ columns.T for c in range(3)])
    out = np.clip(np.floor(out + 0.5), 0, 255) / 255
    return (out - np.array([0.485, 0.456, 0.406])[:, None, None]) / np.array([0.229, 0.224, 0.225])[:, None, None]


def test_network_input_by_hand():
    flat = np.zeros((10, 20, 3), np.uint8)
    flat[:] = (0, 128, 255)  # blue, green, red
    got = kernels.network_input([flat])
    assert got.shape == (1, 3, 224, 224) and got.dtype == np.float32
    assert np.allclose(got[0].reshape(3, -1).mean(axis=1), [(1 - 0.485) / 0.229, (128 / 255 - 0.456) / 0.224, -0.406 / 0.225], atol=1e-5)


@pytest.mark.parametrize("size", [(300, 500), (257, 31), (1, 9), (40, 40), (256, 256)])
def test_network_input_equals_plain_loops(size):
    rng = np.random.default_rng(size[0])
    pictures = [rng.integers(0, 256, (*size, 3)).astype(np.uint8) for _ in range(2)]
    got = kernels.network_input([pictures[0], np.zeros((30, 50, 3), np.uint8), pictures[1]])
    for picture, own in ((pictures[0], got[0]), (pictures[1], got[2])):
        # single precision may round the other way where a value lies between two bytes
        assert np.abs(own - plain_input(picture)).max() < 0.02 and np.abs(own - plain_input(picture)).mean() < 1e-4


def test_network_input_odd_pictures():
    gray = np.arange(600, dtype=np.uint8).reshape(20, 30)
    three = np.repeat(gray[..., None], 3, axis=2)
    a, b, c, d = kernels.network_input([gray, gray[..., None], three, np.concatenate([three, gray[..., None]], axis=2)])
    assert (a == b).all() and (b == c).all() and (c == d).all()
    assert kernels.network_input([]).shape == (0, 3, 224, 224)
    for broken in (np.zeros((0, 5, 3), np.uint8), np.zeros(7, np.uint8), np.zeros((4, 4, 2), np.uint8)):
        with pytest.raises(ValueError):
            kernels.network_input([broken])
    assert kernels.network_input([np.zeros((1, 20000, 3), np.uint8)]).shape == (1, 3, 224, 224)  # the cut alone is computed


# Batches ----------------------------------------------------------------------------------------------------------


def test_batches_keep_rows_in_line(monkeypatch):
    monkeypatch.setattr(models, "RAW_BYTES", 20_000)
    sizes = []

    def load():
        def predict(batch):
            sizes.append(len(batch))
            return batch.mean(axis=(2, 3))

        return predict

    model = models.BatchModel(load, 3, batch_rows=4)
    order = [0, 1, 1, None, 2, -1, 0, 3, 4, 0, 5, 6, 7, -1, 8, 8, 9]
    rows = [(i, None if s is None else media_plugins.picture(s)) for i, s in enumerate(order)]
    got = list(models.batched(iter(rows), model))
    assert [k for keys, _ in got for k in keys] == list(range(len(order)))
    vectors = np.concatenate([v for _, v in got])
    for seed, vector in zip(order, vectors, strict=True):
        alone = np.zeros(3) if seed is None or seed < 0 else kernels.network_input([media_plugins.picture(seed)]).mean(axis=(2, 3))[0]
        assert np.allclose(vector, alone, atol=1e-6)
    assert sizes == [3, 4, 3, 1]  # four different pictures a batch, of which a broken one is left out
    assert list(models.batched(iter([]), model)) == []
    with pytest.raises(ValueError, match="numbers each"):
        list(models.batched(iter(rows[:1]), models.BatchModel(lambda: lambda b: b.mean(axis=(1, 2, 3)), 3)))


def test_many_repeats_do_not_pile_up():
    model = models.BatchModel(lambda: lambda b: b.mean(axis=(2, 3)), 3, batch_rows=2)
    got = list(models.batched(((i, media_plugins.picture(1)) for i in range(200)), model))
    assert max(len(keys) for keys, _ in got) <= 64 and sum(len(keys) for keys, _ in got) == 200


def test_model_features_of_images(spark, tmp_path):
    """Batches of a set size, one load a worker, results as one by one, zeros for what can't be decoded."""
    marks = tmp_path / "marks"
    marks.mkdir()
    registry.register_model("marked", media_plugins.MeanModel(str(marks)), width=147, batch_rows=8)
    rows = [(i, media_plugins.picture(i % 30).tobytes() if i % 10 else None, 48, 64, 3) for i in range(100)] + [(100, b"short", 48, 64, 3)]
    images = spark.createDataFrame(rows, "ord long, data binary, height int, width int, channels int").coalesce(1).sortWithinPartitions("ord")
    for _ in range(2):
        got = {r["id"]: r["f"] for r in registry.features(images, "marked", keep=("width",)).collect()}
    assert len(got) == 101
    predict = media_plugins.MeanModel()()
    for i, vector in got.items():
        want = predict(kernels.network_input([media_plugins.picture(i % 30)]))[0] if i % 10 and i < 100 else np.zeros(147)
        assert np.allclose(vector, want, atol=1e-5)
    names = [os.path.basename(p) for p in glob.glob(f"{marks}/*")]
    batches = [int(n.split("-")[1]) for n in names if n.startswith("batch")]
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    assert max(batches) == 8 and sorted(batches)[-len(batches) // 2 :].count(8) >= len(batches) // 2 - 1
    assert len(loads) == len(set(loads))  # no worker loads it twice
    found = registry.method("marked").join(registry.features(images, "marked").where("id between 1 and 35"), 0.999999).collect()
    assert {(r["id1"], r["id2"]) for r in found} >= {(1, 31), (5, 35)}


# Container headers ------------------------------------------------------------------------------------------------


def box(kind, *bodies):
    body = b"".join(bodies)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def iso_file(width=640, height=360, scale=30000, gap=1001, frames=90, version=0, first=b"", handler=b"vide", coded=True):
    clock = struct.pack(">BxxxIIII", 0, 0, 0, scale, gap * frames) if version == 0 else struct.pack(">BxxxQQIQ", 1, 0, 0, scale, gap * frames)
    entry = struct.pack(">I4s", 86, b"avc1") + bytes(24) + struct.pack(">HH", width, height) + bytes(50)
    table = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry) if coded else b"", box(b"stsz", struct.pack(">III", 0, 0, frames)))
    track = box(b"tkhd", bytes(76), struct.pack(">II", width << 16, height << 16))
    sound = box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(12))))
    movie = box(b"moov", box(b"mvhd", bytes(100)), sound, box(b"trak", track, box(b"mdia", box(b"mdhd", clock), box(b"hdlr", bytes(8), handler, bytes(12)), box(b"minf", table))))
    return box(b"ftyp", b"isom", bytes(4)) + first + movie


def avi_file(width=320, height=240, scale=1, rate=25, frames=50, stream=True):
    def chunk(kind, body):
        return struct.pack("<4sI", kind, len(body)) + body + b"\0" * (len(body) % 2)

    head = chunk(b"avih", struct.pack("<IIIIIIIIII", 40000, 0, 0, 0, frames, 0, 1, 0, width, height) + bytes(16))
    own = chunk(b"strh", b"vidsXVID" + struct.pack("<IHHIIIII", 0, 0, 0, 0, scale, rate, 0, frames) + bytes(16))
    lists = chunk(b"LIST", b"hdrl" + head + (chunk(b"LIST", b"strl" + own) if stream else b""))
    return chunk(b"RIFF", b"AVI " + chunk(b"JUNK", b"odd") + lists + chunk(b"LIST", b"movi" + bytes(100)))


def element(number, body, unknown=False):
    raw = number.to_bytes((number.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if unknown else (0x0100000000000000 | len(body)).to_bytes(8, "big")) + body


def matroska_file(width=800, height=600, gap=40_000_000, seconds=12.0, unknown=False):
    info = element(0x1549A966, element(0x2AD7B1, (1_000_000).to_bytes(3, "big")) + element(0x4489, struct.pack(">d", seconds * 1000)))
    own = element(0xE0, element(0xB0, width.to_bytes(2, "big")) + element(0xBA, height.to_bytes(2, "big")))
    tracks = element(0x1654AE6B, element(0xAE, element(0x83, b"\2")) + element(0xAE, element(0x83, b"\1") + element(0x23E383, gap.to_bytes(4, "big")) + own))
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(0x18538067, info + tracks + element(0x1F43B675, bytes(64)), unknown)


def test_container_headers(spark, tmp_path):
    big = struct.pack(">I4sQ", 1, b"mdat", 16 + 50) + bytes(50)
    made = {
        "a.mp4": (iso_file(), (640, 360, 30000 / 1001, 90)),
        "late.mov": (iso_file(version=1, first=big, coded=False), (640, 360, 30000 / 1001, 90)),
        "b.avi": (avi_file(), (320, 240, 25.0, 50)),
        "c.avi": (avi_file(stream=False), (320, 240, 25.0, 50)),
        "d.mkv": (matroska_file(), (800, 600, 25.0, 300)),
        "e.webm": (matroska_file(unknown=True, seconds=4.0), (800, 600, 25.0, 100)),
        "sound.m4v": (iso_file(handler=b"soun"), (0, 0, 0.0, 0)),
        "still.mp4": (iso_file(frames=0), (640, 360, 0.0, 0)),
        "cut.mp4": (iso_file()[:-60], (0, 0, 0.0, 0)),
        "cut.mkv": (matroska_file()[:30], (0, 0, 0.0, 0)),
        "empty.mp4": (b"", (0, 0, 0.0, 0)),
        "text.ts": (b"not a video at all, but long enough", (0, 0, 0.0, 0)),
        "loop.mp4": (box(b"ftyp") + struct.pack(">I4s", 4, b"moov") + bytes(8), (0, 0, 0.0, 0)),
    }
    for name, (raw, _) in made.items():
        (tmp_path / name).write_bytes(raw)
    listed = media.list_media(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): r for r in media.video_metadata(listed).collect()}
    assert set(got) == set(made)
    for name, (raw, want) in made.items():
        row = got[name]
        assert (row["width"], row["height"], row["fps"], row["frames"]) == (want[0], want[1], pytest.approx(want[2]), want[3]), name
        assert row["size"] == len(raw) and row["duration"] == (pytest.approx(want[3] / want[2]) if want[2] and want[3] else 0.0)


def test_headers_with_random_bytes():
    """Whatever is damaged, something comes out."""
    import io

    rng = np.random.default_rng(3)
    for whole in (iso_file(), avi_file(), matroska_file()):
        for _ in range(300):
            raw = np.frombuffer(whole, np.uint8).copy()
            at = rng.integers(0, len(raw), 4)
            raw[at] = rng.integers(0, 256, 4)
            info = containers.video_info(io.BytesIO(raw.tobytes()), len(raw))
            assert len(info) == 4


# Keyframes --------------------------------------------------------------------------------------------------------


def test_chosen_frames_equal_the_columns(spark):
    cases = [(0, 25.0), (3, 25.0), (4, 25.0), (50, 25.0), (250, 25.0), (7000, 29.97), (100, 0.0), (33, 1.0)]
    for rate, least, most in ((1.0, 4, 32), (2.5, 1, 8), (0.5, 6, 2)):
        df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(cases)], "i int, total int, fps double")
        target = video.target_frames(video.duration_seconds(F.col("total"), F.col("fps")), rate, least, most)
        for row in df.select("i", "total", "fps", video.keyframe_indices(F.col("total"), target).alias("k")).collect():
            got = keyframes.chosen_frames(row["total"], row["fps"], rate, least, most)
            assert got == ([] if row["fps"] == 0 else row["k"])


def text_video(path, **about):
    with open(path, "w", encoding="utf-8") as file:
        json.dump(about, file)


@pytest.fixture
def films(tmp_path):
    folder, log = tmp_path / "films", tmp_path / "log"
    folder.mkdir()
    log.mkdir()
    text_video(folder / "a.mp4", fps=10.0, frames=100, scenes=[1, 2, 3, 4], log=str(log))
    text_video(folder / "b.mkv", fps=10.0, frames=100, scenes=[1, 2, 3, 4], log=str(log))
    text_video(folder / "c.avi", fps=10.0, frames=100, scenes=[7, 8, 9, 5], log=str(log), broken=[0])
    text_video(folder / "short.mov", fps=10.0, frames=6, scenes=[6], log=str(log), broken=[3])
    text_video(folder / "none.mp4", fps=0.0, frames=10, scenes=[1], log=str(log))
    text_video(folder / "odd.webm", fps=1.0, frames=5, scenes=[1, -1, 1, 1, 1])
    (folder / "bad.flv").write_text("not a video")
    return folder, log


def test_reader_gets_the_right_frames(spark, films):
    folder, log = films
    model = registry.vector_model("means")
    listed = media.list_media(spark, str(folder))
    got = keyframes.keyframe_features(listed, media_plugins.TextVideo, model, rate=1.0, least=4, most=32, batch_rows=5).collect()
    names = {r["ord"]: r["name"] for r in listed.collect()}
    frames = {}
    for row in got:
        frames.setdefault(names[row["video_id"]], {})[row["frame_idx"]] = row["v"]
    seen = media_plugins.logs_of(log)
    evenly = list(range(0, 100, 10))  # ten seconds, a frame a second: sparse, so it seeks
    assert seen["a.mp4"]["seeks"] == evenly and seen["a.mp4"]["reads"] == evenly and sorted(frames["a.mp4"]) == list(range(10))
    assert seen["c.avi"]["seeks"] == evenly and sorted(frames["c.avi"]) == list(range(9))  # a failed seek is passed over
    # four of six frames: dense, so it reads through, and stops at the frame that fails
    assert seen["short.mov"]["seeks"] == [] and seen["short.mov"]["reads"] == [0, 1, 2, 3] and sorted(frames["short.mov"]) == [0, 1]
    assert seen["none.mp4"]["reads"] == [] and set(frames) == {"a.mp4", "b.mkv", "c.avi", "short.mov", "odd.webm"}
    assert sorted(frames["odd.webm"]) == [0, 1, 2, 3, 4] and not np.any(frames["odd.webm"][1]) and np.any(frames["odd.webm"][0])
    predict = media_plugins.MeanModel()()
    assert np.allclose(frames["a.mp4"][0], predict(kernels.network_input([media_plugins.picture(1)]))[0], atol=1e-5)


def test_video_scan_with_a_reader(spark, films):
    folder, log = films
    config = ScanConfig((str(folder),), method="means", video_enabled=True, video_method="means", video_threshold=0.99, video_fps=2.0, video_max_frames=12)
    told = []
    with scan.DuplicateScan(spark, config, opener=media_plugins.TextVideo, progress=told.append) as job:
        items = job.group_similar(kind="video").collect()
        assert sorted(r["name"] for r in items) == ["a.mp4", "b.mkv"] and job.group_similar(kind="image").count() == 0
        assert job.counts["frames"]["rows"] == job.frames().count() and job.find_video_duplicates_large().count() == 1
        assert {r["src"].split("/")[-1]: r["action"] for r in job.plan(strategy="keep_best").collect()} == {"a.mp4": "keep", "b.mkv": "remove"}
        folder_of_run = job.work.path.removeprefix("file://")
    assert not os.path.exists(folder_of_run)
    seen = media_plugins.logs_of(log)["a.mp4"]
    assert seen["seeks"] == [int(i * (100 / 12)) for i in range(12)]  # rate and limit reach the reader
    assert {p.stage for p in told} == {"frames", "features", "pairs"} and max(p.percent for p in told) == 100
    with pytest.raises(ValueError, match="not vectors"):
        scan.DuplicateScan(spark, ScanConfig((str(folder),), video_enabled=True, video_method="phash"), opener=media_plugins.TextVideo)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert scan.DuplicateScan(spark, config).find_video_duplicates().count() == 0
    assert any("without a reader" in str(w.message) for w in caught)


def test_durations_reach_the_items(spark, tmp_path):
    for name in ("a.mp4", "b.mp4"):
        (tmp_path / name).write_bytes(iso_file())
    job = scan.DuplicateScan(spark, ScanConfig((str(tmp_path),), video_enabled=True), decoder=lambda path: [(0, [1.0, 0.0])])
    items = job.group_similar().collect()
    assert [(r["resolution"], r["duration"], r["duration_formatted"]) for r in items] == [("640x360", 3.0, "00:03")] * 2


def test_command_line_with_a_reader(spark, films, capsys, tmp_path):
    folder, log = films
    options = ["--plugin", "media_plugins", "--method", "means", "--no-progress", "--video-method", "means", "--video-enabled", "--video-threshold", "0.99", "--video-fps", "3", "--video-max-frames", "9"]
    report = str(tmp_path / "r.json")
    assert cli.main(["find", str(folder), *options, "--decoder", "media_plugins:TextVideo", "--report", report]) == 0
    out = capsys.readouterr().out
    assert "a.mp4" in out and "b.mkv" in out and "100.00%" in out and json.load(open(report))["total_pairs"] == 1
    assert len(media_plugins.logs_of(log)["a.mp4"]["seeks"]) == 9
    assert cli.main(["group", str(folder), *options, "--decoder", "media_plugins:TextVideo"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    for wrong in ([*options], [*options[2:], "--decoder", "media_plugins:Nothing"], ["--method", "nothing"]):
        with pytest.raises(SystemExit):
            cli.main(["find", str(folder), *wrong])


# Listing and decoding ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tasks", [1, 3, 50])
def test_listing_finds_what_a_walk_finds(tmp_path, tasks):
    for place in ("", "a", "a/b", "a/b/c", ".hidden", "_d/e", "a/[x]"):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        for name in ("x.jpg", ".y.png", "_z.mp4", "note.txt"):
            (tmp_path / place / name).write_text(place)
    os.symlink(tmp_path / "a" / "x.jpg", tmp_path / "link.jpg")
    os.symlink(tmp_path / "a", tmp_path / "a" / "circle")
    os.symlink(tmp_path / "gone", tmp_path / "gone.jpg")
    for deep in (True, False):
        reader = listing.FolderReader([str(tmp_path), "/no/such", str(tmp_path / "a")], deep, tasks)
        parts = reader.partitions()
        assert len(parts) <= max(1, tasks)
        got = sorted((row[0], row[1]) for part in parts for row in reader.read(part))
        want = []
        for i, root in ((0, tmp_path), (2, tmp_path / "a")):
            walked = os.walk(root) if deep else [next(os.walk(root))]
            want += [(i, os.path.join(d, n)) for d, _, names in walked for n in names if os.path.isfile(os.path.join(d, n))]
        assert got == sorted(want)


@pytest.mark.parametrize("named", [10_000, 0])
def test_decoding_by_names_and_by_folders(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(media, "NAMED_FILES", named)
    (tmp_path / "in" / "_sub" / "deep").mkdir(parents=True)
    names = ["in/a[1].png", "in/b{2}.PNG", "in/c d%20.png", "in/.e.png", "in/_sub/f.png", "in/_sub/deep/é,?.png"]
    for i, name in enumerate(names):
        png(tmp_path / name, media_plugins.picture(i))
    (tmp_path / "in" / "broken.png").write_bytes(b"no picture")
    (tmp_path / "in" / "other.txt").write_bytes(b"no picture")
    listed = media.list_media(spark, str(tmp_path / "in"))
    assert [r["ord"] for r in listed.orderBy("path").collect()] == list(range(7))
    got = {os.path.relpath(r["path"], tmp_path): r for r in media.decode_images(spark, listed, [str(tmp_path / "in"), "/no/such"]).collect()}
    assert set(got) == {*names, "in/broken.png"} and got["in/broken.png"]["data"] is None and got["in/broken.png"]["width"] == 0
    for i, name in enumerate(names):
        assert got[name]["data"] == media_plugins.picture(i).tobytes()
    assert media.decode_images(spark, listed.limit(0)).collect() == []


def test_known_files_are_not_decoded_again(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        png(folder / f"{i}.png", media_plugins.picture(i // 2))
    asked, decode = [], media.decode_images

    def counting(spark, listed, *rest):
        asked.append(sorted(os.path.basename(r["path"]) for r in listed.collect()))
        return decode(spark, listed, *rest)

    monkeypatch.setattr(media, "decode_images", counting)
    store = FeatureStore(spark, f"file://{tmp_path}/store")
    found = []
    for step in range(3):
        with scan.DuplicateScan(spark, ScanConfig((str(folder),)), store=store) as job:
            found.append([(r["name"], r["width"]) for r in job.group_similar().orderBy("name").collect()])
        if step == 0:
            png(folder / "3.png", media_plugins.picture(1))
    assert asked == [["0.png", "1.png", "2.png"], ["3.png"]]
    assert found == [[("0.png", 64), ("1.png", 64)], [(f"{i}.png", 64) for i in range(4)], [(f"{i}.png", 64) for i in range(4)]]


def test_compare_bytes(spark):
    raw = [png(os.devnull, media_plugins.picture(i)) for i in (1, 1, 2)]
    assert scan.compare_bytes(spark, raw[0], raw[1]) == 1.0 and scan.compare_bytes(spark, raw[0], raw[2]) < 1.0
    assert scan.compare_bytes(spark, raw[0], b"no picture") == 0.0


def test_registered_methods_can_be_scanned(spark, tmp_path):
    for i in range(4):
        png(tmp_path / f"{i}.png", media_plugins.picture(i % 3))
    registry.register_method("corner", lambda bgr: int(bgr[0, 0, 0]), "bigint", pairs.hash_pairs)
    with scan.DuplicateScan(spark, ScanConfig((str(tmp_path),), method="corner", threshold=1.0)) as job:
        assert [(r["id1"], r["id2"]) for r in job.find_duplicates().collect()] == [(0, 3)]
    with pytest.raises(ValueError, match="unknown method"):
        ScanConfig(method="nothing")


def test_cancelled_scan_leaves_nothing(spark, films):
    folder, _ = films
    run = Run(spark)

    def opener(path):
        run_seen.append(path)
        raise AssertionError

    run_seen = []
    job = scan.DuplicateScan(spark, ScanConfig((str(folder),), method="means", video_enabled=True, video_method="means"), opener=SlowVideo, run=run)
    import threading

    threading.Timer(4, run.cancel).start()
    with pytest.raises(Cancelled):
        job.media()
        job.frames()
    assert not os.path.exists(job.work.path.removeprefix("file://"))
    with pytest.raises(Cancelled):
        job.media()


class SlowVideo(media_plugins.TextVideo):
    def read(self):
        import time

        time.sleep(5)
        return super().read()


# Numbering --------------------------------------------------------------------------------------------------------


def test_order_without_a_task_for_all(spark):
    df = spark.createDataFrame([(f"k{i % 50:03}", i) for i in range(400)], "k string, v int").repartition(7)
    made = pairs.with_order(df, "k", "v")
    got = made.orderBy("k", "v").collect()
    assert [r["ord"] for r in got] == list(range(400))
    assert "SinglePartition" not in made._jdf.queryExecution().toString() and "Window" not in made._jdf.queryExecution().toString()
    assert pairs.with_order(df.limit(0), "k").collect() == []
