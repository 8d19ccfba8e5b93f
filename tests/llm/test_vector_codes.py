"""Product codes by heap Lloyd against plain Lloyd and SQL."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import storage, vector_codes

SF = "/root/testdata/sf0.001"


def plain_lloyd(rows, parts, entries, rounds, scale):
    """(vec_id, code, error) by full scans with Python integers; rows are (vec_id, vector)."""
    fine = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(fine[0][1])
    own = [r for r in fine if len(r[1]) == dims]
    width = dims // parts
    out = [[i, "", 0] for i, _ in own]
    books = []
    for p in range(parts):
        x = [v[p * width : (p + 1) * width] for _, v in own]
        book = x[:entries]
        for r in range(rounds + 1):
            ds = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in x]
            found = [d.index(min(d)) for d in ds]
            if r < rounds:
                for e in range(len(book)):
                    mine = [v for v, f in zip(x, found, strict=True) if f == e]
                    if mine:
                        book[e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
        books.append(book)
        for o, f, d in zip(out, found, ds, strict=True):
            o[1] += f"{f:02x}"
            o[2] += d[f]
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    return [tuple(o) for o in out] + [(i, None, None) for i, v in fine if len(v) != dims], digest


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (240, 8))
    base[40:90] = base[7]  # copies, ties between equal entries
    base[100:130] = np.round(base[100:130] * 4) / 4
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf"), *[0.0] * 7]), (504, [0.5] * 4), (505, []), (None, rows[3][1]), rows[9], rows[9], (-4, [0.0] * 8)]
    return rows


@pytest.mark.parametrize(("entries", "rounds", "block"), [(16, 4, 64), (16, 0, 1 << 20), (300, 2, 640), (1, 3, 160)])
def test_codes_equal_plain_lloyd(spark, odd_rows, monkeypatch, entries, rounds, block):
    monkeypatch.setattr(vector_codes, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(vector_codes, "SCAN_ROWS", 50)
    df = spark.createDataFrame([(*r, "x", i % 3) for i, r in enumerate(odd_rows)], "vec_id long, embedding array<float>, code string, label int").repartition(3)
    done = vector_codes.compress(df, storage.Workspace(spark, "test"), parts=4, entries=entries, rounds=rounds, keep=("label",))
    want, digest = plain_lloyd(odd_rows, 4, entries, rounds, 1024)
    if entries > 256:
        assert all(len(r["code"]) == 16 for r in done.rows.where("code IS NOT NULL").collect())
        assert ordered((r["vec_id"], r["error"]) for r in done.rows.collect()) == ordered((i, e) for i, _, e in want)
    else:
        assert ordered((r["vec_id"], r["code"], r["error"]) for r in done.rows.collect()) == ordered(want)
    assert done.books.digest() == digest
    assert done.rows.columns == ["vec_id", "label", "code", "error"]


def test_heaps_spare_most_scans(spark):
    """Parts in tight clusters: once entries rest, next to nothing is popped."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (32, 8))
    x = np.concatenate([centres, centres[rng.integers(0, 32, 3000)] + rng.normal(0, 0.02, (3000, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    done = vector_codes.compress(df, storage.Workspace(spark, "test"), parts=2, entries=32, rounds=4)
    assert done.scanned[0] == 2 * len(rows)
    assert all(n < 0.3 * done.scanned[0] for n in done.scanned[1:])


def test_heaps_survive_packing():
    heaps = vector_codes.SlackHeaps.empty(1, 2)
    rng = np.random.default_rng(1)
    keys = np.concatenate([rng.normal(0, 1, 100), [np.inf]])
    heaps.push(0, rng.integers(0, 2, 101), keys, np.arange(101))
    again = vector_codes.SlackHeaps.unpacked(heaps.packed(), 1, 2)
    rows, entries = again.pop(0, np.array([0.3, -0.2]))
    owner = heaps.assigned(0, 101)
    assert sorted(rows) == [i for i in range(101) if keys[i] <= (0.3, -0.2)[owner[i]]] and (owner[rows] == entries).all()
    assert len(again.pop(0, np.array([1e300, 1e300]))[0]) + len(rows) == 100  # a part without a second entry never comes


def test_large_components():
    x = np.array([[2**25, -(2**25)], [2**25 - 1, 1 - 2**25], [0, 3]], np.int64)
    found, upper, lower = vector_codes.nearest(x, x[::-1].copy())
    assert found.tolist() == [2, 1, 0] and upper.tolist() == [0, 0, 0] and lower[0] == np.sqrt(2)


def test_refusals_and_empty_tables(spark):
    work = storage.Workspace(spark, "test")
    shape = "vec_id long, embedding array<float>, code int"
    assert vector_codes.compress(spark.createDataFrame([], shape), work).rows.collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0)], shape), work)
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 0)], shape), work)
    with pytest.raises(ValueError, match="named like"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0], 0)], shape), work, keep=("code",))


def test_query_matches_sql_in_any_layout(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    cursor = db.execute(vector_codes.ORACLE_OP13)
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(r) for r in cursor.fetchall())
    got = vector_codes.op13_vector_codes(spark, SF)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want
    spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("label", F.expr("if(label = 2, null, label)")).repartition(5, F.rand(3)).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    other = vector_codes.op13_vector_codes(spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in other.select("vec_id", "code", "error").collect()) == [r[:3] for r in want]
    nulls = other.join(spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("label IS NULL").select("vec_id"), "vec_id")
    assert nulls.select("label_error").distinct().count() == 1 and nulls.agg(F.sum("error") - F.max("label_error")).collect()[0][0] == 0
