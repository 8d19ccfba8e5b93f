import collections
import math

import duckdb
import numpy as np
import pytest

from twinsieve.llm import quality, storage, topk

SF = "/root/testdata/sf0.001"


def _brute(rows, queries, k):
    rows = [r for r in rows if r[1] != []]
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, qv in {i: v for i, v in fine if i in queries}.items():
        scored = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in fine if i != q and len(v) == len(qv)))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("query_rows", [None, 8])
def test_top_k_by_brute_force(spark, query_rows, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 32768 if query_rows is None else 70)
    monkeypatch.setattr(topk, "BLOCK_CANDIDATES", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(0, 0.3, (300, 40))
    base[50:90] = base[7]  # ties
    base[100:120] *= 30
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(300, None), (301, [None, *rows[0][1][1:]]), (302, [float("nan"), *rows[0][1][1:]]), (303, [float("inf"), *rows[0][1][1:]]), (None, rows[1][1]), (304, [0.5, 0.5]), (306, [0.25, 1.0]), rows[7], (308, []), (350, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 50 = 0 OR vec_id IN (7, 51, 304)")
    got = {tuple(r) for r in topk.top_k(df, asked, 5, query_rows=query_rows).collect()}
    assert got == _brute(rows, {i for i, _ in rows if i is not None and (i % 50 == 0 or i in (7, 51, 304))}, 5)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    want = {tuple(int(x) for x in r) for r in db.sql(topk.ORACLE_OP10).fetchall()}
    assert {tuple(r) for r in topk.op10_exact_top_k(spark, SF).collect()} == want


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "n-gram jaccard join", "mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, counts, columns = storage.Workspace(spark, "test"), [], docs.columns
    for i, (_, stage) in enumerate(p.STAGES):
        before = docs
        docs = kept.table(stage(spark, docs, SF), str(i))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = quality.scored(spark.read.parquet(f"{SF}/documents.parquet"), model)
    assert counts[0] == scored.where(scored["score"] >= 0.3).count()
    assert counts[1] <= counts[0] and counts[2] <= counts[1]
    mixed = collections.Counter(r["doc_id"] for r in kept.spark.read.parquet(f"{kept.path}/3").collect())
    pieces = collections.Counter(r["doc_id"] for r in docs.where("piece = 0").collect())
    assert mixed == pieces and max(mixed.values()) <= 2
    assert p.run(spark, SF).count() == counts[-1]


def test_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    long = "a b " * 400
    rows = [(None, None, None, None, None, 1, "x"), (1, "", "en", "", 0, 2, "y"), (2, long, "en", "s", 9, 3, None), (2, long, "en", "s", 9, 3, None), (3, "word", None, None, None, None, None), (5, long, "en", "s", 9, 4, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, score string"
    found = {}
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        path = f"file://{tmp_path}/{len(some)}"
        docs.write.parquet(path)
        for name, stage in p.STAGES:
            out = stage(spark, spark.read.parquet(path), SF)
            found[name, len(some)] = [tuple(r) for r in out.collect()]
            if name != "best-fit packing":
                assert out.columns == docs.columns
    n = len(rows)
    assert all(not found[name, 0] for name, _ in p.STAGES)
    assert set(found["quality classifier", n]) <= set(rows)
    assert sorted(found["exact dedup", n], key=str) == sorted([rows[1], rows[2], rows[4]], key=str)  # the null text equals the empty one
    assert sorted(found["n-gram jaccard join", n], key=str) == sorted([rows[0], rows[1], rows[2], rows[4]], key=str)
    mixed = collections.Counter(found["mixing", n])
    assert set(mixed) <= set(rows) and all(mixed[r] <= 2 * rows.count(r) for r in mixed)
    pieces = found["best-fit packing", n]
    assert collections.Counter(r[0] for r in pieces) == collections.Counter(r[0] for r in rows) and len({r[5] for r in pieces}) == 1


def test_votes_equal_plain_cosines():
    """Each score by a loop over the whole sample, ties at the border included."""
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in ("ba", "lo", "ti", "##", "9") for b in ("na", "ri", "$$", "so")]
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)))).encode() for _ in range(60)]
    texts += texts[:10] + [b"", b""]  # equal vectors
    labels = rng.integers(0, 2, len(texts))
    matrix = np.stack([quality.terms(t) for t in texts])
    model = quality.LatentVotes(matrix, labels, 12)
    asked = np.concatenate([matrix[:20], np.stack([quality.terms(t) for t in (None, b"bana lori", b"$$$$ 9so " * 50)])])
    got = model.score(asked, 5, 8.0)
    own, prior = model.latent(asked) @ model.vectors.T, float(labels.astype(np.float32).mean())
    for cosines, score in zip(own, got, strict=True):
        near = sorted(range(len(texts)), key=lambda i: (-cosines[i], i))[:5]
        weights = [math.exp(8.0 * (cosines[i] - cosines[near[0]])) * max(0.0, cosines[i]) for i in near]
        assert score == pytest.approx((sum(w * labels[i] for w, i in zip(weights, near, strict=True)) + 1e-3 * prior) / (sum(weights) + 1e-3), abs=1e-5)


def test_repeated_candidates_fill_no_block(spark):
    """A third of the rows have one id: each block of candidates has some of them, and they all count."""
    rows = [(7, [1.0, 2.0])] * 400 + [(i + 10, [i % 7 / 4, 0.5]) for i in range(800)] + [(0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = topk.top_k(df, df.where("vec_id = 0"), 500, candidate_rows=100)
    ranked = [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()]
    assert ranked[:400] == [(7, 256 * 256 * 3)] * 400 and len(ranked) == 500 and ranked[400][1] == 256 * (384 + 128)


def test_clashing_columns_of_vectors_are_ignored(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], "s", 1, 2) for i in range(6)], "vec_id long, embedding array<float>, score string, rank int, query_id int")
    got = topk.top_k(df, df.where("vec_id = 0"), 2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.count() == 2
