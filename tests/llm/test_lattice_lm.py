"""Lattice scores against listing all segmentations and against plain loops."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import lattice_lm, storage

SF = "/root/testdata/sf0.001"
SMALL = [(b"\xffab", 4.0), (b"\xffa", 2.0), (b"b", 3.0), (b"bc", 1.5), (b"abc", 1.0), (b"c", 1.0), (b"Ab", 9.0), (b"b", 1.0), ("é".encode(), 2.0), (b"\xff", 1.0)]


def segmentations(text, pieces):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        if text[:n] in pieces:
            for rest in segmentations(text[n:], pieces):
                yield [text[:n], *rest]


def test_totals_and_uses_equal_all_segmentations():
    v = lattice_lm.Vocabulary(SMALL)
    assert b"Ab" not in v.pieces and abs(v.prior.sum() - 1) < 1e-12
    assert v.prior[v.pieces.index(b"b")] == pytest.approx(4 * v.prior[v.pieces.index(b"c")])
    log_p = np.log(v.prior)
    words = [b"", b"a", b"abc", b"abcabcbb", "éàbc".encode(), b"zz", "▁a".encode(), b"a\x00b"]
    counts = np.array([1.0, 2, 3, 1, 5, 1, 1, 2])
    lattice = lattice_lm.Lattice(v, words)
    got, uses = lattice.totals(log_p), np.zeros(len(log_p))
    for word, count, total in zip(words, counts, got, strict=True):
        found = [([v.pieces.index(p) for p in s], math.prod(v.prior[v.pieces.index(p)] for p in s)) for s in segmentations(b"\xff" + word, v.pieces)]
        p = sum(x for _, x in found)
        assert total == pytest.approx(math.log(p), abs=1e-9)
        for s, x in found:
            for piece in s:
                uses[piece] += count * x / p
    assert np.allclose(lattice.expected(log_p, counts), uses)
    assert len(lattice_lm.Lattice(v, []).totals(log_p)) == 0


def test_long_words_do_not_underflow():
    v = lattice_lm.Vocabulary(SMALL)
    raw = b"\xff" + b"abcb" * 2000
    a = [0.0]
    for j in range(1, len(raw) + 1):
        a.append(np.logaddexp.reduce([a[i] + math.log(v.prior[v.pieces.index(raw[i:j])]) for i in range(max(0, j - 3), j) if raw[i:j] in v.pieces]))
    lattice = lattice_lm.Lattice(v, [b"b", raw[1:], b""])
    assert lattice.totals(np.log(v.prior))[1] == pytest.approx(a[-1]) and a[-1] < -3000
    uses = lattice.expected(np.log(v.prior), np.array([0.0, 2.0, 0.0]))
    assert (uses * [*map(len, v.pieces), 0]).sum() == pytest.approx(2 * len(raw))


def test_whole_vocabulary_adds_up():
    """Probabilities of all texts of a vocabulary without bytes of its own: what pieces give, lengths added up."""
    v = lattice_lm.Vocabulary([(b"\xff", 1.0), (b"a", 1.0), (b"aa", 1.0)])
    keep = [v.pieces.index(p) for p in (b"\xff", b"a", b"aa")]
    p = np.zeros(len(v.prior))
    p[keep], p[v.end] = (0.3, 0.3, 0.2), 0.2
    with np.errstate(divide="ignore"):
        totals = np.exp(lattice_lm.Lattice(v, [b"a" * n for n in range(200)]).totals(np.log(p)))
    # a word is its mark and any sequence of the other pieces, which add up to 0.5: the sum over all words is 0.3 / (1 - 0.5)
    assert totals.sum() == pytest.approx(0.6)


def plain_scores(rows, vocabulary, rounds, prior):
    """The operator's results by loops over dictionaries, word by word."""
    p = dict(zip([*vocabulary.pieces, None], vocabulary.prior, strict=True))
    longest = max(map(len, vocabulary.pieces))

    def edges(word):
        raw = b"\xff" + word
        return [(i, j, raw[i:j]) for i in range(len(raw)) for j in range(i + 1, min(len(raw), i + longest) + 1) if raw[i:j] in p], len(raw)

    def sums(word):
        found, n = edges(word)
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        a[0] = b[n] = 1.0
        for i, j, s in found:
            a[j] += a[i] * p[s]
        for i, j, s in reversed(found):
            b[i] += p[s] * b[j]
        return found, a, b

    train, every = collections.Counter(), [(i, t, (t or "").encode().lower().split()) for i, t in rows]
    ends = 0
    for i, _, words in every:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words)
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + (ends > 0)
    for _ in range(rounds if n else 0):
        use = collections.Counter({None: ends})
        for word, c in train.items():
            found, a, b = sums(word)
            for i, j, s in found:
                use[s] += c * a[i] * p[s] * b[j] / a[-1]
        start = dict(zip([*vocabulary.pieces, None], vocabulary.prior, strict=True))
        total = sum(use.values()) + prior
        p = {s: (use[s] + prior * start[s]) / total for s in p}
    out = []
    for i, _, words in every:
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        own = sum(math.log10(sums(w)[1][-1]) for w in words) + math.log10(p[None])
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(words) + 1, sum(train[w] > 0 for w in words) + (ends > 0), n, base, own))
    return out


ROWS = [(i, t) for i, t in enumerate([None, "", " \t\n", "One two  TWO\x0bthree", "é à ñ É", "日本語 ▁mark \x00nul", "the cat sat on the mat " * 30, "the dog", "x" * 40, "a b c\x85d"] * 3)]
ROWS += [(None, "the cat"), (None, None), ROWS[6], ROWS[6]]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize(("parts", "block"), [(1, 1 << 25), (3, 200)])
def test_query_equals_plain_loops(spark, tmp_path, monkeypatch, parts, block):
    monkeypatch.setattr(lattice_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lattice_lm, "LATTICE_BYTES", 40)
    df = spark.createDataFrame([(*r, "x", 1.0, "y") for r in ROWS], "doc_id long, text string, held_out string, score double, word string")
    df.repartition(parts).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = [tuple(r) for r in lattice_lm.op11_lattice_lm(spark, f"file://{tmp_path}").collect()]
    vocabulary = lattice_lm.Vocabulary.of_file(lattice_lm.default_path())
    want = plain_scores(ROWS, vocabulary, lattice_lm.ROUNDS, lattice_lm.PRIOR)
    assert len(got) == len(want)
    for g, w in zip(ordered(got), ordered(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_nothing_learned_and_empty_tables(spark):
    work = storage.Workspace(spark, "test")
    shape = "doc_id long, text string, score int"
    empty = spark.createDataFrame([], shape)
    assert lattice_lm.score_documents(empty, F.lit(True), work).columns == ["doc_id", *lattice_lm.RESULTS]
    assert lattice_lm.score_documents(empty, F.lit(True), work).collect() == []
    (only,) = lattice_lm.score_documents(spark.createDataFrame([(1, "a b", 0)], shape), F.lit(None).cast("boolean"), storage.Workspace(spark, "test")).collect()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (3, 0, 0, 0.0) and only["score"] < -3
    with pytest.raises(ValueError, match="named like"):
        lattice_lm.score_documents(empty, F.lit(True), work, keep=("score",))


def test_training_helps_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", lattice_lm.held_out(F.col("doc_id")).alias("held_out"))
    means = []
    for rounds in (0, 1, lattice_lm.ROUNDS):
        done = lattice_lm.score_documents(docs, ~F.col("held_out"), storage.Workspace(spark, "test"), keep=("doc_id", "held_out"), rounds=rounds)
        means.append(done.where("held_out").agg(F.sum("score") / F.sum("n_tokens")).collect()[0][0])
    assert means[0] + 1 < means[1] < means[2]
