"""Spelling variants against all pairs by plain edit distance, and against SQL."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import pytest

from twinsieve.llm import spelling, storage

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def groups_of(words, ratio):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o))
        if words[best] >= ratio * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def test_groups_equal_all_pairs(spark):
    """Words of few letters: many near pairs, equal bigrams in one word, edits at every place."""
    rng = random.Random(4)
    words = {}
    for letters, count in (("ab", 150), ("abcdé", 200), ("aàÿ×z", 100), ("abcdefghijklmnopqrstuvwxyz", 60)):
        for _ in range(count):
            w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
            for _ in range(3):
                words[w] = 5 ** rng.randint(0, 5) + rng.randint(0, 3)
                i = rng.randrange(len(w) + 1)
                w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :] if len(w) > 4 else w, w[:i] + rng.choice(letters) + w[i + 1 :]])
    words |= {"x" * 3000: 7, "x" * 3001: 70, "日本語日本語": 5, "日本語日本": 25, "😀😀😀😀😀😀": 9, "😀😀😀😀😀": 1}
    for shuffle in (1, 5):
        df = spark.createDataFrame([*words.items(), (None, 8)], "word string, n int").repartition(shuffle)
        got = spelling.spelling_groups(df, storage.Workspace(spark, "test"))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == groups_of(words, 5)


def test_long_chain_of_forms(spark):
    words = {"a" * (6 + i): 5**i for i in range(20)}
    got = {r["word"]: r["root"] for r in spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"), storage.Workspace(spark, "test")).collect()}
    assert set(got.values()) == {"a" * 25} and set(got) == set(words)


def test_refusals_and_empty_tables(spark):
    work = storage.Workspace(spark, "test")
    shape = "word string, n long, form string"
    assert spelling.spelling_groups(spark.createDataFrame([], shape), work).collect() == []
    with pytest.raises(ValueError, match="four"):
        spelling.spelling_groups(spark.createDataFrame([("abc", 1, "")], shape), work)
    with pytest.raises(ValueError, match="ratio"):
        spelling.spelling_groups(spark.createDataFrame([("abcd", 1, "")], shape), work, ratio=1)


def words_of(rows):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(9)
    names = ["Spelling", "spelling", "ÉCOLES", "écoles", "Ünÿ×÷ab", "variant", "variante", "grouped", "groped", "abcdefg" * 30]
    rows = [(i, " ".join(rng.choice(names) for _ in range(60))) for i in range(80)]
    rows += [(None, "grouped " * 40), (90, None), (91, ""), (92, "日本語 12345 !!"), rows[3], rows[3]]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    want = groups_of(words_of(rows), 5)
    assert {tuple(r) for r in spelling.op12_spelling_variants(spark, f"file://{tmp_path}").collect()} == want and any(r[1] for r in want)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = {tuple(r) for r in db.execute(spelling.ORACLE_OP12).fetchall()}
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) and any(r[1] for r in got)
