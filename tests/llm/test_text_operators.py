"""Operators over documents against brute force, on odd tables and on the smallest test table."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.llm import exact_dedup, jaccard, mixing, packing, quality, sharding, storage, substring_dedup, suffix_dedup, token_output, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, name string, score string, doc string"


def _odd_rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words) for _ in range(400))
    edited = base.split()
    edited[200] = "changed"
    texts = [None, "", " ", "one", "One", "two words", base, base, base.replace(" ", "\t\n", 5), base.upper(), " ".join(edited), "x" * 500, "x" * 300]
    texts += ["é" * 80 + " tail", "日本語 " * 60, "\x00 odd \x85 é", base[:300] + " other " + base[900:], base + " " + " ".join(words * 40)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0, i, "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, "s1", None, 0, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('odd')}/documents.parquet"
    spark.createDataFrame(_odd_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def work(spark):
    return storage.Workspace(spark, "test")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", [F.xxhash64, lambda b: F.crc32(F.encode(b, "UTF-8")) % 3], ids=["hash", "clashing"])
@pytest.mark.parametrize("block", [7, 4096])
def test_exact_groups(spark, odd, block, digest):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = rows_of(odd)
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    got = exact_dedup.exact_groups(odd, work(spark), block, digest=digest).collect()
    want = collections.Counter()
    for d, t in rows:
        own = groups[norm(t)]
        known = [x for x in own if x is not None]
        want[d, min(known) if known else None, len(own), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_keeps_columns(spark, odd, empty):
    kept = exact_dedup.exact_dedup(odd, work(spark))
    assert kept.columns == odd.columns and kept.count() < odd.count()
    assert exact_dedup.exact_groups(empty, work(spark)).count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty, small):
    for docs in (odd, small):
        got = sharding.shard(docs, 8).collect()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, _ in rows_of(docs))
        counts = collections.Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(8))
        for s, n in counts.items():
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    texts = dict(rows_of(small))
    for r in sharding.shard(small, 8).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard(empty, 8).count() == 0


def test_few_rows_move(spark, small):
    """With slack, a row goes to the first shard clockwise unless that is full, and one more shard moves few rows."""
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(big, 8, slack=0.25).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(big, 9, slack=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)
    assert max(collections.Counter(a.values()).values()) <= 1.25 * 500 + 1


def test_settling_matches_one_by_one():
    positions, owners = sharding.ring(4, 8)
    rng = random.Random(1)
    counts = {arc: rng.randrange(5) for arc in range(len(owners))}
    total = sum(counts.values())
    dealt = sharding.settle(counts, owners, [-(-total // 4)] * 4)
    assert {a: sum(n for _, n in d) for a, d in dealt.items()} == counts
    for arc, d in dealt.items():
        wish = sharding.preferences(owners, arc, 4)
        assert [wish.index(s) for s, _ in d] == sorted(wish.index(s) for s, _ in d)


# 5, 9 -------------------------------------------------------------------------------------------------------------


def _ids(text):
    return tokens.encoder(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_cache_gives_the_librarys_ids(small):
    odd = ["I'm HERE's it'll  don't\x1cx", "a<|endoftext|>b <|EndOfText|>", "Ångström ẞ H̱ İx ΣΣ", "中文 م 12345 3.14 ªºµ ×÷ \x00\x7f", "\x85a b c", "'S 'RE o'Clock .. ,,a.b", ""]
    e = tokens.Encoder(tokens.default_path(), 50)
    for t in odd + [t for _, t in rows_of(small)][:40]:
        assert np.frombuffer(e.encode(t.encode()), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def _one_by_one(lengths, capacity):
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rest if r >= n]
        if fits:
            rest.remove(min(fits))
            rest.append(min(fits) - n)
        else:
            rest.append(capacity - n)
    return rest


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_rules_equal_one_by_one(seed):
    rng = random.Random(seed)
    capacity = 60
    lengths = [rng.choice([rng.randint(1, capacity), 7, 20]) for _ in range(rng.choice([0, 1, 400]))]
    counts = collections.Counter(lengths)
    rules = packing.best_fit_decreasing(dict(counts), capacity)
    bins, placed = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, first, offset in rules:
        for k in range(hi - lo):
            bins[first + k].append((offset, length))
            placed[length, lo + k] += 1
    assert placed == collections.Counter((n, i) for n in counts for i in range(counts[n]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in c) for c in bins.values()) == sorted(_one_by_one(lengths, capacity))


def test_packing(spark, odd, empty):
    got = packing.pack(odd, capacity=64).collect()
    want = collections.Counter()
    for d, t in rows_of(odd):
        ids = _ids(t)
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) == len(_one_by_one([r["length"] for r in got], 64))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("wide", [False, True])
def test_token_files(spark, odd, empty, wide):
    out = work(spark).path
    shards = token_output.write_tokens(odd, out, wide=wide)
    got = token_output.read_tokens(spark, out, shards, wide=wide).collect()
    want = collections.Counter((d, len(_ids(t)), zlib.crc32(np.array(_ids(t), "<u4").tobytes())) for d, t in rows_of(odd))
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [0, *np.cumsum([r["n_tokens"] for r in ordered])[:-1]]
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in ordered), key=lambda d: (d is not None, d or 0))
    raw = b"".join(open(f"{out.removeprefix('file://')}/{s:05d}.bin", "rb").read() for s, *_ in shards)
    assert len(raw) == (4 if wide else 2) * sum(r["n_tokens"] for r in got)
    none = work(spark).path
    assert token_output.read_tokens(spark, none, token_output.write_tokens(empty, none)).count() == 0


# 6 ----------------------------------------------------------------------------------------------------------------


def _components(rows, size, threshold):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = collections.Counter()
    for i, (d, _) in enumerate(rows):
        known = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out[d, len(sets[i]), min(known) if known else None, links[i]] += 1
    return out


@pytest.mark.parametrize("bounds", [(1024, 2_000_000), (2, 50)], ids=["whole", "cut"])
def test_jaccard_components(spark, odd, small, empty, bounds, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", bounds[0])
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", bounds[1])
    for docs, size, threshold in ((odd, 4, 85), (small, 4, 60)):
        got = jaccard.jaccard_components(docs, work(spark), size, threshold).collect()
        assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == _components(rows_of(docs), size, threshold)
    assert jaccard.jaccard_components(empty, work(spark)).count() == 0


def test_compared_sets_by_brute_force():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 60, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(0, 2**60, 60, dtype=np.uint64), base)) for _ in range(80)]
    weights = rng.integers(1, 4, len(sets))
    for sides in (np.zeros(len(sets), int), rng.integers(1, 3, len(sets))):
        links, edges = jaccard.compare_sets(sets, weights, sides, 70)
        forest = jaccard.Forest(len(sets))
        for i, a in enumerate(sets):
            want = 0
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                if i != j and (not sides[i] or sides[i] != sides[j]) and 100 * both >= 70 * (len(a) + len(b) - both):
                    want += weights[j]
                    forest.join(i, j)
            assert links[i] == want
        other = jaccard.Forest(len(sets))
        for x, y in edges:
            other.join(x, y)
        assert [forest.root(i) for i in range(len(sets))] == [other.root(i) for i in range(len(sets))]


def test_near_dedup_keeps_one_of_each(spark, odd):
    kept = jaccard.near_dedup(odd, work(spark), 5, 80)
    assert kept.columns == odd.columns
    groups = len({r["component_id"] if r["n_shingles"] else id(r) for r in jaccard.jaccard_components(odd, work(spark), 5, 80).collect()})
    assert kept.count() == groups


# 7 ----------------------------------------------------------------------------------------------------------------


def _water(sizes, share, most, weights):
    total, held = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(most * sizes[i] for i in held)
        level = rest / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in held else level * weights[i] for i in range(len(sizes))]
        held |= over


def test_mixing(spark, odd, small, empty):
    for docs in (odd, small):
        got = mixing.mix(docs, work(spark), keep=["doc_id", "source", "text"]).collect()
        again = mixing.mix(docs, work(spark), keep=["doc_id", "source", "text"]).collect()
        key = lambda r: (r["doc_id"], r["copies"], r["size"], r["target"])
        assert collections.Counter(map(key, got)) == collections.Counter(map(key, again))
        assert len(got) == docs.count()
        names = sorted({r["source"] for r in got}, key=lambda s: (s is None, s))
        sizes = [sum(r["size"] for r in got if r["source"] == s) for s in names]
        want = _water(sizes, 1.5, 2.0, [(5, 2, 1)[i % 3] for i in range(len(names))])
        for s, n, t in zip(names, sizes, want, strict=True):
            own = [r for r in got if r["source"] == s]
            assert all(r["source_size"] == n and r["target"] == pytest.approx(t) for r in own)
            assert all(0 <= r["copies"] <= 2 for r in own)
            # The selection ends at the document nearest to the target; exchanges only bring it nearer.
            taken = sum(r["copies"] * r["size"] for r in own)
            assert abs(taken - t) <= max(r["size"] for r in own) / 2 + 1
        for r in got:
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert mixing.mix(empty, work(spark)).count() == 0


def test_layout_of_the_table_decides_nothing(spark):
    """Mixing and sharding: whatever the parts and the order of rows, the same rows come out."""
    rng = random.Random(12)
    rows = [(i, f"s{min(i % 7, 3)}", " ".join("w" * rng.choice((0, 1, 1, 2, 3)) + f"{i}" for _ in range(rng.choice((0, 0, 3, 4, 5))))) for i in range(300)]
    rows += [(i, "empty", "") for i in range(300, 340)] + [(400, "empty", "one two three"), (401, "big", "word " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed, dealt = [], []
    for parts in (1, 3, 7):
        own = docs.orderBy(F.xxhash64(F.lit(parts), "doc_id")).repartition(parts)
        got = mixing.mix(own, work(spark), keep=["doc_id"]).collect()
        assert all(r["copies"] <= 2 for r in got)
        mixed.append(collections.Counter(tuple(r) for r in got))
        dealt.append(collections.Counter(tuple(r) for r in sharding.shard(own).collect()))
    assert mixed[0] == mixed[1] == mixed[2]
    assert dealt[0] == dealt[1] == dealt[2]


def test_few_rows_move_without_slack(spark, small):
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.shard(small, n).collect()} for n in (8, 9))
    moved = [d for d in before if before[d] != after[d]]
    assert len(moved) <= 0.25 * len(before) and sum(after[d] == 8 for d in moved) >= len(moved) / 2


def test_narrow_token_files_refuse_wide_ids():
    with pytest.raises(ValueError):
        token_output._narrow(np.array([1, 70000], "<u4").tobytes())


def test_mixing_loses_none_of_many_sources(spark):
    """Several range partitions: each source is numbered once, in order, whatever the plan makes of the partitions."""
    n, before = 300_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("s%07d", "id").alias("source"), F.lit("one two").alias("text"))
        mixed = mixing.mix(docs, work(spark), keep=["doc_id", "source"])
        got = {(r["turn"], round(r["target"], 6)): r["count"] for r in mixed.groupBy((F.col("doc_id") % 3).alias("turn"), "target").count().collect()}
        assert got == {(i, round(t, 6)): n // 3 for i, t in enumerate(_water([2] * 3, 1.5, 2.0, [5, 2, 1]))}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_mixing_keeps_clashing_columns_on_request(spark, odd):
    whole = odd.select("doc_id", "source", "text", F.struct(*odd.columns).alias("doc"))
    assert mixing.mix(whole, work(spark), keep=["doc"]).select("doc.*").columns == odd.columns


# 8 ----------------------------------------------------------------------------------------------------------------


def _removed(rows, length):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], d)
    out = collections.Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            f = first[b[p : p + length]]
            if f != d and (f is None or (d is not None and f < d)):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length,limit", [(50, 1_000_000), (50, 10), (30, 1_000_000)])
def test_suffix_dedup(spark, odd, small, empty, length, limit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM_BYTES", limit)
    for docs in (odd, small) if length == 50 else (odd,):
        got = suffix_dedup.suffix_dedup(docs, work(spark), length).collect()
        assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == _removed(rows_of(docs), length)
    assert suffix_dedup.suffix_dedup(empty, work(spark)).count() == 0


def test_suffix_dedup_returns_what_is_left(spark):
    docs = spark.createDataFrame([(1, "a" * 10 + "b" * 60 + "c"), (2, "zz" + "b" * 60 + "yy")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, work(spark), with_text=True).collect()}
    assert bytes(got[2]["kept"]) == b"zzyy" and got[2]["spans"] == [2, 62] and got[1]["spans"] == []


def test_anchors_of_long_texts_follow_the_content(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdef ") for _ in range(5000))
    whole = [at for _, a, _ in suffix_dedup._anchors_of(pa.array([text], pa.binary()), 50) for at in a.tolist()]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    cut = [at for _, a, _ in suffix_dedup._anchors_of(pa.array([text], pa.binary()), 50) for at in a.tolist()]
    assert sorted(set(cut)) == whole


def test_strings_of_hot_anchors():
    rng = random.Random(6)
    base = bytes(rng.choice(b"abcd") for _ in range(84))
    contexts = list({base[:34] + base[34:50] + bytes(rng.choice(b"xy") if rng.random() < 0.1 else c for c in base[50:]) for _ in range(60)})
    contexts += [base[k:] for k in (3, 20)] + [b"zz" + base[5:70]]
    docs = np.array([rng.randrange(9) for _ in contexts])
    want = suffix_dedup.earlier_strings(contexts, docs, 50)
    for at_once in (10, 10**6):
        assert suffix_dedup.earlier_strings_of_hot(contexts, docs, 50, at_once).tolist() == want.tolist()


@pytest.mark.parametrize("seed", range(4))
def test_transform_intervals(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 4, 300), 0).astype(np.uint16)  # symbols from 1, and a terminator, as required
    order, boundary = suffix_dedup.repeated_intervals(text, 6)
    padded = np.concatenate([text, np.full(6, 9, np.uint16)])
    for i in range(1, len(text)):
        a, b = order[i - 1], order[i]
        if max(a, b) + 6 <= len(text):
            assert bool(boundary[i]) == (padded[a : a + 6].tolist() != padded[b : b + 6].tolist())


# 2 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sources", [4, 1])
def test_passages(spark, odd, small, empty, sources):
    for docs in (small, odd):
        rows = rows_of(docs)
        got = [tuple(r) for r in substring_dedup.passages(docs, work(spark), sources=sources).collect()]
        spans, n, first = collections.defaultdict(list), 50, {}
        for d, s, a, b in got:
            spans[d].append((a, b))
            assert s is None or s < d
            assert b - a >= n
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
            w = (t or "").encode().lower().split()
            for p in range(len(w) - n + 1):
                f = first.setdefault(tuple(w[p : p + n]), d)
                if f != d and d is not None:
                    assert any(a <= p and p + n <= b for a, b in spans[d])
    assert substring_dedup.passages(empty, work(spark)).count() == 0


def test_near_passage_is_found(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    shared = [rng.choice(words) for _ in range(120)]
    other = [*shared[:60], "edit", *shared[61:]]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    docs = spark.createDataFrame([(1, " ".join(fill(80) + shared + fill(50))), (2, " ".join(fill(33) + other + fill(70))), (3, " ".join(fill(200)))], "doc_id long, text string")
    got = substring_dedup.passages(docs, work(spark)).collect()
    assert [(r["doc_id"], r["source_id"]) for r in got] == [(2, 1)]
    assert got[0]["start_word"] <= 34 and got[0]["end_word"] >= 150


def _edited(rng, base, fresh):
    out = list(base)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = [next(fresh)] if kind < 2 else []
    return out


def _near(a, b, similarity):
    return len(a & b) >= similarity * len(a | b) - 1e-9


@pytest.mark.parametrize("seed", range(24))
def test_chained_sequences_by_brute_force(seed):
    """Sequences of any lengths with insertions, deletions, changes and repeats; each is found, and nothing else is."""
    rng, width, similarity = random.Random(seed), 7, 0.7
    fresh = iter(range(10**6, 10**7))
    base = [rng.choice(range(6 if seed % 3 == 0 else 1000)) for _ in range(16)]
    x = [next(fresh) for _ in range(3)] + base + [next(fresh) for _ in range(3)]
    y = [next(fresh) for _ in range(4)] + _edited(rng, base, fresh) + [next(fresh) for _ in range(2)]
    if seed % 4 == 1:
        y = y[11:] + y[:11]
    got = np.zeros(len(x), bool)
    others = [(k, m, set(y[k:m])) for k in range(len(y)) for m in range(k + width, len(y) + 1)]
    for first, last in substring_dedup.chained(np.array(x, np.uint64), np.array(y, np.uint64), width, similarity):
        got[first : last + width] = True
        assert any(_near(set(x[first : last + width]), b, similarity) for _, _, b in others)
    want = np.zeros(len(x), bool)
    for i in range(len(x)):
        for j in range(i + width, len(x) + 1):
            a = set(x[i:j])
            if any(x[i] == y[k] and x[j - 1] == y[m - 1] and _near(a, b, similarity) for k, m, b in others):
                want[i:j] = True
    assert not (want & ~got).any()


def test_sequences_with_inserted_and_deleted_words_are_found(spark):
    rng = random.Random(4)
    word = (f"u{i}" for i in range(10**6))
    fill = lambda n: [next(word) for _ in range(n)]
    rows, spans = [], {}

    def plant(base, other):
        d = len(rows)
        rows.append((d, " ".join(fill(60) + base + fill(60))))
        rows.append((d + 1, " ".join(fill(rng.randint(30, 90)) + other + fill(60))))
        at = rows[-1][1].split().index(other[0])
        spans[d + 1] = (d, at, at + len(other))

    for back in (False, True):
        for words, places in ((88, [44]), (880, range(44, 880, 44)), (88, [44, 44]), (200, [44, 88, 132])):
            base, other = fill(words), []
            for i, w in enumerate(base):
                other += fill(sum(p == i for p in places)) + [w]
            plant(*((other, base) if back else (base, other)))
    got = {r["doc_id"]: (r["source_id"], r["start_word"], r["end_word"]) for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string"), work(spark)).collect()}
    assert set(got) == set(spans)
    for d, (source, start, end) in spans.items():
        assert got[d][0] == source and got[d][1] <= start and got[d][2] >= end, d


def _rule(**changed):
    given = {"folder": "", "blocks": 1, "size": 5, "width": 46, "similarity": 0.8, "hashes": 8, "enough": 4, "sources": 4}
    return substring_dedup.Rule(**(given | changed))


def test_equal_places_of_one_repeated_shingle_are_not_similarity():
    rng = np.random.default_rng(1)
    x, y = (np.full(46, 5, np.uint64) for _ in range(2))
    for t in (x, y):
        t[[3, 13, 23, 33, 43]] = rng.integers(10, 2**60, 5, dtype=np.uint64)
    near = np.zeros(1, bool)
    substring_dedup.near_starts(substring_dedup.Segment(y, _rule()), substring_dedup.Segment(x, _rule()), near, 1)
    assert not near.any()


@pytest.mark.parametrize("seed", range(6))
def test_compact_windows_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    h, width = rng.integers(0, 9 if seed % 2 else 2**60, 70, dtype=np.uint64) << np.uint64(30), 7
    left, place, right = (x.tolist() for x in substring_dedup.compact_windows(h, width))
    holds = collections.Counter()
    for a, c, b in zip(left, place, right, strict=True):
        assert b - a + 1 >= width
        holds.update((i, j, c) for i in range(a, c + 1) for j in range(c, b + 1))
    for i in range(len(h)):
        for j in range(i + width - 1, len(h)):
            assert holds[i, j, i + int(np.argmin(h[i : j + 1]))] == 1  # the first of equals


def _passage_truth(texts, words=50, size=5, similarity=0.8):
    """Starts of sequences of 50 words, by document, near one of 50 or 51 or 49 and what is around in an earlier one."""
    sets = []
    for t in texts:
        g = [tuple(t[i : i + size]) for i in range(len(t) - size + 1)]
        width = words - size + 1
        sets.append([set(g[i : i + width]) for i in range(len(g) - width + 1)])
    out = collections.defaultdict(set)
    for d in range(len(texts)):
        for e in range(d):
            index = collections.defaultdict(set)
            for j, b in enumerate(sets[e]):
                for x in b:
                    index[x].add(j)
            for i, a in enumerate(sets[d]):
                if i in out[d]:
                    continue
                at = set().union(*[index[x] for x in a]) if a else ()
                if any(_near(a, sets[e][j], similarity) for j in at):
                    out[d].add(i)
    return out


def _near_somewhere(x, y, words=50, most=65, size=5, similarity=0.8):
    """Whether any sequence of x of 50 words or more is near one of y, whatever their lengths."""
    gx, gy = ([tuple(t[i : i + size]) for i in range(len(t) - size + 1)] for t in (x, y))
    if len(set(gx) & set(gy)) < similarity * (words - size + 1):
        return False
    lengths = range(words - size + 1, most)
    others = [set(gy[i : i + n]) for n in lengths for i in range(len(gy) - n + 1)]
    return any(_near(set(gx[i : i + n]), b, similarity) for n in lengths for i in range(len(gx) - n + 1) for b in others)


@pytest.mark.parametrize("kind", ["insert", "delete", "change", "two changes", "mixed"])
@pytest.mark.parametrize("sources", [4, 1])
def test_recall_of_near_passages_by_brute_force(spark, kind, sources):
    """All pairs of sequences of 50 words: what is reported is near, and at least nine tenths of what is near is found."""
    rng = random.Random(len(kind))
    fresh = (f"n{i}" for i in range(10**6))
    fill = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for _ in range(20):
        base = fill(60 if kind == "two changes" else 50)
        for copy in range(3):
            own = list(base)
            if copy:
                edits = {"insert": "i", "delete": "d", "change": "c", "two changes": "cc", "mixed": rng.choice("idc")}[kind]
                for e in edits:
                    at = rng.randrange(1, len(own) - 1)
                    own[at : at + (e != "i")] = fill(e != "d")
            texts.append(fill(rng.randint(20, 60)) + own + fill(rng.randint(20, 60)))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = collections.defaultdict(list)
    for r in substring_dedup.passages(docs, work(spark), sources=sources).collect():
        got[r["doc_id"]].append((r["start_word"], r["end_word"]))
    truth = _passage_truth(texts)
    found = sum(any(a <= s and s + 50 <= b for a, b in got[d]) for d in truth for s in truth[d])
    total = sum(map(len, truth.values()))
    assert total and found >= 0.9 * total
    for d, spans in got.items():
        for a, b in spans:
            assert any(a <= s < b for s in truth[d]) or any(_near_somewhere(texts[d][a:b], texts[e]) for e in range(d))


# 3 ----------------------------------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs.select("doc_id", "text"), model).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(flags[d] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in flags)
    out = quality.scored(odd, model, column="score_")
    assert out.columns == [*odd.columns, "score_"] and out.count() == odd.count()
    assert quality.scored(empty, model).count() == 0
    assert quality.fit(docs, labels.where("false")) is None
    assert {r["score"] for r in quality.scored(odd, None).collect()} == {0.5}


def test_no_neighbour_has_a_say_of_labels_it_lacks():
    matrix = np.stack([quality.terms(t) for t in (b"plain words here and there", b"### $$$ %%% ###", b"more plain words to read")])
    model = quality.LatentVotes(matrix, np.array([1, 0, 1]), 2)
    s = model.score(np.stack([quality.terms(b"words to read here"), quality.terms(b"%%% ### $$$")]), 1, 8.0)
    assert s[0] > 0.9 and s[1] < 0.1


def test_shared_folder_is_the_sessions(spark):
    assert storage.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    w = work(spark)
    w.table(spark.range(3), "t")
    assert os.path.isdir(w.path.removeprefix("file://"))
    w.drop()
    assert not os.path.exists(w.path.removeprefix("file://"))
