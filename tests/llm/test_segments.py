"""What op2 sends and keeps of its segments."""

import numpy as np

from twinsieve.llm import exchange, jaccard, storage
from twinsieve.llm import substring_dedup as s


def _prose(count, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    return [vocabulary[(2000 * rng.random(int(n)) ** 3).astype(int)] for n in rng.integers(50, 400, count)]


def test_segments_are_sent_as_numbers_of_words():
    segments = _prose(300)
    packed = s.Packed(segments)
    which = [np.arange(0, 200), np.array([5, 299, 7])]
    payloads = [packed.some(w + (9 << 32), w) for w in which]
    uid, size, tokens = s.unpacked(payloads, 5)
    want = [jaccard._combined(segments[i], 5) for w in which for i in w]
    assert uid.tolist() == [i + (9 << 32) for w in which for i in w] and size.tolist() == [len(t) for t in want]
    assert np.array_equal(tokens, np.concatenate(want))
    # Tokens themselves take 8 bytes each.
    assert sum(map(len, payloads)) < 3 * len(tokens) < len(exchange.pack(tokens)) / 2
    assert [len(c) for c in s.unpacked([], 5)] == [0, 0, 0]


def test_segments_lie_in_few_batches(tmp_path):
    segments = _prose(2000)
    uri = f"file://{tmp_path}/segments"
    rows = [(i, i * 3, 7, w, np.arange(len(w) - 4)) for i, w in enumerate(segments)]
    storage.write_part(uri, s._segment_batches(rows), s._SEGMENT)
    assert len(list(storage.read_part(uri))) <= 1 + sum(map(len, segments)) // s.SEGMENT_WORDS
    got = list(s._read_segments(uri, 5))
    assert [(r, d, b) for r, d, b, _, _ in got] == [(i, i * 3, 7) for i in range(2000)]
    assert all(np.array_equal(t, jaccard._combined(w, 5)) and len(o) == len(t) for (_, _, _, t, o), w in zip(got, segments, strict=True))
    storage.write_part(uri, s._segment_batches([]), s._SEGMENT)
    assert list(s._read_words(uri)) == []


def _rule(**changed):
    given = {"folder": "", "blocks": 1, "size": 5, "width": 46, "similarity": 0.8, "hashes": 8, "enough": 4, "sources": 4}
    return s.Rule(**(given | changed))


def _runs_of_words(seed, words=6):
    """Tokens of texts that repeat each word some times, with small changes."""
    rng = np.random.default_rng(seed)
    vocabulary = rng.integers(0, 2**64, words, dtype=np.uint64)
    base = np.repeat(vocabulary[rng.integers(0, words, 12)], rng.integers(1, 25, 12))
    for _ in range(2):
        words_ = base.copy()
        at = rng.integers(0, len(words_), int(rng.integers(0, 6)))
        words_[at] = rng.integers(0, 2**64, len(at), dtype=np.uint64)
        yield jaccard._combined(words_[int(rng.integers(0, 20)) :], 5)


def test_distinct_tokens_of_many_rows():
    rng = np.random.default_rng(7)
    previous = s._previous(rng.integers(0, 30, 200).astype(np.uint64))
    counts = rng.random((9, 200)) < 0.5
    assert np.array_equal(s._distinct_each(previous, 46, counts), np.stack([s._distinct(previous, 46, c) for c in counts]))


def test_starts_of_windows_by_brute_force():
    tokens = next(_runs_of_words(3))
    value, place, begin, end = s.smallest_of_all(tokens, _rule())
    assert np.array_equal(np.bincount(begin, minlength=len(tokens)).cumsum()[: len(tokens) - 45] - np.append(0, np.bincount(end, minlength=len(tokens)).cumsum())[: len(tokens) - 45], np.full(len(tokens) - 45, 8))
    for v, c, b, e in zip(value.tolist(), place.tolist(), begin.tolist(), end.tolist(), strict=True):
        k = next(k for k in range(8) if int(s.values_of(tokens[c : c + 1], k)[0]) == v)
        assert all(int(s.values_of(tokens[i : i + 46], k).min()) == v for i in (b, e))
        assert b == 0 or int(s.values_of(tokens[b - 1 : b + 45], k).argmin()) + b - 1 != c


def test_what_other_texts_lack_rules_out_no_near_sequence():
    found = 0
    for seed in range(60):
        x, y = (s.Segment(t, _rule()) for t in _runs_of_words(seed, 6 + seed % 30))
        near, all_ = (np.zeros(len(x.tokens) - 45, bool) for _ in range(2))
        s.near_starts(x, y, near, 4)
        s.near_starts(x, y, all_, 4, 1 << 30, np.zeros(len(all_), np.int64))
        assert np.array_equal(near, all_)
        found += int(near.sum())
    assert found


def test_one_repeated_token_in_common_is_not_compared():
    rng = np.random.default_rng(4)
    often, rare, other = (jaccard._combined(np.concatenate([np.full(40, 5, np.uint64), w]), 5) for w in rng.integers(9, 2**64, (3, 40), dtype=np.uint64))
    others = s.Others(np.array([1, 2]), np.array([len(rare), len(often)]), np.concatenate([rare, often]), _rule())
    # Before, 36 equal places of the one token were taken for as many tokens in common.
    assert [turn for turn, *_ in others.screened(s.Segment(often, _rule()), np.array([1, 2]))] == [1]
    x, left = s.Segment(often, _rule()), np.ones(len(often) - 45, bool)
    tokens = x.distinct
    every = np.full(len(often), 9)
    asked, other_ = np.concatenate([[int(np.searchsorted(tokens, often[0]))], np.arange(len(tokens))]), np.repeat([0, 1], [1, len(tokens)])
    assert s.possible_holders(x, every, left, tokens, asked, other_, 2).tolist() == [False, True]
    assert s.possible_holders(x, np.ones(len(often), int), left, tokens[:0], asked[:0], other_[:0], 2).tolist() == [False, False]


def test_vouching_by_brute_force():
    rng = np.random.default_rng(8)
    told = set()
    for _ in range(60):
        value, _, begin, end = s.smallest_of_all(rng.integers(0, 2**64, 150, dtype=np.uint64), _rule())
        known = np.unique(value)
        cut = known[rng.random(len(known)) < 0.1]
        has = rng.random((7, len(known))) < rng.random((7, 1))
        other, at = np.nonzero(has)
        want = [any(sum(b <= i <= e and (v in cut or has[j, np.searchsorted(known, v)]) for v, b, e in zip(value, begin, end, strict=True)) >= 4 for i in range(105)) for j in range(7)]
        assert s.vouching([value, begin, end], cut, known[at], other, 7, 4).tolist() == want
        told.update(want)
    assert told == {True, False}


def test_files_go_once_they_are_used_up(spark, tmp_path, monkeypatch):
    there, table = {}, storage.Workspace.table

    def spy(self, df, name):
        df = table(self, df, name)
        there[name] = {p.name for p in tmp_path.glob("*/parts/*")}
        return df

    monkeypatch.setattr(storage.Workspace, "table", spy)
    monkeypatch.setattr("twinsieve.plans.workspace.shared_root", lambda spark: f"file://{tmp_path}")
    text = " ".join(f"w{i * i % 97}x{i}" for i in range(120))
    rows = [(i, f"a{i} {text} b{i} c{i}") for i in range(4)]
    work = storage.Workspace(spark, "t")
    assert s.passages(spark.createDataFrame(rows, "doc_id long, text string"), work).count() == 3
    assert "part" in there["counts"] and "part" not in there["asked"]
    assert "shared" in there["asked"] and not there["first"] & {"part", "shared", "values"} and "segments" in there["first"]
