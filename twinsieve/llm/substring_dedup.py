"""Near-duplicate passages by compact windows.

Tokens are hashes of five-word shingles. Under each of ``HASHES`` hash functions, a node of the Cartesian tree over a
text's hash values spans the sequences whose smallest value is the node's: its compact window (l, c, r) holds all
sequences that begin in l to c and end in c to r. Nodes whose span has at least the minimal passage length are kept.

1. Texts with the same words are one from here on: the row with the smallest ``doc_id`` stands for all.
2. Each part sends the distinct values of its windows once; values that one document alone has are dropped. A sequence
   that shares under ``ENOUGH`` of its values with others can't be near any.
3. The shingles of what is left are counted over all documents. A sequence of the minimal length too few of whose
   shingles others have goes too; runs of the rest are segments.
4. Each part sends, for each value of its segments' windows, the ``SOURCES`` smallest documents that have it, and learns
   the smallest of all. The parts then ask one another for the segments of those, a segment once for each part.
5. Compact windows of two segments with one value are joined as intervals: they vouch for the sequences that lie in
   them. Where enough hash functions do, sequences of the two are verified: at the shifts of the windows, sequences of
   any length with enough tokens in the same places, and where starts are left, sequences of differing lengths between
   ends of runs in common. The Jaccard similarity of their shingle sets must be ``SIMILARITY`` or more.
6. Starts that no smallest document settles, and whose values more documents have, go on: a sequence near one of those
   has one of its rarest shingles in common with it (the prefix that the similarity leaves), so the documents with
   these shingles, all of them, are asked for and verified in the same way.

No cluster and no pair list of a value's documents is ever made: a value that a third of all documents have costs each
part ``SOURCES`` numbers.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm import exchange, jaccard, storage

SHINGLE = 5
PASSAGE_WORDS = 50
SIMILARITY = 0.8
HASHES = 8
ENOUGH = 4
SOURCES = 4
FLUSH = 1_500_000
MATCHES = 2_000_000
RUNS = 48
SHIFTS = 8
SCREEN = 1_000_000
SEGMENT_WORDS = 100_000
_SLICE = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_SEEDS = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64)
_TWINS, _QUERY = -2, -3


def values_of(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hash function k."""
    return jaccard.mixed(tokens + _SEEDS[k])


def minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the smallest value of the next ``width``, the first of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    for at in range(0, n, _SLICE):
        part = h[at : at + _SLICE + width - 1]
        low, span = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        out[at : at + len(low)] = (low & _LOW).astype(np.int64) + at
    return out


def token_chunks(column: pa.Array, size: int):
    """(first row, tokens, cuts, words) of a binary column: row i has words cuts[i] to cuts[i + 1], and tokens from
    cuts[i] to cuts[i + 1] - size + 1."""
    data, offsets = exchange.bytes_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + jaccard.CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo > 2 * jaccard.CHUNK:
            words = jaccard._words_of_long(data[lo:hi])
            cuts = np.array([0, len(words)])
        else:
            starts, words = jaccard.word_hashes(data[lo:hi], offsets[row : last + 1] - lo)
            cuts = np.searchsorted(starts, offsets[row : last + 1] - lo)
        runs = jaccard._combined(words, size) if len(words) >= size else np.empty(0, np.uint64)
        yield row, runs, cuts, words
        row = last


def _starts_of(cuts: np.ndarray, total: int, size: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of sequences that lie within one row, and their rows."""
    n = np.maximum(0, np.diff(cuts) - (size - 1) - (width - 1))
    rows = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) + np.repeat(cuts[:-1] - (np.cumsum(n) - n), n), rows


class Rule:
    """The parameters of one run."""

    def __init__(self, folder: str, blocks: int, size: int, width: int, similarity: float, hashes: int, enough: int, sources: int):
        self.folder, self.blocks, self.size, self.width = folder, blocks, size, width
        self.similarity, self.hashes, self.enough, self.sources = similarity, hashes, enough, sources
        # Of two sequences of the minimal length, so many tokens of each must be common; one less where lengths differ.
        self.common = int(np.ceil(2 * width * similarity / (1 + similarity) - 1e-9))

    def file(self, kind: str, part: int) -> str:
        return f"{self.folder}/{kind}/{part:06d}"


def smallest_of_all(tokens: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value and place of the nodes that have a compact window, by function and place, and the first and the last start of
    the sequences of the minimal length in it: those whose smallest value is the node's."""
    n = len(tokens) - rule.width + 1
    if len(tokens) > _SLICE:
        each = []
        for k in range(rule.hashes):
            h = values_of(tokens, k)
            at = minima(h, rule.width)
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            each.append((h[at[first]], at[first], first, np.append(first[1:], n) - 1))
        return tuple(np.concatenate(x) for x in zip(*each, strict=True))
    h = jaccard.mixed(tokens[None, :] + _SEEDS[: rule.hashes, None])
    low, span = (h & ~_LOW) | np.arange(len(tokens), dtype=np.uint64), 1
    while 2 * span <= rule.width:
        low = np.minimum(low[:, :-span], low[:, span:])
        span *= 2
    if span < rule.width:
        low = np.minimum(low[:, :n], low[:, rule.width - span :])
    at = (low & _LOW).astype(np.int64)
    new = np.ones(at.shape, bool)
    new[:, 1:] = at[:, 1:] != at[:, :-1]
    k, start = np.nonzero(new)
    last = np.append(start[1:], 0) - 1
    last[last < 0] = n - 1  # the next one begins with the next function
    return h[k, at[k, start]], at[k, start], start, last


def compact_windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the nodes of the Cartesian tree over h whose span is ``width`` or more, in order of c.

    The first of equal values is the smaller. Exactly the nodes that are the smallest of some sequence of ``width`` have
    such a span, and the nodes that bound a span (its ancestors) have larger ones, so a stack over those few is enough.
    """
    at = minima(h, width)
    c = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    left, right = _spans(h[c], c, np.zeros(len(c), int), len(h))
    return left, c, right


def _spans(value: np.ndarray, place: np.ndarray, tree: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the span of each node; nodes are in order of tree and place."""
    n, places = len(place), place.tolist()
    left, right, stack, before = [0] * n, [size - 1] * n, [], -1
    for i, (v, at, t) in enumerate(zip(value.tolist(), places, tree.tolist(), strict=True)):
        if t != before:
            stack, before = [], t
        while stack and stack[-1][0] > v:
            right[stack.pop()[1]] = at - 1
        if stack:
            left[i] = places[stack[-1][1]] + 1
        stack.append((v, i))
    return np.array(left, np.int64), np.array(right, np.int64)


def _measure(folder: str, size: int, words: int):
    """Keep the part's rows in a file; returns number, document, words and a digest of the words of each row that has
    enough words, and one row for the part."""

    def run(batches):
        part, out, base = TaskContext.get().partitionId(), [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])

        def passing():
            nonlocal base
            for batch in batches:
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).fill_null(b"").cast(pa.binary())], schema=schema)
                ids, found = exchange.ids_of(batch.column(0)), []
                for first, tokens, cuts, _ in token_chunks(batch.column(1), size):
                    n = np.diff(cuts)
                    for i in np.flatnonzero(n >= words).tolist():
                        digest = hashlib.blake2b(tokens[cuts[i] : cuts[i + 1] - size + 1].tobytes(), digest_size=16).digest()
                        found.append(((part << 32) | (base + first + i), int(ids[first + i]), int(n[i]), digest))
                out.append(found)
                base += len(batch)
                yield batch

        storage.write_part(f"{folder}/part/{part:06d}", passing(), schema)
        for rows in [[((part << 32), 0, -1, b"")], *out]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["uid", "doc", "n", "digest"])

    return run


def _row_numbers(rows: list[tuple[int, bytes]], origin: int) -> np.ndarray:
    return np.frombuffer(b"".join([p for o, p in rows if o == origin]), "<u4").astype(np.int64)


def _sequences(rule: Rule, part: int, twins: np.ndarray):
    """(number of the chunk's first row, ids, tokens, words, cuts, starts of sequences, their rows) of the part's own texts."""
    base, twin = 0, np.sort(twins)
    for batch in storage.read_part(rule.file("part", part)):
        ids = exchange.ids_of(batch.column(0))
        for first, tokens, cuts, words in token_chunks(batch.column(1), rule.size):
            starts, rows = _starts_of(cuts, len(words), rule.size, rule.width)
            if len(twin) and len(starts):
                place = np.minimum(np.searchsorted(twin, base + first + rows), len(twin) - 1)
                own = twin[place] != base + first + rows
                starts, rows = starts[own], rows[own]
            if len(starts):
                yield base + first, ids[first:], tokens, words, cuts, starts, rows
        base += len(batch)


def _send_values(rule: Rule):
    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            held, weight = [], 0
            for _, ids, tokens, _, _, starts, rows in _sequences(rule, part, _row_numbers(sent, _TWINS)):
                for k in range(rule.hashes):
                    h = values_of(tokens, k)
                    at = minima(h, rule.width)[starts]
                    new = np.concatenate([[True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1])])
                    held.append((h[at[new]], ids[rows[new]]))
                    weight += int(new.sum())
                if weight >= FLUSH:
                    yield exchange.send_hashes(*(np.concatenate(x) for x in zip(*held, strict=True)), part, rule.blocks)
                    held, weight = [], 0
            if held:
                yield exchange.send_hashes(*(np.concatenate(x) for x in zip(*held, strict=True)), part, rule.blocks)

    return run


_SEGMENT = pa.schema([("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("words", pa.binary()), ("often", pa.binary())])


def _segment_batches(rows):
    """Record batches of many (row, doc, start, words, often) each."""
    held, weight = [], 0

    def batch():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=_SEGMENT)

    for row, doc, start, words, often in rows:
        held.append((row, doc, start, words.astype("<u8").tobytes(), often.astype("<u2").tobytes()))
        weight += len(words)
        if weight >= SEGMENT_WORDS:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _read_words(uri: str):
    """(row, doc, start, words, how many documents have each token) of a file's segments, in order."""
    for batch in storage.read_part(uri):
        for row, doc, start, words, often in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            yield row, doc, start, np.frombuffer(words, "<u8"), np.frombuffer(often, "<u2")


def _read_segments(uri: str, size: int):
    """The same with tokens instead of words."""
    for row, doc, start, words, often in _read_words(uri):
        yield row, doc, start, jaccard._combined(words, size), often


def _pieces(good: np.ndarray, starts: np.ndarray, rows: np.ndarray, width: int):
    """Runs of good starts of one row without wide gaps, as indices."""
    if len(good):
        yield from np.split(good, np.flatnonzero((np.diff(starts[good]) > width) | (np.diff(rows[good]) != 0)) + 1)


def _keep_shared(rule: Rule):
    """Keep the sequences that share enough values in a file, and count their shingles by document."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            known, counted = exchange.known_keys([(o, p) for o, p in sent if o >= 0]), []

            def kept():
                for first, ids, tokens, words, cuts, starts, rows in _sequences(rule, part, _row_numbers(sent, _TWINS)) if len(known) else ():
                    votes = np.zeros(len(starts), np.int64)
                    for k in range(rule.hashes):
                        h = values_of(tokens, k)
                        at = minima(h, rule.width)[starts]
                        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                        shared = exchange.is_in(exchange.short_key(h[at[new]], rule.blocks), known)
                        votes += np.repeat(shared, np.diff(np.append(new, len(at))))
                    for some in _pieces(np.flatnonzero(votes >= rule.enough), starts, rows, rule.width):
                        lo, hi, row = int(starts[some[0]]), int(starts[some[-1]]) + rule.width, int(rows[some[0]])
                        counted.append((first + row, tokens[lo:hi]))
                        yield first + row, int(ids[row]), lo - int(cuts[row]), words[lo : hi + rule.size - 1], np.empty(0)

            storage.write_part(rule.file("shared", part), _segment_batches(kept()), _SEGMENT)
            held, weight, at = [], 0, 0
            while at < len(counted):
                end = at
                while end < len(counted) and counted[end][0] == counted[at][0]:
                    end += 1
                held.append(np.unique(np.concatenate([t for _, t in counted[at:end]])))
                weight, at = weight + len(held[-1]), end
                if weight >= FLUSH:
                    yield jaccard._counts(held, part, rule.blocks)
                    held, weight = [], 0
            if held:
                yield jaccard._counts(held, part, rule.blocks)

    return run


def dense_starts(tokens: np.ndarray, often: np.ndarray, rule: Rule) -> np.ndarray:
    """For each sequence of the minimal length, whether enough of its distinct tokens occur in other documents too."""
    previous = _previous(tokens)
    shared = _distinct(previous, rule.width, often > 1)
    n = _distinct(previous, rule.width)
    return shared >= np.where(n < rule.width, np.ceil(rule.similarity * n - 1e-9), rule.common - 1)


def _refine(rule: Rule):
    """Keep the segments in a file, and send the smallest documents that have each value of their windows."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            keys, counts = jaccard._frequencies(sent)
            found: list[tuple[np.ndarray, int]] = []
            windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def kept():
                for row, doc, start, words, _ in _read_words(rule.file("shared", part)) if len(keys) else ():
                    tokens = jaccard._combined(words, rule.size)
                    short = exchange.short_key(tokens, rule.blocks)
                    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                    often = np.where(keys[at] == short, counts[at], 1)
                    good = np.flatnonzero(dense_starts(tokens, often, rule))
                    places = np.arange(len(tokens))
                    for some in _pieces(good, places, np.zeros(len(places), int), rule.width):
                        lo, hi = int(some[0]), int(some[-1]) + rule.width
                        value, _, begin, end = smallest_of_all(tokens[lo:hi], rule)
                        found.append((np.unique(value), doc))
                        windows.append((value, begin.astype("<u4"), end.astype("<u4")))
                        yield row, doc, start + lo, words[lo : hi + rule.size - 1], often[lo:hi]

            storage.write_part(rule.file("segments", part), _segment_batches(kept()), _SEGMENT)
            if not found:
                continue
            doc = np.array([d for _, d in found], np.int64)
            _save(rule.file("values", part), *(np.concatenate(c) for c in zip(*windows, strict=True)), np.array([len(v) for v, _, _ in windows], np.int64), doc)
            n, value = [len(v) for v, _ in found], np.concatenate([v for v, _ in found])
            doc, number = np.repeat(doc, n), np.repeat(np.arange(len(found)), n)
            value, listed, total, at = _smallest(value, doc, number, rule.sources)
            ends = np.cumsum(listed)
            out = []
            for b, own in exchange.split(exchange.block_of(value, rule.blocks), rule.blocks):
                some = _ranges(ends[own] - listed[own], listed[own])
                out.append((b, part, exchange.pack(value[own], listed[own].astype("<u1"), total[own].astype("<u4"), doc[at[some]], number[at[some]].astype("<u4"))))
            yield exchange.batch_of(out)

    return run


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[1], ...: so many places from each start."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _smallest(value: np.ndarray, doc: np.ndarray, uid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, how many segments are listed for each (at most ``most``, those of the smallest documents), how
    many there are, and the places of the listed ones."""
    order = np.lexsort((uid, doc, value))
    v = value[order]
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    total = np.diff(np.append(start, len(v)))
    rank = np.arange(len(v)) - np.repeat(start, total)
    return v[start], np.minimum(total, most), total, order[rank < most]


def _choose(rule: Rule):
    """Answer each part with the smallest documents that have its values, where others than its own do."""

    def run(batches):
        for block, rows in exchange.payload_rows(batches).items():
            columns = [exchange.unpack(p) for _, p in rows]
            sizes = [len(c[0]) for c in columns]
            value, listed, total = (np.concatenate([c[i] for c in columns]) for i in range(3))
            listed, total = listed.astype(np.int64), total.astype(np.int64)
            part = np.repeat([o for o, _ in rows], sizes)
            doc = np.concatenate([c[3] for c in columns])
            uid = (np.repeat(part, listed) << 32) | np.concatenate([c[4] for c in columns]).astype(np.int64)
            known, n, _, at = _smallest(np.repeat(value, listed), doc, uid, rule.sources)
            which = np.searchsorted(known, value)
            every = np.bincount(which, total, len(known)).astype(np.int64)
            begins = np.cumsum(n) - n
            least = uid[at[begins]]
            # A part needs no answer for a value that one segment has, or all of whose own is the smallest one.
            asks = (every[which] > 1) & ~((total == 1) & (least[which] >> 32 == part))
            for turn, (origin, _) in enumerate(rows):
                own = np.flatnonzero(asks[sum(sizes[:turn]) : sum(sizes[: turn + 1])]) + sum(sizes[:turn])
                if len(own):
                    w = which[own]
                    some = at[_ranges(begins[w], n[w])]
                    yield exchange.batch_of([(origin, block, exchange.pack(value[own], n[w].astype("<u1"), (every[w] > n[w]).astype("<u1"), doc[some], uid[some]))])

    return run


def _requests(part: int, uid: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows that ask other parts for their segments."""
    uid = np.unique(uid)
    at = np.flatnonzero(np.concatenate([[True], uid[1:] >> 32 != uid[:-1] >> 32])) if len(uid) else uid
    return [(int(some[0] >> 32), part, (some & 0xFFFFFFFF).astype("<u4").tobytes()) for some in np.split(uid, at[1:]) if len(some)]


def vouching(windows: list[np.ndarray], cut: np.ndarray, value: np.ndarray, other: np.ndarray, others: int, enough: int) -> np.ndarray:
    """Which of so many other segments may share ``enough`` values with a sequence of the minimal length: ``value[i]`` is
    one that ``other[i]`` has, and those in ``cut`` are taken for all of them. ``windows`` have values, first and last
    starts."""
    own, begin, end = windows[0], windows[1].astype(np.int64), windows[2].astype(np.int64)
    n = int(end.max()) + 2
    always = exchange.is_in(own, cut)
    base = np.cumsum(np.bincount(begin[always], minlength=n) - np.bincount(end[always] + 1, minlength=n))
    if base.max() >= enough:
        return np.ones(others, bool)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], value, "left"), np.searchsorted(own[order], value, "right")
    at, who = order[_ranges(lo, hi - lo)], np.repeat(other, hi - lo)
    at, who = at[~always[at]], who[~always[at]]
    found, step = np.zeros(others, bool), max(1, SCREEN // n)
    for first in range(0, others, step):
        some, rows = (who >= first) & (who < first + step), min(step, others - first)
        place = (who[some] - first) * n
        change = np.bincount(place + begin[at[some]], minlength=rows * n) - np.bincount(place + end[at[some]] + 1, minlength=rows * n)
        found[first : first + rows] = (np.cumsum(change.reshape(rows, n), axis=1) + base >= enough).any(axis=1)
    return found


def _ask(rule: Rule):
    """Keep which segments of other documents each segment is to be compared with, and ask for those."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            value, n, more, doc, uid = exchange.gathered([p for o, p in sent if o >= 0], 5)
            order = np.argsort(value)
            begins = (np.cumsum(n, dtype=np.int64) - n)[order] if len(n) else order
            value, n, more = value[order], n[order].astype(np.int64), more[order].astype(bool)
            pairs = [[np.empty(0, np.int64)] for _ in range(4)]
            if len(value):
                *windows, sizes, owners = _load(rule.file("values", part))
                cuts = np.cumsum(sizes)[:-1]
                for x, (own, *window) in enumerate(zip(owners.tolist(), *(np.split(c, cuts) for c in windows), strict=True)):
                    mine = np.unique(window[0])
                    at = np.minimum(np.searchsorted(value, mine), len(value) - 1)
                    at = at[value[at] == mine]
                    some = _ranges(begins[at], n[at])
                    by = np.repeat(value[at], n[at])[doc[some] < own]
                    some = some[doc[some] < own]
                    y, first, inverse, votes = np.unique(uid[some], return_index=True, return_inverse=True, return_counts=True)
                    # What a segment that isn't listed has in common besides can only be as much as is cut off.
                    fine = votes + int(more[at].sum()) >= rule.enough
                    fine[fine] = vouching(window, value[at][more[at]], by, inverse, len(y), rule.enough)[fine]
                    for column, new in zip(pairs, (np.full(int(fine.sum()), x), y[fine], doc[some][first][fine], votes[fine]), strict=True):
                        column.append(new)
            x, y, d, votes = (np.concatenate(c) for c in pairs)
            order = np.lexsort((d, -votes, x))
            _save(rule.file("pairs", part), x[order], y[order], d[order], value[more] if len(value) else np.empty(0, np.uint64))
            if len(y):
                yield exchange.batch_of(_requests(part, y))

    return run


def _save(uri: str, *arrays: np.ndarray) -> None:
    storage.write_file(uri, [exchange.pack(*arrays)])


def _load(uri: str) -> list[np.ndarray]:
    fs, name = storage.open_fs(uri)
    with fs.open_input_file(name) as file:
        return exchange.unpack(file.read())


def _serve(rule: Rule):
    """Send the segments that other parts asked for."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            asked = [(o, np.frombuffer(p, "<u4").astype(np.int64)) for o, p in sent if o >= 0]
            if not asked:
                continue
            wanted = np.unique(np.concatenate([n for _, n in asked]))
            own = set(wanted.tolist())
            held = [words for i, (_, _, _, words, _) in enumerate(_read_words(rule.file("segments", part))) if i in own]
            packed = Packed(held)
            for origin, numbers in asked:
                yield exchange.batch_of([(origin, part, packed.some((part << 32) | numbers, np.searchsorted(wanted, numbers)))])

    return run


class Packed:
    """Segments as numbers of their distinct words. A token is a hash, which no codec shrinks; words come again."""

    def __init__(self, segments: list[np.ndarray]):
        self.size = np.array([len(w) for w in segments], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.known, self.number = np.unique(np.concatenate(segments), return_inverse=True)

    def some(self, uid: np.ndarray, which: np.ndarray) -> bytes:
        """The payload of the segments ``which``."""
        number = self.number[_ranges(self.begin[which], self.size[which])]
        used = np.zeros(len(self.known), bool)
        used[number] = True
        number = (np.cumsum(used) - 1)[number]
        # Hashes in order differ little in their upper bytes; byte by byte, the codec sees that.
        known = np.diff(self.known[used], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
        return exchange.pack(uid, self.size[which].astype("<u4"), known.ravel(), number.astype("<u2" if used.sum() <= 1 << 16 else "<u4"))


def unpacked(payloads: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, lengths and tokens of the segments of several payloads."""
    out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]]
    for payload in payloads:
        uid, words, known, number = exchange.unpack(payload)
        known = np.cumsum(np.ascontiguousarray(known.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)
        n = words.astype(np.int64) - (size - 1)
        tokens = jaccard._combined(known[number], size)[_ranges(np.cumsum(words, dtype=np.int64) - words, n)]
        for column, new in zip(out, (uid, n, tokens), strict=True):
            column.append(new)
    return tuple(np.concatenate(c) for c in out)


def _previous(tokens: np.ndarray) -> np.ndarray:
    """The last earlier place of each token, -1 for none."""
    order = np.argsort(tokens, kind="stable")
    out = np.full(len(tokens), -1, np.int64)
    again = tokens[order[1:]] == tokens[order[:-1]]
    out[order[1:][again]] = order[:-1][again]
    return out


def _distinct(previous: np.ndarray, width: int, counts: np.ndarray | None = None) -> np.ndarray:
    """How many distinct tokens the sequence of ``width`` from each start has, of those that count."""
    # A token counts for the starts between its last occurrence and itself.
    n, at = len(previous) + 1, np.arange(len(previous)) if counts is None else np.flatnonzero(counts)
    change = np.bincount(np.maximum(previous[at] + 1, at - width + 1).clip(0), minlength=n)
    change[at + 1] -= 1
    return np.cumsum(change)[: len(previous) - width + 1]


def _distinct_each(previous: np.ndarray, width: int, counts: np.ndarray) -> np.ndarray:
    """``_distinct`` for each row of ``counts``."""
    at = np.arange(len(previous))
    begin = np.maximum(previous + 1, at - width + 1).clip(0)
    order = np.argsort(begin, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(begin[order]) != 0]))
    change = np.zeros((len(counts), len(previous) + 1), np.int32)
    change[:, begin[order[first]]] = np.add.reduceat(counts[:, order], first, axis=1, dtype=np.int32)
    change[:, 1:] -= counts
    return np.cumsum(change, axis=1)[:, : len(previous) - width + 1]


def lacking(both, least: int, similarity: float):
    """How many distinct tokens a sequence may have that the other text lacks, where the texts have ``both`` distinct ones
    in common and no sequence of the other has under ``least``: a near one of any length lacks no more."""
    # similarity * (lacking + those of the other sequence) <= those in common <= both
    return both / similarity - np.maximum(both, least) + 1e-9


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sequences' token sets is enough."""
    a, b = set(x.tolist()), set(y.tolist())
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _runs(x: np.ndarray, y: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last places (exclusive), in x and in y, of the maximal runs that both have, by place in x.

    Where tokens repeat so often that there are over ``MATCHES`` pairs of places, each counts at its first place in y.
    """
    order = np.argsort(y, kind="stable") if order is None else order
    ordered = y[order]
    lo, hi = np.searchsorted(ordered, x, "left"), np.searchsorted(ordered, x, "right")
    n = hi - lo
    many = int(n.sum()) > MATCHES
    if many:
        n = np.minimum(n, 1)
    p, q = np.repeat(np.arange(len(x)), n), order[_ranges(lo, n)]
    if not many:  # a run begins where the tokens before differ and ends where those behind do, on the same diagonal
        begins = (p == 0) | (q == 0) | (x[p - 1] != y[q - 1])
        ends = (p == len(x) - 1) | (q == len(y) - 1) | (x[np.minimum(p + 1, len(x) - 1)] != y[np.minimum(q + 1, len(y) - 1)])
        to, diagonal = p[ends], q[ends] - p[ends]
        to = to[np.lexsort((to, diagonal))] + 1
        p, q = p[begins], q[begins]
        at = np.lexsort((p, q - p))
        p, q = p[at], q[at]
        at = np.lexsort((q, p))
        return p[at], to[at], q[at], (q + to - p)[at]
    at = np.lexsort((p, q - p))
    p, q = p[at], q[at]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(q) != 1)])) if len(p) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(p)))
    p, q = p[first], q[first]
    at = np.lexsort((q, p))
    return p[at], p[at] + size[at], q[at], q[at] + size[at]


def chained(x: np.ndarray, y: np.ndarray, width: int, similarity: float, runs: tuple | None = None, known: tuple | None = None) -> list[tuple[int, int]]:
    """(first, last) starts in x of sequences near one of y, where both have ``width`` tokens or more, not equally many.
    ``runs`` and ``known`` (earlier places, which tokens the other has, fewest distinct ones) may be given.

    Two near sequences that begin and end with tokens in common stay near when both are drawn out to the ends of the
    runs in common there, so only those ends are tried, with bounds from the distinct tokens, and then the sets are
    compared. What is shorter than ``width`` is filled up with what lies around it.
    """
    p, pe, q, qe = runs or _runs(x, y)
    if not len(p):
        return []
    if known is None:
        px, py = _previous(x), _previous(y)
        known = px, py, np.isin(x, y), np.isin(y, x), int(_distinct(px, width).min()), int(_distinct(py, width).min())
    px, py, in_y, in_x, least_x, least_y = known
    tried = []
    for a in range(len(p)):
        new_x, new_y = px[p[a] :] < p[a], py[q[a] :] < q[a]
        d, e = np.cumsum(new_x), np.cumsum(new_x & in_y[p[a] :])
        straight = np.flatnonzero((pe > p[a]) & (qe > q[a]))
        # Besides the end of each run, what spans all runs from here on, whatever their order in y.
        from_ = np.concatenate([np.full(len(straight), q[a]), np.minimum.accumulate(q[a:])])
        to = np.concatenate([qe[straight], np.maximum.accumulate(qe[a:])])
        end = np.concatenate([pe[straight], np.maximum.accumulate(pe[a:])])
        dx, ex = d[end - p[a] - 1], e[end - p[a] - 1]
        dy = np.cumsum(new_y)[to.clip(q[a] + 1) - q[a] - 1]  # at most what the sequence has, where it begins earlier
        ey = np.where(from_ == q[a], np.cumsum(new_y & in_x[q[a] :])[to.clip(q[a] + 1) - q[a] - 1], len(y))
        both = np.minimum(ex, ey)
        dx, dy = np.where(end - p[a] < width, np.maximum(dx, least_x), dx), np.where(to - from_ < width, np.maximum(dy, least_y), dy)
        fine = both >= similarity * (np.maximum(dx + dy - both, np.maximum(dx, dy))) - 1e-9
        tried.append(np.stack([np.full(int(fine.sum()), p[a]), end[fine], from_[fine], to[fine]], 1))
    found: list[tuple[int, int]] = []
    tried = np.unique(np.concatenate(tried), axis=0)
    for i, j, k, m in tried[np.argsort(tried[:, 0] - tried[:, 1], kind="stable")].tolist():
        starts = range(i, i + 1) if j - i >= width else range(max(0, j - width), min(i, len(x) - width) + 1)
        others = range(k, k + 1) if m - k >= width else range(max(0, m - width), min(k, len(y) - width) + 1)
        for s in starts:
            last = max(s, j - width)
            if any(f <= s and last <= t for f, t in found):
                continue
            for t in others:
                a, b = set(x[s : max(j, s + width)].tolist()), set(y[t : max(m, t + width)].tolist())
                both = len(a & b)
                spare = int(np.floor(both / similarity - (len(a) + len(b) - both) + 1e-9))
                if spare >= 0:  # so many more tokens on either side leave it near
                    found.append((max(0, s - spare), last))
                    found.append((s, min(len(x) - width, last + spare)))
                    break
    return found


def aligned(same: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of sequences of ``width`` or more places, so many of them the same that the two are near where no
    token repeats; for each first place the longest."""
    total = np.concatenate([[0.0], np.cumsum(same - 2 * similarity / (1 + similarity))])
    most = np.maximum.accumulate(total[::-1])[::-1]
    end = np.searchsorted(-most, -(total - 1e-7), "right") - 1
    first = np.flatnonzero(end - np.arange(len(total)) >= width)
    return first, end[first]


class Segment:
    """Tokens with what verifying needs of them, worked out when it is first needed."""

    def __init__(self, tokens: np.ndarray, rule: Rule):
        self.tokens, self.rule = tokens, rule

    @functools.cached_property
    def windows(self) -> tuple[np.ndarray, ...]:
        """Value and place of the compact windows, and the first and last start of sequences of the minimal length in each."""
        return smallest_of_all(self.tokens, self.rule)

    @functools.cached_property
    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values of the windows, and the first and the last place of each."""
        value, place = self.windows[:2]
        order = np.lexsort((place, value))
        value = value[order]
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        return value[at], place[order[at]], place[order[np.append(at[1:], len(value)) - 1]]

    @functools.cached_property
    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens, and the number of each token among them."""
        return np.unique(self.tokens, return_inverse=True)

    @property
    def distinct(self) -> np.ndarray:
        return self.numbered[0]

    @functools.cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.tokens, kind="stable")

    @functools.cached_property
    def previous(self) -> np.ndarray:
        return _previous(self.tokens)

    @functools.cached_property
    def sizes(self) -> list[tuple[int, np.ndarray]]:
        """Distinct tokens of the sequences of the minimal length, and of a quarter more."""
        width = self.rule.width
        return [(w, _distinct(self.previous, w)) for w in (width, width + width // 4) if w <= len(self.tokens)]

    @functools.cached_property
    def least(self) -> int:
        return int(self.sizes[0][1].min())

    @property
    def repeats(self) -> bool:
        return len(self.distinct) < len(self.tokens)

    @functools.cached_property
    def needed(self):
        """How many places of a sequence of the minimal length at least hold tokens that a near one has too."""
        if not self.repeats:
            return self.rule.common - 1
        return np.ceil(self.rule.similarity * self.sizes[0][1] - 1e-9)


class Others:
    """The segments that a part was sent, with their tokens numbered."""

    def __init__(self, uid: np.ndarray, size: np.ndarray, tokens: np.ndarray, rule: Rule):
        self.size, self.rule, self.tokens = size.astype(np.int64), rule, tokens
        self.begin = np.cumsum(self.size) - self.size
        self.place = {u: i for i, u in enumerate(uid.tolist())}
        self.known, number = np.unique(tokens, return_inverse=True)
        self.number = number.astype(np.int32)
        self.at = np.full(len(self.known), -1, np.int32)
        self.made: dict[int, Segment] = {}

    def segment(self, i: int) -> Segment:
        if i not in self.made:
            self.made[i] = Segment(self.tokens[self.begin[i] : self.begin[i] + self.size[i]], self.rule)
        return self.made[i]

    def screened(self, x: Segment, uid: np.ndarray):
        """(turn, segment, starts of x that it may settle, distinct tokens in common, how many distinct ones of each
        start's sequence it lacks) of the segments ``uid`` in order that have, for one start at least, as many of its
        tokens as are needed, and lack few enough; the tokens of many segments are looked up at once."""
        distinct, own = x.numbered
        known = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
        has = np.flatnonzero(self.known[known] == distinct)
        width, which = self.rule.width, np.array([self.place[u] for u in uid.tolist()], np.int64)
        weight = np.cumsum(self.size[which] + len(x.tokens)) // SCREEN
        for some in np.split(np.arange(len(uid)), np.flatnonzero(np.diff(weight)) + 1):
            size = self.size[which[some]]
            self.at[known[has]] = has
            found = self.at[self.number[_ranges(self.begin[which[some]], size)]]
            self.at[known[has]] = -1
            held = np.zeros((len(some), len(distinct)), bool)
            hit = np.flatnonzero(found >= 0)
            held[np.repeat(np.arange(len(some)), size)[hit], found[hit]] = True
            common = np.zeros((len(some), len(own) + 1), np.int32)
            np.cumsum(held[:, own], axis=1, out=common[:, 1:])
            may = common[:, width:] - common[:, :-width] >= x.needed
            rows, both = np.flatnonzero(may.any(axis=1)), np.count_nonzero(held, axis=1)
            lacks = _distinct_each(x.previous, width, ~held[rows][:, own])
            for i, lack in zip(rows.tolist(), lacks, strict=True):
                if lack.min() <= lacking(int(both[i]), 0, self.rule.similarity):
                    yield int(some[i]), int(which[some[i]]), may[i], int(both[i]), lack


def near_starts(x: Segment, y: Segment, near: np.ndarray, enough: int, both: int | None = None, lack: np.ndarray | None = None) -> None:
    """Mark in ``near`` the starts in x of sequences of the minimal length that lie in one near a sequence of y. How many
    distinct tokens they have in common, and how many of each start's y lacks, may be given."""
    rule, width, similarity = x.rule, x.rule.width, x.rule.similarity
    value, first, last = y.values
    own, place, begin, end = x.windows
    at = np.minimum(np.searchsorted(value, own), len(value) - 1)
    hit = np.flatnonzero(value[at] == own)
    if len(hit) < enough:
        return
    # Sweep over the starts: +1 where a window begins, -1 after it ends, wherever y has a window with its value.
    count = np.zeros(len(near) + 1, np.int64)
    np.add.at(count, begin[hit], 1)
    np.add.at(count, end[hit] + 1, -1)
    vouched = np.cumsum(count[:-1]) >= enough
    if not (vouched & ~near).any():
        return
    if lack is None:
        in_y = exchange.is_in(x.tokens, y.distinct)
        both, lack = len(np.unique(x.tokens[in_y])), _distinct(x.previous, width, ~in_y)
    if not (lack[vouched & ~near] <= lacking(both, y.least, similarity)).any():
        return
    a, b, at = x.tokens, y.tokens, at[hit]
    shifts = np.concatenate([first[at] - place[hit], (last[at] - place[hit])[last[at] != first[at]]])
    shifts, votes = np.unique(shifts, return_counts=True)
    unsure = x.repeats or y.repeats
    room = width - rule.common
    shifts = shifts[np.argsort(-votes, kind="stable")]
    for move in shifts[: SHIFTS if unsure else None].tolist():
        from_, to = max(0, -move), min(len(a), len(b) - move)
        if to - from_ < rule.common or not (vouched & ~near).any():
            continue
        # A sequence that reaches beyond an end of a segment is drawn inside there, hence some room on both sides.
        same = np.zeros(to - from_ + 2 * room, bool)
        same[room : room + to - from_] = a[from_:to] == b[from_ + move : to + move]
        begin, end = aligned(same, width, similarity)
        longest = end > np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) if len(end) else end
        for i, j in zip((begin[longest] + from_ - room).tolist(), (end[longest] + from_ - room).tolist(), strict=True):
            s = max(0, min(i, len(a) - width))
            e = max(s + width, min(j, len(a)))
            if near[s : e - width + 1].all():
                continue
            # Equal places say how many tokens two sets share only where tokens don't repeat.
            if not unsure or _similar_at(a, b, s, e, move, width, similarity):
                near[s : e - width + 1] = True
    left = vouched & ~near
    if not left.any():
        return
    in_b = exchange.is_in(a, y.distinct)
    if unsure:
        near[_window_by_window(x, y, np.flatnonzero(left), in_b)] = True
        left &= ~near
    if left.any() and (left & _possible(x, y, in_b, unsure)).any():
        runs = _runs(a, b, y.order)
        if unsure and len(runs[0]) > RUNS:
            return
        for first_, last_ in chained(a, b, width, similarity, runs, (x.previous, y.previous, in_b, exchange.is_in(b, x.distinct), x.least, y.least)):
            near[first_ : last_ + 1] = True


def _window_by_window(x: Segment, y: Segment, starts: np.ndarray, in_y: np.ndarray) -> np.ndarray:
    """The starts whose sequence of the minimal length is near one of y of that length or a quarter more, wherever it
    is."""
    width, similarity, all_ = x.rule.width, x.rule.similarity, x.sizes[0][1]
    most = _distinct(x.previous, width, in_y)  # at most so many are common
    starts = starts[(most >= similarity * (all_ + np.maximum(most, y.least) - most) - 1e-9)[starts]]
    if not len(starts):
        return starts
    distinct, own = x.numbered
    at = np.minimum(np.searchsorted(distinct, y.tokens), len(distinct) - 1)
    other = np.where(distinct[at] == y.tokens, at, len(distinct))
    found = []
    for some in np.array_split(starts, min(len(starts), -(-len(starts) * (len(distinct) + len(other)) // SCREEN))):
        has = np.zeros((len(some), len(distinct) + 1), bool)
        has[np.arange(len(some))[:, None], own[some[:, None] + np.arange(width)]] = True
        common, near = has[:, other], np.zeros(len(some), bool)
        for w, d in y.sizes:
            both = _distinct_each(y.previous, w, common)
            near |= (both >= similarity * (all_[some][:, None] + d - both) - 1e-9).any(axis=1)
        found.append(some[near])
    return np.concatenate(found)


def _similar_at(a: np.ndarray, b: np.ndarray, s: int, e: int, move: int, width: int, similarity: float) -> bool:
    """Whether a from s to e is near the places of b that it lies upon, drawn inside b."""
    t = max(0, min(s + move, len(b) - width))
    return _similar(a[s:e], b[t : max(t + width, e + move)], similarity)


def _possible(x: Segment, y: Segment, in_b: np.ndarray, repeats: bool) -> np.ndarray:
    """Starts in x that sequences of differing lengths may cover: enough of their tokens are in y, on several shifts."""
    a, b, width, similarity = x.tokens, y.tokens, x.rule.width, x.rule.similarity
    n = len(a) - width + 1
    if repeats:
        return np.full(n, bool(in_b.any()))
    at = y.order
    moves = at[np.searchsorted(b[at], a[in_b])] - np.flatnonzero(in_b)
    if len(moves) < 2 or (moves == moves[0]).all():
        return np.zeros(n, bool)
    share, fine = similarity / (1 + similarity), np.ones(n, bool)
    # Of the union, so many tokens are common; and the sequence of b has ``width`` or more.
    for part, more in ((similarity, 0.0), (share, share * width)):
        total = np.concatenate([[0.0], np.cumsum(in_b - part)])
        most = np.maximum.accumulate(total[::-1])[::-1]
        end = np.searchsorted(-most, -(total + more - 1e-7), "right") - 1
        begin = np.flatnonzero(end - np.arange(len(total)) >= width)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, end[begin] - width + 1, -1)
        fine &= np.cumsum(cover[:-1]) > 0
    return fine


def _rarest(tokens: np.ndarray, often: np.ndarray, starts: np.ndarray, rule: Rule) -> np.ndarray:
    """Tokens one of which a sequence near one from these starts has: the rarest of each, as many as needed."""
    found, prefix = [np.empty(0, np.uint64)], rule.width - (rule.common - 1) + 1
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, often))] = np.arange(len(tokens))
    unique = _distinct(_previous(tokens), rule.width)[starts] == rule.width
    for some in np.array_split(starts[unique], -(-int(unique.sum()) // 4096) or 1):
        at = some[:, None] + np.arange(rule.width)
        first = np.argpartition(rank[at], prefix - 1, axis=1)[:, :prefix] if len(some) else at
        found.append(tokens[np.unique(np.take_along_axis(at, first, 1))])
    for start in starts[~unique].tolist():
        found.append(tokens[start : start + rule.width])
    out = np.unique(np.concatenate(found))
    return out[np.isin(out, tokens[often > 1])]


def _verify(rule: Rule, again: bool):
    """Find the passages of the part's segments near those that were sent (origin -1: found). The first time, ask for
    the holders of the rarest tokens of starts that are left and whose values have more documents (origin -3)."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            y_uid, y_size, y_tokens = unpacked([p for o, p in sent if o >= 0], rule.size)
            others = Others(y_uid, y_size, y_tokens, rule)
            x_of, y_of, d_of, more = _load(rule.file("more" if again else "pairs", part))
            found, open_x, open_near, queries = [], [], [], []
            settled = dict(zip(*_load_open(rule, part), strict=True)) if again else {}
            cuts = np.searchsorted(x_of, np.arange(int(x_of[-1]) + 2)) if len(x_of) else np.zeros(1, np.int64)
            for number, (row, doc, start, words, often) in enumerate(_read_words(rule.file("segments", part))):
                if number + 1 >= len(cuts):
                    break
                if cuts[number] == cuts[number + 1]:
                    continue
                tokens = jaccard._combined(words, rule.size)
                x = Segment(tokens, rule)
                near = settled[number] & 1 != 0 if again else np.zeros(len(tokens) - rule.width + 1, bool)
                lo, hi = cuts[number], cuts[number + 1]
                for i, y, may, both, lack in others.screened(x, y_of[lo:hi]):
                    if not (may & ~near).any() or lack[~near].min() > lacking(both, 0, rule.similarity):
                        continue
                    before = near.copy()
                    near_starts(x, others.segment(y), near, rule.enough, both, lack)
                    at = np.flatnonzero(near & ~before)
                    if len(at):
                        found += [((part << 32) | row, doc, start + int(r[0]), start + int(r[-1]) + rule.width + rule.size - 1, int(d_of[lo + i])) for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)]
                    if near.all():
                        break
                if again or near.all() or not len(more):
                    continue
                # Starts of which enough values have documents that weren't listed.
                value, _, begin, end = x.windows
                cut, count = np.flatnonzero(exchange.is_in(value, more)), np.zeros(len(near) + 1, np.int64)
                np.add.at(count, begin[cut], 1)
                np.add.at(count, end[cut] + 1, -1)
                left = np.flatnonzero((np.cumsum(count[:-1]) >= rule.enough) & ~near & dense_starts(tokens, often, rule))
                if len(left):
                    asked = _rarest(tokens, often, left, rule)
                    if len(asked):
                        open_x.append(number)
                        open_near.append(near.astype(np.uint8))
                        open_near[-1][left] |= 2
                        queries.append(asked)
            if found:
                yield exchange.batch_of([(part, -1, exchange.pack(*(np.array(c, np.int64) for c in zip(*found, strict=True))))])
            if not again:
                n = [len(q) for q in queries]
                tokens = np.concatenate([np.empty(0, np.uint64), *queries])
                _save(rule.file("open", part), np.array(open_x, np.int64), np.array([len(v) for v in open_near], np.int64), np.concatenate([np.empty(0, np.uint8), *open_near]), np.repeat(np.array(open_x, np.int64), n), tokens)
                wanted = np.unique(tokens)
                rows = [(b, _QUERY - part, (wanted[at] >> np.uint64(32)).astype("<u4").tobytes()) for b, at in exchange.split(exchange.block_of(wanted, rule.blocks), rule.blocks)]
                if rows:
                    yield exchange.batch_of(rows)

    return run


def _load_open(rule: Rule, part: int) -> tuple[list[int], list[np.ndarray]]:
    """Segments with starts that are left, and each one's starts: 1 for those found near, 2 for those that are left."""
    number, size, state, _, _ = _load(rule.file("open", part))
    return number.tolist(), np.split(state, np.cumsum(size)[:-1]) if len(number) else []


def _holders(batches):
    """Tell each part which of its shingles are wanted (rows from ``_add_counts``, and queries)."""
    for block, rows in exchange.payload_rows(batches).items():
        wanted = [np.frombuffer(p, "<u4") for o, p in rows if o <= _QUERY]
        if wanted:
            wanted = np.unique(np.concatenate(wanted))
            for part, p in rows:
                if part >= 0:
                    own = np.frombuffer(p, "<u4", int.from_bytes(p[:4], "little"), 4)
                    own = own[exchange.is_in(own, wanted)]
                    if len(own):
                        yield exchange.batch_of([(part, block, own.tobytes())])


def _post(rule: Rule):
    """Send where the wanted shingles are."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            wanted, columns = exchange.known_keys([(o, p) for o, p in sent if o >= 0]), [[], [], []]
            for number, (_, doc, _, tokens, _) in enumerate(_read_segments(rule.file("segments", part), rule.size)) if len(wanted) else ():
                short = np.unique(exchange.short_key(tokens, rule.blocks))
                short = short[exchange.is_in(short, wanted)]
                for column, new in zip(columns, (short, np.full(len(short), number, "<u4"), np.full(len(short), doc)), strict=True):
                    column.append(new)
            if columns[0]:
                short, number, doc = (np.concatenate(c) for c in columns)
                block = (short & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rows = [(b, part, exchange.pack((short[at] >> np.uint64(32)).astype("<u4"), number[at], doc[at])) for b, at in exchange.split(block, rule.blocks)]
                if rows:
                    yield exchange.batch_of(rows)

    return run


def _answer(batches):
    """Answer each query with all segments that have its shingle."""
    for block, rows in exchange.payload_rows(batches).items():
        held = [(o, exchange.unpack(p)) for o, p in rows if o >= 0]
        if not held:
            continue
        short, doc = (np.concatenate([c[i] for _, c in held]) for i in (0, 2))
        uid = np.concatenate([(o << 32) | c[1].astype(np.int64) for o, c in held])
        order = np.lexsort((uid, doc, short))
        short, doc, uid = short[order], doc[order], uid[order]
        for origin, p in rows:
            if origin <= _QUERY:
                own = np.unique(np.frombuffer(p, "<u4"))
                lo, hi = np.searchsorted(short, own, "left"), np.searchsorted(short, own, "right")
                some = _ranges(lo, hi - lo)
                if len(some):
                    yield exchange.batch_of([(_QUERY - origin, block, exchange.pack(own, (hi - lo).astype("<u4"), doc[some], uid[some]))])


def possible_holders(x: Segment, often: np.ndarray, left: np.ndarray, tokens: np.ndarray, asked: np.ndarray, other: np.ndarray, others: int) -> np.ndarray:
    """Which of so many other segments may have a sequence near one of x that holds one from a start in ``left``. The
    answers say that ``other[i]`` has ``tokens[asked[i]]``; it lacks the other ``tokens``, and those no document has."""
    rule, (distinct, own) = x.rule, x.numbered
    place = np.searchsorted(distinct, tokens)
    every = np.ones(len(distinct), bool)
    every[own[often <= 1]] = False
    every[place] = False
    found, step = np.zeros(others, bool), max(1, SCREEN // len(own))
    for first in range(0, others, step):
        some, rows = (other >= first) & (other < first + step), min(step, others - first)
        held = np.repeat(every[None], rows, axis=0)
        held[other[some] - first, place[asked[some]]] = True
        lack = _distinct_each(x.previous, rule.width, ~held[:, own])[:, left].min(axis=1)
        found[first : first + rows] = lack <= lacking(np.count_nonzero(held, axis=1), 0, rule.similarity)
    return found


def _ask_more(rule: Rule):
    """Ask for the segments that hold one of the rarest tokens of a segment's starts that are left."""

    def run(batches):
        for part, sent in exchange.payload_rows(batches).items():
            answers = [(o, exchange.unpack(p)) for o, p in sent if o >= 0]
            _, _, _, x, token = _load(rule.file("open", part))
            pairs = [np.empty(0, np.int64)] * 3
            if answers and len(x):
                short = np.concatenate([(c[0].astype(np.uint64) << np.uint64(32)) | np.uint64(b) for b, c in answers])
                n, doc, uid = (np.concatenate([c[i] for _, c in answers]) for i in (1, 2, 3))
                order = np.argsort(short)
                begins, n, short = (np.cumsum(n, dtype=np.int64) - n)[order], n[order].astype(np.int64), short[order]
                open_ = {i: state & 2 != 0 for i, state in zip(*_load_open(rule, part), strict=True)}
                held = {i: (doc, words, often) for i, (_, doc, _, words, often) in enumerate(_read_words(rule.file("segments", part))) if i in open_}
                mine = exchange.short_key(token, rule.blocks)
                at = np.minimum(np.searchsorted(short, mine), len(short) - 1)
                hit = short[at] == mine
                cuts, columns = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])), []
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    number, which = int(x[lo]), np.flatnonzero(hit[lo:hi]) + lo
                    own, words, often = held[number]
                    some, asked = _ranges(begins[at[which]], n[at[which]]), np.repeat(which - lo, n[at[which]])
                    some, asked = some[doc[some] < own], asked[doc[some] < own]
                    y, first, inverse = np.unique(uid[some], return_index=True, return_inverse=True)
                    tokens = jaccard._combined(words, rule.size)
                    fine = possible_holders(Segment(tokens, rule), often, open_[number], token[lo:hi], asked, inverse, len(y))
                    columns.append((np.full(int(fine.sum()), number), y[fine], doc[some][first][fine]))
                pairs = [np.concatenate(c) for c in zip(*columns, strict=True)]
            done = _load(rule.file("pairs", part))
            tried = {(a, b) for a, b in zip(done[0].tolist(), done[1].tolist(), strict=True)}
            fresh = np.array([(a, b) not in tried for a, b in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)], bool)
            x, y, d = (p[fresh] for p in pairs)
            order = np.lexsort((y, d, x))
            _save(rule.file("more", part), x[order], y[order], d[order], np.empty(0, np.uint64))
            if len(y):
                yield exchange.batch_of(_requests(part, y))

    return run


def _found_rows(batches):
    for rows in exchange.payload_rows(batches).values():
        for _, p in rows:
            columns = exchange.unpack(p)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "doc_id", "start_word", "end_word", "source_id"])


def passages(docs: DataFrame, work: storage.Workspace, words: int = PASSAGE_WORDS, shingle: int = SHINGLE, similarity: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH, sources: int = SOURCES) -> DataFrame:
    """``doc_id, source_id, start_word, end_word``: maximal passages near one of a document with a smaller id.

    A passage is a run of words, each in some sequence of ``words`` or more that has a near one in an earlier document:
    the Jaccard similarity of the two sequences' sets of ``shingle`` words is ``similarity`` or more; the two needn't be
    equally long. ``source_id`` is the smallest document that a sequence of the passage was found near to; not all have
    to be looked at, so it needn't be the smallest there is. Words are runs of bytes other than ASCII white space, A-Z
    lower-cased. Null, empty and shorter texts have no passages; texts of any length are looked at whole. Rows with
    equal ``doc_id`` aren't near one another, each has its own passages; a null ``doc_id`` counts as smaller than all
    others and is returned as null. Other columns are ignored. An empty table gives no rows. Identical passages are
    always found; others with the recall that ``enough`` of ``hashes`` equal values give. Where two texts repeat
    themselves so much that they have over ``RUNS`` runs in common, sequences of ``words`` are compared with those of as
    many and a quarter more, not with those of all other lengths.
    """
    spark, width = docs.sparkSession, words - shingle + 1
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rule = Rule(f"{work.path}/parts", exchange.blocks_for(plain), shingle, width, similarity, hashes, enough, sources)
    rows = work.table(plain.mapInArrow(_measure(rule.folder, shingle, words), "uid long, doc long, n long, digest binary"), "rows")
    last = rows.agg(F.max(F.shiftright("uid", 32))).first()[0]
    if last is None:
        return spark.createDataFrame([], "doc_id long, source_id long, start_word long, end_word long")
    parts = int(last) + 1
    marks = exchange.marks(spark, parts)

    def by_part(df: DataFrame) -> DataFrame:
        return df.unionByName(marks).repartitionById(parts, F.col("key"))

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartitionById(rule.blocks, F.col("key"))

    texts = rows.where("n >= 0").groupBy("digest", "n").agg(F.min(F.struct("doc", "uid")).alias("least"), F.count("*").alias("copies"))
    texts = work.table(texts.where("copies > 1"), "texts")
    copies = work.table(rows.join(texts, ["digest", "n"]).where("uid <> least.uid").select("uid", "doc", "n", "least"), "copies")
    number = F.lpad(F.hex(F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    payload = F.unhex(F.concat(*[F.substring(number, i, 2) for i in (7, 5, 3, 1)]))
    twins = work.table(copies.select(F.shiftright("uid", 32).cast("int").alias("key"), F.lit(_TWINS).alias("origin"), payload.alias("payload")), "twins")
    sent = by_part(twins).mapInArrow(_send_values(rule), exchange.ROW)
    shared = by_block(sent).mapInArrow(exchange.shared_hashes, exchange.ROW)
    counted = by_part(shared.unionByName(twins)).mapInArrow(_keep_shared(rule), exchange.ROW)
    counts = work.table(by_block(counted).mapInArrow(jaccard._add_counts, exchange.ROW), "counts")
    work.drop("parts/part")  # read for the last time
    chosen = by_block(by_part(counts).mapInArrow(_refine(rule), exchange.ROW)).mapInArrow(_choose(rule), exchange.ROW)
    asked = work.table(by_part(chosen).mapInArrow(_ask(rule), exchange.ROW), "asked")
    for name in ("shared", "values"):
        work.drop(f"parts/{name}")
    served = by_part(asked).mapInArrow(_serve(rule), exchange.ROW)
    first = work.table(by_part(served).mapInArrow(_verify(rule, False), exchange.ROW), "first")
    found, queries = first.where("origin = -1"), first.where("origin <> -1")
    if not queries.isEmpty():
        queries = work.table(queries, "queries")
        held = counts.select(F.col("origin").alias("key"), F.col("key").alias("origin"), "payload")
        posted = by_part(by_block(held.unionByName(queries)).mapInArrow(_holders, exchange.ROW)).mapInArrow(_post(rule), exchange.ROW)
        answers = by_block(posted.unionByName(queries)).mapInArrow(_answer, exchange.ROW)
        asked = work.table(by_part(answers).mapInArrow(_ask_more(rule), exchange.ROW), "asked_more")
        served = by_part(asked).mapInArrow(_serve(rule), exchange.ROW)
        found = found.unionByName(work.table(by_part(served).mapInArrow(_verify(rule, True), exchange.ROW), "second"))
    found = work.table(found.mapInArrow(_found_rows, "uid long, doc_id long, start_word long, end_word long, source_id long"), "found")
    for name in ("parts", "counts"):
        work.drop(name)
    order = Window.partitionBy("uid").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", (before.isNull() | (F.col("start_word") > before)).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("uid", "run").agg(F.first("doc_id").alias("doc_id"), F.min("source_id").alias("source_id"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    spans = work.table(spans.select("uid", "doc_id", "source_id", "start_word", "end_word"), "spans")
    # A copy of a text with a smaller document is near it as a whole; one with the same document has the same passages.
    whole = copies.where("doc > least.doc").select(F.col("doc").alias("doc_id"), F.col("least.doc").alias("source_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"))
    again = copies.where("doc = least.doc").select(F.col("least.uid").alias("uid")).join(spans, "uid")
    null = F.lit(int(exchange.NULL_ID))
    columns = [F.nullif("doc_id", null).alias("doc_id"), F.nullif("source_id", null).alias("source_id"), "start_word", "end_word"]
    return spans.select(*columns).unionByName(whole.select(*columns)).unionByName(again.select(*columns))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return passages(docs, storage.Workspace(spark, "passages"))
