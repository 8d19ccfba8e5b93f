"""Exact self-join of documents by the Jaccard similarity of their word shingles, and its components.

A set is a document's distinct shingles, as 64-bit hashes. Sets that are equal are merged first.

1. In any order, two sets that link share one of the first ``n - ceil(threshold * n) + 1`` shingles of each. Sets none
   of whose first shingles (in hash order) occurs in another set are done; most are.
2. The rest count in how many sets each shingle occurs, over all of them. A set that shares too few shingles is done.
3. What is left orders its shingles from rare to frequent. Sets that have one of their first shingles in common become
   candidates of one another if their sizes allow a link. Index lists are sorted by size and position, and the
   positions after which too few shingles can follow are skipped block by block. Connected candidates form clusters.
4. A cluster's sets meet in one task; a large cluster is cut into blocks by size, and pairs of blocks whose sizes allow
   a link meet. There, the answers of a set (how many shingles it shares with each other set) are derived from those of
   the set before it, most similar by construction: only the index lists of shingles that one of them lacks are added
   or taken away. Every pair in question gets its exact count. No pair is sent anywhere: a task returns each set's
   number of links, and edges that connect what is linked.

Large clusters' edges go through distributed connected components. The driver sees counts only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import exchange, storage
from twinsieve.operators.components import connected_components

SHINGLE = 4
THRESHOLD = 85
CHUNK = 1 << 19
FLUSH = 2_000_000
BLOCK_SETS = 1024
BLOCK_SHINGLES = 2_000_000

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTERS = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, r, np.uint64)])) for r in (_R, _R_INVERSE))
        if size > 4 * CHUNK:
            return up, down
        _POWERS[size] = up, down
    return _POWERS[size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in a buffer, small and capital A-Z alike; words end at the given edges."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    solid = ~_WHITE[data]
    before = np.concatenate([[False], solid[:-1]])
    edges = edges[edges < len(data)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]])
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    up, down = _powers(len(data))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[data] * up[: len(data)])])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _words_of_long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, a piece at a time; pieces end at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and not _WHITE[data[end]]:
            more = np.flatnonzero(_WHITE[data[end : end + CHUNK]])
            end = end + int(more[0]) if len(more) else min(len(data), end + CHUNK)
        found.append(word_hashes(data[at:end], np.empty(0, np.int64))[1])
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _combined(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of ``size`` words."""
    n, h = len(words) - size + 1, np.full(1, size, np.uint64)
    for k in range(size):
        h = mixed(words[k : k + n] + h * np.uint64(0xFF51AFD7ED558CCD))
    return h


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """(row, words, sorted distinct shingle hashes) for each text of a binary column, in order."""
    data, offsets = exchange.bytes_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo > 2 * CHUNK:
            words, cuts = _words_of_long(data[lo:hi]), [0]
            cuts.append(len(words))
        else:
            starts, words = word_hashes(data[lo:hi], offsets[row : last + 1] - lo)
            cuts = np.searchsorted(starts, offsets[row : last + 1] - lo).tolist()
        runs = _combined(words, size) if len(words) >= size else np.empty(0, np.uint64)
        for i in range(last - row):
            a, b = cuts[i], cuts[i + 1]
            if b - a >= size:
                yield row + i, b - a, np.unique(runs[a : b - size + 1])
            elif b > a:
                yield row + i, b - a, _combined(words[a:b], b - a)
            else:
                yield row + i, 0, np.empty(0, np.uint64)
        row = last


def prefix_length(n, threshold: int):
    """How many shingles of a set of n, in a common order, hold one that any linked set has among its own such."""
    return n - -(-threshold * n // 100) + 1


def _measure(folder: str, size: int, threshold: int):
    """Keep the part's texts and first shingles in files; returns each row's numbers, set size and the set's digest."""

    def run(batches):
        part, first, sizes = TaskContext.get().partitionId(), [], []
        schema = pa.schema([("text", pa.binary())])
        out = []

        def passing():
            for batch in batches:
                text = batch.column(1).fill_null(b"").cast(pa.binary())
                uid, n, digest, base = [], [], [], len(sizes)
                for row, _, shingles in shingle_sets(text, size):
                    uid.append((part << 32) | (base + row))
                    n.append(len(shingles))
                    digest.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    keep = prefix_length(len(shingles), threshold) if len(shingles) else 0
                    sizes.append(keep)
                    first.append(shingles[:keep])
                out.append(pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], names=["uid", "doc_id", "row", "n", "digest"]))
                yield pa.RecordBatch.from_arrays([text], schema=schema)

        storage.write_part(f"{folder}/text-{part:06d}", passing(), schema)
        flat = np.concatenate([np.empty(0, np.uint64), *first])
        storage.write_file(f"{folder}/first-{part:06d}", [len(sizes).to_bytes(8, "little"), np.array(sizes, "<i8").tobytes(), flat.astype("<u8").tobytes()])
        yield from out

    return run


def _first_shingles(folder: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    fs, name = storage.open_fs(f"{folder}/first-{part:06d}")
    with fs.open_input_file(name) as file:
        raw = file.read()
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<u8", -1, 8 + 8 * n)


def _rows_of(rows: list[tuple[int, bytes]], origin: int) -> np.ndarray:
    """Row numbers that were sent one by one or packed, with the given origin."""
    return np.unique(np.frombuffer(b"".join(p for o, p in rows if o == origin), "<u4").astype(np.int64))


_MERGED, _TO_CLUSTER = -2, -3


def _send_first(folder: str, blocks: int):
    """Send the first shingles of the sets that stand for themselves."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            sizes, flat = _first_shingles(folder, part)
            owners = np.repeat(np.arange(len(sizes)), sizes)
            alone = np.ones(len(sizes) + 1, bool)
            alone[_rows_of(rows, _MERGED)] = False
            mine = np.flatnonzero(alone[owners])
            for at in range(0, len(mine), FLUSH):
                some = mine[at : at + FLUSH]
                yield exchange.send_hashes(flat[some], owners[some], part, blocks)

    return run


def _sets_at(folder: str, part: int, wanted: np.ndarray, size: int):
    """(row, shingles) of a part's rows, read again from its texts."""
    base = 0
    for batch in storage.read_part(f"{folder}/text-{part:06d}"):
        own = wanted[(wanted >= base) & (wanted < base + len(batch))] - base
        if len(own):
            for i, _, shingles in shingle_sets(batch.column(0).take(pa.array(own)), size):
                yield base + int(own[i]), shingles
        base += len(batch)


def _survivors(folder: str, part: int, rows: list[tuple[int, bytes]], blocks: int) -> np.ndarray:
    """Rows that have a first shingle which another set has too."""
    known = exchange.known_keys(rows)
    if not len(known):
        return np.empty(0, np.int64)
    sizes, flat = _first_shingles(folder, part)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    alone = np.ones(len(sizes) + 1, bool)
    alone[_rows_of(rows, _MERGED)] = False
    return np.unique(owners[exchange.is_in(exchange.short_key(flat, blocks), known) & alone[owners]])


def _send_counts(folder: str, blocks: int, size: int):
    """Send in how many of the part's sets each shingle occurs, and keep which rows take part."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            own = _survivors(folder, part, rows, blocks)
            storage.write_file(f"{folder}/rows-{part:06d}", [own.astype("<u4").tobytes()])
            held, weight = [], 0
            for _, shingles in _sets_at(folder, part, own, size):
                held.append(shingles)
                weight += len(shingles)
                if weight >= FLUSH:
                    yield _counts(held, part, blocks)
                    held, weight = [], 0
            if held:
                yield _counts(held, part, blocks)

    return run


def _counts(held: list[np.ndarray], part: int, blocks: int) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held), return_counts=True)
    rows = []
    for b, at in exchange.split(exchange.block_of(h, blocks), blocks):
        rows.append((b, part, len(at).to_bytes(4, "little") + (h[at] >> np.uint64(32)).astype("<u4").tobytes() + np.minimum(n[at], 65535).astype("<u2").tobytes()))
    return exchange.batch_of(rows)


def _add_counts(batches):
    """Answer each part with the counts over all sets, for shingles that are in two or more."""
    for key, rows in exchange.payload_rows(batches).items():
        sizes = [int.from_bytes(p[:4], "little") for _, p in rows]
        lists = [np.frombuffer(p, "<u4", n, 4) for (_, p), n in zip(rows, sizes, strict=True)]
        values, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        each = np.concatenate([np.frombuffer(p, "<u2", n, 4 + 4 * n) for (_, p), n in zip(rows, sizes, strict=True)])
        total = np.bincount(inverse, each, len(values))
        wanted = np.minimum(total, 65535).astype("<u2")
        at, mine = 0, {}
        for (origin, _), own in zip(rows, lists, strict=True):
            mine.setdefault(origin, []).append(inverse[at : at + len(own)])
            at += len(own)
        for origin, places in mine.items():
            places = np.unique(np.concatenate(places))
            places = places[wanted[places] > 1]
            if len(places):
                yield exchange.batch_of([(origin, key, len(places).to_bytes(4, "little") + values[places].astype("<u4").tobytes() + wanted[places].tobytes())])


def _frequencies(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for block, p in rows:
        if block >= 0:
            n = int.from_bytes(p[:4], "little")
            keys.append((np.frombuffer(p, "<u4", n, 4).astype(np.uint64) << np.uint64(32)) | np.uint64(block))
            counts.append(np.frombuffer(p, "<u2", n, 4 + 4 * n).astype(np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _send_index(folder: str, blocks: int, size: int, threshold: int):
    """Send, for each shared shingle among a set's first in the order from rare to frequent, its set, size and position."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            keys, counts = _frequencies(rows)
            fs, name = storage.open_fs(f"{folder}/rows-{part:06d}")
            with fs.open_input_file(name) as file:
                own = np.frombuffer(file.read(), "<u4").astype(np.int64)
            parts = [[], [], [], []]
            for row, shingles in _sets_at(folder, part, own, size) if len(keys) else ():
                short = exchange.short_key(shingles, blocks)
                at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
                shared = keys[at] == short
                n = len(shingles)
                if 100 * int(shared.sum()) < threshold * n:
                    continue
                often = np.where(shared, counts[at], 1)
                order = np.lexsort((shingles, often))[: prefix_length(n, threshold)]
                place = np.flatnonzero(shared[order])
                if len(place):
                    for column, value in zip(parts, (shingles[order[place]], np.full(len(place), row), np.full(len(place), n), place), strict=True):
                        column.append(value)
            if parts[0]:
                h, row, n, place = (np.concatenate(x) for x in parts)
                out = []
                for b, at in exchange.split(exchange.block_of(h, blocks), blocks):
                    out.append((b, part, len(at).to_bytes(4, "little") + h[at].astype("<u8").tobytes() + b"".join(x[at].astype("<u4").tobytes() for x in (row, n, place))))
                yield exchange.batch_of(out)

    return run


class Forest:
    """Union-find over 0..n-1 with the smallest member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def candidate_edges(h: np.ndarray, uid: np.ndarray, n: np.ndarray, place: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that connect all sets that may link by an index list.

    Lists are sorted by size and position. Blocks whose position leaves too few shingles for the smallest partner that
    their size allows are skipped. In order of size, neighbours whose sizes allow a link are connected: if the sizes of
    two sets of a list do, so do those of all between them.
    """
    order = np.lexsort((uid, place, n, h))
    h, uid, n, place = h[order], uid[order], n[order], place[order]
    # The smallest partner that a set may have in its list says how many shingles have to follow its position.
    number = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]]))
    wide = int(n.max(initial=0)) + 2
    smallest = n[np.searchsorted(number * wide + n, number * wide - (-threshold * n // 100))]
    needed = -(-threshold * (n + smallest) // (100 + threshold))
    enough = n - place >= needed
    h, uid, n = h[enough], uid[enough], n[enough]
    same = h[1:] == h[:-1]
    fits = same & (100 * n[:-1] >= threshold * n[1:])
    nodes, local = np.unique(uid, return_inverse=True)
    forest, edges = Forest(len(nodes)), []
    for i in np.flatnonzero(fits).tolist():
        x, y = int(local[i]), int(local[i + 1])
        if forest.join(x, y):
            edges.append((int(nodes[x]), int(nodes[y])))
    return edges


def _connect(threshold: int):
    def run(batches):
        for rows in exchange.payload_rows(batches).values():
            parts = [[], [], [], []]
            for part, p in rows:
                k = int.from_bytes(p[:4], "little")
                parts[0].append(np.frombuffer(p, "<u8", k, 4))
                row, n, place = (np.frombuffer(p, "<u4", k, 4 + 8 * k + 4 * k * i).astype(np.int64) for i in range(3))
                for column, value in zip(parts[1:], ((part << 32) | row, n, place), strict=True):
                    column.append(value)
            edges = candidate_edges(*(np.concatenate(x) for x in parts), threshold)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["id1", "id2"])

    return run


def _send_sets(folder: str, blocks: int, size: int):
    """Send the sets of clusters to the groups in which they are compared."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            asked: dict[int, list[tuple[int, int, int]]] = {}
            for origin, p in rows:
                if origin == _TO_CLUSTER:
                    row, weight, side = np.frombuffer(p, "<u4", 3).tolist()
                    group = int(np.frombuffer(p, "<i8", 1, 12)[0])
                    asked.setdefault(row, []).append((group, weight, side))
            for row, shingles in _sets_at(folder, part, np.array(sorted(asked), np.int64), size):
                raw = shingles.astype("<u8").tobytes()
                out = []
                for group, weight, side in asked[row]:
                    head = np.array([group, (part << 32) | row, weight, side], "<i8").tobytes()
                    out.append((int(group % blocks), part, head + raw))
                yield exchange.batch_of(out)

    return run


def compare_sets(sets: list[np.ndarray], weights: np.ndarray, sides: np.ndarray, threshold: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each set of a group, counted by the weights of its partners, and edges that connect what is linked.

    Sides are 0 where all pairs are compared, and 1 and 2 where only pairs across are. Index lists hold sets in order of
    size. The answers of a set are derived from those of the set before it in an order that puts similar sets side by
    side; where more than half of the lists would change, they are added up anew.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    _, token = np.unique(flat, return_inverse=True)
    often = np.bincount(token)
    keep = often[token] > 1
    token, owner = token[keep], owner[keep]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    lists = owner[order]
    ends = np.cumsum(np.bincount(token)) if len(token) else np.empty(0, np.int64)
    starts = ends - np.bincount(token) if len(token) else ends
    cuts = np.searchsorted(owner, np.arange(m + 1))
    own = [np.sort(token[cuts[i] : cuts[i + 1]]) for i in range(m)]

    def add(tokens: np.ndarray) -> np.ndarray:
        """How often each set occurs in the index lists of some shingles."""
        a, n = starts[tokens], ends[tokens] - starts[tokens]
        total = int(n.sum())
        if not total:
            return np.zeros(m, np.int64)
        places = np.arange(total) + np.repeat(a - (np.cumsum(n) - n), n)
        return np.bincount(lists[places], minlength=m)

    visit = sorted(range(m), key=lambda i: (tuple(own[i][:2].tolist()), sizes[i]))
    links, forest, edges = np.zeros(m, np.int64), Forest(m), []
    before, answers = np.empty(0, np.int64), np.zeros(m, np.int64)
    for x in visit:
        lost, new = np.setdiff1d(before, own[x], assume_unique=True), np.setdiff1d(own[x], before, assume_unique=True)
        if len(lost) + len(new) < len(own[x]):
            answers = answers - add(lost) + add(new)
        else:
            answers = add(own[x])
        before = own[x]
        linked = 100 * answers >= threshold * (sizes[x] + sizes - answers)
        linked[x] = False
        if sides[x]:
            linked &= sides != sides[x]
        found = np.flatnonzero(linked)
        links[x] = weights[found].sum()
        for y in found.tolist():
            if forest.join(x, y):
                edges.append((x, y))
    return links, edges


def _compare(threshold: int):
    def run(batches):
        groups: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
        for rows in exchange.payload_rows(batches).values():
            for _, p in rows:
                group, uid, weight, side = np.frombuffer(p, "<i8", 4).tolist()
                groups.setdefault(group, []).append((uid, weight, side, np.frombuffer(p, "<u8", -1, 32)))
        for members in groups.values():
            members.sort(key=lambda x: x[0])
            uid = np.array([x[0] for x in members])
            links, edges = compare_sets([x[3] for x in members], np.array([x[1] for x in members]), np.array([x[2] for x in members]), threshold)
            some = np.flatnonzero(links)
            rows = [(int(uid[i]), None, int(links[i])) for i in some] + [(int(uid[a]), int(uid[b]), 0) for a, b in edges]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["id1", "id2", "links"])

    return run


def _grouped(clusters: DataFrame, threshold: int, work: storage.Workspace) -> DataFrame:
    """``uid, weight, grp, side``: where each set is compared; ``clusters`` has ``uid, n, weight, root``.

    A cluster within the bounds is one group. Others are cut into levels of size, so that only sets of the same and
    neighbouring levels may link, and by a hash within a level; each pair of blocks in question is a group.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / threshold) * (1 + 1e-9)))).cast("int")
    per_level = clusters.withColumn("level", level)
    whole = clusters.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    small = f"sets <= {BLOCK_SETS} AND shingles <= {BLOCK_SHINGLES}"
    sized = work.table(per_level.join(whole, "root"), "sized")
    alone = sized.where(small).select("uid", "weight", F.xxhash64("root").alias("grp"), F.lit(0).alias("side"))
    large = sized.where(f"NOT ({small})")
    if large.isEmpty():
        return alone
    cells = large.groupBy("root", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("cuts"))
    cells = work.table(cells, "cells")
    up = cells.select("root", (F.col("level") - 1).alias("level"), F.col("cuts").alias("above"))
    down = cells.select("root", (F.col("level") + 1).alias("level"), F.col("cuts").alias("below"))
    cells = cells.join(up, ["root", "level"], "left").join(down, ["root", "level"], "left")
    placed = large.join(cells, ["root", "level"]).withColumn("cut", F.pmod(F.xxhash64("uid"), F.col("cuts")).cast("int"))

    def pairs(partner_level, partners, first):
        """A struct (first block, second block, side) for each partner block."""
        return F.transform(F.sequence(F.lit(0), partners - 1), lambda k: F.struct(*first(partner_level, k)))

    def within(_, k):
        own = F.col("cut")
        return (
            F.least(own, k).alias("a"), F.greatest(own, k).alias("b"), F.col("level").alias("la"), F.col("level").alias("lb"),
            F.when(k == own, 0).when(own < k, 1).otherwise(2).alias("side"),
        )

    def above(_, k):
        return F.col("cut").alias("a"), k.alias("b"), F.col("level").alias("la"), (F.col("level") + 1).alias("lb"), F.lit(1).alias("side")

    def below(_, k):
        return k.alias("a"), F.col("cut").alias("b"), (F.col("level") - 1).alias("la"), F.col("level").alias("lb"), F.lit(2).alias("side")

    none = F.array().cast("array<struct<a:int,b:int,la:int,lb:int,side:int>>")
    all_pairs = F.concat(
        pairs(None, F.col("cuts"), within),
        F.when(F.col("above").isNull(), none).otherwise(pairs(None, F.coalesce("above", F.lit(1)), above)),
        F.when(F.col("below").isNull(), none).otherwise(pairs(None, F.coalesce("below", F.lit(1)), below)),
    )
    exploded = placed.select("uid", "weight", "root", F.explode(all_pairs).alias("p"))
    cut = exploded.select("uid", "weight", F.xxhash64("root", "p.la", "p.lb", "p.a", "p.b").alias("grp"), F.col("p.side").alias("side"))
    return alone.unionByName(cut)


def jaccard_components(docs: DataFrame, work: storage.Workspace, shingle: int = SHINGLE, threshold: int = THRESHOLD, row: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, n_links, first``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A set is the distinct shingles of ``shingle``
    words; a text with fewer words is one shingle; a null, empty or blank text has none and links with nothing. Rows
    link when the intersection is at least ``threshold`` percent of the union. ``component_id`` is the smallest
    ``doc_id`` reachable by links (null only if all are null), ``n_links`` the number of rows linked to, and ``first``
    is true for one row of each component, that with the smallest ``doc_id`` (nulls last). Repeated rows are rows of
    their own. Other columns are ignored, but ``row`` names one with 64-bit integers that is returned too, as ``row``.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    own_row = (F.col(row) if row else F.lit(None)).cast("long").alias("row")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), own_row)
    blocks, folder = exchange.blocks_for(plain), f"{work.path}/parts"
    rows = work.table(plain.mapInArrow(_measure(folder, shingle, threshold), "uid long, doc_id long, row long, n long, digest binary"), "rows")
    last = rows.agg(F.max(F.shiftright("uid", 32))).first()[0]
    if last is None:
        return spark.createDataFrame([], "doc_id long, n_shingles long, component_id long, n_links long, first boolean" + (", row long" if row else ""))
    parts = int(last) + 1
    marks = exchange.marks(spark, parts)
    same = rows.where("n > 0").groupBy("digest", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("weight"))
    same = work.table(same, "same")
    merged = rows.join(same, ["digest", "n"], "left").select("uid", "doc_id", "row", "n", F.coalesce("rep", "uid").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"))
    merged = work.table(merged, "merged")

    def to_part(df: DataFrame, origin: int, payload) -> DataFrame:
        return df.select(F.shiftright("uid", 32).cast("int").alias("key"), F.lit(origin).alias("origin"), payload.alias("payload"))

    def little(number, digits: int):
        """A column as a little-endian integer of so many hexadecimal digits."""
        big = F.lpad(F.hex(number), digits, "0")
        return F.unhex(F.concat(*[F.substring(big, digits - 1 - i, 2) for i in range(0, digits, 2)]))

    row_number = F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF))
    twins = work.table(to_part(merged.where("rep <> uid"), _MERGED, little(row_number, 8)), "twins")

    def by_part(df: DataFrame) -> DataFrame:
        return df.unionByName(marks).repartitionById(parts, F.col("key"))

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartitionById(blocks, F.col("key"))

    sent = by_part(twins).mapInArrow(_send_first(folder, blocks), exchange.ROW)
    shared = by_block(sent).mapInArrow(exchange.shared_hashes, exchange.ROW)
    counted = by_part(shared.unionByName(twins)).mapInArrow(_send_counts(folder, blocks, shingle), exchange.ROW)
    counts = work.table(by_block(counted).mapInArrow(_add_counts, exchange.ROW), "counts")
    index = by_part(counts).mapInArrow(_send_index(folder, blocks, shingle, threshold), exchange.ROW)
    edges = work.table(by_block(index).mapInArrow(_connect(threshold), "id1 long, id2 long"), "candidates")
    work.drop("counts")
    clusters = connected_components(edges, work).withColumnRenamed("node", "uid")
    sized = clusters.join(merged.where("rep = uid").select("uid", "n", "weight"), "uid")
    groups = work.table(_grouped(work.table(sized, "clusters"), threshold, work), "groups")
    payload = F.concat(little(row_number, 8), little(F.least("weight", F.lit(2**32 - 1)), 8), little(F.col("side"), 8), little(F.col("grp"), 16))
    asked = by_part(to_part(groups, _TO_CLUSTER, payload))
    compared = by_block(asked.mapInArrow(_send_sets(folder, blocks, shingle), exchange.ROW)).mapInArrow(_compare(threshold), "id1 long, id2 long, links long")
    compared = work.table(compared, "compared")
    work.drop("parts")
    roots = connected_components(compared.where("id2 IS NOT NULL"), storage.Workspace(spark, "links"))
    links = compared.where("id2 IS NULL").groupBy("id1").agg(F.sum("links").alias("links"))
    named = merged.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(links.select(F.col("id1").alias("rep"), "links"), "rep", "left")
    named = work.table(named.select("uid", "doc_id", "row", "n", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("least"))
    least = work.table(least, "least")
    out = named.join(least, "root")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "n_links", (F.col("least.uid") == F.col("uid")).alias("first"), *([F.col("row")] if row else []))


def near_dedup(docs: DataFrame, work: storage.Workspace, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with their own columns."""
    row = storage.free_name(docs.columns, "row")
    base = work.table(docs.withColumn(row, F.monotonically_increasing_id()), "base")
    kept = jaccard_components(base, work, shingle, threshold, row).where("first").select(F.col("row").alias(row))
    return base.join(kept, row, "left_semi").select(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = jaccard_components(docs, storage.Workspace(spark, "jaccard"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE_OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_have AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
ends AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT u AS id, u AS r FROM ends UNION SELECT ends.v, reach.r FROM reach JOIN ends ON ends.u = reach.id),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id),
degree AS (SELECT u, count(*) AS n FROM ends GROUP BY u)
SELECT sizes.doc_id, sizes.n AS n_shingles, coalesce(least.r, sizes.doc_id) AS component_id, coalesce(degree.n, 0) AS n_links
FROM sizes LEFT JOIN least ON least.id = sizes.doc_id LEFT JOIN degree ON degree.u = sizes.doc_id
"""
