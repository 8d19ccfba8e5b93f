"""Removal of byte strings that an earlier document also has, found with a Burrows-Wheeler transform.

Texts that are copies of an earlier document's lose all their bytes and are left out of all else, so that no copy is
ever sent: the earliest stands for them.

1. Winnowing: of the ``min_length - k + 1`` k-byte windows of every string of ``min_length`` bytes, the one with the
   smallest hash (the leftmost of equals) is an anchor. Two documents that share such a string share its anchor at the
   same place in it. Anchors that occur in one document only are dropped: each part of the input sends its distinct
   anchor hashes once, in blocks by hash, and learns which of them others have too.
2. Around each anchor that is left lies its context, the union of the strings of ``min_length`` bytes that hold it.
   A part sends a 64-bit digest of each distinct context once, with the smallest ``doc_id`` that has it there, and short
   digests of the anchor with half the rest of a string on its left and on its right: of two contexts that share a
   string, one of these is the same. Most contexts share none with another one, and nothing more is needed for them.
3. Where contexts of an anchor may share a string, one part sends the bytes of each to one task, which builds the suffix array and
   Burrows-Wheeler transform of the contexts in a row and derives common prefixes by increasing length: intervals of
   suffixes that share l bytes are extended backward by the bytes of the transform to those that share l + 1, breadth
   first, and this stops at ``min_length``. Each remaining interval is one repeated string, and its smallest ``doc_id``
   is known.
4. Each part learns, for its contexts, which strings an earlier document has, and removes the bytes they cover.

Contexts of one anchor are told apart by their digests; all else is compared byte by byte. Tasks hold a part's or
block's numbers, never a group of documents, and copies of a context are merged before they are sent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import exchange, storage

MIN_LENGTH = 50
ANCHOR = 16
CHUNK = 1 << 20
FLUSH_ANCHORS = 1_500_000
FLUSH_CONTEXTS = 150_000
TRANSFORM_BYTES = 250_000
HOT_BYTES = 4_000_000
_LOW = np.uint64((1 << 24) - 1)


def hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 16-byte window."""
    n = len(buf)
    x = np.ndarray((n - 7,), "<u8", buf, 0, (1,))
    h = x[: n - 15] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += x[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of the documents at [start, end) in a buffer of under 2**24 bytes."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    fine = ends - starts >= min_length
    if not fine.any():
        return none
    h = hashes(buf)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, low = min_length - ANCHOR + 1, key
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    edge = np.zeros(len(low) + 1, np.int32)
    np.add.at(edge, starts[fine], 1)
    np.add.at(edge, ends[fine] - min_length + 1, -1)
    chosen = (low[np.cumsum(edge[:-1]) > 0] & _LOW).astype(np.int64)
    places = np.unique(chosen)
    return places, h[places]


def _anchors_of(column: pa.Array, min_length: int):
    """(row, place in the row's text, hash) arrays for the texts of a column, chunk by chunk."""
    data, offsets = exchange.bytes_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= 2 * CHUNK:
            at, h = anchors(data[lo:hi], offsets[row:last] - lo, offsets[row + 1 : last + 1] - lo, min_length)
            rows = np.searchsorted(offsets[row : last + 1] - lo, at, "right") - 1
            yield rows + row, at - (offsets[row:last] - lo)[rows], h
        else:  # one long text, in pieces that overlap by all but one byte of a string
            for start in range(lo, hi - min_length + 1, CHUNK):
                end = min(hi, start + CHUNK + min_length - 1)
                at, h = anchors(data[start:end], np.array([0]), np.array([end - start]), min_length)
                yield np.full(len(at), row), at + (start - lo), h
        row = last


_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
_TWINS = -4


def _keep_texts(folder: str):
    """Keep the part's rows in a file; returns number, document, bytes and digest of each row, and one row for the part."""

    def run(batches):
        part, base = TaskContext.get().partitionId(), 0
        out = [[(part << 32, 0, -1, b"")]]

        def passing():
            nonlocal base
            for batch in batches:
                batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.binary())], schema=_TEXT)
                ids, texts = exchange.ids_of(batch.column(0)).tolist(), batch.column(1).to_pylist()
                out.append([((part << 32) | (base + i), d, len(t or b""), hashlib.blake2b(t or b"", digest_size=16).digest()) for i, (d, t) in enumerate(zip(ids, texts, strict=True))])
                base += len(batch)
                yield batch

        storage.write_part(f"{folder}/part-{part:06d}", passing(), _TEXT)
        for rows in out:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["uid", "doc", "n", "digest"])

    return run


def _twins_of(rows: list[tuple[int, bytes]]) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join([p for o, p in rows if o == _TWINS]), "<u4").astype(np.int64))


def _find_anchors(folder: str, buckets: int, min_length: int):
    """Send the distinct anchor hashes of a part's texts, without those that are copies of an earlier document's."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            twins, held, size, base = _twins_of(rows), [], 0, 0
            for batch in storage.read_part(f"{folder}/part-{part:06d}"):
                ids = exchange.ids_of(batch.column(0))
                for row, _, h in _anchors_of(batch.column(1), min_length):
                    own = ~exchange.is_in(row + base, twins)
                    held.append((h[own], ids[row[own]]))
                    size += len(h)
                base += len(batch)
                if size >= FLUSH_ANCHORS:
                    yield exchange.send_hashes(*(np.concatenate(x) for x in zip(*held, strict=True)), part, buckets)
                    held, size = [], 0
            if size:
                yield exchange.send_hashes(*(np.concatenate(x) for x in zip(*held, strict=True)), part, buckets)

    return run


def _short(data: bytes, half: int) -> int:
    """32 bits of an anchor and ``half`` bytes beside it; 0 where the text ends before."""
    return (xxhash.xxh3_64_intdigest(data) & 0xFFFFFFFF or 1) if len(data) == ANCHOR + half else 0


class _Contexts:
    """Distinct contexts of a part: bytes, the anchor's hash, smallest and largest document."""

    def __init__(self, part: int, buckets: int):
        self.part, self.buckets, self.base = part, buckets, 0
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.hash: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.sides: list[tuple[int, int]] = []

    def add(self, data: bytes, h: int, doc: int, place: int, half: int) -> int:
        i = self.at.setdefault(data, len(self.at))
        if i == len(self.low):
            self.hash.append(h)
            left, right = data[place - half : place + ANCHOR] if place >= half else b"", data[place : place + ANCHOR + half]
            self.sides.append((_short(left, half), _short(right, half)))
            self.low.append(doc)
            self.high.append(doc)
        elif doc < self.low[i]:
            self.low[i] = doc
        elif doc > self.high[i]:
            self.high[i] = doc
        return self.base + i

    def rows(self) -> list[tuple[int, int, bytes]]:
        digest = np.array([xxhash.xxh3_64_intdigest(data) for data in self.at], dtype=np.uint64)
        h, low, high = np.array(self.hash, dtype=np.uint64), np.array(self.low, dtype=np.int64), np.array(self.high, dtype=np.int64)
        left, right = np.array(self.sides, dtype=np.uint32).T
        out = []
        for b, at in exchange.split(exchange.block_of(h, self.buckets), self.buckets):
            out.append((b, self.part, _packed((at + self.base, h[at] >> np.uint64(32), digest[at], low[at], high[at], left[at], right[at]), _DIGESTS)))
        self.base += len(self.at)
        self.clear()
        return out


_DIGESTS = ("<u4", "<u4", "<u8", "<i8", "<i8", "<u4", "<u4")
_ASKED = ("<u4", "<u4", "<u4", "<i8")
_HOLDERS = ("<u4", "<u4", "<u4", "<i8")
_BYTES = ("<u4", "<u4", "<i8", "<u2")
_ANSWERS = ("<u4", "<i8", "<u8")


def _packed(columns, kinds, tail: bytes = b"") -> bytes:
    raw = len(columns[0]).to_bytes(4, "little") + b"".join([np.asarray(c).astype(k).tobytes() for c, k in zip(columns, kinds, strict=True)]) + tail
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(payload: bytes, kinds) -> tuple[list[np.ndarray], bytes, int]:
    """The columns, and the bytes and place of what follows them."""
    raw = pa.decompress(payload[4:], decompressed_size=int.from_bytes(payload[:4], "little"), codec="zstd", asbytes=True)
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for kind in kinds:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, raw, at


def _match_digests(batches):
    """Answers for contexts that share no string with another one of their anchor, which follows from the digests of
    their anchor with one side (origin 0). Of each other one, one part is asked for the bytes (origin: the block's number plus 1), and who has it stays with the block (origin -2)."""
    for block, rows in exchange.payload_rows(batches).items():
        columns = [_unpacked(payload, _DIGESTS)[0] for _, payload in rows]
        turn = np.repeat(np.arange(len(rows)), [len(c[0]) for c in columns])
        index, h, digest, low, high, left, right = (np.concatenate(c) for c in zip(*columns, strict=True))
        order = np.lexsort((digest, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
        least = np.empty(len(h), np.int64)
        least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        # Of a string that two contexts of an anchor share, half of what isn't the anchor lies on one of its sides.
        one, linked = order[new], np.zeros(int(new.sum()), bool)
        for side in (left[one], right[one]):
            by = np.lexsort((side, h[one]))
            same = (side[by[1:]] == side[by[:-1]]) & (h[one][by[1:]] == h[one][by[:-1]]) & (side[by[1:]] != 0)
            linked[by[1:][same]] = linked[by[:-1][same]] = True
        several = np.empty(len(h), bool)
        several[order] = linked[np.cumsum(new) - 1]
        matters = ~several & (high > least)
        for t, (origin, _) in enumerate(rows):
            own = turn == t
            at = np.flatnonzero(matters & own)
            if len(at):
                yield exchange.batch_of([(origin, 0, _packed((index[at], least[at], np.zeros(len(at))), _ANSWERS))])
        at = np.flatnonzero(several)
        if not len(at):
            continue
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        _, first = np.unique(number[at], return_index=True)
        asked = at[first]
        for t, (origin, _) in enumerate(rows):
            own = asked[turn[asked] == t]
            if len(own):
                yield exchange.batch_of([(origin, block + 1, _packed((index[own], number[own], h[own], least[own]), _ASKED))])
        part = np.array([origin for origin, _ in rows])
        yield exchange.batch_of([(block, -2, _packed((number[at], part[turn[at]], index[at], high[at]), _HOLDERS))])


def _places(folder: str, part: int) -> np.ndarray:
    """Rows, starts, lengths and context numbers of a part's contexts where they occur."""
    fs, name = storage.open_fs(f"{folder}/place-{part:06d}")
    with fs.open_input_file(name) as file:
        raw = file.read()
    return np.frombuffer(pa.decompress(raw[:-8], decompressed_size=int.from_bytes(raw[-8:], "little"), codec="zstd"), "<u4").reshape(4, -1).astype(np.int64)


def _send_bytes(folder: str, buckets: int, min_length: int):
    """Send the bytes of the contexts that were asked for."""

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            columns, block = [], []
            for key, payload in rows:
                if key > 0:
                    columns.append(_unpacked(payload, _ASKED)[0])
                    block.append(np.full(len(columns[-1][0]), key - 1))
            if not columns:
                continue
            index, number_of, h, least = (np.concatenate(c) for c in zip(*columns, strict=True))
            block, place = np.concatenate(block), _places(folder, part)
            number, first = np.unique(place[3], return_index=True)
            row, start, length = place[:3, first[np.searchsorted(number, index)]]
            data, base = [b""] * len(index), 0
            order = np.argsort(row, kind="stable")
            for batch in storage.read_part(f"{folder}/part-{part:06d}"):
                text, offsets = exchange.bytes_of(batch.column(1))
                raw = memoryview(text)
                for i in order[np.searchsorted(row[order], base) : np.searchsorted(row[order], base + len(batch))].tolist():
                    at = int(offsets[row[i] - base] + start[i])
                    data[i] = bytes(raw[at : at + int(length[i])])
                base += len(batch)
            for b, at in exchange.split(block, buckets):
                sent = [data[i] for i in at]
                yield exchange.batch_of([(b, part, _packed((number_of[at], h[at], least[at], [len(d) for d in sent]), _BYTES, b"".join(sent)))])

    return run


def _send_contexts(folder: str, buckets: int, min_length: int):
    """Send the part's distinct contexts around shared anchors, and keep where they are."""
    half = -(-(min_length - ANCHOR) // 2)

    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            known, twins = exchange.known_keys(rows), _twins_of(rows)
            if not len(known):
                continue
            found, base, places = _Contexts(part, buckets), 0, []
            for batch in storage.read_part(f"{folder}/part-{part:06d}"):
                data, offsets = exchange.bytes_of(batch.column(1))
                ids, raw = exchange.ids_of(batch.column(0)), memoryview(data)
                for row, at, h in _anchors_of(batch.column(1), min_length):
                    hit = exchange.is_in(exchange.short_key(h, buckets), known) & ~exchange.is_in(row + base, twins)
                    row, at, h = row[hit], at[hit], h[hit]
                    lo = np.maximum(0, at - (min_length - ANCHOR)) + offsets[row]
                    hi = np.minimum(at + min_length + offsets[row], offsets[row + 1])
                    docs = ids[row].tolist()
                    places_in = (at + offsets[row] - lo).tolist()
                    index = [found.add(bytes(raw[a:b]), x, d, p, half) for a, b, x, d, p in zip(lo.tolist(), hi.tolist(), h.tolist(), docs, places_in, strict=True)]
                    places.append(np.stack([row + base, lo - offsets[row], hi - lo, np.array(index, dtype=np.int64)]).astype("<u4"))
                    if len(found.at) >= FLUSH_CONTEXTS:
                        yield exchange.batch_of(found.rows())
                base += len(ids)
            kept = np.concatenate(places, axis=1) if places else np.empty((4, 0), "<u4")
            storage.write_file(f"{folder}/place-{part:06d}", [pa.compress(np.ascontiguousarray(kept).tobytes(), codec="zstd", asbytes=True), kept.nbytes.to_bytes(8, "little")])
            if found.at:
                yield exchange.batch_of(found.rows())

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text of symbols 0..256, sorted by the ``depth`` (or some more) symbols from there on."""
    n, span = len(text), 7
    rank, padded = np.zeros(n, np.int64), np.concatenate([text.astype(np.int64), np.zeros(span, np.int64)])
    for k in range(span):  # seven symbols of nine bits at once
        rank = (rank << 9) | padded[k : k + n]
    while True:
        order = np.argsort(rank, kind="stable")
        ordered = rank[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if span >= depth or (n and new[-1] == n - 1):
            return order
        rank[order] = new
        second = np.zeros(n, np.int64)
        second[:-span] = rank[span:] + 1
        rank = rank * (n + 2) + second
        span *= 2


def repeated_intervals(text: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it whether it shares under ``min_length`` symbols with the one before.

    Breadth-first backward extension: at each length, an interval holds the suffixes with one prefix. Prepending the
    symbols of the Burrows-Wheeler transform sends suffix i to place ``back[i]``, and two neighbours there share one
    symbol more exactly if they got the same symbol and came from one interval. A boundary that has been found stays,
    so only places without one are looked at again. The text has to end with a symbol that occurs nowhere else in a
    repeat: 0, with symbols from 1 otherwise.
    """
    n = len(text)
    order = suffix_order(text, min_length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    transform = text[order - 1]  # the symbol before each suffix, cyclically
    back = place[order - 1]
    source = np.empty(n, np.int32)
    source[back] = np.arange(n, dtype=np.int32)
    boundary = np.ones(n, bool)
    got = transform[source]
    boundary[1:] = got[1:] != got[:-1]  # length 1: the symbols prepended to the empty prefix
    open_ = np.flatnonzero(~boundary)
    mine, other = source[open_], source[open_ - 1]
    interval = np.cumsum(boundary, dtype=np.int32)
    for _ in range(1, min_length):
        apart = interval[mine] != interval[other]
        if apart.any():
            boundary[open_[apart]] = True
            together = ~apart
            open_, mine, other = open_[together], mine[together], other[together]
            interval = np.cumsum(boundary, dtype=np.int32)
    return order, boundary


def earlier_strings(contexts: list[bytes], docs: np.ndarray, min_length: int) -> np.ndarray:
    """For each context, a bit for each string of ``min_length`` bytes at offset 0, 1, ... that a smaller document has."""
    lengths = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.zeros(int((lengths + 1).sum()), np.uint16)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    own = np.repeat(np.arange(len(contexts)), lengths)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    text[starts[own] + within] = flat.astype(np.uint16) + 1
    order, boundary = repeated_intervals(text, min_length)
    which = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[which]
    whole = offset + min_length <= lengths[which]
    number = np.cumsum(boundary) - 1
    least = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number[whole], docs[which[whole]])
    hit = whole & (least[number] < docs[which])
    mask = np.zeros(len(contexts), np.uint64)
    np.bitwise_or.at(mask, which[hit], np.uint64(1) << offset[hit].astype(np.uint64))
    return mask


def earlier_strings_of_hot(contexts: list[bytes], docs: np.ndarray, min_length: int, at_once: int = 1_000_000) -> np.ndarray:
    """The same for very many contexts of one anchor: string by string, in shares by the strings' hashes."""
    mask = [0] * len(contexts)
    strings = sum(max(0, len(c) - min_length + 1) for c in contexts)
    shares = max(1, -(-strings // at_once))
    for share in range(shares):
        least: dict[bytes, int] = {}
        own = []
        for i, c in enumerate(contexts):
            d = int(docs[i])
            for at in range(len(c) - min_length + 1):
                x = c[at : at + min_length]
                if shares == 1 or xxhash.xxh3_64_intdigest(x) % shares == share:
                    own.append((i, at, x))
                    if d < least.get(x, d + 1):
                        least[x] = d
        for i, at, x in own:
            if least[x] < docs[i]:
                mask[i] |= 1 << at
    return np.array(mask, dtype=np.uint64)


def _compare_contexts(min_length: int):
    """For each part that has them, the smallest document and the earlier strings of contexts, where any byte may go."""

    def run(batches):
        for rows in exchange.payload_rows(batches).values():
            columns, held, data = [], [], []
            for origin, payload in rows:
                if origin == -2:
                    held.append(_unpacked(payload, _HOLDERS)[0])
                    continue
                parts, raw, at = _unpacked(payload, _BYTES)
                ends = at + np.cumsum(parts[3].astype(np.int64))
                data += [raw[e - n : e] for e, n in zip(ends.tolist(), parts[3].tolist(), strict=True)]
                columns.append(parts[:3])
            number, h, least = (np.concatenate(c) for c in zip(*columns, strict=True))
            order = np.argsort(number)
            number, h, least, distinct = number[order], h[order], least[order], [data[i] for i in order.tolist()]
            mask = np.zeros(len(distinct), np.uint64)
            groups: dict[int, list[int]] = {}
            for i, x in enumerate(h.tolist()):
                groups.setdefault(x, []).append(i)
            waiting: list[int] = []
            size, todo = 0, list(groups.values())
            for k, group in enumerate(todo):
                weight = sum(len(distinct[i]) for i in group)
                if weight > HOT_BYTES:
                    own = np.array(group)
                    mask[own] = earlier_strings_of_hot([distinct[i] for i in group], least[own], min_length)
                else:
                    waiting += group
                    size += weight
                if waiting and (size > TRANSFORM_BYTES or k == len(todo) - 1):
                    own = np.array(waiting)
                    mask[own] = earlier_strings([distinct[i] for i in waiting], least[own], min_length)
                    waiting, size = [], 0
            # A context's other documents lose all of it; the first one loses what earlier strings cover.
            which, part, index, high = (np.concatenate(c) for c in zip(*held, strict=True))
            which = np.searchsorted(number, which)
            matters = (mask[which] != 0) | (high > least[which])
            for origin in np.unique(part[matters]).tolist():
                at = np.flatnonzero(matters & (part == origin))
                yield exchange.batch_of([(origin, 0, _packed((index[at], least[which[at]], mask[which[at]]), _ANSWERS))])

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    at = np.flatnonzero(first)
    return starts[at], ends[np.concatenate([at[1:], [len(starts)]]) - 1]


def _remove(folder: str, min_length: int, with_text: bool):
    def run(batches):
        for part, rows in exchange.payload_rows(batches).items():
            replies, twins = [p for origin, p in rows if origin >= 0], set(_twins_of(rows).tolist())
            cut_rows, cut_lo, cut_hi = (np.empty(0, np.int64),) * 3
            if replies:
                index, least, mask = (np.concatenate(c) for c in zip(*[_unpacked(p, _ANSWERS)[0] for p in replies], strict=True))
                index = index.astype(np.int64)
                order = np.argsort(index)
                index, least, mask = index[order], least[order], mask[order]
                kept = _places(folder, part)
                at = np.minimum(np.searchsorted(index, kept[3]), len(index) - 1)
                known = index[at] == kept[3]
                kept, at = kept[:, known], at[known]
                ids = np.concatenate([exchange.ids_of(b.column(0)) for b in storage.read_part(f"{folder}/part-{part:06d}")])
                later = ids[kept[0]] > least[at]
                found = [(kept[0][later], kept[1][later], kept[1][later] + kept[2][later])]
                for o in range(min_length - ANCHOR + 1):
                    on = ~later & ((mask[at] >> np.uint64(o)) & np.uint64(1)).astype(bool)
                    found.append((kept[0][on], kept[1][on] + o, kept[1][on] + o + min_length))
                cut_rows, cut_lo, cut_hi = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(cut_rows, kind="stable")
                cut_rows, cut_lo, cut_hi = cut_rows[order], cut_lo[order], cut_hi[order]
            base = 0
            for batch in storage.read_part(f"{folder}/part-{part:06d}"):
                cuts, first = np.searchsorted(cut_rows, np.arange(base, base + len(batch) + 1)), base
                base += len(batch)
                out = [[], [], [], [], [], []]
                for i, text in enumerate(batch.column(1)):
                    text, (a, b) = text.as_py() or b"", cuts[i : i + 2]
                    runs = []
                    rest = text
                    if first + i in twins and len(text) >= min_length:  # all of a copy of an earlier document goes
                        runs, rest = [(0, len(text))], b""
                    elif b > a:
                        runs = list(zip(*(x.tolist() for x in merged(cut_lo[a:b], cut_hi[a:b])), strict=True))
                        edges = [0, *[e for r in runs for e in r], len(text)]
                        rest = b"".join([text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                    for column, value in zip(out, (len(text), len(text) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [x for r in runs for x in r], rest), strict=True):
                        column.append(value)
                arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays += [pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.binary())]
                    names += ["spans", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def suffix_dedup(docs: DataFrame, work: storage.Workspace, min_length: int = MIN_LENGTH, with_text: bool = False) -> DataFrame:
    """Remove each byte that a string of ``min_length`` bytes covers which also starts in a document with a smaller id.

    Texts are UTF-8 bytes, null is empty, and strings are judged on the input. Rows with equal ``doc_id`` don't remove
    one another's bytes; a null ``doc_id`` counts as smaller than all others. Other columns are ignored; an empty table
    gives no rows. One row for each row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; ``with_text`` adds
    ``spans`` (starts and ends in turn) and ``kept`` (the bytes that are left, which need not be whole characters).

    ``min_length`` is 23 to 79: at least the anchors' length and some, and at most what 64 bits can say of a context.
    """
    if not ANCHOR + 7 <= min_length <= ANCHOR + 63:
        raise ValueError("min_length is out of its range")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    buckets = exchange.blocks_for(plain)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<long>, kept binary" if with_text else "")
    folder = f"{work.path}/parts"
    rows = work.table(plain.mapInArrow(_keep_texts(folder), "uid long, doc long, n long, digest binary"), "rows")
    last = rows.agg(F.max(F.shiftright("uid", 32))).first()[0]
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    parts = int(last) + 1
    marks = exchange.marks(docs.sparkSession, parts)
    texts = rows.where("n >= 0").groupBy("digest", "n").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    texts = work.table(texts.where("least < most").select("digest", "n", "least"), "texts")
    number = F.lpad(F.hex(F.col("uid").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    payload = F.unhex(F.concat(*[F.substring(number, i, 2) for i in (7, 5, 3, 1)]))
    copies = rows.join(texts, ["digest", "n"]).where("doc > least")
    twins = work.table(copies.select(F.shiftright("uid", 32).cast("int").alias("key"), F.lit(_TWINS).alias("origin"), payload.alias("payload")), "twins")
    work.drop("rows")
    sent = twins.unionByName(marks).repartitionById(parts, F.col("key")).mapInArrow(_find_anchors(folder, buckets, min_length), exchange.ROW)
    shared = sent.repartitionById(buckets, F.col("key")).mapInArrow(exchange.shared_hashes, exchange.ROW)
    contexts = shared.unionByName(twins).repartitionById(parts, F.col("key")).mapInArrow(_send_contexts(folder, buckets, min_length), exchange.ROW)
    matched = work.table(contexts.repartitionById(buckets, F.col("key")).mapInArrow(_match_digests, exchange.ROW), "matched")
    asked = matched.where("origin > 0").unionByName(marks).repartitionById(parts, F.col("key"))
    sent_bytes = asked.mapInArrow(_send_bytes(folder, buckets, min_length), exchange.ROW)
    held = matched.where("origin = -2")
    compared = sent_bytes.unionByName(held).repartitionById(buckets, F.col("key")).mapInArrow(_compare_contexts(min_length), exchange.ROW)
    answers = work.table(compared, "answers").unionByName(matched.where("origin = 0"))
    return answers.unionByName(twins).unionByName(marks).repartitionById(parts, F.col("key")).mapInArrow(_remove(folder, min_length, with_text), schema)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, storage.Workspace(spark, "suffix"))


# Texts are cut into pieces of 200 places with what their strings need behind them, so that none is searched from its beginning.
ORACLE_OP8 = """
WITH texts AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), pieces AS (
  SELECT doc_id, n, p, substr(h, CAST(2 * p + 1 AS INTEGER), 500) AS h FROM (SELECT doc_id, h, n, unnest(range(0, n, 200)) AS p FROM texts)
), places AS MATERIALIZED (
  SELECT doc_id, p + i AS i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN p + i + 50 <= n THEN substr(h, 2 * i + 1, 100) END AS s
  FROM (SELECT doc_id, n, p, h, CAST(unnest(range(least(200, n - p))) AS INTEGER) AS i FROM pieces)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM places WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)
), marked AS (
  SELECT x.doc_id, x.i, x.b, count(f.first) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS out
  FROM places x LEFT JOIN firsts f ON x.s = f.s AND f.first < x.doc_id
), runs AS (
  SELECT *, out AND NOT coalesce(lag(out) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked
), kept AS (
  SELECT doc_id, count_if(out) AS n_removed, count_if(begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT out) AS h FROM runs GROUP BY doc_id
)
SELECT t.doc_id, t.n AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
