"""Vector code compression: product codes whose codebooks come from heap Lloyd.

Vectors become integers, are cut into equal consecutive parts, and each part position has a codebook. Lloyd's rounds
keep, for each block of vectors and each codebook entry, a heap of the parts assigned to it. A part's key is its
slack, the distance to the second nearest entry (lower bound of all others) less that to its own (upper bound), plus
the entry's drift so far. After an update the entry's drift grows by the way it moved and the longest way that another
one moved: the parts whose key lies above that still have the same nearest entry, unseen. Only the others, at the top
of the heap, are popped, compared with all entries exactly, and pushed again.

Blocks of bounded size lie as files in the shared folder, their heaps in a table that each round writes anew; vectors
are read again only for blocks with popped parts. What an entry gains and loses is added up by Spark, so the driver
sees one row for each entry and dimension. Bounds carry a margin for rounding; what decides is integer arithmetic.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinsieve.llm import exchange, storage

#: Numbers that a block of vectors holds.
BLOCK_NUMBERS = 1 << 20
#: Rows that are compared with a codebook at once.
SCAN_ROWS = 4096
#: Squared distances have to stay below this, so that integer sums are exact.
TOO_FAR = 1 << 62
#: What bounds are pulled in by, as a share of the distances in them; far above the rounding of their square roots.
MARGIN = 1e-12

_STATE = "block string, state binary, moves array<struct<slot: int, delta: bigint>>, popped long, odd long"
_STATE_ARROW = pa.schema(
    [
        ("block", pa.string()),
        ("state", pa.binary()),
        ("moves", pa.list_(pa.struct([("slot", pa.int32()), ("delta", pa.int64())]))),
        ("popped", pa.int64()),
        ("odd", pa.int64()),
    ]
)


def finite(v: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))


def nearest(x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower index), the distance to it and that to the next one."""
    found, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(codes).max(initial=0)))
    kind = np.float64 if 4 * codes.shape[1] * most * most < 2**53 else np.int64  # exact either way
    c = codes.astype(kind)
    squares = (c * c).sum(axis=1)
    for at in range(0, len(x), SCAN_ROWS):
        part = slice(at, at + SCAN_ROWS)
        own = x[part].astype(kind)
        d = (own * own).sum(axis=1)[:, None] - 2 * (own @ c.T) + squares
        rows = np.arange(len(own))
        found[part] = a = d.argmin(axis=1)
        upper[part] = np.sqrt(d[rows, a])
        if len(c) > 1:
            d[rows, a] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            lower[part] = np.sqrt(d.min(axis=1))
    return found, upper, lower


def keys_of(upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Heap keys of parts: slack plus their entry's drift so far, less the margin; without a second entry endless."""
    alone = np.isinf(lower)
    bound = np.where(alone, 0.0, lower)
    return np.where(alone, np.inf, bound - upper + drift - MARGIN * (bound + upper + drift))


class SlackHeaps:
    """A block's heaps: for each part position and entry, (key, row) of the parts assigned to it."""

    def __init__(self, heaps: list[list[list[tuple[float, int]]]]):
        self.heaps = heaps

    @classmethod
    def empty(cls, parts: int, entries: int) -> "SlackHeaps":
        return cls([[[] for _ in range(entries)] for _ in range(parts)])

    def push(self, part: int, entries: np.ndarray, keys: np.ndarray, rows: np.ndarray) -> None:
        heaps, push = self.heaps[part], heapq.heappush
        for e, key, row in zip(entries.tolist(), keys.tolist(), rows.tolist(), strict=True):
            push(heaps[e], (key, row))

    def pop(self, part: int, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose bounds the drift has violated, and the entries that they were assigned to."""
        rows, entries, pop = [], [], heapq.heappop
        for e, (heap, limit) in enumerate(zip(self.heaps[part], drift.tolist(), strict=True)):
            before = len(rows)
            while heap and heap[0][0] <= limit:
                rows.append(pop(heap)[1])
            entries += [e] * (len(rows) - before)
        return np.array(rows, np.int64), np.array(entries, np.int64)

    def assigned(self, part: int, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for e, heap in enumerate(self.heaps[part]):
            if heap:
                out[[row for _, row in heap]] = e
        return out

    def packed(self) -> bytes:
        """Lists in heap order stay heaps when they are read again."""
        lists = [heap for part in self.heaps for heap in part]
        flat = [pair for heap in lists for pair in heap]
        return exchange.pack(
            np.array([len(h) for h in lists], np.int32), np.array([k for k, _ in flat], np.float64), np.array([r for _, r in flat], np.int32)
        )

    @classmethod
    def unpacked(cls, state: bytes, parts: int, entries: int) -> "SlackHeaps":
        sizes, keys, rows = exchange.unpack(state)
        pairs, cuts = list(zip(keys.tolist(), rows.tolist(), strict=True)), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        lists = [pairs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return cls([lists[p * entries : (p + 1) * entries] for p in range(parts)])


@dataclass
class Codebooks:
    """Entries (part, entry, place), what was added up for them, and how far each has drifted."""

    entries: np.ndarray
    sums: np.ndarray = field(init=False)  # per entry: its parts' sums, and their number in the last place
    drift: np.ndarray = field(init=False)

    def __post_init__(self):
        parts, k, width = self.entries.shape
        self.sums, self.drift = np.zeros((parts, k, width + 1), np.int64), np.zeros((parts, k))

    def update(self, moves: list[tuple[int, int]]) -> None:
        """Take the round's moves in, replace each used entry by the floor of its mean, and let drifts grow."""
        flat = self.sums.reshape(-1)
        for slot, delta in moves:
            flat[slot] += delta
        counts, old = self.sums[:, :, -1:], self.entries
        self.entries = np.where(counts > 0, self.sums[:, :, :-1] // np.maximum(counts, 1), old)
        way = np.sqrt(((self.entries - old).astype(np.float64) ** 2).sum(axis=2)) * (1 + MARGIN)
        for p, moved in enumerate(way):
            order = np.argsort(-moved, kind="stable")
            others = np.full(len(moved), moved[order[0]])
            others[order[0]] = moved[order[1]] if len(moved) > 1 else 0.0
            self.drift[p] += moved + others

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, p * width : (p + 1) * width] for p in range(parts)]


def _moves(sums: np.ndarray) -> list[dict]:
    flat = sums.reshape(-1)
    return [{"slot": s, "delta": d} for s, d in zip(np.flatnonzero(flat).tolist(), flat[flat != 0].tolist(), strict=True)]


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)


def _vectors(block: pa.RecordBatch) -> np.ndarray:
    column = block.column(block.num_columns - 1)
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(block), -1).astype(np.int64)


def _first(books: Codebooks, folder: str, dims: int, kept: int):
    """Blocks of the input's vectors as files, every part assigned by a full scan."""
    parts, k, _ = books.entries.shape
    rows_at_once = max(1, BLOCK_NUMBERS // dims)

    def settle(columns: list[pa.Array], x: np.ndarray, odd: int) -> dict:
        most = max(int(x.max()), -int(x.min()))
        if most >= 1 << 31 or 4 * most * most * (dims // parts) >= TOO_FAR:
            raise ValueError("components are too large for exact squared distances")
        block = pa.RecordBatch.from_arrays([*columns, pa.array([row.tobytes() for row in x.astype("<i4")], pa.binary())], names=[f"c{i}" for i in range(kept + 1)])
        name = f"{folder}/{uuid.uuid4().hex}"  # a name of the attempt's own: rows may come in another order when it runs again
        storage.write_part(name, [block], block.schema)
        heaps, sums = SlackHeaps.empty(parts, k), np.zeros_like(books.sums)
        for p, own in enumerate(_cut(x, parts)):
            found, upper, lower = nearest(own, books.entries[p])
            heaps.push(p, found, keys_of(upper, lower, books.drift[p][found]), np.arange(len(own)))
            np.add.at(sums[p], found, _with_ones(own))
        return {"block": name, "state": heaps.packed(), "moves": _moves(sums), "popped": parts * len(x), "odd": odd}

    def run(batches):
        waiting, count, odd = [], 0, 0
        for batch in batches:
            column = batch.column(kept)
            right = pa.array(column.value_lengths().to_numpy(zero_copy_only=False) == dims)
            odd += len(batch) - right.true_count
            batch = batch.filter(right)
            x = batch.column(kept).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dims)
            for at in range(0, len(batch), rows_at_once):
                piece = batch.slice(at, rows_at_once)
                waiting.append((piece.columns[:kept], x[at : at + rows_at_once]))
                count += len(piece)
                if count >= rows_at_once:
                    yield _rows([settle(*_joined(waiting, kept), 0)])
                    waiting, count = [], 0
        if count or odd:
            done = settle(*_joined(waiting, kept), odd) if count else {"block": None, "state": None, "moves": [], "popped": 0, "odd": odd}
            yield _rows([done])

    return run


def _joined(pieces: list, kept: int) -> tuple[list[pa.Array], np.ndarray]:
    columns = [pa.concat_arrays([columns[i] for columns, _ in pieces]) for i in range(kept)]
    return columns, np.concatenate([x for _, x in pieces])


def _rows(found: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema=_STATE_ARROW)


def _rescan(heaps: SlackHeaps, books: Codebooks, block: str, sums: np.ndarray | None) -> tuple[int, pa.RecordBatch | None]:
    """Pop what the drift has violated, compare it with all entries, push it again; ``sums`` gains what has moved."""
    parts, loaded, popped = len(books.entries), None, 0
    for p in range(parts):
        rows, before = heaps.pop(p, books.drift[p])
        if not len(rows):
            continue
        if loaded is None:
            loaded = next(iter(storage.read_part(block)))
            cut = _cut(_vectors(loaded), parts)
        own = cut[p][rows]
        found, upper, lower = nearest(own, books.entries[p])
        heaps.push(p, found, keys_of(upper, lower, books.drift[p][found]), rows)
        popped += len(rows)
        if sums is not None:
            moved = found != before
            np.add.at(sums[p], found[moved], _with_ones(own[moved]))
            np.subtract.at(sums[p], before[moved], _with_ones(own[moved]))
    return popped, loaded


def _next(books: Codebooks):
    parts, k, _ = books.entries.shape

    def run(batches):
        for batch in batches:
            for block, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                heaps, sums = SlackHeaps.unpacked(state, parts, k), np.zeros_like(books.sums)
                popped, _ = _rescan(heaps, books, block, sums)
                yield _rows([{"block": block, "state": heaps.packed() if popped else state, "moves": _moves(sums), "popped": popped, "odd": 0}])

    return run


def _last(books: Codebooks, kept: int, digit: str):
    parts, k, _ = books.entries.shape

    def run(batches):
        for batch in batches:
            for block, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                heaps = SlackHeaps.unpacked(state, parts, k)
                _, loaded = _rescan(heaps, books, block, None)
                loaded = loaded if loaded is not None else next(iter(storage.read_part(block)))
                x = _vectors(loaded)
                codes = np.stack([heaps.assigned(p, len(x)) for p in range(parts)], axis=1)
                errors = sum(((own - books.entries[p][codes[:, p]]) ** 2).sum(axis=1) for p, own in enumerate(_cut(x, parts)))
                texts = [row.tobytes().hex() for row in codes.astype(digit)]
                yield pa.RecordBatch.from_arrays(
                    [*loaded.columns[:kept], pa.array(texts, pa.string()), pa.array(errors, pa.int64())], names=[f"c{i}" for i in range(kept + 2)]
                )

    return run


@dataclass
class Compressed:
    """Rows with codes; the codebooks; and how many parts each assignment compared with all entries."""

    rows: DataFrame
    books: Codebooks | None
    scanned: list[int]


def compress(
    vectors: DataFrame,
    work: storage.Workspace,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: tuple[str, ...] = (),
) -> Compressed:
    """``vec_id``, the columns in ``keep``, ``code`` (hex digits, two a part, four beyond 256 entries) and ``error``.

    Rows whose vector is null or holds a null or non-finite component go. Components become floor(scale * x);
    ones beyond 31 bits, or so large that squared distances leave 62 bits, are refused. Codebooks start as the rows with
    the smallest ids (null ids come last, equal ids by their vectors; repeated rows each count); with fewer rows there
    are fewer entries. Vectors as long as the first of those take part; one of another length has null code and error.
    A length that can't be cut in equal parts is refused. Empty tables give no rows. Columns not in ``keep`` are
    ignored; one named like a result is refused.
    """
    spark = vectors.sparkSession
    if clash := {c.lower() for c in keep} & {"vec_id", "code", "error"}:
        raise ValueError(f"columns to keep are named like results: {sorted(clash)}")
    whole = F.transform(F.col(vector_col), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    plain = vectors.where(finite(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), *[F.col(c) for c in keep], whole.alias("v"))
    kept = 1 + len(keep)
    shape = T.StructType([*plain.schema.fields[:kept], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def smallest(rows: DataFrame) -> list:
        return [r["v"] for r in rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]

    first = smallest(plain)
    if not first:
        return Compressed(spark.createDataFrame([], shape), None, [])
    dims = len(first[0])
    if not dims or dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut in {parts} equal parts")
    if any(len(v) != dims for v in first):
        first = smallest(plain.where(F.size("v") == dims))
    books = Codebooks(np.array(first, np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy())
    blocks, scanned = f"{work.path}/blocks", []
    renamed = plain.toDF(*[f"c{i}" for i in range(kept + 1)])
    state = work.table(renamed.mapInArrow(_first(books, blocks, dims, kept), _STATE), "state0")
    odd = state.agg(F.sum("odd")).collect()[0][0]
    for r in range(rounds):
        if r:
            state = work.table(state.where("block IS NOT NULL").select("block", "state").mapInArrow(_next(books), _STATE), f"state{r}")
            work.drop(f"state{r - 1}")
        scanned.append(state.agg(F.sum("popped")).collect()[0][0] or 0)
        moves = state.select(F.explode("moves").alias("m")).groupBy("m.slot").agg(F.sum("m.delta").alias("delta")).collect()
        books.update([(m["slot"], m["delta"]) for m in moves])  # a row for each entry and dimension, at most
    numbered = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(shape.fields)])
    coded = state.where("block IS NOT NULL").select("block", "state").mapInArrow(_last(books, kept, ">u1" if entries <= 256 else ">u2"), numbered).toDF(*shape.names)
    if odd:
        others = plain.where(F.size("v") != dims).select(*plain.columns[:kept], F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        coded = coded.unionByName(others)
    coded = work.table(coded, "coded")
    work.drop(f"state{max(rounds - 1, 0)}")
    work.drop("blocks")
    return Compressed(coded, books, scanned)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    done = compress(vectors, storage.Workspace(spark, "codes"), keep=("label",))
    digest = F.lit(done.books.digest() if done.books else None).cast("string")
    totals = done.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.withColumnRenamed("label", "total_label")
    rows = done.rows.join(totals, done.rows["label"].eqNullSafe(totals["total_label"]))
    return rows.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""found{r} AS MATERIALIZED (
  SELECT vec_id, p, CAST(m % 256 AS INTEGER) AS e, m // 256 AS d
  FROM (SELECT s.vec_id, s.p, min(CAST(list_dot_product(s.x, s.x) - 2 * list_dot_product(s.x, b.c) + list_dot_product(b.c, b.c) AS BIGINT) * 256 + b.e) AS m
        FROM parts s JOIN book{r} b ON s.p = b.p GROUP BY s.vec_id, s.p)
)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (
  SELECT p, e, list(y ORDER BY i) AS c
  FROM (SELECT f.p, f.e, i, floor(sum(s.x[i]) / count(*)) AS y
        FROM found{r} f JOIN parts s ON f.vec_id = s.vec_id AND f.p = s.p, range(1, (SELECT max(len(x)) FROM parts) + 1) AS places(i)
        GROUP BY f.p, f.e, i)
  GROUP BY p, e
), book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e
)""")
    middle = ", ".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, CAST(p AS INTEGER) AS p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS places(p)
), book0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS e, x FROM parts) WHERE e < 256
), {middle}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM found{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{rounds})
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, g.codebooks_sha256
FROM coded c JOIN kept k ON c.vec_id = k.vec_id, digest g
"""


ORACLE_OP13 = _sql()
