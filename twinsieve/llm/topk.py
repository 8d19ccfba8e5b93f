"""Exact top-k search by integer inner product: columnar branch-and-bound.

Queries and candidates are dealt into blocks of bounded size, and each block of either kind meets each of the other in
a task of its own, by key; nothing is collected or broadcast. Candidates are held in vertical layout, a few thousand
vectors at a time, one row for each dimension. Scores grow by one block of dimensions at a time for all queries of a block. After each block
of dimensions a pair survives only if its score so far, plus the most that its remaining dimensions can add (the
product of the two remaining norms), reaches the query's k-th best score so far; once few pairs survive they are
compacted to a list, and later dimensions are added for the list alone. Every pruned pair is proven to be below the
k-th score, so the result is exact.

A task tells the k best of its candidates for each of its queries, and these are merged for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm import exchange

#: Rows that a block of queries, or of candidates, holds, more or less.
QUERY_ROWS = CANDIDATE_ROWS = 32_768
BLOCK_QUERIES = 128
BLOCK_CANDIDATES = 4096
DIMENSIONS_AT_ONCE = 16
DENSE_SHARE = 0.2


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``vec_id, v``: floor(scale * x) in double arithmetic; rows that are null or hold a null or non-finite part go."""
    x = F.transform(F.col(vector_col), lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _order(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * n
        self.floor = np.full(n, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        keep = _order(scores, ids, self.k)
        self.scores[q], self.ids[q] = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.floor[q] = self.scores[q][-1]


def _remaining(m: np.ndarray, step: int) -> np.ndarray:
    """Norms of what is left after each block of dimensions; m has a row for each dimension."""
    squares = (m.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1]
    tails = [squares[d] if d < len(m) else np.zeros(m.shape[1]) for d in range(step, len(m) + step, step)]
    return np.sqrt(np.array(tails)) * (1 + 1e-12)


def search_block(queries: np.ndarray, query_ids: np.ndarray, query_tails: np.ndarray, best: Best, at: int, block: np.ndarray, ids: np.ndarray, tails: np.ndarray, exact: type) -> None:
    """Offer a block of candidates (dimension x candidate) to a block of queries (dimension x query)."""
    dims, step = len(block), DIMENSIONS_AT_ONCE
    floor = best.floor[at : at + queries.shape[1]]
    score, pairs = np.zeros((queries.shape[1], block.shape[1]), exact), None
    for b, d in enumerate(range(0, dims, step)):
        q, c = queries[d : d + step], block[d : d + step]
        if pairs is None:
            score += q.T @ c
            alive = score + np.multiply.outer(query_tails[b], tails[b]) >= floor[:, None]
            if alive.mean() < DENSE_SHARE or d + step >= dims:
                qi, ci = np.nonzero(alive)
                pairs, score = (qi, ci), score[qi, ci]
        else:
            qi, ci = pairs
            score = score + np.einsum("ij,ij->j", q[:, qi], c[:, ci])
            alive = score + query_tails[b][qi] * tails[b][ci] >= floor[qi]
            pairs, score = (qi[alive], ci[alive]), score[alive]
    qi, ci = pairs
    own = query_ids[qi] == ids[ci]
    qi, ci, score = qi[~own], ci[~own], score[~own].astype(np.int64)
    cuts = np.searchsorted(qi, np.arange(queries.shape[1] + 1))
    for j in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[j], cuts[j + 1])
        best.add(at + j, score[part], ids[ci[part]])


def _packed(rows: DataFrame, side: int, own: str, others: str, count: int) -> DataFrame:
    """Each block of rows (``vec_id, v``, block ``own``) as one value, sent to all blocks of the other kind."""

    def pack(key, table):
        ids, vectors = table["vec_id"].to_numpy(), table["v"].combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if not len(flat) or (flat.min() >= -(2**31) and flat.max() < 2**31):
            flat = flat.astype("<i4")
        return pa.table({"dims": [key[0]], own: [key[1]], "payload": pa.array([exchange.pack(ids, flat)], pa.binary())}, schema=schema)

    schema = pa.schema([("dims", pa.int32()), (own, pa.int32()), ("payload", pa.binary())])
    blocks = rows.groupBy("dims", own).applyInArrow(pack, f"dims int, {own} int, payload binary")
    sent = blocks.withColumn(others, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return sent.select("dims", "qb", "cb", F.lit(side).alias("side"), "payload")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    query_rows: int | None = None,
    candidate_rows: int | None = None,
) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries``: ``query_id, rank, vec_id, score``.

    Vectors are turned into integers as in ``quantised``; vectors that are null, empty or hold a null or non-finite part,
    and rows whose id is null, take no part. A row with the query's own id is no candidate. Vectors of another length than
    the query's are no candidates for it. Ties go to the smaller id; repeated candidate rows each count, and a repeated
    query row counts once. Queries with no candidate have no rows. Other columns are ignored. Sums are exact while
    they fit 64 bits.
    """
    schema = "query_id long, vec_id long, score long"
    candidates = quantised(vectors, id_col, vector_col, scale).where("vec_id IS NOT NULL AND size(v) > 0")
    asked = quantised(queries, id_col, vector_col, scale).where("vec_id IS NOT NULL AND size(v) > 0").dropDuplicates(["vec_id"])
    query_blocks = max(1, -(-asked.count() // (query_rows or QUERY_ROWS)))
    candidate_blocks = max(1, -(-candidates.count() // (candidate_rows or CANDIDATE_ROWS)))
    dims = F.size("v").alias("dims")
    # Candidates are dealt by their place, not by id: one that a third of all rows repeat lies in all blocks.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(candidate_blocks)).cast("int").alias("cb")
    left = _packed(asked.select("vec_id", "v", dims, F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb")), 0, "qb", "cb", candidate_blocks)
    right = _packed(candidates.select("vec_id", "v", dims, dealt), 1, "cb", "qb", query_blocks)
    found = left.unionByName(right).groupBy("dims", "qb", "cb").applyInArrow(_search(k), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(k: int):
    """The k best candidates of one block for each query of another."""

    def run(key, table):
        dims, sides = key[0].as_py(), dict(zip(table["side"].to_pylist(), table["payload"].to_pylist(), strict=True))
        if len(sides) < 2:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        (query_ids, queries), (ids, m) = ((i, v.astype(np.int64).reshape(len(i), dims)) for i, v in (exchange.unpack(sides[s]) for s in (0, 1)))
        best = Best(len(query_ids), k)
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(m).max(initial=0)) * dims
        exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
        parts = []
        for at in range(0, len(query_ids), BLOCK_QUERIES):
            part = np.ascontiguousarray(queries[at : at + BLOCK_QUERIES].T)
            parts.append((at, part.astype(exact), _remaining(part, DIMENSIONS_AT_ONCE)))
        for lo in range(0, len(ids), BLOCK_CANDIDATES):
            block = np.ascontiguousarray(m[lo : lo + BLOCK_CANDIDATES].T)
            tails, block = _remaining(block, DIMENSIONS_AT_ONCE), block.astype(exact)
            for at, part, own_tails in parts:
                search_block(part, query_ids[at : at + BLOCK_QUERIES], own_tails, best, at, block, ids[lo : lo + BLOCK_CANDIDATES], tails, exact)
        sizes = [len(x) for x in best.ids]
        return pa.table({"query_id": np.repeat(query_ids, sizes), "vec_id": np.concatenate([*best.ids, ids[:0]]), "score": np.concatenate([*best.scores, ids[:0]])})

    return run


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_OP10 = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM scored
)
SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 5
"""
