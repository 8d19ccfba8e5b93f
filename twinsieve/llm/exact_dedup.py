"""Exact deduplication by deterministic block naming, with DataFrame operations only.

A text is cut into blocks of a fixed size. The distinct blocks are sorted within hash partitions, and a block's place
(partition and row) is its integer name. Then, level by level, the distinct pairs of adjacent names are sorted and
named in the same way, until every document has one name. Two documents have the same (level, name) exactly when their
normalised texts are equal: no step maps different things to one name.

Blocks are shuffled once, as distinct values; afterwards only names travel. The rows find their blocks' names by a
64-bit digest. Digests that different blocks share are found by counting, and those blocks are joined by content.
A block or pair that very many documents share is one row a task before the shuffle, and the joins back to the rows
are plain equi-joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import storage

BLOCK = 4096
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _names(distinct: DataFrame, *keys: str) -> DataFrame:
    """Integer names, from 1, for rows that are distinct in ``keys``: the place after sorting."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id() + 1)


def _name_blocks(blocks: DataFrame, work: storage.Workspace) -> DataFrame:
    """``row, pos, n, name`` for ``row, pos, n, block, digest``."""
    distinct = blocks.groupBy("block").agg(F.first("digest").alias("digest"))
    names = work.table(_names(distinct, "block").select("digest", "name"), "names0")
    clashes = names.groupBy("digest").count().where("count > 1").select("digest")
    rows = blocks.select("row", "pos", "n", "digest")
    if clashes.isEmpty():
        return rows.join(names, "digest").select("row", "pos", "n", "name")
    clashes = work.table(clashes, "clashes")
    plain = rows.join(names.join(clashes, "digest", "left_anti"), "digest").select("row", "pos", "n", "name")
    among = blocks.join(clashes, "digest", "left_semi")
    by_content = work.table(_names(among.select("block").distinct(), "block").withColumn("name", -F.col("name")), "names_of_clashes")
    return plain.unionByName(among.join(by_content, "block").select("row", "pos", "n", "name"))


def document_names(base: DataFrame, work: storage.Workspace, block: int = BLOCK, digest=F.xxhash64) -> DataFrame:
    """``row, level, name`` for rows with ``row`` (unique) and ``norm``."""
    pieces = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), 0))
    n = F.greatest(F.lit(1), F.ceil(F.length("norm") / block)).cast("int")
    blocks = base.select("row", n.alias("n"), F.posexplode(pieces).alias("pos", "block")).withColumn("digest", digest(F.col("block")))
    current = work.table(_name_blocks(blocks, work), "level0")
    found, level = None, 0
    while True:
        done = current.where("n = 1").select("row", F.lit(level).alias("level"), "name")
        found = done if found is None else found.unionByName(done)
        current = current.where("n > 1")
        if current.isEmpty():
            return found
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = current.groupBy("row", F.expr("CAST(pos DIV 2 AS INT)").alias("pos")).agg(
            F.expr("CAST((max(n) + 1) DIV 2 AS INT)").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b")
        )
        pairs = work.table(pairs, f"pairs{level}")
        names = work.table(_names(pairs.select("a", "b").distinct(), "a", "b"), f"names{level}")
        current = work.table(pairs.join(names, ["a", "b"]).select("row", "pos", "n", "name"), f"level{level}")


def _placed(base: DataFrame, work: storage.Workspace, block: int, digest) -> DataFrame:
    """``row, keep_id, group_size, kept`` for ``row, doc_id, norm``."""
    names = work.table(document_names(base.select("row", "norm"), work, block, digest), "names")
    ids = work.table(base.select("row", "doc_id").join(names, "row"), "ids")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    groups = work.table(ids.groupBy("level", "name").agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["level", "name"]).select("row", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("row")).alias("kept"))


def exact_groups(docs: DataFrame, work: storage.Workspace, block: int = BLOCK, digest=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are so after each run of ASCII white space has become one space; null counts as empty.
    Of equal texts the row with the smallest ``doc_id`` stays (nulls last; of repeated rows with that id, one). The
    sum is of the normalised text in UTF-8. Other columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    base = work.table(base, "base")
    sums = base.select("row", "doc_id", F.sha2("norm", 256).alias("text_sha256"))
    return sums.join(_placed(base, work, block, digest), "row").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, work: storage.Workspace, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; equal texts and the row that stays as above."""
    row = storage.free_name(docs.columns, "row")
    base = work.table(docs.withColumn(row, F.monotonically_increasing_id()), "base")
    plain = base.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    kept = _placed(plain, work, block, F.xxhash64).where("kept").select(F.col("row").alias(row))
    return base.join(kept, row, "left_semi").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs, storage.Workspace(spark, "exact"))


ORACLE_OP1 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
