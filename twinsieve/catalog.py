"""Named queries over the test tables, and the SQL that gives the same rows.

The tables hold no pictures. A row of ``embeddings`` stands for a picture's vector, 8x8 luma grid or descriptor, its
``label`` for a video or picture; ``documents`` stand for files, ``events`` of a user for the frames of a video, and
``pages.url`` for paths. Scores are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.functions import kernels, scalars
from twinsieve.operators import blocklist, groups, pairs, video
from twinsieve.plans import report, resources
from twinsieve.plans.workspace import Workspace
from twinsieve.sources import media

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id1", "id2", F.round("score", 6).alias("score"))


# Pairs ------------------------------------------------------------------------------------------------------------

_COSINE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id1, b.vec_id AS id2, (greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))) + 1) / 2 AS score
      FROM e a JOIN e b ON a.vec_id < b.vec_id)
"""
_EDGES = _COSINE.replace("WITH e", "WITH RECURSIVE e", 1) + """,
s AS (SELECT id1, id2 FROM p WHERE score >= 0.70),
both_ways AS (SELECT id1 AS u, id2 AS v FROM s UNION SELECT id2, id1 FROM s),
reach AS (SELECT u AS id, u AS r FROM both_ways UNION SELECT b.v, reach.r FROM reach JOIN both_ways b ON b.u = reach.id),
g AS (SELECT id, min(r) AS root FROM reach GROUP BY id)
"""


def _vectors(spark, sf_dir):
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("f"))


@query(_COSINE + "SELECT id1, id2, round(score, 6) AS score FROM p WHERE score >= 0.70")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(pairs.cosine_pairs(_vectors(spark, sf_dir), 0.70))


@query(_EDGES + "SELECT root, id FROM g")
def cosine_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_members(pairs.cosine_pairs(_vectors(spark, sf_dir), 0.70))


@query(_EDGES + "SELECT root, count(*) AS size, max(id) AS last_id FROM g GROUP BY root HAVING count(*) > 1")
def cosine_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = groups.larger_than_one(groups.group_members(pairs.cosine_pairs(_vectors(spark, sf_dir), 0.70)))
    return members.groupBy("root").agg(F.count("*").alias("size"), F.max("id").alias("last_id"))


@query(_EDGES + "SELECT g.root, arg_max(g.id, e.label * 100000 - g.id) AS keeper FROM g JOIN embeddings e ON e.vec_id = g.id GROUP BY g.root")
def cosine_keepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near vectors, and in each the row to keep: the largest by label, the first of equals."""
    members = groups.group_members(pairs.cosine_pairs(_vectors(spark, sf_dir), 0.70))
    labels = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("width"), F.lit(1).alias("height"), F.col("vec_id").alias("ord"))
    return groups.keep_best_image(members.join(labels, "id"))


def hashed(df: DataFrame, method: str) -> DataFrame:
    """``id, f``: hashes of 8x8 grids (``id, f`` with 64 numbers); null where there is no such grid."""

    def run(batches):
        for batch in batches:
            fine = np.asarray(batch.column(1).is_valid())
            grids = batch.column(1).drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            found = np.zeros(len(batch), np.int64)
            found[fine] = kernels.grid_hashes(grids, method) if fine.any() else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, mask=~fine)], names=["id", "f"])

    grid = F.when((F.size("f") == 64) & ~F.exists("f", lambda x: x.isNull()), F.col("f"))
    return df.select("id", grid.alias("f")).mapInArrow(run, "id long, f long")


def _hash_pairs(spark, sf_dir, method, threshold=0.70):
    return _scored(pairs.hash_pairs(hashed(_vectors(spark, sf_dir), method), threshold))


_E = "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_HASH_TAIL = """
SELECT a.id AS id1, b.id AS id2, round(1 - hamming(a.h, b.h) / 64.0, 6) AS score
FROM hashes a JOIN hashes b ON a.id < b.id WHERE 1 - hamming(a.h, b.h) / 64.0 >= {t}
"""
_AHASH = _E + """, hashes AS (
  SELECT id, array_to_string(list_transform(v, lambda x: CASE WHEN x > list_avg(v) THEN '1' ELSE '0' END), '') AS h FROM e)
"""
_DHASH = _E + """, hashes AS (
  SELECT id, array_to_string(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0),
         lambda i: CASE WHEN v[i + 1] > v[i] THEN '1' ELSE '0' END), '') AS h FROM e)
"""
_PHASH = _E + """, basis AS (
  SELECT k, list(4 * cos(pi() * (k // 8) * (2 * (p // 8) + 1) / 16) * cos(pi() * (k % 8) * (2 * (p % 8) + 1) / 16) ORDER BY p) AS b
  FROM range(64) t(k), range(64) u(p) GROUP BY k),
coefficients AS (SELECT e.id, list(list_dot_product(e.v, basis.b) ORDER BY k) AS c FROM e, basis GROUP BY e.id),
middle AS (SELECT id, c, list_aggregate(c, 'median') AS m FROM coefficients),
hashes AS (SELECT id, array_to_string(list_transform(c, lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), '') AS h FROM middle)
"""
_WHASH = _E + """, middle AS (SELECT id, list_transform(v, lambda x: x - list_avg(v)) AS c FROM e),
hashes AS (SELECT id, array_to_string(list_transform(c, lambda x: CASE WHEN x > list_aggregate(c, 'median') THEN '1' ELSE '0' END), '') AS h FROM middle)
"""


@query(_AHASH + _HASH_TAIL.format(t=0.70))
def ahash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_pairs(spark, sf_dir, "ahash")


@query(_DHASH + _HASH_TAIL.format(t=0.70))
def dhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_pairs(spark, sf_dir, "dhash")


@query(_PHASH + _HASH_TAIL.format(t=0.70))
def phash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_pairs(spark, sf_dir, "phash")


@query(_WHASH + _HASH_TAIL.format(t=0.70))
def whash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_pairs(spark, sf_dir, "whash")


@query(_COSINE + "SELECT p.id1, p.id2, round(p.score, 6) AS score FROM p JOIN embeddings a ON a.vec_id = p.id1 JOIN embeddings b ON b.vec_id = p.id2 WHERE p.score >= 0.70 AND a.label % 2 = b.label % 2")
def cosine_pairs_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with even and odd labels stand for images and videos, which never meet."""
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("f"), F.when(F.col("label") % 2 == 0, "image").otherwise("video").alias("kind"))
    return _scored(pairs.cosine_pairs(vectors, 0.70))


@query(_AHASH + _HASH_TAIL.format(t=0.75))
def hamming_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banded equi-join, at a threshold low enough to have rows here."""
    return _scored(pairs.hash_pairs(hashed(_vectors(spark, sf_dir), "ahash"), 0.75, band_from=0.0))


@query("""
WITH h AS (SELECT vec_id AS id, list_transform(range(8), lambda b: CAST(len(list_filter(embedding, lambda x: floor((CAST(x AS DOUBLE) + 0.4) / 0.1) = b)) AS DOUBLE)) AS c FROM embeddings),
z AS (SELECT id, list_transform(c, lambda x: x - list_avg(c)) AS c FROM h),
p AS (SELECT a.id AS id1, b.id AS id2, CASE WHEN list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c) = 0 THEN 1.0
      ELSE greatest(0.0, list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c) * list_dot_product(b.c, b.c))) END AS score
      FROM z a JOIN z b ON a.id < b.id)
SELECT id1, id2, round(score, 6) AS score FROM p WHERE score >= 0.99
""")
def histogram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter("f", lambda x: F.floor((x.cast("double") + 0.4) / 0.1) == b)).cast("double"))
    return _scored(pairs.histogram_pairs(_vectors(spark, sf_dir).select("id", bins.alias("f")), 0.99))


#: How far apart the components lie that a made-up descriptor compares; 64 bits each.
_COMPARED = (1, 8, 19, 30)


@query(f"""
WITH d AS (SELECT label AS image, vec_id AS idx, array_to_string(list_transform({list(_COMPARED)}, lambda s: array_to_string(list_transform(range(64), lambda i:
  CASE WHEN embedding[i + 1] < embedding[(i + s) % 64 + 1] THEN '1' ELSE '0' END), '')), '') AS h FROM embeddings),
b AS (SELECT a.image AS id1, c.image AS id2, a.idx AS x, c.idx AS y, hamming(a.h, c.h) AS dist FROM d a JOIN d c ON a.image < c.image),
m AS (SELECT *, row_number() OVER (PARTITION BY id1, id2, x ORDER BY dist, y) AS rx, row_number() OVER (PARTITION BY id1, id2, y ORDER BY dist, x) AS ry FROM b),
n AS (SELECT image, count(*) AS c FROM d GROUP BY image)
SELECT CAST(id1 AS BIGINT) AS id1, CAST(id2 AS BIGINT) AS id2, round(count(*) / CAST(least(any_value(p.c), any_value(q.c)) AS DOUBLE), 6) AS score
FROM m JOIN n p ON p.image = id1 JOIN n q ON q.image = id2 WHERE rx = 1 AND ry = 1 AND dist < 96 GROUP BY id1, id2
""")
def orb_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's descriptor compares its components, as one of a picture compares pixels: 256 bits in four words."""
    e = F.col("embedding")
    words = []
    for apart in _COMPARED:
        bits = [F.when(e[i] < e[(i + apart) % 64], F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(64)]
        words.append(reduce(lambda x, y: x.bitwiseOR(y), bits))
    rows = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("image_id"), F.col("vec_id").alias("idx"), F.array(*words).alias("h"))
    return _scored(pairs.descriptor_pairs(rows, 96))


# Video ------------------------------------------------------------------------------------------------------------


@query("""
WITH f AS (SELECT CAST(label AS BIGINT) AS vid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vid AS id1, b.vid AS id2, a.vec_id AS x, max((greatest(-1.0, least(1.0, list_cosine_similarity(a.v, b.v))) + 1) / 2) AS best
      FROM f a JOIN f b ON a.vid < b.vid GROUP BY a.vid, b.vid, a.vec_id)
SELECT id1, id2, round(avg(best), 6) AS score FROM s GROUP BY id1, id2
""")
def video_meanmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("v"))
    return _scored(video.mean_max_pairs(frames, 0.0))


@query("""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS total FROM events),
t AS (SELECT *, greatest(4, least(32, CAST(floor(total / 2.0) AS INTEGER))) AS target FROM f),
w AS (SELECT DISTINCT user_id, CASE WHEN target >= total THEN k ELSE least(CAST(floor(k * (total / CAST(target AS DOUBLE))) AS BIGINT), total - 1) END AS frame_idx
      FROM (SELECT user_id, any_value(total) AS total, any_value(target) AS target FROM t GROUP BY user_id) u, range(0, 100000) r(k) WHERE k < least(target, total))
SELECT t.user_id, CAST(w.frame_idx AS INTEGER) AS frame_idx, t.event_id FROM w JOIN t ON t.user_id = w.user_id AND t.i = w.frame_idx
""")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_id")
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(order) - 1).alias("frame_idx"))
    totals = events.groupBy("user_id").agg(F.count("*").alias("total"))
    target = video.target_frames(F.col("total"), rate=0.5)
    wanted = totals.select("user_id", F.explode(video.keyframe_indices(F.col("total"), target)).alias("frame_idx")).distinct()
    return events.join(wanted, ["user_id", "frame_idx"]).select("user_id", "frame_idx", "event_id")


@query("""
SELECT CAST(coalesce(floor(avg(w)), 1920) AS INTEGER) AS width, CAST(coalesce(floor(avg(h)), 1080) AS INTEGER) AS height
FROM (SELECT n_chars AS w, n_chars // 2 AS h FROM documents WHERE n_chars // 2 > 0 ORDER BY doc_id LIMIT 3)
""")
def average_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return video.average_resolution(docs.select(F.col("n_chars").alias("width"), F.floor(F.col("n_chars") / 2).alias("height"), F.col("doc_id").alias("ord")))


@query("""
SELECT doc_id AS video_id, CAST(i - 1 AS INTEGER) AS frame_idx, len(line) AS n_chars
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
""")
def flattened_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines stand for a video's frames."""
    videos = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.split("text", "\n").alias("frames"))
    return video.flattened(videos).select("video_id", "frame_idx", F.char_length("v").cast("long").alias("n_chars"))


# Groups -----------------------------------------------------------------------------------------------------------

_FILES = """
WITH f AS (SELECT doc_id AS id, md5(text) AS root, n_chars, source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'a (' || doc_id || ').txt' ELSE 'a' || doc_id || '.txt' END AS path,
           n_chars + doc_id % 7 AS size, doc_id % 5 + 1 AS width, doc_id % 4 + 1 AS height, doc_id AS ord, CAST(doc_id % 11 AS DOUBLE) AS ctime,
           CASE WHEN doc_id % 3 = 0 THEN 'a (' || doc_id || ').txt' ELSE 'a' || doc_id || '.txt' END AS name FROM documents),
d AS (SELECT * FROM f WHERE root IN (SELECT root FROM f GROUP BY root HAVING count(*) > 1))
"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: equal texts form a group; sizes, pixels and names differ within it."""
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("a ("), i, F.lit(").txt"))).otherwise(F.concat(F.lit("a"), i, F.lit(".txt")))
    files = _read(spark, sf_dir, "documents").select(
        i.alias("id"), F.md5("text").alias("root"), "n_chars", F.concat_ws("/", "source", name).alias("path"), name.alias("name"), (F.col("n_chars") + i % 7).alias("size"),
        (i % 5 + 1).alias("width"), (i % 4 + 1).alias("height"), i.alias("ord"), (i % 11).cast("double").alias("ctime"),
    )
    return groups.larger_than_one(files)


@query(_FILES + "SELECT root, count(*) AS size, min(id) AS first_id FROM d GROUP BY root")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


@query(_FILES + "SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS rn FROM f) WHERE rn = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, F.concat(F.lit("a ("), i, F.lit(").txt"))).otherwise(F.concat(F.lit("a"), i, F.lit(".txt")))
    files = docs.select(F.md5("text").alias("root"), F.struct(i.alias("id"), F.concat_ws("/", "source", name).alias("path")).alias("row"))
    return files.groupBy("root").agg(F.min("row").alias("row")).select("row.id", "row.path")


@query("SELECT min(doc_id) AS ord, '/f/' || doc_id // 3 AS path FROM documents GROUP BY doc_id // 3")
def path_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents stand for listings of one file, under paths that are written in different ways."""
    i = F.floor(F.col("doc_id") / 3).cast("string")
    turn = F.col("doc_id") % 4
    path = F.when(turn == 0, F.concat(F.lit("/f/"), i)).when(turn == 1, F.concat(F.lit("/f//./"), i)).when(turn == 2, F.concat(F.lit("/f/x/../"), i)).otherwise(F.concat(F.lit("/g/../f/"), i, F.lit("/")))
    first = media.first_by_path(_read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), path.alias("path")), "ord")
    return first.select("ord", F.concat(F.lit("/f/"), F.floor(F.col("ord") / 3).cast("string")).alias("path"))


@query(_FILES + "SELECT root, min(ord) AS keeper FROM d GROUP BY root")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.keep_first(_files(spark, sf_dir))


@query(_FILES + "SELECT root, id AS keeper FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY width * height DESC, ord) AS rn FROM d) WHERE rn = 1")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.keep_best_image(_files(spark, sf_dir))


@query(_FILES + "SELECT root, id AS keeper FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY size DESC, ord) AS rn FROM d) WHERE rn = 1")
def keep_best_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.keep_best_video(_files(spark, sf_dir))


@query(_FILES + """SELECT root, id, CAST(rn AS INTEGER) AS "rank", rn > 1 AS selected FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY size DESC, width * height DESC,
CAST(regexp_matches(name, '\\(\\d+\\)') AS INTEGER), ctime, ord) AS rn FROM d)""")
def group_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.preselected(groups.ranked(_files(spark, sf_dir))).select("root", "id", "rank", "selected")


@query(_FILES + """, t AS (SELECT root, CASE WHEN min(ord) % 2 = 0 THEN 'image' ELSE 'video' END AS type, min(ord) AS first FROM d GROUP BY root)
SELECT root, type, row_number() OVER (ORDER BY type, first) AS ordinal FROM t""")
def emission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    kind = files.groupBy("root").agg(F.when(F.min("ord") % 2 == 0, "image").otherwise("video").alias("type"))
    return groups.emission_order(files.join(kind, "root"))


@query(_FILES + "SELECT CASE WHEN ord % 2 = 0 THEN 'image' ELSE 'video' END AS type, count(DISTINCT root) AS groups, count(*) AS items FROM d GROUP BY 1")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.result_counts(_files(spark, sf_dir).withColumn("type", F.when(F.col("ord") % 2 == 0, "image").otherwise("video")))


@query(_FILES + """SELECT CASE WHEN rn = 1 THEN 'keep' ELSE 'move' END AS action, path AS src, CASE WHEN rn > 1 THEN '/out/' || name END AS dest
FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS rn FROM d)""")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return groups.action_plan(files.drop("name"), groups.keep_first(files), "/out")


@query(_FILES + "SELECT d.id, d.path, coalesce(l.quality + 1, 0) AS width, coalesce(l.toxic + 1, 0) AS height FROM d LEFT JOIN labels l ON l.doc_id = d.id")
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, which only some documents have, stand for metadata that could be read."""
    meta = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") + 1).alias("width"), (F.col("toxic") + 1).alias("height"))
    return groups.enrich(_files(spark, sf_dir).select("id", "path"), meta, "id").select("id", "path", "width", "height")


# Blocklist --------------------------------------------------------------------------------------------------------

_LISTS = """
WITH f AS (SELECT md5(text) AS root, 'p' || doc_id AS path, doc_id FROM documents),
g AS (SELECT root, list(path ORDER BY path) AS paths, min(doc_id) AS first FROM f GROUP BY root HAVING count(*) > 1),
e AS (SELECT first AS entry_id, CASE WHEN first % 4 = 0 THEN paths[1:1] WHEN first % 4 = 1 THEN list_append(paths, 'other') WHEN first % 4 = 2 THEN ['x' || first] ELSE ['', paths[1]] END AS paths FROM g),
n AS (SELECT entry_id, list_filter(paths, lambda p: p <> '') AS paths FROM e)
"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Groups of equal documents as ``root, path, first`` rows, and an entry made from each as ``entry_id, path`` rows: a
    part of it, a superset, a stranger."""
    f = _read(spark, sf_dir, "documents").select(F.md5("text").alias("root"), F.concat(F.lit("p"), "doc_id").alias("path"), "doc_id")
    g = f.groupBy("root").agg(F.min("path").alias("least"), F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    work, k = Workspace(spark, "lists"), F.col("first") % 4
    g = work.table(g.select("root", "least", "first"), "groups")
    members = work.table(f.join(g, "root").select("root", "path", "first"), "members")
    alone = F.when(k == 0, F.array("least")).when(k == 1, F.array(F.lit("other"))).when(k == 2, F.array(F.concat(F.lit("x"), "first"))).otherwise(F.array(F.lit(""), "least"))
    entries = g.select(F.col("first").alias("entry_id"), F.explode(alone).alias("path"))
    return members, entries.unionByName(members.where(k == 1).select(F.col("first").alias("entry_id"), "path"))


_BLOCKED = "EXISTS (SELECT 1 FROM n WHERE len(n.paths) > 0 AND (list_has_all(g.paths, n.paths) OR list_has_all(n.paths, g.paths)))"


@query(_LISTS + f"SELECT root, first FROM g WHERE NOT {_BLOCKED}")
def blocklist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = _lists(spark, sf_dir)
    return g.select("root", "first").distinct().join(blocklist.blocked_keys(g, e), "root", "left_anti")


@query(_LISTS + f"SELECT count(*) FILTER (WHERE {_BLOCKED}) AS blocked, count(*) FILTER (WHERE NOT {_BLOCKED}) AS kept FROM g")
def blocklist_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = _lists(spark, sf_dir)
    return blocklist.counted_blocked(g.select("root").distinct(), blocklist.blocked_keys(g, e))


@query(_LISTS + """, h AS (SELECT g.root, min(n.entry_id) AS entry_id FROM g JOIN n ON len(n.paths) > 0 AND (list_has_all(g.paths, n.paths) OR list_has_all(n.paths, g.paths)) GROUP BY g.root)
SELECT g.root, CASE WHEN h.entry_id IS NULL THEN 'added' WHEN list_has_all(n.paths, g.paths) THEN 'covered' ELSE 'replaced' END AS status, h.entry_id
FROM g LEFT JOIN h ON h.root = g.root LEFT JOIN n ON n.entry_id = h.entry_id""")
def blocklist_add_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocklist.classified(*_lists(spark, sf_dir))


@query("""
WITH RECURSIVE u AS (SELECT page_id, list_filter(string_split(lower(url), '/'), lambda p: p <> '') AS p FROM pages),
w AS (SELECT page_id, list_sort(list_distinct(list_transform(range(2, 2 + page_id % 3), lambda i: array_to_string(p[2 : i], '/')))) AS paths FROM u),
g AS (SELECT row_number() OVER (ORDER BY page_id) AS i, page_id AS ord, paths FROM w WHERE page_id % 5 <> 0 AND len(paths) > 0),
start AS (SELECT list(page_id ORDER BY page_id) AS ids, list(paths ORDER BY page_id) AS sets FROM w WHERE page_id % 5 = 0 AND len(paths) > 0),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, sets, CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS VARCHAR) AS status FROM start
  UNION ALL
  SELECT i, CASE WHEN hit IS NULL THEN list_append(sets, paths) WHEN status = 'replaced' THEN list_concat(sets[1 : hit - 1], [paths], sets[hit + 1 :]) ELSE sets END, ord, coalesce(hit, len(sets) + 1), status
  FROM (SELECT *, CASE WHEN hit IS NULL THEN 'added' WHEN list_has_all(sets[hit], paths) THEN 'covered' ELSE 'replaced' END AS status
        FROM (SELECT g.i, g.ord, g.paths, f.sets, nullif(list_position(list_transform(f.sets, lambda s: list_has_all(s, g.paths) OR list_has_all(g.paths, s)), true), 0) AS hit
              FROM fold f JOIN g ON g.i = f.i + 1))
)
SELECT ord, status, CASE WHEN hit <= len(ids) THEN ids[hit] ELSE (SELECT max(page_id) FROM w WHERE page_id % 5 = 0) + hit - len(ids) END AS entry_id FROM fold, start WHERE i > 0
""")
def blocklist_batch_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's host, and what is below it, stand for a group's paths; every fifth page is on the list before."""
    parts = F.filter(F.split(F.lower("url"), "/"), lambda p: p != "")
    upper = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.array_join(F.slice(parts, 2, n), "/"))
    pages = _read(spark, sf_dir, "pages").select("page_id", blocklist.path_set(F.slice(upper, 1, (F.col("page_id") % 3).cast("int"))).alias("paths"))
    entries = pages.where("page_id % 5 = 0").select(F.col("page_id").alias("entry_id"), "paths", F.lit(0.0).alias("timestamp"))
    groups_in_turn = pages.where("page_id % 5 <> 0").select(F.col("page_id").alias("ord"), "paths")
    return blocklist.batch_added(entries, groups_in_turn, 1.0)[1]


@query(_LISTS + "SELECT entry_id FROM e ORDER BY entry_id DESC LIMIT 15 OFFSET 15")
def blocklist_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocklist.page(_lists(spark, sf_dir)[1].select("entry_id").distinct(), 1)


@query(_LISTS + "SELECT entry_id FROM n WHERE NOT (list_has_all(paths, ['x2']) AND list_has_all(['x2'], paths))")
def blocklist_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocklist.removed_rows(_lists(spark, sf_dir)[1], ["x2", ""])


@query("SELECT page_id FROM pages WHERE starts_with(lower(url), 'https://m.')")
def folder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _read(spark, sf_dir, "pages").select("page_id", F.array("url").alias("paths"))
    return blocklist.in_folders(entries, ["HTTPS:\\\\M."]).select("page_id")


@query("SELECT (SELECT count(*) FROM pages) - (SELECT count(*) FROM pages WHERE starts_with(lower(url), 'https://m.') OR starts_with(lower(url), 'http://blog')) AS hidden")
def hidden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _read(spark, sf_dir, "pages").select("page_id", F.array("url").alias("paths"))
    return blocklist.hidden_rows(entries, ["https://M.", "http:\\\\BLOG"])


# Scalars ----------------------------------------------------------------------------------------------------------

_NAMES = """
WITH x AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a.JPG' WHEN 1 THEN 'b.tif' WHEN 2 THEN '.png' WHEN 3 THEN 'c.d.mkv' WHEN 4 THEN '..gif' WHEN 5 THEN 'e' WHEN 6 THEN '.f.Png' ELSE 'g (2).m2ts' END AS name FROM documents)
"""


@query(_NAMES + r"""SELECT doc_id, name, lower(regexp_extract(name, '^\.*[^.].*?(\.[^.]+)$', 1)) AS ext,
CASE WHEN lower(regexp_extract(name, '^\.*[^.].*?(\.[^.]+)$', 1)) IN ('.jpg','.jpeg','.png','.bmp','.gif','.tiff','.webp','.heic') THEN 'image'
     WHEN lower(regexp_extract(name, '^\.*[^.].*?(\.[^.]+)$', 1)) IN ('.mp4','.avi','.mov','.mkv','.wmv','.flv','.webm','.m4v','.ts','.m2ts','.3gp','.ogv') THEN 'video' END AS media_type,
regexp_matches(name, '\(\d+\)') AS numbered FROM x""")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("a.JPG", "b.tif", ".png", "c.d.mkv", "..gif", "e", ".f.Png", "g (2).m2ts")])
    x = _read(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 8).cast("int")).alias("name"))
    n = F.col("name")
    return x.select("doc_id", "name", scalars.extension(n).alias("ext"), scalars.media_type(n).alias("media_type"), scalars.has_copy_number(n).alias("numbered"))


_S = "CAST(n_chars AS BIGINT) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 65536 ELSE 1048576 END"


@query("""
WITH x AS (SELECT doc_id, (doc_id % 2001) / 2000.0::DOUBLE AS score, n_chars * 977 AS ms, 'a' || CASE WHEN doc_id % 3 = 0 THEN '副本' ELSE '' END || doc_id AS name, n_chars % 400 AS done FROM documents)
SELECT doc_id, printf('%.2f%%', score * 100) AS similarity, lpad(CAST(ms // 60000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 60000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS time,
contains(name, '副本') AS copied, CAST(least(100, floor(done / 300.0 * 100)) AS INTEGER) AS percent FROM x
""")
def progress_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of scores, times and progress, and the copy mark in names."""
    i, n = F.col("doc_id"), F.col("n_chars").cast("long")
    score = (i % 2001).cast("double") / F.lit(2000.0)
    name = F.concat(F.lit("a"), F.when(i % 3 == 0, scalars.COPY_SUFFIX).otherwise(""), i.cast("string"))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", scalars.format_similarity(score).alias("similarity"), scalars.format_milliseconds(n * 977).alias("time"),
        scalars.has_copy_suffix(name).alias("copied"), scalars.progress_percent(n % 400, F.lit(300)).alias("percent"),
    )


@query("""
WITH x AS (SELECT doc_id, n_chars * CAST(pow(1024, doc_id % 5) AS BIGINT) AS size FROM documents)
SELECT doc_id, CASE WHEN size < 1024 THEN printf('%.1f B', CAST(size AS DOUBLE)) WHEN size < pow(1024, 2) THEN printf('%.1f KB', size / 1024.0) WHEN size < pow(1024, 3) THEN printf('%.1f MB', size / pow(1024, 2))
     WHEN size < pow(1024, 4) THEN printf('%.1f GB', size / pow(1024, 3)) WHEN size < pow(1024, 5) THEN printf('%.1f TB', size / pow(1024, 4)) ELSE printf('%.1f PB', size / pow(1024, 5)) END AS bytes FROM x
""")
def byte_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars").cast("long") * F.pow(F.lit(1024.0), (F.col("doc_id") % 5).cast("double")).cast("long")
    return _read(spark, sf_dir, "documents").select("doc_id", scalars.format_bytes(size).alias("bytes"))


@query(f"""WITH x AS (SELECT doc_id, {_S} AS s FROM documents)
SELECT doc_id, CASE WHEN s < 1024 THEN printf('%.1f B', CAST(s AS DOUBLE)) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0)
ELSE printf('%.1f GB', s / 1073741824.0) END AS size_formatted FROM x""")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.get(F.array(*[F.lit(n) for n in (1, 64, 65536, 1048576)]), (F.col("doc_id") % 4).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", scalars.format_size(F.col("n_chars") * by).alias("size_formatted"))


@query("""WITH x AS (SELECT doc_id, n_chars * 3 - 600 AS s FROM documents)
SELECT doc_id, CASE WHEN s <= 0 THEN '00:00' WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
ELSE lpad(CAST(s // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration_formatted FROM x""")
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", scalars.format_duration(F.col("n_chars") * 3 - 600).alias("duration_formatted"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN (doc_id % 3) || 'x' || (doc_id % 5) ELSE '未知' END AS resolution, CASE WHEN source = '' THEN 'x' ELSE source || ' · x' END AS meta FROM documents")
def labels_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _read(spark, sf_dir, "documents").select("doc_id", scalars.resolution_label(i % 3, i % 5).alias("resolution"), scalars.meta_label(F.col("source"), F.lit(""), F.lit("x")).alias("meta"))


# Resources, reports -------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id = 0 THEN 0 ELSE greatest(1, least((1000000 // greatest(n_chars, 1)) * 2, doc_id)) END AS batch,
CAST(floor(CAST(doc_id AS DOUBLE) * 64 * 48 * 3 * 1.05) AS BIGINT) AS frames_bytes, doc_id * 32 * 2048 * 4 AS feature_bytes FROM documents""")
def batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", resources.batch_size(F.lit(1000000), F.greatest("n_chars", F.lit(1)), i).alias("batch"),
        resources.keyframe_bytes(i, F.lit(64), F.lit(48)).alias("frames_bytes"), resources.feature_bytes(i, F.lit(32), F.lit(2048)).alias("feature_bytes"),
    )


@query("""
WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 0.6 + (event_id % 50) / 100.0 AS ratio FROM events),
s AS (SELECT DISTINCT user_id, 0 AS i, CAST(64 AS BIGINT) AS size, false AS reduced FROM r
 UNION ALL SELECT s.user_id, s.i + 1,
   CASE WHEN ratio > 0.95 THEN greatest(1, CAST(floor(size * 0.5) AS BIGINT)) WHEN ratio > 0.90 THEN greatest(1, CAST(floor(size * 0.75) AS BIGINT))
        WHEN reduced AND ratio < 0.70 THEN least(64, greatest(CAST(floor(size * 1.25) AS BIGINT), size)) ELSE size END,
   CASE WHEN ratio > 0.90 THEN true WHEN reduced AND ratio < 0.70 THEN least(64, CAST(floor(size * 1.25) AS BIGINT)) < 64 ELSE reduced END
 FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
SELECT user_id, arg_max(size, i) AS batch FROM s GROUP BY user_id
""")
def adaptive_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = 0.6 + (F.col("event_id") % 50) / 100.0
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", ratio.alias("r")))), lambda x: x["r"]).alias("ratios"))
    return rows.select("user_id", resources.adapted_batch(F.col("ratios"), F.lit(64)).alias("batch"))


@query(_COSINE + "SELECT id1 AS image1, id2 AS image2, round(score, 4) AS similarity FROM p WHERE score >= 0.70")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_rows(pairs.cosine_pairs(_vectors(spark, sf_dir), 0.70))
