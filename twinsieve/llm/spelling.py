"""Spelling variant grouping: words one edit apart, joined by their three rarest positional bigrams.

All bigrams of the vocabulary are ordered by how often they occur, the rarest first. One inserted, deleted or replaced
character destroys at most two bigrams of a word, so among the three rarest of either word there is one that both have,
untouched, at positions that differ by one at most. An untouched bigram has the edit on one side of it: the other side
is the same in both words, and half of the edited side is, too. So a word sends out each of its three rarest bigrams
with what stands before it and with what stands behind it, and only words that agree in one of these, which fixes the
bigram's position, meet. Pairs that meet are verified by edit distance. Everything is a join or a grouping of the
vocabulary; nothing goes through the driver.

A word's form is its near word with the largest count, where that is ``RATIO`` times its own or more; forms lead to
roots, found by doubling: each round joins links to links, so chains shrink by half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import storage

MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: The bigrams that one edit destroys, and one more.
RAREST = 3
#: Letters of words: the Latin ones of one byte in ISO 8859-1, with the two signs among them.
LETTERS = "A-Za-zÀ-ÿ"
_SMALL, _CAPITALS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """All maximal runs of letters with ``min_length`` characters or more, A-Z as small letters."""
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))


def damaged(run: Column, doc_id: Column, every: int = 199) -> Column:
    """The run, less one character where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id is empty there."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` for rows of ``word``: those long enough that occur often enough; nulls don't count."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("word").alias("n")).where(F.col("n") >= min_count)


def _rarest(words: DataFrame, work: storage.Workspace) -> DataFrame:
    """``word, n, place``: where the rarest bigrams of each word stand."""
    places = F.sequence(F.lit(0), F.char_length("word") - 2)
    grams = words.select("word", "n", F.explode(places).alias("place")).withColumn("gram", F.substring(F.col("word"), F.col("place") + 1, F.lit(2)))
    order = work.table(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")), "grams")
    ranked = grams.join(order, "gram").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "place"))), 1, RAREST).alias("rarest"))
    return ranked.select("word", "n", F.explode("rarest").alias("g")).select("word", "n", "g.place")


def _keys(word: Column, place: Column, longer: bool) -> Column:
    """What a word sends out for a bigram, as hashes; ``longer`` if it is the one with a character more.

    Two words meet by an untouched bigram and the side of it that is the same in both. The other side, ``size``
    characters in the shorter word, has the edit: in its first half or in its second one, so that the other half, from
    the word's end or the bigram on, is the same too. Where the same side is the longer one the halves are left out.
    """
    length = F.char_length(word)
    found = []
    for side, same, other in (
        ("before", F.substring(word, F.lit(1), place + 2), F.substring(word, place + 3, length)),
        ("behind", F.substring(word, place + 1, length), F.substring(word, F.lit(1), place)),
    ):
        size = F.char_length(other) - int(longer)
        half = F.floor(size / 2).cast("int")
        first, second = F.substring(other, F.lit(1), half), F.substring(other, F.char_length(other) - (size - half) + 1, length)
        halves = F.array(*[F.xxhash64(F.lit(side), F.lit(name), size, same, part) for name, part in (("first", first), ("second", second))])
        whole = F.array(F.xxhash64(F.lit(side), size, same))
        found.append(F.when(size < 0, F.array().cast("array<bigint>")).when(F.char_length(same) >= size, whole).otherwise(halves))
    return F.concat(*found)


def near_pairs(words: DataFrame, work: storage.Workspace) -> DataFrame:
    """``a, a_n, b, b_n``: all pairs of distinct words of at least four characters that are one edit apart, each once."""
    rarest = work.table(_rarest(words, work), "rarest")
    own = rarest.select("word", "n", F.explode(_keys(F.col("word"), F.col("place"), False)).alias("key"))
    longer = rarest.select("word", "n", F.explode(_keys(F.col("word"), F.col("place"), True)).alias("key"))
    left = own.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key")
    right = own.withColumn("more", F.lit(0)).unionByName(longer.withColumn("more", F.lit(1))).select(F.col("word").alias("b"), F.col("n").alias("b_n"), "key", "more")
    sizes = F.char_length("b") - F.char_length("a")
    met = left.join(right, "key").where((sizes == F.col("more")) & ((F.col("more") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def roots(links: DataFrame, work: storage.Workspace) -> DataFrame:
    """``word, root`` for rows of ``word, form`` without circles: the word at the end of each chain."""
    now, step = work.table(links.select("word", F.col("form").alias("root")), "links0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step += 1
        after = work.table(after, f"links{step}")
        work.drop(f"links{step - 1}")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_groups(words: DataFrame, work: storage.Workspace, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for rows of ``word, n`` with distinct words.

    Words are near if one inserted, deleted or replaced character makes them equal. The form of a word is its near word
    of the largest count (ties: the first by code point), if that count is ``ratio`` times its own or more, else null;
    following forms leads to the root, the word itself without a form. ``ratio`` has to be above 1, so that counts rise
    along forms and no circle exists. Words of fewer than four characters are refused, as the bigrams of such may all
    be destroyed by one edit. Null words are left out; an empty table gives no rows; other columns are ignored.
    """
    if ratio <= 1:
        raise ValueError("the ratio has to be above 1")
    words = work.table(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "words")
    if not words.where(F.char_length("word") < 4).isEmpty():
        raise ValueError("words need four characters")
    pairs = work.table(near_pairs(words, work), "pairs")
    work.drop("rarest")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best")
    stats = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = words.join(stats, "word", "left")
    taken = -F.col("best.less") >= ratio * F.col("n")
    formed = work.table(
        formed.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n")
        ),
        "formed",
    )
    for name in ("words", "grams", "pairs"):
        work.drop(name)
    ends = roots(formed.where("form IS NOT NULL").select("word", "form"), work)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    words = counted(docs.select(damaged(F.col("run"), F.col("doc_id")).alias("word")))
    return spelling_groups(words, storage.Workspace(spark, "spelling"))


ORACLE_OP12 = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[{LETTERS}]+')) AS run FROM documents
), counted AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS k, hex(encode(concat(doc_id, ':', run))) AS bytes FROM found WHERE length(run) >= {MIN_LENGTH} GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_transform(range(1, length(bytes), 2), lambda i: 16 * (strpos('0123456789ABCDEF', bytes[i]) - 1) + strpos('0123456789ABCDEF', bytes[i + 1]) - 1),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295)) AS h
  FROM counted, crc_table
), words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(k) >= {MIN_COUNT}
), shorter AS MATERIALIZED (
  SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS MATERIALIZED (
  SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.less = w.word
  UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.less = w.word
), best AS (
  SELECT word, n, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other END AS form, CASE WHEN b.other_n >= {RATIO} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word WHERE e.form IS NULL
"""
