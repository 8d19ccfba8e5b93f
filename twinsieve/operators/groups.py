"""Groups of near duplicates: membership, order within a group, keepers, counts and emission order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions import scalars
from twinsieve.operators.components import connected_components
from twinsieve.operators.pairs import with_order


def group_members(pairs: DataFrame, work=None) -> DataFrame:
    """``root, id`` of every row in a pair; the root is the group's smallest id. Rows in no pair form no group."""
    return connected_components(pairs, work).select("root", F.col("node").alias("id"))


def collected(members: DataFrame) -> DataFrame:
    """One row a group: ``root, ids`` in ascending order, ``size``. For groups of a size to show, not to compute with."""
    return members.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count("*").alias("size"))


def larger_than_one(members: DataFrame, key: str = "root") -> DataFrame:
    """Drop groups of one. The sizes are counted before the join, so a large group is no window in one task."""
    sizes = members.groupBy(key).agg(F.count("*").alias("_size")).where("_size > 1").select(key)
    return members.join(sizes, key, "left_semi")


def of_type(members: DataFrame, kind: str) -> DataFrame:
    """Groups of images or of videos."""
    return members.where(F.col("type") == kind)


def _first_of(members: DataFrame, *order: Column, key: str = "root") -> DataFrame:
    """``key, keeper``: the first id of each group in an order, by a partial aggregation; no group is sorted."""
    return members.groupBy(key).agg(F.min(F.struct(*order, F.col("id").alias("_id"))).alias("_first")).select(key, F.col("_first._id").alias("keeper"))


def keep_first(members: DataFrame, key: str = "root") -> DataFrame:
    return _first_of(members, F.col("ord").alias("_o"), key=key)


def keep_best_image(members: DataFrame, key: str = "root") -> DataFrame:
    """The most pixels; the first of equals."""
    return _first_of(members, (-(F.col("width").cast("long") * F.col("height"))).alias("_a"), F.col("ord").alias("_o"), key=key)


def keep_best_video(members: DataFrame, key: str = "root") -> DataFrame:
    """The most bytes; the first of equals."""
    return _first_of(members, (-F.col("size").cast("long")).alias("_a"), F.col("ord").alias("_o"), key=key)


def ranked(members: DataFrame, key: str = "root") -> DataFrame:
    """Add ``rank`` from 1: larger files first, then more pixels, names without copy marks, older files, listing order."""
    order = Window.partitionBy(key).orderBy(
        F.desc("size"),
        F.desc(F.col("width").cast("long") * F.col("height")),
        scalars.has_copy_number(F.col("name")).cast("int"),
        scalars.has_copy_suffix(F.col("name")).cast("int"),
        F.col("ctime"),
        F.col("ord"),
    )
    return members.withColumn("rank", F.row_number().over(order))


def preselected(ranked_members: DataFrame) -> DataFrame:
    """All but the first of each group are marked for removal."""
    return ranked_members.withColumn("selected", F.col("rank") > 1)


def emission_order(members: DataFrame, key: str = "root") -> DataFrame:
    """``root, type, ordinal`` from 1: image groups before video groups, each by its first member."""
    firsts = members.groupBy(key, "type").agg(F.min("ord").alias("first"))
    return with_order(firsts, "type", "first").select(key, "type", (F.col("ord") + 1).alias("ordinal"))


def enrich(members: DataFrame, metadata: DataFrame, on: str = "path") -> DataFrame:
    """Left join with what is known of each file; files without metadata count as 0x0."""
    out = members.join(metadata, on, "left")
    zero = {c: 0 for c in ("width", "height", "size") if c in metadata.columns}
    return out.fillna(zero)


def result_counts(members: DataFrame, key: str = "root") -> DataFrame:
    """``groups, items`` for each type."""
    return members.groupBy("type").agg(F.count_distinct(key).alias("groups"), F.count("*").alias("items"))


def action_plan(members: DataFrame, keepers: DataFrame, output: str | None = None, key: str = "root") -> DataFrame:
    """``action, src, dest``: keep the keeper of each group, move the others to ``output``, or remove them without one.

    Nothing is carried out here. Of files that would share a destination the first in listing order keeps its name, and
    the others are numbered from above the largest number that a name of that kind has, so all destinations differ.
    """
    joined = members.join(keepers, key).withColumn("keep", F.col("id") == F.col("keeper"))
    action = F.when(F.col("keep"), "keep").otherwise("move" if output is not None else "remove")
    if output is None:
        return joined.select(action.alias("action"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dest"))
    name = scalars.base_name(F.col("path"))
    ending = r"(?<=[^.])(\.[^.]+)$"
    named = with_order(joined.select("keep", "path", name.alias("name"), F.col("ord").alias("_ord")), "keep", "name", "_ord", name="_place")
    named = named.withColumns({"stem": F.regexp_replace("name", ending, ""), "ext": F.regexp_extract("name", ending, 1)})
    moved = named.where(~F.col("keep"))
    first = moved.groupBy("name").agg(F.min("_place").alias("_first"))
    marked = r"^(.*) \((\d{1,17})\)$"
    taken = moved.select(F.regexp_extract("stem", marked, 1).alias("stem"), "ext", F.regexp_extract("stem", marked, 2).try_cast("long").alias("n"))
    most = taken.where("n IS NOT NULL").groupBy("stem", "ext").agg(F.max("n").alias("_most"))
    turned = moved.join(first, "name").join(most, ["stem", "ext"], "left").withColumn("_turn", F.col("_place") - F.col("_first"))
    number = (F.col("_turn") + F.coalesce("_most", F.lit(0))).cast("string")
    new = F.when(F.col("_turn") == 0, F.col("name")).otherwise(F.concat("stem", F.lit(" ("), number, F.lit(")"), "ext"))
    moves = turned.select(F.lit("move").alias("action"), F.col("path").alias("src"), F.concat(F.lit(output.rstrip("/") + "/"), new).alias("dest"))
    return joined.where("keep").select(F.lit("keep").alias("action"), F.col("path").alias("src"), F.lit(None).cast("string").alias("dest")).unionByName(moves)
