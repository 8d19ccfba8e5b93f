"""The list of groups that a user marked as false positives, and its algebra over sets of paths.

``entries`` has ``entry_id, paths, timestamp``; ids rise in the order of insertion. Paths compare as sets: empty
strings and repeats don't count.
"""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import scalars
from twinsieve.operators.components import connected_components
from twinsieve.operators.pairs import with_order
from twinsieve.plans.workspace import Workspace

ADDED, COVERED, REPLACED = "added", "covered", "replaced"


def path_set(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != ""))))


def is_blocked(group: Column, entry: Column) -> Column:
    """An entry blocks a group if either holds the other; empty entries block nothing. For sets that are at hand."""
    within = [F.size(F.array_except(a, b)) == 0 for a, b in ((entry, group), (group, entry))]
    return (F.size(entry) > 0) & (within[0] | within[1])


def path_rows(sets: DataFrame, key: str) -> DataFrame:
    """``key, path``: one row for each path of a set (``key, paths``), without empty paths and repeats."""
    return sets.select(key, F.explode(path_set(F.col("paths"))).alias("path"))


def _comparable(members: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``key, entry_id, both, n, m`` where a group (``key, path`` rows) holds an entry (``entry_id, path`` rows) or lies in it.

    One set holds the other only if they share a path, so they meet by an equi-join on paths; no set is gathered.
    """
    own, other = members.where("path <> ''").select(key, "path").distinct(), listed.where("path <> ''").select("entry_id", "path").distinct()
    sizes, counts = own.groupBy(key).agg(F.count("*").alias("n")), other.groupBy("entry_id").agg(F.count("*").alias("m"))
    shared = own.join(other, "path").groupBy(key, "entry_id").agg(F.count("*").alias("both"))
    return shared.join(sizes, key).join(counts, "entry_id").where("both = n OR both = m")


def blocked_keys(members: DataFrame, listed: DataFrame, key: str = "root") -> DataFrame:
    """The keys of the groups (``key, path`` rows) that an entry (``entry_id, path`` rows) blocks."""
    return _comparable(members, listed, key).select(key).distinct()


def _blocking(groups: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """Keys of the blocked groups; an empty group is held by every entry."""
    own = groups.select(F.col(key).alias("_key"), "paths")
    listed = path_rows(entries, "entry_id")
    hit = blocked_keys(path_rows(own, "_key"), listed, "_key")
    empty = own.where(F.size(path_set(F.col("paths"))) == 0).select("_key")
    return hit.unionByName(empty.limit(0) if listed.isEmpty() else empty)


def unblocked(groups: DataFrame, entries: DataFrame, key: str = "root") -> DataFrame:
    """The groups (``key, paths``) that no entry blocks."""
    blocked = _blocking(groups, entries, key)
    return groups.join(blocked, groups[key] == blocked["_key"], "left_anti")


def blocked_count(groups: DataFrame, entries: DataFrame, key: str = "root") -> DataFrame:
    """One row: ``blocked, kept``."""
    return counted_blocked(groups, _blocking(groups, entries, key).withColumnRenamed("_key", key), key)


def counted_blocked(groups: DataFrame, blocked: DataFrame, key: str = "root") -> DataFrame:
    """One row, ``blocked, kept``, for groups and the keys of those that are blocked."""
    joined = groups.select(key).join(blocked.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return joined.agg(F.count("_hit").alias("blocked"), F.count_if(F.col("_hit").isNull()).alias("kept"))


def classify(groups: DataFrame, entries: DataFrame, key: str = "root") -> DataFrame:
    """What adding each group (``key, paths``) alone would do; see ``classified``."""
    return classified(path_rows(groups, key), path_rows(entries, "entry_id"), key)


def classified(members: DataFrame, listed: DataFrame, key: str = "root") -> DataFrame:
    """What adding each group (``key, path`` rows) alone would do: ``key, status, entry_id``.

    The first entry in order that is not apart decides: it holds the group (covered) or the group holds it (replaced).
    Without one the group is added, with a null ``entry_id``. Empty groups are left out.
    """
    status = F.when(F.col("both") == F.col("n"), COVERED).otherwise(REPLACED)
    first = _comparable(members, listed, key).groupBy(key).agg(F.min(F.struct("entry_id", status.alias("status"))).alias("_first"))
    keys = members.where("path <> ''").select(key).distinct()
    return keys.join(first, key, "left").select(key, F.coalesce("_first.status", F.lit(ADDED)).alias("status"), F.col("_first.entry_id").alias("entry_id"))


class Fold:
    """Entries in order, to which groups are added in turn. Paths lead to the entries that hold them.

    The first entry that holds the group covers it, the first that the group holds is replaced by it, whichever comes
    first; otherwise the group becomes the last entry. Empty entries hold nothing and are passed over.
    """

    def __init__(self, entries: list[dict]):
        self.entries = [dict(e) for e in entries]
        self.sets = [{p for p in e["paths"] if p} for e in self.entries]
        self.places: dict[str, set[int]] = {}
        for i, own in enumerate(self.sets):
            self._known(i, own)

    def _known(self, place: int, paths: set[str]) -> None:
        for path in paths:
            self.places.setdefault(path, set()).add(place)

    def add(self, paths: list[str], timestamp: float) -> tuple[str, int]:
        """What became of a group that isn't empty, and the place of the entry that decided."""
        new = {p for p in paths if p}
        for i in sorted(set().union(*(self.places.get(p, ()) for p in new))):
            if new <= self.sets[i]:
                return COVERED, i
            if self.sets[i] <= new:
                self._put(i, paths, new, timestamp)
                return REPLACED, i
        self.entries.append({})
        self.sets.append(set())
        self._put(len(self.entries) - 1, paths, new, timestamp)
        return ADDED, len(self.entries) - 1

    def _put(self, place: int, paths: list[str], new: set[str], timestamp: float) -> None:
        self.entries[place] = {**self.entries[place], "paths": list(paths), "timestamp": timestamp}
        self.sets[place] = new
        self._known(place, new)


def add(entries: list[dict], paths: list[str], timestamp: float) -> tuple[list[dict], str]:
    """Add one group to a list of entries. An empty entry before any other that decides is replaced by it."""
    if not any(paths):
        raise ValueError("an entry needs a path")
    fold, empty = Fold(entries), next((i for i, e in enumerate(entries) if not any(e["paths"])), None)
    if empty is not None:
        alone = Fold(entries[:empty])
        status, _ = alone.add(paths, timestamp)
        if status == ADDED:
            return [*entries[:empty], {**entries[empty], "paths": list(paths), "timestamp": timestamp}, *entries[empty + 1 :]], REPLACED
    status, _ = fold.add(paths, timestamp)
    return fold.entries, status


def add_all(entries: list[dict], groups: list[list[str]], timestamp: float) -> tuple[list[dict], dict[str, int]]:
    """Add groups in turn, passing over empty ones; returns the entries, how many groups were added, covered and
    replaced, and the total of entries then."""
    fold, counts = Fold(entries), {ADDED: 0, COVERED: 0, REPLACED: 0}
    for paths in groups:
        if any(paths):
            counts[fold.add(paths, timestamp)[0]] += 1
    return fold.entries, counts | {"total": len(fold.entries)}


def cleared(entries: DataFrame) -> DataFrame:
    """No entries."""
    return entries.limit(0)


def resolved(entries: DataFrame, paths: str = "paths") -> DataFrame:
    """Entries whose paths are absolute, without links, dots and double slashes, as the machine that runs it sees them.

    Empty paths stay empty, so that they still count for nothing.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(paths)
            column = batch.column(at)
            fixed = [None if own is None else [p and os.path.realpath(p) for p in own] for own in column.to_pylist()]
            yield batch.set_column(at, paths, pa.array(fixed, column.type))

    return entries.mapInArrow(run, entries.schema)


def resolved_rows(rows: DataFrame, path: str = "path") -> DataFrame:
    """The same for rows with one path each."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(path)
            yield batch.set_column(at, path, pa.array([p and os.path.realpath(p) for p in batch.column(at).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


#: Groups that share paths, and have so many in all or fewer, are added in turn by one task.
LOCAL_PATHS = 200_000
_DONE = pa.schema([("ord", pa.int64()), ("paths", pa.list_(pa.string())), ("status", pa.string()), ("slot", pa.int64())])


def batch_added(entries: DataFrame, groups: DataFrame, timestamp: float, work: Workspace | None = None, local_paths: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Add groups (``ord, paths``) in the order of ``ord``, which has to be unique: the entries then, and what became of each.

    The first result is ``entry_id, paths, timestamp``, the second ``ord, status, entry_id``; new entries get the ids
    behind the largest one, in order. Groups without paths are passed over, as empty entries are. Results equal those of
    adding one by one, where the order counts: but a group depends only on earlier ones that share a path with it, or
    with one that does. Such clusters are added side by side, each in turn by one task. A cluster of over
    ``LOCAL_PATHS`` paths goes by rounds: each adds all groups that come first, of those still waiting, for each of
    their paths; these share no path, and no entry, with one another. Groups meet entries by an equi-join on paths.
    """
    spark = entries.sparkSession
    work = work or Workspace(spark, "blocklist")
    local_paths = LOCAL_PATHS if local_paths is None else local_paths
    state = work.table(entries.select(F.col("entry_id").cast("long").alias("slot"), F.col("entry_id").cast("long"), "paths", F.col("timestamp").cast("double")), "state0")
    waiting = work.table(groups.select(F.col("ord").cast("long"), "paths", path_set(F.col("paths")).alias("own")).where(F.size("own") > 0), "waiting0")
    offset = (state.agg(F.max("slot")).first()[0] or 0) + 1
    shift = offset - (waiting.agg(F.min("ord")).first()[0] or 0)  # an added group's slot lies behind all entries, in order
    waiting = work.table(_clustered(waiting, work), "clusters")
    sizes = waiting.groupBy("root").agg(F.sum(F.size("own")).alias("n"))
    large = work.table(sizes.where(F.col("n") > local_paths).select("root"), "large")
    settled, step = [work.table(_added_in_turn(state, waiting.join(large, "root", "left_anti"), shift), "done0")], 0
    state = work.table(_after(state, settled[0], timestamp), "state1")
    waiting = work.table(waiting.join(large, "root", "left_semi"), "waiting1")
    while not waiting.isEmpty():
        step += 1
        settled.append(work.table(_added_at_once(state, waiting, shift), f"done{step}"))
        state = work.table(_after(state, settled[-1], timestamp), f"state{step + 1}")
        waiting = work.table(waiting.join(settled[-1].select("ord"), "ord", "left_anti"), f"waiting{step + 1}")
        work.drop(f"state{step}")
        work.drop(f"waiting{step}")
    slots = state.select("slot", "entry_id")
    new = with_order(slots.where("entry_id IS NULL").select("slot"), "slot", work=work).select("slot", (F.col("ord") + offset).alias("entry_id"))
    ids = work.table(slots.where("entry_id IS NOT NULL").unionByName(new), "ids")
    out = state.drop("entry_id").join(ids, "slot").select("entry_id", "paths", "timestamp")
    told = reduce(DataFrame.unionByName, [done.select("ord", "status", "slot") for done in settled])
    return out, told.join(ids, "slot").select("ord", "status", "entry_id")


def _clustered(waiting: DataFrame, work: Workspace) -> DataFrame:
    """Add ``root``, the same for groups that share a path or are linked by others that do."""
    each = waiting.select("ord", F.explode("own").alias("path"))
    first = each.groupBy("path").agg(F.min("ord").alias("first"))
    links = each.join(first, "path").where("first < ord").select(F.col("first").alias("id1"), F.col("ord").alias("id2")).distinct()
    roots = connected_components(links, work).select(F.col("node").alias("ord"), F.col("root").alias("_root"))
    return waiting.join(roots, "ord", "left").withColumn("root", F.coalesce("_root", "ord")).drop("_root")


def _added_at_once(state: DataFrame, waiting: DataFrame, shift: int) -> DataFrame:
    """``ord, paths, status, slot`` of the groups that are first for all of their paths."""
    each = waiting.select("ord", F.size("own").alias("n"), F.explode("own").alias("path"))
    first = each.groupBy("path").agg(F.min("ord").alias("first"))
    ready = each.join(first, "path").groupBy("ord", "n").agg(F.min(F.col("first") == F.col("ord")).alias("ready")).where("ready").select("ord")
    own = waiting.join(ready, "ord")
    held = state.select("slot", path_set(F.col("paths")).alias("held")).where(F.size("held") > 0)
    shared = own.select("ord", F.size("own").alias("n"), F.explode("own").alias("path")).join(held.select("slot", F.size("held").alias("m"), F.explode("held").alias("path")), "path")
    hits = shared.groupBy("ord", "n", "slot", "m").agg(F.count("*").alias("both")).where("both = n OR both = m")
    status = F.when(F.col("both") == F.col("n"), COVERED).otherwise(REPLACED)
    best = hits.groupBy("ord").agg(F.min(F.struct("slot", status.alias("status"))).alias("best"))
    return own.join(best, "ord", "left").select("ord", "paths", F.coalesce("best.status", F.lit(ADDED)).alias("status"), F.coalesce("best.slot", F.col("ord") + shift).alias("slot"))


def _added_in_turn(state: DataFrame, waiting: DataFrame, shift: int) -> DataFrame:
    """The same for clusters of groups, each one by one, against the entries that share a path with any of them."""
    paths = waiting.select("root", F.explode("own").alias("path")).distinct()
    touched = state.select("slot", F.explode("paths").alias("path")).join(paths, "path").select("root", "slot").distinct()
    known = state.join(touched, "slot").select("root", F.lit(0).alias("kind"), F.col("slot").alias("at"), "paths")
    rows = known.unionByName(waiting.select("root", F.lit(1).alias("kind"), F.col("ord").alias("at"), "paths"))

    def run(table):
        listed = sorted(table.select(["kind", "at", "paths"]).to_pylist(), key=lambda r: (r["kind"], r["at"]))
        slots = [r["at"] for r in listed if r["kind"] == 0]
        fold = Fold([{"paths": [p or "" for p in r["paths"]]} for r in listed if r["kind"] == 0])
        out = []
        for r in listed:
            if r["kind"] == 1:
                status, place = fold.add([p or "" for p in r["paths"]], 0.0)
                if status == ADDED:
                    slots.append(r["at"] + shift)
                out.append({"ord": r["at"], "paths": r["paths"], "status": status, "slot": slots[place]})
        return pa.Table.from_pylist(out, schema=_DONE)

    return rows.groupBy("root").applyInArrow(run, "ord long, paths array<string>, status string, slot long")


def _after(state: DataFrame, done: DataFrame, timestamp: float) -> DataFrame:
    """The entries after a round: replaced ones with the last group that did, and the added groups."""
    last = done.where(F.col("status") != COVERED).groupBy("slot").agg(F.max_by("paths", "ord").alias("_paths"))
    joined = state.join(last, "slot", "full")
    stamp = F.when(F.col("_paths").isNotNull(), F.lit(float(timestamp))).otherwise(F.col("timestamp"))
    return joined.select("slot", "entry_id", F.coalesce("_paths", "paths").alias("paths"), stamp.alias("timestamp"))


def removed_rows(listed: DataFrame, paths: list[str]) -> DataFrame:
    """The entries (``entry_id, path`` rows) but those whose path set is exactly this one, each as its id."""
    wanted = sorted({p for p in paths if p})
    hit = F.col("path").isin(wanted) if wanted else F.lit(False)
    counts = listed.where("path <> ''").distinct().groupBy("entry_id").agg(F.count("*").alias("m"), F.count_if(hit).alias("both"))
    same = counts.where((F.col("m") == len(wanted)) & (F.col("both") == len(wanted))).select("entry_id")
    return listed.select("entry_id").distinct().join(same, "entry_id", "left_anti")


def removed(entries: DataFrame, paths: list[str]) -> DataFrame:
    """Without the entries whose path set is exactly this one."""
    wanted = path_set(F.array(*[F.lit(p) for p in paths]).cast("array<string>"))
    return entries.where(~(path_set(F.col("paths")) == wanted))


def _below(folders: list[str]) -> Column:
    """Whether one of ``paths`` begins with one of the folders."""
    starts = [f.lower().replace("\\", "/") for f in folders]

    def hit(path: Column) -> Column:
        plain = scalars.normalised_path(path)
        return reduce(Column.__or__, [F.startswith(plain, F.lit(s)) for s in starts])

    return F.exists("paths", hit) if starts else F.lit(True)


def in_folders(entries: DataFrame, folders: list[str]) -> DataFrame:
    """Entries with a path that begins with one of the folders, whatever the case and slashes; all without folders.

    A folder is a plain prefix: ``/a/foo`` also finds ``/a/foobar/x``.
    """
    return entries.where(_below(folders))


def page(entries: DataFrame, number: int, size: int = 15) -> DataFrame:
    """A page, newest entries first, pages from 0."""
    return entries.orderBy(F.desc("entry_id")).offset(number * size).limit(size)


def hidden_rows(entries: DataFrame, folders: list[str]) -> DataFrame:
    """One row, ``hidden``: how many entries a folder filter hides."""
    return entries.agg(F.count_if(~F.coalesce(_below(folders), F.lit(False))).alias("hidden"))


def hidden_count(entries: DataFrame, folders: list[str]) -> int:
    return hidden_rows(entries, folders).first()[0]
