"""Versions: snapshots, forks, diff, history, three-way merge, collection of garbage, retention.

A version is a DataFrame of (path, content_hash, content_type, size, updated_at);
a store of versions has a column more, its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.shared import shared_folder

SYSTEM_PREFIX = "_system_"


def at_version(store: DataFrame, name: str, forks: DataFrame | None = None) -> DataFrame:
    """The rows of a version; a fork of that name goes before a snapshot."""
    own = store.where(F.col("version") == name).drop("version")
    if forks is None:
        return own
    fork = forks.where(F.col("version") == name).drop("version")
    return fork.unionByName(own.join(fork.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti"))


def add_snapshot(store: DataFrame, head: DataFrame, name: str) -> DataFrame:
    """store and head under a new name."""
    return store.unionByName(head.withColumn("version", F.lit(name)), allowMissingColumns=True)


def promote_fork(head: DataFrame, forks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(the fork's rows as the new head, the forks without it)."""
    return forks.where(F.col("version") == name).select(*head.columns), forks.where(F.col("version") != name)


def create_fork(forks: DataFrame, head: DataFrame, name: str) -> DataFrame:
    """forks with the rows of head under a new name; a name that is taken is an error."""
    if not forks.where(F.col("version") == name).isEmpty():
        raise ValueError(f"there is a fork {name!r}")
    return add_snapshot(forks, head, name)


def abandon_fork(forks: DataFrame, name: str) -> DataFrame:
    return drop_snapshot(forks, name)


def list_forks(forks: DataFrame) -> DataFrame:
    """(version, files) of every fork."""
    return forks.groupBy("version").agg(F.count("*").alias("files"))


def rename_snapshot(store: DataFrame, old: str, new: str) -> DataFrame:
    return store.withColumn("version", F.when(F.col("version") == old, new).otherwise(F.col("version")))


def drop_snapshot(store: DataFrame, name: str) -> DataFrame:
    return store.where(F.col("version") != name)


def tree_hash(version: DataFrame) -> DataFrame:
    """One row: a hash of all paths and contents that does not depend on order."""
    h = F.xxhash64("path", "content_hash").cast("decimal(38,0)")
    return version.agg(F.sha2(F.concat_ws("/", F.count("*"), F.coalesce(F.sum(h), F.lit(0))), 256).alias("root"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_hash, new_hash) of added, modified and deleted paths."""
    a = old.select("path", F.col("content_hash").alias("old_hash"))
    b = new.select("path", F.col("content_hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return a.join(b, "path", "full_outer").withColumn("change", change).where("change is not null").select("path", "change", "old_hash", "new_hash")


def new_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content that only the new version has."""
    return new.select("content_hash").distinct().join(old.select("content_hash").distinct(), "content_hash", "left_anti")


def patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """An incremental backup: the diff with the new rows' columns."""
    changes = diff(old, new).select("path", "change")
    return changes.join(new, "path", "left")


def apply_patch(version: DataFrame, changes: DataFrame) -> DataFrame:
    kept = version.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.where("change <> 'deleted'").select(*version.columns))


def history(store: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(path, version, created_at, change) against the snapshot before: added, modified, unchanged, deleted.

    snapshots: (version, created_at). Content and content type count. A path is
    deleted in the first snapshot that lacks it.
    """
    paths_of = store.select("path").distinct()
    order = Window.orderBy("created_at", "version")
    numbered = snapshots.select("version", "created_at", F.row_number().over(order).alias("n"))  # one row a snapshot
    identity = F.concat_ws("|", "content_hash", F.coalesce("content_type", F.lit("")))
    have = store.select("path", "version", identity.alias("identity"))
    # only present rows and the snapshot after them can carry a change
    present = have.join(F.broadcast(numbered), "version").select("path", "n", "identity")
    gone = present.select("path", (F.col("n") + 1).alias("n")).join(present.select("path", "n"), ["path", "n"], "left_anti").join(F.broadcast(numbered.select("n")), "n", "left_semi")
    every = present.unionByName(gone.select("path", "n", F.lit(None).cast("string").alias("identity")))
    w = Window.partitionBy("path").orderBy("n")
    before, before_n = F.lag("identity").over(w), F.lag("n").over(w)
    known = (before_n == F.col("n") - 1) & before.isNotNull()
    change = F.when(F.col("identity").isNull(), "deleted").when(~F.coalesce(known, F.lit(False)), "added").when(before == F.col("identity"), "unchanged").otherwise("modified")
    out = every.withColumn("change", change).join(F.broadcast(numbered), "n")
    return out.join(paths_of, "path", "left_semi").select("path", "version", "created_at", "change")


def three_way_merge(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(path, operation, conflict, winner, content_hash) for each path that either side changed.

    operation is what local needs: add, delete or none. Equal changes agree; for
    different ones the later updated_at wins, then the greater hash; a change
    beats a delete.
    """

    def side(new: DataFrame, name: str) -> DataFrame:
        rows = diff(base, new).select("path", F.col("change"), "new_hash").join(new.select("path", F.col("updated_at").alias("t")), "path", "left")
        return rows.select("path", (F.col("change") == "deleted").alias(f"{name}_del"), F.col("new_hash").alias(f"{name}_hash"), F.col("t").alias(f"{name}_t"))

    both = side(local, "l").join(side(remote, "r"), "path", "full_outer")
    changed_l, changed_r = F.col("l_hash").isNotNull(), F.col("r_hash").isNotNull()
    gone_l, gone_r = F.coalesce("l_del", F.lit(False)), F.coalesce("r_del", F.lit(False))
    later = (F.col("l_t") > F.col("r_t")) | ((F.col("l_t") == F.col("r_t")) & (F.col("l_hash") >= F.col("r_hash")))
    differ = changed_l & changed_r & (F.col("l_hash") != F.col("r_hash"))
    conflict = F.when(differ, "modify_modify").when((changed_l & gone_r) | (changed_r & gone_l), "modify_delete")
    remote_wins = (differ & ~later) | (changed_r & ~changed_l)
    operation = F.when(remote_wins, "add").when(gone_r & ~changed_l & ~gone_l, "delete").otherwise("none")
    winner = F.when(conflict.isNull(), None).when(remote_wins, "remote").otherwise("local")
    content = F.when(remote_wins, F.col("r_hash")).otherwise(F.col("l_hash"))
    return both.select("path", operation.alias("operation"), conflict.alias("conflict"), winner.alias("winner"), content.alias("content_hash"))


def merged(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The tree after a merge: local with the operations applied, deletes last."""
    ops = three_way_merge(base, local, remote)
    kept = local.join(ops.where("operation in ('add', 'delete')").select("path"), "path", "left_anti")
    return kept.unionByName(remote.join(ops.where("operation = 'add'").select("path"), "path", "left_semi"))


def merge_links(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """three_way_merge() of symbolic links (path, target, updated_at), by the same rules on their targets; content_hash is named target."""
    rows = [v.select("path", F.col("target").alias("content_hash"), "updated_at") for v in (base, local, remote)]
    return three_way_merge(*rows).withColumnRenamed("content_hash", "target")


def list_conflicts(ops: DataFrame) -> DataFrame:
    """The operations of a merge that met a conflict."""
    return ops.where("conflict is not null")


def dismiss_conflicts(ops: DataFrame, paths_: list[str]) -> DataFrame:
    """The conflicts of these paths settled as they were decided; the others stay."""
    return ops.withColumn("conflict", F.when(~F.col("path").isin(*paths_), F.col("conflict")) if paths_ else F.col("conflict"))


def resolve_conflicts(ops: DataFrame, choice: dict[str, str]) -> DataFrame:
    """Conflicts with the chosen side (local or remote) as winner; others keep theirs."""
    if not choice:
        return ops
    chosen = F.create_map(*(F.lit(x) for kv in choice.items() for x in kv))
    return ops.withColumn("winner", F.when(F.col("conflict").isNotNull(), F.coalesce(F.try_element_at(chosen, F.col("path")), F.col("winner"))))


def unreachable(chunks: DataFrame, *versions: DataFrame) -> DataFrame:
    """Chunks (content_hash, ...) that no version reaches: what a sweep removes."""
    live = reduce(lambda a, b: a.unionByName(b), (v.select("content_hash") for v in versions)).distinct()
    return chunks.join(live, "content_hash", "left_anti")


def expired(snapshots: DataFrame, now: Column, months: dict[str, int], prefix: str = SYSTEM_PREFIX) -> DataFrame:
    """Snapshots (version, kind, created_at timestamp) past their kind's age, a month being 30 days; system names stay."""
    limit = F.lit(None).cast("int")
    for kind, n in months.items():
        limit = F.when(F.col("kind") == kind, n).otherwise(limit)
    age = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) / 86400
    return snapshots.where(~F.col("version").startswith(prefix) & (age > limit * 30))


def broken(files: DataFrame) -> DataFrame:
    """Files whose content does not have the recorded hash."""
    return files.where(F.sha2(F.col("body").cast("binary"), 256) != F.col("content_hash")).select("path", "content_hash")


def repaired(files: DataFrame, contents: DataFrame) -> DataFrame:
    """files with the body of each broken one taken from contents (content_hash, body); status: ok, repaired or lost."""
    sound = F.sha2(F.col("body").cast("binary"), 256) == F.col("content_hash")
    good = contents.select("content_hash", F.col("body").alias("_good")).where(F.sha2(F.col("_good").cast("binary"), 256) == F.col("content_hash")).dropDuplicates(["content_hash"])
    joined = files.join(good, "content_hash", "left")
    status = F.when(F.coalesce(sound, F.lit(False)), "ok").when(F.col("_good").isNotNull(), "repaired").otherwise("lost")
    fixed = joined.withColumn("status", status).withColumn("body", F.when(F.col("status") == "repaired", F.col("_good")).otherwise(F.col("body")))
    return fixed.select(*files.columns, "status")


def live(log: DataFrame) -> DataFrame:
    """The current rows of a log of (path, seq, deleted, ...): the last entry of each path, unless it is a deletion."""
    last = log.groupBy("path").agg(F.max_by(F.struct(*[c for c in log.columns if c != "path"]), "seq").alias("_r"))
    return last.select("path", "_r.*").where("not deleted").drop("deleted", "seq")


def deleted(log: DataFrame) -> DataFrame:
    """Paths whose last entry is a deletion, with the last content that can be restored."""
    last = log.groupBy("path").agg(F.max_by("deleted", "seq").alias("gone"), F.max_by("content_hash", F.when(~F.col("deleted"), F.col("seq"))).alias("content_hash"))
    return last.where("gone").select("path", "content_hash")


def restored(log: DataFrame, paths_: DataFrame, seq: int) -> DataFrame:
    """Entries that bring deleted paths (path) back with their last content; paths that live, or never had any, give none."""
    back = deleted(log).where("content_hash is not null").join(paths_.select("path"), "path", "left_semi")
    return back.select("path", F.lit(seq).cast(log.schema["seq"].dataType).alias("seq"), F.lit(False).alias("deleted"), "content_hash")


def removed_directory(files: DataFrame, path: str, recursive: bool = False) -> DataFrame:
    """files without a directory; one that is not empty goes only if recursive."""
    inside = F.col("path").startswith(path.rstrip("/") + "/")
    if not recursive and not files.where(inside).isEmpty():
        raise ValueError(f"{path} is not empty")
    return files.where(~inside)


def linked(links: DataFrame, path: str, target: str) -> DataFrame:
    """links with a symbolic link set: a new one, or the old one led elsewhere."""
    new = links.sparkSession.createDataFrame([(path, target)], "path string, target string")
    return links.where(F.col("path") != path).select("path", "target").unionByName(new)


def moved(files: DataFrame, old: str, new: str, copy: bool = False) -> DataFrame:
    """files with everything at or under old moved (or copied) to new; what is there already is replaced."""
    inside = (F.col("path") == old) | F.col("path").startswith(old.rstrip("/") + "/")
    target = files.where(inside).withColumn("path", F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 1 << 30)))
    stay = (files if copy else files.where(~inside)).join(target.select("path"), "path", "left_anti")
    return stay.unionByName(target)


def resolve_links(links: DataFrame, max_depth: int = 32) -> DataFrame:
    """(path, target, status) of symbolic links (path, target), followed to a file; cycles and long chains are told."""
    shared_folder(links.sparkSession)  # checkpoints need one
    now = links.select("path", "target", F.lit("open").alias("status"))
    step = links.select(F.col("path").alias("target"), F.col("target").alias("next"))
    for _ in range(max_depth):
        joined = now.join(step, "target", "left")
        circle = F.col("next") == F.col("path")
        status = F.when(F.col("status") != "open", F.col("status")).when(circle, "cycle").when(F.col("next").isNull(), "resolved").otherwise("open")
        now = joined.select("path", F.when((F.col("status") == "open") & F.col("next").isNotNull() & ~circle, F.col("next")).otherwise(F.col("target")).alias("target"), status.alias("status")).checkpoint()
        if now.where("status = 'open'").isEmpty():
            break
    return now.withColumn("status", F.when(F.col("status") == "open", "too_deep").otherwise(F.col("status")))
