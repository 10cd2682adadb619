"""Directory paths by pointer doubling over directories, and the entries and prefixes built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entry_parts, fnv32
from ..shared import written

MAX_DEPTH = 4096
UNKNOWN = "…"


def directory_paths(records: DataFrame) -> DataFrame:
    """(uid, device_id, dir_id, path) of every directory; each step doubles the levels that are resolved.

    Empty, ``.`` and ``..`` parts are skipped, a missing parent or a self-parent ends a path, and whatever a cycle
    or a depth over ``MAX_DEPTH`` leaves open is ``…``.
    """
    dirs = records.where("is_dir").select("uid", "device_id", F.col("record_idx").alias("dir_id"), "parent_idx", "name")
    part = F.when(F.col("name").isin("", ".", ".."), "").otherwise(F.concat(F.lit("/"), "name"))
    up = F.when(F.col("parent_idx") == F.col("dir_id"), None).otherwise(F.col("parent_idx"))
    at = dirs.select("uid", "device_id", "dir_id", part.alias("path"), up.alias("next"))
    known = at.select("uid", "device_id", F.col("dir_id").alias("next"), F.lit(True).alias("known"))
    at = at.join(known, ["uid", "device_id", "next"], "left").select("uid", "device_id", "dir_id", "path", F.when(F.col("known"), F.col("next")).alias("next"))
    keys = ["uid", "device_id"]
    done, at = [], written(at, "paths")
    for _ in range(MAX_DEPTH.bit_length() - 1):
        # Settled rows are set aside; only open ones are joined again, with the last state of all.
        settled = at.where("next IS NULL")
        done.append(settled.select(*keys, "dir_id", "path", "next"))
        going = at.where("next IS NOT NULL")
        if going.isEmpty():
            at = going
            break
        every = reduce(DataFrame.union, [going.select(*keys, "dir_id", "path", "next"), *done])
        above = every.select(*keys, F.col("dir_id").alias("next"), F.col("path").alias("upper"), F.col("next").alias("beyond"))
        at = written(
            going.join(above, [*keys, "next"], "left").select(*keys, "dir_id", F.concat(F.coalesce("upper", F.lit("")), "path").alias("path"), F.col("beyond").alias("next")), "paths"
        )
    every = reduce(DataFrame.union, [at.select(*keys, "dir_id", "path", "next"), *done])
    shown = F.when(F.col("next").isNotNull(), UNKNOWN).when(F.col("path") == "", "/").otherwise(F.col("path"))
    return every.select("uid", "device_id", "dir_id", shown.alias("path"))


def display_prefix(mount: Column, label: Column, device: Column) -> Column:
    """The mount point of a mounted device, else its label or id in brackets."""
    return F.when(F.coalesce(mount, F.lit("")) != "", mount).otherwise(F.concat(F.lit("["), F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(device), F.lit("]")))


def joined_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(directory, F.lit("/"), name))


def under_prefix(prefix: Column, path: Column) -> Column:
    """A mount point alone at its root; a bracketed prefix keeps the slash."""
    bracket = F.startswith(prefix, F.lit("["))
    return F.when((path == "/") & ~bracket, prefix).when(prefix == "/", path).otherwise(F.concat(prefix, path))


def directory_ids(paths: DataFrame) -> DataFrame:
    """(uid, device_id, path, dir_id): the first directory of each path; ``/`` belongs to no record and is null."""
    first = paths.where(F.col("path") != "/").groupBy("uid", "device_id", "path").agg(F.min("dir_id").alias("dir_id"))
    root = paths.select("uid", "device_id").distinct().select("uid", "device_id", F.lit("/").alias("path"), F.lit(None).cast("long").alias("dir_id"))
    return first.unionByName(root)


def resolve_directories(ids: DataFrame, paths: DataFrame, known: DataFrame, uid: int) -> DataFrame:
    """(device_id, dir_id, path, shown) of requested (device_id, dir_id) of one user; ids nobody knows are ``…``.

    ``shown`` begins with the mount point, else the label of a present device, else the device's id.
    """
    own = paths.where(F.col("uid") == uid).select("device_id", "dir_id", "path")
    there = known.select("device_id", "mounted", "primary_mount_point", "label")
    found = ids.join(own, ["device_id", "dir_id"], "left").join(there, "device_id", "left")
    path = F.when(F.col("dir_id").isNull(), "/").otherwise(F.coalesce("path", F.lit(UNKNOWN)))
    return found.select("device_id", "dir_id", path.alias("path"), under_prefix(display_prefix(mount_of(), F.col("label"), F.col("device_id")), path).alias("shown"))


def mount_of() -> Column:
    return F.when(F.coalesce("mounted", F.lit(False)), F.trim("primary_mount_point"))


def resolve_entries(ids: DataFrame, records: DataFrame, paths: DataFrame, indexed: DataFrame, known: DataFrame, uid: int) -> DataFrame:
    """Ten fields for each requested (pos, entry_id) of one user, in place; unknown ids give blanks.

    An entry id is matched by the hash of its device, then by the record; where hashes collide, the first device
    that has the record. ``indexed`` has device_id and the last known label, ``known`` device_id, mounted,
    primary_mount_point and label of the devices that are there.
    """
    high, low = entry_parts(F.col("entry_id"))
    devices = indexed.where(F.col("uid") == uid).select("device_id", fnv32("device_id").alias("device_hash"), F.col("label").alias("last_label"))
    asked = ids.select("pos", "entry_id", high.alias("device_hash"), low.alias("record_idx")).join(devices, "device_hash", "left")
    own = records.where(F.col("uid") == uid).select("device_id", "record_idx", "parent_idx", "name", "is_dir")
    hit = asked.join(own, ["device_id", "record_idx"], "left")
    hit = hit.groupBy("pos", "entry_id").agg(F.min_by(F.struct("device_id", "last_label", "parent_idx", "name", "is_dir"), F.when(F.col("name").isNotNull(), F.col("device_id"))).alias("r")).select("pos", "entry_id", "r.*")
    folders = paths.where(F.col("uid") == uid).select("device_id", F.col("dir_id").alias("parent_idx"), "path")
    there = known.select("device_id", "mounted", "primary_mount_point", "label")
    out = hit.join(folders, ["device_id", "parent_idx"], "left").join(there, "device_id", "left")
    folder = F.when(F.col("parent_idx").isNull(), "/").otherwise(F.coalesce("path", F.lit(UNKNOWN)))
    whole = joined_path(folder, F.col("name"))
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.nullif(F.trim("last_label"), F.lit("")))
    prefix = display_prefix(mount_of(), label, F.col("device_id"))
    text = lambda c: F.when(F.col("name").isNull(), "").otherwise(c)
    point = F.coalesce("primary_mount_point", F.lit(""))
    return out.select(
        "pos", "entry_id", F.coalesce("device_id", F.lit("")).alias("device_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"),
        (F.coalesce("mounted", F.lit(False)) & (F.trim(point) != "")).alias("mounted"), text(point).alias("primary_mount_point"), text(whole).alias("internal_path"), text(under_prefix(prefix, whole)).alias("display_path"),
        text(folder).alias("internal_dir"), text(under_prefix(prefix, folder)).alias("display_dir"),
    )
