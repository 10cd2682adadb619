"""Device inventories: identities, mounts, totals, and the lists that compare indexed with known devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from ..functions.text import fs_kind, retry_mode, retry_seconds


def parse_mountinfo(lines: DataFrame) -> DataFrame:
    """(mount_point, mount_source) of lines of ``/proc/self/mountinfo``; malformed ones are left out."""
    left, right = F.split(F.col("line"), " - ", 2), F.split(F.element_at(F.split(F.col("line"), " - ", 2), 2), " ")
    fields = F.split(F.trim(left[0]), " +")
    ok = (F.size(left) == 2) & (F.size(fields) >= 5) & (F.size(right) >= 2)
    return lines.where(ok).select(fields[4].alias("mount_point"), right[1].alias("mount_source"))


def primary_mount(points: Column) -> Column:
    """The preferred mount point: under /mnt or /media first, then the shortest, then the first in order."""
    preferred = lambda m: F.startswith(m, F.lit("/mnt/")) | F.startswith(m, F.lit("/media/")) | m.isin("/mnt", "/media")
    keyed = F.transform(points, lambda m: F.struct((~preferred(m)).alias("later"), F.length(m).alias("n"), m.alias("point")))
    return F.coalesce(F.array_min(keyed)["point"], F.lit(""))


def inventory(by_partuuid: DataFrame, by_uuid: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """One row for each device node of two link tables (dev_node, id); a partuuid names the device where there is one.

    Several links to one node count once, the first id in order. ``probed`` (dev_node, fs_type, uuid, label) is what
    the device says of itself, and goes before the links' uuid.
    """
    one = lambda links, name: links.groupBy("dev_node").agg(F.min(F.lower("id")).alias(name))
    both = one(by_partuuid, "partuuid").join(one(by_uuid, "uuid"), "dev_node", "full_outer")
    name = F.when(F.col("partuuid").isNotNull(), F.concat(F.lit("partuuid:"), "partuuid")).otherwise(F.concat(F.lit("uuid:"), "uuid"))
    both = both.withColumn("device_id", name)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    if probed is None:
        return both.select("device_id", "dev_node", text("partuuid").alias("partuuid"), text("uuid").alias("uuid"))
    own = probed.select("dev_node", F.lower("fs_type").alias("fs_type"), F.nullif(F.lower("uuid"), F.lit("")).alias("own_uuid"), "label")
    out = both.join(own, "dev_node", "left")
    return out.select("device_id", "dev_node", text("partuuid").alias("partuuid"), F.coalesce("own_uuid", "uuid", F.lit("")).alias("uuid"), text("fs_type").alias("fs_type"), text("label").alias("label"))


def with_mounts(devices: DataFrame, mounts: DataFrame) -> DataFrame:
    points = mounts.groupBy(F.col("mount_source").alias("dev_node")).agg(F.sort_array(F.collect_set("mount_point")).alias("mount_points"))
    out = devices.join(points, "dev_node", "left").withColumn("mount_points", F.coalesce("mount_points", F.array().cast("array<string>")))
    return out.withColumn("mounted", F.size("mount_points") > 0).withColumn("primary_mount_point", primary_mount(F.col("mount_points")))


def scannable(devices: DataFrame) -> DataFrame:
    return devices.where(fs_kind(F.col("fs_type")).isin("ntfs", "ext4"))


def totals(records: DataFrame) -> DataFrame:
    """(device_id, entries, dirs, bytes), and the grand total under a null device."""
    return records.rollup("device_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if("is_dir").alias("dirs"), F.sum("size").alias("bytes"))


def scope_list(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """Indexed devices with whether they are present, by label, else file system, else id."""
    there = known.select("device_id", F.lit(True).alias("present"), "mounted")
    out = indexed.join(there, "device_id", "left").withColumn("present", F.coalesce("present", F.lit(False))).withColumn("mounted", F.coalesce("mounted", F.lit(False)))
    return out.withColumn("title", F.lower(F.coalesce(F.nullif("label", F.lit("")), F.nullif("fs_type", F.lit("")), "device_id")))


def settings_list(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """Known devices, and indexed ones that are absent; ``state`` says which."""
    i = indexed.select("device_id", F.col("entry_count"), F.lit(True).alias("is_indexed"))
    k = known.select("device_id", "mounted", F.lit(True).alias("is_known"))
    state = F.when(F.col("is_known").isNull(), "absent").when(F.col("is_indexed").isNull(), "not indexed").otherwise("indexed")
    return k.join(i, "device_id", "full_outer").select("device_id", state.alias("state"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"), F.coalesce("mounted", F.lit(False)).alias("mounted"))


def watch_plan(indexed: DataFrame, known: DataFrame) -> DataFrame:
    """Devices to watch and where: only enabled ones, a mount point only where it is mounted and not empty."""
    out = indexed.where("watch_enabled").join(known.select("device_id", "mounted", "primary_mount_point"), "device_id", "left")
    point = F.when(F.coalesce("mounted", F.lit(False)) & (F.coalesce("primary_mount_point", F.lit("")) != ""), F.col("primary_mount_point"))
    return out.select("device_id", point.alias("mount_point"), F.when(point.isNull(), "notMounted").otherwise("pending").alias("state"))


def in_list_order(devices: DataFrame) -> DataFrame:
    """``devices`` with ``pos``: by label, else file system, else id, in any case, ties by id. A list for one user's eyes."""
    name = F.lower(F.coalesce(F.nullif("label", F.lit("")), F.nullif("fs_type", F.lit("")), "device_id"))
    return devices.withColumn("pos", F.row_number().over(Window.orderBy(name, "device_id")) - 1)


def stale_watches(armed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Watches that are armed but no longer wanted, by user and device."""
    return armed.join(wanted, ["uid", "device_id"], "left_anti")


def watch_list(indexed: DataFrame, watches: DataFrame, now_ms: int) -> DataFrame:
    """Indexed devices with what their watch does: state, mode and error where they apply, and when it is tried again."""
    out = indexed.join(watches, ["uid", "device_id"], "left")
    state = F.coalesce("state", F.lit("pending"))
    due, only = F.coalesce("next_retry_ms", F.lit(0).cast("long")), F.coalesce("only_on_remount", F.lit(False))
    retry_in = retry_seconds(due, F.lit(now_ms).cast("long"))
    return out.select(
        "uid", "device_id", "entry_count", "watch_enabled", state.alias("watch_state"), F.when(state == "error", F.col("error")).otherwise("").alias("watch_error"), F.when(state == "watching", F.col("mode")).otherwise("").alias("watch_mode"),
        F.coalesce("fail_count", F.lit(0)).alias("fail_count"), retry_in.alias("retry_in"), retry_mode(state, only, retry_in, due).alias("retry_mode"),
    )


def by_kind(files: DataFrame) -> DataFrame:
    """(kind, n, names): files by the lower-cased ending of their names, folders and names without one apart."""
    ending = F.lower(F.regexp_extract("name", r"[^.]\.([^.]+)$", 1))
    kind = F.when(F.col("is_dir"), "folder").when(ending != "", ending).otherwise("none")
    return files.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def outputs(entries: DataFrame) -> DataFrame:
    """Names, paths and URLs of resolved entries for clipboard and drag; a URL only where the device is mounted."""
    path = F.when(F.col("mounted"), F.col("display_path"))
    spaced = F.regexp_replace(F.url_encode(path), r"\+", "%20")
    return entries.where("name <> ''").select("pos", "name", "display_path", F.concat(F.lit("file://"), F.replace(spaced, F.lit("%2F"), F.lit("/"))).alias("url"))
