"""Change streams: coalesced touches, quiet periods and safe upserts. The same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import handle_bytes, path_under_mount
from ..operators.paths import directory_ids, directory_paths
from ..shared import written


def coalesced(touched: DataFrame, gap: str = "250 milliseconds", watermark: str | None = None) -> DataFrame:
    """One row for each key and quiet-ended session with its masks or-ed."""
    if watermark:
        touched = touched.withWatermark("ts", watermark)
    keys = ["uid", "device_id", "fsid_hex", "handle_hex", "name"]
    return touched.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("touches")).select(F.col("w.start").alias("began"), F.col("w.end").alias("ended"), *keys, "mask", "touches")


def sessions(events: DataFrame, gap: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """Bursts that a quiet period ends; a rescan is due at ``due``."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("touches")).select(*keys, F.col("w.start").alias("began"), F.col("w.end").alias("due"), "touches")


def classified(touched: DataFrame) -> DataFrame:
    """generic (``*``), structured or malformed."""
    kind = F.when(F.col("name") == "*", "generic").when((F.col("fsid_hex") != "") & (F.col("handle_hex") != "") & (F.col("name") != ""), "structured").otherwise("malformed")
    return touched.withColumn("kind", kind)


def tokens_of(events: DataFrame, gap: str = "250 milliseconds", watermark: str | None = None) -> DataFrame:
    """Touched entries of batches of events (ts, uid, device_id, fsid_hex, handle_hex, name, mask, overflow).

    A batch with events but no named one gives one generic token, as nothing else is known of it; overflow alone
    gives none. One row for each batch: ``touched`` holds its entries with masks or-ed, ``overflow`` whether one was seen.
    """
    if watermark:
        events = events.withWatermark("ts", watermark)
    named = ~F.col("overflow") & (F.coalesce("fsid_hex", F.lit("")) != "") & (F.coalesce("handle_hex", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != "")
    one = F.struct("fsid_hex", "handle_hex", "name", "mask")
    batch = events.groupBy(F.session_window("ts", gap).alias("w"), "uid", "device_id").agg(
        F.bool_or("overflow").alias("overflow"), F.count_if(~F.col("overflow")).alias("seen"), F.collect_list(F.when(named, one)).alias("all")
    )
    keys = F.array_distinct(F.transform("all", lambda x: F.struct(x["fsid_hex"].alias("fsid_hex"), x["handle_hex"].alias("handle_hex"), x["name"].alias("name"))))
    ored = lambda k: F.aggregate(F.filter("all", lambda x: F.struct(x["fsid_hex"].alias("fsid_hex"), x["handle_hex"].alias("handle_hex"), x["name"].alias("name")) == k), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["mask"]))
    touched = F.transform(F.array_sort(keys), lambda k: F.struct(k["fsid_hex"].alias("fsid_hex"), k["handle_hex"].alias("handle_hex"), k["name"].alias("name"), ored(k).alias("mask")))
    generic = F.array(F.struct(F.lit("").alias("fsid_hex"), F.lit("").alias("handle_hex"), F.lit("*").alias("name"), F.lit(1).cast("long").alias("mask")))
    rows = batch.where("seen > 0 OR overflow").withColumn("touched", F.when((F.col("seen") > 0) & (F.size("all") == 0), generic).otherwise(touched))
    return rows.select("uid", "device_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "touched", "overflow")


#: The type bits of a file's mode, a folder's and a link's, and the bytes before a file handle's own.
TYPE_BITS, FOLDER, LINK, HANDLE_HEAD = 0xF000, 0x4000, 0xA000, 8


def judged(records: DataFrame, batch: DataFrame, mounts: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``batch`` with ``reason`` (empty where an item is safe) and ``target``, the record it updates.

    ``folders`` are the paths of the records' folders, where they are known already.

    Items have uid, device_id, seq, name, handle_hex, parent_path (what the handle stands for, null where it can't be
    opened), and size, mtime and mode of the file (mode null where it is gone). Reasons, in the order in which they
    are looked for: generic, malformed, not mounted, bad handle, outside mount, unknown dir, unknown name, vanished.
    """
    own = ["uid", "device_id"]
    raw = handle_bytes(F.col("handle_hex"))
    little = lambda k: F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("long") * (1 << 8 * (k - 1))
    whole = F.octet_length(raw) >= HANDLE_HEAD + F.when(F.octet_length(raw) >= HANDLE_HEAD, little(1) + little(2) + little(3) + little(4)).otherwise(0)
    items = batch.join(mounts.select("device_id", F.nullif(F.trim("primary_mount_point"), F.lit("")).alias("mount")), "device_id", "left")
    items = items.withColumn("inside", path_under_mount(F.col("parent_path"), F.col("mount"))).withColumn("whole", F.coalesce(whole, F.lit(False)))
    folders = directory_paths(records) if folders is None else folders
    # The root's children have no parent, or the root's own record.
    top = records.select(*own).distinct().select(*own, F.lit("/").alias("path"), F.lit(None).cast("long").alias("dir_id"))
    ids = directory_ids(folders).where("path <> '/'").unionByName(folders.where("path = '/'").select(*own, "path", "dir_id")).unionByName(top)
    ids = ids.select("uid", "device_id", F.col("path").alias("inside"), F.coalesce("dir_id", F.lit(-1)).alias("at"), F.lit(True).alias("known"))
    first = records.groupBy(*own, F.coalesce("parent_idx", F.lit(-1)).alias("at"), "name").agg(F.min("record_idx").alias("target"))
    met = items.join(ids, [*own, "inside"], "left").join(first, [*own, "at", "name"], "left")
    met = met.groupBy(*batch.columns, "mount", "inside", "whole").agg(F.bool_or("known").alias("known"), F.min("target").alias("target"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(F.col("name") == "*", "generic").when(blank("name") | blank("handle_hex"), "malformed").when(F.col("mount").isNull(), "not mounted").when(~F.col("whole") | F.col("parent_path").isNull(), "bad handle")
        .when(F.col("inside").isNull(), "outside mount").when(F.col("known").isNull(), "unknown dir").when(F.col("target").isNull(), "unknown name").when(F.col("mode").isNull(), "vanished").otherwise("")
    )
    return met.select(*batch.columns, reason.alias("reason"), "target")


def batch_counts(reasons: DataFrame) -> DataFrame:
    """(uid, device_id, touched, generic, malformed, structured, updated, unsafe) of judged items."""
    is_ = lambda x: F.count_if(F.col("reason") == x)
    return reasons.groupBy("uid", "device_id").agg(
        F.count(F.lit(1)).alias("touched"), is_("generic").alias("generic"), is_("malformed").alias("malformed"), F.count_if(~F.col("reason").isin("generic", "malformed")).alias("structured"),
        is_("").alias("updated"), F.count_if(F.col("reason") != "").alias("unsafe"),
    )


def upsert(records: DataFrame, batch: DataFrame, mounts: DataFrame, partial: bool = False, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records after the batch, judged items). Size, time and both kinds change, of records that are known.

    One unsafe item leaves its user's device as it was, not others; ``partial`` applies the safe items all the same.
    Of records with equal parent and name the first is changed, by the item with the largest ``seq``. Ranks by size
    and time no longer hold for changed devices; ``store`` writes them anew with the next generation.
    """
    reasons = written(judged(records, batch, mounts, folders), "judged")
    safe = reasons.where("reason = ''")
    if not partial:
        safe = safe.join(reasons.where("reason <> ''").select("uid", "device_id").distinct(), ["uid", "device_id"], "left_anti")
    kind = F.col("mode").bitwiseAND(TYPE_BITS)
    new = safe.groupBy("uid", "device_id", F.col("target").alias("record_idx")).agg(
        F.max_by(F.struct("size", "mtime", (kind == FOLDER).alias("is_dir"), (kind == LINK).alias("is_symlink")), "seq").alias("u")
    )
    out = records.join(new, ["uid", "device_id", "record_idx"], "left")
    changing = ("size", "mtime", "is_dir", "is_symlink")
    return out.select(*[F.when(F.col("u").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(c)).alias(c) if c in changing else F.col(c) for c in records.columns]), reasons
