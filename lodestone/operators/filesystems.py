"""Relational semantics of NTFS and EXT4 metadata, over rows that a reader has decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unix_from_filetime

ROOT_INODE, MFT_MASK, HIDDEN_TO = 2, 0xFFFFFFFFFFFF, 38
DOS, WIN32, BOTH = 2, 1, 3


#: A record number holds the file's number and, below it, the place of the name among the file's names.
NAME_BITS = 31


def merge_extensions(mft: DataFrame) -> DataFrame:
    """Base and extension records as one, by base index: flags or-ed, the largest data size that a data attribute has,
    and the names of all in the order of their records."""
    names = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("mft_idx", "names"))), lambda x: x["names"]))
    return mft.groupBy("base_idx").agg(
        F.bool_or("is_dir").alias("is_dir"), F.bool_or("is_symlink").alias("is_symlink"), F.max(F.when(F.col("data_found"), F.col("data_size"))).alias("data_size"),
        F.bool_or("data_found").alias("data_found"), names.alias("names"),
    )


def without_aliases(names: Column) -> Column:
    """Names without the DOS ones whose parent also has another name of the file."""
    return F.filter(names, lambda n: (n["namespace_type"] != DOS) | ~F.exists(names, lambda o: (o["namespace_type"] != DOS) & (o["parent_mft"] == n["parent_mft"])))


def kept_names(names: DataFrame) -> DataFrame:
    """Rows of names without DOS aliases whose parent already has another name of that file, and without system files."""
    others = names.where(F.col("namespace_type") != DOS).select("base_idx", "parent_mft").distinct()
    alias = names.where(F.col("namespace_type") == DOS).join(others, ["base_idx", "parent_mft"], "left_anti")
    kept = names.where(F.col("namespace_type") != DOS).unionByName(alias)
    return kept.where(~(F.startswith("name", F.lit("$")) & (F.col("base_idx") <= HIDDEN_TO)))


def ntfs_records(mft: DataFrame, compat: bool = False) -> DataFrame:
    """One record for each kept name (hard links give several), with parents as record numbers.

    ``mft`` has mft_idx, base_idx, is_dir, is_symlink, data_found, data_size and names, an array of (name, parent_mft,
    namespace_type, mod_filetime, name_size). Time and name size come from the last Win32 name that is kept, and
    before any from each name while the time is 0; size is the data attribute's where there is one. The root's ``.``
    becomes the empty name. Of several records of one file the last is the parent others point to. ``compat`` drops
    the mark of symbolic links.
    """
    one = merge_extensions(mft).withColumn("names", without_aliases(F.col("names")))
    start = F.struct(F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"))
    meta = F.aggregate(
        "names", start,
        lambda acc, n: F.when((acc["mtime"] == 0) | n["namespace_type"].isin(WIN32, BOTH), F.struct(unix_from_filetime(n["mod_filetime"]).alias("mtime"), n["name_size"].alias("size"))).otherwise(acc),
    )
    rows = one.withColumn("meta", meta).select("base_idx", "is_dir", "is_symlink", "data_found", "data_size", "meta", F.posexplode("names").alias("k", "n"))
    rows = rows.where(~(F.startswith("n.name", F.lit("$")) & (F.col("base_idx") <= HIDDEN_TO)))
    rows = rows.withColumn("record_idx", F.shiftleft("base_idx", NAME_BITS) + F.col("k"))
    owner = rows.groupBy(F.col("base_idx").alias("parent_mft")).agg(F.max("record_idx").alias("parent_idx"))
    rows = rows.withColumn("parent_mft", F.col("n.parent_mft").bitwiseAND(MFT_MASK)).join(owner, "parent_mft", "left")
    return rows.select(
        "record_idx", "parent_idx", F.when(F.col("n.name") == ".", "").otherwise(F.col("n.name")).alias("name"), F.when(F.col("data_found"), F.col("data_size")).otherwise(F.col("meta.size")).alias("size"),
        F.col("meta.mtime").alias("mtime"), "is_dir", (F.lit(False) if compat else F.col("is_symlink")).alias("is_symlink"),
    )


def ext4_records(inodes: DataFrame, dirents: DataFrame, max_inode: int | None = None) -> DataFrame:
    """One record for each live inode: its last directory entry names it; missing stats are zeros.

    Entries without an inode or with one above ``max_inode``, ``.``, ``..`` and empty names are skipped; a parent
    that is the root inode or is not there becomes null. The root itself has a record with an empty name.
    """
    live = dirents.where("ino > 0 AND name NOT IN ('', '.', '..')")
    if max_inode is not None:
        live = live.where(F.col("ino") <= max_inode)
    last = live.groupBy("ino").agg(F.max_by(F.struct("name", "dir_ino"), "scan_seq").alias("e"))
    there = last.select(F.col("ino").alias("parent_idx"))
    rows = last.select("ino", F.col("e.name").alias("name"), F.col("e.dir_ino").alias("dir_ino"))
    root = inodes.sparkSession.range(1).select(F.lit(ROOT_INODE).cast("long").alias("ino"), F.lit("").alias("name"), F.lit(None).cast("long").alias("dir_ino"))
    rows = rows.unionByName(root.join(rows.select("ino"), "ino", "left_anti"))
    rows = rows.join(there, (F.col("dir_ino") == F.col("parent_idx")) & (F.col("dir_ino") != ROOT_INODE), "left")
    stats = inodes.where("links_count > 0").select("ino", "size", "mtime", (F.col("mode").bitwiseAND(0xF000) == 0x4000).alias("is_dir"), (F.col("mode").bitwiseAND(0xF000) == 0xA000).alias("is_symlink"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return rows.join(stats, "ino", "left").select(
        F.col("ino").alias("record_idx"), "parent_idx", "name", F.coalesce("size", zero).alias("size"), F.coalesce("mtime", zero).alias("mtime"), F.coalesce("is_dir", no).alias("is_dir"), F.coalesce("is_symlink", no).alias("is_symlink")
    )
