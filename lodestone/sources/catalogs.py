"""Catalogues of file records over tables: (uid, device_id, record_idx, parent_idx, name, name_lc, size, mtime, is_dir, is_symlink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower

COLUMNS = ["uid", "device_id", "record_idx", "parent_idx", "name", "name_lc", "size", "mtime", "is_dir", "is_symlink"]


def records(df: DataFrame, device, idx, parent, name, size, mtime, is_dir, uid: int = 1000) -> DataFrame:
    return df.select(
        F.lit(uid).cast("long").alias("uid"), device.alias("device_id"), idx.cast("long").alias("record_idx"), parent.cast("long").alias("parent_idx"), name.alias("name"),
        ascii_lower(name).alias("name_lc"), size.cast("long").alias("size"), mtime.cast("long").alias("mtime"), is_dir.alias("is_dir"), F.lit(False).alias("is_symlink"),
    )


def parts(spark: SparkSession, d: str) -> DataFrame:
    """One device for each brand; many equal names, so ties and merges matter."""
    t = spark.read.parquet(f"{d}/part.parquet")
    c = F.col
    return records(t, c("p_brand"), c("p_partkey"), F.lit(None), c("p_name"), F.floor(c("p_retailprice") * 100), F.lit(1700000000) + c("p_size") * 86400, F.pmod(c("p_partkey"), F.lit(7)) == 0)


def tree(spark: SparkSession, d: str, files: bool = False) -> DataFrame:
    """region / nation / customer / order, and with ``files`` the line items of each order."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    c, dev, zero = F.col, F.lit("tree"), F.lit(0)
    stamp = lambda x: F.unix_timestamp(x)
    out = records(t("region"), dev, c("r_regionkey"), F.lit(None), c("r_name"), zero, zero, F.lit(True))
    out = out.union(records(t("nation"), dev, c("n_nationkey") + 100, c("n_regionkey"), c("n_name"), zero, zero, F.lit(True)))
    out = out.union(records(t("customer"), dev, c("c_custkey") + 1000, c("c_nationkey") + 100, c("c_name"), F.floor(F.abs(c("c_acctbal")) * 100), zero, F.lit(True)))
    order_id = lambda k: c(k) + 10_000_000_000
    out = out.union(records(t("orders"), dev, order_id("o_orderkey"), c("o_custkey") + 1000, F.concat(F.lit("Order-"), c("o_orderkey").cast("string")), F.floor(c("o_totalprice") * 100), stamp(c("o_orderdate")), F.lit(True)))
    if files:
        # Line items have no key of their own: they are numbered within their order, by all columns.
        li = t("lineitem")
        li = li.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*[x for x in li.columns if x != "l_orderkey"])))
        out = out.union(records(li, dev, c("l_orderkey") * 1_000_000 + c("n") + 10**15, order_id("l_orderkey"), F.concat(F.lit("item-"), c("n").cast("string"), F.lit(".dat")), F.floor(c("l_extendedprice") * 100), stamp(c("l_shipdate")), F.lit(False)))
    return out


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as accented names, one device for each language."""
    t = spark.read.parquet(f"{d}/documents.parquet")
    return records(t, F.col("lang"), F.col("doc_id"), F.lit(None), F.col("text"), F.col("n_chars"), F.col("doc_id"), F.lit(False))


def two_users(records: DataFrame, second: int = 1001) -> DataFrame:
    """``records``, and the same for a second user."""
    return records.unionByName(records.withColumn("uid", F.lit(second).cast("long")))
