"""Every query of the catalogue engine by name, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import devices, filesystems, paths, search
from ..sources.catalogs import parts, texts, tree, two_users
from ..shared import new_path
from ..streaming import timers, watch
from . import store

QUERIES: dict = {}
ORACLES: dict = {}
UID = 1000

LC = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PARTS = f"""SELECT p_brand AS device_id, p_partkey AS record_idx, NULL::BIGINT AS parent_idx, p_name AS name, {LC.format("p_name")} AS name_lc,
 CAST(floor(p_retailprice * 100) AS BIGINT) AS size, CAST(1700000000 + p_size * 86400 AS BIGINT) AS mtime, p_partkey % 7 = 0 AS is_dir FROM part"""
TREE = f"""SELECT 'tree' AS device_id, *, {LC.format("name")} AS name_lc, true AS is_dir FROM (
 SELECT r_regionkey::BIGINT AS record_idx, NULL::BIGINT AS parent_idx, r_name AS name, 0::BIGINT AS size, 0::BIGINT AS mtime FROM region
 UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, 0, 0 FROM nation
 UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_name, CAST(floor(abs(c_acctbal) * 100) AS BIGINT), 0 FROM customer
 UNION ALL SELECT o_orderkey + 10000000000, o_custkey + 1000, 'Order-' || o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT), CAST(epoch(o_orderdate) AS BIGINT) FROM orders)"""
LINES = f"""SELECT lang AS device_id, doc_id AS record_idx, NULL::BIGINT AS parent_idx, text AS name, {LC.format("text")} AS name_lc, n_chars AS size, doc_id AS mtime, false AS is_dir FROM documents"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rows_sql(base: str, where: str, order: str, offset: int, limit: int, extra: str = "") -> str:
    return f"""WITH RECURSIVE b AS ({base}), f AS (SELECT DISTINCT device_id, hex(encode(device_id)) AS h, 0 AS i, 2166136261::BIGINT AS v FROM b
 UNION ALL SELECT device_id, h, i + 1, (((xor(v, ('0x' || substr(h, i * 2 + 1, 2))::BIGINT) * 16777619) & 4294967295) * 16777619) & 4294967295 FROM f WHERE i < length(h) // 2),
 g AS (SELECT device_id AS d, v AS device_hash FROM f WHERE i = length(h) // 2), h AS (SELECT b.*{extra} FROM b WHERE {where})
 SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS INT) AS pos, device_hash, record_idx, device_id, name, parent_idx AS dir_id, size, mtime, CAST(is_dir AS INT) AS flags
 FROM h JOIN g ON d = device_id QUALIFY pos >= {offset} AND pos < {offset + limit}"""


def like(*found: str) -> str:
    return " AND ".join(f"contains(name_lc, '{t}')" for t in found) or "true"


ORDER = {"name": "name_lc", "path": "parent_idx ASC NULLS LAST, name_lc", "size": "size, name_lc", "mtime": "mtime, name_lc"}
DESC = {"name": "name_lc DESC", "path": "parent_idx DESC NULLS FIRST, name_lc DESC", "size": "size DESC, name_lc DESC", "mtime": "mtime DESC, name_lc DESC"}


def add_search(name, source, base, text_query, sort="name", direction="asc", offset=0, limit=256, only=None):
    where = like(*[text.ascii_folded(t) for t in text.tokens(text_query)]) + (f" AND device_id IN ({', '.join(repr(d) for d in only)})" if only else "")
    order = f"{DESC[sort]}, device_id DESC, record_idx DESC" if direction == "desc" else f"{ORDER[sort]}, device_id, record_idx"
    sql = rows_sql(base, where, order, offset, limit)
    QUERIES[name] = lambda s, d: search.page(search.matching(source(s, d), text_query, UID, only), sort, direction, offset, limit)
    ORACLES[name] = sql


add_search("search_single", parts, PARTS, "BLUE", limit=100)
add_search("search_multi_and", tree, TREE, "  er \t 99 ", limit=200)
add_search("search_short_token", tree, TREE, "9", "size", "desc", limit=50)
add_search("search_unicode", texts, LINES, "É", limit=300)
add_search("search_device_scope", parts, PARTS, "", "size", limit=120, only=["Brand#11", "Brand#22"])
add_search("page_near", parts, PARTS, "", "mtime", offset=64, limit=64)
for _sort in ORDER:
    for _way in ("asc", "desc"):
        add_search(f"sort_{_sort}_{_way}", tree if _sort == "path" else parts, TREE if _sort == "path" else PARTS, "", _sort, _way, limit=150)


@query("search_flagship", f"""WITH b AS ({TREE}), h AS (SELECT * FROM b WHERE {like("customer", "12")})
 SELECT CAST(row_number() OVER (ORDER BY size DESC, name_lc DESC, device_id DESC, record_idx DESC) - 1 AS INT) AS pos, name, size, (SELECT count(*) FROM h) AS total FROM h QUALIFY pos < 256""")  # fmt: skip
def flagship(spark, d):
    hits = search.matching(tree(spark, d), "customer 12", UID)
    return search.page(hits, "size", "desc").crossJoin(F.broadcast(search.total(hits))).select("pos", "name", "size", "total")  # a total is one row


@query("search_count", f"SELECT count(*) AS total FROM ({TREE}) WHERE {like('order', '7')}")
def search_count(spark, d):
    return search.total(search.matching(tree(spark, d), "order 7", UID))


@query("page_far", f"SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY name_lc, record_idx) - 1 AS BIGINT) AS rank_name, record_idx, name FROM ({TREE})) WHERE rank_name BETWEEN 1000 AND 1255")
def page_far(spark, d):
    return search.ranked(tree(spark, d), ("name",)).where("rank_name BETWEEN 1000 AND 1255").select("rank_name", "record_idx", "name")


@query("ranks_all", f"""SELECT device_id, record_idx, CAST(row_number() OVER (PARTITION BY device_id ORDER BY name_lc, record_idx) - 1 AS BIGINT) AS rank_name,
 CAST(row_number() OVER (PARTITION BY device_id ORDER BY parent_idx NULLS LAST, name_lc, record_idx) - 1 AS BIGINT) AS rank_path, CAST(row_number() OVER (PARTITION BY device_id ORDER BY size, name_lc, record_idx) - 1 AS BIGINT) AS rank_size,
 CAST(row_number() OVER (PARTITION BY device_id ORDER BY mtime, name_lc, record_idx) - 1 AS BIGINT) AS rank_mtime FROM ({PARTS})""")  # fmt: skip
def ranks_all(spark, d):
    return search.ranked(parts(spark, d)).select("device_id", "record_idx", "rank_name", "rank_path", "rank_size", "rank_mtime")


@query("merge_rank", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY size, name_lc, record_idx) - 1 AS rank FROM ({PARTS})), h AS (SELECT * FROM r WHERE {like("e")})
 SELECT CAST(row_number() OVER (ORDER BY rank, device_id, record_idx) - 1 AS INT) AS pos, CAST(rank AS BIGINT) AS rank, device_id, record_idx, size FROM h QUALIFY pos < 100""")  # fmt: skip
def merge_rank(spark, d):
    r = parts(spark, d)
    return search.page_by_rank(search.ranked(r, ("size",)), search.matching(r, "e", UID), "size", 0, 100).select("pos", "rank", "device_id", "record_idx", "size")


@query("merge_desc_compat", f"""WITH b AS ({PARTS}), h AS (SELECT *, max({{'s': size, 'n': name_lc}}) OVER (PARTITION BY device_id) AS top FROM b)
 SELECT CAST(row_number() OVER (ORDER BY top, device_id, size DESC, name_lc DESC, record_idx DESC) - 1 AS INT) AS pos, device_id, record_idx, size FROM h QUALIFY pos < 200""")  # fmt: skip
def merge_desc_compat(spark, d):
    return search.page(parts(spark, d), "size", "desc", 0, 200, compat=True).select("pos", "device_id", "record_idx", "size")


@query("trigram_postings", f"""SELECT trigram, count(*) AS n, min(record_idx) AS low FROM (SELECT DISTINCT record_idx, substr(hex(encode(name_lc)), 2 * i + 1, 6) AS trigram FROM
 (SELECT record_idx, name_lc, unnest(range(0, octet_length(encode(name_lc)) - 2)) AS i FROM ({PARTS}) WHERE octet_length(encode(name_lc)) >= 3)) GROUP BY trigram""")  # fmt: skip
def trigram_postings(spark, d):
    return search.postings(parts(spark, d)).groupBy("trigram").agg(F.count(F.lit(1)).alias("n"), F.min("record_idx").alias("low"))


@query("trigram_candidates", f"SELECT device_id, record_idx, name FROM ({TREE}) WHERE {like('123', 'ord')}")
def trigram_candidates(spark, d):
    r = tree(spark, d)
    return search.indexed_search(search.postings(r), r, "123 Ord", UID).select("device_id", "record_idx", "name")


TREE_PATHS = f"""WITH RECURSIVE b AS ({TREE}), p AS (SELECT record_idx, '/' || name AS path FROM b WHERE parent_idx IS NULL UNION ALL SELECT b.record_idx, p.path || '/' || b.name FROM b JOIN p ON b.parent_idx = p.record_idx)"""


@query("resolve_dirs", f"{TREE_PATHS} SELECT record_idx AS dir_id, path, '/mnt/tree' || path AS shown FROM p")
def resolve_dirs(spark, d):
    r = two_users(tree(spark, d))
    folders = paths.directory_paths(r)
    ids = tree(spark, d).select("device_id", F.col("record_idx").alias("dir_id"))
    there = spark.createDataFrame([("tree", True, "/mnt/tree", "Data")], KNOWN_DEVICE)
    return paths.resolve_directories(ids, folders, there, UID).select("dir_id", "path", "shown")


KNOWN_DEVICE = "device_id string, mounted boolean, primary_mount_point string, label string"
FNV = """f AS (SELECT device_id, hex(encode(device_id)) AS h, 0 AS i, 2166136261::BIGINT AS v FROM (SELECT DISTINCT device_id FROM {t})
 UNION ALL SELECT device_id, h, i + 1, (((xor(v, ('0x' || substr(h, i * 2 + 1, 2))::BIGINT) * 16777619) & 4294967295) * 16777619) & 4294967295 FROM f WHERE i < length(h) // 2)"""


@query("resolve_entries", f"""WITH RECURSIVE b AS ({TREE}), p AS (SELECT record_idx, '/' || name AS path FROM b WHERE parent_idx IS NULL UNION ALL SELECT b.record_idx, p.path || '/' || b.name FROM b JOIN p ON b.parent_idx = p.record_idx),
 {FNV.format(t="(SELECT 'tree' AS device_id)")},
 i AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 4000000000 ELSE n_nationkey + 100 END AS record_idx FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
 j AS (SELECT pos, record_idx, CAST(v AS DECIMAL(20, 0)) * 4294967296 + record_idx AS entry_id FROM i, f WHERE f.i = length(h) // 2),
 k AS (SELECT j.pos, j.entry_id, b.name, q.path AS dir FROM j LEFT JOIN b USING (record_idx) LEFT JOIN p q ON q.record_idx = b.parent_idx)
 SELECT pos, CAST(entry_id AS DECIMAL(20, 0)) AS entry_id, CASE WHEN name IS NULL THEN '' ELSE 'tree' END AS device_id, coalesce(name, '') AS name, name IS NOT NULL AS is_dir, false AS mounted, '' AS primary_mount_point,
  coalesce(dir || '/' || name, '') AS internal_path, coalesce('[Old]' || dir || '/' || name, '') AS display_path, coalesce(dir, '') AS internal_dir, coalesce('[Old]' || dir, '') AS display_dir FROM k""")  # fmt: skip
def resolve_entries(spark, d):
    r = two_users(tree(spark, d))
    o = spark.read.parquet(f"{d}/orders.parquet")
    c = F.col("o_orderkey")
    idx = F.when(c % 5 == 0, c + 4_000_000_000).otherwise(c % 25 + 100)
    ids = o.select(c.alias("pos"), text.entry_id(F.lit("tree"), idx).alias("entry_id"))
    own = spark.createDataFrame([(UID, "tree", "Old"), (UID + 1, "tree", "Other")], "uid long, device_id string, label string")
    return paths.resolve_entries(ids, r, paths.directory_paths(r), own, spark.createDataFrame([("tree", False, "", " ")], KNOWN_DEVICE), UID)


@query("directory_ids", f"{TREE_PATHS} SELECT path, min(record_idx) AS dir_id FROM p GROUP BY path UNION ALL SELECT '/', NULL")
def directory_ids(spark, d):
    return paths.directory_ids(paths.directory_paths(tree(spark, d))).select("path", "dir_id")


@query("sort_fullpath", f"""{TREE_PATHS} SELECT CAST(row_number() OVER (ORDER BY {LC.format("coalesce(q.path, '/')")}, name_lc, device_id, b.record_idx) - 1 AS INT) AS pos, b.record_idx, coalesce(q.path, '/') AS dir, b.name
 FROM b LEFT JOIN p q ON q.record_idx = b.parent_idx QUALIFY pos < 200""")  # fmt: skip
def sort_fullpath(spark, d):
    r = tree(spark, d)
    p = paths.directory_paths(r).select("uid", "device_id", F.col("dir_id").alias("parent_idx"), "path")
    hits = r.join(p, ["uid", "device_id", "parent_idx"], "left").withColumn("dir", F.coalesce("path", F.lit("/"))).withColumn("fullpath_lc", text.ascii_lower("dir"))
    return search.page(hits, "fullpath", limit=200, more=("dir",)).select("pos", "record_idx", "dir", "name")


@query("tree_files", f"""SELECT parent_idx, count(*) AS files, sum(size) AS bytes, max(mtime) AS newest FROM (SELECT l_orderkey + 10000000000 AS parent_idx, CAST(floor(l_extendedprice * 100) AS BIGINT) AS size, CAST(epoch(l_shipdate) AS BIGINT) AS mtime FROM lineitem) GROUP BY 1""")
def tree_files(spark, d):
    return tree(spark, d, files=True).where("NOT is_dir").groupBy("parent_idx").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("mtime").alias("newest"))


@query("entry_hash", """WITH RECURSIVE f AS (SELECT DISTINCT p_brand AS device_id, hex(encode(p_brand)) AS h, 0 AS i, 2166136261::BIGINT AS v FROM part
 UNION ALL SELECT device_id, h, i + 1, (((xor(v, ('0x' || substr(h, i * 2 + 1, 2))::BIGINT) * 16777619) & 4294967295) * 16777619) & 4294967295 FROM f WHERE i < length(h) // 2)
 SELECT p_partkey AS record_idx, v AS device_hash, CAST(v AS DECIMAL(20, 0)) * 4294967296 + p_partkey AS entry_id FROM part JOIN f ON device_id = p_brand WHERE i = length(h) // 2""")  # fmt: skip
def entry_hash(spark, d):
    high, low = text.entry_parts(F.col("entry_id"))
    made = parts(spark, d).select(text.entry_id("device_id", F.col("record_idx")).alias("entry_id"))
    return made.select(low.alias("record_idx"), high.alias("device_hash"), F.col("entry_id").cast("decimal(38,0)").alias("entry_id"))


@query("snapshot_key", "SELECT DISTINCT p_brand AS device_id, '1000/' || sha1(p_brand) AS path FROM part")
def snapshot_key(spark, d):
    return parts(spark, d).select("uid", "device_id").distinct().select("device_id", store.snapshot_keys(F.col("uid"), F.col("device_id")).alias("path"))


@query("device_totals", f"SELECT device_id, count(*) AS entries, count(*) FILTER (is_dir) AS dirs, CAST(sum(size) AS BIGINT) AS bytes FROM ({PARTS}) GROUP BY ROLLUP (device_id)")
def device_totals(spark, d):
    return devices.totals(parts(spark, d))


@query("display_columns", f"""{TREE_PATHS}, b2 AS (SELECT *, row_number() OVER (ORDER BY size, name_lc, record_idx) - 1 AS pos FROM b) SELECT CAST(pos AS INT) AS pos, name, CASE WHEN parent_idx IS NULL THEN '/mnt/tree' WHEN parent_idx % 7 = 0 THEN '…' ELSE '/mnt/tree' || p.path END AS path,
 '<DIR>' AS shown_size, strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS shown_time FROM b2 LEFT JOIN p ON p.record_idx = b2.parent_idx WHERE pos < 500""")  # fmt: skip
def display_columns(spark, d):
    r = tree(spark, d)
    rows = search.page(r, "size", limit=500)
    there = spark.createDataFrame([("tree", True, "/mnt/tree", "Data")], KNOWN_DEVICE)
    asked = rows.select("device_id", "dir_id").distinct().where("dir_id IS NULL OR dir_id % 7 <> 0")  # what has been resolved so far
    return search.display_columns(rows, paths.resolve_directories(asked, paths.directory_paths(r), there, UID))


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


POINTS = """SELECT s_nationkey AS k, CASE s_suppkey % 4 WHEN 0 THEN '/mnt/' || s_name WHEN 1 THEN '/media/x/' || s_name WHEN 2 THEN '/' || s_name ELSE '/mnt' END AS point FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 4 = 2"""


def mount_points(spark, d):
    c = F.col("s_suppkey")
    point = F.when(c % 4 == 0, F.concat(F.lit("/mnt/"), "s_name")).when(c % 4 == 1, F.concat(F.lit("/media/x/"), "s_name")).when(c % 4 == 2, F.concat(F.lit("/"), "s_name")).otherwise("/mnt")
    return spark.read.parquet(f"{d}/supplier.parquet").where((c % 5 != 0) | (c % 4 == 2)).select(F.col("s_nationkey").alias("k"), point.alias("point"))


@query("primary_mount", f"SELECT k, arg_min(point, {{'later': NOT (point = '/mnt' OR starts_with(point, '/mnt/') OR starts_with(point, '/media/')), 'n': length(point), 'p': point}}) AS primary_mount FROM ({POINTS}) GROUP BY k")
def primary_mount(spark, d):
    return mount_points(spark, d).groupBy("k").agg(F.collect_list("point").alias("points")).select("k", devices.primary_mount(F.col("points")).alias("primary_mount"))


@query("mounted_devices", f"""WITH m AS (SELECT DISTINCT k, point FROM ({POINTS})), g AS (SELECT k, list_sort(list(point)) AS points FROM m GROUP BY k)
 SELECT n_name AS device_id, coalesce(array_to_string(points, ','), '') AS points, points IS NOT NULL AS mounted FROM nation LEFT JOIN g ON k = n_nationkey WHERE contains(lower('fuse.' || n_name || CASE n_nationkey % 3 WHEN 0 THEN 'NTFS' WHEN 1 THEN ' ext4 ' ELSE 'xfs' END), 'ntfs') OR n_nationkey % 3 = 1""")  # fmt: skip
def mounted_devices(spark, d):
    n, c = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey")
    kind = F.concat(F.lit("fuse."), "n_name", F.when(c % 3 == 0, "NTFS").when(c % 3 == 1, " ext4 ").otherwise("xfs"))
    there = devices.scannable(n.select(F.col("n_name").alias("device_id"), c.cast("string").alias("dev_node"), kind.alias("fs_type")))
    points = mount_points(spark, d).select(F.col("k").cast("string").alias("mount_source"), F.col("point").alias("mount_point"))
    return devices.with_mounts(there, points).select("device_id", F.array_join("mount_points", ",").alias("points"), "mounted")


@query("mountinfo_parse", """SELECT '/mnt/' || replace(s_name, '#', '\\040') AS mount_point, '/dev/sd' || s_suppkey AS mount_source FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0""")
def mountinfo_parse(spark, d):
    k = F.col("s_suppkey")
    left = F.concat(k.cast("string"), F.lit(" 35 98:0 / /mnt/"), F.replace("s_name", F.lit("#"), F.lit("\\040")), F.lit(" rw,noatime master:1"))
    right = F.concat(F.lit("ntfs3 /dev/sd"), k.cast("string"), F.lit(" rw"))
    line = F.when(k % 7 == 0, left).when(k % 11 == 0, F.concat(left, F.lit(" - ntfs3"))).otherwise(F.concat(left, F.lit(" - "), right))
    return devices.parse_mountinfo(spark.read.parquet(f"{d}/supplier.parquet").select(line.alias("line")))


INDEXED = """SELECT 1000 AS uid, p_brand AS device_id, CASE min(p_size) % 3 WHEN 0 THEN 'ntfs' WHEN 1 THEN 'ext4' ELSE '' END AS fs_type, CASE WHEN count(*) % 2 = 0 THEN 'L' || max(p_size) ELSE '' END AS label, count(*) AS entry_count, count(*) % 4 <> 0 AS watch_enabled FROM part GROUP BY p_brand"""
KNOWN = """SELECT 'Brand#' || (10 + 2 * n_nationkey) AS device_id, n_nationkey % 3 <> 0 AS mounted, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '/mnt/' || n_name END AS primary_mount_point, n_name AS label FROM nation"""


def indexed(spark, d):
    n = F.count(F.lit(1))
    kind = F.when(F.min("p_size") % 3 == 0, "ntfs").when(F.min("p_size") % 3 == 1, "ext4").otherwise("")
    label = F.when(n % 2 == 0, F.concat(F.lit("L"), F.max("p_size").cast("string"))).otherwise("")
    out = spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("device_id")).agg(kind.alias("fs_type"), label.alias("label"), n.alias("entry_count"), (n % 4 != 0).alias("watch_enabled"))
    return out.withColumn("uid", F.lit(UID).cast("long"))


def known(spark, d):
    c = F.col("n_nationkey")
    return spark.read.parquet(f"{d}/nation.parquet").select(
        F.concat(F.lit("Brand#"), (c * 2 + 10).cast("string")).alias("device_id"), (c % 3 != 0).alias("mounted"), F.when(c % 4 == 0, "").otherwise(F.concat(F.lit("/mnt/"), "n_name")).alias("primary_mount_point"), F.col("n_name").alias("label"),
    )


@query("scope_list", f"""WITH i AS ({INDEXED}), k AS ({KNOWN}) SELECT i.device_id, k.device_id IS NOT NULL AS present, coalesce(k.mounted, false) AS mounted, lower(coalesce(nullif(i.label, ''), nullif(fs_type, ''), i.device_id)) AS title FROM i LEFT JOIN k USING (device_id)""")
def scope_list(spark, d):
    return devices.scope_list(indexed(spark, d), known(spark, d)).select("device_id", "present", "mounted", "title")


@query("list_order", f"""WITH i AS ({INDEXED}) SELECT CAST(row_number() OVER (ORDER BY lower(coalesce(nullif(label, ''), nullif(fs_type, ''), device_id)), device_id) - 1 AS INT) AS pos, device_id FROM i""")
def list_order(spark, d):
    return devices.in_list_order(indexed(spark, d)).select("pos", "device_id")


@query("settings_list", f"""WITH i AS ({INDEXED}), k AS ({KNOWN}) SELECT coalesce(i.device_id, k.device_id) AS device_id, CASE WHEN k.device_id IS NULL THEN 'absent' WHEN i.device_id IS NULL THEN 'not indexed' ELSE 'indexed' END AS state,
 coalesce(entry_count, 0) AS entry_count, coalesce(mounted, false) AS mounted FROM k FULL JOIN i ON i.device_id = k.device_id""")  # fmt: skip
def settings_list(spark, d):
    return devices.settings_list(indexed(spark, d), known(spark, d))


WANTED = f"""SELECT i.device_id, CASE WHEN mounted AND primary_mount_point <> '' THEN primary_mount_point END AS mount_point FROM ({INDEXED}) i LEFT JOIN ({KNOWN}) k USING (device_id) WHERE watch_enabled"""


@query("watch_plan", f"SELECT *, CASE WHEN mount_point IS NULL THEN 'notMounted' ELSE 'pending' END AS state FROM ({WANTED})")
def watch_plan(spark, d):
    return devices.watch_plan(indexed(spark, d), known(spark, d))


@query("stale_watches", f"SELECT DISTINCT p_brand AS device_id FROM part WHERE p_brand NOT IN (SELECT device_id FROM ({WANTED}))")
def stale_watches(spark, d):
    armed = indexed(spark, d).select("uid", "device_id")
    wanted = devices.watch_plan(indexed(spark, d), known(spark, d)).withColumn("uid", F.lit(UID).cast("long"))
    return devices.stale_watches(armed, wanted).select("device_id")


NOW = 1_700_000_000_000
WATCHES = f"""SELECT p_brand AS device_id, CASE max(p_partkey) % 4 WHEN 0 THEN 'watching' WHEN 1 THEN 'notMounted' ELSE 'error' END AS state, {NOW} + (min(p_partkey) - 5) * 777 AS due, count(*) % 2 = 0 AS only_on FROM part WHERE p_size > 10 GROUP BY p_brand"""


@query("watch_list", f"""WITH i AS ({INDEXED}), w AS ({WATCHES}), x AS (SELECT i.device_id, coalesce(state, 'pending') AS watch_state, coalesce(due, 0) AS due, coalesce(only_on, false) AS only_on FROM i LEFT JOIN w USING (device_id)),
 y AS (SELECT *, CAST(CASE WHEN due > {NOW} THEN (due - {NOW} + 999) // 1000 ELSE 0 END AS BIGINT) AS retry_in FROM x)
 SELECT device_id, watch_state, CASE WHEN watch_state = 'error' THEN 'no' ELSE '' END AS watch_error, CASE WHEN watch_state = 'watching' THEN 'names' ELSE '' END AS watch_mode, retry_in,
 CASE WHEN watch_state <> 'error' THEN 'none' WHEN only_on THEN 'onRemount' WHEN retry_in > 0 OR due > 0 THEN 'backoff' ELSE 'none' END AS retry_mode FROM y""")  # fmt: skip
def watch_list(spark, d):
    m, n = F.max("p_partkey"), F.count(F.lit(1))
    state = F.when(m % 4 == 0, "watching").when(m % 4 == 1, "notMounted").otherwise("error")
    w = spark.read.parquet(f"{d}/part.parquet").where("p_size > 10").groupBy(F.col("p_brand").alias("device_id")).agg(
        state.alias("state"), ((F.min("p_partkey") - 5) * 777 + NOW).alias("next_retry_ms"), (n % 2 == 0).alias("only_on_remount"), F.lit("no").alias("error"), F.lit("names").alias("mode"), F.lit(1).alias("fail_count")
    )
    out = devices.watch_list(indexed(spark, d), w.withColumn("uid", F.lit(UID).cast("long")), NOW)
    return out.select("device_id", "watch_state", "watch_error", "watch_mode", "retry_in", "retry_mode")


@query("device_labels", f"""WITH i AS ({INDEXED}), k AS ({KNOWN}) SELECT i.device_id, CASE WHEN i.label <> '' THEN i.label WHEN fs_type <> '' THEN fs_type ELSE 'Device' END || ' • ' || format('{{:,}}', entry_count) || CASE WHEN k.device_id IS NULL THEN ' (not present)' ELSE '' END AS title,
 'Device ID: ' || i.device_id || chr(10) || 'Dev node: —' || chr(10) || 'Mount: ' || CASE WHEN k.device_id IS NULL THEN '(not present)' WHEN NOT mounted THEN '(not mounted)' WHEN primary_mount_point = '' THEN '(mounted)' ELSE primary_mount_point END || chr(10) || 'Objects: ' || format('{{:,}}', entry_count) AS tip
 FROM i LEFT JOIN k USING (device_id)""")  # fmt: skip
def device_labels(spark, d):
    k = known(spark, d).select("device_id", "mounted", "primary_mount_point", F.lit(True).alias("there"))
    c, there = F.col, F.coalesce("there", F.lit(False))
    return indexed(spark, d).join(k, "device_id", "left").select(
        "device_id", text.device_label(c("label"), c("fs_type"), c("entry_count"), there).alias("title"),
        text.device_tip(c("device_id"), F.lit(" "), there, F.coalesce("mounted", F.lit(False)), c("primary_mount_point"), c("entry_count")).alias("tip"),
    )


@query("inventory_dedupe", """WITH a AS (SELECT '/dev/sd' || s_nationkey AS dev_node, min(lower('AB' || s_name)) AS partuuid FROM supplier GROUP BY 1), b AS (SELECT '/dev/sd' || c_custkey % 40 AS dev_node, min(lower('U' || c_name)) AS uuid FROM customer GROUP BY 1)
 SELECT CASE WHEN partuuid IS NOT NULL THEN 'partuuid:' || partuuid ELSE 'uuid:' || uuid END AS device_id, dev_node, coalesce(partuuid, '') AS partuuid, CASE WHEN dev_node LIKE '%1' THEN lower('OWN' || dev_node) ELSE coalesce(uuid, '') END AS uuid FROM a FULL JOIN b USING (dev_node)""")  # fmt: skip
def inventory_dedupe(spark, d):
    a = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("/dev/sd"), F.col("s_nationkey").cast("string")).alias("dev_node"), F.concat(F.lit("AB"), "s_name").alias("id"))
    b = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("/dev/sd"), (F.col("c_custkey") % 40).cast("string")).alias("dev_node"), F.concat(F.lit("U"), "c_name").alias("id"))
    nodes = a.select("dev_node").union(b.select("dev_node")).distinct()
    own = nodes.select("dev_node", F.lit("ext4").alias("fs_type"), F.when(F.col("dev_node").like("%1"), F.concat(F.lit("OWN"), "dev_node")).otherwise("").alias("uuid"), F.lit("").alias("label"))
    return devices.inventory(a, b, own).select("device_id", "dev_node", "partuuid", "uuid")


# NTFS names from line items: file = order, parent = supplier, name space = line number mod 4.
NAMES = """SELECT l_orderkey AS base_idx, l_suppkey AS parent_mft, (CASE WHEN l_partkey % 11 = 0 THEN '$' ELSE '' END) || 'f' || l_partkey AS name, l_linenumber % 4 AS namespace_type FROM lineitem"""


def ntfs_names(spark, d):
    c = F.col
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    name = F.concat(F.when(c("l_partkey") % 11 == 0, "$").otherwise(""), F.lit("f"), c("l_partkey").cast("string"))
    return li.select(c("l_orderkey").alias("base_idx"), c("l_suppkey").alias("parent_mft"), name.alias("name"), (c("l_linenumber") % 4).alias("namespace_type"))


@query("dos_dedupe", f"WITH n AS ({NAMES}) SELECT * FROM n WHERE (namespace_type <> 2 OR NOT EXISTS (SELECT 1 FROM n o WHERE o.base_idx = n.base_idx AND o.parent_mft = n.parent_mft AND o.namespace_type <> 2)) AND NOT (name LIKE '$%' AND base_idx <= 38)")
def dos_dedupe(spark, d):
    return filesystems.kept_names(ntfs_names(spark, d))


MFT = """SELECT l_orderkey AS base_idx, l_linenumber AS mft_idx, l_linestatus = 'F' AS is_dir, l_quantity > 45 AS is_symlink, l_returnflag = 'R' AS data_found, l_partkey AS data_size,
 CASE WHEN l_partkey % 11 = 0 THEN '$f' || l_partkey WHEN l_partkey % 13 = 0 THEN '.' ELSE 'f' || l_partkey END AS name, l_suppkey AS parent_mft, l_linenumber % 4 AS namespace_type, 116444736000000000 + (l_partkey % 17 - 8) * 10000000 AS mod_filetime, l_suppkey * 3 AS name_size FROM lineitem"""


def mft(spark, d):
    c = F.col
    name = F.when(c("l_partkey") % 11 == 0, F.concat(F.lit("$f"), c("l_partkey").cast("string"))).when(c("l_partkey") % 13 == 0, ".").otherwise(F.concat(F.lit("f"), c("l_partkey").cast("string")))
    one = F.struct(name.alias("name"), c("l_suppkey").alias("parent_mft"), (c("l_linenumber") % 4).alias("namespace_type"), ((c("l_partkey") % 17 - 8) * 10000000 + F.lit(116444736000000000)).alias("mod_filetime"), (c("l_suppkey") * 3).alias("name_size"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        c("l_orderkey").alias("base_idx"), c("l_linenumber").cast("long").alias("mft_idx"), (c("l_linestatus") == "F").alias("is_dir"), (c("l_quantity") > 45).alias("is_symlink"),
        (c("l_returnflag") == "R").alias("data_found"), c("l_partkey").alias("data_size"), F.array(one).alias("names"),
    )


@query("ext_merge", f"SELECT base_idx, bool_or(is_dir) AS is_dir, bool_or(is_symlink) AS is_symlink, max(data_size) FILTER (data_found) AS data_size, bool_or(data_found) AS data_found, string_agg(name, '/' ORDER BY mft_idx, name, parent_mft, namespace_type, mod_filetime, name_size) AS names FROM ({MFT}) GROUP BY 1")
def ext_merge(spark, d):
    return filesystems.merge_extensions(mft(spark, d)).withColumn("names", F.array_join(F.transform("names", lambda n: n["name"]), "/"))


@query("ntfs_records", f"""WITH m AS ({MFT}), f AS (SELECT base_idx, bool_or(is_dir) AS is_dir, bool_or(is_symlink) AS is_symlink, max(data_size) FILTER (data_found) AS data_size, bool_or(data_found) AS data_found FROM m GROUP BY 1),
 o AS (SELECT DISTINCT base_idx, parent_mft FROM m WHERE namespace_type <> 2),
 k AS (SELECT m.*, row_number() OVER (PARTITION BY base_idx ORDER BY mft_idx, name, parent_mft, namespace_type, mod_filetime, name_size) - 1 AS k, CASE WHEN mod_filetime < 116444736000000000 THEN 0 ELSE (mod_filetime - 116444736000000000) // 10000000 END AS t
  FROM m WHERE namespace_type <> 2 OR (base_idx, parent_mft) NOT IN (SELECT (base_idx, parent_mft) FROM o)),
 g AS (SELECT base_idx, coalesce(max(k) FILTER (namespace_type IN (1, 3)), 0) AS a FROM k GROUP BY 1),
 h AS (SELECT base_idx, coalesce(min(k) FILTER (k >= a AND t <> 0), max(k)) AS j FROM k JOIN g USING (base_idx) GROUP BY 1),
 i AS (SELECT h.base_idx, t AS mtime, name_size FROM h JOIN k ON k.base_idx = h.base_idx AND k.k = h.j),
 r AS (SELECT k.*, k.base_idx * 2147483648 + k.k AS record_idx FROM k WHERE NOT (starts_with(name, '$') AND base_idx <= 38)),
 p AS (SELECT base_idx, max(record_idx) AS top FROM r GROUP BY 1)
 SELECT CAST(r.record_idx AS BIGINT) AS record_idx, CAST(p.top AS BIGINT) AS parent_idx, CASE WHEN name = '.' THEN '' ELSE name END AS name, CASE WHEN f.data_found THEN f.data_size ELSE i.name_size END AS size, CAST(i.mtime AS BIGINT) AS mtime, f.is_dir, f.is_symlink
 FROM r JOIN f ON f.base_idx = r.base_idx JOIN i ON i.base_idx = r.base_idx LEFT JOIN p ON p.base_idx = r.parent_mft""")  # fmt: skip
def ntfs_records(spark, d):
    return filesystems.ntfs_records(mft(spark, d))


@query("ext4_records", """WITH e AS (SELECT l_partkey + 2 AS ino, l_suppkey + 1 AS dir_ino, 'n' || l_orderkey AS name, l_orderkey * 10 + l_linenumber AS q FROM lineitem),
 l AS (SELECT ino, arg_max({'n': name, 'd': dir_ino}, {'q': q, 'd': dir_ino, 'n': name}) AS e FROM e GROUP BY ino)
 SELECT l.ino AS record_idx, CASE WHEN l.e.d <> 2 AND l.e.d IN (SELECT ino FROM e) THEN l.e.d END AS parent_idx, l.e.n AS name, coalesce(CAST(floor(p_retailprice) AS BIGINT), 0) AS size, coalesce(p_size::BIGINT, 0) AS mtime, coalesce(p_size % 2 = 0, false) AS is_dir, false AS is_symlink
 FROM l LEFT JOIN part ON p_partkey + 2 = l.ino AND p_size <> 7 UNION ALL SELECT 2, NULL, '', 0, 0, false, false WHERE 2 NOT IN (SELECT ino FROM e)""")  # fmt: skip
def ext4_records(spark, d):
    c = F.col
    li, p = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "part"))
    seq = F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("q"), (c("l_suppkey") + 1).alias("d"), F.concat(F.lit("n"), c("l_orderkey").cast("string")).alias("n"))
    dirents = li.select((c("l_partkey") + 2).alias("ino"), (c("l_suppkey") + 1).alias("dir_ino"), F.concat(F.lit("n"), c("l_orderkey").cast("string")).alias("name"), seq.alias("scan_seq"))
    inodes = p.select((c("p_partkey") + 2).alias("ino"), F.when(c("p_size") == 7, 0).otherwise(1).alias("links_count"), F.floor("p_retailprice").alias("size"), c("p_size").cast("long").alias("mtime"), F.when(c("p_size") % 2 == 0, 0x4000).otherwise(0x8000).alias("mode"))
    return filesystems.ext4_records(inodes, dirents)


def touches(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("ts", F.lit(UID).alias("uid"), F.lit("tree").alias("device_id"), F.lit("f0").alias("fsid_hex"), F.hex("user_id").alias("handle_hex"), F.col("event_type").alias("name"), (F.length(e["event_type"]) % 4 + 1).cast("long").alias("mask"))


SESSION = """SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY {k} ORDER BY ts) > ts - INTERVAL {g} THEN 0 ELSE 1 END AS fresh FROM events)"""


@query("mask_coalesce", f"SELECT user_id, event_type AS name, bit_or(CAST(length(event_type) % 4 + 1 AS BIGINT)) AS mask, count(*) AS touches, min(ts) AS began FROM ({SESSION.format(k='user_id, event_type', g='2 HOURS')}) GROUP BY user_id, event_type, s")
def mask_coalesce(spark, d):
    return watch.coalesced(touches(spark, d), "2 hours").select(F.conv("handle_hex", 16, 10).cast("long").alias("user_id"), "name", "mask", "touches", F.col("began").cast("timestamp_ntz").alias("began"))


@query("quiet_sessions", f"SELECT event_type, min(ts) AS began, max(ts) + INTERVAL 20 MINUTES AS due, count(*) AS touches FROM ({SESSION.format(k='event_type', g='20 MINUTES')}) GROUP BY event_type, s")
def quiet_sessions(spark, d):
    out = watch.sessions(spark.read.parquet(f"{d}/events.parquet"), "20 minutes", "event_type")
    return out.select("event_type", F.col("began").cast("timestamp_ntz").alias("began"), F.col("due").cast("timestamp_ntz").alias("due"), "touches")


@query("touch_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'generic' WHEN 'view' THEN 'malformed' ELSE 'structured' END AS kind FROM events) GROUP BY kind")
def touch_kinds(spark, d):
    t = touches(spark, d).withColumn("name", F.when(F.col("name") == "click", "*").when(F.col("name") == "view", "").otherwise(F.col("name")))
    return watch.classified(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def batch_of(r, folders):
    """Touches of every third order of the first user; handles stand for the folders of two users."""
    own = folders.where(F.col("uid") == UID).select(F.col("dir_id").alias("parent_idx"), F.concat(F.lit("/mnt/./tree/"), "path").alias("parent_path"))
    return r.where((F.col("uid") == UID) & F.expr("name_lc LIKE 'order-%' AND record_idx % 3 = 1")).join(own, "parent_idx").select(
        "uid", "device_id", F.col("record_idx").alias("seq"), "name", F.lit("0400000001000000aabbccdd").alias("handle_hex"), "parent_path", (F.col("size") + 1).alias("size"), (F.col("mtime") + 60).alias("mtime"), F.lit(0x81A4).alias("mode"),
    )


def mounted(spark):
    return spark.createDataFrame([("tree", "/mnt/tree")], "device_id string, primary_mount_point string")


CHANGED = f"""WITH b AS (SELECT 1000 AS uid, * FROM ({TREE}) UNION ALL SELECT 1001, * FROM ({TREE})), c AS (SELECT o_orderkey + 10000000000 AS record_idx FROM orders WHERE o_orderkey % 3 = 0)
 SELECT CAST(b.uid AS BIGINT) AS uid, b.record_idx, CASE WHEN {{hit}} THEN b.size + 1 ELSE b.size END AS size, CASE WHEN {{hit}} THEN b.mtime + 60 ELSE b.mtime END AS mtime, NOT ({{hit}}) AS is_dir FROM b LEFT JOIN c USING (record_idx)"""


def lost_too(batch):
    """``batch`` and one item of the first user whose name nobody knows."""
    return batch.union(batch.orderBy("seq").limit(1).withColumn("name", F.lit("no such name")))


def changed(spark, d, partial=False, lost=False):
    r = two_users(tree(spark, d))
    folders = paths.directory_paths(r)
    batch = batch_of(r, folders)
    out, _ = watch.upsert(r, lost_too(batch) if lost else batch, mounted(spark), partial, folders)
    return out.select("uid", "record_idx", "size", "mtime", "is_dir")


@query("upsert_safe", CHANGED.format(hit="c.record_idx IS NOT NULL AND uid = 1000"))
def upsert_safe(spark, d):
    return changed(spark, d)


@query("upsert_unsafe", CHANGED.format(hit="false"))
def upsert_unsafe(spark, d):
    return changed(spark, d, lost=True)


@query("upsert_partial", CHANGED.format(hit="c.record_idx IS NOT NULL AND uid = 1000"))
def upsert_partial(spark, d):
    return changed(spark, d, True, True)


KINDS = """SELECT o_orderkey AS seq, CASE o_orderkey % 9 WHEN 0 THEN 'generic' WHEN 1 THEN 'malformed' WHEN 2 THEN 'bad handle' WHEN 3 THEN 'outside mount' WHEN 4 THEN 'unknown dir' WHEN 5 THEN 'unknown name' WHEN 6 THEN 'vanished' WHEN 7 THEN 'bad handle' ELSE '' END AS reason FROM orders"""


def judged_odd_batch(spark, d):
    """Every order once, with each thing that can be wrong with an item in turn."""
    r, k = tree(spark, d), F.col("seq") % 9
    folders = paths.directory_paths(r)
    own = folders.select(F.col("dir_id").alias("parent_idx"), F.concat(F.lit("/mnt/tree"), "path").alias("p"))
    o = r.where("name_lc LIKE 'order-%'").join(own, "parent_idx").withColumn("seq", F.col("record_idx") - 10_000_000_000)
    name = F.when(k == 0, "*").when(k == 1, "").when(k == 5, "nothing").otherwise(F.col("name"))
    handle = F.when(k == 2, "0500000001000000aabbccdd").otherwise("0400000001000000aabbccdd")
    place = F.when(k == 3, "/mnt/tree2/x").when(k == 4, "/mnt/tree/no such folder").when(k == 7, None).otherwise(F.col("p"))
    batch = o.select("uid", "device_id", "seq", name.alias("name"), handle.alias("handle_hex"), place.alias("parent_path"), "size", "mtime", F.when(k != 6, 0x41ED).alias("mode"))
    return watch.judged(r, batch, mounted(spark), folders)


@query("unsafe_reasons", KINDS)
def unsafe_reasons(spark, d):
    return judged_odd_batch(spark, d).select("seq", "reason")


@query("batch_counts", f"""SELECT count(*) AS touched, count(*) FILTER (reason = 'generic') AS generic, count(*) FILTER (reason = 'malformed') AS malformed, count(*) FILTER (reason NOT IN ('generic', 'malformed')) AS structured,
 count(*) FILTER (reason = '') AS updated, count(*) FILTER (reason <> '') AS unsafe FROM ({KINDS})""")  # fmt: skip
def batch_counts(spark, d):
    return watch.batch_counts(judged_odd_batch(spark, d)).drop("uid", "device_id")


@query("event_tokens", f"""WITH e AS ({SESSION.format(k="user_id", g="2 HOURS")}), t AS (SELECT user_id, s, event_type AS name, bit_or(CAST(length(event_type) % 4 + 1 AS BIGINT)) AS mask FROM e WHERE event_type NOT IN ('click', 'view') GROUP BY ALL),
 b AS (SELECT user_id, s, min(ts) AS began, bool_or(event_type = 'click') AS overflow, count(*) FILTER (event_type <> 'click') AS seen FROM e GROUP BY ALL)
 SELECT user_id, began, overflow, coalesce(string_agg(name || ':' || mask, ',' ORDER BY name), CASE WHEN max(seen) > 0 THEN '*:1' ELSE '' END) AS touched FROM b LEFT JOIN t USING (user_id, s) GROUP BY user_id, s, began, overflow""")  # fmt: skip
def event_tokens(spark, d):
    t = touches(spark, d).withColumn("uid", F.conv("handle_hex", 16, 10).cast("long")).withColumn("overflow", F.col("name") == "click").withColumn("name", F.when(F.col("name") == "view", "").otherwise(F.col("name")))
    out = watch.tokens_of(t, "2 hours")
    return out.select(F.col("uid").alias("user_id"), F.col("began").cast("timestamp_ntz").alias("began"), "overflow", F.array_join(F.transform("touched", lambda x: F.concat(x["name"], F.lit(":"), x["mask"].cast("string"))), ",").alias("touched"))


@query("backoff_tables", "SELECT CAST(i AS BIGINT) AS n, CASE WHEN i <= 0 THEN 0 ELSE least(600, CAST(30 * pow(2, i - 1) AS BIGINT)) END AS watch_s, least(600, CAST(10 * pow(2, greatest(i, 0)) AS BIGINT)) AS overflow_s FROM range(-2, 21) t(i)")
def backoff_tables(spark, d):
    return spark.range(-2, 21).select(F.col("id").alias("n"), text.watch_backoff(F.col("id")).alias("watch_s"), text.overflow_backoff(F.col("id")).alias("overflow_s"))


@query("filetime", "SELECT o_orderkey, greatest(0, (x - 116444736000000000) // 10000000) AS unix FROM (SELECT o_orderkey, 116444736000000000 + (o_orderkey - 700) * 12345678 AS x FROM orders)")
def filetime(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", text.unix_from_filetime((F.col("o_orderkey") - 700) * 12345678 + F.lit(116444736000000000)).alias("unix"))


SECONDS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey * 86399 WHEN 1 THEN 253402300799 - o_orderkey WHEN 2 THEN 253402300800 + o_orderkey WHEN 3 THEN -o_orderkey * 10000000000 WHEN 4 THEN 67768036191676800 + o_orderkey ELSE 9223372036854775807 - o_orderkey END AS s FROM orders"""
SHOWN = "strftime(make_timestamp(CAST({} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


@query("time_format", f"SELECT o_orderkey, CASE WHEN s < 0 THEN 'out-of-range' WHEN s > 67768036191676799 THEN 'invalid-time' WHEN s >= 253402300800 THEN 'format-error' ELSE {SHOWN.format('least(s, 253402300799)')} END AS shown, CASE WHEN s <= 0 THEN 'Unknown' WHEN s > 67768036191676799 THEN 'invalid-time' WHEN s >= 253402300800 THEN 'format-error' ELSE {SHOWN.format('least(s, 253402300799)')} END AS indexed FROM ({SECONDS})")
def time_format(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 6 == 0, k * 86399).when(k % 6 == 1, F.lit(253402300799) - k).when(k % 6 == 2, k + 253402300800).when(k % 6 == 3, -k * 10000000000).when(k % 6 == 4, k + 67768036191676800).otherwise(F.lit(2**63 - 1) - k)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.display_time(s).alias("shown"), text.last_indexed(s).alias("indexed"))


@query("filetime_display", f"""SELECT o_orderkey, CASE WHEN t = 0 THEN 'N/A' WHEN t < 0 OR t // 10000000 - 11644473600 >= 253402300800 THEN 'format-error' ELSE {SHOWN.format("t // 10000000 - 11644473600")} END AS shown
 FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 116444736000000000 + (o_orderkey - 700) * 987654321 WHEN 2 THEN o_orderkey * 1000000007 ELSE 3000000000000000000 * (o_orderkey % 8 - 4) END AS t FROM orders)""")  # fmt: skip
def filetime_display(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 4 == 0, 0).when(k % 4 == 1, (k - 700) * 987654321 + F.lit(116444736000000000)).when(k % 4 == 2, k * 1000000007).otherwise((k % 8 - 4) * F.lit(3000000000000000000))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.filetime_display(t).alias("shown"))


@query("fs_normalise", """SELECT p_partkey, CASE WHEN contains(x, 'ntfs') THEN 'ntfs' WHEN contains(x, 'ext4') THEN 'ext4' ELSE '' END AS kind FROM (SELECT p_partkey, lower(CASE p_size % 5 WHEN 0 THEN ' NTFS3' WHEN 1 THEN 'fuseblk.' || p_name WHEN 2 THEN 'Ext4dev' WHEN 3 THEN 'ext4 on ntfs' ELSE p_type END) AS x FROM part)""")
def fs_normalise(spark, d):
    k = F.col("p_size")
    fs = F.when(k % 5 == 0, " NTFS3").when(k % 5 == 1, F.concat(F.lit("fuseblk."), "p_name")).when(k % 5 == 2, "Ext4dev").when(k % 5 == 3, "ext4 on ntfs").otherwise(F.col("p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.fs_kind(fs).alias("kind"))


@query("progress_parse", "SELECT o_orderkey, CAST(greatest(0, least(100, o_orderkey - 500)) AS INT) AS p FROM orders WHERE o_orderkey % 4 <> 0")
def progress_parse(spark, d):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("noise "), k.cast("string"))).otherwise(F.concat(F.lit("SCAN_PROGRESS "), (k - 500).cast("string")))
    out = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.progress_percent(line).alias("p"))
    return out.where("p IS NOT NULL")


@query("progress_done", "SELECT o_orderkey, CAST((least(o_orderkey, t) * 100 + t // 2) // t AS INT) AS p FROM (SELECT o_orderkey, greatest(o_custkey, 1) AS t FROM orders)")
def progress_done(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.percent_done(F.col("o_orderkey"), F.col("o_custkey")).alias("p"))


@query("durations", "SELECT o_orderkey, CASE WHEN t < 60 THEN t || 's' ELSE format('{:,}', t // 60) || 'm ' || (t % 60) || 's' END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 7000000 AS t FROM orders)")
def durations(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.compact_duration(k * k % 7000000).alias("shown"))


@query("hex_handles", "SELECT p_partkey, lower(hex(encode(p_name))) AS handle, p_name AS back, CASE WHEN p_partkey % 2 = 0 THEN octet_length(encode(p_name)) END AS n FROM part")
def hex_handles(spark, d):
    h = text.handle_hex(F.col("p_name").cast("binary"))
    odd = F.when(F.col("p_partkey") % 2 == 0, h).otherwise(F.concat(h, F.lit("0")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", h.alias("handle"), F.decode(text.handle_bytes(h), "utf-8").alias("back"), F.octet_length(text.handle_bytes(odd)).cast("long").alias("n"))


@query("reparse_links", "SELECT o_orderkey, (o_orderkey & 1024) <> 0 AND o_custkey % 3 < 2 AS link FROM orders")
def reparse_links(spark, d):
    tag = F.when(F.col("o_custkey") % 3 == 0, 0xA000000C).when(F.col("o_custkey") % 3 == 1, 0xA0000003).otherwise(0x80000017)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.is_link(F.col("o_orderkey"), tag).alias("link"))


@query("clean_paths", r"""WITH x AS (SELECT page_id, '/mnt//d/./' || regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 4 WHEN 0 THEN '/../b/' WHEN 1 THEN '/../../../../e' ELSE '//' END AS p FROM pages),
 y AS (SELECT page_id, unnest(string_split(p, '/')) AS part, generate_subscripts(string_split(p, '/'), 1) AS i FROM x), z AS (SELECT page_id, list(part ORDER BY i) FILTER (part NOT IN ('', '.')) AS l FROM y GROUP BY page_id),
 w AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN list_concat(l[:len(l) - 3], ['b']) WHEN 1 THEN list_concat(l[:greatest(0, len(l) - 9)], ['e']) ELSE l END AS l, len(l) AS n FROM z WHERE page_id % 4 <> 1)
 SELECT page_id, '/' || array_to_string(l, '/') AS clean, '/' || array_to_string(l[3:], '/') AS inside FROM w""")  # fmt: skip
def clean_paths(spark, d):
    k = F.col("page_id")
    path = F.concat(F.lit("/mnt//d/./"), F.regexp_replace("url", "^[a-z]+://", ""), F.when(k % 4 == 0, "/../b/").otherwise("//"))
    out = spark.read.parquet(f"{d}/pages.parquet").where(k % 4 != 1)
    return out.select("page_id", text.clean_path(path).alias("clean"), text.path_under_mount(path, F.lit("/mnt/d/")).alias("inside"))


@query("by_kind", r"""SELECT kind, count(*) AS n, array_to_string(list_sort(list(name)), '/') AS names FROM (SELECT p_name || CASE p_size % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.tar.gz' ELSE '' END AS name, CASE WHEN p_partkey % 7 = 0 THEN 'folder' WHEN p_size % 3 = 0 THEN 'txt' WHEN p_size % 3 = 1 THEN 'gz' ELSE 'none' END AS kind FROM part) GROUP BY kind""")
def by_kind(spark, d):
    r = spark.read.parquet(f"{d}/part.parquet")
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".TXT").when(F.col("p_size") % 3 == 1, ".tar.gz").otherwise(""))
    return devices.by_kind(r.select(name.alias("name"), (F.col("p_partkey") % 7 == 0).alias("is_dir"))).withColumn("names", F.array_join("names", "/"))


@query("entry_outputs", """SELECT p_partkey AS pos, p_name AS name, '/mnt/a b/' || p_name AS display_path, CASE WHEN p_size % 2 = 0 THEN 'file:///mnt/a%20b/' || replace(p_name, ' ', '%20') END AS url FROM part""")
def entry_outputs(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return devices.outputs(p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.concat(F.lit("/mnt/a b/"), "p_name").alias("display_path"), (F.col("p_size") % 2 == 0).alias("mounted")))


@query("global_rank", f"SELECT record_idx, row_number() OVER (ORDER BY size, name_lc, device_id, record_idx) - 1 AS global_rank FROM ({PARTS})")
def global_rank(spark, d):
    return search.ranked_over_devices(parts(spark, d), "size").select("record_idx", "global_rank")



BUILT: dict[tuple[str, str, str], store.Catalogue] = {}


def built(spark, d, name, source):
    """A catalogue that is written once for each application and table folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in BUILT:
        made = store.Catalogue(spark, new_path(spark, f"catalogue-{name}"))
        rows = source(spark, d)
        for r in rows.select("device_id").distinct().orderBy("device_id").collect():
            made.write(rows.where(F.col("device_id") == r[0]).drop("uid", "device_id", "name_lc"), UID, r[0], "ext4", "Data", "u", 1)
        BUILT[key] = made
    return BUILT[key]


def few_parts(spark, d):
    """Three of the brands' devices, as each is a generation of its own."""
    return parts(spark, d).where(F.col("device_id").isin("Brand#11", "Brand#22", "Brand#33"))


FEW = f"(SELECT * FROM ({PARTS}) WHERE device_id IN ('Brand#11', 'Brand#22', 'Brand#33'))"


@query("snapshot_round_trip", f"SELECT device_id, record_idx, name, size, mtime, is_dir FROM {FEW}")
def snapshot_round_trip(spark, d):
    return built(spark, d, "parts", few_parts).records(UID).select("device_id", "record_idx", "name", "size", "mtime", "is_dir")


@query("stored_page", f"SELECT CAST(row_number() OVER (ORDER BY size DESC, name_lc DESC, record_idx DESC) - 1 AS BIGINT) AS pos, record_idx, size FROM ({TREE}) QUALIFY pos >= 700 AND pos < 956")
def stored_page(spark, d):
    return built(spark, d, "tree", tree).page_by_stored_rank(UID, "tree", "size", "desc", 700, 256).select("pos", "record_idx", "size")


@query("stored_global_page", f"SELECT row_number() OVER (ORDER BY mtime, name_lc, device_id, record_idx) - 1 AS pos, device_id, record_idx FROM {FEW} QUALIFY pos >= 10 AND pos < 60")
def stored_global_page(spark, d):
    return built(spark, d, "parts", few_parts).page_over_devices(UID, "mtime", "asc", 10, 50).select("pos", "device_id", "record_idx")


@query("stored_trigrams", f"SELECT device_id, record_idx, name FROM ({TREE}) WHERE {like('123', 'ord')}")
def stored_trigrams(spark, d):
    return built(spark, d, "tree", tree).search(UID, "123 Ord", indexed=True).select("device_id", "record_idx", "name")


@query("latest_generation", """WITH c AS (SELECT o_custkey % 50 AS k, arg_max({'g': o_orderkey, 's': o_orderstatus, 'p': CAST(floor(o_totalprice) AS BIGINT)}, o_orderkey) AS c FROM orders GROUP BY 1) SELECT k, c.g AS generation, c.p AS entry_count FROM c""")
def latest_generation(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    updates = o.select(F.lit(UID).alias("uid"), (F.col("o_custkey") % 50).alias("device_id"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("generation"), F.floor("o_totalprice").alias("entry_count"))
    return store.latest_in_window(updates).select(F.col("device_id").alias("k"), "generation", "entry_count")


@query("notifications", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id FROM events WHERE user_id % 10 = 0), w AS (SELECT user_id, min(t) AS opened FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.opened + 36000000) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.t >= w.opened + 36000000))
 SELECT w.user_id AS uid, opened, max(t) AS last, arg_max(event_id, t) AS generation FROM w JOIN e ON e.user_id = w.user_id AND e.t >= opened AND e.t < opened + 36000000 GROUP BY ALL""")  # fmt: skip
def notifications(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("user_id % 10 = 0")
    updates = e.select(F.col("user_id").alias("uid"), F.lit("d").alias("device_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("generation"), F.unix_millis(F.col("ts").cast("timestamp")).alias("entry_count"))
    return store.notified(updates, 36000000).select("uid", "opened", F.col("entry_count").alias("last"), "generation")


@query("quiet_rescans", """SELECT uid, due AS at_ms FROM (SELECT event_id % 40 AS uid, epoch_us(ts) // 1000 + 2000 AS due, lead(epoch_us(ts) // 1000) OVER (PARTITION BY event_id % 40 ORDER BY ts) AS later FROM events) WHERE later IS NULL OR later >= due""")
def quiet_rescans(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    events = e.select((F.col("event_id") % 40).alias("uid"), F.lit("d").alias("device_id"), "ts", F.lit("unsafe").alias("kind"), F.lit("{}").alias("detail"))
    return timers.replayed(events, timers.Quiet()).select("uid", "at_ms")
