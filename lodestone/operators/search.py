"""Search over a catalogue: filters, orders, merges and pages. Every ordered result carries its position."""

from __future__ import annotations

from collections import OrderedDict
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import contains_all, display_time, flags, fnv32, grouped, token_trigrams, tokens, trigrams
from ..shared import written

KEYS = {"name": [], "path": ["parent_idx"], "size": ["size"], "mtime": ["mtime"]}


def sort_key(name: str | None) -> str:
    """Known keys in any case; anything else sorts by name."""
    low = (name or "").lower()
    return low if low in KEYS or low == "fullpath" else "name"


def order_columns(sort: str, with_device: bool = True) -> list[str]:
    key = sort_key(sort)
    lead = ["fullpath_lc"] if key == "fullpath" else KEYS[key]
    return [*lead, "name_lc", *(["device_id"] if with_device else []), "record_idx"]


def ordering(columns: list[str], descending: bool) -> list[Column]:
    """A missing parent sorts last ascending, first descending."""
    return [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c in columns]


def matching(records: DataFrame, query: str, uid: int, devices: list[str] | None = None) -> DataFrame:
    """Records of one user, of the devices named or of all, whose name holds every token."""
    hits = records.where(F.col("uid") == uid)
    if devices:
        hits = hits.where(F.col("device_id").isin(devices))
    return hits.where(contains_all(F.col("name_lc"), query))


def total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("total"))


def search_rows(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(
        *more, fnv32("device_id").alias("device_hash"), "record_idx", "device_id", "name", F.col("parent_idx").alias("dir_id"), "size", "mtime", flags(F.col("is_dir"), F.col("is_symlink")).alias("flags")
    )


def display_columns(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Name, path, size and date of search rows as a list shows them, with their ``pos``.

    ``shown`` has device_id, dir_id and the folders' paths that are known so far; others are ``…`` until they are.
    """
    folder = shown.select("device_id", F.coalesce("dir_id", F.lit(-1)).alias("_dir"), F.col("shown").alias("path"))
    out = rows.withColumn("_dir", F.coalesce("dir_id", F.lit(-1))).join(folder, ["device_id", "_dir"], "left")
    size = F.when(F.col("flags").bitwiseAND(1) != 0, "<DIR>").otherwise(grouped(F.col("size")))
    time = F.when(F.col("mtime") < 0, "invalid-time").otherwise(display_time(F.col("mtime")))
    return out.select("pos", "name", F.coalesce("path", F.lit("…")).alias("path"), size.alias("shown_size"), time.alias("shown_time"))


def page(hits: DataFrame, sort: str = "name", direction: str = "asc", offset: int = 0, limit: int = 256, compat: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order with ``pos``, a top-k plan; limit 0 gives no rows.

    The plan keeps ``offset + limit`` rows, so far pages of whole catalogues go by stored ranks (``store``). With
    ``compat`` a descending order over several devices lists whole devices, those with smaller largest keys first, as
    engines do whose merge ignores the direction. ``more`` names further columns to return.
    """
    columns, descending = order_columns(sort), (direction or "").lower() == "desc"
    if compat and descending:
        lead = [c for c in columns if c not in ("device_id", "record_idx")]
        top = hits.groupBy("device_id").agg(F.max(F.struct(*lead)).alias("_top"))  # a row for each device
        hits = hits.join(top, "device_id")
        order = [F.col("_top").asc(), F.col("device_id").asc(), *ordering(order_columns(sort, False), True)]
    else:
        order = ordering(columns, descending)
    # The limit comes first, so only a page is numbered in one task.
    near = hits.orderBy(*order).limit(offset + limit)
    pos = F.row_number().over(Window.orderBy(*order)) - 1
    return search_rows(near.withColumn("pos", pos).where(F.col("pos") >= offset), "pos", *more)


def positioned(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """A written table with ``name``, each row's place in the whole order from 0, in that order.

    Rows are dealt by ranges of the order and sorted there; the driver adds up one count for each partition, so no
    task ever holds a device.
    """
    kept = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = written(kept, "order")
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in kept.groupBy(part.alias("p")).count().collect())
    starts = list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0)))
    firsts = rows.sparkSession.createDataFrame(starts, "_p long, _first long")  # one row for each partition
    kept = kept.withColumn("_p", part.cast("long")).join(F.broadcast(firsts), "_p")
    return kept.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_first")


def ranked(records: DataFrame, keys: tuple[str, ...] = tuple(KEYS)) -> DataFrame:
    """Adds ``rank_<key>`` for each of ``keys``: positions within each device of each user, from 0."""
    for key in keys:
        own = ["uid", "device_id"]
        placed = positioned(records, ordering([*own, *order_columns(key, False)], False), "_pos")
        first = placed.groupBy(*own).agg(F.min("_pos").alias("_low"))  # a row for each device
        records = placed.join(first, own).withColumn(f"rank_{key}", F.col("_pos") - F.col("_low")).drop("_pos", "_low")
    return records


def ranked_over_devices(records: DataFrame, key: str) -> DataFrame:
    """Adds ``global_rank``: positions within all records of each user, from 0, ties by device and record."""
    placed = positioned(records, ordering(["uid", *order_columns(key)], False), "_pos")
    first = placed.groupBy("uid").agg(F.min("_pos").alias("_low"))
    return placed.join(first, "uid").withColumn("global_rank", F.col("_pos") - F.col("_low")).drop("_pos", "_low")


def page_by_rank(ranks: DataFrame, hits: DataFrame, sort: str, offset: int, limit: int) -> DataFrame:
    """A page merged by each hit's rank among all records of its device, ties by device and record."""
    rank = F.col(f"rank_{sort_key(sort)}")
    joined = hits.join(ranks.select("uid", "device_id", "record_idx", rank.alias("rank")), ["uid", "device_id", "record_idx"])
    order = [F.col("rank"), F.col("device_id"), F.col("record_idx")]
    near = joined.orderBy(*order).limit(offset + limit)
    return search_rows(near.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1).where(F.col("pos") >= offset), "pos", "rank")


def postings(records: DataFrame) -> DataFrame:
    """(trigram, uid, device_id, record_idx), sorted by trigram within range partitions."""
    rows = records.select(F.explode(trigrams(F.col("name_lc"))).alias("trigram"), "uid", "device_id", "record_idx")
    return rows.repartitionByRange("trigram").sortWithinPartitions("trigram", "device_id", "record_idx")


def candidates(posted: DataFrame, records: DataFrame, query: str) -> DataFrame:
    """Records that hold all trigrams of the query's tokens of three bytes or more; all records where there are none."""
    wanted = token_trigrams(query)
    if not wanted:
        return records
    keys = ["uid", "device_id", "record_idx"]
    full = posted.where(F.col("trigram").isin(wanted)).groupBy(*keys).count().where(F.col("count") == len(wanted)).select(*keys)
    return records.join(full, keys, "left_semi")


def indexed_search(posted: DataFrame, records: DataFrame, query: str, uid: int) -> DataFrame:
    """Candidates first, then the exact filter; equal to :func:`matching`."""
    return matching(candidates(posted, records, query), query, uid) if tokens(query) else matching(records, query, uid)


class Pages:
    """Rows of one result list by position, in pages of ``SIZE`` that are fetched once and kept, the latest ``KEPT``.

    ``fetch(offset, limit)`` gives a frame with ``pos``. A page brings its neighbours with it. ``reset`` begins a new
    list; what an old one still fetches is dropped.
    """

    SIZE, KEPT = 256, 64

    def __init__(self, fetch, total: int):
        self.serial = 0
        self.reset(fetch, total)

    def reset(self, fetch, total: int) -> None:
        self.fetch, self.total, self.serial = fetch, total, self.serial + 1
        self.held: OrderedDict[int, list[Row]] = OrderedDict()

    def page(self, k: int, neighbours: bool = True) -> list[Row]:
        wanted = [x for x in ((k - 1, k, k + 1) if neighbours else (k,)) if 0 <= x * self.SIZE < self.total and x not in self.held]
        if wanted:
            serial, first, last = self.serial, min(wanted), max(wanted)
            rows = sorted(self.fetch(first * self.SIZE, (last + 1 - first) * self.SIZE).collect(), key=lambda r: r["pos"])  # at most three pages
            if serial == self.serial:
                for x in range(first, last + 1):
                    self.held[x] = rows[(x - first) * self.SIZE : (x + 1 - first) * self.SIZE]
        if k in self.held:
            self.held.move_to_end(k)
        while len(self.held) > self.KEPT:
            self.held.popitem(last=False)
        return self.held.get(k, [])

    def row(self, pos: int) -> Row | None:
        rows = self.page(pos // self.SIZE)
        return rows[pos % self.SIZE] if pos % self.SIZE < len(rows) else None

    def __iter__(self):
        for k in range(-(-self.total // self.SIZE)):
            yield from self.page(k, False)
