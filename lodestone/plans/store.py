"""The persisted catalogue: generations of devices, their orders and postings, and a log of commits.

``root/data/uid=U/<sha1 of the device>/<generation>-<unique>`` holds ``records`` (sorted by name), ``order_<key>``
(the records with their places by each key, in that order, so that a page is a range of one table), ``dirs`` (paths)
and ``postings`` (sorted by trigram). A commit is one small
file in ``root/log``, put there under the next free number by a rename that fails where the number is taken, so
readers see a whole generation or none, and of two writers one starts again. The latest commit of a device says what
it is; the number of commits is the epoch that tells readers when their cached orders are stale.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_lower
from ..operators import search
from ..operators.paths import directory_paths
from ..shared import written

FORMAT = 5
#: How many records and bytes of names one device may have.
MAX_RECORDS, MAX_NAME_BYTES = 500_000_000, 8 << 30
RECORD = "uid long, device_id string, record_idx long, parent_idx long, name string, name_lc string, size long, mtime long, is_dir boolean, is_symlink boolean"
ORDER = "uid long, device_id string, record_idx long, parent_idx long, name string, size long, mtime long, is_dir boolean, is_symlink boolean, rank long"
TABLES = ("records", "dirs", "postings", *(f"order_{k}" for k in search.KEYS))
DIRS = "uid long, device_id string, dir_id long, path string"
POSTINGS = "trigram string, uid long, device_id string, record_idx long"
COMMIT = (
    "number long, uid long, device_id string, generation long, format int, path string, fs_type string, label string, uuid string, entry_count long, last_indexed_time long, watch_enabled boolean, removed boolean"
)


def snapshot_key(uid: int, device_id: str) -> str:
    """Where a device's data lie below the catalogue's root; safe for any file system."""
    return f"uid={uid}/{hashlib.sha1(device_id.encode()).hexdigest()}"


def snapshot_keys(uid: Column, device_id: Column) -> Column:
    """The same as a column, without the name of the first folder's key."""
    return F.concat_ws("/", uid.cast("string"), F.sha1(device_id))


class TakenError(Exception):
    """Another writer has taken the commit's number."""


@dataclass
class Catalogue:
    spark: SparkSession
    root: str

    # The log

    def _files(self):
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI.create(self.root), self.spark._jsc.hadoopConfiguration())
        return context, jvm.org.apache.hadoop.fs.Path, jvm

    def _numbers(self) -> list[int]:
        files, path, _ = self._files()
        at = path(f"{self.root}/log")
        if not files.util().exists(at):
            return []
        names = (s.getPath().getName() for s in files.util().listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def epoch(self) -> int:
        """Grows by one with each commit; cached orders of an older epoch are stale."""
        return max(self._numbers(), default=0)

    def commit(self, expected: int | None = None, **fields) -> int:
        """Puts one commit after the last; ``expected`` is the epoch it was made from. Gives the new epoch."""
        files, path, jvm = self._files()
        number = (self.epoch() if expected is None else expected) + 1
        line = json.dumps({"number": number, "format": FORMAT, "removed": False} | fields)
        flag = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
        parents = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
        options[0] = parents
        draft, final = path(f"{self.root}/log/{uuid.uuid4().hex}.draft"), path(f"{self.root}/log/{number:020d}.json")
        out = files.create(draft, flag, options)
        out.write(bytearray(line.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, none)  # fails where the number is taken
        except Exception as e:
            files.delete(draft, False)
            raise TakenError(str(number)) from e
        return number

    def log(self) -> DataFrame:
        if not self._numbers():
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).json(f"{self.root}/log/*.json")

    def latest(self, uid: int | None = None) -> DataFrame:
        """The last commit of each device that hasn't been removed since."""
        log = self.log() if uid is None else self.log().where(F.col("uid") == uid)
        fields = [c for c in log.columns if c not in ("uid", "device_id")]
        last = log.groupBy("uid", "device_id").agg(F.max_by(F.struct(*fields), "number").alias("c"))
        return last.select("uid", "device_id", "c.*").where("NOT removed")

    def _one(self, uid: int, device_id: str):
        return self.latest(uid).where(F.col("device_id") == device_id).first()

    # Writing

    def write(self, records: DataFrame, uid: int, device_id: str, fs_type: str = "", label: str = "", device_uuid: str = "", indexed_at: int | None = None) -> int:
        """A new generation of one device; readers have it as soon as its commit is there. Gives its number.

        ``records`` have the columns of ``RECORD`` but uid and device_id. No records at all, too many, or a record
        without a name, size or time is an error, and leaves the last generation as it was.
        """
        before, epoch = self._one(uid, device_id), self.epoch()
        generation = (before["generation"] if before else 0) + 1
        path = f"{self.root}/data/{snapshot_key(uid, device_id)}/{generation}-{uuid.uuid4().hex}"
        own = records.select(
            F.lit(uid).cast("long").alias("uid"), F.lit(device_id).alias("device_id"), "record_idx", "parent_idx", "name", ascii_lower("name").alias("name_lc"), "size", "mtime", "is_dir", "is_symlink"
        )
        own.repartitionByRange("name_lc", "record_idx").sortWithinPartitions("name_lc", "record_idx").write.parquet(f"{path}/records")
        own = self.spark.read.schema(RECORD).parquet(f"{path}/records")
        bad = F.count_if(F.col("name").isNull() | F.col("record_idx").isNull() | F.col("size").isNull() | F.col("mtime").isNull())
        n, odd, size = own.agg(F.count(F.lit(1)), bad, F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()
        if not 0 < n <= MAX_RECORDS or odd or size > MAX_NAME_BYTES:
            raise ValueError(f"{n} records, of which {odd} are incomplete, with {size} bytes of names")
        self._accelerate(own, path)
        facts = {"fs_type": fs_type or (before["fs_type"] if before else ""), "label": label or (before["label"] if before else ""), "uuid": device_uuid or (before["uuid"] if before else "")}
        self.commit(
            epoch, uid=uid, device_id=device_id, generation=generation, path=path, entry_count=n, last_indexed_time=int(time.time()) if indexed_at is None else indexed_at,
            watch_enabled=before["watch_enabled"] if before else True, **facts,
        )
        return generation

    def _accelerate(self, own: DataFrame, path: str) -> None:
        ranked = written(search.ranked(own), "ranked")
        for key in search.KEYS:
            rows = ranked.select("uid", "device_id", "record_idx", "parent_idx", "name", "size", "mtime", "is_dir", "is_symlink", F.col(f"rank_{key}").alias("rank"))
            rows.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(f"{path}/order_{key}")
        directory_paths(own).write.mode("overwrite").parquet(f"{path}/dirs")
        search.postings(own).write.mode("overwrite").parquet(f"{path}/postings")

    def forget(self, uid: int, device_id: str) -> bool:
        """Removes a device; its files may be deleted when no reader uses them. False where there was none."""
        if not (before := self._one(uid, device_id)):
            return False
        self.commit(**before.asDict() | {"number": self.epoch() + 1, "removed": True})
        return True

    def set_watch_enabled(self, uid: int, device_id: str, enabled: bool) -> None:
        if not (before := self._one(uid, device_id)):
            raise KeyError(f"no index of {device_id}")
        if before["watch_enabled"] != enabled:
            self.commit(**before.asDict() | {"number": self.epoch() + 1, "watch_enabled": enabled})

    def upgrade(self, uid: int) -> list[str]:
        """Writes the orders of devices anew that an older format has written, one after the other."""
        done = []
        for row in sorted(self.latest(uid).where(F.col("format") < FORMAT).collect(), key=lambda r: r["device_id"]):
            self._accelerate(self.spark.read.schema(RECORD).parquet(f"{row['path']}/records"), row["path"])
            self.commit(**row.asDict() | {"number": self.epoch() + 1, "format": FORMAT})
            done.append(row["device_id"])
        return done

    def apply(self, uid: int, device_id: str, changed: DataFrame) -> int:
        """A generation with changed records; orders and ranks are made anew with it."""
        row = self._one(uid, device_id)
        own = changed.where((F.col("uid") == uid) & (F.col("device_id") == device_id))
        return self.write(own, uid, device_id, row["fs_type"], row["label"], row["uuid"], row["last_indexed_time"])

    # Reading

    def load(self, uid: int) -> tuple[list, list[str]]:
        """(commits whose files are whole, devices that were skipped because theirs are not)."""
        files, path, _ = self._files()
        good, bad = [], []
        for row in sorted(self.latest(uid).collect(), key=lambda r: r["device_id"]):  # a row for each device of a user
            whole = all(files.util().exists(path(f"{row['path']}/{t}/_SUCCESS")) for t in TABLES)
            (good if whole else bad).append(row if whole else row["device_id"])
        return good, bad

    def _read(self, uid: int, name: str, ddl: str, devices: list[str] | None) -> DataFrame:
        paths = [f"{r['path']}/{name}" for r in self.load(uid)[0] if not devices or r["device_id"] in devices]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def records(self, uid: int, devices: list[str] | None = None) -> DataFrame:
        """Records of a user's devices that are whole; other devices' files aren't opened."""
        return self._read(uid, "records", RECORD, devices)

    def order(self, uid: int, key: str = "name", devices: list[str] | None = None) -> DataFrame:
        """Records with ``rank``, their place within their device by the key."""
        return self._read(uid, f"order_{search.sort_key(key)}", ORDER, devices)

    def dirs(self, uid: int, devices: list[str] | None = None) -> DataFrame:
        return self._read(uid, "dirs", DIRS, devices)

    def postings(self, uid: int, devices: list[str] | None = None) -> DataFrame:
        return self._read(uid, "postings", POSTINGS, devices)

    def page_by_stored_rank(self, uid: int, device_id: str, key: str = "name", direction: str = "asc", offset: int = 0, limit: int = 256) -> DataFrame:
        """A page of one device in any depth: a range of the key's order, which the scan's pushed filter finds."""
        n, rank = self._one(uid, device_id)["entry_count"], F.col("rank")
        down = (direction or "").lower() == "desc"
        low, high = (n - offset - limit, n - offset) if down else (offset, offset + limit)
        hits = self.order(uid, key, [device_id]).where((rank >= low) & (rank < high))
        return search.search_rows(hits.withColumn("pos", n - 1 - rank if down else rank), "pos")

    def global_order(self, uid: int, key: str) -> DataFrame:
        """(global_rank, device_id, record_idx, …) over a user's devices, written once for each epoch."""
        path = f"{self.root}/orders/uid={uid}/{search.sort_key(key)}/{self.epoch()}"
        files, at, _ = self._files()
        if not files.util().exists(at(f"{path}/_SUCCESS")):
            search.ranked_over_devices(self.records(uid), key).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def page_over_devices(self, uid: int, key: str = "name", direction: str = "asc", offset: int = 0, limit: int = 256) -> DataFrame:
        """A page over all devices of a user in any depth, by the stored order of this epoch."""
        rows, rank = self.global_order(uid, key), F.col("global_rank")
        n = sum(r["entry_count"] for r in self.load(uid)[0])
        down = (direction or "").lower() == "desc"
        low, high = (n - offset - limit, n - offset) if down else (offset, offset + limit)
        return search.search_rows(rows.where((rank >= low) & (rank < high)).withColumn("pos", n - 1 - rank if down else rank), "pos")

    def search(self, uid: int, query: str, devices: list[str] | None = None, indexed: bool = False) -> DataFrame:
        """Records whose names hold every token; ``indexed`` goes by postings, whose scan takes the trigrams' filter."""
        rows = self.records(uid, devices)
        return search.indexed_search(self.postings(uid, devices), rows, query, uid) if indexed else search.matching(rows, query, uid)


def latest_in_window(updates: DataFrame, *keys: str) -> DataFrame:
    """Of several updates of a device in one window the last one's generation and count."""
    return updates.groupBy(*keys, "uid", "device_id").agg(F.max_by(F.struct("generation", "entry_count"), "at").alias("u")).select(*keys, "uid", "device_id", "u.generation", "u.entry_count")


def notified(updates: DataFrame, window_ms: int = 250) -> DataFrame:
    """One notification for each device of each window, which the first update opens and ``window_ms`` later ends.

    ``at`` is in milliseconds. An update that comes ``window_ms`` or more after the one before it always opens a
    window, so only updates in between are folded, one burst of a user at a time.
    """
    in_order = Window.partitionBy("uid").orderBy("at")
    late = F.coalesce(F.col("at") - F.lag("at").over(in_order) >= window_ms, F.lit(True))
    bursts = updates.withColumn("late", late.cast("int")).withColumn("burst", F.sum("late").over(in_order))
    one = F.struct("at", "device_id", "generation", "entry_count")
    bursts = bursts.groupBy("uid", "burst").agg(F.array_sort(F.collect_list(one)).alias("all"))
    opens = F.aggregate(
        "all", F.array().cast("array<bigint>"), lambda w, x: F.when((F.size(w) == 0) | (x["at"] >= F.try_element_at(w, F.lit(-1)) + window_ms), F.array_append(w, x["at"])).otherwise(w)
    )
    flat = bursts.withColumn("opens", opens).select("uid", "opens", F.explode("all").alias("x")).select("uid", "opens", "x.*")
    flat = flat.withColumn("opened", F.array_max(F.filter("opens", lambda o: o <= F.col("at")))).drop("opens")
    return latest_in_window(flat, "opened")
