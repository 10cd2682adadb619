"""The engine's methods over a persisted catalogue, for one caller's user id at a time."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import devices, paths, search
from .plans.store import Catalogue
from .streaming import watch

VERSION = "1"
#: Pages from FAR rows on, or from a quarter of WARM or more, go by the stored order of all devices.
PROGRESS = re.compile(r"\w*PROGRESS (-?\d{1,9})")
FAR, WARM = 100_000, 1_000_000


@dataclass
class Job:
    id: int
    uid: int
    device_id: str
    state: str = "running"
    status: str = ""
    message: str = ""
    percent: int = 0


@dataclass
class Engine:
    """``known`` gives the devices that are there now; ``events`` gets (name, details) of jobs and indexes."""

    spark: SparkSession
    catalogue: Catalogue
    known: Callable[[], DataFrame]
    events: Callable[[str, dict], None] = lambda name, details: None
    jobs: dict[int, Job] = field(default_factory=dict)

    def __post_init__(self):
        self._ids, self._lock, self._loaded = count(1), threading.Lock(), set()

    def _ready(self, uid: int) -> None:
        """Says once what a user's catalogue holds, and writes orders of older formats anew."""
        if uid in self._loaded:
            return
        self._loaded.add(uid)
        self.events("StateChanged", {"state": "loadingSnapshots"})
        good, bad = self.catalogue.load(uid)
        self.catalogue.upgrade(uid)
        self.events("StateChanged", {"state": "ready", "devices": len(good), "skipped": bad})

    def ping(self) -> str:
        return VERSION

    def list_known_devices(self) -> DataFrame:
        return self.known()

    def list_indexed_devices(self, uid: int) -> DataFrame:
        return self.catalogue.latest(uid).select("device_id", "fs_type", "generation", "entry_count", "last_indexed_time", "label", "uuid", "watch_enabled")

    def _running(self, uid: int, device_id: str) -> bool:
        return any(j.uid == uid and j.device_id == device_id and j.state in ("running", "cancelling") for j in self.jobs.values())

    def start_index(self, uid: int, device_id: str, scan: Callable[[], DataFrame], auto: bool = False) -> int:
        """Indexes a device from ``scan()`` and gives the job's id, 0 for an automatic one that isn't allowed.

        An unknown device, or one that a job of this user works on, gives a job that ended in error. An automatic job
        runs only for a device that is indexed and watched.
        """
        row = self.known().where(F.col("device_id") == device_id).first()
        if auto:
            before = self.catalogue._one(uid, device_id)
            if row is None or before is None or not before["watch_enabled"]:
                return 0
        with self._lock:
            busy = self._running(uid, device_id)
            if auto and busy:
                return 0
            job = Job(next(self._ids), uid, device_id)
            self.jobs[job.id] = job
            self.events("JobAdded", {"id": job.id, "device_id": device_id})
            if row is None or busy:
                self._finish(job, "error", "unknown device" if row is None else "an indexing job is running for this device")
                return job.id
        if auto:
            self.events("StateChanged", {"state": "rescanning", "device_id": device_id})
        group = f"index-{job.id}"
        self.spark.sparkContext.setJobGroup(group, f"index {device_id}", True)
        try:
            facts = row.asDict()
            generation = self.catalogue.write(scan(), uid, device_id, facts.get("fs_type") or "", facts.get("label") or "", facts.get("uuid") or "")
            if job.state == "cancelling":
                self._finish(job, "cancelled", "")
            else:
                job.percent = 100
                self.events("DeviceIndexUpdated", {"device_id": device_id, "generation": generation})
                self._finish(job, "ok", "")
        except Exception as e:  # a job's failure is its result
            self._finish(job, "cancelled" if job.state == "cancelling" else "error", str(e).split("\n")[0])
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return job.id

    def _finish(self, job: Job, status: str, message: str) -> None:
        job.state, job.status, job.message = "finished", status, message
        self.events("JobFinished", {"id": job.id, "status": status, "message": message, "device_id": job.device_id})

    def report(self, job_id: int, line: str) -> None:
        """A line that a scan has written: progress goes out once for each percent, other lines are dropped."""
        job, found = self.jobs.get(job_id), PROGRESS.fullmatch(line.strip())
        if job and found and job.state == "running" and (percent := max(0, min(100, int(found[1])))) != job.percent:
            job.percent = percent
            self.events("JobProgress", {"id": job_id, "percent": percent})

    def cancel_job(self, uid: int, job_id: int) -> bool:
        """Ends a running job of this user; others' jobs stay."""
        job = self.jobs.get(job_id)
        if job is None or job.uid != uid or job.state != "running":
            return False
        job.state = "cancelling"
        self.spark.sparkContext.cancelJobGroup(f"index-{job_id}")
        return True

    def search(self, uid: int, query: str = "", device_ids: list[str] | None = None, sort: str = "name", direction: str = "asc", offset: int = 0, limit: int = 256) -> tuple[DataFrame | None, int]:
        """(a page, total of all hits); limit 0 gives no page. Far pages of everything go by the stored order, which
        the first page of a large catalogue writes ahead."""
        self._ready(uid)
        hits = self.catalogue.search(uid, query, device_ids)
        total = hits.count()
        if limit <= 0:
            return None, total
        if not query.split() and not device_ids:
            if offset >= FAR or (total >= WARM and offset >= total / 4):
                return self.catalogue.page_over_devices(uid, sort, direction, offset, limit), total
            if offset == 0 and total >= WARM:
                self.catalogue.global_order(uid, sort)
        return search.page(hits, sort, direction, offset, limit), total

    def pages(self, uid: int, query: str = "", **options) -> search.Pages:
        _, total = self.search(uid, query, options.get("device_ids"), limit=0)
        return search.Pages(lambda offset, limit: self.search(uid, query, **options, offset=offset, limit=limit)[0], total)

    def resolve_directories(self, uid: int, ids: DataFrame) -> DataFrame:
        return paths.resolve_directories(ids, self.catalogue.dirs(uid), self.known(), uid)

    def resolve_entries(self, uid: int, ids: DataFrame) -> DataFrame:
        return paths.resolve_entries(ids, self.catalogue.records(uid), self.catalogue.dirs(uid), self.catalogue.latest(uid), self.known(), uid)

    def forget_index(self, uid: int, device_id: str) -> bool:
        """Removes an index; again is no error, while a job runs it is one."""
        if self._running(uid, device_id):
            raise RuntimeError("an indexing job is running for this device; cancel it first")
        if gone := self.catalogue.forget(uid, device_id):
            self.events("DeviceIndexRemoved", {"device_id": device_id})
        return gone

    def set_watch_enabled(self, uid: int, device_id: str, enabled: bool) -> None:
        self.catalogue.set_watch_enabled(uid, device_id, enabled)

    def apply_touches(self, uid: int, device_id: str, batch: DataFrame) -> bool:
        """Applies a batch where all of it is safe; False asks for a rescan."""
        batch = batch.where((F.col("uid") == uid) & (F.col("device_id") == device_id))
        there = self.known().select("device_id", "primary_mount_point")
        changed, reasons = watch.upsert(self.catalogue.records(uid, [device_id]), batch, there, folders=self.catalogue.dirs(uid, [device_id]))
        counts = watch.batch_counts(reasons).first()
        if counts is None or counts["unsafe"] or not counts["updated"]:
            return False
        generation = self.catalogue.apply(uid, device_id, changed)
        self.events("DeviceIndexUpdated", {"device_id": device_id, "generation": generation})
        return True

    def scope_list(self, uid: int) -> DataFrame:
        return devices.scope_list(self.list_indexed_devices(uid), self.known())
