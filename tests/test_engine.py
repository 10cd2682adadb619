"""The persisted catalogue, the engine's methods, and watch state on timers, as stream and as table."""

import json
import random
import subprocess
import sys
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.functions import text
from lodestone.operators import paths, search
from lodestone.plans import store
from lodestone.shared import new_path
from lodestone.streaming import timers, watch

PLAIN = "record_idx long, parent_idx long, name string, size long, mtime long, is_dir boolean, is_symlink boolean"
ROWS = [(0, None, "Docs", 0, 5, True, False), (1, 0, "b.txt", 30, 1, False, False), (2, 0, "A.txt", 10, 2, False, False), (3, None, "é.md", 20, 3, False, False)]
KNOWN = "device_id string, mounted boolean, primary_mount_point string, label string, fs_type string, uuid string"


@pytest.fixture
def catalogue(spark):
    return store.Catalogue(spark, new_path(spark, "cat"))


def rows(spark, data=ROWS):
    return spark.createDataFrame(data, PLAIN)


def test_shared_folder_of_a_session_without_one():
    """A local session that names no folder gets one, the same each time, and its settings stay as they are."""
    code = """
from pyspark.sql import SparkSession
from lodestone.shared import shared_dir, written
s = SparkSession.builder.master("local").config("spark.ui.enabled", "false").getOrCreate()
a = shared_dir(s)
assert a == shared_dir(s) and a.startswith("file://") and s.conf.get("spark.checkpoint.dir", None) is None
assert written(s.range(3), "t").count() == 3
print("fine")
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr[-2000:]


def test_generations(spark, catalogue):
    assert catalogue.epoch() == 0 and catalogue.latest(1).count() == 0 and catalogue.records(1).count() == 0
    assert catalogue.write(rows(spark), 1, "d", "ext4", "Lab", "u", 77) == 1
    assert catalogue.write(rows(spark, ROWS[:3]), 1, "d") == 2
    catalogue.write(rows(spark), 2, "d", "ntfs")
    row = catalogue.latest(1).first()
    assert (row.generation, row.entry_count, row.fs_type, row.label, row.watch_enabled) == (2, 3, "ext4", "Lab", True)
    assert sorted(r.name for r in catalogue.records(1).collect()) == ["A.txt", "Docs", "b.txt"] and catalogue.records(2).count() == 4
    before = catalogue.epoch()
    for bad in (rows(spark, []), rows(spark, [(0, None, None, 0, 0, False, False)])):
        with pytest.raises(ValueError):
            catalogue.write(bad, 1, "d")
    assert catalogue.epoch() == before and catalogue.records(1).count() == 3
    with pytest.raises(store.TakenError):  # another writer was first
        catalogue.commit(before - 1, uid=1, device_id="d", generation=9)
    catalogue.set_watch_enabled(1, "d", False)
    assert catalogue.epoch() == before + 1 and not catalogue.latest(1).first().watch_enabled
    catalogue.set_watch_enabled(1, "d", False)
    assert catalogue.epoch() == before + 1
    assert catalogue.forget(1, "d") and not catalogue.forget(1, "d") and catalogue.records(1).count() == 0 and catalogue.records(2).count() == 4


def test_damaged_devices_are_skipped(spark, catalogue):
    catalogue.write(rows(spark), 1, "good")
    catalogue.write(rows(spark), 1, "bad")
    path = catalogue._one(1, "bad")["path"]
    files, at, _ = catalogue._files()
    files.delete(at(f"{path}/records/_SUCCESS"), False)
    good, bad = catalogue.load(1)
    assert [r.device_id for r in good] == ["good"] and bad == ["bad"]
    assert {r.device_id for r in catalogue.records(1).collect()} == {"good"}


def test_upgrade_of_older_formats(spark, catalogue):
    catalogue.write(rows(spark), 1, "d")
    row = catalogue._one(1, "d").asDict()
    catalogue.commit(**row | {"number": catalogue.epoch() + 1, "format": 3})
    assert catalogue.upgrade(1) == ["d"] and catalogue.upgrade(1) == [] and catalogue._one(1, "d")["format"] == store.FORMAT
    assert all(catalogue.order(1, k).count() == 4 for k in search.KEYS)


def test_stored_orders(spark, catalogue):
    rng = random.Random(4)
    for d in ("x", "y"):
        catalogue.write(rows(spark, [(k, rng.choice([None, 1]), f"n{rng.randint(0, 30)}", rng.randint(0, 9), k, False, False) for k in range(60)]), 1, d)
    every = catalogue.records(1)
    for key in search.KEYS:
        for way in ("asc", "desc"):
            want = [(r.device_id, r.record_idx) for r in search.page(every, key, way, 0, 200).orderBy("pos").collect()]
            got = [(r.device_id, r.record_idx) for o in range(0, 120, 32) for r in catalogue.page_over_devices(1, key, way, o, 32).orderBy("pos").collect()]
            assert got == want
            own = [r.record_idx for r in search.page(every.where("device_id = 'y'"), key, way, 0, 200).orderBy("pos").collect()]
            assert own == [r.record_idx for o in range(0, 60, 25) for r in catalogue.page_by_stored_rank(1, "y", key, way, o, 25).orderBy("pos").collect()]
    plan = catalogue.page_by_stored_rank(1, "y", "size", "asc", 10, 5)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(rank,10), LessThan(rank,15)" in plan  # the scan takes the range
    for q in ("n1", "n", "N2", "1 n", "zzz", "n12"):
        assert {(r.device_id, r.record_idx) for r in catalogue.search(1, q, indexed=True).collect()} == {(r.device_id, r.record_idx) for r in catalogue.search(1, q).collect()}


def test_engine(spark, catalogue):
    said = []
    there = spark.createDataFrame([("d", True, "/mnt/d", "Data", "ext4", "u")], KNOWN)
    e = Engine(spark, catalogue, lambda: there, lambda n, x: said.append((n, x.get("status"))))
    assert e.ping() and e.list_known_devices().count() == 1
    assert e.start_index(1, "d", lambda: rows(spark), auto=True) == 0  # nothing is indexed yet
    one = e.start_index(1, "d", lambda: rows(spark))
    assert e.jobs[one].status == "ok" and said[-1] == ("JobFinished", "ok")
    assert e.jobs[e.start_index(1, "nope", lambda: rows(spark))].message == "unknown device"
    assert e.jobs[e.start_index(1, "d", lambda: rows(spark, []))].status == "error"
    assert e.start_index(1, "d", lambda: rows(spark), auto=True) > 0
    e.set_watch_enabled(1, "d", False)
    assert e.start_index(1, "d", lambda: rows(spark), auto=True) == 0
    assert [r.name for r in e.search(1, ".TXT", sort="size")[0].orderBy("pos").collect()] == ["A.txt", "b.txt"]
    assert e.search(1, "", limit=0) == (None, 4) and e.search(2, "")[1] == 0
    assert [r.name for r in e.pages(1)] == ["A.txt", "b.txt", "Docs", "é.md"]
    ids = spark.createDataFrame([(0, 1), (1, 3), (2, 99)], "pos long, record_idx long").select("pos", text.entry_id(F.lit("d"), F.col("record_idx")).alias("entry_id"))
    got = e.resolve_entries(1, ids).orderBy("pos").collect()
    assert [(r.internal_path, r.display_path, r.mounted) for r in got] == [("/Docs/b.txt", "/mnt/d/Docs/b.txt", True), ("/é.md", "/mnt/d/é.md", True), ("", "", False)]
    dirs = e.resolve_directories(1, spark.createDataFrame([("d", 0), ("d", None), ("d", 7)], "device_id string, dir_id long")).collect()
    assert {(r.path, r.shown) for r in dirs} == {("/Docs", "/mnt/d/Docs"), ("/", "/mnt/d"), ("…", "/mnt/d…")}
    e.jobs[99] = type(e.jobs[one])(99, 1, "d")
    with pytest.raises(RuntimeError):
        e.forget_index(1, "d")
    assert e.jobs[e.start_index(1, "d", lambda: rows(spark))].status == "error"
    assert not e.cancel_job(2, 99) and e.cancel_job(1, 99) and not e.cancel_job(1, 99)
    e.jobs[99].state = "running"
    for line in ("X_PROGRESS 7", "noise", "X_PROGRESS 7", "X_PROGRESS 250"):
        e.report(99, line)
    assert e.jobs[99].percent == 100 and [n for n, _ in said[-2:]] == ["JobProgress"] * 2
    del e.jobs[99]
    assert e.forget_index(1, "d") and not e.forget_index(1, "d") and said[-1][0] == "DeviceIndexRemoved"


def test_far_pages_by_the_stored_order(spark, catalogue, monkeypatch):
    import lodestone.api as api

    monkeypatch.setattr(api, "FAR", 3)
    monkeypatch.setattr(api, "WARM", 4)
    catalogue.write(rows(spark), 1, "d")
    e = Engine(spark, catalogue, lambda: spark.createDataFrame([], KNOWN))
    every = [r.name for o in range(4) for r in e.search(1, "", sort="size", direction="desc", offset=o, limit=1)[0].collect()]
    assert every == ["b.txt", "é.md", "A.txt", "Docs"]


ITEM = "uid long, device_id string, seq long, name string, handle_hex string, parent_path string, size long, mtime long, mode int"
HANDLE = "0400000001000000aabbccdd"


def test_touches_change_one_users_device(spark, catalogue):
    there = spark.createDataFrame([("d", True, "/mnt/d", "Data", "ext4", "u")], KNOWN)
    e = Engine(spark, catalogue, lambda: there)
    for uid in (1, 2):
        e.start_index(uid, "d", lambda: rows(spark))
    item = (1, "d", 1, "A.txt", HANDLE, "/mnt/d/Docs", 99, 50, 0xA1FF)
    assert not e.apply_touches(1, "d", spark.createDataFrame([item, (1, "d", 2, "new", HANDLE, "/mnt/d", 1, 1, 0x8000)], ITEM))
    assert e.apply_touches(1, "d", spark.createDataFrame([item, (1, "d", 2, "é.md", HANDLE, "/mnt/d/", 5, 6, 0x4000)], ITEM))
    got = {r.name: r for r in e.catalogue.records(1).collect()}
    assert (got["A.txt"].size, got["A.txt"].mtime, got["A.txt"].is_symlink) == (99, 50, True) and got["é.md"].is_dir and got["b.txt"].size == 30
    assert {r.name: r.size for r in e.catalogue.records(2).collect()}["A.txt"] == 10
    order = [r.name for r in e.catalogue.page_by_stored_rank(1, "d", "size", "desc", 0, 2).orderBy("pos").collect()]
    assert order == ["A.txt", "b.txt"]  # ranks hold for the new sizes


def test_root_children_of_both_kinds(spark):
    both = spark.createDataFrame([(1, "n", 5, 5, "", 0, 0, True, False), (1, "n", 6, 5, "top", 1, 1, False, False), (1, "e", 7, None, "top", 1, 1, False, False)], "uid long, device_id string, " + PLAIN).withColumn("name_lc", F.col("name"))
    mounts = spark.createDataFrame([("n", "/m/n"), ("e", "/m/e")], "device_id string, primary_mount_point string")
    batch = spark.createDataFrame([(1, d, 1, "top", HANDLE, f"/m/{d}", 8, 8, 0x8000) for d in "ne"], ITEM)
    assert {(r.reason, r.target) for r in watch.judged(both, batch, mounts).collect()} == {("", 6), ("", 7)}


def test_two_users_entries(spark):
    data = [(u, "d", i, p, n, 0, 0, i == 0, False) for u, names in ((1, ("a", "x")), (2, ("b", "y"))) for i, (p, n) in enumerate(zip((None, 0), names))]
    r = spark.createDataFrame(data, "uid long, device_id string, " + PLAIN)
    ids = spark.createDataFrame([(0, 1)], "pos long, k long").select("pos", text.entry_id(F.lit("d"), F.col("k")).alias("entry_id"))
    own = spark.createDataFrame([(1, "d", ""), (2, "d", "")], "uid long, device_id string, label string")
    none = spark.createDataFrame([], KNOWN)
    for uid, want in ((1, "/a/x"), (2, "/b/y")):
        got = paths.resolve_entries(ids, r, paths.directory_paths(r), own, none, uid).collect()
        assert [(x.internal_path, x.display_path) for x in got] == [(want, "[d]" + want)]


def test_colliding_hashes_keep_the_device_that_has_the_record(spark, monkeypatch):
    monkeypatch.setattr(paths, "fnv32", lambda c: F.lit(5).cast("long"))
    r = spark.createDataFrame([(1, "b", 3, None, "x", 0, 0, False, False)], "uid long, device_id string, " + PLAIN)
    own = spark.createDataFrame([(1, "a", ""), (1, "b", "")], "uid long, device_id string, label string")
    ids = spark.createDataFrame([(0, Decimal(5 * 2**32 + 3)), (1, Decimal(5 * 2**32 + 4))], "pos long, entry_id decimal(20,0)")
    got = {x.pos: (x.device_id, x.name) for x in paths.resolve_entries(ids, r, paths.directory_paths(r), own, spark.createDataFrame([], KNOWN), 1).collect()}
    assert got == {0: ("b", "x"), 1: ("", "")}


def test_pages_model():
    asked = []

    class Rows:
        def __init__(self, o, n):
            self.x = [{"pos": k} for k in range(o, min(o + n, 1000))]

        def collect(self):
            return self.x

    def fetch(o, n):
        asked.append((o, n))
        return Rows(o, n)

    p = search.Pages(fetch, 1000)
    assert p.row(300)["pos"] == 300 and asked == [(0, 768)] and p.row(10)["pos"] == 10 and len(asked) == 1
    assert p.row(999)["pos"] == 999 and p.row(2000) is None
    assert [r["pos"] for r in p] == list(range(1000))
    p.reset(fetch, 0)
    assert p.row(0) is None


def test_display_edges(spark):
    got = spark.createDataFrame([(-(10**13),), (-(10**12),), (0,), (2**63 - 1,), (253402300799,), (None,)], "s long").select(text.display_time(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["out-of-range", "out-of-range", "1970-01-01 00:00:00", "invalid-time", "9999-12-31 23:59:59", None]
    ticks = spark.createDataFrame([(116444736000000000 + 10_000_000 * k - 1,) for k in (1, 9 * 10**10)], "t long").select(text.unix_from_filetime(F.col("t")).alias("s")).collect()
    assert [r.s for r in ticks] == [0, 9 * 10**10 - 1]


MACHINES = {"debounce": timers.Debounce(), "quiet": timers.Quiet(), "overflow": timers.Overflow(), "notify": timers.Notify(), "arm": timers.Arm()}


def events_of(seed, n=60):
    rng, at, out = random.Random(seed), 1_700_000_000_000, []
    for _ in range(n):
        at += rng.choice([1, 40, 100, 240, 260, 900, 3000, 15_000, 40_000])
        kind = rng.choice(["touch", "touch", "overflow", "unsafe", "update", "refused", "started", "target", "armed", "failed"])
        detail = {
            "touch": {"fsid": "f", "handle": rng.choice(["h", ""]), "name": rng.choice("ab"), "mask": rng.choice([1, 2, 4])}, "update": {"generation": at % 97}, "target": {"mount": rng.choice(["/a", "/b", ""]), "wanted": rng.random() < 0.8},
            "failed": {"error": "x", "permanent": rng.random() < 0.3}, "armed": {"mode": "names"},
        }.get(kind, {})
        out.append((1, rng.choice(["d", "e"]), at, kind, json.dumps(detail)))
    return out


def test_machines_by_hand():
    t = 1000
    run = lambda m, ev: timers.stepped(m, s, ev)
    s = {}
    touch = json.dumps({"fsid": "f", "handle": "h", "name": "n", "mask": 2})
    assert run(MACHINES["debounce"], [(t, "touch", touch), (t + 249, "touch", touch.replace("2", "1"))]) == [] and s["due"] == t + 499
    assert json.loads(timers.fired(MACHINES["debounce"], s)[0][2]) == {"touched": [["f", "h", "n", 3]], "overflow": False}
    s = {}
    run(MACHINES["debounce"], [(t + k * 200, "touch", "{}") for k in range(25)])
    assert s["due"] == t + timers.MAX_BATCH_MS  # a steady stream doesn't hold a batch back forever
    assert json.loads(timers.fired(MACHINES["debounce"], s)[0][2])["touched"] == [["", "", "*", 1]]
    s = {}
    run(MACHINES["overflow"], [(t, "overflow", ""), (t + 1, "overflow", "")])
    assert s["due"] == t + 10_000
    assert run(MACHINES["overflow"], [(t + 10_001, "refused", "")]) and s["due"] == t + 30_001 and s["fails"] == 1
    s = {}
    assert run(MACHINES["notify"], [(t, "update", '{"g": 1}'), (t + 249, "update", '{"g": 2}'), (t + 250, "update", '{"g": 3}')]) == [(t + 250, "notification", '{"g": 2}')]
    s = {}
    out = run(MACHINES["arm"], [(t, "target", '{"mount": "/a"}'), (t + 1, "failed", '{"error": "x"}'), (t + 2, "target", '{"mount": "/a"}')])
    assert [k for _, k, _ in out] == ["arm", "state"] and s["due"] == t + 30_001
    assert [k for _, k, _ in run(MACHINES["arm"], [(t + 40_000, "armed", "{}")])] == ["arm", "state"] and s["state"] == "watching"
    assert json.loads(run(MACHINES["arm"], [(t + 50_000, "target", "{}")])[0][2]) == {"state": "notMounted"}
    assert timers.rescan_allowed(True, True, False) and not timers.rescan_allowed(True, True, True) and not timers.rescan_allowed(True, False, False)


@pytest.mark.parametrize("name", sorted(MACHINES))
def test_stream_equals_replay(spark, tmp_path, name):
    """The machine as a stream over files, in two batches, gives what it gives over the table."""
    machine, data = MACHINES[name], events_of(name)
    frame = lambda x: spark.createDataFrame(x, "uid long, device_id string, ms long, kind string, detail string").select("uid", "device_id", F.timestamp_millis("ms").alias("ts"), "kind", "detail")
    want = sorted(map(tuple, timers.replayed(frame(data), machine).collect()))
    assert want
    last = data[-1][2]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = tmp_path / "in"
        src.mkdir()
        stream = spark.readStream.schema(timers.EVENT).option("maxFilesPerTrigger", 1).parquet(str(src))
        query = timers.streamed(stream, machine, "0 seconds").writeStream.outputMode("append").format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "cp")).start()
        # Far events of no kind move the watermark on, so that all timers run out.
        far = [(9, "z", last + k * 10_000_000, "none", "{}") for k in range(1, 3)]
        for k, part in enumerate((data[:30], data[30:], *[[x] for x in far])):
            frame(part).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(src / f"{k}-{f.name}")
            time.sleep(0.05)
            query.processAllAvailable()
        got = sorted(map(tuple, spark.sql(f"SELECT * FROM out_{name}").collect()))
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == want
