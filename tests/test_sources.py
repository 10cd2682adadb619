"""Binary sources over images and files that the tests write, with everything that must be rejected."""

import os
import random
import shutil
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.operators import filesystems
from lodestone.sources import images, machine, recordfiles
from lodestone.streaming import watch

RECORDS = [
    {"name": "", "parent_idx": None, "size": 0, "mtime": 0, "is_dir": True, "is_symlink": False}, {"name": "Café.txt", "parent_idx": 0, "size": 7, "mtime": 9, "is_dir": False, "is_symlink": False},
    {"name": b"bad\xff", "parent_idx": None, "size": 2**40, "mtime": 1, "is_dir": False, "is_symlink": True}, {"name": "x" * 300, "parent_idx": 0, "size": 1, "mtime": 2**33, "is_dir": False, "is_symlink": False},
]


def plain(rows):
    return sorted((r.record_idx, r.parent_idx, bytes(r.name_raw) if r.name_raw is not None else r.name, r.size, r.mtime, r.is_dir, r.is_symlink) for r in rows)


WANT = [(k, r["parent_idx"], r["name"], r["size"], r["mtime"], r["is_dir"], r["is_symlink"]) for k, r in enumerate(RECORDS)]


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_blob_round_trip(spark, tmp_path, rows):
    recordfiles.register(spark)
    path = tmp_path / "blob"
    path.write_bytes(recordfiles.blob_bytes(RECORDS))
    df = spark.read.format("record_blob").option("uid", 5).option("device_id", "d").option("rows", rows).load(str(path))
    got = df.collect()
    assert plain(got) == WANT and {(r.uid, r.device_id) for r in got} == {(5, "d")}
    assert df.rdd.getNumPartitions() == -(-4 // rows)


def test_blob_rejects(spark, tmp_path):
    recordfiles.register(spark)
    good = recordfiles.blob_bytes(RECORDS)
    past = bytearray(good)
    past[8 + 20 : 8 + 24] = struct.pack("<I", 10**6)
    big = struct.pack("<Q", 10**9) + good[8:]
    for k, data in enumerate((b"", good[:4], good[:40], good[:-1], struct.pack("<QQ", 0, 0), big, struct.pack("<Q", 1) + bytes(27) + struct.pack("<Q", 0))):
        (tmp_path / str(k)).write_bytes(data)
        with pytest.raises(ValueError):
            recordfiles.blob_header(str(tmp_path / str(k)))
    (tmp_path / "past").write_bytes(bytes(past))
    with pytest.raises(Exception, match="outside the pool"):
        spark.read.format("record_blob").load(str(tmp_path / "past")).collect()


def test_snapshots(spark, tmp_path):
    for v in range(1, 6):
        path = recordfiles.snapshot_path(str(tmp_path), 7, f"dev{v}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(recordfiles.snapshot_bytes(RECORDS, f"dev{v}", "ntfs", "Lab", "uu", 3, 99, False, v))
    data = recordfiles.snapshot_bytes(RECORDS, "dev", version=5)
    (tmp_path / "7" / "cut.kix").write_bytes(data[:-3])
    (tmp_path / "7" / "magic.kix").write_bytes(b"x" + data[1:])
    (tmp_path / "7" / "six.kix").write_bytes(data[:8] + struct.pack("<I", 6) + data[12:])
    good, bad = recordfiles.load_snapshots(spark, [str(p) for p in (tmp_path / "7").iterdir()], 7)
    assert len(bad) == 3 and len(good) == 5
    for head, df in good:
        v = head.version
        assert plain(df.collect()) == WANT and head.generation == 3
        assert head.label == ("Lab" if v >= 3 else "") and head.last_indexed_time == (99 if v >= 2 else 0) and head.watch_enabled == (v < 5)


def attribute(kind, body, name_len=0, resident=True):
    if resident:
        size = -(-(24 + len(body)) // 8) * 8
        return struct.pack("<IIBBHHHIHBB", kind, size, 0, name_len, 0, 0, 0, len(body), 24, 0, 0) + body + bytes(size - 24 - len(body))
    return None


def file_name(name, parent, space, changed, size=0, flags=0, tag=0):
    raw = name if isinstance(name, bytes) else name.encode("utf-16-le")
    return attribute(0x30, struct.pack("<7QIIBB", parent | 5 << 48, 0, changed, 0, 0, 0, size, flags, tag, len(raw) // 2, space) + raw)


def nonresident(size, runs):
    body = struct.pack("<QQHHIQQQ", 0, 0, 64, 0, 0, 0, size, 0) + runs + b"\0"
    total = -(-(16 + len(body)) // 8) * 8
    return struct.pack("<IIBBHHH", 0x80, total, 1, 0, 0, 0, 0) + body + bytes(total - 16 - len(body))


def mft_record(attrs, flags=1, base=0, size=1024):
    body = b"".join(attrs) + struct.pack("<II", 0xFFFFFFFF, 0)
    used = 56 + len(body)
    raw = bytearray(struct.pack("<4sHHQHHHHIIQH", b"FILE", 48, 3, 0, 1, 1, 56, flags, used, size, base, 0).ljust(56, b"\0") + body).ljust(size, b"\0")
    mark = b"\x07\x00"
    raw[48:50] = mark
    for k in (1, 2):
        raw[48 + 2 * k : 50 + 2 * k] = raw[512 * k - 2 : 512 * k]
        raw[512 * k - 2 : 512 * k] = mark
    return bytes(raw)


EPOCH = 116444736000000000


def ntfs_image(path):
    """Two fragments of a table: the second lies before the first on the disk."""
    cluster = 4096
    by_index = {
        5: mft_record([file_name(".", 5, 3, EPOCH + 50_000_000)], 3), 38: mft_record([file_name("$Hidden", 5, 3, 0)]), 39: mft_record([file_name("$Shown", 5, 3, 0, size=9)]),
        40: mft_record([file_name("Dir", 5, 1, EPOCH + 10_000_000)], 3),
        41: mft_record([file_name("LONGNA~1.TXT", 40, 2, EPOCH), file_name("long name é.txt", 40, 1, EPOCH + 20_000_000), attribute(0x80, b"hello")]),
        42: mft_record([file_name("one", 40, 1, EPOCH + 1), file_name("two", 5, 1, EPOCH + 30_000_000), nonresident(12345, b"\x11\x01\x02")]),
        43: mft_record([attribute(0x20, b"list")]), 44: mft_record([file_name("split", 40, 0, EPOCH + 40_000_000), attribute(0x80, b"abc")], 1, base=43 | 9 << 48),
        45: mft_record([file_name("gone", 5, 1, 0)], 0), 46: mft_record([file_name("link", 5, 1, EPOCH, flags=0x400, tag=0xA000000C)]), 47: mft_record([file_name(b"\x00\xd8x\x00", 5, 0, EPOCH)]),
        48: b"BAAD" + mft_record([])[4:], 49: mft_record([attribute(0x80, b"xy", name_len=3), file_name("stream", 99, 3, EPOCH, size=77)]),
    }
    by_index[0] = mft_record([file_name("$MFT", 5, 3, 0), nonresident(64 * 1024, bytes([0x11, 8, 40, 0x11, 8, 256 - 20]))])
    image = bytearray(60 * cluster)
    image[0:512] = (b"\xeb\x52\x90NTFS    " + struct.pack("<HB", 512, 8)).ljust(48, b"\0") + struct.pack("<QQb", 40, 0, -10) + bytes(512 - 65)
    for i, r in by_index.items():
        vcn, inside = divmod(i * 1024, cluster)
        lcn = 40 + vcn if vcn < 8 else 20 + vcn - 8
        image[lcn * cluster + inside : lcn * cluster + inside + 1024] = r
    with open(path, "wb") as f:
        f.write(image)


@pytest.mark.parametrize("step", [1024, 1 << 20])
def test_ntfs_image(spark, tmp_path, step):
    images.register(spark)
    path = str(tmp_path / "ntfs")
    ntfs_image(path)
    mft = spark.read.format("ntfs_mft").option("image", "true").option("slice", step).load(path)
    rows = {r.name: r for r in filesystems.ntfs_records(mft).collect()}
    assert set(rows) == {"", "$Shown", "Dir", "long name é.txt", "one", "two", "split", "link", "Invalid UTF-16 Data", "stream"}
    root, folder = rows[""], rows["Dir"]
    assert root.parent_idx == root.record_idx and folder.parent_idx == root.record_idx and folder.is_dir and folder.mtime == 1
    assert (rows["long name é.txt"].size, rows["long name é.txt"].mtime, rows["long name é.txt"].parent_idx) == (5, 2, folder.record_idx)
    assert rows["one"].size == rows["two"].size == 12345 and rows["one"].mtime == rows["two"].mtime == 3 and rows["two"].parent_idx == root.record_idx
    assert (rows["split"].size, rows["split"].mtime) == (3, 4) and rows["link"].is_symlink and rows["stream"].size == 77 and rows["stream"].parent_idx is None
    assert not any(r.is_symlink for r in filesystems.ntfs_records(mft, compat=True).collect())


def test_ntfs_rejects(spark, tmp_path):
    with pytest.raises(ValueError):
        images.boot(bytes(512))
    for path in ("dev/x", "/tmp/x", "/dev/../tmp/x", "/dev/null", "/dev/zero"):
        with pytest.raises((ValueError, OSError)):
            images.checked_device(path)
    raw = mft_record([file_name("a", 5, 1, 0)])
    torn = bytearray(raw)
    torn[510:512] = b"\x09\x09"
    assert images.fixed(bytearray(torn))[510:512] == b"\x09\x09"  # the sector stays as it is
    assert images.mft_row(raw[:24] + struct.pack("<I", 60) + raw[28:], 7)[6] == []  # nothing beyond the used part
    assert images.runs(bytes([0x21, 3, 0, 1, 0x11, 2, 0xFE, 0])) == [(0, 256, 3), (3, 254, 2)]


def test_many_names_of_one_file(spark):
    """More names than any fixed width of a number would hold stay apart from the next file's."""
    names = [(f"n{k}", 5, 1, EPOCH, 0) for k in range(1500)]
    mft = spark.createDataFrame([(9, 9, False, False, True, 1, names), (10, 10, False, False, True, 2, [("o", 5, 1, EPOCH, 0)])], images.MFT_SCHEMA)
    got = filesystems.ntfs_records(mft).collect()
    assert len({r.record_idx for r in got}) == 1501


@pytest.mark.skipif(not shutil.which("mke2fs"), reason="needs mke2fs")
@pytest.mark.parametrize("options", [["-t", "ext4", "-b", "1024"], ["-t", "ext4", "-I", "256", "-O", "64bit"], ["-t", "ext2", "-b", "1024"]])
def test_ext4_image(spark, tmp_path, options):
    images.register(spark)
    tree = tmp_path / "tree"
    rng = random.Random(2)
    for k in range(400):
        folder = tree / f"d{k % 7}" / (f"e{k % 3}" if k % 2 else "")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"file-{k}-é{'x' * rng.randint(0, 60)}").write_bytes(b"z" * rng.randint(0, 5000))
    (tree / "link").symlink_to("d1")
    os.link(tree / "d1" / "e1" / next(iter(os.listdir(tree / "d1" / "e1"))), tree / "hard")
    image = str(tmp_path / "image")
    subprocess.run(["mke2fs", "-q", "-d", str(tree), *options, image, "16m"], check=True, capture_output=True)
    raw = spark.read.format("ext4_inodes").option("image", "true").option("groups", 1).load(image).cache()
    inodes = raw.where("kind = 'inode'").select("ino", "links_count", "size", "mtime", "mode")
    got = filesystems.ext4_records(inodes, raw.where("kind = 'dirent'").select("ino", "dir_ino", "name", "scan_seq")).collect()
    want = {}
    for at, folders, files in os.walk(tree):
        for n in [*folders, *files]:
            s = os.lstat(os.path.join(at, n))
            want.setdefault(s.st_ino, []).append((n, s))
    by_name = {r.name: r for r in got}
    assert by_name[""].is_dir and by_name[""].parent_idx is None
    for entries in want.values():
        found = [by_name[n] for n, _ in entries if n in by_name]
        assert len(found) == 1  # one record an inode, whichever of its names comes last
        n, s = next(e for e in entries if e[0] in by_name)
        assert found[0].is_dir == os.path.stat.S_ISDIR(s.st_mode) and found[0].is_symlink == os.path.stat.S_ISLNK(s.st_mode) and found[0].mtime == int(s.st_mtime)
        assert found[0].is_dir or found[0].size == s.st_size
    assert len(got) == len(want) + 2  # the root and lost+found
    ids = {r.record_idx: r for r in got}
    inner = next(r for r in got if r.name == "e1" and ids[r.parent_idx].name == "d1")
    assert ids[inner.parent_idx].parent_idx is None


def event(mask, *records):
    body = b"".join(records)
    return struct.pack("<IBBHQii", 24 + len(body), 3, 0, 24, mask, -1, 0) + body


def named(name, handle=b"abcd", kind=2, cut=0):
    body = b"FSIDFSID" + struct.pack("<Ii", len(handle), 1) + handle + name + b"\0"
    size = 4 + len(body) - cut
    return struct.pack("<BBH", kind, 0, size) + body[: len(body) - cut]


def test_watch_events(spark):
    whole = b"FSIDFSID".hex()
    handle = (struct.pack("<Ii", 4, 1) + b"abcd").hex()
    data = event(0x100, named(b"new.txt")) + event(0x4000) + event(2, named(b"x", kind=1)) + event(8, named(b"a"), named(b"\xff"))
    assert machine.watch_events(data) == [(False, whole, handle, "new.txt", 256), (True, "", "", "", 0x4000), (False, "", "", "", 2), (False, whole, handle, "a", 8), (False, whole, handle, "\ufffd", 8)]
    assert machine.watch_events(data[:30]) == [] and machine.watch_events(event(1, named(b"x", cut=6))) == [(False, "", "", "", 1)]
    torn = event(1, struct.pack("<BBH", 2, 0, 999))
    assert machine.watch_events(torn + torn[:10]) == [(False, "", "", "", 1)]
    df = spark.createDataFrame([(1, "d", data), (2, "e", None)], "uid long, device_id string, data binary").withColumn("ts", F.current_timestamp())
    got = machine.decoded_events(df).collect()
    assert len(got) == 5 and {r.uid for r in got} == {1}
    batch = watch.tokens_of(machine.decoded_events(df)).collect()
    assert len(batch) == 1 and batch[0].overflow and [t.name for t in batch[0].touched] == ["a", "new.txt", "\ufffd"]


def test_machine_sources(spark, tmp_path):
    (tmp_path / "node").write_bytes(b"")
    for folder, name in (("p", "AB-1"), ("u", "U2"), ("u", "U1")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).symlink_to(tmp_path / "node")
    (tmp_path / "u" / "broken").symlink_to(tmp_path / "nothing")
    node = str(tmp_path / "node")
    (tmp_path / "mountinfo").write_text(f"36 35 98:0 / /mnt/x rw - ext4 {node} rw\nbroken\n")
    number = os.stat(node).st_rdev
    (tmp_path / f"b{os.major(number)}:{os.minor(number)}").write_text("S:disk\nE:ID_FS_TYPE=EXT4\nE:ID_FS_LABEL=Data\n")
    r = machine.known_devices(spark, f"{tmp_path}/p", f"{tmp_path}/u", f"{tmp_path}/mountinfo", str(tmp_path)).collect()
    assert [(x.device_id, x.dev_node, x.uuid, x.fs_type, x.label, x.mounted, x.primary_mount_point) for x in r] == [("partuuid:ab-1", node, "u1", "ext4", "Data", True, "/mnt/x")]
    assert machine.known_devices(spark, f"{tmp_path}/none", f"{tmp_path}/none", f"{tmp_path}/mountinfo").count() == 0
