"""Record files as Spark sources: the scanner's blob (records and a pool of names) and snapshots of whole indexes.

Both hold packed records of 27 bytes and a pool of names; a reader's partitions are slices of the records, each with
the part of the pool that its names lie in. All integers are little-endian.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the formats: the record's layout, the root's parent, the snapshot's magic number, and limits.
LAYOUT = np.dtype([("parent", "<u4"), ("size", "<u8"), ("mtime", "<u8"), ("name_at", "<u4"), ("name_len", "<u2"), ("flags", "u1")])
NO_PARENT, MAGIC, VERSIONS = 0xFFFFFFFF, 0x4B4552595448494E, range(1, 6)
MAX_RECORDS, MAX_POOL, MAX_POSTINGS, MAX_TEXT, MAX_KIND = 500_000_000, 8 << 30, 2_000_000_000, 4096, 256
SCHEMA = "uid bigint, device_id string, record_idx bigint, parent_idx bigint, name string, name_raw binary, size bigint, mtime bigint, is_dir boolean, is_symlink boolean"
SLICE = 500_000


def opened(path: str):
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


@dataclass
class Header:
    device_id: str
    fs_type: str
    label: str
    uuid: str
    generation: int
    last_indexed_time: int
    watch_enabled: bool
    version: int
    count: int
    records_at: int
    pool_at: int
    pool_size: int


class _Cursor:
    def __init__(self, f):
        self.f, self.at, self.size = f, 0, f.size()

    def take(self, n: int, what: str) -> bytes:
        if n < 0 or self.at + n > self.size:
            raise ValueError(f"the file ends within {what}")
        self.f.seek(self.at)
        self.at += n
        return self.f.read(n)

    def skip(self, n: int, what: str) -> None:
        if self.at + n > self.size:
            raise ValueError(f"the file ends within {what}")
        self.at += n

    def number(self, kind: str, what: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize(kind), what))[0]

    def text(self, most: int, what: str) -> str:
        n = self.number("I", what)
        if n > most:
            raise ValueError(f"{what} has {n} bytes")
        return self.take(n, what).decode("utf-8", "replace")


def _body(c: _Cursor) -> tuple[int, int, int, int]:
    """(records, where they begin, where the pool begins, its size)."""
    n = c.number("Q", "the number of records")
    if not 0 < n <= MAX_RECORDS:
        raise ValueError(f"{n} records")
    at = c.at
    c.skip(n * LAYOUT.itemsize, "the records")
    pool = c.number("Q", "the size of the pool")
    if not 0 < pool <= MAX_POOL:
        raise ValueError(f"a pool of {pool} bytes")
    begin = c.at
    c.skip(pool, "the pool")
    return n, at, begin, pool


def blob_header(path: str) -> Header:
    with opened(path) as f:
        c = _Cursor(f)
        if not c.size:
            raise ValueError("an empty file")
        n, at, pool_at, pool = _body(c)
    return Header("", "", "", "", 0, 0, True, 0, n, at, pool_at, pool)


def snapshot_header(path: str) -> Header:
    """The head of a snapshot of version 1 to 5, with all lengths checked."""
    with opened(path) as f:
        c = _Cursor(f)
        magic, version = c.number("Q", "the magic number"), c.number("I", "the version")
        if magic != MAGIC or version not in VERSIONS:
            raise ValueError("no snapshot, or one of an unknown version")
        device, kind = c.text(MAX_TEXT, "the device"), c.text(MAX_KIND, "the file system")
        label, uuid = (c.text(MAX_TEXT, "the label"), c.text(MAX_TEXT, "the uuid")) if version >= 3 else ("", "")
        generation = c.number("Q", "the generation")
        indexed = c.number("q", "the time") if version >= 2 else 0
        watch = c.number("B", "the watch") != 0 if version >= 5 else True
        n, at, pool_at, pool = _body(c)
        if version >= 4:
            entries = c.number("Q", "the number of postings")
            if entries > MAX_POSTINGS:
                raise ValueError(f"{entries} postings")
            c.skip(8 * entries, "the postings")
            for _ in range(8):
                m = c.number("Q", "the length of an order")
                if m not in (0, n):
                    raise ValueError("an order of another length than the records")
                c.skip(4 * m, "an order")
    return Header(device, kind, label, uuid, generation, indexed, watch, version, n, at, pool_at, pool)


@dataclass
class Slice(InputPartition):
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, header: Header, uid: int, device_id: str, rows: int):
        self.path, self.header, self.uid, self.device_id, self.rows = path, header, uid, device_id, rows

    def partitions(self) -> list[Slice]:
        return [Slice(k, min(self.rows, self.header.count - k)) for k in range(0, self.header.count, self.rows)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        h = self.header
        with opened(self.path) as f:
            f.seek(h.records_at + part.first * LAYOUT.itemsize)
            rows = np.frombuffer(f.read(part.count * LAYOUT.itemsize), LAYOUT)
            low, high = int(rows["name_at"].min()), int((rows["name_at"].astype(np.int64) + rows["name_len"]).max())
            if high > h.pool_size:
                raise ValueError("a name lies outside the pool")
            f.seek(h.pool_at + low)
            pool = f.read(high - low)
        if (rows["size"] >= 2**63).any() or (rows["mtime"] >= 2**63).any():
            raise ValueError("a size or time beyond 63 bits")
        begin = rows["name_at"].astype(np.int64) - low
        raw = [pool[a : a + n] for a, n in zip(begin.tolist(), rows["name_len"].tolist())]
        names = [x.decode("utf-8", "replace") for x in raw]
        odd = [x if n.encode() != x else None for x, n in zip(raw, names)]
        parent = rows["parent"].astype(np.int64)
        n = len(rows)
        columns = [
            pa.array(np.full(n, self.uid)), pa.array([self.device_id or h.device_id] * n, pa.string()), pa.array(np.arange(part.first, part.first + n)), pa.array(parent, mask=parent == NO_PARENT), pa.array(names, pa.string()),
            pa.array(odd, pa.binary()), pa.array(rows["size"].astype(np.int64)), pa.array(rows["mtime"].astype(np.int64)), pa.array((rows["flags"] & 1) > 0), pa.array((rows["flags"] & 2) > 0),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


class BlobSource(DataSource):
    """``spark.read.format("record_blob").option("uid", …).option("device_id", …).load(path)``"""

    header = staticmethod(blob_header)

    @classmethod
    def name(cls) -> str:
        return "record_blob"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        o = self.options
        return _Reader(o["path"], self.header(o["path"]), int(o.get("uid", 0)), o.get("device_id", ""), int(o.get("rows", SLICE)))


class SnapshotSource(BlobSource):
    """``spark.read.format("index_snapshot").option("uid", …).load(path)``; the device's name is in the file."""

    header = staticmethod(snapshot_header)

    @classmethod
    def name(cls) -> str:
        return "index_snapshot"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlobSource)
    spark.dataSource.register(SnapshotSource)


def load_snapshots(spark: SparkSession, paths: Iterable[str], uid: int) -> tuple[list[tuple[Header, DataFrame]], dict[str, str]]:
    """(head and records of each snapshot of a user that is whole, what is wrong with the others by path)."""
    register(spark)
    good, bad = [], {}
    for path in sorted(paths):
        try:
            good.append((snapshot_header(path), spark.read.format("index_snapshot").option("uid", uid).load(path)))
        except (ValueError, OSError) as e:
            bad[path] = str(e)
    return good, bad


def _packed(records: Iterable) -> bytes:
    rows, pool = [], bytearray()
    for r in records:
        raw = r["name"] if isinstance(r["name"], bytes) else r["name"].encode()
        parent = NO_PARENT if r["parent_idx"] is None else r["parent_idx"]
        rows.append((parent, r["size"], r["mtime"], len(pool), len(raw), int(r["is_dir"]) | int(r["is_symlink"]) << 1))
        pool += raw
    return struct.pack("<Q", len(rows)) + np.array(rows, LAYOUT).tobytes() + struct.pack("<Q", len(pool)) + bytes(pool)


def blob_bytes(records: Iterable) -> bytes:
    """A scanner's blob of records (mappings) in the order of their numbers; for devices that fit the driver."""
    return _packed(records)


def snapshot_bytes(records: list, device_id: str, fs_type: str = "", label: str = "", uuid: str = "", generation: int = 1, indexed: int = 0, watch: bool = True, version: int = 5) -> bytes:
    """A snapshot; from version 4 on with postings and orders. For devices that fit the driver."""
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    out = struct.pack("<QI", MAGIC, version) + text(device_id) + text(fs_type)
    if version >= 3:
        out += text(label) + text(uuid)
    out += struct.pack("<Q", generation)
    if version >= 2:
        out += struct.pack("<q", indexed)
    if version >= 5:
        out += struct.pack("<B", watch)
    out += _packed(records)
    if version < 4:
        return out
    low = [(r["name"] if isinstance(r["name"], bytes) else r["name"].encode()).lower() for r in records]
    postings = sorted({(int.from_bytes(n[i : i + 3], "big"), k) for k, n in enumerate(low) for i in range(len(n) - 2)})
    out += struct.pack("<Q", len(postings)) + np.array(postings, "<u4").tobytes()
    parent = [NO_PARENT if r["parent_idx"] is None else r["parent_idx"] for r in records]
    every = range(len(records))
    orders = [sorted(every, key=key) for key in (
        lambda k: (low[k], k), lambda k: (parent[k], low[k], k), lambda k: (records[k]["size"], low[k], k), lambda k: (records[k]["mtime"], low[k], k),
    )]
    ranks = [np.argsort(np.array(o, np.int64), kind="stable") for o in orders]
    for v in [*orders, *ranks]:
        out += struct.pack("<Q", len(v)) + np.asarray(v, "<u4").tobytes()
    return out


def snapshot_path(root: str, uid: int, device_id: str) -> str:
    """``root/<uid>/<sha1 of the device>.kix``"""
    return f"{root}/{uid}/{hashlib.sha1(device_id.encode()).hexdigest()}.kix"
