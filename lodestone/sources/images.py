"""Readers of raw file systems: NTFS master file tables and EXT4 inode tables, as Spark sources.

Both read a block device or an image by slices, one partition each, and give decoded rows; what these mean is in
``operators.filesystems``. A device must be an absolute path below /dev that is no ordinary file and that not
everyone may write to; images are read with the option ``image``.
"""

from __future__ import annotations

import os
import stat
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LINK_TAGS, REPARSE_POINT
from .recordfiles import opened

MASK48 = (1 << 48) - 1
BAD_NAME = "Invalid UTF-16 Data"
SLICE_BYTES, BATCH_ROWS = 64 << 20, 4096
NAMES = "array<struct<name:string,parent_mft:bigint,namespace_type:int,mod_filetime:bigint,name_size:bigint>>"
MFT_SCHEMA = f"mft_idx bigint, base_idx bigint, is_dir boolean, is_symlink boolean, data_found boolean, data_size bigint, names {NAMES}"
EXT4_SCHEMA = "kind string, ino bigint, links_count int, size bigint, mtime bigint, mode int, dir_ino bigint, name string, scan_seq bigint"


def checked_device(path: str) -> str:
    """``path`` where it may be scanned, else an error."""
    if not path.startswith("/") or os.path.normpath(path) != path or not path.startswith("/dev/"):
        raise ValueError("a device must be an absolute path below /dev")
    real = os.path.realpath(path)
    if not real.startswith("/dev/"):
        raise ValueError("the device leads out of /dev")
    mode = os.stat(real).st_mode
    if not stat.S_ISBLK(mode):
        raise ValueError("no block device")
    if mode & stat.S_IWOTH:
        raise ValueError("everyone may write to the device")
    return real


def utf16(raw: bytes) -> str:
    try:
        return raw.decode("utf-16-le")
    except UnicodeDecodeError:
        return BAD_NAME


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark holds it."""
    return value - (1 << 64) if value >= 1 << 63 else value


# NTFS


@dataclass
class Volume:
    cluster: int
    record: int
    mft_at: int


def boot(sector: bytes) -> Volume:
    if len(sector) < 512 or sector[3:11] != b"NTFS    ":
        raise ValueError("no NTFS volume")
    per_sector, per_cluster = struct.unpack_from("<HB", sector, 11)
    lcn, clusters = struct.unpack_from("<Q", sector, 48)[0], struct.unpack_from("<b", sector, 64)[0]
    cluster = per_sector * per_cluster
    size = clusters * cluster if clusters > 0 else 1 << -clusters
    if not lcn * cluster or not size:
        raise ValueError("no place or size of the master file table")
    return Volume(cluster, size, lcn * cluster)


def runs(data: bytes) -> list[tuple[int, int, int]]:
    """(first virtual cluster, first logical cluster, clusters) of a run list: lengths and signed steps of any width."""
    out, at, vcn, lcn = [], 0, 0, 0
    while at < len(data) and data[at]:
        n, m = data[at] & 15, data[at] >> 4
        length = int.from_bytes(data[at + 1 : at + 1 + n], "little")
        lcn += int.from_bytes(data[at + 1 + n : at + 1 + n + m], "little", signed=True) if m else 0
        out.append((vcn, lcn, length))
        vcn += length
        at += 1 + n + m
    return out


def fixed(record: bytearray) -> bytearray:
    """The record with the last two bytes of each sector put back; a sector whose mark doesn't fit stays as it is."""
    at, n = struct.unpack_from("<HH", record, 4)
    if n < 2 or at + 2 * n > len(record):
        return record
    step = len(record) // (n - 1)
    for i in range(1, n):
        end = i * step
        if end > len(record):
            break
        if record[end - 2 : end] == record[at : at + 2]:
            record[end - 2 : end] = record[at + 2 * i : at + 2 * i + 2]
    return record


def attributes(record: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, offset, length) up to the end mark or the first one that doesn't fit the used part."""
    at, used = struct.unpack_from("<H", record, 20)[0], min(struct.unpack_from("<I", record, 24)[0], len(record))
    while at + 16 <= used:
        kind, length = struct.unpack_from("<II", record, at)
        if kind == 0xFFFFFFFF or length == 0 or at + length > used:
            return
        yield kind, at, length
        at += length


def mft_row(record: bytes, index: int) -> tuple | None:
    """One row of ``MFT_SCHEMA``; none where a part of a larger file says nothing about it."""
    flags, base = struct.unpack_from("<H", record, 22)[0], struct.unpack_from("<Q", record, 32)[0]
    used = min(struct.unpack_from("<I", record, 24)[0], len(record))
    names, found, size, link, parts = [], False, 0, False, base != 0
    for kind, at, _ in attributes(record):
        resident = record[at + 8] == 0
        if kind == 0x20:
            parts = True
        elif kind == 0x30 and resident and at + 24 <= used:
            body = at + struct.unpack_from("<H", record, at + 20)[0]
            if body + 68 > used:
                continue
            parent, _, changed, _, _, _, data, attrs, tag, n, space = struct.unpack_from("<7QIIBB", record, body)
            if body + 66 + 2 * n > used:
                continue
            names.append((utf16(bytes(record[body + 66 : body + 66 + 2 * n])), parent & MASK48, space, signed(changed), signed(data)))
            link |= bool(attrs & REPARSE_POINT) and tag in LINK_TAGS
        elif kind == 0x80 and record[at + 9] == 0:
            if (resident and at + 20 <= used) or (not resident and at + 56 <= used):
                found = True
                size = struct.unpack_from("<I", record, at + 16)[0] if resident else signed(struct.unpack_from("<Q", record, at + 48)[0])
    if parts and not found and not names:
        return None
    return index, (base & MASK48) if base else index, bool(flags & 2), link, found, size, names


@dataclass
class Run(InputPartition):
    at: int
    first: int
    records: int


class MftReader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int):
        self.path, self.slice = path, slice_bytes
        with opened(path) as f:
            self.volume = boot(f.read(512))
            v = self.volume
            f.seek(v.mft_at)
            head = fixed(bytearray(f.read(v.record)))
        if head[:4] != b"FILE":
            raise ValueError("no record of the master file table itself")
        for kind, at, length in attributes(head):
            if kind == 0x80 and head[at + 8]:
                own = struct.unpack_from("<H", head, at + 32)[0]
                self.runs = runs(bytes(head[at + own : at + length]))
                break
        else:
            raise ValueError("the master file table has no run list")

    def partitions(self) -> list[Run]:
        v, out = self.volume, []
        for vcn, lcn, length in self.runs:
            n, step = length * v.cluster // v.record, max(1, self.slice // v.record)
            out += [Run(lcn * v.cluster + k * v.record, vcn * v.cluster // v.record + k, min(step, n - k)) for k in range(0, n, step)]
        return out or [Run(0, 0, 0)]

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        size, held = self.volume.record, []
        with opened(self.path) as f:
            for k in range(0, part.records, BATCH_ROWS):
                n = min(BATCH_ROWS, part.records - k)
                f.seek(part.at + k * size)
                data = f.read(n * size)
                for i in range(len(data) // size):
                    raw = bytearray(data[i * size : (i + 1) * size])
                    if raw[:4] == b"FILE" and raw[22] & 1 and (row := mft_row(fixed(raw), part.first + k + i)):
                        held.append(row)
                yield _batch(held, MFT_SCHEMA)
                held = []


class MftSource(DataSource):
    """``spark.read.format("ntfs_mft").option("image", "true").load(path)``: one row for each record in use."""

    @classmethod
    def name(cls) -> str:
        return "ntfs_mft"

    def schema(self) -> str:
        return MFT_SCHEMA

    def reader(self, schema) -> MftReader:
        return MftReader(_place(self.options), int(self.options.get("slice", SLICE_BYTES)))


def _place(options: dict) -> str:
    return options["path"] if options.get("image", "").lower() == "true" else checked_device(options["path"])


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_NAME = pa.struct([(f.split(":")[0], _KINDS[f.split(":")[1]]) for f in NAMES[len("array<struct<") : -2].split(",")])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows as Arrow; workers have no session to parse ``ddl`` with."""
    fields = [x.split(" ") for x in ddl.replace(NAMES, "names").split(", ")]
    schema = pa.schema([(n, pa.list_(_NAME) if k == "names" else _KINDS[k]) for n, k in fields])
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([_array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):
        names = [x.name for x in kind.value_type]
        values = [[dict(zip(names, x, strict=True)) for x in v] for v in values]
    return pa.array(values, kind)


# EXT4


@dataclass
class Groups(InputPartition):
    first: int
    count: int


class Ext4Reader(DataSourceReader):
    def __init__(self, path: str, groups: int):
        self.path, self.groups = path, groups
        with opened(path) as f:
            f.seek(1024)
            s = f.read(1024)
        if len(s) < 1024 or struct.unpack_from("<H", s, 56)[0] != 0xEF53:
            raise ValueError("no EXT4 file system")
        self.inodes, blocks, first, log, per_group = (struct.unpack_from("<I", s, k)[0] for k in (0, 4, 20, 24, 32))
        self.inodes_per_group = struct.unpack_from("<I", s, 40)[0]
        self.block = 1024 << log
        incompatible, revision = struct.unpack_from("<I", s, 96)[0], struct.unpack_from("<I", s, 76)[0]
        self.inode_size = struct.unpack_from("<H", s, 88)[0] if revision else 128
        self.wide = bool(incompatible & 0x80)
        self.desc_size = struct.unpack_from("<H", s, 254)[0] if self.wide else 32
        if not self.inodes_per_group or incompatible & 0x10:
            raise ValueError("a layout of block groups that isn't supported")
        self.first_desc = (first + 1) * self.block
        self.n_groups = -(-self.inodes // self.inodes_per_group)

    def partitions(self) -> list[Groups]:
        return [Groups(g, min(self.groups, self.n_groups - g)) for g in range(0, self.n_groups, self.groups)]

    def read(self, part: Groups) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as f:
            for g in range(part.first, part.first + part.count):
                f.seek(self.first_desc + g * self.desc_size)
                d = f.read(self.desc_size)
                table, flags, unused = struct.unpack_from("<I", d, 8)[0], struct.unpack_from("<H", d, 18)[0], struct.unpack_from("<H", d, 28)[0]
                if self.wide and self.desc_size >= 64:
                    table |= struct.unpack_from("<I", d, 40)[0] << 32
                    unused |= struct.unpack_from("<H", d, 50)[0] << 16
                if flags & 1:  # no inode of the group was ever used
                    continue
                last = self.inodes_per_group - min(unused, self.inodes_per_group)
                for k in range(0, last, BATCH_ROWS):
                    n = min(BATCH_ROWS, last - k)
                    f.seek(table * self.block + k * self.inode_size)
                    yield _batch(list(self.rows(f, f.read(n * self.inode_size), g * self.inodes_per_group + k + 1)), EXT4_SCHEMA)

    def rows(self, f, data: bytes, first: int) -> Iterator[tuple]:
        for i in range(len(data) // self.inode_size):
            raw, ino = data[i * self.inode_size : (i + 1) * self.inode_size], first + i
            mode, links = struct.unpack_from("<H", raw, 0)[0], struct.unpack_from("<H", raw, 26)[0]
            if not links:
                continue
            size = struct.unpack_from("<I", raw, 4)[0] | struct.unpack_from("<I", raw, 108)[0] << 32
            yield "inode", ino, links, signed(size), struct.unpack_from("<I", raw, 16)[0], mode, None, None, None
            if mode & 0xF000 == 0x4000:
                for k, (child, name) in enumerate(self.entries(f, raw, size)):
                    yield "dirent", child, None, None, None, None, ino, name, (ino << 31) | k

    def entries(self, f, raw: bytes, size: int) -> Iterator[tuple[int, str]]:
        flags, place = struct.unpack_from("<I", raw, 32)[0], raw[40:100]
        if flags & 0x10000000:  # the folder is in its inode, after its parent's number
            yield from dirents(place[4:])
            return
        for block in self.extents(f, place) if flags & 0x80000 else self.mapped(f, place, size):
            f.seek(block * self.block)
            yield from dirents(f.read(self.block))

    def extents(self, f, node: bytes) -> Iterator[int]:
        magic, n, _, depth = struct.unpack_from("<HHHH", node, 0)
        if magic != 0xF30A:
            return
        for k in range(min(n, len(node) // 12 - 1)):
            _, a, b, c = struct.unpack_from("<IHHI", node, 12 + 12 * k) if depth == 0 else (0, 0, 0, 0)
            if depth == 0:
                if a <= 32768:  # longer ones are room that was never written
                    yield from range((b << 32) | c, ((b << 32) | c) + a)
            else:
                low, high = struct.unpack_from("<IH", node, 16 + 12 * k)
                f.seek((high << 32 | low) * self.block)
                yield from self.extents(f, f.read(self.block))

    def mapped(self, f, place: bytes, size: int) -> Iterator[int]:
        left = -(-size // self.block)

        def below(block: int, depth: int) -> Iterator[int]:
            nonlocal left
            if depth == 0:
                left -= 1
                if block:
                    yield block
                return
            per = (self.block // 4) ** depth
            if not block:
                left -= per
                return
            f.seek(block * self.block)
            for b in struct.unpack(f"<{self.block // 4}I", f.read(self.block)):
                if left <= 0:
                    return
                yield from below(b, depth - 1)

        for k, b in enumerate(struct.unpack("<15I", place)):
            if left <= 0:
                return
            yield from below(b, max(0, k - 11))


def dirents(data: bytes) -> Iterator[tuple[int, str]]:
    at = 0
    while at + 8 <= len(data):
        ino, length, n = struct.unpack_from("<IHB", data, at)
        if length < 8:
            return
        if ino and n and at + 8 + n <= len(data):
            yield ino, data[at + 8 : at + 8 + n].decode("utf-8", "replace")
        at += length


class Ext4Source(DataSource):
    """``spark.read.format("ext4_inodes").option("image", "true").load(path)``: rows of inodes and folder entries."""

    @classmethod
    def name(cls) -> str:
        return "ext4_inodes"

    def schema(self) -> str:
        return EXT4_SCHEMA

    def reader(self, schema) -> Ext4Reader:
        return Ext4Reader(_place(self.options), int(self.options.get("groups", 16)))


def register(spark) -> None:
    spark.dataSource.register(MftSource)
    spark.dataSource.register(Ext4Source)
