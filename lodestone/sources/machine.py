"""What a machine says of its devices: links by id, mounts, what udev has probed; and events of the kernel's file watch.

These read small files of the machine that asks, on the driver; the frames go into ``operators.devices``. Event
buffers come from anywhere, as rows of bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import devices

LINKS = "dev_node string, id string"
PROBED = "dev_node string, fs_type string, uuid string, label string"


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(dev_node, id) of a folder of links such as /dev/disk/by-uuid; broken links are left out."""
    rows = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        target = os.path.realpath(os.path.join(folder, name))
        if os.path.islink(os.path.join(folder, name)) and os.path.exists(target):
            rows.append((target, name))
    return spark.createDataFrame(rows, LINKS)


def udev_fields(text: str) -> dict[str, str]:
    """The properties of one file of udev's database."""
    return dict(line[2:].split("=", 1) for line in text.splitlines() if line.startswith("E:") and "=" in line)


def probed(spark: SparkSession, nodes: list[str], database: str = "/run/udev/data") -> DataFrame:
    """(dev_node, fs_type, uuid, label) of block devices, as udev has them; devices it doesn't know give blanks."""
    rows = []
    for node in nodes:
        found = {}
        try:
            number = os.stat(node).st_rdev
            with open(os.path.join(database, f"b{os.major(number)}:{os.minor(number)}")) as f:
                found = udev_fields(f.read())
        except OSError:
            pass
        rows.append((node, found.get("ID_FS_TYPE", ""), found.get("ID_FS_UUID", ""), found.get("ID_FS_LABEL", "")))
    return spark.createDataFrame(rows, PROBED)


def mounts(spark: SparkSession, path: str = "/proc/self/mountinfo") -> DataFrame:
    """(mount_point, mount_source) of this machine."""
    with open(path) as f:
        return devices.parse_mountinfo(spark.createDataFrame([(line.rstrip("\n"),) for line in f], "line string"))


def known_devices(spark: SparkSession, by_partuuid: str = "/dev/disk/by-partuuid", by_uuid: str = "/dev/disk/by-uuid", mountinfo: str = "/proc/self/mountinfo", database: str = "/run/udev/data") -> DataFrame:
    """The inventory with mounts: one row for each device that has an id."""
    a, b = links(spark, by_partuuid), links(spark, by_uuid)
    nodes = sorted({r["dev_node"] for r in a.union(b).collect()})  # the machine's own devices
    return devices.with_mounts(devices.inventory(a, b, probed(spark, nodes, database)), mounts(spark, mountinfo))


#: Fixed values of the kernel's event format: the overflow bit, the head's size, and the record of a folder and a name.
OVERFLOW, HEAD, NAMED = 0x4000, 24, 2
EVENTS = "overflow boolean, fsid_hex string, handle_hex string, name string, mask bigint"


def watch_events(data: bytes) -> list[tuple]:
    """Rows of ``EVENTS`` from one buffer: a row for each named entry, one without a name for an event that has none.

    Reading ends at a head that doesn't fit the buffer; a record that doesn't fit its event ends that event.
    """
    out, at = [], 0
    while at + HEAD <= len(data):
        length, _, _, head, mask = struct.unpack_from("<IBBHQ", data, at)
        if length < HEAD or at + length > len(data) or head < HEAD:
            break
        if mask & OVERFLOW:
            out.append((True, "", "", "", mask))
        else:
            named, k = [], at + HEAD
            while k + 4 <= at + length:
                kind, _, size = struct.unpack_from("<BBH", data, k)
                if size < 4 or k + size > at + length:
                    break
                if kind == NAMED and size >= 20:
                    own = 8 + struct.unpack_from("<I", data, k + 12)[0]  # the handle's head and bytes
                    name = data[k + 12 + own : k + size].split(b"\0", 1)[0] if 12 + own <= size else b""
                    if name:
                        named.append((False, data[k + 4 : k + 12].hex(), data[k + 12 : k + 12 + own].hex(), name.decode("utf-8", "replace"), mask))
                k += size
            out += named or [(False, "", "", "", mask)]
        at += length
    return out


def decoded_events(buffers: DataFrame) -> DataFrame:
    """Events of rows with uid, device_id, ts and data (a buffer each), of a table or a stream."""
    keys = ["uid", "device_id", "ts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [watch_events(x or b"") for x in batch["data"].to_pylist()]
            at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
            flat = [r for rows in found for r in rows]
            types = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array([r[k] for r in flat], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(at) for c in keys], *columns], names=[*keys, *(x.split()[0] for x in EVENTS.split(", "))])

    narrow = buffers.select(*keys, "data")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:3])
    return narrow.mapInArrow(run, f"{ddl}, {EVENTS}")
