"""Column functions on names: byte-wise ASCII folding, tokens, trigrams, hashes and display forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column | str) -> Column:
    """Folds A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def tokens(query: str) -> list[str]:
    return query.split()


def ascii_folded(token: str) -> str:
    return token.translate(str.maketrans(UPPER, LOWER))


def contains_all(name_lc: Column, query: str) -> Column:
    """All tokens, in any order and with overlap; true without tokens."""
    return reduce(lambda a, b: a & b, (F.contains(name_lc, F.lit(ascii_folded(t))) for t in tokens(query)), F.lit(True))


def trigrams(name_lc: Column) -> Column:
    """Distinct byte trigrams as upper-case hex; empty for names under three bytes."""
    raw = name_lc.cast("binary")
    n = F.octet_length(name_lc)
    found = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.hex(F.substring(raw, i, F.lit(3))))
    return F.when(n >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def token_trigrams(query: str) -> list[str]:
    found = {t[i : i + 3].hex().upper() for t in (ascii_folded(x).encode() for x in tokens(query)) for i in range(len(t) - 2)}
    return sorted(found)


def fnv32(c: Column | str) -> Column:
    """32-bit FNV-1a over the UTF-16LE bytes, as a non-negative long."""
    raw = F.hex(F.encode(c, "UTF-16LE"))
    at = F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1)), F.lit(2))
    byte = lambda i: F.coalesce(F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long"), F.lit(0).cast("long"))
    fold = F.aggregate(at, F.lit(0x811C9DC5).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.length(raw) == 0, F.lit(0x811C9DC5).cast("long")).otherwise(fold)


def whole(a: Column, b: Column | int) -> Column:
    """The quotient of whole numbers, exact for all of them."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def flags(is_dir: Column, is_symlink: Column) -> Column:
    return is_dir.cast("int") + is_symlink.cast("int") * 2


def unix_from_filetime(c: Column) -> Column:
    """100 ns ticks since 1601 to Unix seconds; before 1970 gives 0."""
    return F.when(c < 116444736000000000, F.lit(0).cast("long")).otherwise(whole(c - F.lit(116444736000000000), 10000000))


#: The seconds between 1601 and 1970, and the last second whose year a calendar of 32 bits holds.
SECONDS_1601, LAST_YEAR_SECOND = 11_644_473_600, 67_768_036_191_676_799


def _clock(seconds: Column) -> Column:
    """Seconds within the calendar in the session's zone; years past 9999 don't fit the display form."""
    at = F.timestamp_seconds(F.greatest(F.least(seconds, F.lit(253402387200)), F.lit(-SECONDS_1601 - 86400)))
    return F.when(seconds.isNull(), None).when(F.year(at) > 9999, "format-error").otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def display_time(seconds: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in the session's zone of an unsigned count, whose upper half is negative here."""
    return F.when(seconds < 0, "out-of-range").when(seconds > LAST_YEAR_SECOND, "invalid-time").otherwise(_clock(seconds))


def filetime_display(ticks: Column) -> Column:
    """The same of 100 ns ticks since 1601 (unsigned); 0 is ``N/A``."""
    return F.when(ticks == 0, "N/A").when(ticks < 0, "format-error").otherwise(_clock(whole(ticks, 10_000_000) - SECONDS_1601))


def last_indexed(seconds: Column) -> Column:
    return F.when(seconds <= 0, "Unknown").otherwise(display_time(seconds))


def grouped(n: Column) -> Column:
    """Thousands apart, as in en-US."""
    return F.format_number(n, 0)


def compact_duration(seconds: Column) -> Column:
    minutes, rest = whole(seconds, 60), F.pmod(seconds, F.lit(60))
    return F.when(minutes == 0, F.concat(grouped(rest), F.lit("s"))).otherwise(F.concat(grouped(minutes), F.lit("m "), grouped(rest), F.lit("s")))


def retry_seconds(retry_at_ms: Column, now_ms: Column) -> Column:
    """Whole seconds, rounded up, until a retry; 0 where none is due or it is past."""
    return F.when((retry_at_ms > 0) & (retry_at_ms > now_ms), whole(retry_at_ms - now_ms + 999, 1000)).otherwise(0).cast("long")


def retry_mode(state: Column, only_on_remount: Column, retry_in: Column, retry_at_ms: Column) -> Column:
    return F.when(state != "error", "none").when(only_on_remount, "onRemount").when((retry_in > 0) | (retry_at_ms > 0), "backoff").otherwise("none")


def percent_done(done: Column, total: Column) -> Column:
    """Rounded half up; a total of 0 counts as 1, and more than all is all."""
    all_ = F.greatest(total, F.lit(1))
    part = F.least(done, all_)
    return whole(part * 100 + whole(all_, 2), all_).cast("int")


def clean_path(path: Column) -> Column:
    """An absolute path without empty, ``.`` and ``..`` parts; ``..`` takes the part before it away."""
    empty = F.array().cast("array<string>")
    fold = F.aggregate(
        F.split(path, "/"), empty,
        lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.lit("/"), F.array_join(fold, "/"))


def path_under_mount(path: Column, mount: Column) -> Column:
    """The path inside a device that is mounted at ``mount``; null outside. A mount at ``/`` holds every path."""
    own, at = clean_path(path), clean_path(mount)
    return F.when(own == at, "/").when(at == "/", own).when(F.startswith(own, F.concat(at, F.lit("/"))), F.substring(own, F.length(at) + 1, F.length(own)))


def device_label(label: Column, fs_type: Column, entries: Column, present: Column) -> Column:
    name = F.coalesce(F.nullif(label, F.lit("")), F.nullif(fs_type, F.lit("")), F.lit("Device"))
    return F.concat(name, F.lit(" • "), grouped(entries), F.when(present, "").otherwise(" (not present)"))


def device_tip(device: Column, dev_node: Column, present: Column, mounted: Column, mount: Column, entries: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    at = F.when(~present, "(not present)").when(mounted, F.coalesce(blank(mount), F.lit("(mounted)"))).otherwise("(not mounted)")
    return F.concat(F.lit("Device ID: "), device, F.lit("\nDev node: "), F.coalesce(blank(dev_node), F.lit("—")), F.lit("\nMount: "), at, F.lit("\nObjects: "), grouped(entries))


#: The file attribute of a reparse point, and the tags of symbolic links and junctions.
REPARSE_POINT, LINK_TAGS = 0x400, (0xA000000C, 0xA0000003)


def is_link(attributes: Column, tag: Column) -> Column:
    return (attributes.bitwiseAND(REPARSE_POINT) != 0) & tag.isin(*LINK_TAGS)


def handle_hex(handle: Column) -> Column:
    return F.lower(F.hex(handle))


def handle_bytes(text: Column) -> Column:
    """The bytes of a hex string; null for anything else."""
    return F.when(F.regexp_like(text, F.lit("^([0-9a-fA-F]{2})*$")), F.unhex(F.regexp_replace(text, "[^0-9a-fA-F]", "")))


def entry_id(device: Column | str, record_idx: Column) -> Column:
    """The device's hash above 32 bits of record number, as decimal(20,0): it has 64 bits without a sign."""
    return (fnv32(device).cast("decimal(20,0)") * 4294967296 + record_idx).cast("decimal(20,0)")


def entry_parts(entry: Column) -> tuple[Column, Column]:
    """(device hash, record number) of an entry id."""
    high = F.floor(entry / 4294967296).cast("long")
    return high, (entry - high.cast("decimal(20,0)") * 4294967296).cast("long")


def fs_kind(c: Column) -> Column:
    """``ntfs``, ``ext4``, or nothing for other kinds; drivers name theirs variously."""
    low = F.lower(F.trim(c))
    return F.when(F.contains(low, F.lit("ntfs")), "ntfs").when(F.contains(low, F.lit("ext4")), "ext4").otherwise("")


def backoff(n: Column, base: int, power: Column, most: int = 600) -> Column:
    """``base * 2**power`` seconds, at most ``most``; the exponent is bounded so it can't overflow."""
    return F.least(F.lit(most).cast("long"), (F.lit(base) * F.pow(F.lit(2.0), F.least(F.greatest(power, F.lit(0)), F.lit(30)))).cast("long"))


def watch_backoff(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(backoff(n, 30, n - 1))


def overflow_backoff(n: Column) -> Column:
    return backoff(n, 10, n)


def progress_percent(line: Column, marker: str = "PROGRESS") -> Column:
    """Percent of a progress line (``<marker> n``) within 0 to 100; null for other lines."""
    found = F.regexp_extract(line, rf"^\w*{marker} (-?\d{{1,9}})\s*$", 1)
    return F.when(found != "", F.greatest(F.lit(0), F.least(F.lit(100), F.when(found != "", found).cast("int"))))
