"""Token-id files coded by an adaptive context-mixing range coder.

Three models predict the next id. Order 2 and order 1 remember, for the two ids or the one id before, the id that
followed and how often it was right; order 0 counts ids by bins that widen with the id.
The three are mixed into one distribution whose weights follow how often each has been right in the same state of
confidence, and that distribution drives a range coder, in one step for each id. Blocks of ``BLOCK`` ids start from a fresh model and carry checksums, so any block
decodes alone; the blocks of a segment are coded side by side, one lane each. All arithmetic is on integers.

A file is a table of segments in ascending order of their first document; a document lies in one segment. Spark's
writer commits it, so a lost executor leaves no half-written segment.
"""

from __future__ import annotations

import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import library_words, slabs
from .common import bounded_batches, new_path, table

BLOCK, LEAST_BLOCK, LANES = 2048, 1024, 2560
SEGMENT_IDS = 8 << 20
CHUNK = 32  # ids of a block after which the models learn from them
END_ID = 2
MAGIC = b"LMIX3\0\0\0"
MAX_PARTS_BROADCAST = 1_000_000
#: The coder's range is 64 bits and moves on by 16; weights have 20 bits, and order 0 shares its own out by 12 more.
TOTAL, BIN_BITS, WORD = 32, 12, np.uint64(16)
LEAST_RANGE, LOW16 = np.uint64(2**48), np.uint64(2**16 - 1)
ONE_SLOTS, TWO_SLOTS, BINS = 1 << 10, 1 << 11, 256
LOW32, HALF, BYTES = np.uint64(2**32 - 1), np.uint64(32), np.uint64(0x0101010101010101)
#: Bins of ids: one each below 64, then 19 for each doubling up to 65536.
EDGES = np.unique(np.concatenate([np.arange(64), np.floor(64 * 2 ** (np.arange(190) / 19 + 1e-9)).astype(np.int64), [65536]]))
BIN_OF = np.searchsorted(EDGES, np.arange(65536), "right") - 1
START = np.concatenate([EDGES[:-1], np.full(BINS + 1 - len(EDGES), 65536)])
WIDTH = np.concatenate([np.diff(EDGES), np.ones(BINS + 1 - len(EDGES), np.int64)])
F1 = np.float32(1)


class Model:
    """Predictions, counts and weights of all lanes, which learn from ``CHUNK`` ids at a time.

    A slot of order 2 or 1 holds an id and, 16 bits up, its confidence. Order 0 shares its distribution out anew each
    time that its ids are a quarter more; ``inverse`` keeps for decoders which bin each of its 4,096 shares falls to.
    """

    def __init__(self, lanes: int, inverse: bool = False):
        self.lane = np.arange(lanes)
        self.lanes_of = np.tile(self.lane, CHUNK)
        self.t1, self.t2 = np.zeros(lanes * ONE_SLOTS, np.int32), np.zeros(lanes * TWO_SLOTS, np.int32)
        self.at1, self.at2, self.at_p = self.lane * ONE_SLOTS, self.lane * TWO_SLOTS, self.lane * 32
        # By confidence of order 2 and 1, and whether they agree: how many ids were order 2's, only order 1's, neither's.
        # Whole numbers far below 2**24, so single precision counts them exactly, and divides alike on every machine.
        k2, k1 = np.arange(32) // 4 % 4, np.arange(32) % 4
        two, one = np.array([1, 4, 8, 11])[k2], np.where(np.arange(32) >= 16, 0, np.array([1, 2, 3, 4])[k1])
        self.outcomes = np.tile(np.stack([16 - two - one, two, one]).astype(np.float32), (1, lanes))
        self.counts = np.ones((lanes, BINS), np.int32)
        self.flat = np.zeros(lanes * BINS + 1, np.int32)
        self.bin_of = np.zeros((lanes, 1 << BIN_BITS), np.uint8) if inverse else None
        self.step = self.due = 0
        self.refresh()

    def refresh(self) -> None:
        """Weights and distributions from the counts."""
        none, two, one = self.outcomes
        weight2 = (two / (none + two + one + F1) * np.float32(960 << 10)).astype(np.int64) + 1024
        weight1 = (one / (none + one + F1) * (((1 << 20) - weight2) * 0.875).astype(np.float32)).astype(np.int64) + 16
        self.weights = u64(weight2 << BIN_BITS) | (u64(weight1 << BIN_BITS) << HALF)
        if self.step >= self.due:
            self.due = max(self.step + CHUNK, self.step * 5 // 4)
            sums = np.cumsum(self.counts, axis=1, dtype=np.int32)
            scale = (((1 << BIN_BITS) - BINS) << 16) // sums[:, -1:]  # a product has 31 bits at most
            sums *= scale
            sums >>= 16
            shares = self.flat[:-1].reshape(-1, BINS)
            np.add(sums[:, :-1], np.arange(1, BINS, dtype=np.int32), out=shares[:, 1:])
            if self.bin_of is not None:
                for k in range(0, len(shares), 64):  # few enough lanes for a core's cache
                    marks = self.bin_of[k : k + 64]
                    marks[:] = 0
                    marks.ravel()[(shares[k : k + 64, 1:] + (self.lane[: len(marks), None] << BIN_BITS)).ravel()] = 1
                    eight = marks.view("<u8")  # running sums of bytes, eight at a time; none is above 255
                    eight *= BYTES
                    tops = eight >> np.uint64(56)
                    before = np.cumsum(tops, axis=1)
                    before -= tops
                    before *= BYTES
                    eight += before

    def predict(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """(i1, i2, e1, e2, x, c1, c2, weight of c2, weight of c1) for the ids before; any number of rows of lanes."""
        i1 = self.at1 + ((one * 40503 >> 5) & (ONE_SLOTS - 1))
        i2 = self.at2 + ((one * 0x9E3779B1 + two * 0x85EBCA6B >> 13) & (TWO_SLOTS - 1))
        e1, e2 = self.t1[i1], self.t2[i2]
        c1, c2 = e1 & 0xFFFF, e2 & 0xFFFF
        x = self.at_p + ((e2 >> 16 << 2) + (e1 >> 16) + ((c1 == c2).view(np.int8) << 4))
        w = self.weights[x]
        return i1, i2, e1, e2, x, c1, c2, (w & LOW32).view(np.int64), (w >> HALF).view(np.int64)

    def share(self, lane: np.ndarray, bins: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, length for each id) of bins, where order 0 has ``rest`` for all of them."""
        slot = lane * BINS + bins
        below, above = self.flat[slot], self.flat[slot + 1]
        above[above == 0] = 1 << BIN_BITS  # the next lane begins at 0
        length = (above - below) * rest
        return below * rest, length // WIDTH[bins]

    def bin_at(self, lane: np.ndarray, aim: np.ndarray) -> np.ndarray:
        """The last bin of each lane that begins at or below ``aim``."""
        return self.bin_of.ravel()[(lane << BIN_BITS) + aim].astype(np.int64)

    def learn(self, ids: np.ndarray, found: tuple[np.ndarray, ...], hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``ids`` (rows of lanes, 32 bits) have followed; where one slot is due twice, the later id counts."""
        i1, i2, e1, e2, x, c1, c2 = found[:7]
        for t, i, e, c, hit in ((self.t2, i2, e2, c2, hit2), (self.t1, i1, e1, c1, ids == c1)):
            # A hit raises confidence to 3 at most, a miss halves it, and the id takes the place of one without any.
            then = c | (e >> 1 & 0x10000)
            np.copyto(then, ids, where=e < 0x10000)
            at = np.flatnonzero(hit)
            then.ravel()[at] = np.minimum(e.ravel()[at] + 0x10000, c.ravel()[at] + 0x30000)
            t[i] = then
        np.add.at(self.outcomes.ravel(), (x + len(self.lane) * 32 * (hit2.view(np.int8) + hit1.view(np.int8) * 2).astype(np.int64)).ravel(), F1)
        at = np.flatnonzero(~(hit2 | hit1))
        np.add.at(self.counts.ravel(), self.lanes_of[at] * BINS + BIN_OF[ids.ravel()[at]], np.int32(4))
        self.step += len(ids)
        self.refresh()


def u64(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def encode_lanes(ids: np.ndarray) -> list[bytes]:
    """Payloads of the rows of ``ids`` (lanes, steps), each below 65536."""
    lanes, steps = ids.shape
    model = Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    most = steps * 2 + 8  # a step takes two words at most
    out, pos = np.zeros(lanes * most, "<u2"), model.lane * most
    after = np.zeros((CHUNK + 2, lanes), np.int64)
    for t in range(0, steps, CHUNK):
        n = min(CHUNK, steps - t)
        after[:2] = after[-2:]
        after[2 : 2 + n] = ids[:, t : t + n].T
        x = after[2 : 2 + n]
        found = model.predict(after[1 : 1 + n], after[:n])
        c1, c2, a, b = found[5:]
        x = x.astype(np.int32)
        hit2 = x == c2
        hit1 = (x == c1) & ~hit2
        cum, freq = a * ~hit2, a + (b - a) * hit1
        at = np.flatnonzero(~(hit2 | hit1))
        rare, lane = x.ravel()[at].astype(np.int64), model.lanes_of[at]
        bins = BIN_OF[rare]
        ab = a.ravel()[at] + b.ravel()[at]
        begin, each = model.share(lane, bins, ((1 << TOTAL) - ab) >> BIN_BITS)
        cum.ravel()[at], freq.ravel()[at] = ab + begin + (rare - START[bins]) * each, each
        cum, freq = u64(cum), u64(freq)
        for k in range(n):
            unit = span >> np.uint64(TOTAL)
            old = low
            low, span = old + unit * cum[k], unit * freq[k]
            over = np.flatnonzero(low < old)
            if len(over):  # carries go into words that are out already
                p = pos[over] - 1
                while len(p):
                    out[p] += np.uint16(1)
                    p = p[out[p] == 0] - 1
            due = np.flatnonzero(span < LEAST_RANGE)
            while len(due):
                first, p, wide = low[due], pos[due], span[due] << WORD
                out[p] = first >> np.uint64(48)
                pos[due] = p + 1
                low[due], span[due] = first << WORD, wide
                due = due[wide < LEAST_RANGE]
        model.learn(x, found, hit2, hit1)
    for shift in (48, 32, 16, 0):
        out[pos] = (low >> np.uint64(shift)) & LOW16
        pos += 1
    return [out[k * most : pos[k]].tobytes() for k in range(lanes)]


def decode_lanes(payloads: list[bytes], steps: int) -> np.ndarray:
    lanes = len(payloads)
    most = max(map(len, payloads)) // 2 + 8
    words = np.zeros((lanes, most), "<u2")
    for k, p in enumerate(payloads):
        words[k, : len(p) // 2] = np.frombuffer(p, "<u2")
    model = Model(lanes, inverse=True)
    pos = model.lane * most + 4  # a damaged block may read on into the next one's words; its checksum tells
    flat = words.ravel()
    span = np.full(lanes, 2**64 - 1, np.uint64)
    value = np.zeros(lanes, np.uint64)  # the code's distance from the lower end of the range
    for k in range(4):
        value = (value << WORD) | words[:, k]
    out = np.empty((lanes, steps), np.uint16)
    after = np.zeros((CHUNK + 2, lanes), np.int64)
    for t in range(0, steps, CHUNK):
        n = min(CHUNK, steps - t)
        after[:2] = after[-2:]
        found = [np.empty((n, lanes), kind) for kind in "qqiiqii"]
        hits = np.empty((2, n, lanes), bool)
        for k in range(n):
            *kept, a, b = model.predict(after[k + 1], after[k])
            for j in range(7):
                found[j][k] = kept[j]
            c1, c2 = kept[5:]
            unit = span >> np.uint64(TOTAL)
            v = np.minimum(value // unit, np.uint64((1 << TOTAL) - 1)).view(np.int64)
            ab, later = a + b, v >= a
            rest = v >= ab
            hits[0, k], hits[1, k] = ~later, later ^ rest
            cum, freq, x = a * later, a + (b - a) * later, c2 + (c1 - c2) * later
            rare = np.flatnonzero(rest)
            ab = ab[rare]
            v, rest = v[rare] - ab, ((1 << TOTAL) - ab) >> BIN_BITS
            bins = model.bin_at(rare, v // rest)
            begin, each = model.share(rare, bins, rest)
            place = np.minimum((v - begin) // each, WIDTH[bins] - 1)
            cum[rare], freq[rare], x[rare] = ab + begin + place * each, each, START[bins] + place
            value -= unit * u64(cum)
            span = unit * u64(freq)
            due = np.flatnonzero(span < LEAST_RANGE)
            while len(due):
                p, wide = pos[due], span[due] << WORD
                value[due] = (value[due] << WORD) | flat.take(p, mode="clip")
                pos[due] = p + 1
                span[due] = wide
                due = due[wide < LEAST_RANGE]
            after[k + 2] = x
        x = after[2 : 2 + n].astype(np.int32)
        out[:, t : t + n] = x.T
        model.learn(x, tuple(found), hits[0], hits[1])
    return out


def groups(lanes: int) -> list[tuple[int, int]]:
    """Lanes that are coded together: as few groups of at most LANES as there can be, of about equal size."""
    n = -(-lanes // LANES)
    edges = [lanes * k // n for k in range(n + 1)] if n else []
    return list(zip(edges[:-1], edges[1:], strict=True))


def encode_segment(ids: np.ndarray) -> bytes:
    """Blocks of equal length, the last one shorter, with their lengths and checksums in front.

    A block has BLOCK ids, and down to LEAST_BLOCK where the segment is small, as few lanes cost as much as many.
    """
    n = len(ids)
    if n and int(ids.max()) >= 65536:
        raise ValueError("ids must be below 65536")
    steps = min(n, BLOCK, max(LEAST_BLOCK, -(-n // (LANES // 2))))
    lanes = -(-n // steps) if n else 0
    padded = np.zeros(lanes * steps, np.uint16)
    padded[:n] = ids
    rows = padded.reshape(lanes, steps) if n else padded.reshape(0, 0)
    parts = [p for a, b in groups(lanes) for p in encode_lanes(rows[a:b])]
    heads = []
    for k, p in enumerate(parts):
        block = ids[k * steps : (k + 1) * steps]
        heads.append(struct.pack("<IIII", len(block), len(p), zlib.crc32(p), zlib.crc32(block.astype("<u4").tobytes())))
    return MAGIC + struct.pack("<II", lanes, steps) + b"".join(heads + parts)


def decode_segment(data: bytes) -> np.ndarray:
    """The ids; raises where a checksum doesn't hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    lanes, steps = struct.unpack_from("<II", data, 8)
    heads = [struct.unpack_from("<IIII", data, 16 + 16 * k) for k in range(lanes)]
    at, payloads = 16 + 16 * lanes, []
    for _, size, crc, _ in heads:
        payloads.append(data[at : at + size])
        at += size
        if zlib.crc32(payloads[-1]) != crc:
            raise ValueError("a block's payload is damaged")
    out = np.empty(sum(h[0] for h in heads), "<u4")
    filled = 0
    for a, b in groups(lanes):
        rows = decode_lanes(payloads[a:b], steps)
        for row, (n, _, _, crc) in zip(rows, heads[a:b], strict=True):
            out[filled : filled + n] = row[:n]
            if zlib.crc32(out[filled : filled + n]) != crc:
                raise ValueError("a block decodes to other ids")
            filled += n
    return out


SEGMENT = "part int, segment int, begin long, n_tokens long, docs array<bigint>, counts array<bigint>, data binary"
NAMES = [x.split()[0] for x in SEGMENT.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def write_ids(docs: DataFrame, path: str) -> None:
    """Encode (doc_id, text), append END_ID to each document and write segments in ascending doc_id order.

    Null text is empty. Equal doc_ids follow each other in the order of their texts' hashes; a null doc_id comes
    first, and is kept as null. Other columns are ignored. A document is never split, however long: a segment ends
    with the document that reaches ``SEGMENT_IDS`` ids. An empty table writes an empty file.
    """
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # The last key only parts rows that are equal in all others, so that many copies of one row don't meet in a task.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    ordered = keyed.repartitionByRange(n, "doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        words, part, segment, begin = library_words(), 0, 0, 0
        held, docs_, counts, size = [], [], [], 0

        def packed():
            nonlocal held, docs_, counts, size, segment, begin
            row = (part, segment, begin, size, docs_, counts, encode_segment(np.concatenate(held)))
            segment, begin = segment + 1, begin + size
            held, docs_, counts, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, TYPES, strict=True)], names=NAMES)

        for batch in slabs(batches):
            part = batch["part"][0].as_py()
            ids, ends = words.encode(batch["text"], END_ID)
            at = 0
            for doc, end in zip(batch["doc_id"].to_pylist(), ends.tolist(), strict=True):
                held.append(ids[at:end])
                docs_.append(doc)
                counts.append(end - at)
                size, at = size + end - at, end
                if size >= SEGMENT_IDS:
                    yield packed()
        if docs_:
            yield packed()

    ordered.mapInArrow(run, SEGMENT).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the file; ``ids`` are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. The driver gets one sum for each part of the file.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    sums = sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n_tokens")).collect())
    bases = list(zip((p for p, _ in sums), accumulate((n for _, n in sums), initial=0)))
    parts = spark.createDataFrame(bases, "part int, base long")
    rows = segments.join(F.broadcast(parts) if len(bases) <= MAX_PARTS_BROADCAST else parts, "part")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in ("docs", "counts", "begin", "base", "data")}
                ids = decode_segment(row["data"])
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                starts = row["base"] + row["begin"] + ends - counts
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(starts), pa.array(counts), raw.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op4_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
