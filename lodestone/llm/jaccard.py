"""Exact Jaccard self-join of word-shingle sets by universe partition and the pigeonhole principle.

Two sets of sizes a and b with Jaccard similarity of at least P/Q differ in at most H = (a+b)(Q-P)/(Q+P) elements.
Sizes fall into bands that double. A band splits the hashed universe into m segments; every set indexes its subset
of each segment under its own band, and probes its own and the next smaller band. A probe gives segment i an
allocation a_i: 0 skips it, 1 finds sets with an equal subset, 2 also those one element apart (one-deletion
neighbourhoods, indexed in the bands of small sets). If the allocations sum to H+1, any partner is found: one that no
segment finds differs in at least sum(a_i) > H elements. Allocations go where they cost least, by how often a subset
has occurred in the task, so subsets that boilerplate fills are left out.

Sets with equal signatures form runs. Short runs give all their pairs; long ones, in a share of the buckets, a star and
a chain. What still lies in different components after those are verified is refined: the sets of long runs meet again
by their rarest elements, of which linked sets must share one (counts of hashed elements over all sets give the order),
short groups as pairs and long ones as pairs of bounded blocks. So a passage that fills most of many texts costs no
pairs. Before sets are compared exactly, their parity sketches are: bits that differ are a lower bound of the elements
that differ.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, components, extended_components, freed, table, written
from .words import WordHashes, hashed, inside, mix, windows

N = 5
P, Q = 75, 100
SHORT_RUN = 16
AHEAD = 8  # one bucket in so many gives stars and chains
SLICE = 500_000
BLOCK_DOCS, BLOCK_PAIRS = 400, 1000
LARGE_CLASS = 100
SALTS = 64
FILTER_BITS = 1 << 24
RARITY_SLOTS = 1 << 20  # hashed counts of elements; only an order, so collisions cost time and not exactness
RARITY_PARTS = 64
SIG_BYTES, RARE_BYTES, ELEMENT_BITS = 4, 4, 48
DELETIONS_TO = 5  # bands of sets below 2**(DELETIONS_TO + 1) elements index one-deletion neighbourhoods
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (Q - P) // (Q + P)


def scheme(band: int) -> int:
    """Segments of a band, for sets of 2**band to 2**(band+1)-1 elements and probes up to Q/P times as large."""
    top = 2 ** (band + 1) - 1
    most = most_apart(top, top * Q // P)
    return (most + 2) // 2 + (band >= 3) if band <= DELETIONS_TO else max(most + 1, -(-top * 2 // 5)) + 2


def sets_of(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes by document, each sorted; offsets)."""
    h, offsets = hashed(words, cache)
    n = len(words)
    at = inside(offsets, N, len(h))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    few = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < N))
    whole = []
    for d in few:
        x = int(offsets[d + 1] - offsets[d])
        for w in h[offsets[d] : offsets[d + 1]].tolist():
            x = (x * int(K1) + w + 1) % 2**64
        whole.append(x)
    sizes = np.bincount(doc[at], minlength=n) if len(at) else np.zeros(n, np.int64)
    sizes[few] = 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    values, single = np.empty(ends[-1], np.uint64), np.zeros(ends[-1], bool)
    single[ends[few]] = True
    values[single], values[~single] = mix(np.array(whole, np.uint64)), windows(h, N)[at]
    for d in np.flatnonzero(sizes > 1).tolist():
        values[ends[d] : ends[d + 1]].sort()
    owner = np.repeat(np.arange(n), sizes)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[new], minlength=n)
    return values[new], np.concatenate([[0], np.cumsum(counts)])


def ranks_in(group: np.ndarray) -> np.ndarray:
    """Position within its group, for sorted groups."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))


def signatures(values: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, 1 for index + 2 for probe, True where it stands for an empty subset)."""
    sizes = np.diff(offsets)
    band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    own = np.flatnonzero(sizes > 0)
    lower = own[(band[own] > 0) & (-(-sizes[own] * P // Q) <= 2 ** band[own] - 1)]
    task, tband = np.concatenate([own, lower]), np.concatenate([band[own], band[lower] - 1])
    is_own = np.arange(len(task)) < len(own)
    if not len(task):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    m = np.array([scheme(b) for b in range(int(tband.max()) + 1)])[tband]
    base = np.concatenate([[0], np.cumsum(m)])
    # One element per (task, shingle), sorted by segment.
    n = sizes[task]
    t = np.repeat(np.arange(len(task)), n)
    v = values[np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n) + offsets[task][t]]
    spread = mix(v + tband[t].astype(np.uint64) * K2)
    seg = base[t] + ((spread >> np.uint64(32)) * m[t].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(seg)
    seg, element = seg[order], mix(v[order] ^ K3)
    count = np.bincount(seg, minlength=base[-1])
    sums = np.zeros(base[-1], np.uint64)
    filled = np.flatnonzero(count)
    sums[filled] = np.add.reduceat(element, np.concatenate([[0], np.cumsum(count[filled])[:-1]]))
    owner = np.repeat(np.arange(len(task)), m)
    where = (np.arange(base[-1]) - base[owner]).astype(np.uint64) * K1 + tband[owner].astype(np.uint64) * K2
    sub = mix(sums + where)
    # Cost of a segment: about how often its subset has occurred in this task; deletions cost their own look-ups too.
    slot = (sub & np.uint64(len(seen) - 1)).astype(np.int64)
    seen += np.bincount(slot, minlength=len(seen)).astype(seen.dtype)
    cost = seen[slot].astype(np.int64)
    need = ((sizes[task] + np.minimum(sizes[task], 2 ** (tband + 1) - 1)) * (Q - P) // (Q + P) + 1)
    small = tband[owner] <= DELETIONS_TO
    last = np.int64(1) << 40
    one = np.where(count == 0, last, cost)
    two = np.where(~small, last << 2, np.where(count >= 2, cost + count, (last << 1) + count))
    item_cost = np.concatenate([one, two])
    item_seg = np.concatenate([np.arange(base[-1])] * 2)
    by = np.argsort((owner[item_seg] << 44) + item_cost)  # costs stay below 2**44
    chosen = by[ranks_in(owner[item_seg][by]) < need[owner[item_seg][by]]]
    allocation = np.bincount(item_seg[chosen], minlength=base[-1])

    rows = []
    flag = np.where(is_own[owner], 1, 0) + np.where(allocation >= 1, 2, 0)
    keep = flag > 0
    rows.append((sub[keep], task[owner[keep]], flag[keep], count[keep] == 0))
    # One-deletion neighbourhoods of small bands: indexed by all, looked up where the allocation is 2.
    e_own, e_small = is_own[owner[seg]], small[seg]
    left = sums[seg] - element
    i = np.flatnonzero(e_small & e_own)
    rows.append((mix(left[i] + where[seg[i]] + K3), task[owner[seg[i]]], np.ones(len(i), np.int64), count[seg[i]] == 1))
    i = np.flatnonzero(e_small & (allocation[seg] == 2))
    rows.append((mix(left[i] + where[seg[i]]), task[owner[seg[i]]], np.full(len(i), 2), count[seg[i]] == 1))
    i = np.flatnonzero(small & (allocation == 2))
    rows.append((mix(sums[i] + where[i] + K3), task[owner[i]], np.full(len(i), 2), count[i] == 0))
    return tuple(np.concatenate(x) for x in zip(*rows, strict=True))


def planes(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each number, byte by byte, so that equal high bytes compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(data: bytes, rows: int, n: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, rows).T
    return out.view("<u8").ravel()


BUNDLE = "bucket int, rows int, sigs binary, docs binary, info binary"


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or "").encode().lower().split() for t in batch["text"].to_pylist()]


def bundled(docs: DataFrame, buckets: int) -> DataFrame:
    """Signatures of each task's distinct sets, packed by bucket; bucket -1 holds (doc_id, n_shingles, set's first), -2 and below parts of the counts of elements."""

    def run(batches):
        cache, first, held, seen, often = WordHashes(), {}, [], np.zeros(1 << 21, np.int32), np.zeros(RARITY_SLOTS, np.int32)

        def packed():
            sig, doc, info = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            # The bucket and SIG_BYTES more stand for a signature; two that fall together give candidates, not links.
            bucket = (sig >> np.uint64(8 * SIG_BYTES)) % np.uint64(buckets)
            order = np.argsort((bucket << np.uint64(32)) + np.arange(len(bucket), dtype=np.uint64))  # a document's rows stay together
            sig, doc, info, bucket = sig[order], doc[order], info[order], bucket[order].astype(np.int64)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            parts = [(int(bucket[a]), b - a, planes(sig[a:b], SIG_BYTES), planes(doc[a:b].view(np.uint64), 8), planes(info[a:b], 5)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), TYPES, strict=True)], names=NAMES)

        for batch in slices(batches, limit=SLICE):
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            values, offsets = sets_of(_words(batch), cache)
            sizes = np.diff(offsets)
            total = np.concatenate([[0], np.cumsum(mix(values ^ K2), dtype=np.uint64)])
            digest = total[offsets[1:]] - total[offsets[:-1]]
            head = [first.setdefault((int(n), int(g)), int(d)) if n else int(d) for n, g, d in zip(sizes, digest, ids, strict=True)]
            head = np.array(head, np.int64)
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((-1, len(ids), ids.tobytes(), sizes.astype(np.int64).tobytes(), head.tobytes()), TYPES, strict=True)], names=NAMES)
            new = np.flatnonzero((head == ids) & (sizes > 0))
            new = new[np.unique(ids[new], return_index=True)[1]]  # a repeated row is one set
            pick = np.concatenate([np.arange(offsets[d], offsets[d + 1]) for d in new]) if len(new) else np.empty(0, np.int64)
            often += np.bincount((values[pick] & np.uint64(RARITY_SLOTS - 1)).astype(np.int64), minlength=RARITY_SLOTS).astype(np.int32)
            sig, s, flag, empty = signatures(values[pick], np.concatenate([[0], np.cumsum(sizes[new])]), seen)
            doc, size = ids[new][s], sizes[new][s]
            # Empty subsets are common: index rows go to one of SALTS places, a probe that needs them to all.
            where = mix(doc.view(np.uint64)) % np.uint64(SALTS)
            probe = empty & (flag >= 2)
            raw = sig[probe]
            sig = np.where(empty, mix(sig + where + np.uint64(1)), sig)
            flag_own = np.where(empty, flag & 1, flag)
            keep = flag_own > 0
            info = (size.astype(np.uint64) << np.uint64(2))
            held.append((sig[keep], doc[keep], info[keep] | flag_own[keep].astype(np.uint64)))
            if probe.any():
                for salt in range(SALTS):
                    held.append((mix(raw + np.uint64(salt + 1)), doc[probe], info[probe] | np.uint64(2)))
            if sum(len(x[0]) for x in held) > 1_200_000:
                yield packed()
        if held and sum(len(x[0]) for x in held):
            yield packed()
        for part, counts in enumerate(often.reshape(RARITY_PARTS, -1)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((-2 - part, len(counts), zlib.compress(planes(counts, 4), 1), b"", b""), TYPES, strict=True)], names=NAMES)

    return docs.mapInArrow(run, BUNDLE)


TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
NAMES = ["bucket", "rows", "sigs", "docs", "info"]


def linked_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * Q >= np.maximum(a, b) * P


def _rows(kind, a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["kind", "a", "b", "c"])


def candidates(bundles: DataFrame, short_run: int = SHORT_RUN) -> DataFrame:
    """(kind, a, b, c): kind 0 document, size, set's first; kind 1 a pair; kind 2 a document of a long run; kind 3 slot and its count of elements."""

    def match(parts, ahead, crowd):
        sig = np.concatenate([unplanes(p[1], p[0], SIG_BYTES) for p in parts])
        doc = np.concatenate([unplanes(p[2], p[0], 8) for p in parts]).view(np.int64)
        info = np.concatenate([unplanes(p[3], p[0], 5) for p in parts])
        order = np.argsort(sig)
        sig, doc, info = sig[order], doc[order], info[order]
        run = np.cumsum(np.concatenate([[True], sig[1:] != sig[:-1]])) - 1
        flags = (info & np.uint64(3)).astype(np.int64)
        live = (np.bincount(run) > 1) & (np.bincount(run, flags & 1) > 0) & (np.bincount(run, (flags & 2) > 0) > 0)
        keep = live[run]
        run, doc, flags, size = run[keep], doc[keep], flags[keep], (info[keep] >> np.uint64(2)).astype(np.int64)
        if not len(run):
            return
        order = np.lexsort((doc, run))
        run, doc, flags, size = run[order], doc[order], flags[order], size[order]
        length = np.bincount(run)[run]
        found = []

        def pairs(i, j):
            ok = (doc[i] != doc[j]) & (((flags[i] & 2) > 0) & (flags[j] & 1 > 0) | ((flags[j] & 2) > 0) & (flags[i] & 1 > 0)) & linked_sizes(size[i], size[j])
            found.append(np.unique(np.stack([np.minimum(doc[i[ok]], doc[j[ok]]), np.maximum(doc[i[ok]], doc[j[ok]])], 1), axis=0))

        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        start = np.repeat(first, np.diff(np.append(first, len(run))))
        for d in range(1, max(2, short_run)):
            i = np.flatnonzero((run[d:] == run[:-d]) & (length[d:] <= short_run))
            if len(i):
                pairs(i, i + d)
        long = np.flatnonzero(length > short_run)
        if len(long) and ahead:
            # Not needed for exactness: they only join most near copies before blocks are compared.
            pairs(start[long], long)
            chain = long[1:][run[long[1:]] == run[long[:-1]]]
            pairs(chain - 1, chain)
        both = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        if len(both):
            yield _rows(1, both[:, 0], both[:, 1], np.zeros(len(both), np.int64))
        if len(long):
            ids = np.unique(doc[long])
            slot = (mix(ids.view(np.uint64)) % np.uint64(len(crowd))).astype(np.int64)
            ids, slot = ids[crowd[slot] != ids], slot[crowd[slot] != ids]
            crowd[slot] = ids
            yield _rows(2, ids, ids, ids)

    def run_all(batches):
        held, at, crowd, often = [], None, np.zeros(1 << 18, np.int64), {}
        crowd[0] = 1  # which were given already, as far as it remembers; no entry stands for its own place at first
        for batch in batches:
            for bucket, rows, sigs, docs, info in zip(*(batch[c].to_pylist() for c in NAMES), strict=True):
                if bucket < -1:
                    often[bucket] = often.get(bucket, 0) + unplanes(zlib.decompress(sigs), rows, 4).astype(np.int64)
                    continue
                if bucket < 0:
                    yield _rows(0, np.frombuffer(sigs, np.int64), np.frombuffer(docs, np.int64), np.frombuffer(info, np.int64))
                    continue
                if bucket != at and held:
                    yield from match(held, at % AHEAD == 0, crowd)
                    held = []
                at = bucket
                held.append((rows, sigs, docs, info))
        if held:
            yield from match(held, at % AHEAD == 0, crowd)
        for part, counts in often.items():
            slots = (-2 - part) * len(counts) + np.arange(len(counts))
            yield _rows(3, slots, counts, slots)

    return bundles.mapInArrow(run_all, "kind int, a long, b long, c long")


def wanted_bits(nodes: DataFrame) -> bytes:
    """A bitmap of fixed size that has the bit of every node; others pass rarely and are dropped by a join later."""
    h = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    words = nodes.select(h.alias("h")).select(F.expr("h div 64").alias("w"), F.expr("shiftleft(1L, CAST(h % 64 AS INT))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.toArrow()  # at most FILTER_BITS / 64 rows
    out[got["w"].to_numpy()] = got["bits"].to_numpy()
    return out.tobytes()


def of_nodes(docs: DataFrame, nodes: DataFrame, encode, ddl: str) -> DataFrame:
    """``encode(ids, values, offsets, bit numbers)`` over the shingle sets of about the given nodes."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted_bits(nodes))
    marked = docs.select("doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_BITS)).alias("h"))

    def run(batches):
        cache, words = WordHashes(), np.frombuffer(bits.value, np.int64).view(np.uint64)
        for batch in batches:
            h = batch["h"].to_numpy().astype(np.int64)
            batch = batch.filter(pa.array((words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1))
            for part in slices(iter([batch]), limit=SLICE):
                yield encode(part["doc_id"], *sets_of(_words(part), cache), part["h"].to_numpy().astype(np.int64))

    return marked.mapInArrow(run, ddl)


def sketch(values: np.ndarray) -> bytes:
    """Parity of the elements that fall on each of one to two bits per element."""
    n = max(64, 1 << (len(values) - 1).bit_length()) if len(values) else 64
    at = (mix(values ^ K2) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=n).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(x: np.ndarray, n: int) -> np.ndarray:
    """Sketches (a row each) of n bytes; a power of two at most their length."""
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, n), axis=1)


def rarity(counts: DataFrame) -> bytes:
    """The counts of all slots; a table of fixed size. They reach the driver compressed."""

    def pack(batches):
        for batch in batches:
            slots, often = (batch[c].to_numpy() for c in ("a", "b"))
            raw = planes(np.diff(slots, prepend=0), 8) + planes(often, 8)
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(raw, 1)], pa.binary())], names=["raw"])

    out = np.zeros(RARITY_SLOTS, np.int64)
    for part in counts.select("a", "b").mapInArrow(pack, "raw binary").toArrow()["raw"].to_pylist():  # at most RARITY_SLOTS counts
        raw = zlib.decompress(part)
        steps, often = (unplanes(x, len(x) // 8, 8).view(np.int64) for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
        out[np.cumsum(steps)] = often
    return np.minimum(out, 2**31 - 1).astype(np.int32).tobytes()


def asking(size):
    """How many of a set's rarest elements hold one of any linked set that is at most as large."""
    return size - -(-size * P // Q) + 1


def asked(size):
    """The same for linked sets that are at least as large."""
    return size - -(-2 * size * P // (P + Q)) + 1


def sketches_for(docs: DataFrame, nodes: DataFrame, crowd: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, size, sketch, rare): rare holds RARE_BYTES of the hash of each of the rarest elements of a set of a long run, else null."""
    context = docs.sparkSession.sparkContext
    often, bits = context.broadcast(rarity(counts)), context.broadcast(wanted_bits(crowd))

    def encode(ids, values, offsets, h):
        rank = np.frombuffer(often.value, np.int32)[(values & np.uint64(RARITY_SLOTS - 1)).astype(np.int64)]
        words = np.frombuffer(bits.value, np.int64).view(np.uint64)
        crowded = ((words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1).tolist()
        sketches, rare = [], []
        for a, b, c in zip(offsets[:-1].tolist(), offsets[1:].tolist(), crowded, strict=True):
            v = values[a:b]
            sketches.append(sketch(v))
            first = np.argsort(rank[a:b], kind="stable")[: asking(b - a)] if c and b > a else None
            rare.append(None if first is None else planes(mix(v[first] ^ K1), RARE_BYTES))
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(sketches, pa.binary()), pa.array(rare, pa.binary())], names=["node", "size", "sketch", "rare"])

    return written(of_nodes(docs, nodes, encode, "node long, size long, sketch binary, rare binary"), "sketches")


def rare_groups(sketches: DataFrame, found: DataFrame, buckets: int, short_run: int = SHORT_RUN) -> DataFrame:
    """(kind, a, b, c): kind 1 a pair; kind 2 long group, document, twice its size plus 1 if it may be the smaller of a pair.

    Only groups and pairs of different components of ``found`` (node, component).
    """
    sets = sketches.where("rare IS NOT NULL").select("node", "size", "rare").join(found, "node", "left").select("node", "size", "rare", F.coalesce("component", "node").alias("component"))

    def pack(batches):
        for batch in slices(batches, "rare", 4 * SLICE):
            nodes, sizes, labels = (batch[c].to_numpy() for c in ("node", "size", "component"))
            raw = batch["rare"].to_pylist()
            counts = np.array([len(r) // RARE_BYTES for r in raw], np.int64)
            if not counts.sum():
                continue
            element = np.concatenate([unplanes(r, n, RARE_BYTES) for r, n in zip(raw, counts.tolist(), strict=True)])
            owner = np.repeat(np.arange(len(raw)), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            flag = (place < asked(sizes[owner])).astype(np.int64)
            bucket = (mix(element) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort((bucket << 32) + np.arange(len(bucket)))
            element, owner, flag, bucket = element[order], owner[order], flag[order], bucket[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            u = lambda x: x.view(np.uint64)
            parts = [(int(bucket[a]), b - a, planes(element[a:b], RARE_BYTES), planes(u(nodes[owner[a:b]]), 8) + planes(u(labels[owner[a:b]]), 8), planes(u(sizes[owner[a:b]] * 2 + flag[a:b]), 5)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), TYPES, strict=True)], names=NAMES)

    def match(parts):
        element = np.concatenate([unplanes(p[1], p[0], RARE_BYTES) for p in parts])
        doc, label = (np.concatenate([unplanes(p[2][k * 8 * p[0] : (k + 1) * 8 * p[0]], p[0], 8) for p in parts]).view(np.int64) for k in range(2))
        info = np.concatenate([unplanes(p[3], p[0], 5) for p in parts]).view(np.int64)
        order = np.argsort(element)
        element, doc, label, info = element[order], doc[order], label[order], info[order]
        first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(element))))
        live = (np.minimum.reduceat(label, first) < np.maximum.reduceat(label, first)) & (np.bincount(run, info & 1) > 0)
        keep = np.flatnonzero(live[run])
        if not len(keep):
            return
        keep = keep[np.lexsort((doc[keep], run[keep]))]
        run, doc, label, info = run[keep], doc[keep], label[keep], info[keep]
        size, length, pairs = info >> 1, np.bincount(run)[run], []
        for d in range(1, max(2, short_run)):
            i = np.flatnonzero((run[d:] == run[:-d]) & (length[d:] <= short_run))
            j = i + d
            ok = (label[i] != label[j]) & (info[i] & 1 | info[j] & 1 > 0) & linked_sizes(size[i], size[j])
            pairs.append(np.stack([doc[i[ok]], doc[j[ok]]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        yield _rows(1, pairs[:, 0], pairs[:, 1], pairs[:, 0])
        long = np.flatnonzero(length > short_run)
        if len(long):  # groups that hold the same documents count once
            key = np.zeros(int(run.max()) + 1, np.uint64)
            np.add.at(key, run[long], mix(doc[long].view(np.uint64) * np.uint64(2) + (info[long] & 1).view(np.uint64)))
            once, ids = np.zeros(len(key), bool), np.unique(run[long])
            once[ids[np.unique(key[ids], return_index=True)[1]]] = True
            long = long[once[run[long]]]
            yield _rows(2, mix(key ^ K1)[run[long]].view(np.int64), doc[long], info[long])

    def match_all(batches):
        held, at = [], None
        for batch in batches:
            for bucket, *part in zip(*(batch[c].to_pylist() for c in NAMES), strict=True):
                if bucket != at and held:
                    yield from match(held)
                    held = []
                at = bucket
                held.append(part)
        if held:
            yield from match(held)

    spread = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(sets.mapInArrow(pack, BUNDLE).repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(match_all, "kind int, a long, b long, c long"), "groups")


def packed_set(values: np.ndarray) -> bytes:
    """ELEMENT_BITS of each of the sorted elements, as steps from one to the next, byte by byte."""
    top = values >> np.uint64(64 - ELEMENT_BITS)
    return planes(np.diff(top, prepend=np.uint64(0)), ELEMENT_BITS // 8)


def unpacked_set(data: bytes) -> np.ndarray:
    n = ELEMENT_BITS // 8
    return np.cumsum(unplanes(data, len(data) // n, n), dtype=np.uint64)


def sets_for(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    def encode(ids, values, offsets, _):
        raw = [packed_set(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(raw, pa.binary())], names=["node", "elements"])

    return of_nodes(docs, nodes, encode, "node long, elements binary")


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches don't rule a link out; a written table."""
    one = sketches.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("s"))
    two = sketches.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("t"))

    def run(batches):
        for batch in batches:
            keep = []
            for m, s, n, t in zip(*(batch[c].to_pylist() for c in ("m", "s", "n", "t")), strict=True):
                size = min(len(s), len(t))
                x, y = (folded(np.frombuffer(v, np.uint8)[None], size) for v in (s, t))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= most_apart(m, n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long"), "pairs")


CELL = "cell long, kind int, a long, b long, label long, elements binary"


def in_cells(cells: DataFrame, check, unpacked) -> DataFrame:
    """(a, b) from ``check(members, pairs)`` over the rows of each cell; a cell's rows are bounded by its making."""

    def run(batches):
        at, members, pairs = None, {}, []
        for batch in batches:
            for cell, kind, a, b, label, elements in zip(*(batch[c].to_pylist() for c in ("cell", "kind", "a", "b", "label", "elements")), strict=True):
                if cell != at:
                    if members:
                        yield from check(members, pairs)
                    at, members, pairs = cell, {}, []
                if elements is None:
                    pairs.append((a, b))
                else:
                    members[kind, a] = (unpacked(elements), label, b)
        if members:
            yield from check(members, pairs)

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "kind").mapInArrow(run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return both * (P + Q) >= P * (a + b)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def check_pairs(members: dict, pairs: list):
    a, b = [], []
    for x, y in pairs:
        u, v = members[0, x][0], members[0, y][0]
        if len(u) > len(v):
            u, v = v, u
        k = np.searchsorted(v, u)
        k[k == len(v)] = 0
        if linked(len(u), len(v), int((v[k] == u).sum())):
            a.append(x)
            b.append(y)
    yield _links(a, b)


def check_blocks(members: dict, _pairs: list):
    """Pairs of a probe (kind 0) and a document (kind 1) of different components whose sketches don't rule a link out."""
    by_width: dict[int, list] = {}
    for (kind, x), (raw, label, size) in members.items():
        if kind:
            by_width.setdefault(raw.nbytes, []).append((x, label, size, raw.view(np.uint8)))
    right = {n: (np.stack([r[3] for r in rows]), *(np.array([r[k] for r in rows]) for k in range(3))) for n, rows in by_width.items()}
    for (kind, x), (raw, label, size) in members.items():
        if kind:
            continue
        for n, (stacked, ids, labels, sizes) in right.items():
            ok = np.flatnonzero((labels != label) & (ids != x) & linked_sizes(sizes, np.int64(size)))
            if len(ok):
                width = min(n, raw.nbytes)
                apart = np.bitwise_count(folded(stacked[ok], width) ^ folded(raw.view(np.uint8)[None], width)).sum(1, dtype=np.int64)
                j = ids[ok[apart <= (sizes[ok] + size) * (Q - P) // (Q + P)]]
                if len(j):
                    yield _links(np.minimum(x, j), np.maximum(x, j))


def verified_pairs(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of a written table of pairs. Those of one neighbourhood meet in a cell; large ones are split by hash."""
    sets = sets_for(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b")
    # Grouped tables are written before they are joined, so that a join's hot keys can be split at run time.
    home = written(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("home")), "homes")
    at = written(pairs.join(home, "a"), "pairs")
    wide = F.greatest(F.ceil(F.approx_count_distinct("b") / BLOCK_DOCS), F.ceil(F.sqrt(F.count(F.lit(1)) / BLOCK_PAIRS)))
    width = at.groupBy("home").agg(wide.alias("width")).where("width > 1")
    at = at.join(written(width, "widths"), "home", "left").withColumn("width", F.coalesce("width", F.lit(1)))  # large homes only, so few rows
    place = lambda c: F.pmod(F.xxhash64(c), F.col("width"))
    at = written(at.select(F.xxhash64("home", place("a"), place("b")).alias("cell"), "a", "b"), "pairs")
    needed = at.select("cell", F.col("a").alias("node")).union(at.select("cell", "b")).distinct()
    empty = F.lit(None).cast("binary").alias("elements")
    rows = needed.join(sets, "node").select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("label"), "elements")
    return in_cells(rows.union(at.select("cell", F.lit(1), "a", "b", F.lit(0).cast("long"), empty)), check_pairs, unpacked_set)


def open_pairs(runs: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of one long run that ``found`` (node, component) leaves in different components; a written table."""
    docs = runs.groupBy(F.col("doc").alias("node")).agg(F.first("size").alias("size"), F.max("probe").alias("probe"))
    # Written after each few joins, as what is read twice stands twice in a plan, and the driver holds the plans.
    docs = written(docs.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    large = docs.groupBy("component").count().where(F.col("count") >= LARGE_CLASS).select("component", F.col("component").alias("class"))
    docs = docs.join(large, "component", "left").withColumn("class", F.coalesce("class", F.lit(-1).cast("long")))
    docs = docs.withColumn("bin", F.floor(F.log("size") / np.log(1.15)).cast("int"))
    # The smallest document within a few runs names the neighbourhood, so that few blocks meet in one run.
    group = runs.select(F.col("doc").alias("node"), F.col("doc").alias("group")).distinct()
    for _ in range(2):
        near = written(runs.join(group, runs["doc"] == group["node"]).groupBy("run").agg(F.min("group").alias("low")), "near")
        group = runs.join(near, "run").groupBy(F.col("doc").alias("node")).agg(F.min("low").alias("group"))
    docs = written(docs.join(group, "node"), "members")
    keys = ["group", "class", "bin"]
    crowd = docs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS).alias("parts"), F.ceil(F.sum("probe") / BLOCK_DOCS).alias("few"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)))
    docs = docs.join(crowd, keys).withColumn("block", F.xxhash64(F.lit(0), *keys, place("parts"))).withColumn("probes", F.xxhash64(F.lit(1), *keys, place("few")))
    docs = written(docs.select("node", "component", "probe", "block", "probes", "class", "bin"), "blocks")
    met = runs.select("run", F.col("doc").alias("node"), F.col("probe").alias("asks")).join(docs, "node")
    part = lambda c: F.struct(F.col(c).alias("block"), "class", "bin")
    mixed = met.groupBy("run").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.collect_set(F.when(F.col("asks") == 1, part("probes"))).alias("left"), F.collect_set(part("block")).alias("right")
    ).where("x <> y")
    cells = mixed.select("right", F.explode("left").alias("p")).select("p", F.explode("right").alias("q")).where("NOT (p.class >= 0 AND p.class = q.class) AND abs(p.bin - q.bin) <= 3")
    cells = cells.select(F.col("p.block").alias("p"), F.col("q.block").alias("q")).distinct()
    cells = written(cells.withColumn("cell", F.xxhash64("p", "q")), "cells")
    sides = docs.where("probe = 1").select("node", "component", F.col("probes").alias("p")).join(cells, "p").select("cell", F.lit(0).alias("kind"), "node", "component")
    sides = sides.union(docs.select("node", "component", F.col("block").alias("q")).join(cells, "q").select("cell", F.lit(1), "node", "component"))
    rows = sides.join(sketches, "node").select("cell", "kind", F.col("node").alias("a"), F.col("size").alias("b"), F.col("component").alias("label"), F.col("sketch").alias("elements"))
    return written(in_cells(rows, check_blocks, lambda x: np.frombuffer(x, np.uint64)).distinct(), "pairs")


def similarity_classes(docs: DataFrame, short_run: int = SHORT_RUN) -> DataFrame:
    """(doc_id, n_shingles, component_id) for a table of doc_id and text; other columns are ignored.

    Words are runs of non-white ASCII-lowered characters; a set holds the distinct 5-word shingles, or the whole
    sequence where there are fewer words. Null, empty and wordless texts have size 0 and stand alone. Linked texts and
    whatever links reach share the smallest doc_id. A repeated doc_id gives a row each time. A null doc_id is left
    out of the join and returned with its set's size as its own class, a null component. An empty table gives no rows.
    """
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    buckets = max(64, 4 * known.rdd.getNumPartitions())
    bundles = bundled(known, buckets).withColumn("at", F.when(F.col("bucket") == -1, -1 - F.spark_partition_id()).otherwise(F.col("bucket")))
    stage = written(candidates(bundles.repartition(spread, "at").sortWithinPartitions("bucket").select(*NAMES), short_run), "candidates")
    members = stage.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    pairs = stage.where("kind = 1").select("a", "b").distinct()
    crowd = stage.where("kind = 2").select(F.col("a").alias("node")).distinct()
    nodes = stage.where("kind = 1").select(F.explode(F.array("a", "b")).alias("node")).union(crowd)
    sketches = sketches_for(known, nodes, crowd, stage.where("kind = 3").select("a", "b"))
    freed(docs.sparkSession)
    found = components(written(verified_pairs(near_pairs(pairs, sketches), known), "links"))
    freed(docs.sparkSession)
    groups = rare_groups(sketches, found, buckets, short_run)
    runs = groups.where("kind = 2").select(F.col("a").alias("run"), F.col("b").alias("doc"), F.expr("c div 2").alias("size"), (F.col("c") % 2).alias("probe"))
    rest = near_pairs(groups.where("kind = 1").select("a", "b").distinct(), sketches).union(open_pairs(runs, found, sketches)).distinct()
    rest = written(rest, "pairs")
    freed(docs.sparkSession)
    found = extended_components(found, written(verified_pairs(rest, known), "links"))
    freed(docs.sparkSession)
    named = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # Copies in one task share a node that need not be their class's smallest document.
    low = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = named.join(low, "component").select("doc_id", "n_shingles", "component_id")
    return out.union(sizes_without_id(docs.where("doc_id IS NULL").select("doc_id", "text")))


def sizes_without_id(docs: DataFrame) -> DataFrame:
    def run(batches):
        cache = WordHashes()
        for batch in slices(batches, limit=SLICE):
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(np.diff(sets_of(_words(batch), cache)[1])), none], names=["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def op6_jaccard_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return similarity_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(low) AS low FROM r GROUP BY node) c ON c.node = w.doc_id
"""
