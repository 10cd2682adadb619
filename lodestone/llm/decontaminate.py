"""Benchmark decontamination by an FM-index over the words of each training shard.

A shard is a bounded run of documents. Only words of the benchmark can be part of a hit, so a shard is indexed as
its maximal runs of such words, with a separator of its own after each run. The index keeps the Burrows-Wheeler
transform in a wavelet matrix, first positions of each symbol, and suffix positions sampled every SAMPLE words and at
run starts. All windows of the benchmark are searched backwards together.
"""

from __future__ import annotations

import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, extended, table, written

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES, GROUP_BLOCKS, KEPT_BLOCKS = 16_000_000, 8, 2
_WORD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return (text or "").encode().translate(_WORD).split()


class Ranked:
    """Bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.depth = max(1, int(sigma - 1).bit_length())
        for b in reversed(range(self.depth)):
            bits = (symbols >> b) & 1 == 1
            self.levels.append(Ranked(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        start = np.zeros_like(i)
        for k, level in enumerate(self.levels):
            one = (c >> (self.depth - 1 - k)) & 1 == 1
            r, s = level.rank(i), level.rank(start)
            i, start = np.where(one, self.zeros[k] + r, i - r), np.where(one, self.zeros[k] + s, start - s)
        return i - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, its occurrences before i)."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for k, level in enumerate(self.levels):
            one = level.get(i) == 1
            r, s = level.rank(i), level.rank(start)
            c = c * 2 + one
            i, start = np.where(one, self.zeros[k] + r, i - r), np.where(one, self.zeros[k] + s, start - s)
        return c, i - start


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; only suffixes that still tie are sorted again. The last symbol must be unique."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    new = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while not new.all():
        last = np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~(new & last))  # slots of groups of two or more
        at = order[tied]
        second = rank[at + h]  # ties end before the last symbol, so at + h is inside
        by = np.lexsort((second, rank[at]))
        at, second, first = at[by], second[by], rank[at][by]
        order[tied] = at
        new[tied[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[tied[0]] = True
        rank[at] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        h *= 2
    return order


class FMIndex:
    """Over a sequence of symbols 1..sigma-1 in runs; ``ends`` marks a separator (symbol 0) after each run."""

    def __init__(self, t: np.ndarray, sigma: int):
        n = len(t)
        ends = t == 0
        distinct = t + ends.sum()
        distinct[ends] = np.arange(ends.sum())  # separators differ, so no comparison goes past the end of a run
        sa = suffix_array(np.append(distinct, -1))[1:] if n else np.empty(0, np.int64)
        bwt = t[sa - 1] if n else t  # row of position 0 wraps to the last separator
        self.n = n
        self.matrix = WaveletMatrix(bwt, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma))])
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.marks, self.samples = Ranked(sampled), sa[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (a row per pattern, zeros on the left)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1] if len(patterns) else 0
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - 1 - k]
            lo[live] = self.first[c] + self.matrix.rank(c, lo[live])
            hi[live] = self.first[c] + self.matrix.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back to the nearest sampled suffix."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marks.get(rows[todo]) == 1
            done = todo[hit]
            out[done] = self.samples[self.marks.rank(rows[done])] + steps[done]
            todo = todo[~hit]
            c, before = self.matrix.access(rows[todo])
            rows[todo] = self.first[c] + before
            steps[todo] += 1
        return out


class Block:
    """A bounded part of the benchmark: its vocabulary and its distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[str, list[bytes]]]):
        self.vocabulary: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            for k in range(max(1, len(ids) - WINDOW + 1)):
                held.setdefault(tuple(ids[k : k + WINDOW]), set()).add(item)
        self.lengths = np.fromiter(map(len, held), np.int64, len(held))
        self.patterns = np.array([(0,) * (WINDOW - len(w)) + w for w in held], np.int64).reshape(len(held), WINDOW)
        self.items = [sorted(v) for v in held.values()]

    def hits(self, docs: list[list[bytes]], offsets: np.ndarray, mask: np.ndarray, found: list[set[str]]) -> None:
        """Marks hit words in ``mask`` and adds items to ``found`` for one shard."""
        get = self.vocabulary.get
        ids = np.fromiter((i for ws in docs for i in map(get, ws, repeat(0))), np.int64, int(offsets[-1]))
        doc = np.repeat(np.arange(len(docs)), np.diff(offsets))
        known = ids > 0
        starts = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])[: len(ids)]
        run = np.cumsum(starts)[known] - 1
        at = np.flatnonzero(known)
        long = np.bincount(run, minlength=1) >= self.lengths.min()
        at, run = at[long[run]], run[long[run]]
        if not len(at):
            return
        index = np.arange(len(at)) + np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
        t = np.zeros(index[-1] + 2, np.int64)
        t[index] = ids[at]
        place = np.zeros(len(t), np.int64)
        place[index] = at
        fm = FMIndex(t, len(self.vocabulary) + 1)
        lo, hi = fm.search(self.patterns, self.lengths)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        where = place[fm.locate(rows)]
        edge = np.zeros(len(mask) + 1, np.int64)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + self.lengths[which], -1)
        mask |= np.cumsum(edge)[:-1] > 0
        for d, w in np.unique(np.stack([doc[where], which], 1), axis=0).tolist():
            found[d].update(self.items[w])


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[bytes]:
    """The benchmark's items in compressed parts of BLOCK_BYTES of text, streamed to the driver a partition at a time."""
    held, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).toLocalIterator():
        if r[1]:
            held.append((r[0], r[1]))
            size += len(r[1])
        if size >= BLOCK_BYTES:
            yield zlib.compress(pickle.dumps(held), 1)
            held, size = [], 0
    if held:
        yield zlib.compress(pickle.dumps(held), 1)


@lru_cache(maxsize=KEPT_BLOCKS)
def block_of(key: tuple[str, int], load) -> Block | None:
    """A worker's index of one part, built from its broadcast; only the latest KEPT_BLOCKS stay."""
    items = [(i, ws) for i, t in pickle.loads(zlib.decompress(load.sent.value[key[1]])) if (ws := words(t))]
    return Block(items) if items else None


class Load:
    """Carries a broadcast past the cache's key."""

    def __init__(self, sent):
        self.sent = sent

    def __hash__(self):
        return 0

    def __eq__(self, other):
        return isinstance(other, Load)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids), spans (bytes of the UTF-8 text) and clean (text without them).

    A window is ``WINDOW`` consecutive words of an item, or the whole item where it is shorter. A document word
    inside any occurrence is hit; spans merge hit words that follow each other. Null text has no words and stays
    null in ``clean``; items without words have no windows; a null item id counts as the empty string; repeated
    items count once, as do repeated rows of ``docs`` apart. Very long texts are shards of their own. Columns with the
    new names are replaced, others stay.

    Parts of the benchmark go out as broadcasts, at most ``GROUP_BLOCKS`` (bounded by BLOCK_BYTES each) at a time: a
    larger benchmark takes several passes, between which hits are written with the documents.
    """
    added = ["n_words", "n_hit", "items", "spans", "clean"]
    docs = docs.drop(*added)
    own = next(p for k in range(len(docs.columns) + 1) if not any(c.startswith(p := f"_{k}_") for c in docs.columns))  # a prefix no column has
    context = docs.sparkSession.sparkContext
    parts = blocks(benchmark, item_id, item_text)
    state, group = docs, list(islice(parts, GROUP_BLOCKS))
    while True:
        later = list(islice(parts, GROUP_BLOCKS))
        sent = context.broadcast(group)
        out = marked(state, text, own, sent, len(group), docs.columns, None if later else added)
        if not later:
            return out
        state, group = written(out, "hits"), later
        sent.unpersist()


def marked(state: DataFrame, text: str, own: str, sent, n: int, columns: list[str], added: list[str] | None) -> DataFrame:
    """``state`` with the hit words (bits) and items of each document, added to those of an earlier pass; the last
    pass gives ``added`` instead."""
    names, token = [f"{own}mask", f"{own}items"], uuid.uuid4().hex
    before = names[0] in state.columns

    def run(batches):
        load = Load(sent)
        for batch in slices(batches, text):
            texts = batch[text].to_pylist()
            ws = [words(t) for t in texts]
            counts = np.fromiter(map(len, ws), np.int64, len(ws))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            mask, found = np.zeros(offsets[-1], bool), [set() for _ in ws]
            if before:
                found = [set(x) for x in batch[names[1]].to_pylist()]
                bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=k).view(bool) for m, k in zip(batch[names[0]].to_pylist(), counts.tolist(), strict=True)]
                mask = np.concatenate([mask[:0], *bits])
            for k in range(n):
                if (b := block_of((token, k), load)) is not None:
                    b.hits(ws, offsets, mask, found)
            kept, items = [batch[c] for c in columns], pa.array([sorted(f) for f in found], pa.list_(pa.string()))
            if added is None:
                raw = [np.packbits(mask[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.binary()), items], names=[*columns, *names])
                continue
            sums = np.concatenate([[0], np.cumsum(mask)])
            n_hit = sums[offsets[1:]] - sums[offsets[:-1]]
            spans, clean = [[] for _ in ws], texts
            for d in np.flatnonzero(n_hit):
                spans[d], clean[d] = removal(texts[d], mask[offsets[d] : offsets[d + 1]])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array(n_hit), items, pa.array(spans, SPANS), pa.array(clean, pa.string())], names=[*columns, *added])

    more = f"{names[0]} binary, {names[1]} array<string>" if added is None else "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, clean string"
    return state.mapInArrow(run, extended(state.select(*columns), more))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def removal(text: str, hit: np.ndarray) -> tuple[list[dict], str]:
    """Merged byte spans of hit words, and the text without them."""
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_WORD))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [(places[a][0], places[b - 1][1]) for a, b in edges.reshape(-1, 2)]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return [{"start": a, "end": b} for a, b in spans], b"".join([*kept, data[at:]]).decode()


def op1_decontaminate_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0),
y AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS k, least(10, len(w)) AS n FROM x),
l AS (SELECT DISTINCT n FROM y),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, y.item FROM p JOIN y ON p.k = y.k AND p.n = y.n),
s AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
