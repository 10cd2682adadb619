"""Exact byte-level BPE over whole texts, with tree concatenation for text that no boundary splits.

Text is cut where the tokenizer itself always cuts, before white space that follows something else. A piece longer
than ``LEAF`` is split by the tokenizer's own pattern, and a pre-token that is still longer is halved down to leaves;
the leaves are encoded in parallel and joined pairwise. A join re-encodes a window around it that doubles until the
window's first token is the left side's token there and its last token the right side's: BPE output is canonical if
and only if each pair of neighbours is, so agreement at both ends proves the joined sequence.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, extended, table

VOCABULARY = "byte_bpe_50k"
LEAF = 4096
CACHE_ENTRIES = 250_000
SLICE_CHARS = 3_000_000
SLAB_BYTES = 16_000_000
SPECIAL = "<|endoftext|>"
#: The code points with Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY, leaf: int = LEAF) -> Encoder:
    """One for each Python worker."""
    return Encoder(name, leaf)


class Generations(dict):
    """Values of ``make``, remembered for about the last one to two times CACHE_ENTRIES keys."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces(dict):
    """Codes of the pieces of many texts, and the ids of each piece in flat arrays.

    Texts are cut where the tokenizer always cuts, so a text's ids are those of its pieces in order. A key is what
    follows a space, or a space and then a piece that has none of its own before it. A piece is encoded once, until
    ``PIECES`` of them or ``PIECE_CHARS`` have gathered: new ones of the first kind as a text of ``JOINED`` of them,
    whose ids the bytes of each id (``lengths``) deal out again, others and long ones alone.
    """

    PIECES, PIECE_CHARS, JOINED = 400_000, 16_000_000, 256

    def __init__(self, encode_one, encode_many, lengths: np.ndarray, leaf: int = LEAF):
        self.encode_one, self.encode_many, self.lengths, self.leaf = encode_one, encode_many, lengths, leaf
        self.cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.uneven = re.compile(f"[{WHITE}] | $").search  # then a space doesn't always start a piece
        self.white = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.chars = 0
        self.sizes, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, key: str | int) -> int:
        self[key] = code = len(self)
        self.new.append(key)
        return code

    def keys_of(self, text: str) -> list[str]:
        if self.uneven(text):
            return [" " + p for p in self.cut(text)]
        first, *rest = text.split(" ")
        return [" " + first, *rest] if first else rest

    def encode_new(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys, how many each has)."""
        sizes, parts, k = np.empty(len(keys), np.int64), [], 0
        alone = [isinstance(x, int) or not x or x[0] == " " or len(x) > self.leaf or x[-1] in self.white for x in keys]
        while k < len(keys):
            if alone[k]:
                x = keys[k]
                ids = np.array([x] if isinstance(x, int) else self.encode_one(x[1:] if x[:1] == " " else " " + x), np.uint32)
                sizes[k] = len(ids)
                parts.append(ids)
                k += 1
                continue
            j = k
            while j < len(keys) and j - k < self.JOINED and not alone[j]:
                j += 1
            text = " " + " ".join(keys[k:j])
            ids = np.array(self.encode_many(text), np.uint32)
            ends = np.cumsum(self.lengths[ids])
            wanted = np.cumsum(np.fromiter(map(len, map(str.encode, keys[k:j])), np.int64, j - k) + 1)
            at = np.searchsorted(ends, wanted)
            if len(ids) == 0 or not (ends[at] == wanted).all():
                raise ValueError("a token goes over the end of a piece")
            sizes[k:j] = np.diff(at, prepend=-1)
            parts.append(ids)
            k = j
        return np.concatenate(parts), sizes

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); ``end`` follows each text."""
        if len(self) > self.PIECES or self.chars > self.PIECE_CHARS:
            self.reset()
        last = [] if end is None else [end]
        keys = [[*(self.keys_of(t) if t else ()), *last] for t in texts]
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(keys)), np.int64)
        new, self.new = self.new, []
        if new:
            ids, sizes = self.encode_new(new)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.chars += sum(len(k) for k in new if isinstance(k, str))
        n = self.sizes[codes]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        before = np.concatenate([[0], ends])
        return self.ids[at], before[np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))]


@lru_cache(maxsize=2)
def library_pieces(name: str = VOCABULARY) -> Pieces:
    """One for each Python worker, over the tokenizers library itself."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    library = Tokenizer.from_file(public.path(f"{name}.json"))
    library.no_padding()
    library.no_truncation()
    lengths = np.zeros(library.get_vocab_size(), np.int64)
    for token, i in library.get_vocab().items():
        lengths[i] = len(token)  # one character stands for one byte
    encode = lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids
    return Pieces(encode, encode, lengths)


class Words:
    """Ids of many texts by the tokenizers library, whose words are found in Arrow and encoded once.

    A text is cut at its spaces; a key is what follows a space, or a space and then a text's first word. A key of
    letters, with a mark after them, a line's end and more letters, is parts that the tokenizer always cuts: words and
    single bytes. New words go to the library's model many at a time without its search for pre-tokens, and the bytes of
    each id (``lengths``) deal the ids out again. All other keys, and texts in which a space doesn't always start a
    piece, take the way of ``Pieces``. Up to ``KEYS`` of them or ``KEY_IDS`` are remembered.
    """

    KEYS, KEY_IDS, JOINED = 700_000, 16_000_000, 128
    #: Letters in every version of Unicode, of which no merge joins one with a space or a line's end after it.
    LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
    PARTS = f"^(?P<bare> ?)(?P<a>[{LETTERS}]+)(?P<b>[.,;:!?]?)(?P<c>\\n?)(?:(?P<d>[{LETTERS}]+)(?P<e>[.,;:!?]?))?$"
    SINGLE = pa.array(["", *".,;:!?\n"])

    def __init__(self, library, pieces: Pieces):
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(library.model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces, self.lengths = pieces, pieces.lengths
        self.singles = [pieces.encode_one(x) if x else [] for x in self.SINGLE.to_pylist()]
        self.uneven = f"[{WHITE}] | \\n?$"
        self.reset()

    def reset(self) -> None:
        self.keys, self.parts = Known(), Known()
        self.keys.add(pa.array(["", " "]), np.zeros(0), np.zeros(2))  # before a text that begins with a space, or is empty
        self.parts.add(self.SINGLE, np.concatenate(self.singles), np.array(list(map(len, self.singles))))

    def model_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); nothing that the tokenizer merges goes over a text's end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data, parts, counts = memoryview(texts.buffers()[2]), [], []
        for k in range(0, len(texts), self.JOINED):
            some = offsets[k : k + self.JOINED + 1]
            joined = str(data[some[0] : some[-1]], "utf-8")
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self.lengths[ids]), some[1:] - some[0]
            at = np.searchsorted(ends, wanted)
            if len(ids) == 0 or ends[-1] != wanted[-1] or not (ends[at] == wanted).all():
                raise ValueError("a token goes over the end of a piece")
            parts.append(ids)
            counts.append(np.diff(at, prepend=-1))
        return np.concatenate(parts), np.concatenate(counts)

    def add_parts(self, new: pa.Array) -> np.ndarray:
        spaced = pc.starts_with(new, " ")
        places = np.empty(len(new), np.int32)
        for here, over in ((spaced, 0), (pc.invert(spaced), 1)):
            some = new.filter(here)
            if len(some):
                # A line's end parts words without a space, and is an id of its own.
                ids, sizes = self.model_ids(pc.binary_join_element_wise(some, "\n", "") if over else some)
                if over:
                    keep = np.ones(len(ids), bool)
                    keep[np.cumsum(sizes) - 1] = False
                    ids, sizes = ids[keep], sizes - 1
                places[here.to_numpy(zero_copy_only=False)] = self.parts.add(some, ids, sizes)
        return places

    def add_keys(self, new: pa.Array) -> np.ndarray:
        places = np.empty(len(new), np.int32)
        found = pc.extract_regex(new, self.PARTS)
        plain = pc.is_valid(found)
        some, others = new.filter(plain), new.filter(pc.invert(plain))
        if len(some):
            bare, a, b, c, d, e = found.filter(plain).flatten()
            single = lambda x: pc.index_in(x, self.SINGLE).to_numpy()
            space = pc.if_else(pc.equal(bare, " "), "", " ")
            first = self.parts.codes_of(pc.binary_join_element_wise(space, a, ""), self.add_parts)
            has_d = pc.not_equal(d, "")
            second = np.zeros(len(d), np.int32)
            second[has_d.to_numpy(zero_copy_only=False)] = self.parts.codes_of(d.filter(has_d), self.add_parts)
            ids, ends = self.parts.ids_of(np.stack([first, single(b), single(c), second, single(e)], 1).ravel())
            places[plain.to_numpy(zero_copy_only=False)] = self.keys.add(some, ids, np.diff(ends[4::5], prepend=0))
        if len(others):
            places[~plain.to_numpy(zero_copy_only=False)] = self.keys.add(others, *self.pieces.encode_new(others.to_pylist()))
        return places

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); ``end`` follows each text, and null is empty."""
        if max(len(self.keys), len(self.parts)) > self.KEYS or max(len(self.keys.ids), len(self.parts.ids)) > self.KEY_IDS:
            self.reset()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pc.match_substring_regex(texts, self.uneven)
        odd = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        n, words = len(texts), lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
        offsets -= offsets[0]
        first = words.take(pa.array(offsets[:-1]))
        codes = self.keys.codes_of(pa.concat_arrays([words, pc.binary_join_element_wise("", first, " ")]), self.add_keys)
        codes[offsets[:-1]] = codes[len(words) :]
        codes = codes[: len(words)]
        ids, ends = self.keys.ids_of(codes)
        # Each text's ids move on by the ends of the texts before; texts of the other way take their places.
        ends = ends[offsets[1:] - 1] if n else np.zeros(0, np.int64)
        sizes = np.diff(ends, prepend=0)
        found, at = self.pieces.encode(texts.filter(apart).to_pylist())
        sizes[odd] = np.diff(at, prepend=0)
        whole = np.cumsum(sizes + 1)
        out = np.empty(int(whole[-1]) if n else 0, np.uint32)
        free = np.ones(len(out), bool)
        free[whole - 1] = False
        for k, stop in zip(odd.tolist(), at.tolist(), strict=True):
            here = slice(whole[k] - 1 - sizes[k], whole[k] - 1)
            out[here] = found[stop - sizes[k] : stop]
            free[here] = False
        out[free] = ids
        out[whole - 1] = end
        return out, whole


class Known:
    """Strings in the order of their codes, and the ids of each in one array."""

    def __init__(self):
        self.strings = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.strings)

    def add(self, strings: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The codes of the strings."""
        n = len(self)
        self.strings = pa.concat_arrays([self.strings, strings])
        self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        return np.arange(n, n + len(strings), dtype=np.int32)

    def codes_of(self, strings: pa.Array, add) -> np.ndarray:
        """Codes of the strings; ``add`` takes the distinct ones that aren't known and gives their codes."""
        found = pc.index_in(strings, self.strings)
        codes = np.array(pc.fill_null(found, -1))
        if found.null_count:
            unknown = pc.is_null(found)
            new = strings.filter(unknown).dictionary_encode()
            codes[unknown.to_numpy(zero_copy_only=False)] = add(new.dictionary)[new.indices.to_numpy()]
        return codes

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all codes in order, where those of each end)."""
        n = self.sizes[codes]
        ends = np.cumsum(n, dtype=np.int64)
        at = np.repeat((self.starts[codes] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], ends


@lru_cache(maxsize=1)
def library_words(name: str = VOCABULARY) -> Words:
    """One for each Python worker."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(public.path(f"{name}.json")), library_pieces(name))


class Encoder:
    def __init__(self, name: str = VOCABULARY, leaf: int = LEAF):
        import public_tokenizers as public
        import regex
        import tiktoken

        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = len(ranks)
        # The core's calls skip the argument checks of the public ones, which cost more than a short piece does.
        self.core = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: self.special})._core_bpe
        self.bytes_of = [b""] * (self.special + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b
        self.bytes_of[self.special] = SPECIAL.encode()
        self.pieces = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.pretokens = regex.compile(public.PATTERN).findall
        self.leaf = leaf
        self.uneven = re.compile(f"[{WHITE}] | $").search
        self.cache = Generations(lambda rest: self.piece(" " + rest))
        self.known = Pieces(self.ids, lambda text: self.core.encode(text, {SPECIAL}), np.fromiter(map(len, self.bytes_of), np.int64), leaf)
        self.pool = ThreadPoolExecutor(2)

    def raw(self, data: bytes) -> list[int]:
        """BPE of the bytes as one pre-token."""
        return self.core.encode_single_piece(data) if data else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 8
        while left and right:
            a, b = left[-k:], right[:k]
            window = self.raw(b"".join(map(self.bytes_of.__getitem__, a + b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2
        return left or right

    def tree(self, data: bytes) -> list[int]:
        """BPE of one long pre-token: halves down to leaves, encoded side by side and joined up the tree."""
        parts = [data]
        while max(map(len, parts)) > self.leaf:
            parts = [x for p in parts for x in (p[: len(p) // 2], p[len(p) // 2 :])]
        level = list(self.pool.map(self.raw, parts))
        while len(level) > 1:
            level = list(self.pool.map(self.join, level[::2], level[1::2]))  # a power of two, so pairs come out even
        return level[0]

    def piece(self, text: str) -> bytes:
        return np.array(self.ids(text), "<u4").tobytes()

    def ids(self, text: str) -> list[int]:
        """Ids of a text that ``pieces`` doesn't split."""
        if len(text) <= self.leaf:
            word = text[1:] if text[0] == " " else text
            return self.core.encode_single_piece(text.encode()) if word.isalpha() else self.core.encode(text, {SPECIAL})
        ids = []
        for i, part in enumerate(text.split(SPECIAL)):
            ids += [self.special] * (i > 0)
            for t in self.pretokens(part):
                ids += self.tree(data) if len(data := t.encode()) > self.leaf else self.raw(data)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.uneven(text):  # white space before a space: a space doesn't always start a piece
            return b"".join(map(self.piece, self.pieces(text)))
        first, *rest = text.split(" ")
        return (self.piece(first) if first else b"") + b"".join(map(self.cache.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds a bounded amount of text, or one row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def slabs(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLAB_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches joined until each holds about ``limit`` bytes of text, or all there is."""
    held, size = [], 0
    for batch in slices(batches, text):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch[text])).as_py() or 0
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    Null text counts as empty and has no ids. Rows are independent: repeats, ties and an empty table need no rule.
    Columns named ids or decoded are replaced; others stay.
    """
    docs = docs.drop("ids", "decoded")

    def run(batches):
        bpe = encoder(name)
        for batch in slices(batches):
            ids, ends = bpe.known.encode([t or "" for t in batch["text"].to_pylist()])
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            raw = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary()), pa.array(map(bpe.decode, raw), pa.string())], names=[*batch.schema.names, "ids", "decoded"]
            )
        bpe.known.reset()  # the worker may go on with another stage

    return docs.mapInArrow(run, extended(docs, "ids binary, decoded string"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
