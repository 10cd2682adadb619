"""Quality rules: counts over whole texts, then tokeniser fertility with bands per language or script.

Two public vocabularies are measured: characters per token and token entropy with a byte-level BPE for many
languages, characters per token and byte-fallback share with a piece BPE. A text outside its band is rejected. Bands
of characters per token and per piece lie around the median of the input's own texts of that language or script.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder, slices
from .common import bounded_batches, table, written
from .words import ODD, inside, mix, windows

LEVEL_VOCABULARY = "byte_bpe_multi_50k"
PIECE_VOCABULARY = "piece_bpe_32k"
#: Lowest and highest characters per token, and highest byte-fallback share, by language, else by the
#: script of most letters. The lowest characters per token hold only where fewer than MIN_TEXTS texts of MIN_TOKENS tokens
#: or more pass the base rules; else the medians of those do.
BANDS = {
    "en": (2.05, 7.5, 0.15), "de": (2.1, 7.5, 0.15), "fr": (1.95, 7.5, 0.15), "es": (1.95, 7.5, 0.15),
    "Latin": (1.6, 7.5, 0.25), "Greek": (0.7, 5.0, 0.6), "Cyrillic": (0.9, 6.0, 0.4), "Hebrew": (0.5, 4.0, 0.8), "Arabic": (0.6, 5.0, 0.8),
    "Devanagari": (0.3, 4.0, 0.9), "Thai": (0.3, 4.0, 0.95), "Kana": (0.4, 3.0, 0.8), "Han": (0.3, 2.5, 0.9), "Hangul": (0.3, 3.0, 0.9), "other": (0.2, 8.0, 1.0),
}
MIN_TOKENS = 64
MIN_TEXTS = 30
#: Distances from a median, in natural logarithms: NEAREST is a quarter more tokens for as many characters; where texts
#: differ more, SIGMAS standard deviations (by the median absolute deviation). Above the median, twice as far.
NEAREST, SIGMAS = float(np.log(1.25)), 3.0
#: A band is wider by sqrt(1 + SHORT / tokens), as a mean over fewer tokens spreads more.
SHORT = 64
BINS = 200  # of the logarithm, for each power of e
#: Bits of token entropy: at least the smaller of the first and the second times log2 of the tokens.
MIN_ENTROPY, ENTROPY_SHARE, MAX_ENTROPY = 4.5, 0.62, 13.0
#: First code points of blocks and their scripts.
BLOCKS = [
    (0x0, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xC0, "Latin"), (0x250, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, ""), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x700, ""), (0x900, "Devanagari"), (0x980, ""), (0xE00, "Thai"), (0xE80, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""),
    (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x323B0, ""),
]
SCRIPTS = sorted({s for _, s in BLOCKS if s})
_STARTS = np.array([b for b, _ in BLOCKS])
_SCRIPT = np.array([SCRIPTS.index(s) if s else len(SCRIPTS) for _, s in BLOCKS])
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "chars_per_token", "chars_per_piece", "byte_share", "token_entropy", "kept"]
BLANK = " \t\n\x0b\x0c\r"

SLICE = 1_000_000
UNITS, UNIT_CHARS = 400_000, 16_000_000


@lru_cache(maxsize=1)
def pieces():
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public.path(f"{PIECE_VOCABULARY}.model"))
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def script(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_SCRIPT[np.searchsorted(_STARTS, points, "right") - 1], minlength=len(SCRIPTS) + 1)[:-1]
    return SCRIPTS[int(counts.argmax())] if counts.any() else "other"


def measured(length: int, ids: np.ndarray, n_pieces: int, n_bytes: int) -> tuple[float, float, float, float, int]:
    """(characters per token, characters per piece, byte-fallback share, token entropy, tokens); zeros without tokens."""
    if not len(ids):
        return 0.0, 0.0, 0.0, 0.0, 0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    return length / len(ids), length / max(1, n_pieces), n_bytes / n_pieces if n_pieces else 0.0, abs(entropy), len(ids)


def fertility(text: str) -> tuple[float, float, float, float, int]:
    """``measured`` of a whole text by both vocabularies."""
    ids = np.frombuffer(encoder(LEVEL_VOCABULARY).encode(text), "<u4")
    model, is_byte = pieces()
    found = np.array(model.encode(text, num_threads=1), np.int64)
    return measured(len(text), ids, len(found), int(is_byte[found].sum()))


class Units(dict):
    """Codes of what stands between single spaces, and by code its tokens, pieces, byte pieces and word hashes.

    Neither vocabulary merges across a space that follows something else than white space or ``▁``, so the sums over the units of such a text
    are those of the whole text. A unit is measured once, until ``UNITS`` of them or ``UNIT_CHARS`` have gathered.
    """

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.chars = 0
        self.n_ids, self.n_pieces, self.n_bytes, self.n_words = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.words = np.zeros(0, np.uint32), np.zeros(0, np.uint64)

    def __missing__(self, unit: str) -> int:
        self[unit] = code = len(self)
        self.fresh.append(unit)
        return code

    def codes(self, texts: list[list[str]]) -> np.ndarray:
        """The codes of all units in order; every one of them is measured."""
        if len(self) > UNITS or self.chars > UNIT_CHARS:
            self.reset()
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64)
        fresh, self.fresh = self.fresh, []
        if fresh:
            level = encoder(LEVEL_VOCABULARY)
            model, is_byte = pieces()
            ids = [level.ids(" " + u) for u in fresh]
            found = model.encode(fresh, num_threads=1)
            words = [u.encode().split() for u in fresh]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            byte_pieces = np.concatenate([[0], np.cumsum(is_byte[np.fromiter(chain.from_iterable(found), np.int64)])])
            ends = np.cumsum(sizes)
            self.n_ids = np.concatenate([self.n_ids, np.fromiter(map(len, ids), np.int64, len(ids))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32)])
            self.n_pieces = np.concatenate([self.n_pieces, sizes])
            self.n_bytes = np.concatenate([self.n_bytes, byte_pieces[ends] - byte_pieces[ends - sizes]])
            self.n_words = np.concatenate([self.n_words, np.fromiter(map(len, words), np.int64, len(words))])
            self.words = np.concatenate([self.words, np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64)])
            self.chars += sum(map(len, fresh))
        return out


def gathered(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of the given sizes, by code) that belong to ``codes``, in their order."""
    n = sizes[codes]
    return values[np.repeat(np.cumsum(sizes)[codes] - np.cumsum(n), n) + np.arange(n.sum())]


def counted(texts: list[str], units: Units) -> tuple[np.ndarray, np.ndarray, list]:
    """(hashes of all words, their offsets by text, ``fertility`` of each text)."""
    level = encoder(LEVEL_VOCABULARY)
    # Where white space or the pieces' own sign for a space stands before a space, the space doesn't always start a
    # token: such texts are measured whole.
    even = [not t.startswith(" ") and "▁" not in t and not level.uneven(t) for t in texts]
    split = [t.split(" ") if e else [w.decode() for w in t.encode().split()] for t, e in zip(texts, even, strict=True)]
    codes = units.codes(split)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])

    def before(sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes[codes])])[at]

    words, offsets = gathered(units.words, units.n_words, codes), before(units.n_words)
    ids, id_at = gathered(units.ids, units.n_ids, codes), before(units.n_ids)
    n_pieces, n_bytes = np.diff(before(units.n_pieces)), np.diff(before(units.n_bytes))
    measures = []
    for k, t in enumerate(texts):
        if even[k] and t:
            skip = id_at[k] + units.n_ids[codes[at[k]]]  # the first unit has no space before it
            first = np.array(level.ids(split[k][0]), np.uint32)
            measures.append(measured(len(t), np.concatenate([first, ids[skip : id_at[k + 1]]]), int(n_pieces[k]), int(n_bytes[k])))
        else:
            measures.append(fertility(t))
    return words, offsets, measures


def centre(bins: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Median of the logarithms in a histogram, and the distance from it that a band takes."""

    def median(x: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        return float(x[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])

    middle = median(bins / BINS)
    return middle, max(NEAREST, SIGMAS * 1.4826 * median(abs(bins / BINS - middle)))


def centres(measures: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """By band, the median and the distance of characters per token and then per piece, over all texts of ``measures``.

    The driver gets counts by band and bin of the logarithm, not rows of texts; bins lie within -10 and 10.
    """
    bin_of = lambda c: F.round(F.least(F.greatest(F.log(c), F.lit(-10.0)), F.lit(10.0)) * BINS).cast("int")
    counts = (
        measures.where(~F.col("base_failed") & (F.col("n_tokens") >= MIN_TOKENS))
        .select("band", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bin_of(c).alias("bin")) for k, c in enumerate(("chars_per_token", "chars_per_piece"))])).alias("x"))
        .groupBy("band", "x.k", "x.bin").count().collect()
    )
    out = {}
    for band in {r["band"] for r in counts}:
        own = [np.array(sorted((r["bin"], r["count"]) for r in counts if r["band"] == band and r["k"] == k)).T for k in (0, 1)]
        if own[0][1].sum() >= MIN_TEXTS:
            out[band] = (*centre(*own[0]), *centre(*own[1]))
    return out


def in_band(found: dict[str, tuple[float, float, float, float]]) -> Column:
    """Whether the measures of a row lie in its band."""
    limits = F.create_map(*chain.from_iterable((F.lit(b), F.array(*map(F.lit, map(float, v)))) for b, v in BANDS.items()))[F.col("band")]
    n, per_token, per_piece = F.col("n_tokens"), F.col("chars_per_token"), F.col("chars_per_piece")
    wider = F.sqrt(1 + SHORT / F.greatest(n, F.lit(1)))
    room = F.exp(NEAREST * (wider - 1))
    least = per_token >= limits[0] / room
    if found:
        own = F.create_map(*chain.from_iterable((F.lit(b), F.array(*map(F.lit, v))) for b, v in found.items()))[F.col("band")]
        near = lambda c, k: (F.log(c) - own[k]).between(-own[k + 1] * wider, 2 * own[k + 1] * wider)
        least = F.when(own.isNull(), least).otherwise(near(per_token, 0) & near(per_piece, 2))
    entropy = F.col("token_entropy").between(F.least(F.lit(MIN_ENTROPY), ENTROPY_SHARE * F.log2(n)) / wider, F.lit(MAX_ENTROPY))
    return F.coalesce(least & (per_token <= limits[1] * room) & (per_piece <= limits[1] * room) & (F.col("byte_share") <= limits[2] * wider) & entropy, F.lit(False))


def repeated_words(h: np.ndarray, offsets: np.ndarray, n: int = 5) -> np.ndarray:
    """By document, the words inside windows of n words found twice or more in that document."""
    at = inside(offsets, n, len(h))
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not len(at):
        return counts
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(windows(h, n)[at] + doc[at].astype(np.uint64) * ODD)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    edge[at[twice]] += 1  # starts are distinct
    edge[at[twice] + n] -= 1
    hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return hit[offsets[1:]] - hit[offsets[:-1]]


def dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, passed: list[str]) -> DataFrame:
    """The columns ``passed`` of ``docs``, those of ``NEW`` but ``kept``, n_tokens, and the name of the text's band."""
    has_lang = "lang" in docs.columns
    docs = docs.select(*dict.fromkeys([*passed, "text", *["lang"] * has_lang]))

    def run(batches):
        units = Units()
        for batch in slices(batches, limit=SLICE):
            texts = [t or "" for t in batch["text"].to_pylist()]
            langs = batch["lang"].to_pylist() if has_lang else [None] * len(texts)
            data = [t.encode() for t in texts]
            h, offsets, found = counted(texts, units)
            n_words, repeats = np.diff(offsets), repeated_words(h, offsets)
            columns = [
                pa.array(n_words),
                pa.array([len(t) - sum(map(t.count, BLANK)) for t in texts], pa.int64()),
                pa.array([len(b) - len(b.translate(None, b"#*$%&|<>")) for b in data], pa.int64()),
                pa.array(map(dup_lines, texts), pa.int64()),
                pa.array(repeats), pa.array((n_words < 10) | (100 * repeats > 20 * n_words)),
                *[pa.array([m[k] for m in found], pa.float64()) for k in range(4)],
                pa.array([m[4] for m in found], pa.int64()), pa.array([lang if lang in BANDS else script(t) for lang, t in zip(langs, texts, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in passed], *columns], names=[*passed, *NEW[:-1], "n_tokens", "band"])
        encoder(LEVEL_VOCABULARY).cache.forget()  # the worker may go on with another stage

    ddl = ", ".join(f"{c} {'boolean' if c == 'base_failed' else 'long' if k < 5 else 'double'}" for k, c in enumerate(NEW[:-1]))
    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in passed], *T.StructType.fromDDL(f"{ddl}, n_tokens long, band string")]))


def judged(measured: DataFrame, found: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    return measured.withColumn("kept", ~F.col("base_failed") & in_band(found)).drop("n_tokens", "band")


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` (text, and lang where there is one) with the columns of ``NEW``.

    Null text counts as empty: no words, so it fails the base rules. Null or unknown languages take the band of the
    script with most letters, texts without letters the band ``other``. Repeated rows get the same verdict; columns
    with the new names are replaced; an empty table gives no rows. Texts are measured twice, first for the medians of
    the bands, so that they needn't be written between.
    """
    docs = docs.drop(*NEW)
    aside = {}  # columns of docs whose names the measures need, under names that nothing has
    for c in (c for c in docs.columns if c.lower() in ("n_tokens", "band")):
        aside[c] = next(n for k in count() if (n := f"{c}_{k}") not in docs.columns)
    docs = docs.withColumnsRenamed(aside)
    return judged(measures(docs, docs.columns), centres(measures(docs, []))).withColumnsRenamed({v: k for k, v in aside.items()})


def op9_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    measured = written(measures(table(spark, sf_dir, "documents"), ["doc_id"]), "measures")
    return judged(measured, centres(measured)).select("doc_id", *NEW)
