"""Histogram sort into shards of near equal bytes, in built-in expressions only.

Each round counts exact bytes and rows below candidate key boundaries in one aggregation, and places new candidates
inside the intervals that hold a wanted splitter. When every splitter is within tolerance, or its interval is one
key, the rows are exchanged once. Known counts below each boundary give every row its slot without another pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table, written

N_SHARDS = 16
FIRST_PROBES = 4096
PROBES = 256
RANGE_BYTES = 64 << 20


def _histogram(rows: DataFrame, cuts: list[tuple[int, int]], probes: int) -> dict[int, tuple[int, int]]:
    """Bytes and rows by the lower key of each sub-interval of ``cuts`` (ends excluded); at most ``probes`` for each cut."""
    low = None
    for lo, hi in cuts:
        width = max(1, -(-(hi - lo) // probes))
        # Distances of long keys may have 64 bits.
        far = F.col("key").cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
        begin = (F.call_function("div", far, F.lit(width).cast("decimal(20,0)")).cast("decimal(20,0)") * F.lit(width).cast("decimal(20,0)") + F.lit(lo)).cast("long")
        inside = (F.col("key") >= lo) & (F.col("key") <= hi - 1)
        low = F.when(inside, begin) if low is None else low.when(inside, begin)
    counts = rows.select(low.alias("low"), "bytes").where("low IS NOT NULL").groupBy("low").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["low"]: (r["b"], r["n"]) for r in counts.collect()}  # at most len(cuts) * probes rows


def histogram_boundaries(rows: DataFrame, n_shards: int, tolerance: float) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Lower keys of shards 0..n-1, and exact (bytes, rows) below every boundary counted on the way.

    ``rows`` has ``key`` (long, never null) and ``bytes``. Driver memory is bounded by probes, not by rows.
    """
    ends = rows.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if ends[0] is None:
        return [], {}
    lo, hi, total = ends[0], ends[1] + 1, ends[2]
    below = {lo: (0, 0)}
    cuts, probes = [(lo, hi)], FIRST_PROBES
    wanted = [total * i // n_shards for i in range(1, n_shards)]
    slack = max(1, int(tolerance * total / n_shards))
    while cuts:
        found = _histogram(rows, cuts, probes)
        for a, b in cuts:
            width = max(1, -(-(b - a) // probes))
            s, n = below[a]
            for k in range(a, b, width):
                below[k] = (s, n)
                x, y = found.get(k, (0, 0))
                s, n = s + x, n + y
            below[b] = (s, n)
        keys = sorted(below)
        sums = [below[k][0] for k in keys]
        cuts = []
        for w in wanted:
            i = max(j for j in range(len(keys)) if sums[j] <= w)
            if w - sums[i] > slack and i + 1 < len(keys) and sums[i + 1] - w > slack and keys[i + 1] - keys[i] > 1:
                cuts.append((keys[i], keys[i + 1]))
        cuts, probes = sorted(set(cuts)), PROBES
    starts = [lo]
    for w in wanted:
        starts.append(min(keys, key=lambda k: (abs(below[k][0] - w), k)))
    return starts, below


def shard_by_bytes(df: DataFrame, key: str, size: Column, n_shards: int = N_SHARDS, tolerance: float = 0.001, n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (bytes near equal, in key order) and ``slot`` (gapless from 0 within its shard).

    The law is ``bytes``: a shard differs from the mean by the tolerance or by the bytes of one key. Keys are whole
    numbers of at most 64 bits; another type is an error. Rows of one key stay together; a null key is with the
    smallest one, before it. Ties of a key are ordered by the hash of all other columns; identical rows may swap
    slots. An empty table gives no rows, very long texts count with their size. Columns named shard or slot are
    replaced, all others stay, whatever their names.
    """
    kind = df.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"a key of type {kind.simpleString()}; whole numbers are wanted")
    df = df.drop(*({"shard", "slot"} - {key}))
    own = next(p for k in range(len(df.columns) + 1) if not any(c.lower().startswith(p := f"_{k}_") for c in df.columns))  # a prefix no column has
    # Keys and sizes are read once from the rows; all counting goes over this narrow table.
    narrow = written(df.select(F.col(key).cast("long").alias("key"), size.cast("long").alias("bytes")), "sizes")
    lowest = narrow.agg(F.min("key")).first()[0]
    lowest = 0 if lowest is None else lowest
    starts, below = histogram_boundaries(narrow.select(F.coalesce("key", F.lit(lowest)).alias("key"), "bytes"), n_shards, tolerance)
    if not starts:
        return df.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    keys, total = sorted(below), max(v[0] for v in below.values())
    # Ranges finer than shards keep tasks small however large a shard is; they reuse boundaries already counted.
    n_ranges = n_ranges or min(FIRST_PROBES, max(8 * n_shards, total // RANGE_BYTES))
    fine, passed = set(starts), 0
    for k in keys[:-1]:
        if below[k][0] * n_ranges // max(total, 1) > passed:
            passed = below[k][0] * n_ranges // max(total, 1)
            fine.add(k)
    fine = sorted(k for k in fine if k < 2**63)  # no key lies beyond
    bases = [(k, max(i for i, s in enumerate(starts) if s <= k)) for k in fine]
    slots = [below[k][1] - below[starts[s]][1] for k, s in bases]
    filled = F.coalesce(F.col(key).cast("long"), F.lit(lowest))
    rows = df.withColumn(f"{own}key", filled)
    rows = rows.withColumn(f"{own}range", _bisect(fine, f"{own}key"))
    others = [c for c in df.columns if c != key]
    window = Window.partitionBy(f"{own}range").orderBy(f"{own}key", F.col(key).asc_nulls_first(), *([F.xxhash64(*others)] if others else []))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(f"{own}range") + 1)
    return (
        rows.withColumn(f"{own}at", F.row_number().over(window).cast("long") - 1)
        .withColumn("shard", pick([s for _, s in bases]).cast("int"))
        .withColumn("slot", pick(slots).cast("long") + F.col(f"{own}at"))
        .drop(f"{own}key", f"{own}range", f"{own}at")
    )


def _bisect(fine: list[int], name: str) -> Column:
    """Index of the last boundary at or below the named column, as a balanced tree of comparisons."""

    def tree(i: int, j: int) -> Column:
        if j - i == 1:
            return F.lit(i)
        m = (i + j) // 2
        return F.when(F.col(name) < fine[m], tree(i, m)).otherwise(tree(m, j))

    return tree(0, len(fine))


def op2_shard_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return shard_by_bytes(docs, "doc_id", size).select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
