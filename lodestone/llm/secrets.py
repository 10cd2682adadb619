"""Secret scans: candidates by pattern, false positives removed by a random forest.

Features are the candidate's length, its character classes and transitions between them, how much of it dictionary
words cover, its path and its neighbouring words. The forest is trained from labelled findings, of which at most
``MAX_TRAIN`` are used; ``labelled_findings`` makes such a table from public key formats and their look-alikes.
"""

from __future__ import annotations

import base64
import random
import re
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import bounded_batches, extended, table

MAX_TRAIN = 20_000
TREES, DEPTH, LEAF_ROWS = 40, 10, 3
THRESHOLD = 0.5
MASK = "[SECRET]"
EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=\-])(?:(?i:eyJ)[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+|[A-Za-z0-9+/_=\-]{16,})")
#: Values start in lookaheads, so that an assignment inside another's value is found too.
QUOTED = r"\"(?=([^\s\"]{8,}))|'(?=([^\s']{8,}))"
ASSIGNED = re.compile(rf"(?:=>|[=:])(?:[ \t]*(?:{QUOTED})|[ \t]+(?=([^\s\"'<>]{{8,}}))|(?!//)(?=([^\s\"'<>=:]{{8,}}={{0,2}})))")
#: Words beside a candidate that speak for and against a secret, and parts of paths of test data.
FOR = ["token", "secret", "key", "password", "passwd", "pwd", "auth", "bearer", "credential", "apikey", "private", "access"]
AGAINST = ["commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "order", "card", "account", "phone", "isbn", "tracking", "version", "revision", "file", "image", "url", "see"]
TEST_PATHS = ["test", "example", "sample", "fixture", "mock", "doc", "vendor", "lock"]
NAMED = re.compile(rf"(?:{'|'.join(FOR)})[ \t]+(?:{QUOTED}|(?=([^\s\"'<>]{{8,}})))", re.I)
PREFIX = re.compile(r"(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|AIza|ya29|eyJ|glpat-|npm_|-----BEGIN)")
WORD = re.compile(r"[A-Za-z]{2,}\d*")


@lru_cache(maxsize=1)
def dictionary() -> frozenset[str]:
    """Alphabetic entries of four letters or more of a public vocabulary."""
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        entries = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip() for line in f)
        return frozenset(e.lower() for e in entries if len(e) >= 4 and e.isascii() and e.isalpha())


def coverage(text: str) -> float:
    """Share of characters that dictionary words cover, longest first from the left."""
    known, covered = dictionary(), 0
    for run in re.findall(r"[a-z]{4,}", text.lower()):
        i = 0
        while i + 4 <= len(run):
            n = next((n for n in range(min(16, len(run) - i), 3, -1) if run[i : i + n] in known), 0)
            covered += n
            i += n or 1
    return covered / max(1, len(text))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order that don't overlap. Key blocks go before values that a credential word names, these before other
    assigned values, these before long runs; what others leave of a span stays where it has 16 characters or more.
    """
    found = [(3, *m.span()) for m in TOKEN.finditer(text)]
    begin = None  # of the first key block that has no end yet
    for m in EDGE.finditer(text) if "-----BEGIN" in text else ():
        if m[1] == "BEGIN":
            begin = m.start() if begin is None else begin
        elif begin is not None:
            found.append((0, begin, m.end()))
            begin = None
    low = text.lower()
    if any(w in low for w in FOR):
        found += [(1, *m.span(m.lastindex)) for m in NAMED.finditer(text)]
    if "=" in text or ":" in text:
        names = tuple(FOR)
        for m in ASSIGNED.finditer(text):
            name = text[max(0, m.start() - 40) : m.start()].rstrip(" \t\"'").lower()
            found.append((1 if name.endswith(names) else 2, *m.span(m.lastindex)))
    found.sort(key=lambda x: (x[0], x[1], -x[2]))
    taken: list[tuple[int, int]] = []
    for _, a, b in found:
        k = bisect_left(taken, (a, a))
        k -= k > 0 and taken[k - 1][1] > a
        rest, at, whole = [], a, True
        while k < len(taken) and taken[k][0] < b:
            rest.append((at, taken[k][0]))
            at, whole = max(at, taken[k][1]), False
            k += 1
        for x in [(a, b)] if whole else [(x, y) for x, y in [*rest, (at, b)] if y - x >= 16]:
            insort(taken, x)
    return taken


def kinds(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.select([(b >= 48) & (b <= 57), (b >= 97) & (b <= 102), (b > 102) & (b <= 122), (b >= 65) & (b <= 70), (b > 70) & (b <= 90)], [0, 1, 2, 3, 4], 5)


def features(found: str, left: str, right: str, path: str) -> list[float]:
    if not found:
        raise ValueError("an empty candidate has no features")
    k = kinds(found)
    n = len(k)
    share = np.bincount(k, minlength=6) / n
    change = k[1:] != k[:-1]
    counts = np.unique(list(found), return_counts=True)[1] / n
    letter = (k >= 1) & (k <= 4)
    near = [w.lower() for w in WORD.findall(left)[-4:]]
    before = left.rstrip(" \t\"'")[-1:]
    joined = " ".join(near[-3:])
    return [
        float(np.log2(n)), float(n % 4 == 0), *share.tolist(), float(change.mean()) if n > 1 else 0.0,
        float((letter[1:] != letter[:-1]).mean()) if n > 1 else 0.0, float(-(counts * np.log2(counts)).sum()), len(counts) / n,
        coverage(found), float(bool(re.fullmatch(r"[0-9a-fA-F]+", found))), float(bool(re.fullmatch(r"[0-9\- ]+", found))),
        float(bool(PREFIX.match(found))), float(found.count("-") == 4), found.count("/") / n, float(before in ("=", ":")) if before else 0.0,
        float(any(w in joined for w in FOR)), float(any(w.rstrip("0123456789") in AGAINST or w in AGAINST for w in near[-2:])),
        float(any(w in path.lower() for w in TEST_PATHS)), float(len(near)), float(right[:1] in "\"'" and right[:1] != ""), float(bool(re.search(r"(.)\1{5,}|example|xxxx|placeholder|your", found, re.I))),
    ]


class Tree:
    """Nodes in flat arrays: feature (-1 at a leaf), threshold, left, right, share of positives."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator):
        self.nodes: list[list[float]] = []
        todo = [(np.arange(len(y)), 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            self.nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if depth < DEPTH and len(rows) >= 2 * LEAF_ROWS and 0 < y[rows].sum() < len(rows) and (cut := self.split(x[rows], y[rows], rng)):
                self.nodes[me][:2] = cut
                low = x[rows, int(cut[0])] <= cut[1]
                todo += [(rows[low], depth + 1, me, 0), (rows[~low], depth + 1, me, 1)]
        self.flat = np.array(self.nodes)

    @staticmethod
    def split(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[int, float] | None:
        """The cut with the least Gini impurity among a random subset of features."""
        best, n = None, len(y)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, pos = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= LEAF_ROWS) & (n - at - 1 >= LEAF_ROWS)]
            if len(at):
                a, p = at + 1.0, pos[at]
                gini = p * (a - p) / a + (pos[-1] - p) * (n - a - (pos[-1] - p)) / (n - a)
                k = int(gini.argmin())
                if best is None or gini[k] < best[0]:
                    best = (gini[k], int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
        return best and best[1:]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = self.flat[at, 0].astype(np.int64)
            inner = f >= 0
            if not inner.any():
                break
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= self.flat[at, 1]
            at = np.where(inner, np.where(low, self.flat[at, 2], self.flat[at, 3]).astype(np.int64), at)
        return self.flat[at, 4]


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[rows], y[rows], rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


def labelled_findings(n: int = 4000, seed: int = 1) -> list[tuple[str, str, str, str, int]]:
    """(candidate, text before, text after, path, 1 for a secret): public key formats and their look-alikes."""
    r = random.Random(seed)
    hexes, letters = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = sorted(dictionary())
    draw = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    filler = lambda: " ".join(r.choice(words) if r.random() < 0.6 else draw("aeiounrstldhcm", r.randint(2, 9)) for _ in range(r.randint(0, 6)))
    uuid = lambda: "-".join(draw(hexes, k) for k in (8, 4, 4, 4, 12))
    rows = []
    for i in range(n):
        path = r.choice(["src/app.py", "conf/prod.env", "web/main.js", "notes.txt", "src3", "pages/17", ""])
        left, right, label = filler(), filler(), i % 2
        if label:
            found = r.choice([
                lambda: draw(hexes, r.choice([32, 40, 40, 64])), lambda: "AKIA" + draw(letters[:26] + "0123456789", 16), lambda: "ghp_" + draw(letters, 36),
                lambda: "sk_live_" + draw(letters, 24), lambda: draw(letters + "+/", r.choice([40, 44, 64])), lambda: "eyJ" + draw(letters, 30) + "." + draw(letters + "_-", 60),
                lambda: draw(letters, r.randint(20, 40)), lambda: draw(letters + "!@#%^*", r.randint(9, 16)), lambda: uuid(), lambda: draw(hexes, 40),
                lambda: "".join(r.choice([w for w in r.sample(words, 20) if len(w) < 8] or ["hunter"]) + draw("0123456789", r.randint(1, 4)) for _ in range(2)),
            ])()
            word = r.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "SECRET_KEY", "Bearer", "Token", "apikey", "TOKEN"])
            left += f" {word}" + r.choice([" = \"", "=", ": ", " = ", "=\"", ": '", " "])
            if PREFIX.match(found) and r.random() < 0.5:
                left = filler() + " "
            right = ("\"" if left.endswith("\"") else "'" if left.endswith("'") else "") + " " + right
            if r.random() < 0.15:
                found, right, left = found.upper(), right.upper(), left.upper()
        else:
            kind = r.randrange(10)
            found = [
                lambda: draw(hexes, r.choice([32, 40, 64])), lambda: draw("0123456789", r.choice([16, 16, 16, 18, 20])), uuid, lambda: "_".join(r.sample(words, r.randint(2, 4))),
                lambda: "/".join(r.sample(words, r.randint(3, 5))) + draw("0123456789", 2), lambda: "".join(w.title() for w in r.sample(words, 3)), lambda: r.choice("=-_") * r.randint(16, 60),
                lambda: r.choice(["your_api_key_here", "EXAMPLE" + draw(letters, 12), "x" * 24, "placeholder_" + draw("0123456789", 8), "0" * 32]), lambda: draw("aeiounrstldhcm", r.randint(16, 30)),
                lambda: r.choice([str.lower, str.lower, str.title, str.upper])(r.choice([r.choice([w for w in r.sample(words, 20) if len(w) > 7] or ["password"]), draw("aeiounrstldhcm", r.randint(8, 15))])) + r.choice(["", "", ".", ",", ";", ":"]),
            ][kind]()
            if kind in (0, 2):
                left += r.choice([" commit ", " sha256: ", " md5 ", " checksum = ", " digest: ", " uuid ", " id = ", " revision ", " file ", " version "])
            elif kind == 7:
                left += r.choice([" token = \"", " api_key: ", " secret="])
            elif kind == 9:
                left += " " + r.choice([*FOR, *FOR, "Token", "Bearer", "Secret", "api_key", "note", "see"]) + r.choice([" ", " ", " ", ": ", " = "])
            elif r.random() < 0.5:
                left += r.choice([" = ", ": ", " \"", " see ", " order ", " card ", " | "])
            else:
                left += " "
            right = r.choice([" ", "\" ", ". ", " | "]) + right
            if r.random() < 0.15:
                path = r.choice(["tests/data.txt", "docs/guide.md", "examples/run.py", "vendor/lib.js"])
        rows.append((found, left, right, path, label))
    return rows


def train(findings: DataFrame) -> Forest:
    """A forest from (candidate, left, right, path, label); at most MAX_TRAIN of them, picked by hash of the row.

    Rows without a candidate or a label are left out, other nulls count as empty; it is an error where none is left.
    """
    rows = findings.where("candidate <> '' AND label IS NOT NULL").orderBy(F.xxhash64(*findings.columns)).limit(MAX_TRAIN).collect()
    if not rows:
        raise ValueError("there are no labelled findings to learn from")
    x = np.array([features(r["candidate"], r["left"] or "", r["right"] or "", r["path"] or "") for r in rows])
    return Forest(x, np.array([r["label"] for r in rows], float))


def scan(docs: DataFrame, forest: Forest, path_col: str | None = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with n_candidates, secrets (start and end in code points, score) and masked (text with them replaced).

    Null text has no candidates and stays null in ``masked``; a null or missing path is the empty string. Overlapping
    candidates can't occur, repeated rows get equal results, columns with the new names are replaced.
    """
    added = ["n_candidates", "secrets", "masked"]
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(forest)  # its size is bounded by TREES and DEPTH

    def run(batches):
        for batch in slices(batches, text_col):
            texts = batch[text_col].to_pylist()
            paths = batch[path_col].to_pylist() if path_col and path_col in batch.schema.names else [None] * len(texts)
            owner, spans, rows = [], [], []
            for d, t in enumerate(texts):
                for a, b in candidates(t or ""):
                    owner.append(d)
                    spans.append((a, b))
                    rows.append(features(t[a:b], t[max(0, a - 80) : a], t[b : b + 8], paths[d] or ""))
            scores = sent.value.predict(np.array(rows)) if rows else []
            kept, counts = [[] for _ in texts], [0] * len(texts)
            for d, (a, b), s in zip(owner, spans, scores, strict=True):
                counts[d] += 1
                if s >= THRESHOLD:
                    kept[d].append({"start": a, "end": b, "score": float(s)})
            masked = [mask(t, k) if k else t for t, k in zip(texts, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(kept, FOUND), pa.array(masked, pa.string())], names=[*batch.schema.names, *added])

    return docs.mapInArrow(run, extended(docs, "n_candidates long, secrets array<struct<start:int,end:int,score:double>>, masked string"))


FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def mask(text: str, found: list[dict]) -> str:
    parts, at = [], 0
    for f in found:
        parts += [text[at : f["start"]], MASK]
        at = f["end"]
    return "".join([*parts, text[at:]])


def trained(spark: SparkSession) -> Forest:
    columns = [pa.array(c) for c in zip(*labelled_findings(), strict=True)]
    # As an Arrow table, the rows need no Python workers of another kind, which would stay beside those of the scan.
    return train(spark.createDataFrame(pa.table(columns, names=["candidate", "left", "right", "path", "label"])).withColumn("label", F.col("label").cast("int")))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), trained(spark))
    return out.select(
        "doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
        F.transform("secrets", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), F.sha2("masked", 256).alias("masked_sha256"),
    )
