"""Secret scans: stated patterns, and a battery of randomness tests on long tokens.

A token of 16 or more letters, digits and code characters gets an inferred encoding (hex,
base32 or base64 alphabet) and three tests of the hypothesis that its characters are
random over that alphabet: chi-squared uniformity over five classes, runs above and below
the middle, and serial correlation. Fisher's method makes one p-value of them, its
randomness score; tokens made of ordinary words get scores near zero.

Which scores count is set by false-discovery control for each length class: tokens without
a digit show how often ordinary text of at most that length reaches a score, and the lowest
score is taken at which the expected share of such chance hits stays below the stated rate.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpuslab.llm.common import map_text
from corpuslab.plans.storage import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
# "=" belongs to a token only as padding at its end, so that NAME=value is two tokens
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,2}(?![A-Za-z0-9+/_=-]))?", re.ASCII)
TOKEN_LEAST = 16
LENGTHS = (16, 20, 24, 32, 48, 1 << 62)
SCORES = 50
FALSE_RATE = 0.05

ALPHABETS = (
    ("hex", "0123456789abcdef", (3, 6, 9, 12)), ("HEX", "0123456789ABCDEF", (3, 6, 9, 12)),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (6, 12, 18, 26)),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (13, 26, 39, 52)),
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the stated patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    # both need a run of letters and digits, which holds no white space
    longest = max(map(len, text.split()), default=0)
    if longest >= ACCESS_LEAST and "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if longest >= HEX_LEAST:
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> float:
    """Combined p-value of the battery: near zero when the token isn't random over its alphabet."""
    core = token.rstrip("=").translate({45: 43, 95: 47})
    for _, alphabet, cuts in ALPHABETS:
        values = np.array([alphabet.find(c) for c in core])
        if len(core) and values.min() >= 0:
            break
    else:
        return 0.0
    n, size = len(values), len(alphabet)
    edges = (0, *cuts, size)
    observed = np.histogram(values, edges)[0]
    expected = n * np.diff(edges) / size
    x = float(((observed - expected) ** 2 / expected).sum()) / 2
    uniform = math.exp(-x) * (1 + x)
    above = values >= size / 2
    high = int(above.sum())
    low = n - high
    if high and low:
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = two_sided((1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = two_sided(math.sqrt(n))
    spread = values - values.mean()
    power = float((spread * spread).sum())
    serial = two_sided(float((spread[1:] * spread[:-1]).sum()) / power * math.sqrt(n)) if power else 0.0
    y = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-y) * (1 + y + y * y / 2)


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int, int, bool]]:
    """(start, end, length class, score class, holds a digit) of long tokens, or their long parts, outside base spans."""
    out = []
    if max(map(len, text.split()), default=0) < TOKEN_LEAST:
        return out
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < TOKEN_LEAST:
            continue
        at, parts = m.start(), []
        for a, _, b in base:
            if at < b and a < m.end():
                parts.append((at, a))
                at = max(at, b)
        for start, end in [*parts, (at, m.end())]:
            if end - start < TOKEN_LEAST:
                continue
            token = text[start:end]
            length = next(i for i in range(len(LENGTHS) - 1) if end - start < LENGTHS[i + 1])
            score = min(SCORES - 1, int(randomness(token) * SCORES))
            has_digit = any(c.isdigit() for c in token)
            out.append((start, end, length, score, has_digit and any(c.isalpha() for c in token)))
    return out


def scanned(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``tokens``, the spans of the patterns and the long tokens with their classes."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
    token = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "length", "score")] + [T.StructField("digit", T.BooleanType())])

    def make():
        def work(texts):
            base = [base_spans(t or "") for t in texts]
            tokens = [candidates(t or "", b) for t, b in zip(texts, base)]
            return [
                [[dict(zip(("start", "kind", "end"), s)) for s in each] for each in base],
                [[dict(zip(("start", "end", "length", "score", "digit"), s)) for s in each] for each in tokens]]
        return work

    return map_text(docs, text, [T.StructField("base", T.ArrayType(span)), T.StructField("tokens", T.ArrayType(token))], make, keep)


def cutoffs(counts: list[tuple[int, int, bool, int]], rate: float = FALSE_RATE) -> list[int]:
    """Lowest score class to report for each length class; SCORES reports none.

    ``counts``: (length class, score class, holds a digit, tokens), one per class.
    """
    digit = np.zeros((len(LENGTHS) - 1, SCORES))
    plain = np.zeros_like(digit)
    for length, score, has_digit, n in counts:
        (digit if has_digit else plain)[length, score] += n
    plain = plain.cumsum(axis=0)
    out = []
    for own, ordinary in zip(digit, plain):
        reach, chance = own[::-1].cumsum()[::-1], (1 + ordinary[::-1].cumsum()[::-1]) / (1 + ordinary.sum())
        good = np.flatnonzero((reach > 0) & (chance * own.sum() <= rate * reach))
        out.append(int(good[0]) if len(good) else SCORES)
    return out


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: (id, base, spans), arrays of (start, kind, end) in code points.

    ``spans`` holds the base spans and the random tokens, or their parts, outside of them, by
    start and kind. A null text is an empty text; without long tokens, or with too few ordinary ones to
    bound the false-discovery rate, nothing is added.
    """
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = written(scanned(given, "text", ["id"]), "secrets")
    classes = found.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.score", "t.digit").agg(F.count(F.lit(1)).alias("n"))
    # at most 2 * SCORES counts for each length class
    least = F.array(*[F.lit(c) for c in cutoffs([tuple(r) for r in classes.collect()])])
    hits = F.filter("tokens", lambda t: t["digit"] & (t["score"] >= F.get(least, t["length"])))
    added = F.transform(hits, lambda t: F.struct(t["start"].alias("start"), F.lit("random").alias("kind"), t["end"].alias("end")))
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("nth"), s["kind"].alias("kind"), s["end"].alias("end"))
    return found.select("id", "base", F.array_sort(F.transform(F.concat("base", added), keyed)).alias("spans"))


def op7_secrets(spark, sf_dir):
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS[:3]],
                        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
