"""Quality rules by compression bands (zstandard).

A text whose compressed share falls below the band for its length repeats itself, one
above it is noise. Limits are a matter of length, as short texts carry the frame's
overhead and long ones have more to refer back to. Texts are also judged by fixed chunks
of ``CHUNK`` bytes, the last and shorter one too, so that a clean start does not hide a repetitive rest:
at most half of them may be out of their bands.

Bands come from labelled rows: of the texts labelled good that pass the base rules, those
of one half octave of lengths give a line of the share by the logarithm of the length, and the
limits lie ``MARGIN`` beyond the ``TAIL`` quantiles of their distances from it. A half octave
with under ``LEAST`` such texts, and every one without labels, has the wide ``BANDS``. The fit takes every
labelled row: lines are sums by half octave, quantiles come from counts by cells of ``STEP``, and a limit is its cell's outer edge.

Defined results: a null or empty text has no words, so the base rules reject it; texts
below 128 bytes are not judged by compression; a text of any length is compressed whole;
repeated rows are judged alike, each for itself; extra columns are left alone, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.llm.common import cut, drop

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 5
LEVEL = 3
CHUNK = 4096
#: From so many bytes: the least and the largest share that the compressed text may have, where labels do not tell.
BANDS = ((0, 0.0, 9.0), (128, 0.36, 1.05), (256, 0.33, 0.92), (512, 0.28, 0.86), (1024, 0.24, 0.80), (2048, 0.22, 0.76), (4096, 0.20, 0.74), (16384, 0.17, 0.72), (65536, 0.14, 0.70))
LEAST, TAIL, MARGIN, STEP = 100, 0.002, 0.01, 1e-4

METRICS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]).add("ratio", T.DoubleType()).add("bad_chunks", T.LongType()).add("n_chunks", T.LongType()).add("base_failed", T.BooleanType()).add("kept", T.BooleanType())


class Bands:
    """Limits by length: wide ones, and those fitted for some half octaves of lengths."""

    def __init__(self, fitted: dict[int, tuple[float, float, float, float]] | None = None):
        self.fitted = fitted or {}  # half octave -> slope, intercept, least and largest distance

    def limits(self, n_bytes: int) -> tuple[float, float]:
        _, low, high = next(b for b in reversed(BANDS) if b[0] <= n_bytes)
        x = np.log2(max(n_bytes, 1))
        line = self.fitted.get(int(2 * x))
        if line is None or n_bytes < BANDS[1][0]:
            return low, high
        slope, at, least, most = line
        return slope * x + at + least, slope * x + at + most

    def hold(self, n_bytes: int, ratio: float) -> bool:
        low, high = self.limits(n_bytes)
        return low <= ratio <= high


def fit_bands(sizes: np.ndarray, ratios: np.ndarray, least: int = LEAST) -> Bands:
    """Bands from the lengths and shares of good texts at hand: the plain version of ``learned``."""
    x = np.log2(np.maximum(sizes, 1))
    half, out = (2 * x).astype(int), {}
    for k in np.unique(half):
        own = half == k
        if own.sum() >= least:
            slope, at = np.polyfit(x[own], ratios[own], 1)
            off = ratios[own] - (slope * x[own] + at)
            out[int(k)] = (slope, at, np.quantile(off, TAIL) - MARGIN, np.quantile(off, 1 - TAIL) + MARGIN)
    return Bands(out)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    grams = ids
    for k in range(1, window):
        _, grams = np.unique(grams[:-1] * len(seen) + ids[k:], return_inverse=True)
        if grams.size and int(grams.max()) + 1 == grams.size:
            return 0
    twice = (np.bincount(grams) > 1)[grams]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


def share(raw: bytes, packer: zstandard.ZstdCompressor) -> float:
    return len(packer.compress(raw)) / len(raw) if raw else 0.0


def base_fails(n: int, repeats: int) -> bool:
    return n < 10 or 100 * repeats > 20 * n


def measure(text: str | None, packer: zstandard.ZstdCompressor, bands: Bands) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    repeats = repeated_words(words)
    failed = base_fails(n, repeats)
    ratio = share(raw, packer)
    held = bands.hold(len(raw), ratio)
    if len(raw) > CHUNK:
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        bad = sum(not bands.hold(len(c), share(c, packer)) for c in chunks)
    else:
        chunks, bad = [raw] if raw else [], int(bool(raw) and not held)
    kept = not failed and held and 2 * bad <= len(chunks)
    return (n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(raw), repeats, ratio, bad, len(chunks), failed, kept)


def quality(bands: Bands) -> Callable:
    """The metrics of each text as a pandas UDF."""

    @F.pandas_udf(METRICS)
    def judged(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        return pd.DataFrame([measure(t, packer, bands) for t in texts], columns=METRICS.names)

    return judged


@F.pandas_udf(T.StructType().add("half", T.IntegerType()).add("size", T.DoubleType()).add("ratio", T.DoubleType()))
def packed(texts: pd.Series) -> pd.DataFrame:
    """Half octave and logarithm of the length, and the compressed share, of each text that passes the base rules; else nulls."""
    packer, out = zstandard.ZstdCompressor(level=LEVEL), []
    for t in texts:
        raw = (t or "").encode()
        words = raw.split()
        if base_fails(len(words), repeated_words(words)):
            out.append((None, None, None))
        else:
            size = float(np.log2(len(raw)))
            out.append((int(2 * size), size, share(raw, packer)))
    return pd.DataFrame(out, columns=["half", "size", "ratio"]).astype({"half": "Int32", "size": float, "ratio": float})


def learned(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> Bands:
    """Bands from all of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) call good.

    Texts are measured before the join, which moves numbers alone; the driver gets a row for each half octave.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    x = docs.select("doc_id", packed("text").alias("q")).select("doc_id", "q.*").join(good, "doc_id")
    x = cut(x.where("half is not null").select("half", "size", "ratio"))
    # rounded, so that sums in another order give the same bands
    lines = x.groupBy("half").agg(F.count("*").alias("n"), F.round(F.coalesce(F.regr_slope("ratio", "size"), F.lit(0.0)), 9).alias("slope"), F.avg("size").alias("s"), F.avg("ratio").alias("r")).where(F.col("n") >= least)
    lines = lines.select("half", "n", "slope", F.round(F.col("r") - F.col("slope") * F.col("s"), 9).alias("at"))  # a row for each half octave
    cell = F.floor((F.col("ratio") - F.col("slope") * F.col("size") - F.col("at")) / STEP).alias("cell")
    cells = x.join(F.broadcast(lines), "half").groupBy("half", "n", "slope", "at", cell).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("half").orderBy("cell"))  # over cells, whose number is bounded
    last = F.col("n") - 1
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("cell")))
    got = cells.withColumn("upto", upto).groupBy("half", "slope", "at").agg(at(F.floor(last * TAIL)).alias("low"), at(F.ceil(last * (1 - TAIL))).alias("high")).collect()
    drop(x)
    return Bands({r["half"]: (r["slope"], r["at"], r["low"] * STEP - MARGIN, (r["high"] + 1) * STEP + MARGIN) for r in got})


def judge(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id with the metrics and verdict of each row."""
    bands = Bands() if labels is None else learned(docs, labels)
    return docs.select("doc_id", quality(bands)("text").alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    bands = Bands() if labels is None else learned(docs, labels)
    return docs.where(quality(bands)("text")["kept"])
