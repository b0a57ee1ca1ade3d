"""Large JSON array files, read in blocks of bytes that are cut at element boundaries.

Whether a block starts inside a string, and how deep in brackets, follows from the blocks before it. So a first pass
gives each block's number of quotes (odd or even) and what it adds to the depth, for both ways it may start;
running sums over blocks give how each starts; a second pass counts the separators (the opening bracket and the
commas of the outermost array) in each, whose running sums are the positions of their elements; a third reads the
elements. An element belongs to the block that holds the separator before it, and is read on beyond the block's end.

What meets in one task are blocks' numbers, a row for each ``BLOCK`` bytes. Files are opened by pyarrow, which knows local and
remote paths. A file that isn't there is an error; one that holds no array, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 64 << 20
AHEAD = 1 << 16
QUOTE, ESCAPE, COMMA, OPENS, CLOSES = ord('"'), ord("\\"), ord(","), b"[{", b"]}"


def opened(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(start, stop) of the file's blocks."""
    with opened(path) as f:
        size = f.size()
    n = max(-(-size // block), 1)
    return spark.range(0, n, 1, n).select((F.col("id") * block).alias("start"), F.least((F.col("id") + 1) * block, F.lit(size)).alias("stop"))


class Bytes:
    """Bytes from ``start`` on with the places of quotes and brackets, whatever comes before."""

    def __init__(self, f, start: int, stop: int):
        back = start
        while back:  # how many escapes stand before the first byte
            a = max(back - AHEAD, 0)
            f.seek(a)
            before = f.read(back - a)
            kept = len(before.rstrip(b"\\"))
            back = a + kept
            if kept:
                break
        f.seek(start)
        self.raw = f.read(stop - start)
        x = np.frombuffer(self.raw, np.uint8)
        at = np.arange(len(x))
        plain = np.maximum.accumulate(np.where(x != ESCAPE, at, -1 - (start - back))) if len(x) else at
        run = at - 1 - np.append(-1 - (start - back), plain[:-1])[: len(x)]
        self.quote = (x == QUOTE) & (run % 2 == 0)
        self.odd = np.cumsum(self.quote) % 2 == 1
        self.x = x
        self.step = np.isin(x, list(OPENS)).astype(np.int64) - np.isin(x, list(CLOSES))

    def inside(self, string: bool) -> np.ndarray:
        """Which bytes are in a string; its quotes are."""
        return (self.odd ^ string) | self.quote

    def depth(self, string: bool, depth: int) -> np.ndarray:
        """After each byte."""
        return depth + np.cumsum(np.where(self.inside(string), 0, self.step))

    def separators(self, string: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of what opens the outermost array or parts its elements, and of what closes it."""
        d, out = self.depth(string, depth), ~self.inside(string)
        opens = out & (self.step > 0) & (d == 1)
        return np.flatnonzero(opens & (self.x == OPENS[0]) | out & (self.x == COMMA) & (d == 1)), np.flatnonzero(out & (self.step < 0) & (d == 0))


def started(table: DataFrame, path: str) -> DataFrame:
    """``table`` of blocks with string, depth, n (separators) and first (separators before)."""

    def look(batches: Iterator[pd.DataFrame]):
        for b in batches:
            with opened(path) as f:
                for start, stop in b[["start", "stop"]].itertuples(index=False):
                    x = Bytes(f, start, stop)
                    yield pd.DataFrame([(start, stop, int(x.quote.sum()) % 2, *(int(np.where(x.inside(s), 0, x.step).sum()) for s in (False, True)))], columns=["start", "stop", "odd", "outer", "inner"])

    def count(batches: Iterator[pd.DataFrame]):
        for b in batches:
            with opened(path) as f:
                for r in b.itertuples():
                    yield pd.DataFrame([(r.start, r.stop, r.string, r.depth, len(Bytes(f, r.start, r.stop).separators(r.string, r.depth)[0]))], columns=["start", "stop", "string", "depth", "n"])

    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    over = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    seen = table.mapInPandas(look, "start long, stop long, odd int, outer long, inner long")
    seen = seen.withColumn("string", over("odd") % 2 == 1).withColumn("adds", F.when(F.col("string"), F.col("inner")).otherwise(F.col("outer")))
    seen = seen.withColumn("depth", over("adds")).select("start", "stop", "string", "depth")
    n = table.sparkSession.conf.get("spark.sql.shuffle.partitions")
    counted = seen.repartitionByRange(int(n), "start").mapInPandas(count, "start long, stop long, string boolean, depth long, n long")
    return counted.withColumn("first", over("n"))


def elements(spark: SparkSession, path: str, start: int = 0, end: int | None = None, block: int = BLOCK) -> DataFrame:
    """(position, value) of the elements [start, end) of a JSON array file, each as its text; a range without elements is an error."""
    found = started(blocks(spark, path, block), path)
    rows = found.collect()  # a row of numbers for each block
    total = sum(r["n"] for r in rows)
    with opened(path) as f:
        head = f.read(AHEAD).lstrip()
    if not head.startswith(b"["):
        raise ValueError(f"{path} holds no JSON array")
    if total == 1:  # an opening bracket: one element, or none
        with opened(path) as f:
            total = len(_one(f, rows))
    stop = total if end is None else min(end, total)
    if max(start, 0) >= stop:
        raise ValueError(f"no elements in [{start}, {end}) of {total}")
    mine = [(r["start"], r["stop"], r["string"], r["depth"], r["first"]) for r in rows if r["n"] and r["first"] < stop and r["first"] + r["n"] > start]
    table = spark.createDataFrame(mine, "start long, stop long, string boolean, depth long, first long").repartition(len(mine), "start")

    def read(batches: Iterator[pd.DataFrame]):
        for b in batches:
            with opened(path) as f:
                for r in b.itertuples():
                    got = pd.DataFrame({"value": texts(f, r.start, r.stop, r.string, r.depth)})
                    got.insert(0, "position", np.arange(r.first, r.first + len(got)))
                    yield got[(got["position"] >= start) & (got["position"] < stop)]

    return table.mapInPandas(read, "position long, value string")


def texts(f, start: int, stop: int, string: bool, depth: int) -> list[str]:
    """The elements whose separators are in a block."""
    x = Bytes(f, start, stop)
    cuts, closes = x.separators(string, depth)
    if not len(cuts):
        return []
    ends = np.append(cuts[1:], closes[0] if len(closes) else -1)
    rest, at = x.raw[cuts[-1] + 1 : ends[-1]] if ends[-1] >= 0 else x.raw[cuts[-1] + 1 :], stop
    if ends[-1] < 0:  # the last one goes on beyond the block
        string, depth = bool(x.odd[-1]) ^ string, int(x.depth(string, depth)[-1])
        while True:
            more = Bytes(f, at, at + AHEAD)
            found = np.concatenate(more.separators(string, depth))
            if len(found) or not more.raw:
                rest += more.raw[: found.min()] if len(found) else b""
                break
            rest, at = rest + more.raw, at + len(more.raw)
            string, depth = bool(more.odd[-1]) ^ string, int(more.depth(string, depth)[-1])
    made = [x.raw[a + 1 : b] for a, b in zip(cuts[:-1], ends[:-1])] + [rest]
    return [t.decode() for t in map(bytes.strip, made) if t]


def _one(f, rows) -> list[str]:
    r = next(r for r in rows if r["n"])
    return texts(f, r["start"], r["stop"], r["string"], r["depth"])
