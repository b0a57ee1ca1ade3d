"""SimHash near-duplicates, linked through sharded BK-trees.

Of ``BLOCKS`` blocks of bits, two fingerprints that differ in at most ``radius`` bits agree on
at least BLOCKS - radius; so a fingerprint goes to one shard for each choice of that many
blocks and the values there (pairs of blocks: ten choices), and every link has both
ends in some shard. Of the blocks' bits so many count that a shard holds ``NODES`` to twice
``NODES`` fingerprints on average, at any number of them up to 2^25 times as many. A shard is held by one task as a
BK-tree (children keyed by Hamming distance to the parent); a search follows the edges within the radius, skips subtrees
whose nodes were all reached, and gives the shard's components as stars. A shard with
over ``MOST`` fingerprints is dealt into parts, and each pair of parts is a shard of its
own, so no task holds more than two parts. Stars are merged by alternating star
contraction over DataFrames.

Trees are shuffled to tasks instead of broadcast: fingerprints grow with the corpus, so
no bound holds for a broadcast of all of them.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text
of one or two words is one shingle; a text of any length is read whole, in slabs of shingles; equal fingerprints are one node, however many rows
bear them; component_id is the smallest doc_id that is not null, and null where there is none; an empty table gives no rows;
columns other than doc_id and text are left alone, whatever their names. Of a group's rows
``one_of_each`` keeps the one with the smallest doc_id that is not null (ties: by a hash of its text), so a row
without doc_id stays if nothing else is like it, and rows that share a doc_id are judged each by its text.
"""

from __future__ import annotations

from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotledger.llm.common import cut, drop

SHINGLE = 3
SEED = 42
RADIUS, BLOCKS = 3, 5
MOST = 1000
NODES = 64
TASK_ROWS, TASKS = 1 << 13, 20_000  # placed fingerprints of a task of tree searches, and the most such tasks
HOT = 10_000  # rows of a key that one task joins
SLAB = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit: bit i is 1 if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    raw = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    a, b = starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(a), SLAB):
        h = np.fromiter(map(xxhash.xxh64_intdigest, [raw[s:e] for s, e in zip(a[i : i + SLAB], b[i : i + SLAB])], repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


class Tree:
    """A BK-tree of distinct fingerprints that forgets what a search has reached."""

    def __init__(self, keys: list[int]):
        self.keys = keys
        self.up = [-1] * len(keys)
        self.down: list[dict[int, int]] = [{} for _ in keys]
        self.left = [1] * len(keys)  # nodes of the subtree not reached yet
        self.fresh = [True] * len(keys)
        self.visited = 0  # nodes whose distance a search has taken
        for i in range(1, len(keys)):
            at = 0
            while True:
                self.left[at] += 1
                d = (keys[at] ^ keys[i]).bit_count()
                child = self.down[at].get(d)
                if child is None:
                    self.down[at][d] = i
                    self.up[i] = at
                    break
                at = child

    def take(self, i: int) -> None:
        self.fresh[i] = False
        while i >= 0:
            self.left[i] -= 1
            i = self.up[i]

    def near(self, key: int, radius: int) -> list[int]:
        """Nodes within the radius that were not reached before."""
        found, open_, visited = [], [0], 0
        while open_:
            i = open_.pop()
            if not self.left[i]:
                continue
            visited += 1
            d = (self.keys[i] ^ key).bit_count()
            if d <= radius and self.fresh[i]:
                found.append(i)
            down = self.down[i]
            if len(down) > 2 * radius + 1:
                open_ += [down[e] for e in range(d - radius, d + radius + 1) if e in down]
            else:
                open_ += [c for e, c in down.items() if -radius <= e - d <= radius]
        self.visited += visited
        return found


def stars(keys: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(key, smallest key of its component) for the keys that are not smallest themselves."""
    keys = sorted(set(keys))
    mask = (1 << 64) - 1
    tree = Tree([k & mask for k in keys])
    out = []
    for i, key in enumerate(keys):
        if not tree.fresh[i]:
            continue
        tree.take(i)
        queue = [i]
        while queue:
            for j in tree.near(tree.keys[queue.pop()], radius):
                tree.take(j)
                queue.append(j)
                out.append((keys[j], key))
    return out


def shards(keys: DataFrame, n: int, radius: int = RADIUS, blocks: int = BLOCKS, nodes: int = NODES) -> DataFrame:
    """(fp, b, v): the ``n`` fingerprints ``keys`` (fp) in each of their shards, choice ``b`` of blocks with value ``v``."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    sets = list(combinations(range(blocks), max(1, blocks - radius)))
    bits = max(0, (max(n, 1) // nodes).bit_length() - 1)  # that a shard's fingerprints agree on
    values = []
    for own in sets:
        v = F.lit(0).cast("long")
        for k, i in enumerate(own):
            width = min((bits + k) // len(own), edges[i + 1] - edges[i])
            v = F.shiftleft(v, width).bitwiseOR(F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1)))
        values.append(v)
    placed = F.array(*[F.struct(F.lit(i).alias("b"), v.alias("v")) for i, v in enumerate(values)])
    return keys.select("fp", F.explode(placed).alias("s")).select("fp", "s.b", "s.v")


def links(keys: DataFrame, radius: int = RADIUS, most: int = MOST, blocks: int = BLOCKS, nodes: int = NODES) -> DataFrame:
    """(u, v): stars of each shard's components over distinct fingerprints ``keys`` (fp)."""
    n = keys.count()
    placed = shards(keys, n, radius, blocks, nodes)
    hot = placed.groupBy("b", "v").agg(F.count("*").alias("n")).where(F.col("n") > most)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / most).cast("int")
    x = placed.join(hot, ["b", "v"], "left").select("fp", "b", "v", parts.alias("k"))
    x = x.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own")))
    x = x.select("fp", "b", "v", "own", F.explode(others).alias("j"))
    x = x.select("fp", "b", "v", F.least("own", "j").alias("p"), F.greatest("own", "j").alias("q"))

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            place = batch[["b", "v", "p", "q"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)]))
            rest = batch.iloc[starts[-1] :]
            yield _pairs(batch["fp"].to_numpy(), starts.tolist())
        if rest is not None:
            yield _pairs(rest["fp"].to_numpy(), [0, len(rest)])

    tasks = min(TASKS, 1 + n * comb(blocks, max(1, blocks - radius)) // TASK_ROWS)
    dealt = x.repartition(tasks, "b", "v", "p", "q").sortWithinPartitions("b", "v", "p", "q")
    return dealt.mapInPandas(run, "u long, v long")


def _pairs(fp: np.ndarray, starts: list[int]) -> pd.DataFrame:
    found = [e for a, b in zip(starts, starts[1:]) if b - a > 1 for e in stars(fp[a:b].tolist())]
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v): each node with a link, except the smallest of its component, with that smallest node.

    Large-star and small-star rounds alternate until the edges stay as they are.
    """
    now, was = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == was or not seen[0]:
            return now
        was = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both, least, "u", by="v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", by="v")
        old, now = now, cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        drop(old)
    raise RuntimeError("components did not settle")


def spread_join(left: DataFrame, right: DataFrame, key: str, most: int = HOT, by: str | None = None) -> DataFrame:
    """``left`` with the one row of ``right`` that each key has; a key with over ``most`` rows is dealt over parts.

    Rows are dealt by the column ``by``, or by their numbers. Then ``left`` must be read from files, so that rows have the same numbers in each attempt.
    """
    n = F.broadcast(left.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_n")).where("_n > 1"))  # at most one row for each ``most`` of ``left``
    parts = F.coalesce("_n", F.lit(1).cast("long"))
    row = F.xxhash64(by) if by else F.monotonically_increasing_id()
    x = left.join(n, key, "left").withColumn("_part", F.pmod(row, parts)).drop("_n")
    y = right.join(n, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n")
    return x.join(y, [key, "_part"]).drop("_part")


def _named(docs: DataFrame, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp); and fingerprints (fp, first, component): the least (no doc_id, doc_id, text_hash) of one, and its root."""
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), simhash("text").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = cut(prints.groupBy("fp").agg(first))
    roots = components(links(nodes.select("fp"), radius, most))
    named = cut(nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("component")))
    drop(nodes)
    drop(roots)
    return prints.select("doc_id", "fp"), named


def linked(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint and component_id of each row."""
    prints, named = _named(docs, radius, most)
    least = named.groupBy("component").agg(F.min("first").alias("least")).select("component", F.col("least.doc_id").alias("component_id"))
    known = cut(spread_join(named.select("fp", "component"), least, "component").select("fp", "component_id"))
    out = spread_join(prints, known, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row of ``docs`` of each component."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k_id"), F.col("doc_id").isNull().alias("k_null")]
    rows = docs.select(F.struct("*").alias("row"), *key, F.xxhash64("text").alias("k_hash"))
    # rows that share doc_id and text: one of them, before they are shuffled
    rows = rows.groupBy("k_id", "k_null", "k_hash").agg(F.first("row").alias("row"))
    named = _named(docs, radius, most)[1]
    keep = named.groupBy("component").agg(F.min("first").alias("k")).select("k.doc_id", F.col("k.text_hash").alias("k_hash")).select(*key, "k_hash")
    x = rows.join(keep, ["k_id", "k_null", "k_hash"], "left_semi")
    return x.select(*[F.col("row")[c].alias(c) for c in docs.columns])
