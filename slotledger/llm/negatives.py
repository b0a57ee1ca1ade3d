"""Hard negatives by one-dimensional distance keys.

A vector becomes integers; with one more component, which fills its length up to the largest
length L of all rows, the largest inner product with a query is the smallest distance to it:
|q - x|^2 = |q|^2 + L^2 - 2 qx. Pivots are fitted by k-means on a bounded sample of ``SAMPLE``
rows; every row is stored under its nearest pivot, sorted by (pivot, distance to it), with the
quantile cell of that distance. A cell's least and largest distances are those of all its rows.

A query whose distance to a pivot is d meets a row at distance e of that pivot no nearer than
|d - e| and no farther than d + e. So it scans key intervals, whole cells, in the order of that
least distance: first those that hold a sixteenth of the rows it might need, then a quarter, then
all, and never beyond its k-th best distance so far; once all cells within that distance are
scanned, its k are certified. A search for scores in a range also leaves out cells that lie wholly
nearer or farther than the range. The result is exact. How much is left out depends on the vectors:
clusters save most of the work, independent random directions nearly nothing.

Queries and rows meet in blocks: at most about ``BLOCK`` queries of one pivot, and a chunk of a cell
of about ``CHUNK`` rows, so that a pivot, a cell or a label with a third of all rows is dealt over many tasks.

Defined results: a row without vec_id takes no part, nor one with a null label, a null vector or a
null or non-finite component. A row repeated whole counts once. Rows that share vec_id but differ
each count, and none of them is a candidate of another; equal scores and vec_ids go by label and vector.
Shorter vectors count as filled with zeros; empty and zero vectors take part. A score beyond +-2^62
counts as that. Columns other than vec_id, label and embedding are ignored, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.common import cut, drop

SCALE, ANCHORS, MOVED, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES, LEAST, MOST = 5, 3, 50, 95
SAMPLE, SAMPLE_BYTES, PIVOTS = 10_000, 64 << 20, 16
#: Rows of a cell, as the sample has them, and cells of a pivot at most.
CELL, CELLS = 2048, 64
CHUNK, BLOCK = 8192, 512
#: Of the rows that a query might need, how many each round reaches.
ROUNDS = (1 / 16, 1 / 4, 1.0)
LIMIT = 1 << 62
ROW = "vec_id long, rid long, label long, raw binary, pivot int, cell int, dist double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved where MOVED divides vec_id) and vector of the rows that take part, whole repeats once."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return x.where(~bad).withColumn("label", moved).dropDuplicates(["vec_id", "label", "vector"])


def whole(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * component), as doubles, or as Python's integers where doubles are not exact."""
    x = np.floor(np.asarray(v, float) * SCALE)
    if not len(x) or np.abs(x).max() < 1 << 52:
        return x
    return np.array([math.floor(c) * SCALE if abs(c) > 1 << 44 else math.floor(c * SCALE) for c in np.asarray(v, float).tolist()], object)


def pack(x: np.ndarray) -> bytes:
    """Integers in as few bytes as hold them, after a byte that says how many; larger ones as text."""
    if x.dtype == object:
        return b"0" + ",".join(map(str, x)).encode()
    most = np.abs(x).max() if len(x) else 0
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return b"%d" % size + x.astype(f"<i{size}").tobytes()


def unpack(raws) -> np.ndarray:
    """One row for each; doubles, or Python's integers where some are beyond them."""
    raws = list(raws)
    if len({(r[:1], len(r)) for r in raws}) == 1 and raws[0][:1] != b"0":
        return np.frombuffer(b"".join(r[1:] for r in raws), f"<i{int(raws[0][:1])}").reshape(len(raws), -1).astype(float)
    rows = [np.array(list(map(int, r[1:].split(b","))), object) if r[:1] == b"0" else np.frombuffer(r[1:], f"<i{int(r[:1])}") for r in raws]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), object if any(r.dtype == object for r in rows) else float)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def fill(x: np.ndarray, n: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, n - x.shape[1]))) if x.shape[1] < n else x


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact, within LIMIT."""
    d = max(q.shape[1], x.shape[1])
    q, x = fill(q, d), fill(x, d)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d < 1 << 53:
        return q.astype(float) @ x.astype(float).T
    ints = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(ints(q) @ ints(x).T, -LIMIT, LIMIT).astype(np.int64)


class Index:
    """Pivots (with the component beyond the vector's), the cells' bounds on distance, and their numbers of rows; its size is bounded by the parameters and the vectors' length."""

    def __init__(self, sample: np.ndarray, length: float, cells: int, pivots: int = PIVOTS, rounds: int = 8):
        self.length, self.slack = length, 1e-9 * (1 + length)
        x = self.raised(sample)
        rng = np.random.default_rng(5)
        self.pivots = x[rng.choice(len(x), min(pivots, len(x)), replace=False)].copy()
        for _ in range(rounds):
            near = self.distances(x).argmin(1)
            n = np.bincount(near, minlength=len(self.pivots))
            sums = np.zeros_like(self.pivots)
            np.add.at(sums, near, x)
            self.pivots[n > 0] = sums[n > 0] / n[n > 0, None]
        d = self.distances(x)
        near, own = d.argmin(1), d.min(1)
        at = np.linspace(0, 1, cells + 1)[1:-1]
        self.bounds = [np.quantile(own[near == p], at) if (near == p).any() else np.zeros(len(at)) for p in range(len(self.pivots))]
        self.cells = cells

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        with np.errstate(all="ignore"):
            return np.concatenate([x, np.sqrt(np.maximum(self.length**2 - (x * x).sum(1), 0))[:, None]], 1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To each pivot; a query's own last component is zero."""
        with np.errstate(all="ignore"):
            return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.pivots], 1)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, cell and distance of each row."""
        d = self.distances(self.raised(fill(x, self.pivots.shape[1] - 1)))
        p = d.argmin(1)
        own = d[np.arange(len(d)), p]
        return p, np.array([k * self.cells + np.searchsorted(self.bounds[k], e, "right") for k, e in zip(p, own)]), own

    def measured(self, rows) -> None:
        """Takes (cell, least, largest, n) of the cells that have rows."""
        self.cell, self.low, self.high, self.n = (np.array([r[i] for r in rows]) for i in range(4))
        self.at = self.cell // self.cells

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query its squared length, and its least and largest distance to the rows of each cell."""
        x = fill(np.asarray(q, float), self.pivots.shape[1] - 1)
        d = self.distances(np.concatenate([x, np.zeros((len(x), 1))], 1))[:, self.at]
        with np.errstate(all="ignore"):
            least = np.maximum(np.maximum(d - self.high, self.low - d), 0) - self.slack
            return (x * x).sum(1), np.where(np.isfinite(least), least, -1.0), d + self.high + self.slack

    def farthest(self, square: float, score) -> float:
        """How far from a query what has this score or more can be; no score, and the least, are beyond any distance."""
        return math.inf if score is None or score <= -LIMIT else math.sqrt(max(square + self.length**2 - 2 * float(score), 0.0))

    def nearest(self, square: float, score) -> float:
        """How near what has this score or less can be."""
        return 0.0 if score >= LIMIT else self.farthest(square, score) if score > -LIMIT else 0.0


def build(rows: DataFrame) -> tuple[DataFrame, Index] | None:
    """The stored rows (``ROW``), sorted by (pivot, distance), and their index; None without rows."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * SCALE).cast("double"), F.lit(2.0)))
    n, square, d = rows.agg(F.count("*"), F.max(square), F.max(F.size("vector"))).first()
    if not n:
        return None
    size = max(min(SAMPLE, SAMPLE_BYTES // (8 * max(d, 1))), PIVOTS)
    most = min(1 << 20, 2 * (size << 20) // n)  # a threshold first, so that few rows leave the executors
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= most).orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(size).select("vector").toPandas()["vector"]
    if not len(some):
        some = rows.orderBy("vec_id", "label").limit(size).select("vector").toPandas()["vector"]
    sample = fill(unpack([pack(whole(v)) for v in some]), d)
    found = Index(sample, math.sqrt(square), max(1, min(CELLS, n // (PIVOTS * CELL))))
    shared = rows.sparkSession.sparkContext.broadcast(found)  # PIVOTS x dimension and PIVOTS x CELLS numbers

    def store(batches):
        for b in batches:
            if len(b):
                raws = [pack(whole(v)) for v in b["vector"]]
                p, c, e = shared.value.place(unpack(raws))
                yield pd.DataFrame({"vec_id": b["vec_id"], "rid": b["rid"], "label": b["label"], "raw": raws, "pivot": p, "cell": c, "dist": e})

    keyed = rows.select("vec_id", F.xxhash64("label", "vector").alias("rid"), "label", "vector").mapInPandas(store, ROW)
    order = ["pivot", "dist", "vec_id"]
    stored = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order))
    found.measured(stored.groupBy("cell").agg(F.min("dist"), F.max("dist"), F.count("*")).orderBy("cell").collect())  # at most PIVOTS x CELLS rows
    return stored, found


def met(q: pd.DataFrame, x: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query of a block the k best rows of a chunk that it may have."""
    out: list[tuple] = []
    if len(q) and len(x):
        x = x.sort_values(["vec_id", "rid"])
        ids, rids, labels, rows = x["vec_id"].to_numpy(), x["rid"].to_numpy(), x["label"].to_numpy(), unpack(x["raw"])
        for a in range(0, len(q), 64):
            part = q.iloc[a : a + 64]
            for s, r in zip(scores(unpack(part["raw"]), rows), part.itertuples()):
                fits = (ids != r.own) & ((labels == r.label) == r.same) & (s >= r.low) & (s <= r.high)
                near = np.flatnonzero(fits)
                if len(near) > k:
                    least = np.partition(s[near], len(near) - k)[len(near) - k]
                    near = near[s[near] >= least]
                near = near[np.argsort(-s[near], kind="stable")[:k]]
                out += [(r.qid, int(ids[j]), int(rids[j]), int(s[j])) for j in near]
    return pd.DataFrame(out, columns=["qid", "vec_id", "rid", "score"]).astype("int64")


def search(queries: DataFrame, stored: DataFrame, index: Index, k: int, block: int = BLOCK, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(qid, rank, vec_id, rid, score): for each query the k rows of the highest scores, ties by vec_id; and (qid, visited), the rows that it met.

    Queries: a written table of qid, own (vec_id), raw, label, pivot, same (rows of its label, or of others alone), low and high (bounds of the score).
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)  # PIVOTS x dimension and PIVOTS x CELLS numbers
    blocks = {r[0]: -(-r[1] // block) for r in queries.groupBy("pivot").count().collect()}  # of at most PIVOTS pivots
    given = ["qid", "own", "raw", "label", "pivot", "same", "low", "high"]
    schema = "qid long, own long, raw binary, label long, pivot int, same boolean, low long, high long, reach double, visited long, block long, cells array<int>"
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid"))
    chunks = F.create_map(*[F.lit(int(v)) for c, n in zip(index.cell, index.n) for v in (c, -(-n // chunk))])
    own = F.pmod(F.xxhash64("vec_id", "rid"), F.element_at(chunks, F.col("cell"))).cast("int")
    rows = stored.select("vec_id", "rid", "label", "raw", "cell", own.alias("chunk"))

    def plan(share):
        def run(batches):
            x = shared.value
            for b in batches:
                if not len(b):
                    continue
                squares, least, most = x.reach(unpack(b["raw"]))
                reach, cells, visited = [], [], []
                for i, r in enumerate(b.itertuples()):
                    far, near = x.farthest(squares[i], r.low), x.nearest(squares[i], r.high)
                    useful = ~(least[i] > far + x.slack) & ~(most[i] < near - x.slack)
                    order = np.argsort(least[i][useful], kind="stable")
                    held = np.cumsum(x.n[useful][order])
                    end = least[i][useful][order][np.searchsorted(held, share * held[-1])] if len(held) else r.reach
                    end = max(min(end, x.farthest(squares[i], None if pd.isna(r.kth) else r.kth)), r.reach)
                    now = useful & (least[i] > r.reach) & (least[i] <= end)
                    reach.append(end)
                    cells.append(x.cell[now].tolist())
                    visited.append(r.visited + int(x.n[now].sum()))
                yield b[given].assign(reach=reach, visited=visited, block=[p * (1 << 32) + q % blocks[p] for p, q in zip(b["pivot"], b["qid"])], cells=cells)

        return run

    state = queries.select(*given, F.lit(-math.inf).alias("reach"), F.lit(0).cast("long").alias("visited"), F.lit(None).cast("long").alias("kth"))
    known = step = None
    for share in ROUNDS:
        before, step = step, cut(state.mapInPandas(plan(share), schema))
        if before is not None:
            drop(before)
        # what each query scans now, in its block, a cell's chunks each for itself
        left = step.select("qid", "own", "raw", "label", "same", "low", "high", "block", F.explode("cells").alias("cell"))
        left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(chunks, F.col("cell")) - 1)))
        by = ["block", "cell", "chunk"]
        right = rows.join(left.select(*by).distinct(), ["cell", "chunk"])
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, as both come from ``step``
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(lambda q, x: met(q, x, k), "qid long, vec_id long, rid long, score long")
        both = found if known is None else found.unionByName(known)
        old, known = known, cut(both.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        if old is not None:
            drop(old)
        kth = known.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        state = step.drop("block", "cells").join(kth, "qid", "left")
    return known.withColumn("rank", rank.cast("int")), step.select("qid", "visited")


def anchored(stored: DataFrame, index: Index, anchors: int = ANCHORS, positives: int = POSITIVES) -> DataFrame:
    """The anchors, as queries with qid, joined with the rows that are their positives; a written table."""
    asked = cut(stored.where(F.col("vec_id") % anchors == 0).withColumn("qid", F.monotonically_increasing_id()))
    any_ = [F.lit(True).alias("same"), F.lit(-LIMIT).alias("low"), F.lit(LIMIT).alias("high")]
    best, _ = search(asked.select("qid", F.col("vec_id").alias("own"), "raw", "label", "pivot", *any_), stored, index, positives)
    best = best.select(F.col("qid").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    x = best.join(asked.select(F.col("qid").alias("anchor"), F.col("vec_id").alias("own"), "raw", "label", "pivot"), "anchor")
    return cut(x.withColumn("qid", F.monotonically_increasing_id()))


def mine(vectors: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; and rows_met, of the search of that positive's negatives."""
    rows = cut(usable(vectors))
    built = build(rows)
    if built is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, rows_met long")
    drop(rows)
    pairs = anchored(*built, anchors, positives)
    # score * 100 between least and most of the positive's, in parts that can't leave a long
    share = lambda p: p * F.expr("(positive_score - pmod(positive_score, 100)) div 100"), lambda p: p * F.expr("pmod(positive_score, 100)")
    low = share[0](least) + F.ceil(share[1](least) / 100)
    high = share[0](most) + F.floor(share[1](most) / 100)
    asked = pairs.select("qid", "own", "raw", "label", "pivot", F.lit(False).alias("same"), low.alias("low"), high.alias("high"))
    found, visits = search(asked, *built, negatives)
    out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(visits, "qid").join(pairs.select("qid", F.col("own").alias("anchor_id"), "positive_id", "positive_score"), "qid")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("visited").alias("rows_met"))


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(c * 256)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""
