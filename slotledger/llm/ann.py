"""Approximate nearest neighbours by additive quantisation.

Full-dimensional codebooks are fitted by residual k-means on a bounded sample of ``SAMPLE``
vectors. A vector is encoded by beam search, which keeps the ``BEAM`` best partial sums. A query's
inner products with all codewords form a lookup table, so a score is a sum of lookups. By these a
shard's distinct vectors are scored again exactly, a ``STEP``-th share of them at a time, until a
whole step holds none of the best found; near copies that the codes can't tell apart make more
steps. ``step=1`` scores all exactly. The shard's best ``k`` go on.

Queries and rows meet in blocks: (query block, row shard), both of bounded size. The
product of blocks is the search of a stated query set against all rows. A row travels as its code and the bytes of its vector, in single precision where that is what it holds, once for each ``BLOCK`` queries.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, take no part; nor do those whose length is not the commonest. Equal vectors
are scored once a shard and tie by vec_id; of repeated rows with one vec_id each may be a
candidate. Columns other than vec_id and embedding are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOKS, WORDS, BEAM, SAMPLE = 16, 64, 4, 10_000
#: Of a shard's vectors that are scored exactly at a time, and how many times k at least.
STEP, LEAST = 1 / 16, 5
EVERY, TOP = 20, 20
SHARD, BLOCK = 8192, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    x = vectors.select("vec_id", v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return x.where(~bad & F.exists("vector", lambda c: c != 0))


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8) -> np.ndarray:
    """books x words x dimension."""
    rng = np.random.default_rng(7)
    rest, out = sample.copy(), []
    for _ in range(books):
        c = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(c)
            np.add.at(sums, near, rest)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        rest = rest - c[np.argmin((c * c).sum(1) - 2 * rest @ c.T, 1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x books) and lengths of the residuals, by beam search over sums of codewords."""
    codes, left = [], []
    for a in range(0, len(x), 1024):
        v = x[a : a + 1024]
        n = len(v)
        rest, path = v[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for c in books:
            cost = (rest**2).sum(2)[:, :, None] - 2 * rest @ c.T + (c * c).sum(1)
            flat = cost.reshape(n, -1)
            best = np.argsort(flat, 1, kind="stable")[:, :beam]
            src, word = best // len(c), best % len(c)
            rows = np.arange(n)[:, None]
            rest = rest[rows, src] - c[word]
            path = np.concatenate([path[rows, src], word[:, :, None].astype(np.uint8)], 2)
        codes.append(path[:, 0])
        left.append(np.linalg.norm(rest[:, 0], axis=1))
    return (np.concatenate(codes), np.concatenate(left)) if codes else (np.zeros((0, len(books)), np.uint8), np.zeros(0))


def reranked(score: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their exact scores, taken by lookup score ``step`` at a time, until a whole step holds none of the ``k`` best so far."""
    order = np.argsort(-score, kind="stable")
    got, least = np.zeros(0), -np.inf
    for a in range(0, len(order), step):
        new = exact(order[a : a + step])
        if a and (new < least).all():
            return order[: len(got)], got
        got = np.concatenate([got, new])
        least = np.partition(got, len(got) - k)[len(got) - k] if len(got) > k else -np.inf
    return order, got


def _search(q_ids, q, ids, x, codes, books, k, step) -> pd.DataFrame:
    order = np.argsort(ids, kind="stable")
    ids, x, codes = ids[order], x[order], codes[order]
    rank = {}
    group = np.fromiter((rank.setdefault(r.tobytes(), len(rank)) for r in x + 0.0), np.int64, len(x))
    first = np.unique(group, return_index=True)[1]
    x, codes = x[first], codes[first]
    by = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[by], np.arange(len(first) + 1))
    rows, step = [], max(math.ceil(step * len(first)), LEAST * k)
    for i, v in enumerate(q):
        table = books @ v
        near, exact = reranked(table[np.arange(len(books)), codes].sum(1), lambda n: (x[n] * v).sum(1), k + 1, step)  # one more, as the query may be among them
        if len(near) > k + 1:
            best = exact >= np.partition(exact, len(exact) - k - 1)[len(exact) - k - 1]
            near, exact = near[best], exact[best]
        members = [(-s, int(m)) for s, g in zip(exact.tolist(), near.tolist()) for m in ids[by[bounds[g] : bounds[g + 1]][: k + 1]] if m != q_ids[i]]
        rows += [(int(q_ids[i]), m, -s) for s, m in sorted(members)[:k]]
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = TOP, every: int = EVERY, sample: int = SAMPLE, step: float = STEP, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id ``every`` divides."""
    x = usable(vectors)
    lengths = x.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d, n = (lengths[0]["d"], lengths[0]["count"]) if lengths else (1, 0)
    x = x.where(F.size("vector") == d)
    most = min(1 << 20, 2 * (sample << 20) // max(n, 1))  # a threshold first, so that few rows leave the executors
    some = x.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) <= most)
    got = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()["vector"]
    books = fit(np.stack(got.to_numpy())) if len(got) else np.zeros((BOOKS, WORDS, d))
    shared = x.sparkSession.sparkContext.broadcast(books)  # BOOKS x WORDS x dimension, whatever the input

    def codes(batches):
        for b in batches:
            if len(b):
                v = np.stack(b["vector"].to_numpy())
                c = encode(v, shared.value)[0]
                small = v.astype(np.float32)
                v = small if (small == v).all() else v
                yield pd.DataFrame({"vec_id": b["vec_id"], "raw": [r.tobytes() for r in v], "code": [r.tobytes() for r in c]})

    coded = x.mapInPandas(codes, "vec_id long, raw binary, code binary")
    shards, queries = -(-n // shard), x.where(F.col("vec_id") % every == 0)
    blocks = -(-n // every // block) + 1
    left = queries.select("vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("b"), F.explode(F.expr(f"sequence(0L, {max(shards, 1) - 1}L)")).alias("s"))
    right = coded.select("vec_id", "raw", "code", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(shards, 1))).alias("s"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"))

    def meet(q, r):
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        code = np.frombuffer(b"".join(r["code"]), np.uint8).reshape(len(r), -1)
        return _search(q["vec_id"].to_numpy(), np.stack(q["vector"].to_numpy()), r["vec_id"].to_numpy(), np.stack([np.frombuffer(v, f"f{len(v) // d}") for v in r["raw"]]).astype(float), code, shared.value, k, step)

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # each task keeps k of a query before they meet
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
