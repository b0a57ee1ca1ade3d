"""Vector and lexical top-k, latest-per-slot rewriting, links and graph walks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotledger.functions.text import dot, strip, words


def scored_within(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Inner products of queries (query_id, episode_id, vector) with the entries of their own episode."""
    x = queries.select("query_id", "episode_id", F.col("vector").alias("q")).join(entries, "episode_id")
    return x.where("entry_id <> query_id").select("query_id", "entry_id", "slot", "event_idx", F.round(dot(F.col("q"), F.col("vector")), 6).alias("score"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def latest_per_slot(scored: DataFrame, k: int) -> DataFrame:
    """Of each slot the newest entry alone, then the k of best score; entries without a slot stay."""
    w = Window.partitionBy("query_id", "slot").orderBy(F.desc("event_idx"), F.desc("score"), "entry_id")
    kept = scored.withColumn("n", F.row_number().over(w)).where("n = 1 or slot is null").drop("n")
    return top_k(kept, k)


def confident_top_k(scored: DataFrame, confidence: str, k: int) -> DataFrame:
    """3k by score, then k by the mean of score and confidence."""
    wide = top_k(scored, 3 * k).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc("mixed"), "entry_id")
    mixed = F.round(0.5 * F.col(confidence) + 0.5 * F.col("score"), 7)
    return wide.withColumn("mixed", mixed).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def lexical_top_k(queries: DataFrame, texts: DataFrame, key: str, k: int) -> DataFrame:
    """Texts of the query's key by shared terms, then recency."""
    x = queries.select(key, "query").join(texts, key).where(strip(F.col("text")) != "")
    x = x.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(words(F.col("query"))), words(F.col("text")))).cast("long"))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), F.desc("idx"))
    return x.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def merged(lists: list[DataFrame], key: str, item: str) -> DataFrame:
    """(key, item, source, rank, place): ranked lists one after the other, each item at its first place alone."""
    x = [d.select(key, item, F.lit(i).alias("source"), "rank") for i, d in enumerate(lists)]
    for other in x[1:]:
        x[0] = x[0].unionByName(other)
    first = x[0].groupBy(key, item).agg(F.min(F.struct("source", "rank")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long")
    return first.select(key, item, "first.source", "first.rank", place.alias("place"))


def links(entries: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (src, dst) of a key with an inner product of at least ``least``; src is the later entry."""
    a, b = entries.alias("a"), entries.alias("b")
    x = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.entry_id") < F.col("a.entry_id")))
    return x.where(dot(F.col("a.vector"), F.col("b.vector")) >= least).select(F.col("a.entry_id").alias("src"), F.col("b.entry_id").alias("dst"))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node) reached from (start) in at most ``depth`` steps over undirected edges."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seen = starts.select("start", F.col("start").alias("node"))
    for _ in range(depth):
        front = front.join(both, front["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen.where("start <> node")


def dense(edges: DataFrame, entries: DataFrame, key: str, degree: int, least: float) -> DataFrame:
    """(key, entry_id, degree, weight, place): entries with ``degree`` links or more and a confidence of ``least`` or more, by degree times confidence."""
    n = edges.select(F.explode(F.array("src", "dst")).alias("entry_id")).groupBy("entry_id").agg(F.count("*").alias("degree")).where(F.col("degree") >= degree)
    x = entries.where(F.col("confidence") >= least).select(key, "entry_id", "confidence").join(n, "entry_id")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "entry_id")).cast("long")
    return x.select(key, "entry_id", "degree", F.round(F.col("degree") * F.col("confidence"), 6).alias("weight")).withColumn("place", place)


def evicted(entries: DataFrame, key: str, item: str, confidence: str, at: str, grace: int) -> DataFrame:
    """(key, item): of each key the entry of least confidence, of those more than ``grace`` seconds older than its newest, if there are any; ties to the older one."""
    newest = entries.groupBy(F.col(key).alias("_key")).agg(F.max(at).alias("_newest"))
    x = entries.join(newest, entries[key].eqNullSafe(F.col("_key")))
    young = (F.col("_newest") - F.make_dt_interval(secs=F.lit(grace)) <= F.col(at)).cast("int")
    return x.groupBy(key).agg(F.min_by(item, F.struct(young, confidence, at, item)).alias(item))


#: Rows of a block of queries and of a block of entries; a task meets one of each. Partial results grow with the number of the latter.
BLOCK, WIDE = 2048, 32_768


def block_pairs(entries: DataFrame, key: str, meet, schema: str, block: int, wide: int) -> DataFrame:
    """``meet(queries, entries)`` for all pairs of blocks of a key's rows, each pair a task's work.

    Rows are dealt by the hash of entry_id to as many blocks of ``block`` queries and ``wide`` entries as the key's count needs.
    """
    n = entries.groupBy(F.col(key).alias("n_key")).agg(*[F.ceil(F.count("*") / size).cast("int").alias(name) for name, size in (("qs", block), ("es", wide))])
    x = entries.join(n, entries[key].eqNullSafe(F.col("n_key"))).drop("n_key")
    own = lambda c: F.pmod(F.xxhash64("entry_id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = x.withColumn("qb", own("qs")).withColumn("eb", each("es")).drop("qs", "es")
    right = x.withColumn("eb", own("es")).withColumn("qb", each("qs")).drop("qs", "es")
    by = [key, "qb", "eb"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, as both come from ``entries``
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, schema)


def top_k_within(entries: DataFrame, key: str, k: int, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """query_id, entry_id, score, rank: for every entry the k best others of its key, as ``top_k`` of ``scored_within`` has them."""

    def meet(q, e):
        rows = []
        if len(q) and len(e):
            e = e.sort_values("entry_id", kind="stable")
            ids, x, own, v = e["entry_id"].to_numpy(), np.stack(e["vector"].to_numpy()), q["entry_id"].to_numpy(), np.stack(q["vector"].to_numpy())
            for a in range(0, len(v), 64):
                score = np.round(v[a : a + 64] @ x.T, 6)
                for i, s in zip(own[a : a + 64], score):
                    least = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
                    near = np.flatnonzero(s >= least)  # the k + 1 best and their ties, of which the own row is at most one
                    near = near[ids[near] != i]
                    rows += [(i, ids[j], s[j]) for j in near[np.argsort(-s[near], kind="stable")[:k]]]
        return pd.DataFrame(rows, columns=["query_id", "entry_id", "score"])

    return top_k(block_pairs(entries, key, meet, "query_id long, entry_id long, score double", block, wide), k)


def links_within(entries: DataFrame, key: str, least: float, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """The pairs of ``links``, found in pairs of blocks."""

    def meet(q, e):
        if not len(q) or not len(e):
            return pd.DataFrame({"src": [], "dst": []}).astype("int64")
        a, b = q["entry_id"].to_numpy(), e["entry_id"].to_numpy()
        v, x, out = np.stack(q["vector"].to_numpy()), np.stack(e["vector"].to_numpy()), []
        for i in range(0, len(a), 64):
            r, c = np.nonzero((v[i : i + 64] @ x.T >= least) & (b[None, :] < a[i : i + 64, None]))
            out.append(pd.DataFrame({"src": a[i : i + 64][r], "dst": b[c]}))
        return pd.concat(out)

    return block_pairs(entries, key, meet, "src long, dst long", block, wide)


def newest_within(entries: DataFrame, key: str, k: int) -> DataFrame:
    """``latest_per_slot`` for every entry as query.

    Without the query itself a slot's newest entries are among those of its two newest indices.
    """
    w = Window.partitionBy(key, "slot").orderBy(F.desc("event_idx"))
    some = entries.withColumn("n", F.dense_rank().over(w)).where("n <= 2 or slot is null").drop("n")
    return latest_per_slot(scored_within(entries.select(F.col("entry_id").alias("query_id"), key, "vector"), some), k)
