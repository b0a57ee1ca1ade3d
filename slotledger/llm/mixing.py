"""Mixing sources to target weights by capped water-filling.

Sources, in code point order with null last, get ``weights`` in turn and share ``share`` times all
words. A source stops at ``epochs`` times its own words; what it can't take is shared again among
the others by weight, round after round, until none is above. This level rises from below to where
the targets sum to the share, as Newton's steps on a concave function do, so rounds are few; each is
one aggregate over the table of sources, and two numbers reach the driver.

A target of r times a source's words is sampled by repetition: every document whole, floor(r) times,
and the remaining words in a seeded order of the documents, of which the last is taken in part. Where
that order stops is found by histograms of the order's key, 12 bits at a time, so that no source is
ever sorted or held in one task: a source's rows meet only as sums of at most ``CELLS`` cells, and the
last cell holds about one document in ``CELLS`` squared.

Defined results: a null text has size 0; a source without words has the target 0; with ``share`` of
``epochs`` or more every source stops at its cap. Repeated rows, and rows that the seeded key can't tell apart, share
what falls to them evenly, rounded down, so reruns agree whatever the partitions. A null doc_id is an empty one in the key.
Columns other than doc_id, text and source are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotledger.llm.common import WORD, cut, drop

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 11
#: Of a histogram of the 60-bit key; and the bits below its two levels.
CELLS, UPPER, LOWER = 4096, 48, 36
#: A source with over one row in so many of all is joined from a broadcast of at most so many rows.
HOT = 1000


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and the 60-bit key of the seeded order."""
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("key"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank from 0 by code point, null last; a written table, as ranks of a range sort hold for one run of it."""
    parts = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    n = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    out = cut(parts.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.col("before") + row).drop("at", "part", "before"))
    drop(parts)
    return out


def level(sources: DataFrame, total: float, epochs: float) -> float | None:
    """The water level: a source of weight w gets w times it, up to its cap; None where all stop at their caps."""
    cap = epochs * F.col("source_size")
    now, clamped = 0.0, -1
    while True:
        full = cap < F.col("weight") * now
        n, caps, weights = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weights or n == clamped:
            return now if weights else None
        now, clamped = (total - (caps or 0.0)) / weights, n


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, rows) with weight and target."""
    given = F.array(*[F.lit(float(w)) for w in weights])
    x = ranked(sources).withColumn("weight", F.get(given, F.col("rank") % len(weights)))
    words = x.agg(F.sum("source_size")).first()[0] or 0
    at, cap = level(x, share * words, epochs), epochs * F.col("source_size")
    return x.withColumn("target", cap if at is None else F.least(cap, F.col("weight") * at)).drop("weight", "rank")


def with_source(rows: DataFrame, sources: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the one row of ``sources`` that each has (null is a source); those of ``hot`` ones (source) never meet in a task."""
    rows, few = rows.withColumnRenamed("source", "own"), F.broadcast(hot)
    named = lambda x: x.withColumnRenamed("source", "other")
    same = F.col("own").eqNullSafe(F.col("other"))
    heavy = F.broadcast(named(sources.join(few, sources["source"].eqNullSafe(hot["source"]), "left_semi")))
    one = rows.join(heavy, same)
    two = rows.join(F.broadcast(named(hot)), same, "left_anti").join(named(sources), same)
    return one.unionByName(two).drop("other").withColumnRenamed("own", "source")


def crossing(cells: DataFrame, *keep: str) -> DataFrame:
    """Of each source's cells (source, cell, words, left) the first at whose end the running sum reaches ``left``; words before it are taken off ``left``."""
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    x = cells.withColumn("sum", F.sum("words").over(w))
    return x.where((F.col("left") > F.col("sum") - F.col("words")) & (F.col("left") <= F.col("sum"))).withColumn("left", F.col("left") - F.col("sum") + F.col("words")).drop("sum").select("source", "cell", "words", "left", *keep)


def stops(docs: DataFrame, sources: DataFrame, hot: DataFrame) -> DataFrame:
    """Where each source's seeded order stops: (source, stop, left, words), the key there, what is left for its rows, and their words. Sources (source, left) with nothing left have none."""
    wants = sources.where("left > 0").select("source", "left")
    cells = docs.groupBy("source", F.shiftright("key", UPPER).alias("cell")).agg(F.sum("size").alias("words"))  # at most CELLS rows of a source
    first = cut(crossing(with_source(cells, wants, hot)))
    inside = with_source(docs, first.select("source", "left", F.col("cell").alias("first")), hot).where(F.shiftright("key", UPPER) == F.col("first"))
    cells = inside.groupBy("source", "left", "first", F.shiftright("key", LOWER).alias("cell")).agg(F.sum("size").alias("words"))
    second = cut(crossing(cells))
    inside = with_source(docs, second.select("source", "left", F.col("cell").alias("second")), hot).where(F.shiftright("key", LOWER) == F.col("second"))
    last = cut(crossing(inside.groupBy("source", "left", F.col("key").alias("cell")).agg(F.sum("size").alias("words"))))
    drop(first)
    drop(second)
    return last.withColumnRenamed("cell", "stop")


def taken(size: Column, key: Column) -> Column:
    """Words of a document: its whole repetitions, and its part of the words beyond."""
    exact = lambda c: c.cast("decimal(19,0)")
    even = F.floor(exact(size) * exact(F.col("left")) / exact(F.col("words"))).cast("long")
    more = F.when(F.col("stop").isNull() | (key > F.col("stop")), 0).when(key < F.col("stop"), size).when(size == F.col("words"), F.col("left")).otherwise(even)
    return (F.col("whole") * size + more).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row, with its source."""
    rows = cut(sized(docs, seed))
    sums = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    n = sums.agg(F.sum("rows")).first()[0] or 0
    hot = sums.where(F.col("rows") * HOT > n).select("source")  # under HOT rows
    x = cut(targets(sums.drop("rows"), weights, share, epochs))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    x = x.withColumn("whole", whole.cast("long")).withColumn("left", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    last = stops(rows, x, hot).withColumnsRenamed({"source": "at"})
    known = x.drop("left").join(last, x["source"].eqNullSafe(last["at"]), "left").drop("at")
    out = with_source(rows, known, hot)
    return out.select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"), "source")


ORACLE = """WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER w AS i, coalesce(sum(2.0::DOUBLE * source_size) OVER w - 2.0::DOUBLE * source_size, 0) AS caps, sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight DESC, source DESC NULLS FIRST) AS weights,
1.5::DOUBLE * sum(source_size) OVER () AS total FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST)),
l AS (SELECT (total - caps) / weights AS level FROM o WHERE cap >= weight * ((total - caps) / weights) ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM o, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, source_size, target, whole, CAST(round(target) AS BIGINT) - whole * source_size AS remain, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(whole * size + greatest(0, least(size, remain - before)) AS BIGINT) AS taken FROM r"""
