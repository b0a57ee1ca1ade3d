"""URL filters: host and path rules first, a Bloom filter cascade for the rest.

Listed keys are hosts with a page under a block rule: what else they have is blocked too, where no
rule says otherwise. The
key universe is every host of the corpus. Level 1 of the cascade encodes the listed
hosts, level 2 the unlisted ones that level 1 lets through, level 3 the listed ones that
level 2 lets through, and so on until nothing is let through wrongly; over that universe
the first level that says no then gives exact membership, and no join is needed.

The universe is dealt by hash into shards of about ``KEYS`` hosts, each with a cascade of its own, built
in one task and of bounded size; nothing of it passes the driver. A shard's levels travel to the tasks
that read its pages, ahead of them; a shard with over ``ROWS`` pages, as of one host with a large share of
all, is dealt over several tasks, each with a copy of the levels. It is the same at every size.

Defined results: a null url or one without ``://`` has an empty host and path, which no
rule fits and which is never listed, so it is allowed; urls of any length are read whole; repeated rows are judged alike;
columns other than page_id and url are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.llm.common import LOWER, UPPER, ascii_lower, cut

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS_PER_KEY = 10
HASHES = 5
KEYS = 1 << 18  # of a shard
ROWS = 1 << 20  # pages that a task judges with one copy of a shard's levels
LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, else null."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _spots(h: np.ndarray, level: int, m: int) -> np.ndarray:
    """The ``HASHES`` bits of each key, of which two 64-bit hashes are given, at a level of ``m`` bits."""
    x = h + np.array([2 * level + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # each level mixes anew
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    i = np.arange(HASHES, dtype=np.uint64)
    return (x[:, :1] + i * (x[:, 1:] | np.uint64(1))) % np.uint64(m)


def _holds(bits: np.ndarray, h: np.ndarray, level: int) -> np.ndarray:
    at = _spots(h, level, 8 * len(bits))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(1)


def build(h: np.ndarray, listed: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> list[bytes]:
    """The levels over keys with hashes ``h`` (keys x 2, unsigned)."""
    inside, outside, levels = h[listed], h[~listed], []
    while len(inside):
        if len(levels) == LEVELS:
            raise RuntimeError("a listed key and another have the same hashes")
        m = 8 * -(-len(inside) * bits_per_key // 8)
        bits = np.zeros(m, np.uint8)
        bits[_spots(inside, len(levels), m).ravel()] = 1
        bits = np.packbits(bits, bitorder="little")
        inside, outside = outside[_holds(bits, outside, len(levels))], inside
        levels.append(bits.tobytes())
    return levels


def walk(levels: list[bytes], h: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed: the parity of the first level that says no."""
    open_, listed = np.arange(len(h)), np.zeros(len(h), bool)
    for i, raw in enumerate(levels):
        open_ = open_[_holds(np.frombuffer(raw, np.uint8), h[open_], i)]
        listed[open_] = i % 2 == 0
    return listed


def _unsigned(x: pd.DataFrame) -> np.ndarray:
    return x[["_h1", "_h2"]].to_numpy(np.int64).view(np.uint64)


def _hashed(df: DataFrame, shards: int) -> DataFrame:
    h1, h2 = F.xxhash64("host", F.lit(1)), F.xxhash64("host", F.lit(2))
    return df.select("*", h1.alias("_h1"), h2.alias("_h2"), F.pmod(F.xxhash64("host", F.lit(3)), F.lit(shards)).alias("_shard"))


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """_shard and levels (array<binary>) over ``keys`` (distinct host, listed boolean)."""

    def run(key, x):
        return pd.DataFrame({"_shard": [key[0]], "levels": [build(_unsigned(x), x["listed"].to_numpy(bool))]})

    return _hashed(keys, shards).select("_shard", "_h1", "_h2", "listed").groupBy("_shard").applyInPandas(run, "_shard long, levels array<binary>")


def member(rows: DataFrame, keys: DataFrame, per_shard: int = KEYS, per_task: int = ROWS) -> DataFrame:
    """``rows`` with whether each one's host is listed; ``keys`` holds every host of them."""
    shards = max(1, -(-keys.count() // per_shard))
    x = _hashed(rows, shards)
    copies = F.ceil(F.count("*") / per_task).cast("long")
    n = dict(x.groupBy("_shard").agg(copies.alias("n")).where("n > 1").collect())  # at most a row for each shard and each per_task rows
    many = F.coalesce(F.try_element_at(F.lit([n.get(i, 1) for i in range(shards)]), (F.col("_shard") + 1).cast("int")), F.lit(1)) if n else F.lit(1)
    x = x.select("*", F.pmod(F.monotonically_increasing_id(), many.cast("long")).alias("_part"), F.lit(None).cast("array<binary>").alias("levels"))
    none = [F.lit(0).cast("long").alias(c) for c in ("_h1", "_h2")]  # nulls would turn the hashes into floats
    sent = cascades(keys, shards).select("_shard", "levels", *none, F.explode(F.sequence(F.lit(0).cast("long"), many.cast("long") - 1)).alias("_part"))
    both = x.unionByName(sent, allowMissingColumns=True)
    names = rows.columns

    def run(batches):
        own: list[bytes] = []
        for b in batches:
            head = np.flatnonzero(b["levels"].notna())  # the levels of a shard come before its rows
            edges = np.unique(np.concatenate([[0], head, [len(b)]]))
            for a, z in zip(edges, edges[1:]):
                part = b.iloc[a:z]
                if part["levels"].iloc[0] is not None:
                    own, part = [bytes(v) for v in part["levels"].iloc[0]], part.iloc[1:]
                if len(part):
                    yield part[names].assign(listed=walk(own, _unsigned(part)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = both.repartition("_shard", "_part").sortWithinPartitions("_shard", "_part", F.col("levels").isNull())
    return dealt.mapInPandas(run, f"{schema}, listed boolean")


def judge(pages: DataFrame, rules=RULES, per_shard: int = KEYS, per_task: int = ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row."""
    host, path = host_and_path(F.col("url"))
    kind = pages.schema["page_id"].dataType
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), host.alias("host"), path.alias("path"))  # pandas would make floats of numbers and nulls
    rows = rows.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "path")])
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    blocked = F.count_if(F.col("ruled").eqNullSafe("block")) > 0
    keys = cut(rows.groupBy("host").agg(blocked.alias("listed")).select("host", (F.col("listed") & (F.col("host") != "")).alias("listed")))
    found = member(rows, keys, per_shard, per_task)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


ORACLE = f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
k AS (SELECT host, host <> '' AND count(*) FILTER (rule IN ('net/', 'example.com/de/')) > 0 AS listed FROM v GROUP BY host)
SELECT page_id, v.host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM v JOIN k ON v.host = k.host
"""
