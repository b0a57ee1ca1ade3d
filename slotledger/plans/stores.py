"""Registered queries of stores that change in order, threshold sweeps, running means and merged lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.functions import text
from slotledger.operators import folds, prefix, retrieval, store
from slotledger.plans.registry import FACTS, SCORED, VECTORS, every, facts, query, vectors
from slotledger.sources.facts import table

#: Requests over the event log: views add, clicks update, errors delete, the rest does nothing; ``k`` of an event's properties is the id that it names.
ASKED = f"""{FACTS}, named AS (SELECT *, CAST(json_extract(props, '$.k') AS VARCHAR) AS target FROM events),
asked AS (SELECT f.episode_id, f.event_idx, CASE f.attribute WHEN 'view' THEN 'ADD' WHEN 'click' THEN 'UPDATE' WHEN 'error' THEN 'DELETE' ELSE 'NOOP' END AS op,
n.target, f.value AS slot FROM facts f JOIN named n ON n.user_id = f.episode_id AND n.ts = f.ts),
drawn AS (SELECT *, CAST('0x' || md5('17:explore:' || episode_id || ':' || event_idx)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS explore,
CAST('0x' || md5('17:pick:' || episode_id || ':' || event_idx)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS pick,
CAST('0x' || md5('17:aim:' || episode_id || ':' || event_idx)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS aim FROM asked)"""
#: The store is a list of (id, slot, since), in the order of its entries.
REPLAYED = f"""WITH RECURSIVE {ASKED}, runs AS (SELECT DISTINCT episode_id, policy FROM asked, (SELECT unnest(['plain', 'seed', 'explore']) AS policy)),
step AS (SELECT episode_id, policy, -1::BIGINT AS event_idx, []::STRUCT(id BIGINT, slot VARCHAR, since BIGINT)[] AS store, NULL::VARCHAR AS requested, NULL::VARCHAR AS effective, NULL::BIGINT AS entry, NULL::VARCHAR AS how, NULL::VARCHAR AS told FROM runs
UNION ALL SELECT episode_id, policy, event_idx, CASE WHEN effective = 'ADD' THEN list_append(store, {{'id': event_idx, 'slot': CASE WHEN op = 'UPDATE' THEN NULL ELSE slot END, 'since': event_idx}})
WHEN op = 'UPDATE' AND entry IS NOT NULL THEN list_transform(store, lambda e: CASE WHEN e.id = entry THEN {{'id': e.id, 'slot': slot, 'since': event_idx}} ELSE e END)
WHEN op = 'DELETE' AND entry IS NOT NULL THEN list_filter(store, lambda e: e.id <> entry) ELSE store END, op, effective, entry, how, target
FROM (SELECT *, CASE WHEN op = 'UPDATE' AND len(store) = 0 THEN 'ADD' ELSE op END AS effective,
CASE WHEN op = 'ADD' OR op = 'UPDATE' AND len(store) = 0 THEN event_idx WHEN op = 'NOOP' THEN NULL ELSE coalesce(direct, own) END AS entry,
CASE WHEN op NOT IN ('UPDATE', 'DELETE') THEN NULL WHEN direct IS NOT NULL THEN 'direct_id' WHEN own IS NOT NULL THEN 'slot' ELSE 'none' END AS how FROM (
SELECT * EXCLUDE (target), CASE WHEN op IN ('UPDATE', 'DELETE') THEN target END AS target, list_filter(store, lambda e: CAST(e.id AS VARCHAR) = target)[1].id AS direct,
list_reverse_sort(list_transform(list_filter(store, lambda e: e.slot = slot), lambda e: {{'since': e.since, 'id': e.id}}))[1].id AS own FROM (
SELECT s.episode_id, s.policy, d.event_idx, s.store, d.slot,
CASE WHEN s.policy = 'seed' AND len(s.store) = 0 THEN 'ADD' WHEN s.policy = 'explore' AND d.explore < 0.1 THEN
CASE WHEN len(s.store) = 0 OR d.pick < 0.35 THEN 'ADD' WHEN d.pick - 0.35 - 0.3 < 0 THEN 'UPDATE' WHEN d.pick - 0.35 - 0.3 - 0.15 < 0 THEN 'DELETE' ELSE 'NOOP' END ELSE d.op END AS op,
CASE WHEN s.policy = 'explore' AND d.explore < 0.1 THEN CAST(s.store[1 + CAST(floor(d.aim * len(s.store)) AS BIGINT)].id AS VARCHAR) ELSE d.target END AS target
FROM step s JOIN drawn d ON d.episode_id = s.episode_id AND d.event_idx = s.event_idx + 1)))),
logged AS (SELECT *, requested = 'NOOP' OR entry IS NOT NULL AS success, requested IN ('UPDATE', 'DELETE') AND entry IS NOT NULL AND told <> CAST(entry AS VARCHAR) AS fallback FROM step WHERE event_idx >= 0)"""
OPS = "ADD UPDATE DELETE NOOP".split()
COUNTED = ", ".join(f"count(*) FILTER ({c} = '{o}') AS {c}_{o.lower()}" for c in ("requested", "effective") for o in OPS)


def asked(spark, sf):
    """Requests over the event log, with slots and named ids."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("episode_id"), "ts", F.get_json_object("props", "$.k").alias("target_id"))
    kinds = F.when(F.col("attribute") == "view", "ADD").when(F.col("attribute") == "click", "UPDATE").when(F.col("attribute") == "error", "DELETE").otherwise("NOOP")
    return facts(spark, sf).join(e, ["episode_id", "ts"]).select("episode_id", "event_idx", kinds.alias("operation"), "target_id", "entity", F.col("value").alias("attribute"))


@query(REPLAYED + " SELECT episode_id, event_idx, requested, effective, coalesce(entry, -1) AS entry_id, coalesce(how, '') AS how, success, fallback FROM logged WHERE policy = 'plain'")
def resolved_targets(spark, sf):
    """What each request meant in the store at its event: by id, else by slot, else nothing (-1)."""
    return store.executed(asked(spark, sf)).fillna({"entry_id": -1, "how": ""})


@query(REPLAYED + f" SELECT policy, episode_id, {COUNTED}, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS failed, count(*) FILTER (fallback) AS fallback_target FROM logged GROUP BY ALL")
def execution_accounts(spark, sf):
    """Accounts of the plain, the seeded and the exploring policy."""
    rows = asked(spark, sf)
    kinds = [store.executed(rows, p).withColumn("policy", F.lit(p)) for p in ("plain", "seed", "explore")]
    return store.accounted(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "policy", "episode_id")


#: The store is a list of (id, last, n, reward, v).
SEMANTIC = f"""WITH RECURSIVE {VECTORS}, asked AS (SELECT episode_id, event_idx, vector, slot / 10.0::DOUBLE AS reward, CASE WHEN slot < 5 THEN 'ADD' WHEN slot < 8 THEN 'UPDATE' ELSE 'DELETE' END AS op,
row_number() OVER (PARTITION BY episode_id ORDER BY event_idx) AS n FROM vectors),
step AS (SELECT DISTINCT episode_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, last BIGINT, n BIGINT, reward DOUBLE, v DOUBLE[])[] AS store FROM asked
UNION ALL SELECT episode_id, n, CASE WHEN op = 'ADD' THEN list_append(store, {{'id': event_idx, 'last': event_idx, 'n': 1, 'reward': reward, 'v': vector}})
WHEN op = 'UPDATE' THEN list_transform(store, lambda e: CASE WHEN e.id = near THEN {{'id': e.id, 'last': event_idx, 'n': e.n + 1, 'reward': greatest(e.reward, reward), 'v': vector}} ELSE e END)
ELSE list_filter(store, lambda e: near IS NULL OR e.id <> near) END FROM (
SELECT a.*, s.store, list_sort(list_transform(s.store, lambda e: {{'s': -list_inner_product(e.v, a.vector), 'id': e.id}}))[1].id AS near FROM step s JOIN asked a ON a.episode_id = s.episode_id AND a.n = s.n + 1)),
last AS (SELECT episode_id, unnest(store) AS e FROM step QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC) = 1)"""


def semantic_requests(spark, sf):
    kind = F.when(F.col("slot") < 5, "ADD").when(F.col("slot") < 8, "UPDATE").otherwise("DELETE")
    return vectors(spark, sf).select("episode_id", "event_idx", kind.alias("operation"), (F.col("slot") / 10).alias("reward"), "vector")


@query(SEMANTIC + " SELECT episode_id, e.id AS entry_id, e.last AS last_idx, e.n AS n_writes, e.reward AS reward FROM last")
def semantic_store(spark, sf):
    """Entries after adds, and updates and deletes of the most similar entry of the store as it is."""
    return store.stored(semantic_requests(spark, sf), semantic=True).select("episode_id", "entry_id", "last_idx", "n_writes", "reward")


THRESHOLDS = (0.2, 0.25, 0.3, 0.35, 0.4, 0.45)
UPSERTS = f"""WITH RECURSIVE {VECTORS}, rows AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY event_idx) AS n FROM vectors),
step AS (SELECT DISTINCT episode_id, least, 0::BIGINT AS n, []::STRUCT(n BIGINT, last BIGINT, v DOUBLE[])[] AS store FROM rows, (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS least)
UNION ALL SELECT episode_id, least, n, CASE WHEN best.s IS NULL OR -best.s < least THEN list_append(store, {{'n': 1, 'last': event_idx, 'v': vector}})
ELSE list_transform(store, lambda e, i: CASE WHEN i = best.i THEN {{'n': e.n + 1, 'last': event_idx, 'v': vector}} ELSE e END) END FROM (
SELECT r.*, s.least, s.store, list_sort(list_transform(s.store, lambda e, i: {{'s': -list_inner_product(e.v, r.vector), 'i': i}}))[1] AS best FROM step s JOIN rows r ON r.episode_id = s.episode_id AND r.n = s.n + 1)),
last AS (SELECT episode_id, least, unnest(store) AS e FROM step QUALIFY row_number() OVER (PARTITION BY episode_id, least ORDER BY n DESC) = 1)"""


@query(UPSERTS + " SELECT least AS threshold, episode_id, count(*) AS size, CAST(sum(e.n) AS BIGINT) AS n_writes, max(e.n) AS most_writes FROM last GROUP BY ALL")
def threshold_stores(spark, sf):
    """Six thresholds of the similarity upsert over one shuffle and one sort."""
    x = folds.similarity_sweep(vectors(spark, sf), THRESHOLDS)
    return x.groupBy("threshold", "episode_id").agg(F.count("*").alias("size"), F.sum("n_writes").alias("n_writes"), F.max("n_writes").alias("most_writes"))


@query(UPSERTS + ", one AS (SELECT least, episode_id, count(*) AS size, sum(e.n) FILTER (e.n > 1) AS again FROM last GROUP BY ALL) SELECT least AS threshold, count(*) AS episodes, round(avg(size), 6) AS mean_size, round(avg(coalesce(again, 0)), 6) AS mean_again FROM one GROUP BY least ORDER BY least")
def threshold_table(spark, sf):
    """The sweep as a table, by threshold."""
    x = folds.similarity_sweep(vectors(spark, sf), THRESHOLDS).groupBy("threshold", "episode_id").agg(F.count("*").alias("size"), F.sum(F.when(F.col("n_writes") > 1, F.col("n_writes")).otherwise(0)).alias("again"))
    return x.groupBy("threshold").agg(F.count("*").alias("episodes"), F.round(F.avg("size"), 6).alias("mean_size"), F.round(F.avg("again"), 6).alias("mean_again")).orderBy("threshold")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY event_id) AS n, avg(CAST(floor(value) AS BIGINT)) OVER (ORDER BY event_id) AS a, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) OVER (ORDER BY event_id) AS b, count(*) OVER () AS total FROM events)
SELECT n, round(a, 6) AS mean_value, round(b, 6) AS error_rate FROM r WHERE n % 10 = 0 OR n = total""")
def running_means(spark, sf):
    """Means of all events so far, at every tenth and at the last."""
    e = table(spark, sf, "events").select("event_id", F.floor("value").cast("long").alias("value"), F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("error"))
    x = prefix.running_sums(e, ["event_id"], ["value", "error"])
    return x.where((F.col("n") % 10 == 0) | (F.col("n") == F.col("total"))).select("n", F.round(F.col("sum_value") / F.col("n"), 6).alias("mean_value"), F.round(F.col("sum_error") / F.col("n"), 6).alias("error_rate"))


@query(f"""WITH {VECTORS}, {SCORED}, a AS (SELECT query_id, entry_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM scored) WHERE rank <= 5),
b AS (SELECT * FROM (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM
(SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, slot ORDER BY event_idx DESC, score DESC, entry_id) = 1)) WHERE rank <= 5),
m AS (SELECT query_id, entry_id, min({{'source': source, 'rank': rank}}) AS first FROM (SELECT 0 AS source, * FROM b UNION ALL SELECT 1, * FROM a) GROUP BY ALL)
SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place, first.source = 0 AS managed FROM m""")
def merged_lists(spark, sf):
    """The newest of each slot, then the most similar, each entry at its first place."""
    v = vectors(spark, sf)
    lists = [retrieval.newest_within(v, "episode_id", 5), every(spark, sf, 5)]
    x = retrieval.merged([x.select("query_id", "entry_id", "rank") for x in lists], "query_id", "entry_id")
    return x.select("query_id", "entry_id", "place", (F.col("source") == 0).alias("managed"))


@query(UPSERTS.replace(str(list(THRESHOLDS)), "[0.45]") + ", flat AS (SELECT episode_id, store, n FROM step QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC) = 1), e AS (SELECT episode_id, unnest(range(len(store))) AS entry, unnest(store) AS e FROM flat) SELECT episode_id, entry, e.n AS n_writes, e.last AS last_event_idx FROM e")
def similarity_upsert(spark, sf):
    return folds.similarity_upsert(vectors(spark, sf), 0.45)


FACTUAL = " OR ".join(f"contains(low, '{f}')" for f in folds.FACTUAL)


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, lower(coalesce(text, '')) AS low, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS words,
row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations),
step AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, []::STRUCT(low VARCHAR, words VARCHAR[], turn BIGINT, n BIGINT)[] AS store FROM c
UNION ALL SELECT conv_id, n, CASE WHEN hit IS NOT NULL THEN list_transform(store, lambda e, i: CASE WHEN i = hit THEN {{'low': low, 'words': words, 'turn': turn, 'n': e.n + 1}} ELSE e END)
WHEN {FACTUAL} THEN list_append(store, {{'low': low, 'words': words, 'turn': turn, 'n': 1}})[-200:] ELSE store END FROM (
SELECT c.*, s.store, list_filter(list_transform(s.store, lambda e, i: CASE WHEN len(list_intersect(e.words, c.words)) > 3 AND e.low <> c.low THEN i END), lambda i: i IS NOT NULL)[1] AS hit FROM step s JOIN c ON c.conv_id = s.conv_id AND c.n = s.n + 1)),
last AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1), e AS (SELECT conv_id, unnest(range(len(store))) AS entry, unnest(store) AS e FROM last)
SELECT conv_id, entry, e.turn AS last_turn, e.n AS n_writes FROM e""")
def keyword_upsert(spark, sf):
    x = table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").cast("long").alias("idx"), "text")
    return folds.keyword_upsert(x).toDF("conv_id", "entry", "last_turn", "n_writes")


@query(f"""WITH RECURSIVE {VECTORS}, rows AS (SELECT *, event_idx * 7 AS born, event_idx * 37 % 11 / 10 AS sure, row_number() OVER (PARTITION BY episode_id ORDER BY event_idx) AS n FROM vectors),
step AS (SELECT DISTINCT episode_id, 0::BIGINT AS n, []::STRUCT(id BIGINT, born BIGINT, sure DOUBLE, v DOUBLE[], links BIGINT[])[] AS store FROM rows
UNION ALL SELECT episode_id, n, CASE WHEN gone IS NULL THEN grown ELSE list_transform(list_filter(grown, lambda e: e.id <> gone), lambda e: {{'id': e.id, 'born': e.born, 'sure': e.sure, 'v': e.v, 'links': list_filter(e.links, lambda l: l <> gone)}}) END FROM (
SELECT *, CASE WHEN len(grown) > 40 THEN list_sort(list_transform(grown, lambda e, i: {{'young': born - e.born <= 60, 'sure': e.sure, 'i': i, 'id': e.id}}))[1].id END AS gone FROM (
SELECT *, list_append(list_transform(store, lambda e: {{'id': e.id, 'born': e.born, 'sure': e.sure, 'v': e.v, 'links': CASE WHEN list_contains(near, e.id) THEN list_append(e.links, event_idx) ELSE e.links END}}),
    {{'id': event_idx, 'born': born, 'sure': sure, 'v': vector, 'links': near}}) AS grown FROM (
SELECT *, list_transform(list_filter(best, lambda b: b.id <> event_idx AND -b.s > 0.35), lambda b: b.id) AS near FROM (
SELECT r.*, s.store, list_sort(list_append(list_transform(s.store, lambda e: {{'s': -list_inner_product(e.v, r.vector), 'id': e.id}}), {{'s': -list_inner_product(r.vector, r.vector), 'id': r.event_idx}}))[:3] AS best FROM step s JOIN rows r ON r.episode_id = s.episode_id AND r.n = s.n + 1))))),
last AS (SELECT episode_id, unnest(store) AS e FROM step QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n DESC) = 1)
SELECT episode_id, e.id AS event_idx, CAST(len(e.links) AS BIGINT) AS n_links FROM last""")
def bounded_store(spark, sf):
    i = F.col("event_idx")
    return folds.bounded_store(vectors(spark, sf).withColumns({"at": i * 7, "confidence": i * 37 % 11 / 10}), 40, least=0.35)
