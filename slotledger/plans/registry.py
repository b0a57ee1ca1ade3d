"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotledger.functions import slots, text
from slotledger.operators import metrics, policies, retrieval
from slotledger.sources.facts import conversation_events, slot_events, table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

FACTS = """facts AS (SELECT user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_idx,
    'user_' || user_id AS entity, event_type AS attribute, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR) AS value, ts FROM events)"""
LATEST = "latest AS (SELECT episode_id, entity, attribute, arg_max(value, event_idx) AS value, max(event_idx) AS event_idx FROM facts GROUP BY ALL)"
GOLD = """gold AS (SELECT * FROM (SELECT episode_id, entity, attribute, count(*) AS k_updates, arg_max(value, event_idx) AS gold FROM facts GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY k_updates DESC, attribute) = 1)"""
VECTORS = "vectors AS (SELECT vec_id AS entry_id, vec_id // 100 AS episode_id, label AS slot, vec_id AS event_idx, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"
SCORED = """scored AS (SELECT q.entry_id AS query_id, e.entry_id, e.slot, e.event_idx, round(list_inner_product(q.vector, e.vector), 6) AS score
    FROM vectors q JOIN vectors e ON q.episode_id = e.episode_id AND q.entry_id <> e.entry_id)"""
NORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def facts(spark, sf):
    return slot_events(table(spark, sf, "events"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), F.floor(F.col("vec_id") / 100).alias("episode_id"), F.col("label").alias("slot"), F.col("vec_id").alias("event_idx"), F.col("embedding").cast("array<double>").alias("vector"))


def every(spark, sf, k):
    """The k best for every entry as query, with slot and event_idx."""
    v = vectors(spark, sf)
    return retrieval.top_k_within(v, "episode_id", k).join(v.select("entry_id", "slot", "event_idx"), "entry_id")


@query(f"WITH {FACTS}, {LATEST} SELECT * FROM latest")
def latest_per_slot(spark, sf):
    return policies.latest(facts(spark, sf))


@query(f"WITH {FACTS} SELECT episode_id, entity, attribute, value, event_idx AS created_idx, event_idx AS updated_idx FROM facts")
def raw_append_state(spark, sf):
    return policies.append(facts(spark, sf))


@query(f"""WITH {FACTS}, f AS (SELECT * REPLACE (CASE WHEN event_idx % 5 = 4 THEN NULL ELSE entity END AS entity) FROM facts)
SELECT episode_id, entity, attribute, arg_max(value, event_idx) AS value, min(event_idx) AS created_idx, max(event_idx) AS updated_idx
FROM f WHERE entity IS NOT NULL GROUP BY ALL UNION ALL SELECT episode_id, entity, attribute, value, event_idx, event_idx FROM f WHERE entity IS NULL""")
def slot_upsert_state(spark, sf):
    x = facts(spark, sf)
    return policies.slot_upsert(x.withColumn("entity", F.when(F.col("event_idx") % 5 != 4, F.col("entity"))))


@query(f"""WITH {FACTS}, f AS (SELECT * FROM facts WHERE event_idx % 5 <> 4)
SELECT episode_id, count(*) AS append_size, count(DISTINCT attribute) AS upsert_size FROM f GROUP BY episode_id""")
def parsed_only_policies(spark, sf):
    x = policies.parsed_only(facts(spark, sf).withColumn("entity", F.when(F.col("event_idx") % 5 != 4, F.col("entity"))))
    one = policies.append(x).groupBy("episode_id").agg(F.count("*").alias("append_size"))
    return one.join(policies.slot_upsert(x).groupBy("episode_id").agg(F.count("*").alias("upsert_size")), "episode_id")


@query(f"""WITH {FACTS} SELECT episode_id, event_idx, entity, attribute, value,
CASE WHEN row_number() OVER (PARTITION BY episode_id, entity, attribute ORDER BY event_idx) > 1 THEN 'UPDATE' ELSE 'ADD' END AS operation FROM facts""")
def gold_actions(spark, sf):
    return policies.gold_actions(facts(spark, sf))


@query(f"""WITH {FACTS} SELECT episode_id, entity, attribute, event_idx, value,
lag(value) OVER (PARTITION BY episode_id, entity, attribute ORDER BY event_idx) AS value_before FROM facts""")
def slot_state_asof(spark, sf):
    return policies.value_before(facts(spark, sf))


@query(f"""WITH {FACTS}, a AS (SELECT *, CASE WHEN event_idx % 4 = 0 THEN 'ADD' ELSE 'UPDATE' END AS operation FROM facts),
s AS (SELECT *, CASE WHEN operation = 'ADD' OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS starts FROM a WINDOW w AS (PARTITION BY episode_id, entity, attribute ORDER BY event_idx)),
e AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY episode_id, entity, attribute ORDER BY event_idx) AS BIGINT) AS entry FROM s)
SELECT episode_id, entity, attribute, entry, arg_max(value, event_idx) AS value, count(*) AS n_writes FROM e GROUP BY ALL""")
def learned_islands(spark, sf):
    return policies.replay(facts(spark, sf).withColumn("operation", F.when(F.col("event_idx") % 4 == 0, "ADD").otherwise("UPDATE")))


@query(f"""WITH {FACTS}, {GOLD} SELECT g.episode_id, count(*) AS memory_size,
count(*) FILTER (f.attribute = g.attribute) AS same_slot, count(*) FILTER (f.attribute = g.attribute AND f.value = g.gold) AS gold_entries,
count(*) FILTER (f.attribute = g.attribute AND f.value <> g.gold) AS stale_entries FROM gold g JOIN facts f ON f.episode_id = g.episode_id GROUP BY g.episode_id""")
def burden_metrics(spark, sf):
    x = facts(spark, sf)
    return metrics.burden(policies.append(x), metrics.gold_slots(x))


@query(f"""WITH {FACTS}, {GOLD} SELECT g.episode_id, k_updates, round(count(DISTINCT f.attribute) / count(*), 6) AS write_amplification
FROM gold g JOIN facts f ON f.episode_id = g.episode_id GROUP BY g.episode_id, k_updates""")
def write_amplification(spark, sf):
    x = facts(spark, sf)
    n = x.groupBy("episode_id").agg(F.count("*").alias("n_events"))
    size = policies.slot_upsert(x).groupBy("episode_id").agg(F.count("*").alias("size"))
    out = metrics.gold_slots(x).join(n, "episode_id").join(size, "episode_id")
    return out.select("episode_id", "k_updates", F.round(F.col("size") / F.greatest("n_events", F.lit(1)), 6).alias("write_amplification"))


@query(f"""WITH {FACTS}, {GOLD}, s AS (SELECT g.*, CASE WHEN f.episode_id % 7 = 0 THEN NULL WHEN f.episode_id % 7 = 1 THEN 'other' ELSE f.entity END AS got_entity,
f.attribute AS got_attribute, f.value AS got_value FROM gold g JOIN facts f ON f.episode_id = g.episode_id AND f.event_idx = 0)
SELECT CASE WHEN got_entity IS NULL THEN 'missing_state' WHEN got_entity <> entity THEN 'wrong_entity' WHEN got_attribute <> attribute THEN 'wrong_attribute'
WHEN got_value <> gold THEN 'wrong_value' ELSE 'correct' END AS error, count(*) AS n FROM s GROUP BY 1""")
def state_error_taxonomy(spark, sf):
    x = facts(spark, sf)
    m = F.col("episode_id") % 7
    first = x.where("event_idx = 0").select("episode_id", F.when(m == 0, None).when(m == 1, "other").otherwise(F.col("entity")).alias("got_entity"), F.col("attribute").alias("got_attribute"), F.col("value").alias("got_value"))
    rows = metrics.gold_slots(x).withColumnRenamed("gold", "value").join(first, "episode_id")
    return metrics.state_error(rows).groupBy("error").agg(F.count("*").alias("n"))


@query(f"WITH {VECTORS}, {SCORED} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM scored) WHERE rank <= 5")
def topk_cosine(spark, sf):
    return every(spark, sf, 5)


@query(f"""WITH {VECTORS}, {SCORED}, k AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, slot ORDER BY event_idx DESC, score DESC, entry_id) = 1)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM k) WHERE rank <= 5""")
def latest_per_slot_topk(spark, sf):
    return retrieval.newest_within(vectors(spark, sf), "episode_id", 5)


@query(f"""WITH {VECTORS}, {SCORED}, r AS (SELECT *, (entry_id % 10) / 10.0 AS confidence FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) <= 15),
m AS (SELECT query_id, entry_id, round(CAST(0.5 * CAST(confidence AS DOUBLE) + 0.5 * score AS DOUBLE), 7) AS mixed FROM r)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mixed DESC, entry_id) AS rank FROM m) WHERE rank <= 5""")
def topk_confident(spark, sf):
    x = every(spark, sf, 15).drop("rank").withColumn("confidence", F.col("entry_id") % 10 / 10.0)
    return retrieval.confident_top_k(x, "confidence", 5).select("query_id", "entry_id", "mixed", "rank")


@query(f"""WITH {VECTORS}, {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM scored),
q AS (SELECT vec_id AS query_id, label FROM embeddings)
SELECT k, round(avg(CASE WHEN r.slot = q.label THEN 1.0 ELSE 0.0 END), 6) AS same_slot_rate FROM r JOIN q USING (query_id) JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ON rank <= k GROUP BY k""")
def topk_sweep(spark, sf):
    return sweep(spark, sf, every(spark, sf, 10))


def sweep(spark, sf, wide):
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    x = wide.join(own, "query_id").select("slot", "label", "rank", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))).alias("k")).where("rank <= k")
    return x.groupBy("k").agg(F.round(F.avg(F.when(F.col("slot") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("same_slot_rate"))


@query(f"""WITH {VECTORS} SELECT a.entry_id AS src, b.entry_id AS dst FROM vectors a JOIN vectors b ON a.episode_id = b.episode_id AND b.entry_id < a.entry_id
WHERE list_inner_product(a.vector, b.vector) >= 0.45""")
def threshold_links(spark, sf):
    return retrieval.links_within(vectors(spark, sf), "episode_id", 0.45)


@query(f"""WITH {VECTORS}, l AS (SELECT a.entry_id AS src, b.entry_id AS dst FROM vectors a JOIN vectors b ON a.episode_id = b.episode_id AND b.entry_id < a.entry_id WHERE list_inner_product(a.vector, b.vector) >= 0.35),
e AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), one AS (SELECT src AS start, dst AS node FROM e)
SELECT start, node FROM (SELECT start, node FROM one UNION SELECT start, dst FROM one JOIN e ON node = src) WHERE start <> node""")
def bfs_depth2(spark, sf):
    v = vectors(spark, sf)
    return retrieval.neighbours(retrieval.links_within(v, "episode_id", 0.35), v.select(F.col("entry_id").alias("start")), 2)


@query(f"""WITH {VECTORS}, l AS (SELECT a.entry_id AS src, b.entry_id AS dst FROM vectors a JOIN vectors b ON a.episode_id = b.episode_id AND b.entry_id < a.entry_id WHERE list_inner_product(a.vector, b.vector) >= 0.35),
e AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l) SELECT src AS node, count(*) AS degree FROM e GROUP BY src HAVING count(*) >= 2""")
def dense_subgraph(spark, sf):
    l = retrieval.links_within(vectors(spark, sf), "episode_id", 0.35)
    both = l.unionByName(l.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).where("degree >= 2")


@query(f"""WITH {VECTORS}, l AS (SELECT a.entry_id AS src, b.entry_id AS dst FROM vectors a JOIN vectors b ON a.episode_id = b.episode_id AND b.entry_id < a.entry_id WHERE list_inner_product(a.vector, b.vector) >= 0.25),
e AS (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l), d AS (SELECT src AS entry_id, count(*) AS degree FROM e GROUP BY src),
c AS (SELECT episode_id, entry_id, degree, (slot + 1) / 10.0 AS confidence FROM d JOIN vectors USING (entry_id) WHERE degree >= 2 AND (slot + 1) / 10.0 >= 0.5)
SELECT episode_id, entry_id, degree, round(degree * confidence, 6) AS weight, row_number() OVER (PARTITION BY episode_id ORDER BY round(degree * confidence, 6) DESC, entry_id) AS place FROM c""")
def dense_ranked(spark, sf):
    """Entries of some confidence with at least two links, by degree times confidence."""
    v = vectors(spark, sf).withColumn("confidence", (F.col("slot") + 1) / 10)
    return retrieval.dense(retrieval.links_within(v, "episode_id", 0.25), v, "episode_id", 2, 0.5)


@query(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalize_value(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_value(F.col("text")).alias("norm"))


@query("""WITH p AS (SELECT d.doc_id, list_filter(string_split_regex(lower(d.text), '\\s+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lower(b.text), '\\s+'), lambda w: w <> '') AS b,
lower(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) = lower(regexp_replace(b.text, '^\\s+|\\s+$', '', 'g')) AS same, contains(lower(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')), lower(regexp_replace(b.text, '^\\s+|\\s+$', '', 'g'))) AS held FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
s AS (SELECT *, len(list_intersect(a, b)) AS i FROM p)
SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 OR i = 0 THEN 0.0::DOUBLE ELSE round(2 * (i / len(a)) * (i / len(b)) / (i / len(a) + i / len(b)), 6) END AS f1,
CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, held AS contains_raw FROM s""")
def answer_scores(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"))
    x = d.withColumn("item_id", F.col("doc_id") % b.count()).join(b, "item_id")
    p, g = F.col("text"), F.col("gold")
    return x.select("doc_id", F.round(text.token_f1(p, g), 6).alias("f1"), text.exact_match(p, g).alias("em"), text.contains_raw(p, g).alias("contains_raw"))


@query("""WITH c AS (SELECT conv_id, turn, text, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
q AS (SELECT conv_id, arg_max(w, turn) AS q FROM c GROUP BY conv_id), s AS (SELECT c.conv_id, turn AS idx, CAST(len(list_intersect(q, w)) AS BIGINT) AS overlap FROM c JOIN q ON c.conv_id = q.conv_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, idx DESC) AS rank FROM s) WHERE rank <= 3""")
def lexical_topk(spark, sf):
    c = table(spark, sf, "conversations").where(text.strip(F.col("text")) != "")
    q = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    return retrieval.lexical_top_k(q, c.select("conv_id", F.col("turn").alias("idx"), "text"), "conv_id", 3).select("conv_id", "idx", "overlap", "rank")


@query("SELECT conv_id, turn AS event_idx, upper(role[1]) || role[2:] || ' says: ' || coalesce(text, '') AS event FROM conversations")
def conversation_stream(spark, sf):
    return conversation_events(table(spark, sf, "conversations"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def tail_windows(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("n")).where("n <= 6").drop("n")


@query("""WITH t AS (SELECT user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 50),
s AS (SELECT user_id, count(*) AS n, date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS span FROM t GROUP BY user_id)
SELECT user_id, CASE WHEN n < 2 OR span <= 0 THEN 0.0::DOUBLE ELSE round(n / (span / 3600.0::DOUBLE), 6) END AS per_hour FROM s""")
def growth_rate(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"))
    t = table(spark, sf, "events").select("user_id", "ts", F.row_number().over(w).alias("r")).where("r <= 50")
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    s = t.groupBy("user_id").agg(F.count("*").alias("n"), span.alias("span"))
    return s.select("user_id", F.when((F.col("n") < 2) | (F.col("span") <= 0), 0.0).otherwise(F.round(F.col("n") / (F.col("span") / 3600.0), 6)).alias("per_hour"))


@query(f"""WITH {FACTS}, {GOLD}, l AS (SELECT f.episode_id, f.event_idx, f.value, CASE WHEN f.event_idx = max(f.event_idx) OVER (PARTITION BY f.episode_id) THEN 'latest' ELSE 'outdated' END AS label
FROM facts f JOIN gold g ON f.episode_id = g.episode_id AND f.attribute = g.attribute)
SELECT episode_id, string_agg(value || ' (' || label || ')', '; ' ORDER BY event_idx) AS chronological, string_agg(value, '; ' ORDER BY event_idx DESC) AS reversed,
string_agg(value, '; ' ORDER BY label, event_idx) AS current_first FROM l GROUP BY episode_id""")
def context_orders(spark, sf):
    x = facts(spark, sf)
    own = x.join(metrics.gold_slots(x).select("episode_id", "attribute"), ["episode_id", "attribute"])
    newest = F.max("event_idx").over(Window.partitionBy("episode_id"))
    own = own.withColumn("label", F.when(F.col("event_idx") == newest, "latest").otherwise("outdated"))
    g = own.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("event_idx", "value", "label"))).alias("t"), F.array_sort(F.collect_list(F.struct("label", "event_idx", "value"))).alias("c"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: s["value"]), "; ")
    marked = F.array_join(F.transform("t", lambda s: F.concat(s["value"], F.lit(" ("), s["label"], F.lit(")"))), "; ")
    return g.select("episode_id", marked.alias("chronological"), joined(F.reverse("t")).alias("reversed"), joined(F.col("c")).alias("current_first"))


@query("SELECT CAST(l.quality AS DOUBLE) AS dose, count(*) AS n, round(avg(l.toxic), 6) AS mean FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY l.quality")
def dose_bins(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return metrics.dose_bins(x, "quality", "toxic").withColumn("mean", F.round("mean", 6))


@query("""WITH RECURSIVE d AS (SELECT CAST(trunc(length(text) / 1000) AS DOUBLE) AS dose, quality FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL),
b AS (SELECT dose, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS y FROM d GROUP BY dose),
bins AS (SELECT list({'x': dose, 'n': n, 'y': y} ORDER BY dose) AS bins, sum(n) AS total FROM b),
fit AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS s UNION ALL SELECT step + 1, a - 0.01 * list_sum(off) / total, s - 0.01 * list_sum(list_transform(off, lambda e, i: e * bins[i].x)) / total
FROM (SELECT *, list_transform(bins, lambda e: e.n / (1 + exp(-greatest(-30.0, least(30.0, a + s * e.x)))) - e.y) AS off FROM fit, bins) WHERE step < 1000)
SELECT round(a, 6) AS intercept, round(s, 6) AS slope, round(-a / s, 6) AS ed50 FROM fit WHERE step = 1000""")
def logistic_dose_fit(spark, sf):
    """Intercept, slope and the dose at one half, after the first thousand steps of the descent."""
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", (F.length("text") / 1000).cast("int").alias("dose")), "doc_id")
    fit = metrics.logistic_fit(x.where("quality is not null and dose is not null"), "dose", "quality", steps=1000) or (None, None)
    half = None if not fit[1] else -fit[0] / fit[1]
    return spark.createDataFrame([(*fit, half)], "intercept double, slope double, ed50 double").select(*[F.round(c, 6).alias(c) for c in ("intercept", "slope", "ed50")])


@query(f"""WITH {FACTS}, r AS (SELECT episode_id, attribute AS item, count(*) AS a, max(event_idx) AS b FROM facts GROUP BY ALL),
p AS (SELECT l.episode_id, sign(l.a - r.a) AS da, sign(l.b - r.b) AS db FROM r l JOIN r ON l.episode_id = r.episode_id AND l.item < r.item)
SELECT episode_id, CASE WHEN sum(da * da) = 0 OR sum(db * db) = 0 THEN 0.0 ELSE round(sum(da * db) / sqrt(sum(da * da) * sum(db * db)), 6) END AS tau FROM p GROUP BY episode_id""")
def kendall_tau(spark, sf):
    r = facts(spark, sf).groupBy("episode_id", F.col("attribute").alias("item")).agg(F.count("*").alias("a"), F.max("event_idx").alias("b"))
    return metrics.kendall_tau(r, "episode_id", "a", "b").withColumn("tau", F.round("tau", 6))


@query(f"""WITH {FACTS}, a AS (SELECT *, CASE WHEN event_idx % 3 = 0 THEN 'ADD' ELSE 'UPDATE' END AS operation FROM facts)
SELECT attribute, operation, count(*) AS n FROM a GROUP BY GROUPING SETS ((attribute), (operation), (attribute, operation), ())""")
def grouping_sets_errors(spark, sf):
    x = facts(spark, sf).withColumn("operation", F.when(F.col("event_idx") % 3 == 0, "ADD").otherwise("UPDATE"))
    return x.groupingSets([["attribute"], ["operation"], ["attribute", "operation"], []], "attribute", "operation").agg(F.count("*").alias("n"))


@query("SELECT event_type, value, n FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY ALL) ORDER BY n DESC, event_type, value LIMIT 20")
def top_raw_outputs(spark, sf):
    x = table(spark, sf, "events").groupBy("event_type", F.floor("value").cast("long").alias("value")).agg(F.count("*").alias("n"))
    return x.orderBy(F.desc("n"), "event_type", "value").limit(20)


@query("""SELECT l_returnflag AS method, round(CAST(avg(l_quantity) FILTER (l_linenumber = 1) AS DOUBLE), 4) AS k1, round(avg(l_quantity) FILTER (l_linenumber = 2), 4) AS k2,
round(avg(l_quantity) FILTER (l_linenumber = 4), 4) AS k4 FROM lineitem GROUP BY l_returnflag""")
def metric_pivot(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).pivot("l_linenumber", [1, 2, 4]).agg(F.round(F.avg("l_quantity"), 4))
    return x.toDF("method", "k1", "k2", "k4")


@query("""SELECT n_nationkey, p AS o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders) EXCEPT
SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000""")
def missing_cells(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    kinds = [r[0] for r in o.select("o_orderpriority").distinct().limit(101).collect()]
    if len(kinds) > 100:
        raise ValueError("over 100 priorities: make the grid from a table of them")
    cells = table(spark, sf, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, kinds))).alias("o_orderpriority"))
    there = o.where("o_totalprice > 480000").join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority").distinct()
    return cells.join(there, ["n_nationkey", "o_orderpriority"], "left_anti")


@query("""WITH p AS (SELECT l_orderkey, avg(l_quantity) FILTER (l_returnflag = 'N') AS base, avg(l_quantity) FILTER (l_returnflag = 'R') AS target FROM lineitem GROUP BY l_orderkey)
SELECT count(*) AS n, round(avg(target - base), 6) AS effect, count(*) FILTER (target > base) AS fixed, count(*) FILTER (target < base) AS regressed FROM p WHERE base IS NOT NULL AND target IS NOT NULL""")
def paired_effects(spark, sf):
    when = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(when("N").alias("base"), when("R").alias("target")).where("base is not null and target is not null")
    return p.agg(F.count("*").alias("n"), F.round(F.avg(F.col("target") - F.col("base")), 6).alias("effect"), F.count_if(F.col("target") > F.col("base")).alias("fixed"), F.count_if(F.col("target") < F.col("base")).alias("regressed"))


@query("""SELECT event_id, round(1 / (1 + exp(-(0.4 * (value / 100) + 0.4 * ((event_id % 5) / greatest(event_id % 7, 1)) + 0.2 * ln(1 + event_id % 48)))), 6) AS confidence FROM events""")
def confidence_sigmoid(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.round(text.confidence(F.col("value") / 100, e % 5, e % 7, e % 48), 6).alias("confidence"))


@query(f"""WITH {FACTS} SELECT episode_id, event_idx, CASE WHEN event_idx % 5 = 4 THEN NULL ELSE 'friend_alex' END AS entity,
CASE event_idx % 5 WHEN 0 THEN 'location' WHEN 1 THEN 'company' WHEN 2 THEN 'language' WHEN 3 THEN 'timezone' END AS attribute,
CASE event_idx % 5 WHEN 0 THEN 'Wuxi' WHEN 1 THEN 'Tencent' WHEN 2 THEN 'Kotlin' WHEN 3 THEN 'UTC+' || value END AS value FROM facts""")
def parse_roundtrip(spark, sf):
    m, v = F.col("event_idx") % 5, F.col("value")
    says = F.when(m == 0, "User says: my friend Alex relocated to Wuxi.").when(m == 1, "User says: Alex joined Tencent.").when(m == 2, "User says: Alex switched to Kotlin.").when(m == 3, F.concat(F.lit("User says: my friend Alex timezone is UTC+"), v, F.lit("."))).otherwise("User says: Alex read a guide about Dalian.")
    return slots.parse(facts(spark, sf).select("episode_id", "event_idx", says.alias("text"))).drop("text")


@query("SELECT DISTINCT event_type AS method, 'slot_prompt' AS answer_mode, CAST(user_id % 5 AS INTEGER) AS k FROM events")
def run_name_parse(spark, sf):
    name = F.concat(F.col("event_type"), F.lit("_prompt_k"), (F.col("user_id") % 5).cast("string"))
    return table(spark, sf, "events").select(text.run_name(name).alias("r")).select("r.*").distinct()


@query(f"""WITH {FACTS}, s AS (SELECT episode_id % 4 AS shard, attribute, count(*) AS n, sum(event_idx) AS t FROM facts GROUP BY ALL)
SELECT attribute, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(t) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS mean_idx, count(*) AS shards FROM s GROUP BY attribute""")
def shard_merge(spark, sf):
    part = facts(spark, sf).groupBy((F.col("episode_id") % 4).alias("shard"), "attribute").agg(F.count("*").alias("n"), F.sum("event_idx").alias("t"))
    return part.groupBy("attribute").agg(F.sum("n").alias("n"), F.round(F.sum("t") / F.sum("n"), 6).alias("mean_idx"), F.count("*").alias("shards"))


@query(f"WITH {FACTS} SELECT attribute AS operation, count(*) AS n FROM facts GROUP BY attribute")
def opcount_map_sum(spark, sf):
    counts = facts(spark, sf).groupBy("episode_id", "attribute").agg(F.count("*").alias("n"))
    maps = counts.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "n"))).alias("ops"))  # event types
    return maps.select(F.explode("ops").alias("operation", "k")).groupBy("operation").agg(F.sum("k").alias("n"))


@query("""WITH e AS (SELECT *, max(ts) OVER (PARTITION BY user_id) - INTERVAL 60 SECOND > ts AS old FROM events), o AS (SELECT *, bool_or(old) OVER (PARTITION BY user_id) AS aged FROM e)
SELECT user_id, event_id FROM o WHERE old OR NOT aged QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, ts, event_id) = 1""")
def evict_lowest_aged(spark, sf):
    """Of each user the entry that a full store gives up: of least value among those older than a minute, if there are any."""
    return retrieval.evicted(table(spark, sf, "events"), "user_id", "event_id", "value", "ts", 60).select("user_id", "event_id")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) = 1""")
def evict_lowest(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("event_id"))
