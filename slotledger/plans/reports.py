"""More registered queries: traces, taxonomies, report tables and bounded stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotledger.operators import metrics, retrieval
from slotledger.plans.registry import FACTS, GOLD, SCORED, VECTORS, every, facts, query, vectors
from slotledger.sources.facts import table

TRACE = f"""WITH {VECTORS}, {SCORED}, own AS (SELECT vec_id AS query_id, label FROM embeddings), newest AS (SELECT episode_id, slot, max(event_idx) AS newest FROM vectors GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, entry_id) AS rank FROM scored s),
t AS (SELECT r.query_id, r.rank, r.entry_id, coalesce(r.slot = own.label AND r.event_idx = n.newest, false) AS gold, coalesce(r.slot = own.label AND r.event_idx <> n.newest, false) AS stale
FROM r JOIN own USING (query_id) LEFT JOIN newest n ON n.episode_id = r.query_id // 100 AND n.slot = own.label WHERE rank <= 10)"""


def trace(spark, sf):
    """Rank, entry, gold and stale flag of the ten best entries of every entry as query."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    newest = vectors(spark, sf).groupBy(F.col("episode_id").alias("e"), F.col("slot").alias("label")).agg(F.max("event_idx").alias("newest"))
    x = every(spark, sf, 10).join(own, "query_id").withColumn("e", F.floor(F.col("query_id") / 100)).join(newest, ["e", "label"], "left")
    same, new = F.col("slot") == F.col("label"), F.col("event_idx") == F.col("newest")
    no = F.lit(False)
    return x.select("query_id", "rank", "entry_id", F.coalesce(same & new, no).alias("gold"), F.coalesce(same & ~new, no).alias("stale"))


@query(TRACE + " SELECT * FROM t")
def retrieved_trace(spark, sf):
    return trace(spark, sf)


@query(TRACE + " SELECT query_id, string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY rank) AS entries, bool_or(gold) AS gold, bool_or(stale) AS stale, count(*) FILTER (stale) AS stale_count FROM t GROUP BY query_id")
def trace_flags(spark, sf):
    g = trace(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id"))).alias("e"), F.bool_or("gold").alias("gold"), F.bool_or("stale").alias("stale"), F.count_if("stale").alias("stale_count"))
    return g.withColumn("e", F.array_join(F.transform("e", lambda s: s["entry_id"].cast("string")), ",")).withColumnRenamed("e", "entries")


@query(TRACE + """, f AS (SELECT query_id, bool_or(gold) AS g, bool_or(stale) AS s FROM t GROUP BY query_id)
SELECT CASE WHEN query_id % 100 = 0 THEN 'answer_correct' WHEN query_id % 150 = 0 THEN 'no_trace' WHEN NOT g THEN 'gold_not_retrieved' WHEN s THEN 'stale_contamination' ELSE 'gold_retrieved_wrong' END AS error, count(*) AS n FROM f GROUP BY 1""")
def answer_error_taxonomy(spark, sf):
    f = trace(spark, sf).groupBy("query_id").agg(F.bool_or("gold").alias("g"), F.bool_or("stale").alias("s"))
    q = F.col("query_id")
    e = F.when(q % 100 == 0, "answer_correct").when(q % 150 == 0, "no_trace").when(~F.col("g"), "gold_not_retrieved").when(F.col("s"), "stale_contamination").otherwise("gold_retrieved_wrong")
    return f.groupBy(e.alias("error")).agg(F.count("*").alias("n"))


@query(TRACE + ", f AS (SELECT query_id, max(CAST(gold AS INT)) AS g, max(CAST(stale AS INT)) AS s, count(*) FILTER (stale) AS n FROM t GROUP BY query_id) SELECT round(avg(g), 6) AS gold_rate, round(avg(s), 6) AS stale_rate, round(avg(n), 6) AS mean_stale FROM f")
def retrieval_rates(spark, sf):
    f = trace(spark, sf).groupBy("query_id").agg(F.max(F.col("gold").cast("int")).alias("g"), F.max(F.col("stale").cast("int")).alias("s"), F.count_if("stale").alias("n"))
    return f.agg(*[F.round(F.avg(a), 6).alias(b) for a, b in (("g", "gold_rate"), ("s", "stale_rate"), ("n", "mean_stale"))])


@query(f"""WITH {VECTORS}, l AS (SELECT a.entry_id AS src, b.entry_id AS dst FROM vectors a JOIN vectors b ON a.episode_id = b.episode_id AND b.entry_id < a.entry_id WHERE list_inner_product(a.vector, b.vector) >= 0.3)
SELECT src, dst FROM l WHERE src % 3 <> 0 AND dst % 3 <> 0""")
def delete_cascade(spark, sf):
    v = vectors(spark, sf)
    gone = v.where("entry_id % 3 = 0").select("entry_id")
    l = retrieval.links_within(v, "episode_id", 0.3)
    return l.join(gone, l["src"] == gone["entry_id"], "left_anti").join(gone, l["dst"] == gone["entry_id"], "left_anti")


@query(f"""WITH {FACTS}, {GOLD}, c AS (SELECT f.episode_id, f.event_idx, f.value, row_number() OVER (PARTITION BY f.episode_id ORDER BY f.event_idx DESC) AS back
FROM facts f JOIN gold g ON f.episode_id = g.episode_id AND f.attribute = g.attribute), d AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY event_idx) AS i FROM c WHERE back BETWEEN 2 AND 9),
n AS (SELECT episode_id, count(*) AS n FROM d GROUP BY episode_id), p AS (SELECT unnest(['beginning', 'middle', 'end']) AS position),
u AS (SELECT d.episode_id, position, d.i + 0.0 AS o, d.value FROM d, p UNION ALL
SELECT c.episode_id, position, CASE position WHEN 'beginning' THEN 0.5 WHEN 'middle' THEN n // 2 + 0.5 ELSE n + 0.5 END, c.value FROM c JOIN n USING (episode_id), p WHERE back = 1)
SELECT episode_id, position, string_agg(value, ' ' ORDER BY o) AS context FROM u GROUP BY ALL""")
def gold_position(spark, sf):
    x = facts(spark, sf)
    own = x.join(metrics.gold_slots(x).select("episode_id", "attribute"), ["episode_id", "attribute"])
    back = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("event_idx")))
    own = own.withColumn("back", back).where("back <= 9")  # the gold entry and its eight distractors
    g = own.groupBy("episode_id").agg(F.max_by("value", "event_idx").alias("gold"), F.array_sort(F.collect_list(F.struct("event_idx", "value"))).alias("c"))
    rest = F.transform(F.slice("c", F.lit(1), F.size("c") - 1), lambda s: s["value"])
    g = g.select("episode_id", "gold", rest.alias("r"), F.explode(F.array(*map(F.lit, ("beginning", "middle", "end")))).alias("position")).where(F.size("r") > 0)
    at = F.when(F.col("position") == "beginning", 0).when(F.col("position") == "middle", F.floor(F.size("r") / 2)).otherwise(F.size("r")).cast("int")
    return g.select("episode_id", "position", F.array_join(F.array_insert("r", at + 1, F.col("gold")), " ").alias("context"))


@query(f"""WITH {FACTS} SELECT attribute, CAST(event_idx % 3 AS VARCHAR) AS kind, count(*) AS n FROM facts GROUP BY ROLLUP (attribute, kind)""")
def operation_stats(spark, sf):
    return facts(spark, sf).withColumn("kind", (F.col("event_idx") % 3).cast("string")).rollup("attribute", "kind").agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag AS method, printf('%.2f / %.2f', avg(l_discount) FILTER (l_linenumber = 1), avg(l_tax) FILTER (l_linenumber = 1)) AS k1,
printf('%.2f / %.2f', avg(l_discount) FILTER (l_linenumber = 4), avg(l_tax) FILTER (l_linenumber = 4)) AS k4 FROM lineitem GROUP BY l_returnflag""")
def em_f1_cells(spark, sf):
    x = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).pivot("l_linenumber", [1, 4]).agg(F.printf(F.lit("%.2f / %.2f"), F.avg("l_discount"), F.avg("l_tax")))
    return x.toDF("method", "k1", "k4")


@query("""SELECT o_orderpriority AS method, round(avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS gap FROM orders GROUP BY 1""")
def ceiling_gap(spark, sf):
    on = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(F.round(on("F") - on("O"), 4).alias("gap"))


@query("SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def first_n_per_group(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("n", F.row_number().over(w)).where("n <= 5").select("o_orderpriority", "o_orderkey")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(max(value) - min(value), 6) AS spread FROM events GROUP BY event_type")
def seed_stability(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("deviation"), F.round(F.max(v) - F.min(v), 6).alias("spread"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS answers, count(*) FILTER (role = 'user' AND length(text) > 3) AS asked FROM conversations GROUP BY conv_id""")
def conversation_counts(spark, sf):
    r = F.col("role")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(r == "assistant").alias("answers"), F.count_if((r == "user") & (F.length("text") > 3)).alias("asked"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def fifo_buffer(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 20").drop("n")


@query(f"""WITH {FACTS} SELECT a.episode_id, a.event_idx, a.attribute, CASE WHEN p.operation IS NULL THEN 'MISSING' ELSE p.operation END AS predicted
FROM facts a LEFT JOIN (SELECT episode_id, event_idx, 'ADD' AS operation FROM facts WHERE event_idx % 4 <> 1) p ON a.episode_id = p.episode_id AND a.event_idx = p.event_idx""")
def action_alignment(spark, sf):
    gold = facts(spark, sf).select("episode_id", "event_idx", "attribute")
    told = gold.where("event_idx % 4 <> 1").select("episode_id", "event_idx", F.lit("ADD").alias("operation"))
    return gold.join(told, ["episode_id", "event_idx"], "left").select("episode_id", "event_idx", "attribute", F.coalesce("operation", F.lit("MISSING")).alias("predicted"))
