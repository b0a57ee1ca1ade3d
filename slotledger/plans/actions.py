"""Registered queries over actions, their outcomes and failure types."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.functions import text
from slotledger.operators import metrics, policies
from slotledger.plans.registry import FACTS, facts, query
from slotledger.sources.facts import table


@query(f"""WITH {FACTS} SELECT episode_id, event_idx, CASE WHEN event_idx % 6 IN (3, 4) THEN 'INVALID' WHEN event_idx % 6 = 2 THEN 'NOOP' WHEN event_idx % 6 = 0 THEN 'ADD' ELSE 'UPDATE' END AS operation,
CASE WHEN event_idx % 6 IN (0, 1, 5) THEN entity ELSE '' END AS entity, CASE WHEN event_idx % 6 IN (0, 1, 5) THEN attribute ELSE '' END AS attribute,
CASE WHEN event_idx % 6 IN (0, 1, 5) THEN value ELSE '' END AS value FROM facts""")
def parse_constrained_action(spark, sf):
    m = F.col("event_idx") % 6
    body = F.concat(F.initcap("entity"), F.lit("."), F.col("attribute"), F.lit(" = "), F.col("value"))
    out = F.when(m == 0, F.concat(F.lit("ADD "), body, F.lit(".\t"))).when(m == 1, F.concat(F.lit(" update "), body, F.lit(" NOOP\nmore"))).when(m == 2, " noop\n").when(m == 3, "perhaps").when(m == 4, "NOOP, nothing new").otherwise(F.concat(F.lit("UPDATE "), body, F.lit(". DELETE")))
    return facts(spark, sf).select("episode_id", "event_idx", text.parse_action(out).alias("a")).select("episode_id", "event_idx", "a.*")


@query(f"""WITH {FACTS} SELECT episode_id, event_idx, CASE event_idx % 7 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'DELETE' WHEN 4 THEN 'ADD' WHEN 5 THEN 'UPDATE' ELSE 'NOOP' END AS operation,
CASE event_idx % 7 WHEN 1 THEN 'e' || event_idx WHEN 2 THEN 'e' || event_idx WHEN 5 THEN 'update x' || event_idx ELSE '' END AS target,
CASE WHEN event_idx % 7 IN (0, 1, 5) THEN value WHEN event_idx % 7 = 4 THEN attribute ELSE '' END AS content FROM facts""")
def parse_freeform_op(spark, sf):
    m, i, v = F.col("event_idx") % 7, F.col("event_idx").cast("string"), F.col("value")
    out = F.when(m == 0, F.concat(F.lit("ADD: "), v)).when(m == 1, F.concat(F.lit("UPDATE id_e"), i, F.lit(".: "), v, F.lit("\nExplanation: none"))).when(m == 2, F.concat(F.lit("Delete e"), i, F.lit("."))).when(m == 3, "nothing").when(m == 4, "Address unknown").when(m == 5, F.concat(F.lit("update x"), i, F.lit(": "), v)).otherwise(F.concat(F.lit("UPDATE e"), i))
    out = F.when(m == 2, F.replace(out, F.lit("Delete"), F.lit("DELETE"))).otherwise(out)
    return facts(spark, sf).select("episode_id", "event_idx", text.parse_operation(out, F.col("attribute")).alias("a")).select("episode_id", "event_idx", "a.*")


@query(f"""WITH {FACTS}, a AS (SELECT *, CASE event_idx % 5 WHEN 0 THEN 'ADD' WHEN 3 THEN 'NOOP' WHEN 4 THEN 'INVALID' ELSE 'UPDATE' END AS operation FROM facts),
w AS (SELECT *, row_number() OVER (PARTITION BY episode_id, attribute, operation IN ('ADD', 'UPDATE') ORDER BY event_idx) AS n FROM a)
SELECT episode_id, count(*) FILTER (operation = 'ADD' OR (operation = 'UPDATE' AND n = 1)) AS n_add, count(*) FILTER (operation = 'UPDATE' AND n > 1) AS n_update,
count(*) FILTER (operation = 'NOOP') AS n_noop, count(*) FILTER (operation = 'INVALID') AS n_failed FROM w GROUP BY episode_id""")
def execution_stats(spark, sf):
    m = F.col("event_idx") % 5
    op = F.when(m == 0, "ADD").when(m == 3, "NOOP").when(m == 4, "INVALID").otherwise("UPDATE")
    return metrics.execution_stats(facts(spark, sf).withColumn("operation", op))


@query(f"""WITH {FACTS}, g AS (SELECT *, CASE WHEN event_idx % 9 = 8 THEN 'NOOP' WHEN row_number() OVER (PARTITION BY episode_id, attribute ORDER BY event_idx) > 1 THEN 'UPDATE' ELSE 'ADD' END AS op FROM facts),
p AS (SELECT *, CASE event_idx % 4 WHEN 0 THEN 'NOOP' WHEN 2 THEN 'INVALID' ELSE op END AS p_op, CASE WHEN event_idx % 4 IN (0, 2) THEN '' ELSE attribute END AS p_attribute,
CASE WHEN event_idx % 4 = 3 THEN value || '!' WHEN event_idx % 4 = 1 THEN value || 'x' ELSE '' END AS p_value FROM g),
f AS (SELECT *, op = p_op AND (op = 'NOOP' OR (attribute = p_attribute AND event_idx % 4 = 3)) AS hit FROM p)
SELECT attribute, count(*) AS total_actions, count(*) FILTER (p_op = 'INVALID') AS invalid_action, count(*) FILTER (op = p_op) AS operation_correct, count(*) FILTER (op <> p_op) AS wrong_operation,
count(*) FILTER (p_op = 'NOOP' AND op <> 'NOOP') AS unnecessary_noop, count(*) FILTER (p_op <> 'NOOP' AND op = 'NOOP') AS missed_noop, count(*) FILTER (hit) AS full_action_correct,
count(*) FILTER (NOT hit AND op <> 'NOOP' AND attribute = p_attribute) AS attribute_correct, count(*) FILTER (NOT hit AND op <> 'NOOP' AND attribute <> p_attribute) AS wrong_attribute,
count(*) FILTER (NOT hit AND op <> 'NOOP' AND value = rtrim(p_value, '!')) AS value_correct, count(*) FILTER (NOT hit AND op <> 'NOOP' AND value <> rtrim(p_value, '!')) AS wrong_value FROM f GROUP BY attribute""")
def action_pathology(spark, sf):
    i, m, own = F.col("event_idx"), F.col("event_idx") % 4, F.col("operation")
    x = policies.gold_actions(facts(spark, sf)).withColumn("operation", F.when(i % 9 == 8, "NOOP").otherwise(own))
    none = m.isin(0, 2)
    told = F.struct(F.when(m == 0, "NOOP").when(m == 2, "INVALID").otherwise(own).alias("operation"), F.when(none, "").otherwise(F.col("entity")).alias("entity"), F.when(none, "").otherwise(F.col("attribute")).alias("attribute"), F.when(m == 3, F.concat("value", F.lit("!"))).when(m == 1, F.concat("value", F.lit("x"))).otherwise("").alias("value"))
    pairs = x.select(F.struct("operation", "entity", "attribute", "value").alias("gold"), told.alias("pred"), F.col("attribute").alias("group"))
    out = metrics.action_outcomes(pairs, "group")
    return out.select(F.col("group").alias("attribute"), "total_actions", "invalid_action", "operation_correct", "wrong_operation", "unnecessary_noop", "missed_noop", "full_action_correct", "attribute_correct", "wrong_attribute", "value_correct", "wrong_value")


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'correct' WHEN o_orderkey % 7 = 0 THEN 'state_wrong' WHEN o_orderkey % 3 = 0 THEN 'gold_not_retrieved' WHEN o_orderkey % 4 = 0 THEN 'gold_present_but_non_exact'
WHEN o_orderkey % 2 > 0 THEN 'gold_retrieved_stale_competition' ELSE 'gold_retrieved_answer_layer_failure' END AS error, count(*) AS n FROM orders GROUP BY 1""")
def attribute_error_types(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select((k % 5 == 0).cast("double").alias("em"), (k % 7 != 0).cast("int").alias("state_value_em"), (k % 3).alias("gold_retrieved_count"), (k % 4 == 0).cast("int").alias("answer_value_present"), (k % 2).alias("stale_retrieved_count"))
    return metrics.attribute_error(rows).groupBy("error").agg(F.count("*").alias("n"))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'exact_after_normalization' WHEN 1 THEN 'gold_plus_annotation_or_prompt_spillover' WHEN 2 THEN 'gold_plus_extraneous_text'
WHEN 3 THEN 'multiple_candidate_values' ELSE 'behavioral_non_exact_other' END AS failure, count(*) AS n FROM events GROUP BY 1""")
def same_value_failures(spark, sf):
    m = F.col("event_id") % 5
    told = F.when(m == 0, " Scala!\nmore").when(m == 1, "scala  (Latest)").when(m == 2, "Scala, of course").when(m == 3, "Java or Rust").otherwise("none")
    x = table(spark, sf, "events").select(told.alias("predicted"), F.lit("Scala").alias("gold"))
    return metrics.same_value_failure(x).groupBy("failure").agg(F.count("*").alias("n"))


@query("""SELECT event_id, len(t) AS n, array_to_string(t, '|') AS texts FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['m' || event_id, 's'] WHEN 1 THEN ['c' || event_id, 'x', 'z']
WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE ['v' || event_id] END AS t FROM events)""")
def payload_text_extract(spark, sf):
    i, m = F.col("event_id").cast("string"), F.col("event_id") % 4
    made = F.when(m == 0, F.format_string('{"results": [{"text": "t", "memory": "m%s"}, "s", 4]}', i)).when(m == 1, F.format_string('{"a": {"content": "c%s", "b": "b"}, "b": ["x", {"value": 5, "y": {"q": "z"}}]}', i)).when(m == 2, F.col("props")).otherwise(F.format_string('[[], {"value": "v%s"}, null]', i))
    x = table(spark, sf, "events").select("event_id", text.payload_texts(made).alias("t"))
    return x.select("event_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("texts"))
