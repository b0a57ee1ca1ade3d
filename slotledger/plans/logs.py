"""Registered queries of reflection and experience logs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotledger.operators import feedback
from slotledger.plans.registry import query
from slotledger.sources.facts import table

ANSWERS = """a AS (SELECT o_orderkey AS seq, o_custkey AS run, 'order ' || o_orderkey AS question, o_orderstatus AS answer, o_comment || o_comment || o_comment AS prediction,
    CAST(o_orderkey % 5 AS DOUBLE) / 4 AS reward FROM (SELECT *, o_orderpriority || ' by ' || o_orderkey AS o_comment FROM orders))"""


def _answers(spark, sf):
    key = F.col("o_orderkey").cast("string")
    said = F.repeat(F.concat("o_orderpriority", F.lit(" by "), key), 3)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("run"), F.concat(F.lit("order "), key).alias("question"), F.col("o_orderstatus").alias("answer"), said.alias("prediction"), (F.col("o_orderkey") % 5 / 4.0).cast("double").alias("reward"))


@query(f"""WITH {ANSWERS} SELECT seq, 'Reflection: when answering ''' || question || ''', prioritize the facts that support ''' || answer || '''. The previous answer was ''' || prediction[:120] || '''.' AS reflection FROM a WHERE reward < 0.99""")
def reflection_log(spark, sf):
    return feedback.reflections(_answers(spark, sf)).select("seq", "reflection")


@query(f"""WITH {ANSWERS} SELECT run, seq, CASE WHEN reward >= 0.5 THEN 'Successful experience: question ''' || question || ''' was answered well by focusing on ''' || answer || '''.'
ELSE 'Corrective experience: for question ''' || question || ''', the reliable target answer is ''' || answer || ''', not ''' || prediction[:120] || '''.' END AS experience
FROM a QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq DESC) <= 5""")
def experience_log(spark, sf):
    """The newest five of each customer, as a store that is full keeps them."""
    return feedback.experiences(_answers(spark, sf), "run", "seq", kept=5).select("run", "seq", "experience")


@query(f"WITH {ANSWERS} SELECT run, seq, seen FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY seq) AS INTEGER) AS seen FROM a) WHERE seen % 4 = 0")
def consolidation_points(spark, sf):
    return feedback.consolidations(_answers(spark, sf), "run", "seq", 4).select("run", "seq", "seen")
