"""Registered queries of a probe over the log's slots: what a reader of each context order and note gets wrong, with their SQL.

Every slot of every episode shows its three newest values in an order, with or without a note; the reader tells the
last line, with its label where lines have one. A slot whose older lines repeat the current value has the policy same_as_current, others conflict.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotledger.functions import text
from slotledger.operators import metrics, runs
from slotledger.plans.episodes import SAID, SUMMARY, evidence_manifest, said, summaries
from slotledger.plans.registry import query

ORDERS, NOTES, SHOWN = ("chronological", "reverse_chronological"), ("none", "latest_outdated_label"), 3
PROBE = f"""WITH {SAID}, w AS (SELECT *, row_number() OVER (PARTITION BY episode_id, entity, attribute ORDER BY event_idx DESC) AS back FROM said WHERE entity IS NOT NULL),
c AS (SELECT episode_id, entity, attribute, arg_min(value, back) AS gold, arg_max(value, back) AS oldest, count(*) AS n, count(DISTINCT value) AS kinds, list(value) AS vals FROM w WHERE back <= {SHOWN} GROUP BY episode_id, entity, attribute),
q AS (SELECT *, CAST(len(list_filter(vals, lambda v: v <> gold)) AS BIGINT) AS stale_count FROM c, (SELECT unnest({list(ORDERS)}) AS context_order), (SELECT unnest({list(NOTES)}) AS note)),
p AS (SELECT *, CASE WHEN stale_count = 0 THEN 'same_as_current' ELSE 'conflict' END AS value_policy, CASE WHEN context_order = 'chronological' THEN gold ELSE oldest END AS told,
    CASE WHEN note = 'none' THEN '' WHEN context_order = 'chronological' OR n = 1 THEN ' (latest)' ELSE ' (outdated)' END AS mark FROM q),
probe AS (SELECT *, told || mark AS predicted, CASE WHEN told = gold AND mark = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
    CASE WHEN told <> gold THEN 0.0::DOUBLE WHEN mark = '' THEN 1.0::DOUBLE ELSE round(2 * (1 / 2.0::DOUBLE) / (1 + 1 / 2.0::DOUBLE), 6) END AS f1, contains(lower(told), lower(gold)) AS held,
    value_policy || '_' || context_order || '_' || note || '_stale' || stale_count AS condition FROM p)"""


def probe(spark, sf):
    """A row for each slot, order and note: gold, predicted, em, f1, held (the gold value is in the answer) and the cell's condition."""
    x = said(spark, sf)[0].where("entity is not null")
    back = F.row_number().over(Window.partitionBy(*runs.SLOT).orderBy(F.desc("event_idx")))
    shown = F.array_sort(F.collect_list(F.struct("back", "value")))  # SHOWN values
    c = x.withColumn("back", back).where(F.col("back") <= SHOWN).groupBy(*runs.SLOT).agg(shown.alias("shown"))
    c = c.select(*runs.SLOT, F.get("shown", F.lit(0))["value"].alias("gold"), F.element_at("shown", -1)["value"].alias("oldest"), F.size("shown").alias("n"), F.col("shown"))
    c = c.withColumn("stale_count", F.size(F.filter("shown", lambda s: s["value"] != F.col("gold"))).cast("long")).drop("shown")
    each = lambda names: F.explode(F.array(*map(F.lit, names)))
    c = c.withColumn("context_order", each(ORDERS)).withColumn("note", each(NOTES))
    newest = F.col("context_order") == "chronological"
    mark = F.when(F.col("note") == "none", "").when(newest | (F.col("n") == 1), " (latest)").otherwise(" (outdated)")
    p = c.withColumn("value_policy", F.when(F.col("stale_count") == 0, "same_as_current").otherwise("conflict")).withColumn("predicted", F.concat(F.when(newest, F.col("gold")).otherwise(F.col("oldest")), mark))
    told, gold = F.col("predicted"), F.col("gold")
    p = p.withColumns({"em": text.exact_match(told, gold), "f1": F.round(text.token_f1(told, gold), 6), "held": text.contains_value(told, gold)})
    return p.withColumn("condition", F.concat_ws("_", "value_policy", "context_order", "note", F.concat(F.lit("stale"), F.col("stale_count"))))


_SCORES = "count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1, round(avg(CASE WHEN held THEN 1.0 ELSE 0.0 END), 6) AS answer_value_present"


def scores():
    return [F.count("*").alias("n"), runs.mean("em").alias("em"), runs.mean("f1").alias("f1"), runs.mean("held").alias("answer_value_present")]


@query(f"{PROBE} SELECT value_policy, context_order, note, stale_count, {_SCORES} FROM probe GROUP BY ALL")
def probe_grouped(spark, sf):
    """The probe's table by policy, order, note and number of stale lines."""
    return probe(spark, sf).groupBy("value_policy", "context_order", "note", "stale_count").agg(*scores())


@query(f"{PROBE} SELECT condition, any_value(context_order) AS context_order, any_value(note) AS note, any_value(stale_count) AS stale_count, {_SCORES} FROM probe GROUP BY condition")
def probe_conditions(spark, sf):
    """The same by the condition's name alone, with the columns that it settles."""
    return probe(spark, sf).groupBy("condition").agg(*[F.first(c).alias(c) for c in ("context_order", "note", "stale_count")], *scores())


@query(f"{PROBE} SELECT condition, attribute, 'gold_plus_annotation_or_prompt_spillover' AS failure, count(*) AS n FROM probe WHERE value_policy = 'same_as_current' AND em < 1 AND held GROUP BY condition, attribute")
def same_value_selection(spark, sf):
    """Answers that hold a value repeated by all lines and still are not it, by what is wrong with them."""
    x = metrics.same_value_failure(runs.same_value_rows(probe(spark, sf)))
    return x.groupBy("condition", "attribute", "failure").agg(F.count("*").alias("n"))


@query(f"""{PROBE} SELECT value_policy, context_order, attribute, episode_id, entity, note FROM probe WHERE em < 1
QUALIFY row_number() OVER (PARTITION BY value_policy, context_order, attribute ORDER BY held DESC, f1, stale_count DESC, episode_id, entity, note) <= 3""")
def failing_cases(spark, sf):
    """The first three failures of each policy, order and attribute: with the value in the answer first, then by score, stale lines and id."""
    w = Window.partitionBy("value_policy", "context_order", "attribute").orderBy(F.desc("held"), "f1", F.desc("stale_count"), "episode_id", "entity", "note")
    x = probe(spark, sf).where("em < 1").withColumn("n", F.row_number().over(w)).where("n <= 3")
    return x.select("value_policy", "context_order", "attribute", "episode_id", "entity", "note")


@query(f"{SUMMARY} SELECT 'log' AS result_group, mode, 'completed' AS status, count(*) AS n, CAST(sum(num_examples) AS BIGINT) AS examples FROM summary GROUP BY mode")
def manifest_counts(spark, sf):
    """Runs and examples of each group, mode and status of the manifest."""
    return evidence_manifest(spark, sf).groupBy("result_group", "mode", "status").agg(F.count("*").alias("n"), F.sum("num_examples").alias("examples"))


@query(f"{SUMMARY} SELECT s.mode || '_direct_k' || s.k_updates AS run_name, s.mode AS method, s.k_updates, g.episodes FROM summary s JOIN (SELECT k_updates, count(*) AS episodes FROM gold GROUP BY 1) g USING (k_updates)")
def runs_with_data(spark, sf):
    """Each run with the size of the data that the number of updates in its name stands for."""
    both = said(spark, sf)
    names = summaries(both).select(F.concat_ws("_", "mode", F.lit("direct"), F.concat(F.lit("k"), F.col("k_updates"))).alias("run_name"))
    parsed = names.select("run_name", text.run_name(F.col("run_name")).alias("r")).select("run_name", F.col("r.method").alias("method"), F.col("r.k").cast("long").alias("k_updates"))
    data = both[1].groupBy("k_updates").agg(F.count("*").alias("episodes"))
    return parsed.join(data, "k_updates")
