"""Write policies over slot facts, and the states that they leave.

Facts: episode_id, event_idx, entity, attribute, value; entity is null for events without
a slot. These policies are projections and aggregations; those whose target depends on
the store so far are in ``folds``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("episode_id", "entity", "attribute")


def append(facts: DataFrame) -> DataFrame:
    """One entry for each event."""
    return facts.select(*SLOT, "value", F.col("event_idx").alias("created_idx"), F.col("event_idx").alias("updated_idx"))


def slot_upsert(facts: DataFrame) -> DataFrame:
    """One entry for each slot, with its last value; every event without a slot adds one."""
    slots = facts.where("entity is not null").groupBy(*SLOT).agg(F.max_by("value", "event_idx").alias("value"), F.min("event_idx").alias("created_idx"), F.max("event_idx").alias("updated_idx"))
    return slots.unionByName(append(facts.where("entity is null")))


def parsed_only(facts: DataFrame) -> DataFrame:
    return facts.where("entity is not null")


def latest(facts: DataFrame) -> DataFrame:
    """The last fact of each slot."""
    return facts.groupBy(*SLOT).agg(F.max_by("value", "event_idx").alias("value"), F.max("event_idx").alias("event_idx"))


def gold_actions(facts: DataFrame) -> DataFrame:
    """ADD for a slot's first fact in its episode, UPDATE for later ones, NOOP without a slot."""
    n = F.row_number().over(Window.partitionBy(*SLOT).orderBy("event_idx"))
    op = F.when(F.col("entity").isNull(), "NOOP").when(n > 1, "UPDATE").otherwise("ADD")
    return facts.select("episode_id", "event_idx", "entity", "attribute", "value", op.alias("operation"))


def value_before(facts: DataFrame) -> DataFrame:
    """Each fact with the value that its slot held before."""
    before = F.lag("value").over(Window.partitionBy(*SLOT).orderBy("event_idx"))
    return facts.select(*SLOT, "event_idx", "value", before.alias("value_before"))


def replay(actions: DataFrame) -> DataFrame:
    """Entries after actions: ADD starts one, UPDATE overwrites its slot's newest, or adds where there is none."""
    w = Window.partitionBy(*SLOT).orderBy("event_idx")
    starts = (F.col("operation") == "ADD") | (F.row_number().over(w) == 1)
    x = actions.where(F.col("operation").isin("ADD", "UPDATE")).withColumn("starts", starts.cast("int"))
    x = x.withColumn("entry", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*SLOT, "entry").agg(F.max_by("value", "event_idx").alias("value"), F.count("*").alias("n_writes"))
