"""What a run leaves for later ones: training pairs of a manager, and logs of reflections and experiences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The manager's prompt, around the state and the sentence.
PROMPT = """You are a constrained Memory Manager. Given the current slot state and a new event, output exactly one structured memory action.

Allowed output formats:
- ADD <entity>.<attribute> = <value>
- UPDATE <entity>.<attribute> = <value>
- NOOP

Entity key normalization examples:
- my friend Bob -> friend_bob
- my sister Lily -> sister_lily
- my mentor Chen -> mentor_chen
- my coworker Alice -> coworker_alice
- my manager Tom -> manager_tom

Current slot state:
{state}

New event:
{event}

Action:"""
EMPTY = "(empty slot state)"
#: Rewards from which an answer is right, and from which an experience is a good one; experiences that are kept; signs of a prediction.
RIGHT, GOOD, KEPT, SHOWN = 0.99, 0.5, 300, 120


def states_before(acts: DataFrame) -> DataFrame:
    """(episode_id, event_idx, state): the slots that hold a value before each event, sorted; events before the first have no row.

    Each write is repeated for the events at which it holds, so that no two events are paired.
    """
    w = Window.partitionBy("episode_id", "entity", "attribute").orderBy("event_idx")
    ends = acts.groupBy("episode_id").agg(F.max("event_idx").alias("end"))
    held = acts.where("entity is not null").withColumn("until", F.lead("event_idx").over(w)).join(ends.hint("merge"), "episode_id")
    first, last = F.col("event_idx") + 1, F.coalesce("until", "end")
    x = held.where(first <= last).select("episode_id", F.explode(F.sequence(first, last)).alias("event_idx"), F.struct("entity", "attribute", "value").alias("slot"))
    return x.groupBy("episode_id", "event_idx").agg(F.array_sort(F.collect_list("slot")).alias("state"))


def action_text(operation: Column, slot: Column) -> Column:
    return F.when(operation == "NOOP", operation).otherwise(F.concat(operation, F.lit(" "), slot))


def training_pairs(acts: DataFrame) -> DataFrame:
    """Prompt, completion and their text for each event of ``acts`` (``runs.actions``)."""
    line = lambda s: F.concat(F.lit("- "), s["entity"], F.lit("."), s["attribute"], F.lit(" = "), s["value"])
    x = acts.join(states_before(acts).hint("merge"), ["episode_id", "event_idx"], "left")
    state = F.coalesce(F.array_join(F.transform("state", line), "\n"), F.lit(EMPTY))
    head, rest = PROMPT.split("{state}")
    mid, tail = rest.split("{event}")
    slot = F.concat("entity", F.lit("."), "attribute", F.lit(" = "), "value")
    x = x.withColumns({"prompt": F.concat(F.lit(head), state, F.lit(mid), "text", F.lit(tail)), "completion": action_text(F.col("operation"), slot)})
    x = x.withColumns({"n_state": F.coalesce(F.size("state"), F.lit(0)), "pair": F.concat("prompt", F.lit(" "), "completion")})
    return x.select("episode_id", "event_idx", "operation", "prompt", "completion", F.col("pair").alias("text"), F.greatest("n_state", F.lit(0)).alias("n_state"))


def reflections(answers: DataFrame) -> DataFrame:
    """A lesson for each answer (question, answer, prediction, reward) that was not right."""
    text = F.concat(
        F.lit("Reflection: when answering '"), "question", F.lit("', prioritize the facts that support '"), "answer",
        F.lit("'. The previous answer was '"), F.substring("prediction", 1, SHOWN), F.lit("'."),
    )
    return answers.where(F.col("reward") < RIGHT).withColumn("reflection", text)


def experiences(answers: DataFrame, key: str, order: str, kept: int = KEPT) -> DataFrame:
    """The last ``kept`` experiences of each ``key``, by ``order``."""
    good = F.concat(F.lit("Successful experience: question '"), "question", F.lit("' was answered well by focusing on '"), "answer", F.lit("'."))
    bad = F.concat(
        F.lit("Corrective experience: for question '"), "question", F.lit("', the reliable target answer is '"), "answer",
        F.lit("', not '"), F.substring("prediction", 1, SHOWN), F.lit("'."),
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = answers.withColumn("_rank", rank).where(F.col("_rank") <= kept).drop("_rank")
    return last.withColumn("experience", F.when(F.col("reward") >= GOOD, good).otherwise(bad))


def consolidations(answers: DataFrame, key: str, order: str, interval: int) -> DataFrame:
    """The answers after which a consolidation is due: every ``interval``-th of each ``key``, with its number."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return answers.withColumn("seen", n).where(F.col("seen") % interval == 0)
