"""Registered queries of report tables over the event log: prompts compared, answers from the gold context, and the pack of tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from slotledger.functions import surface, text
from slotledger.operators import metrics, runs
from slotledger.plans.episodes import ROWS, SAID, SUMMARY, TRACE, rows_of, said, traces
from slotledger.plans.registry import NORM, query
from slotledger.sources.facts import table
from slotledger.sources.kept import kept
from slotledger.sources.sinks import cell

VARIANTS = ("v1_value_only", "v2_ignore_distractors")
READ = f"""{TRACE}, own AS (SELECT episode_id AS example_id, coalesce(arg_min(v, rank) FILTER (same AND v IS NOT NULL), '') AS kept FROM o WHERE rank <= 5 GROUP BY episode_id),
asked AS (SELECT t.*, variant, CASE variant WHEN '{VARIANTS[0]}' THEN told ELSE kept END AS predicted FROM t JOIN own USING (example_id), (SELECT unnest({list(VARIANTS)}) AS variant))"""


def asked(both):
    """Each trace under both prompts: the first reader takes the newest value of any slot, the second that of the slot asked for."""
    gold = both[1].select("episode_id", "entity", "attribute")
    x = traces(both).join(gold.hint("merge"), "episode_id").withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    own = F.filter("retrieved", lambda e: (e["e_entity"] == F.col("entity")) & (e["e_attribute"] == F.col("attribute")) & e["e_value"].isNotNull())
    kept = F.coalesce(F.get(own, F.lit(0))["e_value"], F.lit(""))
    x = x.withColumn("predicted", F.when(F.col("variant") == VARIANTS[0], F.col("told")).otherwise(kept))
    told, answer = F.col("predicted"), F.col("gold_answer")
    return x.withColumns({"em": text.exact_match(told, answer), "f1": text.token_f1(told, answer)})


@query(f"""{READ}, {SUMMARY.removeprefix('WITH ' + SAID + ',')},
a AS (SELECT k, variant, count(*) AS num_examples, round(avg(CASE WHEN lower(predicted) = lower(answer) THEN 1.0 ELSE 0.0 END), 6) AS avg_em, round(avg(CAST(gold AS DOUBLE)), 6) AS gold_retrieved_rate,
    round(avg(CAST(stale AS DOUBLE)), 6) AS stale_retrieved_rate, round(avg(CAST(distractor AS DOUBLE)), 6) AS distractor_retrieved_rate FROM asked GROUP BY ALL)
SELECT 'raw_add' AS method, variant, k, a.num_examples, a.avg_em, a.avg_em AS avg_f1, s.state_accuracy, s.stale_same_slot_entry_count_avg, s.final_memory_size_avg, gold_retrieved_rate, stale_retrieved_rate, distractor_retrieved_rate
FROM a JOIN summary s ON s.mode = 'raw_add' AND s.k_updates = a.k""")
def prompt_robustness(spark, sf):
    """Scores and retrieval rates by the method, variant and number of updates in a run's name, beside the store's own means."""
    name = F.concat_ws("_", F.lit("raw_add"), "variant", F.concat(F.lit("k"), F.col("k_updates")))
    both = said(spark, sf)
    x = asked(both).withColumn("run", surface.run_name_variant(name))
    rates = {"em": "avg_em", "f1": "avg_f1", "gold_in_retrieved": "gold_retrieved_rate", "stale_in_retrieved": "stale_retrieved_rate", "distractor_in_retrieved": "distractor_retrieved_rate"}
    a = x.groupBy("run").agg(F.count("*").alias("num_examples"), *[runs.mean(c).alias(n) for c, n in rates.items()])
    a = a.select(F.col("run.method").alias("method"), F.col("run.variant").alias("variant"), F.col("run.k").cast("long").alias("k"), "num_examples", *rates.values())
    s = runs.summary(rows_of(both, ("raw_add",)), "mode", "k_updates").select(F.col("mode").alias("method"), F.col("k_updates").alias("k"), "state_accuracy", "stale_same_slot_entry_count_avg", "final_memory_size_avg")
    return a.join(s, ["method", "k"])


def _question(entity, attribute):
    return F.concat(F.lit("What is the "), attribute, F.lit(" of "), entity, F.lit("?"))


def gold_answers(both):
    """Each episode asked with nothing but its latest sentence on the slot: the context, the prompt and the last word of the context as the answer."""
    x = both[1]
    at = F.when(F.col("latest").isNull(), -1).otherwise(0)
    context = surface.gold_context(F.array("latest"), at, F.col("entity"), F.col("attribute"), F.col("answer"))
    x = x.withColumn("context", context)
    prompt = surface.answer_prompt(_question(F.col("entity"), F.col("attribute")), F.col("context"), F.col("entity"), F.col("attribute"), VARIANTS[0])
    return x.withColumns({"prompt": prompt, "predicted": F.regexp_extract("context", r"(\w+)\.?$", 1)})


GOLDEN = f"""latest AS (SELECT episode_id, arg_max(s.text, event_idx) AS said_last FROM said s JOIN gold g USING (episode_id, entity, attribute) GROUP BY episode_id),
golden AS (SELECT g.*, '- ' || said_last AS context, regexp_extract(said_last, '(\\w+)\\.?$', 1) AS predicted FROM gold g JOIN latest USING (episode_id))"""


@query(f"""WITH {SAID}, {GOLDEN} SELECT episode_id, context, predicted, '{surface.INSTRUCTIONS[VARIANTS[0]]}' || chr(10) || chr(10) || 'Target entity: ' || entity || chr(10) || 'Target attribute: ' || attribute || chr(10) || chr(10) || 'Memory entries:' || chr(10) || context
|| chr(10) || chr(10) || 'Question: What is the ' || attribute || ' of ' || entity || '?' || chr(10) || chr(10) || 'Final value only:' AS prompt FROM golden""")
def gold_context_prompts(spark, sf):
    return gold_answers(said(spark, sf)).select("episode_id", "context", "predicted", "prompt")


@query(f"""{ROWS}, {GOLDEN}, {TRACE.removeprefix('WITH ' + SAID + ',')},
a AS (SELECT episode_id AS example_id, 'gold_context' AS context_mode, predicted, true AS gold, false AS stale, false AS distractor FROM golden UNION ALL SELECT example_id, 'retrieved', told, gold, stale, distractor FROM t)
SELECT r.mode, context_mode, r.k_updates, count(*) AS n, round(avg(CASE WHEN lower(a.predicted) = lower(r.gold_answer) THEN 1.0 ELSE 0.0 END), 6) AS em, round(avg(CASE WHEN contains(lower(a.predicted), lower(r.gold_answer)) THEN 1.0 ELSE 0.0 END), 6) AS answer_value_present,
round(avg(r.memory_size), 6) AS memory_size, round(avg(CAST(state_value_em AS DOUBLE)), 6) AS state_accuracy, round(avg(CAST(a.gold AS DOUBLE)), 6) AS gold_rate, round(avg(CAST(a.stale AS DOUBLE)), 6) AS stale_rate, round(avg(CAST(a.distractor AS DOUBLE)), 6) AS distractor_rate
FROM rows r JOIN a USING (example_id) WHERE r.mode = 'raw_add' OR (r.mode = 'constrained_slot_crud' AND context_mode = 'gold_context') GROUP BY ALL""")
def answer_layer(spark, sf):
    """What the answer layer loses: scores from the gold context beside those from what was retrieved, over the stores of both policies."""
    both = said(spark, sf)
    rows = runs.judged(*both, ("raw_add", "constrained_slot_crud")).select("mode", F.col("example_id").alias("episode_id"), "k_updates", "gold_answer", "memory_size", "state_value_em")
    flags = ("gold_in_retrieved", "stale_in_retrieved", "distractor_in_retrieved")
    fixed = [F.lit(f == flags[0]).alias(f) for f in flags]
    given = gold_answers(both).select("episode_id", F.lit("gold_context").alias("context_mode"), "predicted", *fixed)
    found = traces(both).select("episode_id", F.lit("retrieved").alias("context_mode"), F.col("told").alias("predicted"), *flags)
    x = rows.join(given.unionByName(found).hint("merge"), "episode_id").where("mode = 'raw_add' or context_mode = 'gold_context'")
    told, gold = F.col("predicted"), F.col("gold_answer")
    x = x.withColumns({"em": text.exact_match(told, gold), "held": text.contains_value(told, gold)})
    named = {"em": "em", "held": "answer_value_present", "memory_size": "memory_size", "state_value_em": "state_accuracy", flags[0]: "gold_rate", flags[1]: "stale_rate", flags[2]: "distractor_rate"}
    return x.groupBy("mode", "context_mode", "k_updates").agg(F.count("*").alias("n"), *[runs.mean(c).alias(n) for c, n in named.items()])


SMOKE = 10


def _fraction(c: str) -> str:
    return f"printf('%.3f', round({c}, 3))"


SHOWN = {"EM": "avg_em", "state": "state_accuracy", "stale same-slot": "stale_same_slot_entry_count_avg", "memory size": "final_memory_size_avg"}


@query(f"""{SUMMARY}, {TRACE.removeprefix('WITH ' + SAID + ',')}, e AS (SELECT t.*, r.stale AS stored, CASE WHEN lower(told) = lower(t.answer) THEN 1.0 ELSE 0.0 END AS em FROM t JOIN rows r ON r.example_id = t.example_id AND r.mode = 'raw_add'),
d AS (SELECT section, dose, count(*) AS n, avg(em) AS em FROM (SELECT em, unnest([struct_pack(section := 'Stored stale dose-response', dose := stored), struct_pack(section := 'Retrieved stale dose-response', dose := n_stale)], recursive := true) FROM e) GROUP BY ALL),
named AS (SELECT CASE WHEN num_examples < {SMOKE} THEN 'smoke_' ELSE '' END || mode || '_slot_direct_k' || k_updates AS run_name, * FROM summary)
SELECT section, printf('%.3f', dose::DOUBLE) AS label, x.name AS name, x.cell AS cell FROM (SELECT section, dose, unnest([struct_pack(name := 'n', cell := CAST(n AS VARCHAR)), struct_pack(name := 'EM', cell := {_fraction('em')})]) AS x FROM d)
UNION ALL SELECT section, run_name, x.name, x.cell FROM (SELECT run_name, unnest([{", ".join(f"struct_pack(name := '{n}', cell := {_fraction(c)})" for n, c in SHOWN.items())}]) AS x,
    section FROM (SELECT *, unnest(CASE WHEN stale_same_slot_entry_count_avg = 0 THEN ['Runs', 'Zero stale'] ELSE ['Runs'] END) AS section FROM named WHERE NOT starts_with(run_name, 'smoke_')))""")
def table_pack(spark, sf):
    """The cells of all tables of the report: doses of stored and of retrieved stale entries, all runs, and those without a stale entry.

    Runs of fewer than ``SMOKE`` examples are named smoke runs, and left out.
    """
    both = said(spark, sf)
    em = text.exact_match(F.col("told"), F.col("gold_answer"))
    seen = traces(both).select("episode_id", em.alias("em"), F.col("stale_retrieved_count").alias("retrieved"))
    rows = kept(rows_of(both))
    stored = rows.where("mode = 'raw_add'").select(F.col("example_id").alias("episode_id"), F.col("stale").alias("stored"))
    seen = kept(seen.join(stored.hint("merge"), "episode_id"))
    parts = []
    for dose in ("stored", "retrieved"):
        cells = [F.struct(F.lit("n").alias("name"), cell(F.col("n"), "bigint", 3).alias("cell")), F.struct(F.lit("EM").alias("name"), cell(F.col("mean"), "double", 3).alias("cell"))]
        parts.append(metrics.dose_bins(seen, dose, "em").select(F.lit(f"{dose.capitalize()} stale dose-response").alias("section"), cell(F.col("dose"), "double", 3).alias("label"), F.explode(F.array(*cells)).alias("x")))
    x = runs.summary(rows, "mode", "k_updates")
    name = F.concat(F.when(F.col("num_examples") < SMOKE, "smoke_").otherwise(""), F.concat_ws("_", "mode", F.lit("slot_direct"), F.concat(F.lit("k"), F.col("k_updates"))))
    x = x.withColumn("label", name).where(~F.startswith("label", F.lit("smoke_")))
    cells = [F.struct(F.lit(n).alias("name"), cell(F.col(c), "double", 3).alias("cell")) for n, c in SHOWN.items()]
    sections = F.when(F.col("stale_same_slot_entry_count_avg") == 0, F.array(F.lit("Runs"), F.lit("Zero stale"))).otherwise(F.array(F.lit("Runs")))
    parts.append(x.withColumn("section", F.explode(sections)).select("section", "label", F.explode(F.array(*cells)).alias("x")))
    return reduce(lambda a, b: a.unionByName(b), parts).select("section", "label", "x.name", "x.cell")


@query("""SELECT conv_id, turn, role || ': ' || CASE WHEN coalesce(text, '') = '' THEN '[image] turn ' || turn ELSE text END AS said FROM conversations
WHERE length(role || ': ' || CASE WHEN coalesce(text, '') = '' THEN '[image] turn ' || turn ELSE text END) > 3""")
def flat_turns(spark, sf):
    """The turns of conversations, written as dicts in Python's way, as one line each; what has no text is told by its caption."""
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("turn "), "turn").alias("blip_caption")))
    event = F.concat(F.lit("{'speaker': '"), "role", F.lit("', 'seen': None, 'sent': True, "), F.substr(body, F.lit(2)))
    x = table(spark, sf, "conversations").select("conv_id", "turn", surface.flat_event(event).alias("said"))
    return x.where(F.length("said") > 3)


NEAR, PLACES = 8, ("beginning", "middle", "end")


@query(f"""WITH {SAID}, c AS (SELECT s.episode_id, s.event_idx, s.text, coalesce(s.entity = g.entity AND s.attribute = g.attribute, false) AS same FROM said s JOIN gold g USING (episode_id) WHERE s.entity IS NOT NULL),
m AS (SELECT *, event_idx = max(event_idx) FILTER (same) OVER (PARTITION BY episode_id) AS newest FROM c),
r AS (SELECT *, CASE WHEN newest THEN 0 ELSE row_number() OVER (PARTITION BY episode_id, newest ORDER BY NOT same, event_idx DESC) END AS rn FROM m),
k AS (SELECT *, max(rn) OVER (PARTITION BY episode_id) AS n FROM r WHERE rn <= {NEAR}),
p AS (SELECT *, CASE gold_position WHEN 'beginning' THEN 0 WHEN 'middle' THEN n // 2 ELSE n END AS gold_index FROM k, (SELECT unnest({list(PLACES)}) AS gold_position)),
q AS (SELECT *, CASE WHEN rn = 0 THEN gold_index WHEN rn <= gold_index THEN rn - 1 ELSE rn END AS place, CASE WHEN rn = 0 THEN 'gold' WHEN same THEN 'stale_same_slot' ELSE 'near_miss' END AS tag FROM p)
SELECT episode_id, gold_position, CAST(count(*) AS BIGINT) AS context_size, CAST(gold_index AS BIGINT) AS gold_index, string_agg(tag, ',' ORDER BY place) AS tags, string_agg('- ' || text, chr(10) ORDER BY place) AS context FROM q GROUP BY episode_id, gold_position, gold_index""")
def lost_in_middle(spark, sf):
    """The latest sentence of each gold slot at the beginning, the middle and the end of up to ``NEAR`` others: stale ones first, then the newest."""
    facts, gold = said(spark, sf)
    g = gold.select("episode_id", F.col("entity").alias("g_entity"), F.col("attribute").alias("g_attribute"))
    x = facts.where("entity is not null").join(g.hint("merge"), "episode_id").withColumn("same", (F.col("entity") == F.col("g_entity")) & (F.col("attribute") == F.col("g_attribute")))
    own = runs.Window.partitionBy("episode_id")
    x = x.withColumn("newest", F.coalesce(F.col("event_idx") == F.max(F.when(F.col("same"), F.col("event_idx"))).over(own), F.lit(False)))
    w = runs.Window.partitionBy("episode_id", "newest").orderBy(~F.col("same"), F.desc("event_idx"))
    tag = F.when(F.col("newest"), "gold").when(F.col("same"), "stale_same_slot").otherwise("near_miss")
    x = x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= NEAR)
    entry = F.struct(tag.alias("tag"), F.col("text"))
    e = x.groupBy("episode_id").agg(F.max(F.when(F.col("newest"), entry)).alias("gold"), F.array_sort(F.collect_list(F.when(~F.col("newest"), F.struct("rn", entry.alias("e"))))).alias("others"))
    e = e.withColumn("others", F.transform("others", lambda o: o["e"])).withColumn("gold_position", F.explode(F.array(*map(F.lit, PLACES))))
    n = F.size("others")
    at = F.when(F.col("gold_position") == "beginning", 0).when(F.col("gold_position") == "middle", F.floor(n / 2).cast("int")).otherwise(n)
    e = e.withColumn("at", at)
    lines = F.concat(F.slice("others", F.lit(1), F.col("at")), F.array("gold"), F.slice("others", F.col("at") + 1, n))
    e = e.withColumn("lines", lines)
    tags, context = F.array_join(F.transform("lines", lambda s: s["tag"]), ","), F.array_join(F.transform("lines", lambda s: F.concat(F.lit("- "), s["text"])), "\n")
    return e.select("episode_id", "gold_position", F.size("lines").cast("long").alias("context_size"), F.col("at").cast("long").alias("gold_index"), tags.alias("tags"), context.alias("context"))


@query(f"""WITH {SAID}, w AS (SELECT episode_id, event_idx, entity || '.' || attribute AS slot, value, CASE WHEN entity IS NULL THEN 'NOOP' WHEN row_number() OVER (PARTITION BY episode_id, entity, attribute ORDER BY event_idx) > 1 THEN 'UPDATE' ELSE 'ADD' END AS op FROM said)
SELECT episode_id, event_idx, CASE op WHEN 'ADD' THEN 'ADD: ' || value WHEN 'UPDATE' THEN 'UPDATE ' || slot || ': ' || value ELSE op END AS written, op AS operation, CASE WHEN op = 'UPDATE' THEN slot ELSE '' END AS target, CASE WHEN op = 'NOOP' THEN '' ELSE value END AS content FROM w""")
def written_operations(spark, sf):
    """The log's operations as text, and what the parser of free text reads from it."""
    x = runs.acted(said(spark, sf)[0])
    x = x.withColumn("written", surface.operation_text(F.col("operation"), F.concat_ws(".", "entity", "attribute"), F.col("value")))
    return x.select("episode_id", "event_idx", "written", text.parse_operation(F.col("written"), F.lit("")).alias("a")).select("episode_id", "event_idx", "written", "a.*")


LAST = 6


@query(f"""{TRACE}, h AS (SELECT episode_id, string_agg('- ' || said.text, chr(10) ORDER BY event_idx DESC) AS held FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY event_idx DESC) AS rank FROM said) said JOIN gold g USING (episode_id)
    WHERE rank <= 5 AND contains({NORM.format('said.text')}, lower(g.answer)) GROUP BY episode_id),
e AS (SELECT episode_id, string_agg('- ' || text, chr(10) ORDER BY event_idx) AS events FROM (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY event_idx DESC) <= {LAST}) GROUP BY episode_id)
SELECT episode_id, '### Retrieved Context' || chr(10) || coalesce(held, '(no retrieved context)') || chr(10) || chr(10) || '### Current Events' || chr(10) || events AS prompt FROM gold JOIN e USING (episode_id) LEFT JOIN h USING (episode_id)""")
def agent_prompts(spark, sf):
    """What an agent is shown: what it retrieved that holds the answer, newest first, and the last events, oldest first."""
    held = F.transform(F.filter("retrieved", lambda e: e["has_gold_value"]), lambda e: e["content"])
    last = F.row_number().over(runs.Window.partitionBy("episode_id").orderBy(F.desc("event_idx")))
    both = said(spark, sf)
    e = both[0].withColumn("back", last).where(F.col("back") <= LAST).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("event_idx", "text"))).alias("events"))
    events = F.transform("events", lambda s: s["text"])
    shown = F.concat_ws("\n\n", surface.context_block("Retrieved Context", held, "(no retrieved context)"), surface.context_block("Current Events", events, "(no events)"))
    return traces(both).join(e.hint("merge"), "episode_id").select("episode_id", shown.alias("prompt"))


@query(TRACE + """, c AS (SELECT example_id, told, answer, count(*) FILTER (v IS NOT NULL) AS told_any, count(*) FILTER (same AND v = answer) AS g, count(*) FILTER (same AND v <> answer) AS s FROM (SELECT * EXCLUDE (answer, k) FROM o WHERE rank <= 2) o JOIN t ON t.example_id = o.episode_id GROUP BY ALL)
SELECT CASE WHEN told_any > 0 THEN CAST(g AS VARCHAR) ELSE '' END AS gold, CASE WHEN told_any > 0 THEN CAST(s AS VARCHAR) ELSE '' END AS stale, count(*) AS n, round(avg(CASE WHEN lower(told) = lower(answer) THEN 1.0 ELSE 0.0 END), 6) AS em FROM c GROUP BY 1, 2""")
def retrieved_doses(spark, sf):
    """Scores by how many of the two newest entries, if they tell any fact, tell the answer and a stale value; empty where they tell none."""
    both = said(spark, sf)
    gold = both[1].select("episode_id", "entity", "attribute")
    x = traces(both).join(gold.hint("merge"), "episode_id")
    facts = F.filter("retrieved", lambda e: (e["rank"] <= 2) & e["e_value"].isNotNull())
    x = x.withColumn("c", runs.trace_counts(facts, F.col("entity"), F.col("attribute"), F.col("gold_answer"))).withColumn("em", text.exact_match(F.col("told"), F.col("gold_answer")))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return x.groupBy(shown("c.gold").alias("gold"), shown("c.stale").alias("stale")).agg(F.count("*").alias("n"), runs.mean("em").alias("em"))
