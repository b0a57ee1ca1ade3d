"""The parser, generated splits, text surface, sources and sinks on small rows."""

import json
import re

import generators
import pytest
from pyspark.sql import functions as F

from slotledger.functions import slots, surface
from slotledger.operators import runs
from slotledger.sources import facts, sinks

GOLDEN = [
    ("User says: My manager Tom works at Tencent.", ("manager_tom", "company", "Tencent")),
    ("User says: Tom joined JD.", ("manager_tom", "company", "JD")),
    ("User says: my advisor Nora timezone is UTC+8.", ("advisor_nora", "timezone", "UTC+8")),
    ("User says: my teammate Leo hobby is climbing.", ("teammate_leo", "hobby", "climbing")),
    ("User says: my cousin Mia instrument is erhu.", ("cousin_mia", "instrument", "erhu")),
    ("User says: my neighbor Hank now works on project Atlas.", ("neighbor_hank", "project", "Atlas")),
    ("User says: Alice lives in Ulm.", ("coworker_alice", "location", "Ulm")),
    ("User says: my mother moved to Xiamen.", ("mother", "location", "Xiamen")),
    ("User says: Hank and Tom settled in Wuxi.", ("manager_tom", "location", "Wuxi")),
    ("User says: I joined Kotlin.", (None, None, None)),
    ("User says: I switched to kotlin.", ("user", "language", "kotlin")),
    ("User says: I work at Siemens.", (None, None, None)),
    ("User says: Bob became my tutor.", ("friend_bob", "relation", "tutor")),
    ("User says: it is my turn.", (None, None, None)),
    ("User says: Leo moved to project Jade.", ("teammate_leo", "project", "Jade")),
    ("User says: my friend Tom prefers Go.", ("friend_tom", "language", "Go")),
    ("User says: Tom started preferring tea.", ("friend_tom", "preference", "tea")),
    ("User says: Tommy plays chess.", ("user", "instrument", "chess")),
]


def test_parser(spark):
    x = spark.createDataFrame([(e, i, t) for e in (1, 2) for i, (t, _) in enumerate(GOLDEN)] + [(3, 0, None), (3, 1, "")], "episode_id long, event_idx int, text string")
    got = {(r.episode_id, r.event_idx): (r.entity, r.attribute, r.value) for r in slots.parse(x).collect()}
    for i, (t, want) in enumerate(GOLDEN):
        assert got[1, i] == got[2, i] == want, t
    assert got[3, 0] == got[3, 1] == (None, None, None) and slots.parse(x.limit(0)).count() == 0


def plain_resolver():
    """The rule, one sentence at a time."""
    known = dict(slots.ALIASES)

    def entity(text):
        low = text.lower()
        m = re.search(rf"\bmy ({'|'.join(slots.RELATIONS)}) ([a-z]+)\b", low)
        if m:
            known[m[2]] = f"{m[1]}_{m[2]}"
            return known[m[2]]
        if "my mother" in low or "user's mother" in low:
            return "mother"
        return next((e for n, e in known.items() if re.search(rf"\b{n}\b", low)), "user")

    return entity


@pytest.mark.parametrize("kind", generators.SHAPES)
def test_resolver_on_splits(spark, kind):
    e = generators.episodes(spark, kind, per_k=20)
    got = {(r.episode_id, r.event_idx): r.entity for r in slots.resolve(facts.events_of(e)).collect()}
    for r in e.collect():
        resolve = plain_resolver()
        assert [got[r.episode_id, i] for i in range(len(r.events))] == [resolve(t) for t in r.events]
        assert r.answer in r.events[r.latest_event_idx] and r.num_events == len(r.events)


def test_prompts_and_contexts(spark):
    x = spark.createDataFrame([(["a", "b"], 1, "e", "at", "v"), (["a", "b"], 7, "e", "at", "v"), (["a", "b"], None, None, None, None)], "events array<string>, i int, e string, a string, v string")
    c = F.col
    got = x.select(surface.gold_context(c("events"), c("i"), c("e"), c("a"), c("v")).alias("g"), surface.answer_prompt(F.lit("q"), F.lit("- m"), c("e"), c("a"), "v1_value_only").alias("p")).collect()
    assert [r.g for r in got] == ["- b", "- e.at = v", "- b"]
    assert got[2].p.endswith("Target entity: user\nTarget attribute: unknown\n\nMemory entries:\n- m\n\nQuestion: q\n\nFinal value only:")


def test_names_and_values(spark):
    x = spark.createDataFrame([("direct_t0.85_k16", "raw_add_v2_ignore_k8", "True"), ("direct_k16", "x", "0.5"), ("", "", "")], "a string, b string, t string")
    got = x.select(surface.run_name_threshold(F.col("a")).alias("a"), surface.run_name_variant(F.col("b")).alias("b"), surface.truth(F.col("t")).alias("t")).collect()
    assert tuple(got[0].a) == ("direct", 0.85, 16) and tuple(got[0].b) == ("raw_add", "v2_ignore", 8) and tuple(got[1].a) == (None, None, None)
    assert [r.t for r in got] == [1.0, 0.5, 0.0]
    events = {
        '{"speaker": "A", "text": "hi", "blip_caption": "cat"}': "A: hi", "plain": "plain", '{"text": "x"}': "x", "{broken": "{broken", "": "",
        "{'speaker': 'Ann', 'text': \"it's\", 'n': None, 'seen': [True, False]}": "Ann: it's", "{'text': 'say \\'hi\\'', 'speaker': ''}": "say 'hi'",
        "{'speaker': 'Ann', 'text': '', 'blip_caption': 'a cat'}": "Ann: [image] a cat", "{'blip_caption': 'a cat', 'text': None}": "[image] a cat",
        "{'speaker': 'Ann'}": "{'speaker': 'Ann'}", '{"text": "a: None, b", "n": 1}': "a: None, b",
    }
    y = spark.createDataFrame([(e,) for e in events] + [(None,)], "e string")
    assert [r[0] for r in y.select(surface.flat_event(F.col("e"))).collect()] == [*events.values(), None]
    z = spark.createDataFrame([("Lily location Xiamen", "sister_lily", "location", "Xiamen"), ("Lily in Xiamen", "sister_lily", "location", "Xiamen")], "c string, e string, a string, v string")
    assert [r[0] for r in z.select(surface.same_slot_text(*map(F.col, "ceav"))).collect()] == [True, False]


def test_encoder(spark):
    v = [r[0] for r in spark.createDataFrame([("a b c",), ("a b c",), ("",), ("q",)], "t string").select(surface.encode(F.col("t"))).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9 and not any(v[2]) and len(v[3]) == 64


def test_targets_and_texts(spark):
    t = spark.createDataFrame([(1, 1, "11", "e", "a"), (2, 1, "99", "e", "a"), (3, 1, "99", "x", "a"), (4, 2, "11", "x", "y")], "action_id long, episode_id long, target_id string, entity string, attribute string")
    e = spark.createDataFrame([(1, 11, "q", "q", 0), (1, 12, "e", "a", 1), (1, 13, "e", "a", 5)], "episode_id long, entry_id long, entity string, attribute string, updated_idx long")
    near = spark.createDataFrame([(3, 11, 0.5), (3, 12, 0.9)], "action_id long, entry_id long, score double")
    got = {r.action_id: (r.entry_id, r.how) for r in surface.resolve_target(t, e, near).collect()}
    assert got == {1: (11, "direct_id"), 2: (13, "slot"), 3: (12, "semantic"), 4: (None, "none")}
    c = spark.createDataFrame([(1, i, i % 3 / 2, f"t{i}") for i in range(30)], "k long, entry_id long, confidence double, content string")
    text = surface.most_confident(c, "k").first().text.split("\n")
    assert len(text) == 20 and text[0] == "- t2" and text[10] == "- t1"
    x = spark.createDataFrame([(1, 0, "sister Lily visited Wuxi.", "sister_lily", "location"), (1, 1, "my sister Lily moved to Ulm.", "sister_lily", "location"), (1, 2, "my sister Lily lives in Hof.", "sister_lily", "location"), (2, 0, "Bob works at Acme.", "friend_bob", "company"), (3, 0, "Nothing, here!", "u", "hobby")], "episode_id long, idx long, content string, entity string, attribute string")
    assert {r.episode_id: r.predicted for r in surface.choose_prediction(x).collect()} == {1: "Hof", 2: "Acme", 3: "nothing here"}


def test_taxonomy_labels(spark):
    schema = "em double, value_em boolean, state_error string, predicted string, gold_answer string, stale_values array<string>, has_trace boolean, gold_in_retrieved boolean, distractor_in_retrieved boolean, stale_in_retrieved boolean"
    base = [0.0, False, "correct", "zz", "Ulm", ["Hof"], True, True, False, False]
    put = lambda **k: tuple(k.get(n.split()[0], v) for n, v in zip(schema.split(", "), base))
    rows = [put(em=1.0), put(state_error="missing_state"), put(predicted="in Ulm"), put(predicted="hof or bad", stale_values=["Hof", "bad"]), put(has_trace=False), put(gold_in_retrieved=False), put(distractor_in_retrieved=True), put(stale_in_retrieved=True), put()]
    assert [r.answer_error for r in runs.answer_error(spark.createDataFrame(rows, schema)).collect()] == list(runs.ANSWER_ERRORS)


def test_shards_with_a_repeated_example_fail(spark):
    rows = runs.result_rows(generators.episodes(spark, "update_frequency_hard", per_k=2, ks=(2,)), ("raw_add",))
    assert runs.merged([rows.where("example_id = 0"), rows.where("example_id = 1")], "mode").first().num_examples == 2
    with pytest.raises(Exception, match="two shards"):
        runs.merged([rows, rows], "mode").collect()


def test_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, "a b", 0.5), (2, None, None)], "id long, content string, confidence double")
    sinks.save_store(e, str(tmp_path / "s"))
    got = facts.load_store(spark, str(tmp_path / "s"), "id long, content string, confidence double").orderBy("id").collect()
    assert [(r.id, r.content, r.confidence) for r in got] == [(1, "a b", 0.5), (2, None, None)] and len(got[0].embedding) == 64
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n   \n{"a": 3}\n')
    assert facts.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").count() == 3 and facts.json_lines(spark, str(tmp_path / "l.jsonl"), "a int", 2).count() == 2
    sinks.write_csv(e, str(tmp_path / "c"), ["content", "id", "more"])
    back = facts.csv_rows(spark, str(tmp_path / "c")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a b", "1", None), (None, "2", None)]
    assert sinks.markdown_head(e) == ["| id | content | confidence |", "| --- | --- | --- |"]
    assert [r.line for r in sinks.markdown_rows(e).collect()] == ["| 1 | a b | 0.500 |", "| 2 | — | — |"]
    p = sinks.payload(e.limit(1), e).collect()
    assert [r.part for r in p].count("summary") == 1 and {json.loads(r.body)["id"] for r in p} == {1, 2}
    assert sinks.unavailable(spark.range(1), "m", "none").first().status == "unavailable"
    assert [r.shard for r in facts.not_done(spark.range(3).toDF("shard"), spark.range(2).toDF("shard")).collect()] == [2]
    assert len(facts.unique_inputs([str(tmp_path / "s"), str(tmp_path / "x" / ".." / "s")])) == 1
    m = facts.manifest(spark.createDataFrame([("results/g/r_k2/evomemory.json", '{"summary": {"mode": "m"}, "results": [{"k_updates": 2}, {}]}'), ("x/y.json", "{}")], "path string, value string")).collect()
    assert (m[0].result_group, m[0].run_name, m[0].mode, m[0].k_updates, m[0].num_examples, m[0].status) == ("g", "r_k2", "m", 2, 2, "completed") and m[1].result_group == "unknown"
    sinks.write_by_updates(generators.episodes(spark, "update_frequency", per_k=2), str(tmp_path / "f"))
    assert (tmp_path / "f" / "k_updates=16").exists()


def test_operations_and_blocks_as_text(spark):
    x = spark.createDataFrame([("ADD", "t", "c"), ("UPDATE", "t", "c"), ("DELETE", "t", "c"), ("NOOP", "t", "c"), ("ADD", None, None), ("DELETE", None, None), (None, "t", "c"), ("other", "", "")], "o string, t string, c string")
    got = [r[0] for r in x.select(surface.operation_text(F.col("o"), F.col("t"), F.col("c"))).collect()]
    assert got == ["ADD: c", "UPDATE t: c", "DELETE t", "NOOP", "ADD:", "DELETE", "NOOP", "NOOP"]
    y = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "i array<string>")
    assert [r[0] for r in y.select(surface.context_block("T", F.col("i"), "(none)")).collect()] == ["### T\n- a\n- b", "### T\n(none)", "### T\n(none)"]


def test_trace_counts_tell_none_from_zero(spark):
    from slotledger.operators.runs import trace_counts

    entry = "array<struct<e_entity: string, e_attribute: string, e_value: string>>"
    rows = [([("u", "a", " Bonn\n"), ("u", "a", "Ulm"), ("u", "b", "Bonn"), ("u", "a", None)],), ([("w", "a", "Bonn")],), ([],), (None,)]
    x = spark.createDataFrame(rows, f"r {entry}")
    got = [tuple(r[0]) for r in x.select(trace_counts(F.col("r"), F.lit("u"), F.lit("a"), F.lit("bonn"))).collect()]
    assert got == [(1, 2), (0, 0), (None, None), (None, None)]


def test_parse_searches_once(spark):
    """No join of a sentence with its own words, no search again for a filter, and equal rows stay apart."""
    x = spark.createDataFrame([(1, 0, "User says: my mentor Zed plays chess."), (1, 1, "User says: Zed took up judo."), (1, 1, "User says: Zed took up judo."), (1, 2, None)], "episode_id long, event_idx int, text string")
    got = slots.parse(x).where("entity is not null")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1 and "relocated" not in plan
    assert sorted((r.event_idx, r.entity, r.attribute, r.value) for r in got.collect()) == [(0, "mentor_zed", "instrument", "chess"), *[(1, "mentor_zed", "hobby", "judo")] * 2]


def test_log_is_parsed_once():
    """The parts of a report share one parsed log."""
    import inspect

    from slotledger.plans import tables

    for f in (tables.answer_layer, tables.table_pack, tables.prompt_robustness):
        assert inspect.getsource(f).count("said(spark, sf)") == 1


def test_resolver_with_many_names(spark):
    """Names beyond the bits that mark them, words that are bound later, and names bound again."""
    import random

    r = random.Random(5)
    names = [f"{a}{b}" for a in "qwrtplkjhg" for b in "aeiouy"] + ["alex", "says", "is"]
    said = [r.choice([f"User says: my {r.choice(slots.RELATIONS)} {r.choice(names)} is well.", f"User says: {r.choice(names)} met {r.choice(names)} and {r.choice(names)}."]) for _ in range(600)]
    x = spark.createDataFrame([(e, i, t) for e in (1, 2) for i, t in enumerate(said[e - 1 :])], "episode_id long, event_idx int, text string")
    got = {(g.episode_id, g.event_idx): g.entity for g in slots.resolve(x).collect()}
    for e in (1, 2):
        resolve = plain_resolver()
        assert [got[e, i] for i in range(len(said) - e + 1)] == [resolve(t) for t in said[e - 1 :]]


def test_rows_are_those_of_the_stores(spark):
    """What ``judged`` sums over slots is what the entries of each mode's store come to."""
    x = slots.parse(facts.events_of(generators.episodes(spark, "update_frequency_hard", per_k=3)))
    golds = generators.episodes(spark, "update_frequency_hard", per_k=3)
    got = {(r.mode, r.example_id): r for r in runs.judged(x, golds).collect()}
    gold = {g.episode_id: g for g in golds.collect()}
    for mode in runs.MODES:
        entries = runs.stores(x, (mode,)).collect()
        for i, g in gold.items():
            own = [e for e in entries if e.episode_id == i]
            slot = [e for e in own if (e.entity, e.attribute) == (g.entity, g.attribute)]
            right = [e for e in slot if e.value.lower() == g.value.lower()]
            r = got[mode, i]
            assert (r.memory_size, r.same_slot, r.gold, r.stale) == (len(own), len(slot), len(right), len(slot) - len(right))
            assert (r.n_add + r.n_update, r.target_slot_write_count) == (sum(e.n_writes for e in own), sum(e.n_writes for e in slot))
            assert r.gold_present_anywhere == any(g.value.lower() in e.content.lower() for e in own)
            assert r.predicted == max(slot, key=lambda e: e.updated_idx).value


#: What the plan of a report held when it went over the log again for each mode, part or text.
AGAIN = {
    "table_pack": "max_by", "merged_shards": "max_by", "prompt_robustness": "parsed_append", "attribute_summary": "explode",
    "context_mechanisms": "max_by", "gold_context_prompts": "Join", "recent_trace_flags": "max_by",
}


@pytest.mark.parametrize("name", AGAIN)
def test_reports_go_over_the_log_once(spark, name):
    from slotledger.plans import registry, tables  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert AGAIN[name] not in plan


@pytest.mark.parametrize("name", ["thesis_table", "run_summary", "recent_trace_flags", "manager_training_pairs", "memory_metrics", "annotated_contexts", "position_summary", "lost_in_middle", "agent_prompts", "retrieved_doses", "answer_layer"])
def test_no_log_goes_through_the_driver(spark, name):
    """Joins of events or episodes are merged, though the files are small enough for Spark to broadcast them."""
    from slotledger.plans import registry, tables  # noqa: F401

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_log_is_sorted_once(spark):
    """The parse deals and sorts the log's events once; no grouping or windows by name follow."""
    from slotledger.plans import episodes

    plan = slots.parse(episodes.sentences(spark, "/root/testdata/sf0.001"), episodes.ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == plan.count("Exchange ") == 1 and "Aggregate" not in plan and "Generate" not in plan


def test_names_last_over_batches(spark):
    """What is bound in one batch holds in the next, not in the next episode, and a filter above the parse takes no sentence from it."""
    said = ["User says: my mentor Zed plays chess.", *["User says: Zed took up judo."] * 20, "User says: my cousin Zed joined JD.", *["User says: Zed took up judo."] * 20]
    x = spark.createDataFrame([(e, i, t) for e in (1, 2) for i, t in enumerate(said[e - 1 :])], "episode_id long, event_idx int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = slots.parse(x).where("text like '%judo%'").groupBy("episode_id", "entity").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(1, "cousin_zed", 20), (1, "mentor_zed", 20), (2, "cousin_zed", 20), (2, "user", 20)]


def test_summary_makes_what_it_reports(spark):
    """A summary of the gold slots' values reads no texts, and the sums over whole episodes are not made for it."""
    from slotledger.plans import registry

    plan = registry.QUERIES["attribute_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "num_events" not in plan and "bool_or" not in plan


def test_rows_of_episodes_without_their_gold_slot(spark):
    """A gold slot that no sentence told, one of an episode without sentences, and one without a value."""
    x = slots.parse(spark.createDataFrame([(1, 0, "User says: I moved to Ulm."), (1, 1, "User says: so it is."), (3, 0, "User says: I moved to Graz.")], "episode_id long, event_idx int, text string"))
    golds = [(1, "user", "hobby", "Ulm", "Ulm", 4, 2), (2, "user", "hobby", "Ulm", "Ulm", 4, 0), (3, "user", "location", None, None, 4, 1)]
    g = spark.createDataFrame(golds, "episode_id long, entity string, attribute string, value string, answer string, k_updates int, num_events int")
    got = {(r.mode, r.example_id): r for r in runs.judged(x, g).collect()}
    assert len(got) == 12
    for (mode, i), r in got.items():
        size = {1: 1 if mode.startswith("parsed") else 2, 2: 0, 3: 1}[i]
        assert (r.memory_size, r.same_slot, r.stale, r.gold, r.gold_present_anywhere) == (size, int(i == 3), 0, 0, i == 1)
        assert (r.state_resolved, r.predicted) == (i == 3, "Graz" if i == 3 else "")
