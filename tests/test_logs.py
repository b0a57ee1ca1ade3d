"""Back-filled annotations, training pairs and logs on small inputs."""

import generators

from slotledger.functions.surface import annotate
from slotledger.operators import feedback, runs

EPISODE = "events array<string>, question string, answer string, entity string, attribute string, value string, latest_event_idx int"


def test_annotations_are_filled_from_question_and_events(spark):
    rows = [
        (["I live in A.", "I work at B.", "Im moving in C.", "x"], "Where does the user currently live?", "C", None, None, None, -1),
        (["I work at B.", "nothing"], "Where does the user work?", "B", None, "", None, None),
        (["I prefer Go.", "Ive switched to Rust."], "What programming language does the user prefer?", "Rust", "me", None, "r", -1),
        (["I live in A."], "Why?", "?", None, None, None, -1),
        ([], None, None, None, None, None, None),
        (["I live in A."], "Why?", "A", "e", "location", "v", 7),
    ]
    got = annotate(spark.createDataFrame(rows, EPISODE)).collect()
    assert [(r.entity, r.attribute, r.value, r.latest_event_idx) for r in got] == [
        ("user", "location", "C", 2), ("user", "company", "B", 0), ("me", "language", "r", 1),
        ("user", "unknown", "?", -1), ("user", "unknown", "", -1), ("e", "location", "v", 7),
    ]


def test_training_pairs_against_loop(spark):
    acts = runs.actions(generators.episodes(spark, "update_frequency_hard", per_k=3))
    got = {(r.episode_id, r.event_idx): r for r in feedback.training_pairs(acts).collect()}
    state, last = {}, None
    rows = acts.orderBy("episode_id", "event_idx").collect()
    assert len(got) == len(rows)
    for a in rows:
        if a.episode_id != last:
            state, last = {}, a.episode_id
        lines = "\n".join(f"- {e}.{k} = {v}" for (e, k), v in sorted(state.items())) or feedback.EMPTY
        want = feedback.PROMPT.replace("{state}", lines).replace("{event}", a.text)
        op = "NOOP" if a.entity is None else f"{'UPDATE' if (a.entity, a.attribute) in state else 'ADD'} {a.entity}.{a.attribute} = {a.value}"
        r = got[a.episode_id, a.event_idx]
        assert (r.prompt, r.completion, r.text, r.n_state) == (want, op, f"{want} {op}", len(state))
        if a.entity is not None:
            state[a.entity, a.attribute] = a.value


def test_logs(spark):
    rows = [("u", i, f"q{i}", "a", "p" * 200, i % 3 / 2) for i in range(400)]
    x = spark.createDataFrame(rows, "run string, seq long, question string, answer string, prediction string, reward double")
    kept = feedback.experiences(x, "run", "seq").collect()
    assert sorted(r.seq for r in kept) == list(range(100, 400))
    assert {r.experience[:4] for r in kept if r.reward < 0.5} == {"Corr"} and {r.experience[:4] for r in kept if r.reward >= 0.5} == {"Succ"}
    assert max(r.experience.count("p") for r in kept if r.reward < 0.5) < 130
    assert feedback.reflections(x).count() == sum(i % 3 < 2 for i in range(400))
    assert [r.seq for r in feedback.consolidations(x, "run", "seq", 150).orderBy("seq").collect()] == [149, 299]
