"""Stores that change in order, sweeps, running sums, keyed streams and array files against plain loops."""

import json
import os
import random

import generators
import numpy as np
import pytest
from pyspark.sql import functions as F

from slotledger.operators import folds, policies, prefix, runs, store
from slotledger.sources import arrays, facts
from slotledger.streaming import slots as streams

DATA = "/root/testdata/sf0.001"
KINDS = ("ADD", "UPDATE", "DELETE", "NOOP")


def loop(rows, semantic):
    """The log and the entries left, by lists of dicts."""
    kept, log = [], []
    for r in rows:
        slot = (r["entity"], r["attribute"]) if r["entity"] else None
        v = np.array(r["vector"])
        near = max(kept, key=lambda e: (float(e["v"] @ v), -e["id"]), default=None)
        direct = [e for e in kept if str(e["id"]) == r["target_id"]]
        own = sorted((e for e in kept if slot and e["slot"] == slot), key=lambda e: (e["at"], e["last"], e["id"]))
        found, how = None, None
        if r["operation"] in ("UPDATE", "DELETE") and (semantic or r["target_id"]):
            if semantic:
                found, how = (near, "semantic") if near else (None, "none")
            else:
                found, how = (direct[0], "direct_id") if direct else (own[-1], "slot") if own else (near, "semantic") if near else (None, "none")
        op, ok, fallback = r["operation"], r["operation"] == "NOOP", False
        asked = bool(r["target_id"]) or semantic
        if op == "ADD" or op == "UPDATE" and not semantic and asked and not kept:
            scored = sorted(kept + [{"id": r["event_idx"], "v": v}], key=lambda e: (-float(e["v"] @ v), e["id"]))[:3]
            links = {e["id"] for e in scored if e["id"] != r["event_idx"] and float(e["v"] @ v) > 0.7}
            for e in kept:
                if e["id"] in links:
                    e["links"].add(r["event_idx"])
            fallback = op == "UPDATE"
            kept.append({"id": r["event_idx"], "slot": slot if op == "ADD" else None, "at": r["event_idx"], "last": r["event_idx"], "v": v, "n": 1, "reward": r["reward"], "links": links})
            op, ok, entry = "ADD", True, r["event_idx"]
        else:
            entry = found["id"] if found else None
            if found:
                ok, fallback = True, bool(r["target_id"]) and not semantic and str(entry) != r["target_id"]
                if op == "UPDATE":
                    found.update(v=v, last=r["event_idx"], n=found["n"] + 1, reward=max(found["reward"], r["reward"]))
                    if slot and not semantic or slot:
                        found.update(slot=slot, at=r["event_idx"])
                else:
                    kept.remove(found)
                    for e in kept:
                        e["links"].discard(entry)
        log.append((r["episode_id"], r["event_idx"], op, entry, how, ok, fallback))
    return log, [(r["episode_id"], e["id"], e["last"], e["n"], e["reward"], len(e["links"])) for e in kept]


@pytest.mark.parametrize("semantic", [False, True])
def test_stores_against_loop(spark, semantic):
    rng = np.random.default_rng(4)
    rows = []
    for e in range(4):
        for i in range(60):
            v = rng.normal(size=4)
            kind = "UPDATE" if i == 0 and e == 1 else KINDS[rng.choice(4, p=[0.4, 0.3, 0.2, 0.1])]
            entity = f"e{rng.integers(3)}" if rng.random() < 0.6 else None
            target = "" if semantic or rng.random() < 0.1 else str(rng.integers(70)) if rng.random() < 0.8 else "x7"
            rows.append({"episode_id": e, "event_idx": i, "operation": kind, "requested": kind, "target_id": target, "entity": entity, "attribute": "a" if entity else None, "reward": float(rng.random()), "vector": (v / np.linalg.norm(v)).tolist()})
    want = [loop([r for r in rows if r["episode_id"] == e], semantic) for e in range(4)]
    df = spark.createDataFrame(rows, "episode_id long, event_idx long, operation string, requested string, target_id string, entity string, attribute string, reward double, vector array<double>").repartition(3)
    log = store.executed(df, semantic=semantic)
    got = sorted((r.episode_id, r.event_idx, r.effective, r.entry_id, r.how, r.success, r.fallback) for r in log.collect())
    assert got == sorted(x for w in want for x in w[0])
    left = store.stored(df, semantic=semantic).collect()
    assert sorted((r.episode_id, r.entry_id, r.last_idx, r.n_writes, r.reward, r.n_links) for r in left) == sorted(x for w in want for x in w[1])
    assert not semantic or any(r.n_links for r in left)
    if not semantic:
        assert {g[4] for g in got} == {None, "direct_id", "slot", "semantic", "none"} - ({"none"} if not any(g[4] == "none" for g in got) else set())
    counts = store.accounted(log, "episode_id").collect()
    for c in counts:
        own = [g for g in got if g[0] == c.episode_id]
        assert c.success + c.failed == 60 and c.success == sum(g[5] for g in own) and c.effective_add == sum(g[2] == "ADD" for g in own)


def test_exploring_is_the_same_under_any_partitioning(spark):
    rows = [(e, i, "NOOP", f"e{i % 3}", "a") for e in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "episode_id long, event_idx long, operation string, entity string, attribute string")
    one, two = (sorted(store.executed(df.repartition(n), "explore", epsilon=0.3).collect(), key=str) for n in (1, 7))
    assert one == two
    n = sum(r.effective != "NOOP" for r in one)
    assert 80 < n < 210 and {r.effective for r in one} == set(KINDS)
    seeded = store.executed(df, "seed").where("effective = 'ADD'").collect()
    assert sorted((r.episode_id, r.event_idx) for r in seeded) == [(e, 0) for e in range(3)]


def test_sweep_equals_single_runs(spark):
    from slotledger.plans.registry import vectors

    v = vectors(spark, DATA)
    got = {(r.threshold, r.episode_id, r.entry): (r.n_writes, r.last_event_idx) for r in folds.similarity_sweep(v, (0.1, 0.2, 0.3)).collect()}
    want = {(t, r.episode_id, r.entry): (r.n_writes, r.last_event_idx) for t in (0.1, 0.2, 0.3) for r in folds.similarity_upsert(v, t).collect()}
    assert got == want and len({k[0] for k in got}) == 3


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_running_sums(spark, parts):
    rng = random.Random(5)
    rows = [(i // 3, i, rng.randint(-5, 9)) for i in range(500)]
    x = prefix.running_sums(spark.createDataFrame(rows, "a long, b long, v long").repartition(4), ["a", "b"], ["v"], parts).orderBy("n").collect()
    total = 0
    assert len(x) == 500
    for i, r in enumerate(x):
        total += rows[i][2]
        assert (r.n, r.total, r.b, r.sum_v) == (i + 1, 500, i, total)
    assert prefix.running_sums(spark.createDataFrame([], "a long, v long"), ["a"], ["v"], parts).count() == 0


def test_streams_restart_and_equal_batch(spark, tmp_path):
    from slotledger.plans.registry import vectors

    for k, v in streams.ROCKS.items():
        spark.conf.set(k, v)
    f = facts.slot_events(spark.read.parquet(f"{DATA}/events.parquet")).drop("ts")
    v = vectors(spark, DATA).select("episode_id", "event_idx", "vector")
    cases = ((f, streams.slot_upserts, ["episode_id", "entity", "attribute"], "updated_idx", policies.slot_upsert(f)), (v, lambda x: streams.similarity_upserts(x, 0.2), ["episode_id", "entry"], "last_event_idx", folds.similarity_upsert(v, 0.2)))
    for c, (rows, run, key, last, want) in enumerate(cases):
        at = [str(tmp_path / f"{c}-{n}") for n in ("in", "out", "state")]
        edge = rows.approxQuantile("event_idx", [0.3, 0.7], 0.0)
        for low, high in ((-1, edge[0]), (edge[0], edge[1]), (edge[1], 1 << 40)):  # a query of its own each time: a restart from the checkpoint
            rows.where((F.col("event_idx") > low) & (F.col("event_idx") <= high)).coalesce(1).write.mode("append").parquet(at[0])
            q = run(spark.readStream.schema(rows.schema).parquet(at[0])).writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(at[1])).option("checkpointLocation", at[2]).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
        out = spark.read.parquet(at[1])
        names = [n for n in want.columns if n not in key]
        got = out.groupBy(*key).agg(F.max_by(F.struct(*names), last).alias("x")).select(*key, "x.*")
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() < out.count()


def some(rng, depth=0):
    word = lambda: "".join(rng.choices(["a", '"', "\\", "{", "}", "[", "]", ",", "é", "\n", " ", "中"], k=rng.randint(0, 12)))
    k = rng.random()
    if depth < 3 and k < 0.2:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    if depth < 3 and k < 0.5:
        return {word(): some(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return rng.choice([word(), 1, -2.5, None, True, "x" * 300])


def test_array_file_in_blocks(spark, tmp_path):
    rng = random.Random(3)
    x, path = [some(rng) for _ in range(100)], str(tmp_path / "a.json")
    with open(path, "w") as f:
        f.write("  " + json.dumps(x, indent=1, ensure_ascii=False) + "\n")
    size = os.path.getsize(path)
    for block in (-(-size // 4), size // 23):
        got = sorted(map(tuple, arrays.elements(spark, path, block=block).collect()))
        assert [p for p, _ in got] == list(range(100)) and [json.loads(t) for _, t in got] == x
    assert arrays.blocks(spark, path, -(-size // 4)).rdd.getNumPartitions() == 4
    part = sorted(map(tuple, arrays.elements(spark, path, 17, 60, -(-size // 4)).collect()))
    assert [p for p, _ in part] == list(range(17, 60)) and [json.loads(t) for _, t in part] == x[17:60]
    for low, high in ((100, None), (5, 5), (-3, 0)):
        with pytest.raises(ValueError, match="no elements"):
            arrays.elements(spark, path, low, high)
    for body, error in (("[]", "no elements"), ('{"a": 1}', "no JSON array")):
        (tmp_path / "b.json").write_text(body)
        with pytest.raises(ValueError, match=error):
            arrays.elements(spark, str(tmp_path / "b.json"))
    (tmp_path / "set.json").write_text("[1]")
    (tmp_path / "set_dev.json").write_text("[1, 2]")
    assert facts.split_file(str(tmp_path), "set", "dev").endswith("set_dev.json") and facts.split_file(str(tmp_path), "set", "test").endswith("/set.json")
    with pytest.raises(FileNotFoundError):
        facts.split_file(str(tmp_path), "set", "train")


def test_published_sizes(spark):
    """Sizes and stale counts that are published for the hard split, by the number of updates."""
    e = generators.episodes(spark, "update_frequency_hard")
    got = {(r["mode"], r.k_updates): (r.size, r.stale) for r in runs.result_rows(e).groupBy("mode", "k_updates").agg(F.avg("memory_size").alias("size"), F.avg("stale").alias("stale")).collect()}
    want = {"raw_add": [(2, 0), (5, 1), (12, 3), (25, 6.75), (52, 14.25)], "constrained_slot_crud": [(2, 0), (4, 0), (7, 0), (12, 0), (23, 0)]}
    assert {(m, k): got[m, k] for m in want for k in (1, 2, 4, 8, 16)} == {(m, k): w for m, ws in want.items() for k, w in zip((1, 2, 4, 8, 16), ws)}
    assert (got["parsed_append", 16], got["parsed_slot_update", 16]) == ((31, 14.25), (2, 0))
