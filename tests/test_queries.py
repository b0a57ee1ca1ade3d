"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from slotledger.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_similarity_upsert_against_loop(spark):
    import numpy as np

    from slotledger.operators.folds import similarity_upsert

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i % 2, i, v.tolist()) for i, v in enumerate(x)], "episode_id long, event_idx long, vector array<double>")
    got = similarity_upsert(df, 0.5).groupBy("episode_id").count().collect()
    want = {}
    for e in (0, 1):
        store = []
        for v in x[e::2]:
            s = [float(a @ v) for a in store]
            if s and max(s) >= 0.5:
                store[s.index(max(s))] = v
            else:
                store.append(v)
        want[e] = len(store)
    assert {r[0]: r[1] for r in got} == want


def test_text_scores(spark):
    from pyspark.sql import functions as F

    from slotledger.functions import text

    x = spark.createDataFrame([("the cat sat", "the cat"), ("a a", "a a"), ("", "x"), ("Paris\n", " paris"), ("\tParis ", "Paris\r\n")], "p string, g string")
    got = x.select(text.token_f1(F.col("p"), F.col("g")), text.exact_match(F.col("p"), F.col("g")), text.contains_raw(F.col("p"), F.col("g"))).collect()
    assert [round(r[0], 6) for r in got] == [0.8, 0.5, 0.0, 1.0, 1.0] and [r[1] for r in got] == [0.0, 1.0, 0.0, 1.0, 1.0] and [r[2] for r in got] == [True, True, False, True, True]


def test_blank_turns_and_white_space(spark):
    from slotledger.operators import metrics, retrieval
    from slotledger.sources.facts import conversation_events

    c = spark.createDataFrame([(1, 0, "user", " \t\n"), (1, 1, "assistant", None), (1, 2, "user", "a b")], "conv_id long, turn long, role string, text string")
    assert [r.event for r in conversation_events(c).orderBy("event_idx").collect()] == ["User says:  \t\n", "Assistant says: ", "User says: a b"]
    hits = retrieval.lexical_top_k(spark.createDataFrame([(1, "b")], "conv_id long, query string"), c.withColumnRenamed("turn", "idx"), "conv_id", 3)
    assert [r.idx for r in hits.collect()] == [2]
    entries = spark.createDataFrame([(1, "e", "a", v, i) for i, v in enumerate(["x\n", "\t", "y", " X "])], "episode_id long, entity string, attribute string, value string, created_idx long")
    got = metrics.burden(entries, spark.createDataFrame([(1, "e", "a", "x", 4)], "episode_id long, entity string, attribute string, gold string, k_updates long")).first()
    assert (got.same_slot, got.gold_entries, got.stale_entries) == (4, 2, 1)


def test_logistic_and_tau(spark):
    from slotledger.operators import metrics

    x = spark.createDataFrame([(d, y) for d in range(6) for y in [1] * (6 - d) + [0] * d], "dose int, em int")
    a, b = metrics.logistic_fit(x, "dose", "em")
    assert b < 0 and 2 < -a / b < 4
    r = spark.createDataFrame([(1, i, i, i) for i in range(3)], "k int, item int, a int, b int")
    assert metrics.kendall_tau(r, "k", "a", "b").first()["tau"] == 1.0


def test_files(spark, tmp_path):
    import json

    from slotledger.sources import facts

    (tmp_path / "e.json").write_text(json.dumps([{"events": ["a", "b"], "question": "q", "answer": "x"}, {"events": ["c"], "answer": "y", "entity": "e"}]))
    e = facts.episodes(spark, str(tmp_path / "e.json")).collect()
    assert [(r.episode_id, r.entity, r.value, r.num_updates) for r in e] == [(0, "user", "x", 2), (1, "e", "y", 1)]
    for n, body in (("r1", '{"summary": {"em": 1}, "results": []}'), ("r2", "not json")):
        (tmp_path / "runs" / n).mkdir(parents=True)
        (tmp_path / "runs" / n / "out.json").write_text(body)
    (tmp_path / "n.jsonl").write_text('{"a": 1}\n{}\n \t\n{"a": 2}\n')
    assert facts.json_lines(spark, str(tmp_path / "n.jsonl"), "a int").count() == 3
    got = {r.run: r.status for r in facts.results(spark, str(tmp_path / "runs")).collect()}
    assert got == {"r1": "ok", "r2": "invalid_json"}


def test_stream_equals_batch(spark, tmp_path):
    from slotledger.streaming.latest import latest_stream

    src = spark.read.parquet(f"{DATA}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = latest_stream(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, latest_stream(src).collect()))


def test_keyword_upsert_against_loop(spark):
    from slotledger.operators import folds

    texts = ["Ann lives in a big red house", "ann lives in a big red house", "Ann lives in a small red flat", "hm", None, "Bob works at sea", "Cy was here", "Di has one", ""]
    df = spark.createDataFrame([(k, i, t) for k in (1, 2) for i, t in enumerate(texts)] + [(None, 0, "x is y")], "key long, idx long, text string")
    got = folds.keyword_upsert(df, capacity=3).where("key = 2").orderBy("entry").collect()
    # the second text equals the first, so it is added; the third overwrites the first of them; the oldest goes at each add beyond three
    assert [(r.last_idx, r.n_writes) for r in got] == [(5, 1), (6, 1), (7, 1)]
    assert folds.keyword_upsert(df).where("key = 1").count() == 5
    assert folds.keyword_upsert(df.limit(0)).count() == 0


def test_bounded_store_against_loop(spark):
    import numpy as np

    from slotledger.operators import folds

    rng = np.random.default_rng(9)
    v = rng.normal(size=(120, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sure, at = rng.integers(0, 5, 120) / 5, np.cumsum(rng.integers(0, 40, 120))
    df = spark.createDataFrame([(i % 2, i, float(at[i]), float(sure[i]), v[i].tolist()) for i in range(120)], "episode_id long, event_idx long, at double, confidence double, vector array<double>")
    got = {(r.episode_id, r.event_idx): r.n_links for r in folds.bounded_store(df, 10, least=0.5).collect()}
    want = {}
    for e in (0, 1):
        kept, pairs = [], set()
        for i in range(e, 120, 2):
            order = sorted([*kept, i], key=lambda j: (-float(v[j] @ v[i]), j))[:3]
            pairs |= {frozenset((i, j)) for j in order if j != i and v[j] @ v[i] > 0.5}
            kept.append(i)
            if len(kept) > 10:
                old = [j for j in kept if at[i] - at[j] > 60] or kept
                gone = min(old, key=lambda j: (sure[j], j))
                kept.remove(gone)
                pairs = {p for p in pairs if gone not in p}
        want |= {(e, j): sum(j in p for p in pairs) for j in kept}
    assert got == want


def test_parts_of_operations(spark):
    from pyspark.sql import functions as F

    from slotledger.functions import text

    x = spark.createDataFrame([("ADD:\nUPDATE x",), ("DELETE id 7. ",), ("UPDATE",), ("",), (None,)], "c string")
    got = x.select(text.parse_operation(F.col("c"), F.lit("f")).alias("a")).select("a.*").collect()
    assert list(map(tuple, got)) == [("ADD", "", "UPDATE x"), ("DELETE", "7", ""), ("NOOP", "", ""), ("NOOP", "", ""), ("NOOP", "", "")]
    y = spark.createDataFrame([("not json",), (None,), ('"s"',), ('{"results": []}',)], "p string").select(text.payload_texts("p").alias("t"))
    assert [r.t for r in y.collect()] == [[], [], ["s"], []]


def test_normalize_value(spark, tmp_path):
    import re

    texts = ["  The CAFÉ, 12\t", "naïve " * 200 + "End", "x" * 500 + " tail!", "\u00a0a\u2003b\u0085c ", "\u0130I \u212a9", "漢字", "", " \n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    run = __spark_entry__.queries()["normalize_value"]
    brute = lambda t: None if t is None else " ".join(re.findall("[a-z0-9]+", t.lower()))
    assert {r.doc_id: r.norm for r in run(spark, str(tmp_path)).collect()} == {i: brute(t) for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert {r.doc_id: r.norm for r in run(spark, DATA).collect()} == {r.doc_id: brute(r.text) for r in docs}


def test_whole_queries_take_every_entry(spark, monkeypatch):
    """The registered queries against the plain all-pairs plans, in blocks smaller than an episode."""
    from pyspark.sql import functions as F

    from slotledger.operators import retrieval

    monkeypatch.setattr(retrieval.top_k_within, "__defaults__", (64, 48))
    monkeypatch.setattr(retrieval.links_within, "__defaults__", (64, 48))
    v = registry.vectors(spark, DATA)
    s = retrieval.scored_within(v.withColumnRenamed("entry_id", "query_id"), v).cache()
    x = s.withColumn("confidence", F.col("entry_id") % 10 / 10.0)
    want = {
        "topk_cosine": retrieval.top_k(s, 5),
        "latest_per_slot_topk": retrieval.latest_per_slot(s, 5),
        "topk_confident": retrieval.confident_top_k(x, "confidence", 5).select("query_id", "entry_id", "mixed", "rank"),
        "topk_sweep": registry.sweep(spark, DATA, retrieval.top_k(s, 10)),
        "bfs_depth2": retrieval.neighbours(retrieval.links(v, "episode_id", 0.35), v.select(F.col("entry_id").alias("start")), 2),
    }
    found = __spark_entry__.queries()
    for name, df in want.items():
        assert rows(found[name](spark, DATA).toPandas()) == rows(df.toPandas()), name
    assert found["topk_cosine"](spark, DATA).select("query_id").distinct().count() == v.count()


def test_answer_scores_reaches_every_item(spark, tmp_path):
    words = lambda i: f"item {i} of many"
    spark.createDataFrame([(i, words(i % 90)) for i in range(180)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, words(i)) for i in range(90)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = __spark_entry__.queries()["answer_scores"](spark, str(tmp_path)).collect()
    assert len(got) == 180 and all((r.f1, r.em, r.contains_raw) == (1.0, 1.0, True) for r in got)
