"""Source mixing, hard-negative mining and tokenizer alignment against plain Python, with odd rows."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from slotledger.llm import alignment, mixing, negatives

DATA = "/root/testdata/sf0.001"


def same_as_sql(got, sql, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS FROM '{DATA}/{table}.parquet'")
    want = con.sql(sql).df()
    rows = lambda df: sorted(map(str, df[sorted(want.columns)].values.tolist()))
    return rows(got.toPandas()) == rows(want)


def filled(sizes, weights=(5, 2, 1), share=Fraction(3, 2), epochs=2):
    """Targets by reclamping, exactly: what a source can't take is shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        target = {s: epochs * sizes[s] if s in full else left * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_sql(spark):
    assert same_as_sql(mixing.mix(spark.read.parquet(f"{DATA}/documents.parquet")), mixing.ORACLE, "documents")


def test_mixing_targets_and_samples(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60))), rng.choice(["hot"] * 6 + [None, "", "a", "é", "z", "\U0001f600", "￿"]), 7) for i in range(900)]
    rows += [(None, None, "a", 1), (None, "x y", None, 1), (3, "", "z", 1), (901, None, "silent", 1), (902, "one " * 3_000, "long", 1), (903, "q r", "one", 1)] + [(904, "copy of it", "copies", 1)] * 40
    schema = "doc_id long, text string, source string, target int"
    out = [sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, schema).repartition(n)).collect()), key=str) for n in (1, 5)]
    assert out[0] == out[1] and len(out[0]) == len(rows)
    sizes, taken, told = Counter(), Counter(), {}
    for doc, size, source_size, target, took, source in out[0]:
        sizes[source] += size
        taken[source] += took
        told[source] = (source_size, target)
        assert 0 <= took <= 2 * size
    want = filled(sizes)
    for s in sizes:
        assert told[s][0] == sizes[s] and abs(told[s][1] - float(want[s])) < 1e-6 * max(1, told[s][1])
        assert abs(taken[s] - told[s][1]) <= (0.5 if s != "copies" else 40)
    assert abs(sum(map(float, want.values())) - 1.5 * sum(sizes.values())) < 1e-6
    # a document is taken whole times, or one time more, but for those where an order stops
    parts = Counter(s for _, size, source_size, target, took, s in out[0] if size and took % size)
    assert all(n <= 1 for s, n in parts.items() if s != "copies")
    other = mixing.mix(spark.createDataFrame(rows, schema), seed=12).collect()
    assert sorted(map(tuple, other), key=str) != out[0]


@pytest.mark.parametrize("share, epochs", [(5.0, 2.0), (0.5, 1.0), (2.5, 3.0)])
def test_mixing_shares(spark, share, epochs):
    rows = [(i, "w " * (i % 7), f"s{i % 5}") for i in range(200)]
    x = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=share, epochs=epochs).collect()
    sizes = Counter()
    for r in x:
        sizes[r.source] += r["size"]
    want = filled(sizes, share=Fraction(share), epochs=int(epochs)) if share < epochs else {s: epochs * n for s, n in sizes.items()}
    assert all(abs(r.target - float(want[r.source])) < 1e-6 and r.taken <= epochs * r["size"] for r in x)
    assert all(abs(sum(r.taken for r in x if r.source == s) - float(t)) <= 0.5 for s, t in want.items())


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert [tuple(r)[1:5] for r in mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()] == [(0, 0, 0.0, 0)] * 2


def mined(rows):
    """All pairs, in Python's integers."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        kept[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(c * 256)) for c in v)] = True
    out = []
    for i, label, v in kept:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i)
        for s, j, m in [x for x in scored if x[2] == label][:5]:
            fits = [(t, n) for t, n, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits[:3])]
    return sorted(out)


def test_negatives_sql(spark):
    got = negatives.mine(spark.read.parquet(f"{DATA}/embeddings.parquet"))
    assert same_as_sql(got.drop("rows_met"), negatives.ORACLE, "embeddings")


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(3)), (rng.integers(-3, 4, 6) / 8).tolist()) for i in range(300)]  # many ties
    rows += [(350, 1, None), (400, None, [1.0]), (450, 1, [float("nan")] * 6), (500, 1, [0.5, None]), (None, 1, [1.0] * 6), (550, 1, [0.0] * 6), (600, 2, []), (650, 0, [0.25, -0.5]), (700, 1, [0.5] * 8)]
    rows += [(301, 1, [0.25] * 6)] * 3 + [(100, 2, [0.5, 0.25, 0.5, 0.5, 0.5, 0.5])]  # a repeat, and a second row of one vec_id
    x = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, rank int").repartition(3)
    got = sorted(tuple(r)[:6] for r in negatives.mine(x).collect())
    assert got == mined(rows) and len({g[0] for g in got}) > 5
    assert negatives.mine(x.limit(0)).collect() == []
    assert negatives.mine(x.where("vec_id % 50 <> 0")).collect() == []


def test_negatives_large_numbers(spark):
    rows = [(i, i % 2, [2.0**e * (1 + i % 5), 1.0 + i]) for i, e in enumerate([16, 17, 18, 15] * 30)]
    x = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r)[:6] for r in negatives.mine(x).collect()) == mined(rows)
    huge = spark.createDataFrame([(50, 0, [1e300, 1.0]), (51, 0, [1e300, 2.0]), (52, 1, [1e299, 1.0]), (53, 1, [1.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert all(abs(r.positive_score) <= negatives.LIMIT for r in negatives.mine(huge).collect())


def test_negatives_keys_leave_rows_out(spark, monkeypatch):
    """With clusters a query meets a part of the rows, in several chunks and blocks; without the bounds it meets all, and the result is the same."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 12)) * 3
    rows = [(i, int(rng.integers(4)), (centres[i % 16] + rng.normal(size=12) * 0.05).tolist()) for i in range(1600)]
    x = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(negatives, "CELL", 25)
    monkeypatch.setattr(negatives.search, "__defaults__", (16, 40))
    got = negatives.mine(x).collect()
    assert sorted(tuple(r)[:6] for r in got) == mined(rows)
    assert np.mean([r.rows_met for r in got]) < 0.6 * len(rows)
    stored, index = negatives.build(negatives.usable(x))
    assert index.n.sum() == len(rows) and len(index.n) > 16
    held = stored.select("cell", "dist").toPandas().groupby("cell")["dist"]
    assert (held.min().loc[index.cell].to_numpy() == index.low).all() and (held.max().loc[index.cell].to_numpy() == index.high).all()


def plain(text, tokenizers):
    """Ids by both, groups as text and links, token by token."""
    if not text:
        return [], [], "", []
    a_model, b_model, signs = tokenizers
    a, b, raw = a_model.encode(" " + text, add_special_tokens=False), b_model.encode(text), (" " + text).encode()
    a_bytes = [bytes(signs[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], "", []
    place = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
    at_a, at_b = place(a_bytes), place(b_bytes)
    groups, own, other = [], [], []
    ends = {e for _, e in at_b}
    j = 0
    for i, (_, e) in enumerate(at_a):
        own.append(a.ids[i])
        if e in ends:
            while j < len(b) and at_b[j][1] <= e:
                other.append(b[j])
                j += 1
            groups.append(",".join(map(str, own)) + "|" + ",".join(map(str, other)))
            own, other = [], []
    links = [(a.ids[i], b[k]) for i, (s, e) in enumerate(at_a) for k, (t, f) in enumerate(at_b) if s < f and t < e]
    return a.ids, b, ";".join(groups), links


def test_alignment_against_plain(spark, monkeypatch):
    a = Tokenizer.from_file(public_tokenizers.path(alignment.A))
    a.encode_special_tokens = True
    models = a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.B)), alignment.byte_level()
    rng = random.Random(1)
    signs = ["a", "b", " ", " ", "\n", "\t", "'s", "1", "9", ".", "é", "中", "　", "\xa0", "\U0001f600", "Z", "\x85", " ", "\r", "-", "the", " of", "▁", "\x1c", ");\r"]
    texts = [None, "", "a", "  ", "\n", "x▁y", "a  b \t c\n\n  d ", "<|endoftext|> </s> <s> <unk>", "don't  stop　now", "▁", "A" * 300 + " " + "b " * 50, "\x00 y", "� z", "café naïve ﬁ"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(None, "the cat sat"), (2, "the cat sat"), (2, "the cat sat")]
    rows += [(r[0], r[1]) for r in duckdb.sql(f"SELECT doc_id + 1000, text FROM '{DATA}/documents.parquet' WHERE length(text) < 2000 LIMIT 60").fetchall()]
    want, n = [plain(t, models) for _, t in rows], Counter()
    for w in want:
        n.update(set(w[3]))
    best = {}
    for (p, _), c in n.items():
        best[p] = max(best.get(p, 0), c)
    told = Counter((i, len(w[0]), len(w[1]), w[2].count("|"), len(w[3]), sum(n[l] == best[l[0]] for l in w[3]), sum(n[l] for l in w[3]), hashlib.sha256(w[2].encode()).hexdigest() if w[2] else "") for (i, _), w in zip(rows, want))
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_a int")
    for hot, parts in ((alignment.HOT, 2), (300, 5)):
        monkeypatch.setattr(alignment, "HOT", hot)
        assert Counter(map(tuple, alignment.align(df.repartition(parts)).collect())) == told
    assert alignment.align(df.limit(0)).collect() == []


def test_runs_are_kept_and_forgotten(monkeypatch):
    p = alignment.Pair(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    monkeypatch.setattr(alignment, "CACHED", 5)
    texts = ["one two three", "three four five six seven", "one two", "eight nine ten eleven twelve", "three"]
    got = [alignment.summed(p.texts([t])[0])[:5] for t in texts * 3]
    fresh = alignment.Pair(public_tokenizers.path(alignment.A), public_tokenizers.path(alignment.B))
    assert got == [alignment.summed(g)[:5] for g in fresh.texts(texts)] * 3
    assert len(p.known) + len(p.older) <= 24
