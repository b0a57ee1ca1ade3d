"""Language-model scores: a gated recurrent unit in numpy with class-factored output.

Token counts come from every training document (the checksum of its doc_id leaves a
remainder other than 0), by partial sums before the shuffle. The ``WORDS`` most frequent tokens
are the network's words, in classes of equal size by frequency; all others are one more word,
unknown, whose mass is shared among them as their smoothed counts are, so the score is
a proper probability of the whole text. Output biases start at the corpus's log
frequencies.

The weights are learned from every training document, whole: documents are dealt by a hash of
doc_id and text into rounds of ``SHARES``, and in a round into lanes of about ``LANE`` tokens (longer ones where
that would make more than ``LANES``). A lane is a task's work: in the order of the hash, from the round's common weights, it runs truncated
backpropagation over all its documents and gives its weights, whose mean by tokens
(taken in two steps, so that no group holds more than ``FAN`` rows or one row for each of them) is the next
round's start. Rounds, lanes and their order depend on the rows alone, so scores are the same under any
partitioning, but for the rounding of sums. Documents are scored whole, window by window, with the state carried over.

Tokens that make up at least 1 / ``COMMON`` of all tokens, of which there are at most
``COMMON``, are looked up from a broadcast; the others are summed per document and joined
with the counts.

Defined results: a null or empty text is the end token alone; a text of any length is one
sequence, learned and scored whole (a task's memory grows with its ids, two bytes a token); repeated rows are
scored each for itself; without training documents the counts are zero and every token is
unknown; an empty table gives no rows; a null doc_id counts as not held out; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm.common import cut, slices

END = b""
WORDS, HIDDEN = 1023, 16
COMMON = 200_000
FLUSH = 300_000
#: Of 16 parts of the training documents, by hash, those of each round; every document is in one.
SHARES = (1, 2, 4, 9)
STREAMS, WINDOW = 256, 16
RATE, CLIP = 0.02, 5.0
TALL = 60.0  # logits start as logarithms of shares, so that none of a class is far below zero; this keeps exp finite above
WIDE, STRIDE, SLAB = 1024, 16, 1 << 14
LANE, LANES = 1 << 20, 20_000
HELD = 1 << 22  # ids that a task holds before it learns from them or scores them
BLOCK, FAN = 1024, 64


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def counts(docs: DataFrame) -> DataFrame:
    """token (binary), c: over the training documents."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(tokens(t))
                if len(seen) > FLUSH:
                    yield pd.DataFrame({"token": list(seen), "c": list(seen.values())})
                    seen.clear()
        yield pd.DataFrame({"token": list(seen), "c": list(seen.values())})

    got = docs.where(~held_out()).select("text").mapInPandas(run, "token binary, c long")
    return got.groupBy("token").agg(F.sum("c").alias("c"))


class Network:
    """Gated recurrent unit over word ids; probabilities factored into class and word within it."""

    def __init__(self, mass: np.ndarray, hidden: int = HIDDEN):
        k = len(mass)
        self.width = w = int(np.ceil(np.sqrt(k)))
        self.n = n = -(-k // w)
        full = np.zeros(n * w)
        full[:k] = np.maximum(mass, 1e-12)
        grid = full.reshape(n, w)
        by_class = grid.sum(1)
        with np.errstate(divide="ignore"):
            inner = np.where(grid > 0, np.log(grid / by_class[:, None]), -1e9)
        rng = np.random.default_rng(11)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.p = {"g": f(k, 3 * hidden), "u": f(hidden, 3 * hidden), "wc": f(hidden, n) * 0, "bc": np.log(by_class / by_class.sum()).astype(np.float32), "wo": np.zeros((n, hidden, w), np.float32), "bo": inner.astype(np.float32)}
        self.hidden = hidden

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.__dict__ |= self.__dict__ | {"p": {k: v.copy() for k, v in self.p.items()}}
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def set(self, flat: np.ndarray) -> None:
        at = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(flat, at))}

    def step(self, ids: np.ndarray, h: np.ndarray) -> tuple:
        m = self.hidden
        g, a = self.p["g"][ids], h @ self.p["u"]
        zr = 0.5 + 0.5 * np.tanh(0.5 * (g[:, : 2 * m] + a[:, : 2 * m]))
        z, r = zr[:, :m], zr[:, m:]
        n = np.tanh(g[:, 2 * m :] + r * a[:, 2 * m :])
        return n + z * (h - n), z, r, n, a[:, 2 * m :]

    def log_probs(self, h: np.ndarray, ids: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each id after its state; with ``grads``, also the losses' gradient for the states."""
        p, cls, at = self.p, ids // self.width, ids % self.width
        rows = np.arange(len(ids))
        ones, ones_rows = np.ones(max(self.n, self.width), np.float32), np.ones(len(ids), np.float32)
        x = h @ p["wc"]
        out, total = self.soft(x, p["bc"], rows, cls, ones)
        back = None
        if grads is not None:
            x /= total[:, None]
            x[rows, cls] -= 1
            grads["wc"] += h.T @ x
            grads["bc"] += ones_rows @ x
            back = x @ p["wc"].T
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.n + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = order[edges[k] : edges[k + 1]]
            states, i, j = h[own], rows[: len(own)], at[own]
            x = states @ p["wo"][k]
            got, total = self.soft(x, p["bo"][k], i, j, ones)
            out[own] += got
            if grads is not None:
                x /= total[:, None]
                x[i, j] -= 1
                grads["wo"][k] += states.T @ x
                grads["bo"][k] += ones_rows[: len(own)] @ x
                back[own] += x @ p["wo"][k].T
        return out, back

    @staticmethod
    def soft(x: np.ndarray, bias: np.ndarray, i: np.ndarray, j: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of column ``j`` of row ``i`` and the sum of exponentials of each row; ``x`` becomes its exponentials."""
        x += bias
        np.minimum(x, TALL, out=x)
        own = x[i, j]
        np.exp(x, out=x)
        total = x @ ones[: x.shape[1]]
        return own - np.log(total), total

    def learn(self, line: np.ndarray, last: np.ndarray, state: dict, rate: float = RATE, streams: int = STREAMS) -> float:
        """Adam over windows of parallel streams of ``line``; returns the mean loss. The state starts anew after a ``last`` id.

        ``state`` is kept between calls, empty at first.
        """
        n = len(line)
        streams = max(1, min(streams, n // WINDOW))
        width = -(-n // streams)
        fill = lambda v: np.concatenate([v, np.zeros(streams * width - n, v.dtype)]).reshape(streams, width)
        grid, keep, there = fill(line.astype(np.int64)), fill(1 - last.astype(np.float32))[:, :, None], fill(np.ones(n, bool))
        if not state:
            state |= {"t": 0, "m": {k: np.zeros_like(v) for k, v in self.p.items()}, "s": {k: np.zeros_like(v) for k, v in self.p.items()}}
        m, s, k3 = state["m"], state["s"], 3 * self.hidden
        h, told = np.zeros((streams, self.hidden), np.float32), 0.0
        for a in range(0, width, WINDOW):
            ids, live, valid = grid[:, a : a + WINDOW].T, keep[:, a : a + WINDOW], there[:, a : a + WINDOW].T
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            kept, before = [], np.empty((len(ids), streams, self.hidden), np.float32)
            for j in range(len(ids)):
                before[j] = h
                new, *gates = self.step(ids[j], h)
                kept.append((new, *gates))
                h = new * live[:, j]
            back = np.zeros_like(before)
            got, back[valid] = self.log_probs(before[valid], ids[valid], grads)
            told -= float(got.sum())
            dh, inner = np.zeros_like(h), np.empty((len(ids), streams, k3), np.float32)
            for j in reversed(range(len(ids))):
                prior, (_, z, r, n_, a_n) = before[j], kept[j]
                dh = dh * live[:, j]
                dn = dh * (1 - z) * (1 - n_ * n_)
                dz = dh * (prior - n_) * z * (1 - z)
                dr = dn * a_n * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], 1)
                inner[j] = np.concatenate([dz, dr, dn], 1)
                grads["u"] += prior.T @ da
                dh = dh * z + da @ self.p["u"].T + back[j]
            flat = ids.reshape(-1)
            order = np.argsort(flat.astype(np.uint16), kind="stable")
            starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
            grads["g"][flat[order[starts]]] = np.add.reduceat(inner.reshape(-1, k3)[order], starts, axis=0)
            state["t"] += 1
            t, share = state["t"], 1 / max(int(valid.sum()), 1)
            size = share * np.sqrt(sum(float(g.ravel() @ g.ravel()) for g in grads.values()))
            share *= min(1, CLIP / max(size, 1e-9))
            for k, g in grads.items():
                g *= share
                m[k] += 0.1 * (g - m[k])
                g *= g
                s[k] += 0.01 * (g - s[k])
                down = s[k] / (1 - 0.99**t)
                np.sqrt(down, out=down)
                down += 1e-6
                np.divide(m[k], down, out=down)
                down *= rate / (1 - 0.9**t)
                self.p[k] -= down
        return told / max(n, 1)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each sequence of ids; sequences follow one another in streams, each from a fresh state."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return np.zeros(len(texts))
        streams = int(min(WIDE, len(texts)))
        free, place = [(0, k) for k in range(streams)], [(0, 0)] * len(texts)
        for i in np.argsort(-sizes, kind="stable").tolist():  # the longest first, each where least is yet
            n, k = free[0]
            place[i] = (k, n)
            heapq.heapreplace(free, (n + int(sizes[i]), k))
        ends = np.zeros(streams, np.int64)
        for n, k in free:
            ends[k] = n
        rank = np.empty(streams, np.int64)
        rank[np.argsort(-ends, kind="stable")] = np.arange(streams)
        ends, place = -np.sort(-ends), [(int(rank[k]), n) for k, n in place]  # streams that go on longest come first
        base = np.cumsum(ends) - ends
        line, keep, out = np.empty(int(sizes.sum()), np.int32), np.ones(int(sizes.sum()), np.float32), np.zeros(int(sizes.sum()))
        begins = [int(base[k]) + n for k, n in place]
        for n, t in zip(begins, texts):
            if len(t):
                line[n : n + len(t)], keep[n] = t, 0
        h, a = np.zeros((streams, self.hidden), np.float32), 0
        while a < ends[0]:
            live = int(np.searchsorted(-ends, -a))  # streams with an id at ``a``
            steps = int(min(ends[0] - a, max(STRIDE, SLAB // live)))
            there, states = np.arange(a, a + steps) < ends[:live, None], np.empty((steps, live, self.hidden), np.float32)
            at = np.where(there, base[:live, None] + np.arange(a, a + steps), 0).T
            ids, fresh = line[at], keep[at][:, :, None]
            h = h[:live]
            for j in range(steps):
                states[j] = h * fresh[j]
                h = self.step(ids[j], states[j])[0]
            valid = there.T
            out[at[valid]], _ = self.log_probs(states[valid], ids[valid])
            a += steps
        return np.array([out[n : n + m].sum() for n, m in zip(begins, sizes.tolist())])


def held(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Runs of rows with about ``HELD`` ids, and the ids of each row."""
    rows, n = [], 0
    for b in batches:
        for a in range(0, len(b), 500):
            own = b.iloc[a : a + 500]
            rows.append(own)
            n += sum(map(len, own["ids"])) // 2
            if n >= HELD:
                got = pd.concat(rows)
                yield got, [np.frombuffer(x, "<u2") for x in got["ids"]]
                rows, n = [], 0
    if rows:
        got = pd.concat(rows)
        yield got, [np.frombuffer(x, "<u2") for x in got["ids"]]


def fit(docs: DataFrame, net: Network, total: int, shares=SHARES, rate: float = RATE) -> None:
    """Learn ``net`` from all of ``docs`` (key, ids), which hold ``total`` ids, in rounds."""
    first, part = 0, F.pmod("key", F.lit(sum(shares)))
    for share in shares:
        lanes = min(LANES, max(1, round(total * share / sum(shares) / LANE)))
        lane = F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("int")
        own = docs.where((part >= first) & (part < first + share)).select(lane.alias("lane"), "key", "ids")
        _round(own.repartitionById(lanes, "lane").sortWithinPartitions("lane", "key", "ids"), net, rate)
        first += share


def _round(docs: DataFrame, net: Network, rate: float) -> None:
    """Set ``net``'s weights to the mean of those that the lanes learn; a partition of ``docs`` (lane, ids) is one lane."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches):
        own, state, n, texts, size = shared.value.copy(), {}, 0, [], 0

        def learn():
            line, last = np.concatenate(texts), np.zeros(size, bool)
            last[np.cumsum([len(t) for t in texts]) - 1] = True
            own.learn(line, last, state, rate)

        for b in batches:
            for lane, x in zip(b["lane"], b["ids"]):
                texts.append(np.frombuffer(x, "<u2"))
                size += len(texts[-1])
                n += len(texts[-1])
                if size >= HELD:
                    learn()
                    texts, size = [], 0
        if size:
            learn()
        if n:
            flat = own.flat()
            blocks = [flat[a : a + BLOCK].tobytes() for a in range(0, len(flat), BLOCK)]
            yield pd.DataFrame({"fan": lane // FAN, "lane": lane, "block": range(len(blocks)), "n": n, "v": blocks})

    def mean(key, x):
        x = x.sort_values("lane")
        n = x["n"].to_numpy()
        v = np.stack([np.frombuffer(b, np.float32) for b in x["v"]]).astype(np.float64)
        return pd.DataFrame({"fan": [0], "lane": [key[0]], "block": [key[-1]], "n": [n.sum()], "v": [(n @ v / n.sum()).astype(np.float32).tobytes()]})

    schema = "fan long, lane long, block long, n long, v binary"
    got = docs.select("lane", "ids").mapInPandas(run, schema).groupBy("fan", "block").applyInPandas(mean, schema)
    got = got.groupBy("block").applyInPandas(mean, schema).select("block", "v").collect()  # the network's weights
    if got:
        net.set(np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(got, key=lambda r: r["block"])]))
    shared.unpersist()


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = cut(counts(docs))
    total, kinds = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = total + 0.1 * (kinds + 1)
    common = {bytes(t): c for t, c in table.where(F.col("c") * COMMON >= total).collect()}  # at most COMMON rows
    names = sorted(common, key=lambda w: (-common[w], w))
    names = ([END] if END in common else []) + [w for w in names if w != END][: WORDS - 1]
    rest = (size - sum(common[w] + 0.1 for w in names)) / size
    words = {w: i for i, w in enumerate(sorted(names, key=lambda w: (-common[w], w)))}
    net = Network(np.array([(common[w] + 0.1) / size for w in words] + [rest]))
    place = {w: i for i, w in enumerate(common)}
    logs = np.array([*(float(np.log10((c + 0.1) / size)) for c in common.values()), 0.0])  # the last is any other token's
    word_ids = np.array([*(words.get(w, len(words)) for w in common), len(words)], "<u2")
    shared = spark.sparkContext.broadcast((place, logs, word_ids))  # bounded by COMMON

    def run(batches):
        place, logs, word_ids = shared.value
        unknown = word_ids[-1]
        for b in slices(batches):
            rows = []
            for rid, key, doc_id, held_out, text in zip(b["rid"], b["key"], b["doc_id"], b["held_out"], b["text"]):
                own = tokens(text)
                at = np.fromiter(map(place.get, own, repeat(-1)), np.int32, len(own))
                ids, log = word_ids[at], logs[at]
                rare = Counter(own[i] for i in np.flatnonzero(at < 0).tolist())
                other = ids == unknown
                rows.append((rid, key, doc_id, held_out, len(own), len(own) - sum(rare.values()), log.sum(), log[other].sum() - other.sum() * np.log10(rest), ids.tobytes(), list(rare), list(rare.values())))
            yield pd.DataFrame(rows, columns=["rid", "key", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "ids", "rare", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", "text").alias("key"), "doc_id", held_out().alias("held_out"), "text")
    schema = f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    first = cut(marked.mapInPandas(run, f"key long, {schema}, ids binary, rare array<binary>, times array<long>"))
    fit(first.where(~F.col("held_out")), net, total=total)
    learned = spark.sparkContext.broadcast(net)  # of fixed size

    def add(batches):
        for b, texts in held(batches):
            yield b.assign(score=b["score"] + learned.value.score(texts) / np.log(10)).drop(columns="ids")

    whole = first.drop("key", "rare", "times").mapInPandas(add, schema)
    rare = first.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("token"), F.col("x.times").alias("k"))
    met = rare.join(table.where(F.col("c") * COMMON < total), "token", "left")
    log = F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(size))
    part = met.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_known"), F.sum(log).alias("base"), F.sum(log).alias("score"))
    both = whole.unionByName(part, allowMissingColumns=True)
    one = [F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")]
    sums = both.groupBy("rid").agg(*one, *[F.sum(c).alias(c) for c in ("n_known", "base", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
