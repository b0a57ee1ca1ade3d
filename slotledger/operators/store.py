"""A store whose entries change in order: adds, updates in place, deletes, and the targets they resolve to.

Requests: episode_id, event_idx, operation (ADD, UPDATE, DELETE or NOOP), requested (its name before parsing), target_id
(text), entity and attribute (null without a slot), reward, vector (null where nothing semantic is asked).
An episode's requests are folded in order as a stream; a task holds one episode's store, never its requests.
An entry is named by the event_idx that added it.

Exploring draws are columns made from a hash of seed, episode, event and draw, so that they are the same
under retries and any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.operators.folds import Vectors, ordered_fold

#: Chances of the operations that an exploring step draws, a score over which entries are linked, and with how many at most.
CHANCES = (("ADD", 0.35), ("UPDATE", 0.30), ("DELETE", 0.15), ("NOOP", 0.20))
LINK_OVER, NEAREST = 0.7, 3
SEED, EPSILON = 17, 0.1
REQUEST = ["episode_id", "event_idx", "operation", "requested", "target_id", "entity", "attribute", "reward", "vector", "explore", "pick", "aim"]


@dataclass
class Entry:
    id: int
    slot: tuple | None
    at: int  # the event of its slot's last value
    last: int
    reward: float
    writes: int = 1
    links: set[int] = field(default_factory=set)


class Store:
    """Entries in the order they came; ``index`` has their vectors in the same order."""

    def __init__(self):
        self.entries: dict[int, Entry] = {}
        self.index, self.order = Vectors(), []

    def add(self, i: int, slot, reward: float, v) -> int:
        e = Entry(i, slot, i, i, reward)
        if v is not None:
            self.index.add(v)
            score = self.index.scores(v)
            self.order.append(i)
            for j in np.argsort(-score, kind="stable")[:NEAREST].tolist():  # the new entry is among them, and takes a place
                if self.order[j] != i and score[j] > LINK_OVER:
                    e.links.add(self.order[j])
                    self.entries[self.order[j]].links.add(i)
        self.entries[i] = e
        return i

    def update(self, target: int, i: int, slot, reward: float, v) -> None:
        e = self.entries[target]
        e.last, e.reward, e.writes = i, max(e.reward, reward), e.writes + 1
        if slot is not None:
            e.slot, e.at = slot, i
        if v is not None:
            if target in self.order:
                self.index.room[self.order.index(target)] = v
            else:
                self.index.add(v)
                self.order.append(target)

    def delete(self, target: int) -> None:
        for other in self.entries.pop(target).links:
            self.entries[other].links.discard(target)
        if target in self.order:
            at = self.order.index(target)
            self.index.drop(at)
            del self.order[at]

    def newest(self, slot) -> int | None:
        """The entry of the slot whose value is the newest."""
        own = [e for e in self.entries.values() if slot is not None and e.slot == slot]
        return max(own, key=lambda e: (e.at, e.last, e.id)).id if own else None

    def nearest(self, v) -> int | None:
        if v is None or not self.order:
            return None
        return self.order[int(self.index.scores(v).argmax())]

    def resolve(self, target: str, slot, v) -> tuple[int | None, str]:
        """The entry that is meant: by its id, else the newest of its slot, else the most similar, else none."""
        if target and target.isdecimal() and str(int(target)) == target and int(target) in self.entries:
            return int(target), "direct_id"
        found = self.newest(slot)
        if found is not None:
            return found, "slot"
        found = self.nearest(v)
        return (found, "semantic") if found is not None else (None, "none")


def decided(store: Store, policy: str, epsilon: float, r) -> tuple[str, str, str, bool]:
    """Operation, requested name and target of a request under a policy, and whether it is forced."""
    if policy == "seed" and not store.entries:
        return "ADD", "ADD", "", True
    if policy == "explore" and r.explore < epsilon:
        ids, op, left = list(store.entries), "ADD", r.pick
        for op, chance in CHANCES if ids else ():
            left -= chance
            if left < 0:
                break
        target = str(ids[min(int(r.aim * len(ids)), len(ids) - 1)]) if op in ("UPDATE", "DELETE") else ""
        return op, op, target, True
    return r.operation, r.requested, r.target_id or "", False


def run(rows: Iterator[tuple], store: Store, policy: str, epsilon: float, semantic: bool) -> Iterator[tuple]:
    """Executes requests on ``store``: (event_idx, requested, effective, entry_id, how, success, fallback) for each.

    ``semantic``: UPDATE and DELETE always mean the most similar entry, and do nothing without one; else an UPDATE of an empty store adds.
    """
    for row in rows:
        r = _Row(*row)
        i, slot = r.event_idx, (r.entity, r.attribute) if r.entity is not None else None
        op, requested, target, _ = decided(store, policy, epsilon, r)
        entry, how, ok, asked = None, None, False, None
        if op == "ADD":
            entry, ok = store.add(i, slot, r.reward, r.vector), True
        elif op == "NOOP":
            ok = True
        elif semantic or target:
            found, how = store.resolve("" if semantic else target, None if semantic else slot, r.vector)
            if found is not None:
                entry, ok, asked = found, True, target
                if op == "UPDATE":
                    store.update(found, i, slot, r.reward, r.vector)
                else:
                    store.delete(found)
            elif op == "UPDATE" and not store.entries and not semantic:
                entry, ok, asked, op = store.add(i, None, 0.0 if r.reward is None else r.reward, r.vector), True, target, "ADD"
        yield i, requested, op, entry, how, ok, bool(asked) and str(entry) != asked


class _Row:
    __slots__ = REQUEST

    def __init__(self, *values):
        for name, v in zip(REQUEST, values):
            setattr(self, name, None if v is None or isinstance(v, float) and v != v else v)


def draw(seed: int, name: str) -> Column:
    """Of each episode and event a number in [0, 1), by a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col("episode_id").cast("string"), F.col("event_idx").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def requests(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` with defaults for columns that they lack, and the draws of exploring policies."""
    have, null = set(rows.columns), F.lit(None)
    x = rows.withColumns({c: null.cast(t) for c, t in (("target_id", "string"), ("entity", "string"), ("attribute", "string"), ("vector", "array<double>")) if c not in have})
    x = x.withColumns({"requested": F.col("requested") if "requested" in have else F.col("operation"), "reward": F.col("reward").cast("double") if "reward" in have else F.lit(0.5)})
    return x.withColumns({"explore": draw(seed, "explore"), "pick": draw(seed, "pick"), "aim": draw(seed, "aim")}).select(*REQUEST)


def executed(rows: DataFrame, policy: str = "plain", epsilon: float = EPSILON, seed: int = SEED, semantic: bool = False) -> DataFrame:
    """What became of each request. Policies: plain; seed, the first request of an empty store is an ADD; explore, some requests are drawn at random."""
    fold = lambda own: run(own, Store(), policy, epsilon, semantic)
    schema = "episode_id long, event_idx long, requested string, effective string, entry_id long, how string, success boolean, fallback boolean"
    return ordered_fold(requests(rows, seed), "episode_id", ["event_idx"], fold, schema)


def stored(rows: DataFrame, policy: str = "plain", epsilon: float = EPSILON, seed: int = SEED, semantic: bool = False) -> DataFrame:
    """The entries that are left after all requests, in their order."""

    def fold(own):
        store = Store()
        for _ in run(own, store, policy, epsilon, semantic):
            pass
        yield from ((n, e.id, e.last, e.writes, e.reward, len(e.links)) for n, e in enumerate(store.entries.values()))

    schema = "episode_id long, place long, entry_id long, last_idx long, n_writes long, reward double, n_links long"
    return ordered_fold(requests(rows, seed), "episode_id", ["event_idx"], fold, schema)


def accounted(log: DataFrame, *keys: str) -> DataFrame:
    """Counts of requested and effective operations, successes, failures and requests that met another entry than they named."""
    ops = [name for name, _ in CHANCES]
    count = lambda c, o: F.count_if(F.col(c) == o).alias(f"{c}_{o.lower()}")
    return log.groupBy(*keys).agg(*[count(c, o) for c in ("requested", "effective") for o in ops], F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"), F.count_if("fallback").alias("fallback_target"))
