"""Policies whose next step depends on the store so far, folded in order within a key.

Rows are dealt by key and sorted; a task reads them as a stream and holds one key's store,
never the key's rows, so a hot key costs time but no memory beyond its store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Substrings that mark a sentence as holding a fact.
FACTUAL = "is was are were has have had lives works moved started stopped prefers likes dislikes wants needs bought sold married born died favorite allergic speaks studies".split()
SHARED_WORDS, CAPACITY = 3, 200
ROWS_OUT = 10_000


def ordered_fold(rows: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` takes the rows of a key (tuples, in order) and gives result rows without the key, which comes first in ``schema``.

    Rows with a null key take no part; ties in ``order`` must be broken by it.
    """

    def run(batches):
        stream = chain.from_iterable(b.itertuples(index=False, name=None) for b in batches)
        out: list[tuple] = []
        for k, own in groupby(stream, key=lambda r: r[at]):
            for row in fold(own):
                out.append((k, *row))
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    at, names = rows.columns.index(key), [c.split()[0] for c in schema.split(", ")]
    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Vectors:
    """A growing matrix of vectors."""

    def __init__(self):
        self.n, self.room = 0, None

    def add(self, v: np.ndarray) -> None:
        if self.room is None:
            self.room = np.zeros((16, len(v)))
        elif self.n == len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n] = v
        self.n += 1

    def drop(self, i: int) -> None:
        self.room[i : self.n - 1] = self.room[i + 1 : self.n]
        self.n -= 1

    def scores(self, v: np.ndarray) -> np.ndarray:
        return self.room[: self.n] @ v if self.n else np.zeros(0)


def similarity_upsert(vectors: DataFrame, threshold: float) -> DataFrame:
    """(episode_id, event_idx, vector): the nearest entry is overwritten at ``threshold`` or more, else one is added."""

    def fold(rows):
        store, writes, last = Vectors(), [], []
        for _, i, v in rows:
            upsert(store, writes, last, threshold, i, v)
        yield from zip(range(store.n), writes, last)

    x = vectors.select("episode_id", "event_idx", "vector")
    return ordered_fold(x, "episode_id", ["event_idx"], fold, "episode_id long, entry long, n_writes long, last_event_idx long")


def similarity_sweep(vectors: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``similarity_upsert`` for each threshold, over one shuffle and one sort: every row goes to a store of each."""

    def fold(rows):
        stores = [(t, Vectors(), [], []) for t in thresholds]
        for _, i, v in rows:
            for t, store, writes, last in stores:
                upsert(store, writes, last, t, i, v)
        for t, store, writes, last in stores:
            yield from ((t, n, writes[n], last[n]) for n in range(store.n))

    x = vectors.select("episode_id", "event_idx", "vector")
    return ordered_fold(x, "episode_id", ["event_idx"], fold, "episode_id long, threshold double, entry long, n_writes long, last_event_idx long")


def upsert(store: Vectors, writes: list, last: list, threshold: float, i: int, v) -> int:
    """One step of the similarity upsert; the place that was written."""
    near = store.scores(v)
    at = int(near.argmax()) if len(near) else -1
    if at >= 0 and near[at] >= threshold:
        store.room[at] = v
        writes[at] += 1
        last[at] = i
        return at
    store.add(v)
    writes.append(1)
    last.append(i)
    return store.n - 1


def keyword_upsert(texts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, idx, text): a text with over three words in common with another entry overwrites the first such; else a factual one is added, and beyond ``capacity`` the oldest goes.

    A null text is empty, which holds no fact.
    """

    def fold(rows):
        store: list[list] = []
        for _, i, t in rows:
            low = (t or "").lower()
            own = set(low.split())
            hit = next((e for e in store if len(e[1] & own) > SHARED_WORDS and e[0] != low), None)
            if hit is not None:
                hit[:] = [low, own, i, hit[3] + 1]
            elif any(f in low for f in FACTUAL):
                store.append([low, own, i, 1])
                del store[: max(len(store) - capacity, 0)]
        yield from ((n, e[2], e[3]) for n, e in enumerate(store))

    return ordered_fold(texts.select("key", "idx", "text"), "key", ["idx", "text"], fold, "key long, entry long, last_idx long, n_writes long")


def bounded_store(vectors: DataFrame, capacity: int, least: float = 0.7, nearest: int = 3, grace: float = 60.0) -> DataFrame:
    """(episode_id, event_idx, at, confidence, vector): every row is added and linked, and beyond ``capacity`` one entry goes.

    A new entry is linked with those of its ``nearest`` in the index, itself among them, that score over ``least``.
    The entry of least confidence goes (ties: the first added), of those older than ``grace`` seconds if there are any.
    The rows are the entries that stay, with the number of their links to others that stay.
    """

    def fold(rows):
        index, ids, born, sure = Vectors(), [], [], []
        links: dict[int, set[int]] = {}
        for _, i, now, confidence, v in rows:
            index.add(v)
            score = index.scores(v)
            best = np.argsort(-score, kind="stable")[:nearest]
            near = [ids[j] for j in best.tolist() if j < len(ids) and score[j] > least]
            links[i] = set(near)
            for other in near:
                links[other].add(i)
            ids.append(i)
            born.append(now)
            sure.append(confidence)
            if len(ids) > capacity:
                old = [j for j in range(len(ids)) if now - born[j] > grace] or range(len(ids))
                gone = min(old, key=lambda j: sure[j])
                for other in links.pop(ids[gone]):
                    links[other].discard(ids[gone])
                index.drop(gone)
                for kept in (ids, born, sure):
                    del kept[gone]
        yield from ((i, len(links[i])) for i in ids)

    x = vectors.select("episode_id", "event_idx", F.col("at").cast("double"), F.col("confidence").cast("double"), "vector")
    return ordered_fold(x, "episode_id", ["event_idx"], fold, "episode_id long, event_idx long, n_links long")
