"""Write policies over streams, with keyed state that survives a restart: the batch policies' results, trigger by trigger.

The rows of a key that a trigger brings are sorted by ``event_idx`` before they are applied, so results equal the batch's
where every trigger's events come after those of the triggers before it. A row that was applied already (its index is not
above the key's last) is ignored, so a source that sends rows again does no harm. Run with output mode update or append, and with a state store for
keyed processors (``ROCKS``). Each trigger gives the entries it changed, as they are after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from slotledger.operators.folds import Vectors, upsert

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SLOTS = "episode_id long, entity string, attribute string, value string, created_idx long, updated_idx long, n_writes long"
STORE = "episode_id long, entry long, n_writes long, last_event_idx long"


def in_order(batches: Iterator[pd.DataFrame], last: int) -> pd.DataFrame:
    """A trigger's rows of a key that are new, in order."""
    x = pd.concat(list(batches), ignore_index=True)
    return x[x["event_idx"] > last].sort_values("event_idx", kind="stable").drop_duplicates("event_idx")


class SlotUpsert(StatefulProcessor):
    """A key is a slot; its state is value, first and last index, and number of writes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slot = handle.getValueState("slot", "value string, created_idx long, updated_idx long, n_writes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, created, updated, n = self.slot.get() or (None, None, -1, 0)
        new = in_order(rows, updated)
        if len(new):
            value, created = new["value"].iloc[-1], int(new["event_idx"].iloc[0]) if created is None else created
            updated, n = int(new["event_idx"].iloc[-1]), n + len(new)
            self.slot.update((value, created, updated, n))
            yield pd.DataFrame([(*key, value, created, updated, n)], columns=[c.split()[0] for c in SLOTS.split(", ")])

    def close(self) -> None:
        pass


class SimilarityUpsert(StatefulProcessor):
    """A key is an episode; its state holds each entry's vector, writes and last index."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry long", "vector array<double>, n_writes long, last_event_idx long")
        self.last = handle.getValueState("last", "event_idx long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = in_order(rows, self.last.get()[0] if self.last.exists() else -1)
        store, writes, last, changed = Vectors(), [], [], set()
        for _, (v, n, at) in sorted((k[0], e) for k, e in self.entries.iterator()):
            store.add(np.array(v))
            writes.append(n)
            last.append(at)
        for i, v in zip(new["event_idx"].tolist(), new["vector"]):
            changed.add(upsert(store, writes, last, self.threshold, i, v))
        for e in changed:
            self.entries.updateValue((e,), (store.room[e].tolist(), writes[e], last[e]))
        if changed:
            self.last.update((int(new["event_idx"].iloc[-1]),))
            yield pd.DataFrame([(key[0], e, writes[e], last[e]) for e in sorted(changed)], columns=[c.split()[0] for c in STORE.split(", ")])

    def close(self) -> None:
        pass


def slot_upserts(facts: DataFrame) -> DataFrame:
    """Changed slots of a stream of facts (episode_id, event_idx, entity, attribute, value); facts without a slot have no key here."""
    x = facts.where(F.col("entity").isNotNull()).select("episode_id", "entity", "attribute", "event_idx", "value")
    return x.groupBy("episode_id", "entity", "attribute").transformWithStateInPandas(SlotUpsert(), SLOTS, "Update", "None")


def similarity_upserts(vectors: DataFrame, threshold: float) -> DataFrame:
    """Changed entries of a stream of (episode_id, event_idx, vector)."""
    x = vectors.select("episode_id", "event_idx", "vector")
    return x.groupBy("episode_id").transformWithStateInPandas(SimilarityUpsert(threshold), STORE, "Update", "None")
