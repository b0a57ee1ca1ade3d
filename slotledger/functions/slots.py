"""Sentences of an event stream to slot facts: entities in the order of the episode, attributes and values sentence by sentence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Relations, names that are known from the start, and the values that guarded attributes may take.
RELATIONS = "friend sister brother mentor coworker manager advisor teammate neighbor cousin".split()
ALIASES = {"alex": "friend_alex", "alice": "coworker_alice", "bob": "friend_bob", "lily": "sister_lily", "chen": "mentor_chen"}
COMPANIES = "google microsoft alibaba bytedance huawei tencent baidu jd netease meituan pinduoduo".split()
COMPANY_MARKERS = "work works employed switching switched joined".split()
LANGUAGES = "python java rust go typescript kotlin scala".split()
LANGUAGE_MARKERS = "code codes language switched prefer".split()
#: Attributes in the order in which they are tried, and the phrases before a value. {} is the value, which ends at a dot.
PHRASES = (
    ("location", ("(?:live|lives) in {}", "(?:is based|relocated|moved|settled) in {}", r"(?:moving|moved|relocated|settled) to (?!project\b){}")),
    ("company", ("(?:work|works) at {}", "is employed at {}", "(?:switching|switched) to {}", "joined {}")),
    ("language", ("programming language is {}", "(?:prefer|prefers) {}", "(?:switched to|now codes in) {}")),
    ("preference", ("(?:prefer|prefers) {}", "started preferring {}", "now prefers {}")),
    ("timezone", ("timezone is {}", "uses {} time", "switched timezone to {}")),
    ("hobby", ("hobby is {}", "took up {}", "now practices {}")),
    ("instrument", ("instrument is {}", "plays {}", "switched instrument to {}")),
    ("project", ("project is {}", "works on project {}", "moved to project {}", "now works on project {}")),
    ("relation", ("(?:is|became) my {}",)),
)


SPACES = " \t\n\v\f\r"
_SEARCHES = [(name, [re.compile("(?ia)" + p.replace("{}", "([^.]+)")) for p in phrases]) for name, phrases in PHRASES]
#: Sentences that a worker remembers; logs repeat theirs.
KEPT = 1 << 14


@lru_cache(KEPT)
def slot_of(text: str, user: bool) -> tuple[str | None, str | None]:
    """Attribute and value of the first attribute that fits: of its phrases the first that the text holds gives the value.

    A company or language must be a known one, beside a word that belongs to it; the user has no relation to themselves.
    """
    text = text.strip(SPACES)
    low = text.lower()
    near = lambda words: any(w in low for w in words)
    for name, searches in _SEARCHES:
        found = next(filter(None, (s.search(text) for s in searches)), None)
        value = found[1].strip(SPACES) if found else ""
        if not value or name == "relation" and user:
            continue
        if name == "company" and not (near(COMPANY_MARKERS) and value.lower() in COMPANIES):
            continue
        if name == "language" and not (near(LANGUAGE_MARKERS) and value.lower() in LANGUAGES):
            continue
        return name, value
    return None, None


_BINDS = re.compile(rf"\bmy ({'|'.join(RELATIONS)}) ([a-z]+)\b")
_WORDS, _NAME = re.compile(r"\w+"), re.compile("[a-z]+")


@lru_cache(KEPT)
def named(text: str) -> tuple[str | None, str | None, tuple[str, ...]]:
    """The entity that a sentence tells by itself, the name that it binds to it, and else the words that may be names."""
    low = text.lower()
    if m := _BINDS.search(low):
        return f"{m[1]}_{m[2]}", m[2], ()
    if "my mother" in low or "user's mother" in low:
        return "mother", None, ()
    return None, None, tuple(w for w in dict.fromkeys(_WORDS.findall(low)) if _NAME.fullmatch(w))


#: Since when a name is known, and whom it means, as an episode begins.
_KNOWN = {name: (i - len(ALIASES), entity) for i, (name, entity) in enumerate(ALIASES.items())}


@F.arrow_udf(T.StructType().add("entity", T.StringType()).add("attribute", T.StringType()).add("value", T.StringType()))
def facts_told(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What each sentence of a partition is about, and its slot; episodes come one after another, in order, and hold but the names bound so far."""
    known = dict(_KNOWN)
    for texts, begins in batches:
        entities, found = [], []
        for text, first in zip(texts.to_numpy(zero_copy_only=False).tolist(), begins.to_numpy(zero_copy_only=False).tolist()):  # many times as fast as to_pylist
            if first:
                known = dict(_KNOWN)
            entity, name, words = named(text) if text is not None else (None, None, ())
            if name:
                known[name] = (known[name][0] if name in known else len(known), entity)
            elif not entity:
                entity = min((known[w] for w in words if w in known), default=(0, "user"))[1]
            entities.append(entity)
            found.append(slot_of(text, entity == "user") if text is not None else (None, None))
        parts = [pa.array(entities, pa.string()), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))]
        yield pa.StructArray.from_arrays(parts, ["entity", "attribute", "value"])


#: What a row gives depends on those before it, so no filter may go below it.
facts_told = facts_told.asNondeterministic()


def _told(events: DataFrame, order: tuple[str, ...] = ("event_idx",)) -> DataFrame:
    """``events`` with ``facts_told``; the window deals and sorts them by episode."""
    begins = F.row_number().over(Window.partitionBy("episode_id").orderBy(*order)) == 1
    return events.withColumn("_begins", begins).select(*events.columns, facts_told("text", "_begins").alias("_told"))


def resolve(events: DataFrame) -> DataFrame:
    """``events`` (episode_id, event_idx, text) with the entity that each sentence is about.

    ``my <relation> <name>`` binds the name from that event on. Else a mother is ``mother``; else the sentence is about the known name
    in it that has been known longest, by its latest binding; else about the user.
    """
    return _told(events).select(*events.columns, F.col("_told.entity").alias("entity"))


def parse(events: DataFrame, order: tuple[str, ...] = ("event_idx",)) -> DataFrame:
    """episode_id, event_idx, text with entity, attribute, value; null where a sentence holds no fact.

    ``order`` names the columns that ``event_idx`` counts, where the rows are sorted by them already.
    """
    x = _told(events, order)
    has = F.col("_told.attribute").isNotNull()
    return x.select("episode_id", "event_idx", "text", F.when(has, F.col("_told.entity")).alias("entity"), F.col("_told.attribute").alias("attribute"), F.col("_told.value").alias("value"))
