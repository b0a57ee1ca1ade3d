"""Text surface of runs: prompts, gold contexts, entries as text, run names, and a deterministic encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotledger.functions.slots import parse
from slotledger.functions.text import contains_value, normalize_value, strip, words

#: The instruction of each prompt variant; any other name takes the first.
INSTRUCTIONS = {
    "default": "Answer using only the final value for the specified target slot. Do not return a sentence or explanation. Ignore facts about other entities or attributes.",
    "v1_value_only": "Return only the final value for the target slot. Do not include a sentence, label, punctuation, or explanation.",
    "v2_ignore_distractors": "Return only the final value for the target slot. Ignore all memories about other entities, other attributes, older values, and distractors. Do not include a sentence, label, punctuation, or explanation.",
}


def answer_prompt(question: Column, context: Column, entity: Column, attribute: Column, variant: str = "default") -> Column:
    parts = [F.lit(INSTRUCTIONS.get(variant, INSTRUCTIONS["default"]) + "\n\nTarget entity: "), F.coalesce(entity, F.lit("user")), F.lit("\nTarget attribute: "), F.coalesce(attribute, F.lit("unknown"))]
    return F.concat(*parts, F.lit("\n\nMemory entries:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nFinal value only:"))


def gold_context(events: Column, latest: Column, entity: Column, attribute: Column, answer: Column) -> Column:
    """The sentence of the latest update; where its place is not among the events, the slot and its value. A null place is the last."""
    at = F.coalesce(latest, F.size(events) - 1)
    slot = F.concat(F.coalesce(entity, F.lit("user")), F.lit("."), F.coalesce(attribute, F.lit("unknown")), F.lit(" = "), F.coalesce(answer, F.lit("")))
    return F.concat(F.lit("- "), F.when((at >= 0) & (at < F.size(events)), F.get(events, at.cast("int"))).otherwise(slot))


def same_slot_text(content: Column, entity: Column, attribute: Column, value: Column) -> Column:
    """Whether a text seems to state a slot's value: it names the entity's last part, the attribute and the value."""
    low = F.lower(content)
    return F.contains(low, F.lower(F.substring_index(entity, "_", -1))) & F.contains(low, F.lower(attribute)) & contains_value(content, value)


def run_name_threshold(c: Column) -> Column:
    """struct<answer_mode, threshold, k> of ``direct_t0.85_k16``; nulls where the name is another."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^(direct|prompt)_t(\d+\.\d+)_k(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("answer_mode"), part(2).cast("double").alias("threshold"), part(3).cast("int").alias("k"))


def run_name_variant(c: Column) -> Column:
    """struct<method, variant, k> of ``<method>_v<n>_<name>_k<k>``."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^(.+)_(v\d+_[a-z_]+)_k(\d+)$", i), F.lit(""))
    return F.struct(part(1).alias("method"), part(2).alias("variant"), part(3).cast("int").alias("k"))


def truth(c: Column) -> Column:
    """A number of a text: true and True are one, false, False and an empty one zero; null if it is none of these."""
    return F.when(c.isin("True", "true"), 1.0).when(c.isin("False", "false", ""), 0.0).otherwise(c.try_cast("double"))


#: What a written Python dict says otherwise than JSON, beside its quotes, which the reader allows.
LITERALS = {"None": "null", "True": "true", "False": "false"}


def flat_event(event: Column) -> Column:
    """``speaker: text`` of an event that is a dict with speaker, text and blip_caption, written as JSON or as Python does.

    Without a text it is ``speaker: [image] caption``; with neither, or where it can't be read, the event stays.
    """
    literal = event
    for name, word in LITERALS.items():
        literal = F.regexp_replace(literal, rf"(?<=[:,\[]\s?){name}(?=\s*[,}}\]])", word)

    def read(c: Column) -> Column:
        return F.from_json(c, "speaker string, text string, blip_caption string, _bad string", {"columnNameOfCorruptRecord": "_bad", "allowBackslashEscapingAnyCharacter": "true"})

    plain, loose = read(event), read(literal)
    of = lambda k: F.nullif(F.when(plain["_bad"].isNull(), plain[k]).when(loose["_bad"].isNull(), loose[k]), F.lit(""))
    body = F.coalesce(of("text"), F.concat(F.lit("[image] "), of("blip_caption")))
    told = F.when(of("speaker").isNotNull(), F.concat(of("speaker"), F.lit(": "), body)).otherwise(body)
    return F.when(event.startswith("{"), F.coalesce(told, event)).otherwise(event)


def encode(c: Column, dimension: int = 64) -> Column:
    """A unit vector from hashed words; a text without words is the zero vector.

    Stands in for a sentence encoder: deterministic, and the same on every engine that has the hash.
    """
    spots = F.transform(words(c), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimension)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    zero = F.array_repeat(F.lit(0.0), dimension)
    raw = F.aggregate(spots, zero, lambda v, x: F.transform(v, lambda y, j: y + F.when(x["i"] == j, x["s"]).otherwise(0.0)))
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, y: s + y * y))
    return F.transform(raw, lambda y: F.when(length > 0, y / length).otherwise(0.0))


def operation_text(operation: Column, target: Column, content: Column) -> Column:
    """A parsed operation as text again: ``ADD: content``, ``UPDATE target: content``, ``DELETE target``, and NOOP for any other."""
    target, content = F.coalesce(target, F.lit("")), F.coalesce(content, F.lit(""))
    written = F.when(operation == "ADD", F.concat(F.lit("ADD: "), content)).when(operation == "UPDATE", F.concat(F.lit("UPDATE "), target, F.lit(": "), content))
    return strip(written.when(operation == "DELETE", F.concat(F.lit("DELETE "), target)).otherwise("NOOP"))


def context_block(title: str, items: Column, empty: str) -> Column:
    """A titled list of lines for a prompt; without items (or where there is no array) the text ``empty``."""
    lines = F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")
    return F.concat(F.lit(f"### {title}\n"), F.when(F.coalesce(F.size(items), F.lit(0)) > 0, lines).otherwise(empty))


def most_confident(entries: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Of each key the ``n`` most confident entries (ties: by entry_id) as one text of lines."""
    best = entries.withColumn("_r", F.struct((-F.col("confidence")).alias("c"), "entry_id", "content"))
    w = F.row_number().over(_window(key))
    kept = best.withColumn("_n", w).where(F.col("_n") <= n)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: F.concat(F.lit("- "), r["content"])), "\n").alias("text"))


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("_r")


def resolve_target(targets: DataFrame, entries: DataFrame, semantic: DataFrame) -> DataFrame:
    """The entry that an action means: by its id, else the newest of its slot, else the most similar, else none.

    targets: action_id, episode_id, target_id, entity, attribute; entries: episode_id, entry_id, entity, attribute, updated_idx;
    semantic: action_id, entry_id, score.
    """
    ids = entries.select("episode_id", F.col("entry_id").alias("by_id"))
    slot = entries.where("entity is not null").groupBy("episode_id", "entity", "attribute").agg(F.max_by("entry_id", F.struct("updated_idx", "entry_id")).alias("by_slot"))
    near = semantic.groupBy("action_id").agg(F.max_by("entry_id", F.struct("score", (-F.col("entry_id")).alias("e"))).alias("by_text"))
    x = targets.join(ids, (ids["episode_id"] == targets["episode_id"]) & (F.col("by_id").cast("string") == F.col("target_id")), "left").drop(ids["episode_id"])
    x = x.join(slot, ["episode_id", "entity", "attribute"], "left").join(near, "action_id", "left")
    how = F.when(F.col("by_id").isNotNull(), "direct_id").when(F.col("by_slot").isNotNull(), "slot").when(F.col("by_text").isNotNull(), "semantic").otherwise("none")
    return x.select("action_id", F.coalesce("by_id", "by_slot", "by_text").alias("entry_id"), how.alias("how"))


#: Phrases that make a text of an attribute fresh, and their weight.
FRESH = {
    "company": (("works at", 3), ("joined", 2), ("switched to", 1)), "location": (("lives in", 3), ("relocated to", 2), ("moved to", 1)),
    "preference": (("prefers", 3), ("started preferring", 2)), "language": (("programming language is", 3), ("now codes in", 2), ("switched to", 1)),
}


def choose_prediction(texts: DataFrame) -> DataFrame:
    """Of texts found for an example (episode_id, idx, content, entity, attribute) the one that states its slot best, and its value.

    Texts rank by the same slot, then the attribute, then the entity, then freshness, then the first. A text of the attribute gives its
    parsed value, another what follows the attribute's phrase, else the whole text normalised.
    """
    alone = parse(texts.select(F.concat_ws(" ", F.col("episode_id").cast("string"), F.col("idx").cast("string")).alias("episode_id"), F.lit(0).alias("event_idx"), F.col("content").alias("text")))
    x = texts.withColumn("_key", F.concat_ws(" ", F.col("episode_id").cast("string"), F.col("idx").cast("string")))
    x = x.join(alone.select(F.col("episode_id").alias("_key"), F.col("entity").alias("p_entity"), F.col("attribute").alias("p_attribute"), F.col("value").alias("p_value")), "_key")
    low, tail, kin = F.lower("content"), F.lower(F.substring_index("entity", "_", -1)), F.lower(F.regexp_extract("entity", "^(.*)_[^_]*$", 1))
    attribute = F.coalesce(F.col("p_attribute") == F.col("attribute"), F.lit(False))
    slot = attribute & F.coalesce(F.endswith("p_entity", tail), F.lit(False))
    entity = F.contains(low, tail) & ((kin == "") | F.contains(low, kin))
    fresh, after = F.lit(0), normalize_value(F.col("content"))
    for name, phrases in FRESH.items():
        held = sum((F.when(F.contains(low, F.lit(p)), w).otherwise(0) for p, w in phrases), F.lit(0))
        fresh = F.when(F.col("attribute") == name, held).otherwise(fresh)
        if name in ("company", "location"):
            for p, _ in reversed(phrases[: 2 if name == "company" else 3]):
                got = F.regexp_replace(strip(F.regexp_extract("content", f"(?s){p}(.*)$", 1)), r"\.+$", "")
                after = F.when((F.col("attribute") == name) & F.contains("content", F.lit(p)), got).otherwise(after)
    value = F.when(attribute, strip(F.col("p_value"))).otherwise(after)
    rank = F.struct(slot.alias("a"), attribute.alias("b"), entity.alias("c"), fresh.alias("d"), (-F.col("idx")).alias("e"))
    return x.where(strip(F.col("content")) != "").groupBy("episode_id").agg(F.max_by(value, rank).alias("predicted"))


#: Parts of a question that tell its attribute, in the order in which they are tried, and parts of a sentence that states one.
ASKS = {"location": ("currently live", "where does the user live"), "company": ("work",), "language": ("language",)}
STATES = {"location": (" live", "moving", "moved"), "company": ("work at", "switching to", "works at"), "language": ("prefer", "switched to", "language")}


def annotate(eps: DataFrame) -> DataFrame:
    """``eps`` (events, question, answer, entity, attribute, value, latest_event_idx) with what is null or -1 filled in.

    The question tells the attribute; the last sentence that states one is the latest; entity is the user, value the answer.
    """
    holds = lambda c, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(c), p))
    asked = F.lit("unknown")
    for name, parts in reversed(ASKS.items()):
        asked = F.when(holds(F.coalesce("question", F.lit("")), parts), name).otherwise(asked)
    x = eps.withColumn("attribute", F.coalesce(F.nullif("attribute", F.lit("")), asked))
    states = lambda e: F.coalesce(*[F.when(F.col("attribute") == a, holds(e, parts)) for a, parts in STATES.items()], F.lit(False))
    last = F.array_max(F.transform("events", lambda e, j: F.when(states(e), j).otherwise(-1)))
    idx = F.when(F.coalesce("latest_event_idx", F.lit(-1)) != -1, F.col("latest_event_idx")).otherwise(F.coalesce(last, F.lit(-1)))
    return x.withColumns({"latest_event_idx": idx, "entity": F.coalesce("entity", F.lit("user")), "value": F.coalesce("value", "answer", F.lit(""))})
