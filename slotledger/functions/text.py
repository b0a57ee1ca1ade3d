"""Scalar text functions: value normalisation, match scores, parsing of actions and names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_value(c: Column) -> Column:
    """Trimmed and lower-cased, other signs than a-z, 0-9 and white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9\s]", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Overlap of the token sets over the lengths of the token lists; zero without overlap."""
    a, b = words(predicted), words(gold)
    same = F.size(F.array_intersect(a, b))
    p, r = same / F.size(a), same / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (same == 0), 0.0).otherwise(2 * p * r / (p + r))


def exact_match(predicted: Column, gold: Column) -> Column:
    return F.when(F.lower(strip(predicted)) == F.lower(strip(gold)), 1.0).otherwise(0.0)


def contains_value(answer: Column, gold: Column) -> Column:
    """Normalised substring; an empty gold value is never contained."""
    g = normalize_value(gold)
    return (g != "") & F.contains(normalize_value(answer), g)


def contains_raw(answer: Column, gold: Column) -> Column:
    """Plain substring after trim and lower case; an empty gold value always is."""
    return F.contains(F.lower(strip(answer)), F.lower(strip(gold)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def parse_action(c: Column) -> Column:
    """struct<operation, entity, attribute, value> of a constrained action's first line; INVALID where it does not parse.

    Parts that are not there are empty. A value loses its final dots and an operation's name after it.
    """
    line = strip(F.split(strip(c), "\n")[0])
    part = lambda i: F.regexp_extract(line, r"(?i)^(ADD|UPDATE)\s+([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\s*=\s*(.+?)\s*$", i)
    value = strip(F.regexp_replace(part(4), r"(?i)(?:\.*\s+(?:NOOP|ADD|UPDATE|DELETE))?\.*\s*$", ""))
    op = F.when(F.upper(line) == "NOOP", "NOOP").when(part(1) != "", F.upper(part(1))).otherwise("INVALID")
    return F.struct(op.alias("operation"), F.lower(part(2)).alias("entity"), F.lower(part(3)).alias("attribute"), value.alias("value"))


#: What ends an operation's content when a line begins with it.
STOPS = "ADD UPDATE DELETE NOOP ### Explanation: Operations: Decision:".split()


def parse_operation(c: Column, fallback: Column) -> Column:
    """struct<operation, target, content> of a free operation: ``ADD: text``, ``UPDATE id: text``, ``DELETE id``, else NOOP.

    ``fallback`` is the content where none is given. Any text that begins with an operation's name
    counts as one, in either case; only the upper-case name is taken off a target. An update needs a colon.
    """
    line = strip(c)
    begins = lambda w: F.upper(line).startswith(w)
    colon = F.contains(line, F.lit(":"))
    add, update, delete = begins("ADD"), begins("UPDATE") & colon, begins("DELETE")
    name = F.when(delete, F.replace(line, F.lit("DELETE"), F.lit(""))).otherwise(F.replace(F.substring_index(line, ":", 1), F.lit("UPDATE"), F.lit("")))
    target = F.regexp_replace(strip(F.regexp_replace(strip(name), r"\.+$", "")), r"(?i)^id(?:_| \s*)", "")
    given = F.when(colon, F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)).otherwise(fallback)
    content = strip(F.regexp_replace(strip(given), r"(?s)\n(?:" + "|".join(STOPS) + r").*$", ""))
    content = F.when(content == "", fallback).otherwise(content)
    op = F.when(add, "ADD").when(update, "UPDATE").when(delete, "DELETE").otherwise("NOOP")
    return F.struct(op.alias("operation"), F.when(update | delete, target).otherwise("").alias("target"), F.when(add | update, content).otherwise("").alias("content"))


#: Keys of a payload that hold its text, the first that does first.
TEXT_KEYS = ("memory", "text", "content", "value")


def texts_within(payload) -> list[str]:
    """The texts of nested lists and maps, in order; a map with a text key counts for that text alone, one with results for these."""
    open_, out = [payload], []
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            open_ += x[::-1]
        elif isinstance(x, dict):
            own = next((x[k] for k in TEXT_KEYS if isinstance(x.get(k), str)), None)
            open_ += [x["results"]] if "results" in x else [own] if own is not None else list(x.values())[::-1]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def payload_texts(payloads: pd.Series) -> pd.Series:
    """The texts of JSON payloads of any depth; a payload that is null or no JSON has none."""

    def read(p):
        try:
            return texts_within(json.loads(p)) if p is not None else []
        except ValueError:
            return []

    return pd.Series([read(p) for p in payloads], dtype=object)


def run_name(c: Column) -> Column:
    """struct<method, answer_mode, k> of ``<method>_<answer>_k<k>``; direct and prompt are short for the slot modes."""
    pattern = r"^(.+)_(slot_direct|slot_prompt|direct|prompt)_k(\d+)$"
    mode = F.regexp_extract(c, pattern, 2)
    mode = F.when(mode.isin("direct", "prompt"), F.concat(F.lit("slot_"), mode)).otherwise(mode)
    return F.struct(F.regexp_extract(c, pattern, 1).alias("method"), mode.alias("answer_mode"), F.regexp_extract(c, pattern, 3).try_cast("int").alias("k"))


def confidence(reward: Column, hits: Column, tries: Column, age_hours: Column) -> Column:
    """Logistic of the weighted reward, hit ratio and log age (weights .4, .4, .2)."""
    z = 0.4 * reward + 0.4 * hits / F.greatest(tries, F.lit(1)) + 0.2 * F.log1p(age_hours)
    return 1 / (1 + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
