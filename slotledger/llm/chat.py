"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is ``<s>``, its content and ``</s>`` with a line end; ``<s:1>`` opens a turn whose
text is escaped. Content is ``[INST]text[/INST]`` for a user, the bare text for an
assistant and ``<<role>>text`` for any other role. By the grammar a text holds no control string, and an
escaped one no ``<`` or ``[``; the parser splits at turn ends, reads the opening signs, and has no
turn for what breaks the grammar.

Each turn is rendered at the first level of escaping at which it is parsed to the same role and text:
as it is, then escaped (``%``, ``<`` and ``[`` as ``%25``, ``%3C``, ``%5B``). The joined
conversation is parsed again and compared with its source; if turns differ, all of them
are escaped, and parsed once more. What still differs is an error, never an output.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then
text, so ties and repeated rows have one order; a null conv_id is a conversation of its
own; an empty table has no conversations; columns other than conv_id, turn, role and text are ignored, whatever
their names. A conversation is one output value, so its turns
meet in one row, and nothing else does; within it work grows with its length, times the logarithm of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import running

RAW, ESCAPED, END = "<s>", "<s:1>", "</s>\n"
CONTROL = r"</?s>|<s:1>|\[/?INST\]|<<|>>"
END_PATTERN = "</s>\n"


def escape(c: Column) -> Column:
    for a, b in (("%", "%25"), ("<", "%3C"), ("[", "%5B")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("<", "%3C"), ("[", "%5B"), ("%", "%25")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def head(role: Column, escaped: Column) -> Column:
    mark = F.when(escaped, ESCAPED).otherwise(RAW)
    other = F.concat(F.lit("<<"), F.replace(escape(role), F.lit(">"), F.lit("%3E")), F.lit(">>"))
    return F.concat(mark, F.when(role == "user", "[INST]").when(role == "assistant", "").otherwise(other))


def tail(role: Column) -> Column:
    return F.concat(F.when(role == "user", "[/INST]").otherwise(""), F.lit(END))


def render(role: Column, text: Column, escaped: Column) -> Column:
    return F.concat(head(role, escaped), F.when(escaped, escape(text)).otherwise(text), tail(role))


def _turn(piece: Column) -> Column:
    """Role and text of what stands before a turn's end; null if it is no turn."""
    escaped, raw = piece.startswith(ESCAPED), piece.startswith(RAW)
    rest = F.when(escaped, piece.substr(F.lit(len(ESCAPED) + 1), F.length(piece))).otherwise(piece.substr(F.lit(len(RAW) + 1), F.length(piece)))
    user = rest.startswith("[INST]") & rest.endswith("[/INST]")
    other = rest.startswith("<<")
    named = F.substring_index(rest, ">>", 1)
    role = F.when(user, "user").when(other, unescape(F.replace(named.substr(F.lit(3), F.length(named)), F.lit("%3E"), F.lit(">")))).otherwise("assistant")
    text = F.when(user, rest.substr(F.lit(7), F.length(rest) - 13)).when(other, rest.substr(F.length(named) + 3, F.length(rest))).otherwise(rest)
    broken = F.when(escaped, text.rlike(r"[<\[]")).otherwise(text.rlike(CONTROL))
    return F.when((escaped | raw) & ~broken, F.struct(role.alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>; null in place of what is no turn."""
    pieces = F.split(formatted, END_PATTERN)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _turn)


def _comes_back(out: Column, turns: Column) -> Column:
    return F.coalesce(parse(out) == turns, F.lit(False))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_spans: where assistants' texts stand (code points, end exclusive) and whether escaped."""
    none = F.lit("")
    t = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    own = F.array(F.struct("role", "text"))
    plain, marked = (render(F.col("role"), F.col("text"), F.lit(e)) for e in (False, True))
    t = t.withColumn("escaped", ~_comes_back(plain, own))
    t = t.withColumn("out", F.when(~F.col("escaped"), plain).when(_comes_back(marked, own), marked).otherwise(F.raise_error(F.lit("a turn is not parsed to its source"))))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "escaped", "out"))).alias("t"))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["out"]), "")
    again = F.transform("t", lambda x: F.struct(x["turn"], x["role"], x["text"], F.lit(True).alias("escaped"), render(x["role"], x["text"], F.lit(True)).alias("out")))
    g = g.select("conv_id", "t", source.alias("source"), _comes_back(joined("t"), source).alias("same"))
    g = g.select("conv_id", "source", "same", F.when(F.col("same"), F.col("t")).otherwise(again).alias("t"))
    g = g.withColumn("formatted", joined("t"))
    ends = running(F.transform("t", lambda x: F.length(x["out"])), lambda a, b: a + b)
    spans = F.transform(F.arrays_zip(F.col("t").alias("t"), ends.alias("end")), _loss)
    whole = F.when(F.col("same") | _comes_back(F.col("formatted"), F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation is not parsed to its source")))
    return g.select("conv_id", whole.alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def _loss(x: Column) -> Column:
    t, end = x["t"], x["end"]
    start, stop = end - F.length(t["out"]) + F.length(head(t["role"], t["escaped"])), end - F.length(tail(t["role"]))
    return F.when(t["role"] == "assistant", F.struct(start.alias("start"), stop.alias("end"), t["escaped"].alias("escaped")))


def with_conflict(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts look like control strings."""
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(hard)


def digests(out: DataFrame) -> DataFrame:
    """What a reader recovers from the formatted text and from the loss mask."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))

    def under(s):
        text = F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        return F.when(s["escaped"], unescape(text)).otherwise(text)

    x = out.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform("loss_spans", under), "").alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return x.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_matches(text, '</?s>|<s:1>|\[/?INST\]|<<|>>') AS escaped FROM t),
n AS (SELECT *, length(CASE WHEN escaped THEN replace(replace(replace(text, '%', '%25'), '<', '%3C'), '[', '%5B') ELSE text END)
               + CASE WHEN escaped THEN 5 ELSE 3 END + 5
               + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 0
                      ELSE 4 + length(replace(replace(replace(replace(role, '%', '%25'), '<', '%3C'), '[', '%5B'), '>', '%3E')) END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
