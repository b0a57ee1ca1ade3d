"""Secret scans in DataFrame functions alone: fixed patterns, and character Markov models.

Two first-order models over printable ASCII, of random strings and of ordinary
identifiers, are trained from labelled samples; a token of ``LEAST`` signs or more whose
log-likelihood ratio favours the random model by ``MEAN_BITS`` a sign is a secret. Where a whole token is none,
its parts between ``/``, ``_`` and ``-`` are judged by the same rule. Tokens are sought around the base
spans, so that what is left of a token beside one is judged too. Only
the table of ratios (128 x 128, whatever the input) leaves the executors.

Positions come from the gaps that ``split`` leaves between matches, as code points; they are
summed by doubling steps, so the work grows with the number of matches times its logarithm.

Defined results: a null or empty text has no spans; texts of any length are searched whole;
spans of two kinds may overlap or be equal, each is reported; repeated rows are scanned alike; an empty table gives no rows;
columns other than doc_id and text are left alone, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotledger.llm.common import running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{LEAST},}}"
MEAN_BITS = 1.0
DISTINCT = 8  # signs; fewer are a rule, a date or a run
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SEPARATED = rf"[A-Za-z0-9+]{{{LEAST},}}"
#: Ordinary words in four languages, and names that code is full of, of which identifiers and prose are composed.
PARTS = """
get set user name file path data list item value index count total default config request response handler manager service
client server window button image table column format string number buffer stream thread process system update create delete
insert select current previous version message error result session account address document language customer order product
category temperature websocket handshake exception quick brown fox jumps lazy dog the and that with from which would their about
there other because government although strength through thought knight rhythm website keyboard javascript python mozilla chrome
und nicht eine werden auch nach schon gesellschaft verschieden einheit wichtig zwischen entscheidung heute pflanze herrschaft
moeglich buecher zeichen freundschaft verzeichnis berechtigung deutschland sprache geschichte landwirtschaft durchschnitt
les des dans pour que est une avec sont mais nous vous leur cette aussi peut comme tout deux questions eaux gouvernement
elle beaucoup travailleur toujours lumiere royaume developpement
los las por para como pero sus este entre cuando muy sobre tambien hasta desde todos nosotros ciudad trabajo quien llamar
desarrollo huevo naranja corazon
abcdefghijklmnopqrstuvwxyz qwertyuiop asdfghjkl zxcvbnm
""".split()
SAMPLES = 20_000
MASK = "[SECRET]"


def labelled(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(text, random boolean): ``n`` strings from hash digests, and ``n`` identifiers composed of PARTS."""
    sha = F.sha2(F.col("id").cast("string"), 256)
    random = F.element_at(F.array(sha, F.base64(F.unhex(sha)), F.substring(F.upper(F.translate(F.base64(F.unhex(sha)), "+/=", "")), 1, 32)), (F.col("id") % 3 + 1).cast("int"))
    part = lambda k: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    a, b, c, d = part(1), part(2), part(3), part(4)
    kinds = [F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), F.concat(a, b, c, d), F.upper(F.concat(a, b, c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c), F.pmod("id", F.lit(100)).cast("string"))]
    named = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    ids = spark.range(n, numPartitions=1)
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(named.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> np.ndarray:
    """Bits by which the random model prefers a sign after another: 128 x 128."""
    chars = F.transform(F.regexp_extract_all("text", F.lit("[!-~]"), F.lit(0)), F.ascii)
    x = samples.select("random", chars.alias("c")).where(F.size("c") > 1)
    n = F.size("c") - 1
    pairs = x.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda a, b: a * 128 + b)).alias("p"))
    counts = {True: np.zeros((128, 128)), False: np.zeros((128, 128))}
    for random, p, k in pairs.groupBy("random", "p").count().collect():  # 2 x 128 x 128 rows at most
        counts[random][p // 128, p % 128] = k
    log = {k: np.log2((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * len(SIGNS))) for k, c in counts.items()}
    return log[True] - log[False]


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit, got>> of the matches in ``text``; got: a group of each."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(hits))
    ends = running(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)), lambda a, b: a + b)
    rows = F.transform(F.arrays_zip(ends.alias("end"), hits.alias("hit"), got.alias("got")), lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["got"].alias("got")))
    return F.when(text.rlike(pattern), rows).otherwise(F.expr("CAST(array() AS array<struct<start: int, end: int, hit: string, got: string>>)"))


def _blank(text: Column, pattern: str, found: Column, fits) -> Column:
    """``text`` with the matches that fit as blanks of their length."""
    gaps = F.split(text, pattern)
    body = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, x: F.concat(g, F.when(fits(x), F.repeat(F.lit(" "), F.length(x["hit"]))).otherwise(x["hit"])))
    return F.when(F.size(found) > 0, F.concat(F.array_join(body, ""), F.element_at(gaps, -1))).otherwise(text)


#: Of each base kind: its pattern, the group whose length counts, and its least length.
BASE = ((ASSIGN, 2, 12), (ACCESS, 0, 18), (HEX, 0, 16))


def _at_least(n: int):
    return lambda m: F.length(m["got"]) >= n


def scan(docs: DataFrame, ratios: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` and text, with base and added: arrays of (start, kind, end), kind by its place in KINDS, in order."""
    model = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios.ravel())), ",").cast("array<double>")
    spans = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"], F.lit(kind).alias("kind"), x["end"]))
    x = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    x = x.select("*", *[_matches(F.col("text"), pattern, group).alias(f"_{k}") for k, (pattern, group, _) in enumerate(BASE)], F.col("text").alias("_rest"))
    base = []
    for k, (pattern, _, least) in enumerate(BASE):
        fits = _at_least(least)
        base.append(spans(F.filter(f"_{k}", fits), k))
        own = F.col(f"_{k}") if not k else _matches(F.col("_rest"), pattern)  # what earlier kinds left
        x = x.withColumn("_own", own).withColumn("_rest", _blank(F.col("_rest"), pattern, F.col("_own"), fits))
    x = x.select(*keep, "text", F.array_sort(F.concat(*base)).alias("base"), _matches(F.col("_rest"), TOKEN).alias("_m"))

    def secret(token):
        signs = F.regexp_extract_all(token, F.lit("."), F.lit(0))
        codes = F.transform(signs, F.ascii)
        n = F.size(codes) - 1
        bits = F.aggregate(F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: F.element_at(model, a * 128 + b + 1)), F.lit(0.0), lambda s, v: s + v)
        return token.rlike("[A-Za-z]") & (F.size(F.array_distinct(signs)) >= DISTINCT) & (bits >= MEAN_BITS * n)

    def parts(m):
        found = F.filter(_matches(m["hit"], SEPARATED), lambda p: secret(p["hit"]))
        return F.transform(found, lambda p: F.struct((m["start"] + p["start"]).alias("start"), F.lit(3).alias("kind"), (m["start"] + p["end"]).alias("end")))

    whole = lambda m: F.array(F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    added = F.flatten(F.transform("_m", lambda m: F.when(secret(m["hit"]), whole(m)).otherwise(parts(m))))
    return x.select(*keep, "text", "base", added.alias("added"))


def model(docs: DataFrame) -> np.ndarray:
    return train(labelled(docs.sparkSession))


def _join(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans of each row."""
    x = scan(docs, model(docs), "doc_id")
    kinds = F.transform("base", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return x.select("doc_id", *n, F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(F.array_sort(F.concat("base", "added"))).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by MASK (spans that overlap: by one), n_chars to match."""
    x = scan(docs.select(F.struct("*").alias("row"), "text"), model(docs), "row")
    x = x.select("row", "text", F.array_sort(F.concat("base", "added")).alias("spans"))
    stops = running(F.transform("spans", lambda s: s["end"]), F.greatest)
    x = x.select("*", stops.alias("stops"), F.when(F.size("spans") > 0, F.split("text", "")).alias("signs"))

    def piece(s, i):
        before = F.when(i > 0, F.get("stops", i - 1)).otherwise(F.lit(0))
        return F.concat(F.array_join(F.slice("signs", before + 1, F.greatest(s["start"] - before, F.lit(0))), ""), F.when(s["start"] >= before, MASK).otherwise(""))

    last = F.element_at("stops", -1)
    done = F.concat(F.array_join(F.transform("spans", piece), ""), F.array_join(F.slice("signs", last + 1, F.size("signs")), ""))
    x = x.select("row", F.when(F.size("spans") > 0, done).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return x.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
