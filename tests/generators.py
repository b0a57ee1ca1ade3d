"""Synthetic event splits: updates of a target slot, distractors on another slot, and sentences that hold no fact.

Where a choice of words is free, a hash of the episode and step makes it, so that a split is the same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relations, names and values by attribute; each split takes the first so many.
RELATIONS = "friend sister brother mentor coworker manager advisor teammate neighbor cousin".split()
NAMES = "Alex Bob Lily Chen Alice Tom Emma Jack Sophia David Wang Li Nora Owen Mia Leo Grace Hank Ivy Noah".split()
VALUES = {
    "location": "Wuxi Ningbo Kunming Changsha Fuzhou Dalian Qingdao Suzhou Xiamen Wuhan Nanjing Hefei Jinan Harbin Lanzhou Guiyang Shenzhen Chengdu Tianjin Shenyang".split(),
    "company": "Tencent Baidu JD NetEase Meituan Pinduoduo Alibaba ByteDance Huawei Microsoft Google".split(),
    "preference": "cold brew,oolong tea,jasmine tea,green tea,espresso,matcha,black coffee,tea,latte,mocha,sparkling water,lemon tea,herbal tea,americano,milk tea,cocoa".split(","),
    "language": "Kotlin Scala Python Go Rust TypeScript Java".split(),
    "timezone": "UTC+1 UTC+2 UTC+3 UTC+5 UTC+8 UTC+9 UTC-5 UTC-8".split(),
    "hobby": "climbing painting cycling photography gardening baking running swimming calligraphy chess".split(),
    "instrument": "piano violin guitar cello flute drums erhu saxophone".split(),
    "project": "Atlas Beacon Comet Delta Echo Falcon Galaxy Harbor Ion Jade".split(),
}
#: What follows the subject in a slot's first sentence, and in later ones; {} is the value.
FIRST = {
    "location": [" lives in {}"], "company": [" works at {}"], "preference": [" prefers {}"], "language": ["'s programming language is {}"],
}
LATER = {
    "location": [" relocated to {}", " moved to {}"], "company": [" joined {}", " switched to {}"],
    "preference": [" started preferring {}"], "language": [" switched to {}", " now codes in {}"],
}
WIDE_FIRST = {
    "location": [" lives in {}", " is based in {}"], "company": [" works at {}", " is employed at {}"], "preference": [" prefers {}"],
    "language": [" programming language is {}"], "timezone": [" timezone is {}"], "hobby": [" hobby is {}"],
    "instrument": [" instrument is {}", " plays {}"], "project": [" project is {}", " works on project {}"],
}
WIDE_LATER = {
    "location": [" relocated to {}", " moved to {}", " settled in {}"], "company": [" joined {}", " switched to {}"],
    "preference": [" started preferring {}", " now prefers {}"], "language": [" switched to {}", " now codes in {}"],
    "timezone": [" switched timezone to {}", " uses {} time"], "hobby": [" took up {}", " now practices {}"],
    "instrument": [" switched instrument to {}", " now plays {}"], "project": [" now works on project {}"],
}
#: Near misses, which name a value and state no fact, and other noise.
NEAR = {
    "location": [" is considering a trip to {}", " read a travel guide about {}", " visited {} last year"],
    "company": [" interviewed with {} but has not changed jobs", " read news about {}", " got a recruiting message from {} but stayed put"],
    "preference": [" tried {} once at a cafe", " bought {} for a guest", " mentioned {} in a menu discussion"],
    "language": [" discussed {} in a workshop", " read a tutorial about {}", " watched a talk about {}"],
    "timezone": [" scheduled a call with someone in {}", " checked a clock labeled {}"],
    "hobby": [" watched a video about {}", " bought a gift related to {}"],
    "instrument": [" attended a concert featuring {}", " repaired a case for a {}"],
    "project": [" read a memo that mentioned {}", " attended a review where {} was discussed"],
}
QUESTIONS = {
    "location": "Where does {} currently live?", "company": "Which company does {} currently work for?", "preference": "What drink does {} currently prefer?",
    "language": "What programming language does {} currently prefer?", "timezone": "What timezone does {} currently use?", "hobby": "What hobby does {} currently have?",
    "instrument": "What instrument does {} currently play?", "project": "Which project does {} currently work on?",
}
NOISE = {
    "update_frequency": "This came up during a long planning chat.",
    "update_frequency_hard": "This came up during a long planning chat, but no facts changed.",
    "update_frequency_expanded": "The conversation continued with no memory fact changes.",
}
KS = (1, 2, 4, 8, 16)
#: Names, values of location, near misses that a split uses; steps of its names, place of the second relation, and every how many steps noise comes.
SHAPES = {
    "update_frequency": {"relations": 6, "names": 12, "attributes": 4, "places": 16, "near": 0, "stride": 3, "second": 2, "every": 3},
    "update_frequency_hard": {"relations": 6, "names": 12, "attributes": 4, "places": 16, "near": 3, "stride": 3, "second": 3, "every": 3},
    "update_frequency_expanded": {"relations": 10, "names": 20, "attributes": 8, "places": 20, "near": 2, "stride": 5, "second": 5, "every": 4},
}


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def _by(attribute: Column, table: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, c in table.items():
        out = F.when(attribute == name, c).otherwise(out)
    return out


def _at(values: Column, i: Column) -> Column:
    return F.get(values, F.pmod(i, F.size(values)).cast("int"))


def episodes(spark: SparkSession, kind: str, split: str = "test", per_k: int = 100, ks: tuple[int, ...] = KS) -> DataFrame:
    """The episodes of a split in the schema of ``sources.facts``: ``per_k`` for each number of updates in ``ks``."""
    shape, plain = SHAPES[kind], kind == "update_frequency"
    attributes = list(VALUES)[: shape["attributes"]]
    pools = {a: _array(VALUES[a][: shape["places"]]) for a in attributes}
    first, later = ({a: _array(t[a]) for a in attributes} for t in ((WIDE_FIRST, WIDE_LATER) if shape["attributes"] == 8 else (FIRST, LATER)))
    i, k, attribute = F.col("i"), F.col("k_updates"), F.col("attribute")
    relations, names = _array(RELATIONS[: shape["relations"]]), _array(NAMES[: shape["names"]])
    x = spark.range(per_k).select(F.col("id").alias("i"), F.explode(_array(ks)).alias("k_updates"))
    shift = len(split) if kind == "update_frequency_expanded" else 0
    x = x.withColumns({"attribute": _at(_array(attributes), i + shift), "relation": _at(relations, i + k), "name": _at(names, i * shape["stride"] + k)})
    other = _at(names, i * 5 + 1)
    after = _at(names, F.array_position(names, F.col("name")))
    x = x.withColumns({
        "relation_2": _at(relations, i + 2 if plain else i + k + shape["second"]),
        "name_2": F.when(other == F.col("name"), after).otherwise(other) if plain else F.col("name"),
        "pool": _by(attribute, pools), "first": _by(attribute, first), "later": _by(attribute, later),
        "near": _by(attribute, {a: _array(NEAR[a][: shape["near"]]) for a in attributes}) if shape["near"] else _array([""]),
    })
    own, second = (F.concat(F.lit("my "), F.col(r), F.lit(" "), F.col(n)) for r, n in (("relation", "name"), ("relation_2", "name_2")))
    pool, pick = F.col("pool"), lambda s, salt: F.xxhash64("i", "k_updates", s, F.lit(salt))
    stride = F.when((attribute == "company") & F.lit(kind == "update_frequency_hard"), 1).otherwise(3)
    value = lambda s: _at(pool, i + s * stride + k)
    says = lambda subject, phrase, v: F.concat(F.lit("User says: "), subject, F.replace(phrase, F.lit("{}"), v), F.lit("."))

    def told(surface, bare, v, s, is_first, salt):
        subject = F.when(is_first, surface).otherwise(bare) if plain else surface
        return says(subject, F.when(is_first, _at(F.col("first"), pick(s, salt))).otherwise(_at(F.col("later"), pick(s, salt))), v)

    def step(s):
        if plain:  # a sample of four values without repeats
            v2 = _at(pool, F.xxhash64("i", "k_updates") % 1000 + s % 4)
            miss = F.when(s % 2 == 1, F.concat(F.lit("User says: "), F.col("name"), F.lit(" visited last week.")))
        else:
            v2 = _at(pool, i + F.pmod(s, F.greatest(k, F.lit(3))) * 5 + 2)
            miss = says(F.when(s % 2 == 0, own).otherwise(second), _at(F.col("near"), s.cast("long")), _at(pool, i + s * 7 + 1))
        noise = F.when(s % shape["every"] == shape["every"] - 1, F.concat(F.lit("User says: "), F.lit(NOISE[kind])))
        return F.array_compact(F.array(F.when(s > 0, told(second, F.col("name_2"), v2, s, s == 1, 1)), miss, told(own, F.col("name"), value(s), s, s == 0, 2), noise))

    events = F.flatten(F.transform(F.sequence(F.lit(0), k - 1), step))
    x = x.withColumns({"events": events, "value": value(k - 1)})
    noisy = F.pmod(k - 1, F.lit(shape["every"])) == shape["every"] - 1
    surface = F.col("name") if plain else own
    question = F.replace(_by(attribute, {a: F.lit(QUESTIONS[a]) for a in attributes}), F.lit("{}"), surface)
    n = F.size("events")
    return x.select(
        (F.array_position(_array(ks), k).cast("long") * per_k - per_k + i).alias("episode_id"),
        "events", question.alias("question"), F.col("value").alias("answer"), F.concat_ws("_", "relation", F.lower("name")).alias("entity"), "attribute", "value",
        (n - 1 - noisy.cast("int")).cast("long").alias("latest_event_idx"), F.lit(f"{kind}_evolution_tracking").alias("category"), F.lit(kind).alias("stress_type"), "k_updates",
        F.lit("same_attribute_single_entity" if plain else "same_name_multi_entity").alias("distractor_level"), F.lit(None if plain else "semantic_near_miss").cast("string").alias("noop_level"),
        n.alias("num_events"), k.alias("num_target_updates"), n.alias("num_updates"),
    )


def split_events(spark: SparkSession, ks: tuple[int, ...], densities: tuple[int, ...]) -> DataFrame:
    """(k, d, kind, i): k updates, k - 1 distractors, k near misses and k // d noise sentences for each k and density."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, ks))).alias("k")).select("k", F.explode(F.array(*map(F.lit, densities))).alias("d"))
    k, d = F.col("k"), F.col("d")
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), c.cast("int").alias("n")) for n, c in (("update", k), ("distractor", k - 1), ("near_miss", k), ("noise", F.floor(k / d)))])
    x = grid.select("k", "d", F.explode(kinds).alias("x")).where("x.n > 0")
    return x.select("k", "d", "x.kind", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("i"))
