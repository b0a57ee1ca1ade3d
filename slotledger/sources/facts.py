"""Slot facts, episodes and result files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotledger.sources.arrays import elements, opened

EPISODE = "events array<string>, question string, answer string, entity string, attribute string, value string, latest_event_idx bigint, category string, stress_type string, k_updates int, distractor_level string, noop_level string, num_events int, num_target_updates int, num_updates int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_events(events: DataFrame) -> DataFrame:
    """Facts (episode_id, event_idx, entity, attribute, value, ts) of the event log: a slot for each user and event type."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("episode_id"),
        (F.row_number().over(order) - 1).cast("long").alias("event_idx"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("attribute"),
        (F.floor("value").cast("long") % 7).cast("string").alias("value"),
        "ts",
    )


def episodes(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """Episodes of a JSON array file, with their position as episode_id and defaults for missing keys; rows [start, end).

    The file is read in blocks cut between elements; a missing file and an empty range are errors.
    """
    x = elements(spark, path, start, end).select(F.col("position").alias("episode_id"), F.from_json("value", EPISODE).alias("e")).select("episode_id", "e.*")
    return x.withColumns({
        "entity": F.coalesce("entity", F.lit("user")),
        "attribute": F.coalesce("attribute", F.lit("unknown")),
        "value": F.coalesce("value", "answer"),
        "latest_event_idx": F.coalesce("latest_event_idx", F.lit(-1)),
        "num_updates": F.coalesce("num_updates", F.size("events")),
    })


def split_file(folder: str, prefix: str, split: str, legacy: str = "test") -> str:
    """The file of a split of a data folder; for the ``legacy`` split also the older name that has ``legacy`` in it. Neither is an error."""
    for name in [f"{prefix}_{split}.json"] + [f"{prefix}.json"] * (split == legacy):
        path = f"{folder.rstrip('/')}/{name}"
        try:
            with opened(path):
                return path
        except FileNotFoundError:
            pass
    raise FileNotFoundError(f"no file of split {split} in {folder}")


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """A file of JSON lines, without blank ones; the first ``limit`` where that is asked for."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    x = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return x if limit is None else x.limit(limit)


def load_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved store; contents are encoded again."""
    from slotledger.functions.surface import encode

    return spark.read.schema(schema).json(path).withColumn("embedding", encode(F.col("content")))


def not_done(shards: DataFrame, done: DataFrame, key: str = "shard") -> DataFrame:
    """The shards of a run that have no output yet."""
    return shards.join(done.select(key).distinct(), key, "left_anti")


def unique_inputs(paths: list[str]) -> list[str]:
    """Paths without repeats, in order, after their dots and links are resolved."""
    import os

    return list(dict.fromkeys(os.path.realpath(p) for p in paths))


def events_of(eps: DataFrame) -> DataFrame:
    """(episode_id, event_idx, text) of episodes."""
    return eps.select("episode_id", F.posexplode("events").alias("event_idx", "text"))


def results(spark: SparkSession, glob: str) -> DataFrame:
    """Result files as (run, path, summary, results), one row a file; a file that is not JSON keeps its row with status invalid_json."""
    whole = spark.read.option("recursiveFileLookup", True).text(glob, wholetext=True)
    path = F.col("_metadata.file_path")
    ok = F.try_parse_json("value").isNotNull()
    return whole.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("run"), path.alias("path"), F.get_json_object("value", "$.summary").alias("summary"), F.get_json_object("value", "$.results").alias("results"), F.when(ok, "ok").otherwise("invalid_json").alias("status"))


def manifest(payloads: DataFrame) -> DataFrame:
    """One row for each result file (path, value): the group and run that its path names, and its summary's fields with their fallbacks."""
    of = lambda *keys: F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in keys])
    group = F.coalesce(F.nullif(F.regexp_extract("path", "results/([^/]+)/", 1), F.lit("")), F.lit("unknown"))
    n = F.when(F.get_json_object("value", "$.results").isNotNull(), F.size(F.from_json(F.get_json_object("value", "$.results"), "array<string>")))
    return payloads.select(
        group.alias("result_group"), F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("run_name"), of("summary.mode", "summary.method").alias("mode"),
        F.coalesce(of("summary.retrieval_policy"), F.lit("normal")).alias("retrieval_policy"), F.coalesce(of("summary.num_examples").cast("long"), n.cast("long")).alias("num_examples"),
        of("summary.k_updates", "results[0].k_updates").cast("long").alias("k_updates"), of("summary.avg_em").cast("double").alias("avg_em"),
        of("summary.state_accuracy").cast("double").alias("state_accuracy"), F.coalesce(of("summary.status"), F.lit("completed")).alias("status"),
    )


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """(conv_id, event_idx, event): turns as the sentences of an event stream, blank ones too; a null text is empty."""
    return conversations.select("conv_id", F.col("turn").alias("event_idx"), F.concat(F.initcap("role"), F.lit(" says: "), F.coalesce("text", F.lit(""))).alias("event"))
