"""Small side tables: streams, rules, presets, spell names, archetypes; and corpus sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.operators.rules import PRESETS

STREAM = (
    "stream_id STRING, game STRING, server STRING, player STRING, public_stream BOOLEAN, is_replay BOOLEAN, "
    "owner_key STRING, utc_offset_secs BIGINT"
)
RULE = (
    "rule_id INT, name STRING, enabled BOOLEAN, logic STRING, "
    "conditions ARRAY<STRUCT<type: STRING, match_type: STRING, pattern: STRING, var_name: STRING, op: STRING, value: STRING, channel: STRING, custom_channel: STRING>>, "
    "actions ARRAY<STRUCT<type: STRING, message: STRING, tts_text: STRING, sounds: ARRAY<STRING>, mode: STRING, delay_secs: DOUBLE, priority: STRING, var_name: STRING, value: STRING>>"
)


def one_per_identity(streams: DataFrame) -> DataFrame:
    """One stream per (game, server, player) in any case: public before private, then newest."""
    key = [F.lower("game"), F.lower("server"), F.lower("player")]
    w = Window.partitionBy(*key).orderBy(F.col("public_stream").desc(), F.col("updated_at").desc(), "stream_id")
    return streams.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def read_stream_registry(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per stream; ``updated_at`` is the file's own time."""
    raw = spark.read.schema(STREAM).option("multiLine", True).json(path)
    return one_per_identity(raw.select("*", F.col("_metadata.file_modification_time").alias("updated_at")))


def find_public(streams: DataFrame) -> DataFrame:
    return streams.filter("public_stream")


CONFIG = f"rules ARRAY<STRUCT<{RULE.replace(' INT,', ': INT,').replace('name STRING,', 'name: STRING,').replace('enabled BOOLEAN', 'enabled: BOOLEAN').replace('logic STRING', 'logic: STRING').replace('conditions ARRAY', 'conditions: ARRAY').replace('actions ARRAY', 'actions: ARRAY')}>>, reference_groups MAP<STRING, MAP<STRING, STRING>>, active_reference_group STRING"


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """The rules of a JSON file (a list), with free text trimmed.  A rule file is small and is
    needed on the driver to build the plan."""
    return _rules(spark.read.schema(RULE).option("multiLine", True).json(path))


def read_rule_config(spark: SparkSession, path: str) -> tuple[list[dict], dict[str, str]]:
    """Rules of a JSON object with reference groups, and the variables of the active group."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    seeds = raw.select(F.explode(F.try_element_at("reference_groups", F.col("active_reference_group"))).alias("k", "v"))
    rules = _rules(raw.select(F.inline("rules")))
    return rules, {r["k"].strip(): r["v"].strip() for r in seeds.collect()}


def _rules(df: DataFrame) -> list[dict]:
    trim = lambda a, fields: F.transform(a, lambda s: _trim_all(s, fields))
    df = df.withColumns({
        "name": F.trim("name"),
        "conditions": trim("conditions", ["pattern", "var_name", "value", "custom_channel"]),
        "actions": trim("actions", ["message", "tts_text", "var_name", "value"]),
    })
    return [_clean(r.asDict(recursive=True)) for r in df.collect()]


def _trim_all(s, fields):
    for f in fields:
        s = s.withField(f, F.regexp_replace(s[f], r"^\s+|\s+$", ""))
    return s


def _clean(x):
    if isinstance(x, dict):
        return {k: _clean(v) for k, v in x.items() if v is not None}
    return [_clean(v) for v in x] if isinstance(x, list) else x


def read_presets(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Downloaded presets when there are any, else the built-in ones."""
    built_in = spark.createDataFrame(PRESETS, "category STRING, label STRING, pattern STRING")
    if path is None:
        return built_in
    schema = "version INT, presets ARRAY<STRUCT<category: STRING, label: STRING, pattern: STRING>>"
    got = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("presets").alias("p")).select("p.*")
    return built_in if got.isEmpty() else got


# Positions in the caret-delimited spell file (from 0), and its field count.
SPELL_NAME, SPELL_ICON = 1, 75


def read_spell_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct spell names per icon, in file order; short rows are dropped."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    text = spark.read.text(path).withColumn("_at", F.col("_metadata.file_block_start") * 2 + row)
    part = F.split("value", r"\^")
    rows = text.filter(F.size(part) > SPELL_ICON).select("_at", part[SPELL_NAME].alias("name"), part[SPELL_ICON].try_cast("int").alias("icon_id"))
    rows = rows.filter(F.col("icon_id").isNotNull() & (F.col("name") != ""))
    first = rows.groupBy("icon_id", "name").agg(F.min("_at").alias("_at"))
    return first.groupBy("icon_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda x: x["name"]).alias("names"))


def spell_icon_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    return wanted.join(names, "icon_id", "left")


def read_archetype_map(spark: SparkSession, path: str) -> DataFrame:
    """Speaker to label, from a JSON object."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("speaker", "archetype"))


def update_archetype_map(known: DataFrame, suggested: DataFrame) -> DataFrame:
    """Old labels stay; only unknown speakers are added."""
    fresh = suggested.join(known.select("speaker"), "speaker", "left_anti")
    return known.select("speaker", "archetype").unionByName(fresh.select("speaker", "archetype"))


def write_corpus(corpus: DataFrame, path: str) -> None:
    """JSON lines of chat records."""
    corpus.write.mode("overwrite").json(path)


def write_training_set(rows: DataFrame, meta: dict, path: str) -> None:
    """Sequences by split, with the token table and lengths beside them."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/sequences")
    rows.sparkSession.createDataFrame([(k, str(v)) for k, v in meta.items()], "key STRING, value STRING").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
