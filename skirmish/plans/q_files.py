"""Queries that go through files: rules, presets, corpora and training sets written and read back, a store after retention."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skirmish.operators import chat as C
from skirmish.operators import maintain as M
from skirmish.operators import rules as R
from skirmish.operators.ordered import stage
from skirmish.plans import q_chat as Q
from skirmish.plans.q_time import folder
from skirmish.plans.registry import SQL, query
from skirmish.plans.render import combat_events, combat_lines
from skirmish.plans.sql import EV
from skirmish.sources import batches as B
from skirmish.sources import tables as T


def _file(spark, value) -> str:
    path = folder(spark)
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(path)
    return path


@query("rule_file", SQL["apply_rules"])
def rule_file(spark, sf):
    """The rules of ``apply_rules`` from a file, with blanks around their texts."""
    padded = [{**r, "name": f" {r['name']} ", "conditions": [{**c, "pattern": f" {c['pattern']}\t"} if "pattern" in c else c for c in r["conditions"]]} for r in Q.RULES]
    rules = T.read_rules(spark, _file(spark, padded))
    out = R.apply_rules(Q._rule_lines(spark, sf), rules, seeds=Q._SEED, span=Q._SPAN)
    return out.select("stream_id", "line_no", "rule_id", "action", "type", "message", "priority", "fire_ts")


@query("rule_config", SQL["apply_rules"])
def rule_config(spark, sf):
    """The same from a configuration whose active reference group gives the variable."""
    config = {"rules": Q.RULES, "reference_groups": {"mine": {" limit ": " 30 "}, "other": {"limit": "1"}}, "active_reference_group": "mine"}
    rules, seeds = T.read_rule_config(spark, _file(spark, config))
    out = R.apply_rules(Q._rule_lines(spark, sf), rules, seeds=seeds, span=Q._SPAN)
    return out.select("stream_id", "line_no", "rule_id", "action", "type", "message", "priority", "fire_ts")


@query("preset_file", SQL["preset_hits"])
def preset_file(spark, sf):
    """The presets of ``preset_hits`` from a downloaded file."""
    presets = [r.asDict() for r in T.read_presets(spark).collect()]
    read = T.read_presets(spark, _file(spark, {"version": 1, "presets": presets}))
    rules = [{"rule_id": n, "name": r.label, "logic": "all", "conditions": [{"type": "match", "match_type": "regex", "pattern": r.pattern}], "actions": []} for n, r in enumerate(read.collect())]
    hits = R.preview_rules(combat_lines(spark, sf), rules)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("written_corpus", SQL["flat_corpus"])
def written_corpus(spark, sf):
    """The flat corpus as JSON lines, read back."""
    path = folder(spark)
    T.write_corpus(Q.flat_corpus(spark, sf), path)
    return spark.read.schema("speaker STRING, channel STRING, text STRING").json(path)


@query("written_training_set", SQL["training_lengths"])
def written_training_set(spark, sf):
    """The training set as files by split, read back."""
    path = folder(spark)
    rows = stage(C.training_prefix(Q.corpus(spark, sf)).select("stream_id", "line_no", "tokens", "slot", "text"))
    T.write_training_set(C.training_set(rows, lambda s: [len(w) for w in s.split()], vocab_size=1000, eos=2, pad=0), {"vocab": 1000}, path)
    out = spark.read.parquet(f"{path}/sequences").filter(F.size("seq") == F.col("full_len"))
    return out.groupBy("prefix_len", "full_len").agg(F.count(F.lit(1)).alias("n"))


_NOW, _DAYS = 1704067200 + 3 * 86400 + 10_800, 3


@query("retained_store", f"WITH {EV} SELECT stream_id, count(*) AS n, min(ts) AS first FROM ev WHERE ts >= {_NOW - _DAYS * 86400} GROUP BY ALL")
def retained_store(spark, sf):
    """The stored events after the scheduled job."""
    path = folder(spark)
    B.write_events(combat_events(spark, sf), path)
    M.retention(spark, path, _NOW, _DAYS)
    return B.read_events(spark, path).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
