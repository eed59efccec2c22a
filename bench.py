"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores.  Each query runs once to warm up, then three
times while that takes under 20 seconds in all (``BENCH_RUNS``, ``BENCH_SECONDS``); the median counts.  Rows go to the no-op
sink, so every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skirmish.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "damage_from_text", "classified_events", "pattern_cascade", "parsed_fields", "parse_loot_lines", "log_times",
    "damage_by_player", "damage_by_spell", "healing_by_player", "tanked_by_player", "hit_ranges", "breakdown", "timeline",
    "instance_of_line", "mob_instances", "instance_damage", "meter_damage", "pulls", "pull_summary", "named_mobs",
    "loot_summary", "sessionize", "session_summary", "segments", "assign_scope", "event_batches", "event_store",
    "apply_rules", "preset_hits", "rules_with_variables", "rule_hits_by_line", "correlate_chat", "extract_corpus",
    "speaker_features", "rank_archetypes", "ngram_precision_2",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # The tables are one file of one row group each, which no setting splits.
        .config("skirmish.spread", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    out: dict[str, float] = {}
    for name in names:
        times: list[float] = []
        for n in range(int(os.environ.get("BENCH_RUNS", "3")) + 1):
            t = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
            if n and sum(times) + times[-1] > float(os.environ.get("BENCH_SECONDS", "20")):
                break
        out[name] = round(statistics.median(times[1:]), 3)
        print(f"{name:24s} {out[name]:7.2f}", file=sys.stderr, flush=True)
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    lines = {}
    for rate, query, each in (("log_lines_parsed_per_sec", "parsed_fields", 1), ("line_rule_evaluations_per_sec", "preset_hits", 16), ("lines_segmented_per_sec", "instance_of_line", 1)):
        if query in out:
            lines[rate] = round(n * each / out[query])
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf), **lines}))
    spark.stop()


if __name__ == "__main__":
    main()
