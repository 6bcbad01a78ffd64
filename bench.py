"""Time the headline queries: BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from boutline.plans import load_all, registry  # noqa: E402
from boutline.session import local_session  # noqa: E402

HEADLINE = (
    "wasted_rate_by_slot", "burst", "idle", "moments", "moment_cluster", "habit_metrics", "profile_report", "match_list", "match_outcome", "pressure",
    "death_context", "damage_resets", "damage_at", "align_offset", "press_groups", "tendency", "payoff_matrix", "death_review",
    "segments", "frozen_spans", "moves", "stuck_windows", "openings", "combos", "punish_join", "input_log", "caption_events",
    "template_match", "fuzzy_snap", "findings", "opponent_habits", "parse_combo", "page_blocks", "concept_tags", "doc_build", "doc_signature", "audit",
    "matchup", "progress_levels", "session_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    load_all()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # start the engine
    times, start = {}, time.time()
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(time.time() - start, 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
