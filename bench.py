"""Headline bench: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritab.plans import load_all  # noqa: E402
from veritab.session import local_session  # noqa: E402

HEADLINE = [
    "d19_confirmed_relations", "d15_relation_fit", "f7_bootstrap_stability", "d17_invariant_check",
    "b1_event_validation", "e1_gap_filter", "e2_episodes", "d1_skill_model",
    "b2_quality_assessment", "f1_grouped_split", "f3_connected_components", "c3_evidence_anti_join",
    "d3_pearson_relevance", "d4_spearman_relevance", "c11_distance_correlation", "d9_selection_evaluation",
    "d23_trajectory_features", "d27_split_gain", "e11_guided_promotion", "f4_changepoints",
    "e6_pareto_front", "f11_novelty", "e14_acquisition_plan", "b14_rule_checks",
    "g2_sections", "g5_protected_spans", "c6_quote_location", "c8_cross_references", "e9_sparse_relations", "f18_hierarchy_checks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries = load_all().QUERIES
    names = list(queries) if "--all" in sys.argv else HEADLINE
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if "--all" in sys.argv:
            print(f"{seconds[name]:8.2f} {name}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(found.group(1)) if found else None}))


if __name__ == "__main__":
    main()
