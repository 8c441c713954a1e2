"""Headline timings: one JSON line on stdout."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg_summary", "clean_bars", "fill_small_gaps", "pit_eligibility", "ind_sma", "wt_ensemble", "acct_stream", "pf_rule", "dd_throttle",
    "wf_select_argmax", "wf_candidate_records", "sw_cost", "bs_metrics", "mt_reality_check", "cl_clusters", "agg_regime_perf", "au_classify_evidence",
    "au_hash_chain", "au_running_balance", "st_tumbling", "st_sleeve_state",
]


def main() -> None:
    from barloom import catalog
    from barloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "barloom-bench")
    catalog.load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the executors
    timings = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
