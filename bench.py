"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores.  Every query runs in full into the no-op sink: best of two runs after
one warm-up of the session, plan building included.
"""

from __future__ import annotations

import json
import os
import time

from watchframe import session
from watchframe.plans import catalog

HEADLINE = [
    "c01_match_all_rules", "c02_first_match_alerts", "c03_worst_match_alerts",
    "c07_process_list_rule_alerts", "d01_brute_force_alerts", "d03_lineage_escalation_alerts",
    "d04_beacon_alerts", "d05_beacon_candidates", "d06_zscore_anomalies", "d10_request_quota",
    "d11_new_processes", "e13_threat_reports", "f01_match_playbooks", "f02_plan_actions",
    "g02_alert_overview", "g08_activity", "g09_stats", "h03_upsert_hosts", "i01_upsert_agents",
    "j02_redact", "j03_prompt_gate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = session("bench", f"local[{cpus}]", spark__ui__enabled="false",
                    spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
                    spark__sql__shuffle__partitions=str(max(8, int(cpus))))
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("d01_brute_force_alerts")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
