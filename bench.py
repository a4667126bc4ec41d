"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables and ``BENCH_CPUS`` the number of cores.
Arguments, if any, name the queries to run. The first query runs twice; its first time, of a
session without compiled code, is given apart as ``cold`` and is not part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

from repoaudit.plans.queries import ALL
from repoaudit.session import local_session

HEADLINE = (
    "security_category_counts",
    "security_findings",
    "security_ranked_top10",
    "raw_text_rules",
    "dependencies_dedup",
    "dependency_findings",
    "typosquat_popular",
    "typosquat_known_table",
    "registry_lookup",
    "package_age_downloads",
    "api_findings",
    "risk_score",
    "markdown_report",
    "json_report_fields",
    "audit_reports",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).write.format("noop").mode("overwrite").save()  # start the session
    names = sys.argv[1:] or HEADLINE

    def timed(name: str) -> float:
        begin = time.perf_counter()
        ALL[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    cold = {names[0]: timed(names[0])}  # the first query also pays for compilation
    times = {name: timed(name) for name in names}
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "cold": cold, "sf": sf}
        )
    )


if __name__ == "__main__":
    main()
