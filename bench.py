"""Time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pollspark.catalogue import REGISTRY
from pollspark.session import local_session

# Jobs of several steps that write and read back; by name they can be timed as well.
JOBS = {"document_rules", "dynamic_melt", "id_migration", "page_table", "source_files", "stream_routes"}


def headline(name: str) -> bool:
    return name not in JOBS and not name.startswith(("job_", "snapshot_"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    names = sys.argv[1:] or [n for n in REGISTRY if headline(n)]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # One untimed run starts the JVM's code paths and the Python workers.
    REGISTRY["period_share"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
