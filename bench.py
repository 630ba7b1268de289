"""Time all registered queries but the text operators and the pipeline, and print one JSON line.

The check tool alone measures those.

Each query runs twice on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; the
second run counts, so that code generation and file listing do not.  Queries that
write tables of their own (streams, round trips, layouts, the gold refresh) run once.  The
result goes to Spark's ``noop`` sink, which reads every row and keeps none.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from millwatch.session import build_session, clear_scratch  # noqa: E402

ONCE = ("stream_", "gold_r", "table_", "work_order_append", "constraint_violations_by_batch")
ONCE_ENDS = ("_clustered", "_from_summaries")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")  # one machine: a folder of its own is shared enough
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=f"{folder}/shared", spark__sql__warehouse__dir=f"{folder}/warehouse",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in registry.QUERIES.items():
        for _ in range(1 if name.startswith(ONCE) or name.endswith(ONCE_ENDS) else 2):
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
