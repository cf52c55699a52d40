"""Times of the headline queries: one JSON line.

Each query writes all its rows to the noop sink. Batch queries run twice and the second
time counts; streams run once, start to end of input, results included.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession, functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from keyfold import catalog, names  # noqa: E402
from keyfold.operators import (  # noqa: E402
    aggregating_state,
    histogram_rows,
    list_parts,
    reducing_state,
    value_state,
)
from keyfold.plans.five_state import keyed_state  # noqa: E402
from keyfold.sources import events_keyed, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def lineitem_keyed(spark):
    """The larger table, for operators that need no order."""
    return table(spark, SF_DIR, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.col("l_linenumber").cast("bigint").alias("value")
    )


BATCH = [
    "value_state",
    "value_state_running",
    "value_state_running_split",
    "reducing_state",
    "reducing_state_function",
    "aggregating_state",
    "aggregating_state_merge",
    "list_state",
    "list_state_long",
    "list_state_parts",
    "map_state",
    "map_state_long",
    "keyed_route",
    "five_state",
    "five_state_lines",
    "five_state_split",
    "check_sum",
    "check_list",
    "check_map",
    "check_report",
]
STREAMS = [
    "end_of_input_flush",
    "checkpoint_restart",
    "savepoint_restore",
    "rescale_restore",
    "backend_switch_restore",
    "state_scan",
    "state_variable_scan",
    "processor_functions_restore",
]
# One pass over the five operators, against one query each.
COMPARED = {
    "five_in_one_pass": lambda spark: [keyed_state(events_keyed(spark, SF_DIR))],
    "five_in_five_passes": lambda spark: [
        value_state(events_keyed(spark, SF_DIR)),
        reducing_state(events_keyed(spark, SF_DIR)),
        aggregating_state(events_keyed(spark, SF_DIR)),
        list_parts(events_keyed(spark, SF_DIR)),
        histogram_rows(events_keyed(spark, SF_DIR)),
    ],
    "lineitem_value_state": lambda spark: [value_state(lineitem_keyed(spark))],
    "lineitem_map_state_long": lambda spark: [histogram_rows(lineitem_keyed(spark))],
}


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in BATCH:
        query = catalog.QUERIES[name]
        timed(lambda: consume(query(spark, SF_DIR)))
        seconds[name] = timed(lambda: consume(query(spark, SF_DIR)))
    for name, make in COMPARED.items():
        timed(lambda: [consume(df) for df in make(spark)])
        seconds[name] = timed(lambda: [consume(df) for df in make(spark)])
    for name in STREAMS:
        seconds[name] = timed(lambda: consume(catalog.QUERIES[name](spark, SF_DIR)))
    print(
        json.dumps(
            {
                "metric": "total time of the keyed-state queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "events": table(spark, SF_DIR, "events").count(),
                "operators": list(names.OPERATORS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
