"""All queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line with the seconds of each.

A catalogued query runs once to warm up; of the two runs of a headline query that follow the faster one counts, of others one is
timed. The operators for training data run once. Every row of a result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The queries whose seconds make up the metric, the same in every round: row decisions first, then relations.
NAMES = (
    "complete_default", "complete_clauses_or", "else_chain", "user_function_else", "function_patterns", "floor_div_mod", "str_case_split_concat",
    "str_format", "casts", "types", "json_path", "with_input", "array_index_destructure",
    "deny_messages", "partial_set", "equi_join3", "semi_join_in_set", "anti_join_not", "every_anti", "comp_count", "comp_sum", "comp_max_min",
    "set_comp_distinct", "group_by_idiom", "all_any", "top_k", "set_ops", "nested_heads", "var_key_ref", "rule_composition",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from sparkpolicy.catalogue import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        began = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name, q in sorted(QUERIES.items(), key=lambda x: x[0] not in NAMES):
        timed(q.run)
        seconds[name] = round(min(timed(q.run) for _ in range(2 if name in NAMES else 1)), 4)
    try:  # the folder may be absent
        from sparkpolicy.llm.queries import QUERIES as operators
    except ImportError:
        operators = {}
    for name, run in operators.items():  # long enough to need no second run
        seconds[name] = round(timed(run), 4)
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").count()
    sf = Path(SF_DIR).name.removeprefix("sf")
    out = {"metric": "total_seconds", "value": round(sum(seconds[n] for n in NAMES), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "decisions_per_sec": round(orders / seconds["complete_default"])}
    print(json.dumps(out | {"catalogue_seconds": round(sum(seconds[n] for n in QUERIES), 3), "operator_seconds": round(sum(seconds[n] for n in operators), 3)}))


if __name__ == "__main__":
    main()
