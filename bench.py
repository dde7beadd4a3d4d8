"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tersa import Analysis, Step, execute_plan, kpi_report, profile, quality_issues  # noqa: E402
from tersa.operators.catalog import apply_operation  # noqa: E402
from tersa.sources.checkpoints import drop_checkpoints  # noqa: E402
from tersa.workload.queries import QUERIES  # noqa: E402
from tersa.workload.views import table, view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    """Compute every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def profile_lineitem(spark):
    run(profile(table(spark, SF_DIR, "lineitem"), order_by="l_orderkey"))


def quality_orders(spark):
    run(quality_issues(Analysis(view(spark, SF_DIR, "pedidos"), order_by="id_pedido")))


def clean_with_audit(spark):
    steps = [
        Step("trim_text", "prioridad"), Step("normalize_case", "prioridad", {"mode": "title"}),
        Step("fill_missing", "prioridad"), Step("convert_datetime", "fecha_pedido"),
        Step("fill_missing", "total", {"strategy": "median"}),
        Step("clamp_range", "total", {"min_value": 0, "max_value": 400000.0}),
    ]
    watched = execute_plan(view(spark, SF_DIR, "pedidos"), steps).watched()
    run(watched.frame)
    run(watched.audit())


def dedup_lineitem_by_key(spark):
    df = table(spark, SF_DIR, "lineitem")
    run(apply_operation(df, "remove_duplicates", order_by="l_shipdate", subset_columns=["l_orderkey", "l_linenumber"]))


def kpi_sales(spark):
    report = kpi_report(view(spark, SF_DIR, "ventas"))
    run(report.kpis)
    run(report.breakdown)


def registered(name):
    return lambda spark: run(QUERIES[name](spark, SF_DIR))


BENCH = {
    "profile_lineitem": profile_lineitem,
    "quality_orders": quality_orders,
    "clean_with_audit": clean_with_audit,
    "dedup_lineitem_by_key": dedup_lineitem_by_key,
    "kpi_sales": kpi_sales,
    "flagship": registered("flagship_clean_and_aggregate"),
    "propose_plan": registered("r11_propose_plan"),
    "execute_plan": registered("e1_execute_plan"),
    "mask_documents": registered("a2_mask_embedded"),
    "round_lineitem": registered("t6_round_numeric"),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        # One process: a folder of its own stands in for the cluster's shared one.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, SF_DIR, "lineitem").count()
    seconds = {}
    for name, query in BENCH.items():
        start = time.perf_counter()
        query(spark)
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    drop_checkpoints(spark)
    spark.stop()


if __name__ == "__main__":
    main()
