"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from duebook.session import build_session  # noqa: E402
from registry import QUERIES  # noqa: E402

HEADLINE = [
    "receivables_by_stage",
    "due_dates_day_first",
    "accepted_invoices",
    "subject_lines",
    "prompt_texts",
    "ready_made_drafts",
    "draft_rulings",
    "invoice_outcomes",
    "attempt_fold",
    "audit_records",
    "first_audit_rows",
    "queue_upsert",
    "retry_transitions",
    "job_ledger",
    "job_metrics",
    "email_feed",
    "duplicate_documents",
    "column_profile",
    "invoice_batches",
    "follow_up_run",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "duebook-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["receivables_by_stage"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    invoices = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
                "invoices": invoices,
                "invoices_per_second_full_run": round(invoices / seconds["follow_up_run"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
