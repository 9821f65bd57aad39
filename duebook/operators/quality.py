"""Checks of the rules that plain files do not enforce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.operators.audit import AUDIT_KEY
from duebook.operators.validation import KEY
from duebook.session import write_and_read


def orphans(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows whose job is not in the ledger."""
    known = jobs.select(F.col("id").alias("job_id"))
    return rows.join(known, "job_id", "left_anti")


def _row_rules(table: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    facts = [
        F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.count_if(broken).alias("violations"))
        for rule, broken in rules.items()
    ]
    return table.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def _unique(table: DataFrame, name: str, key: list[str]) -> DataFrame:
    copies = table.groupBy(*key).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("violations")
    ).select(
        F.lit(name).alias("table_name"),
        F.lit("unique " + ", ".join(key)).alias("rule"),
        "violations",
    )


def _known_job(table: DataFrame, name: str, jobs: DataFrame) -> DataFrame:
    per_job = table.groupBy("job_id").agg(F.count("*").alias("_n"))
    return orphans(per_job, jobs).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations")
    ).select(F.lit(name).alias("table_name"), F.lit("job_id in jobs").alias("rule"), "violations")


def constraint_audit(jobs: DataFrame, audit: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per table and rule with the number of violations.

    What the rules read of each table is written once, as several of them read it.
    """
    state = F.when(F.col("invoice_state_json").isNotNull(), F.lit("")).alias("invoice_state_json")
    jobs = write_and_read(jobs.select("id", "file_path", "file_hash", "status", "created_at"), "checked-jobs")
    audit = write_and_read(audit.select(*AUDIT_KEY, "client", "created_at"), "checked-audit")
    failures = write_and_read(failures.select(*KEY, state, "status", "created_at", "updated_at"), "checked-failures")

    def missing(*names: str) -> dict[str, Column]:
        return {f"{n} not null": F.col(n).isNull() for n in names}

    def outside(column: str, values: list[str]) -> dict[str, Column]:
        return {f"{column} accepted": F.col(column).isNotNull() & ~F.col(column).isin(*values)}

    parts = [
        _row_rules(
            jobs, "jobs",
            missing("file_path", "file_hash", "status", "created_at") | outside("status", fv.JOB_STATUSES),
        ),
        _row_rules(audit, "audit_logs", missing("job_id", "invoice_no", "client", "created_at")),
        _row_rules(
            failures, "failed_invoices",
            missing("job_id", "invoice_no", "invoice_state_json", "status", "created_at", "updated_at")
            | outside("status", fv.QUEUE_STATUSES),
        ),
        _unique(jobs, "jobs", ["id"]),
        _unique(audit, "audit_logs", AUDIT_KEY),
        _unique(failures, "failed_invoices", KEY),
        _known_job(audit, "audit_logs", jobs),
        _known_job(failures, "failed_invoices", jobs),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
