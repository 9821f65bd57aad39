"""What plans look like, and what happens when one key holds a third of the rows."""

import datetime as dt
import re

from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.text import strip
from duebook.operators import audit, batching, drafts, failures, hot_keys, metrics, normalize, outcomes, profiling, quality, validation
from duebook.schemas import AUDIT
from duebook.session import write_and_read
from duebook.sources import star
from duebook.sources import tables as tables_module
from duebook.sources.tables import PartitionedTable

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    return star.staged(spark, FOLDER), star.drafts(spark, FOLDER), star.send_results(spark, FOLDER)


def test_no_python_and_small_tables_broadcast(spark):
    staged, draft, sends = tables(spark)
    text = plan(outcomes.audit_rows(outcomes.decide_outcomes(staged, draft, sends), star.now()))
    assert "Python" not in text
    assert "BroadcastHashJoin [stage_key" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_each_input_is_shuffled_once_for_the_outcome(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        raw = write_and_read(star.invoices_balanced(spark, FOLDER), "raw")
        draft = write_and_read(star.drafts(spark, FOLDER), "drafts")
        sends = write_and_read(star.send_results(spark, FOLDER), "sends")
        staged = normalize.stage_invoices(normalize.normalize_invoices(raw), star.as_of())
        text = plan(outcomes.decide_outcomes(staged, draft, sends))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(job_id#\d+L, invoice_no#\d+", text)) == 3
    assert "SinglePartition" not in text


def test_filters_and_columns_reach_the_scan(spark):
    path = write_and_read(star.failed_queue(spark, FOLDER), "queue")
    text = plan(failures.due_failures(path, star.now(), None).select("invoice_no"))
    assert "EqualTo(status,pending)" in text and "LessThanOrEqual(next_retry_at" in text
    assert "ReadSchema: struct<invoice_no:string,next_retry_at:timestamp,status:string>" in text


def test_first_wins_is_cut_before_the_shuffle(spark):
    rows = star.attempts(spark, FOLDER).select(
        "job_id", "invoice_no", F.lit("sent").alias("send_status"), F.lit(0).alias("retry_count"), "attempt"
    )
    assert "WindowGroupLimit" in plan(audit.first_per_key(rows, ["attempt"]))


def test_a_drafts_text_is_made_searchable_once(spark):
    staged, draft, _ = tables(spark)
    text = plan(validation.judge_drafts(drafts.with_subject(staged), draft, strict=True))
    assert text.count("regexp_replace(concat_ws(") == 1


def test_whole_audit_rows_are_shuffled_only_where_they_must_be(spark):
    kind = "job_id long, invoice_no string, send_status string, retry_count int, created_at timestamp"
    now = dt.datetime(2026, 5, 14)
    rows = spark.createDataFrame([(1, "A", "sent", 0, now), (1, None, None, 0, now), (1, "B", "sent", 0, now)], kind)
    old = spark.createDataFrame([(1, None, None, 0, now), (2, "A", "sent", 0, now)], kind)
    none = audit.key_counts(rows, tables_module.no_rows(spark, rows.schema))
    assert none.asDict() == {"known": 0, "fresh": 3, "repeated": 0}
    assert "Exchange" not in plan(audit.new_audit_rows(rows, old.limit(0), counts=none))
    some = audit.key_counts(rows.union(rows), old)
    assert some.asDict() == {"known": 1, "fresh": 2, "repeated": 2}
    added = audit.new_audit_rows(rows.union(rows), old, counts=some)
    assert sorted(r.invoice_no for r in added.collect()) == ["A", "B"]


def test_a_run_again_appends_no_audit_rows(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "audit"), AUDIT)
    rows = write_and_read(outcomes.audit_rows(outcomes.decide_outcomes(*tables(spark)), star.now()), "rows")
    audit.append_new(table, rows.union(rows), list(range(star.JOBS)))
    files = sorted(tmp_path.rglob("*.parquet"))
    audit.append_new(table, rows, list(range(star.JOBS)))
    assert sorted(tmp_path.rglob("*.parquet")) == files
    assert table.read().exceptAll(rows).count() == 0 and rows.exceptAll(table.read()).count() == 0


def test_the_checks_work_each_table_out_once(spark):
    times = "timestamp'2026-05-14' AS created_at, timestamp'2026-05-14' AS updated_at"
    rows = spark.range(3).selectExpr(
        "id", "id AS job_id", "'A' AS invoice_no", "'c' AS client", "'sent' AS send_status", "0 AS retry_count", "'{}' AS invoice_state_json",
        "'queued' AS status", "'p' AS file_path", "IF(id = 0, NULL, 'h') AS file_hash", *times.split(", "),
    )
    report = quality.constraint_audit(rows, rows, rows.withColumn("invoice_state_json", F.lit(None).cast("string")))
    assert "Range (" not in plan(report)
    found = {(r.table_name, r.rule): r.violations for r in report.collect() if r.violations}
    assert found == {
        ("jobs", "file_hash not null"): 1, ("failed_invoices", "invoice_state_json not null"): 3, ("failed_invoices", "status accepted"): 3,
    }


def test_metrics_are_combined_before_the_shuffle(spark):
    assert "partial_count" in plan(metrics.job_metrics(outcomes.decide_outcomes(*tables(spark))))


def test_batches_do_not_gather_a_stage(spark):
    rows = star.staged(spark, FOLDER, balanced=False).select("job_id", "stage_key", "invoice_no")
    text = plan(batching.assign_batches(rows))
    windows = [line for line in text.splitlines() if " Window " in line]
    assert windows and all("_rows" in line or "_stage_rows" in line for line in windows)


def crowded(spark):
    """Nine thousand invoices, a third of them with one number."""
    day = dt.date(2026, 5, 4)
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    raw = spark.range(0, 9000, 1, 12).select(
        F.lit(1).cast("long").alias("job_id"),
        F.concat(F.lit("N"), key.cast("string")).alias("invoice_number"),
        F.concat(F.lit("Client "), F.col("id").cast("string")).alias("client_name"),
        F.lit("a@b.co").alias("recipient_email"),
        F.col("id").cast("double").alias("amount"),
        F.lit(day).alias("due_date"),
    )
    return normalize.stage_invoices(normalize.normalize_invoices(raw), F.lit(dt.date(2026, 5, 14)))


def test_a_crowded_number_is_spread_and_gives_the_same_rows(spark):
    staged = crowded(spark)
    draft = write_and_read(drafts.template_drafts(staged).dropDuplicates(["job_id", "invoice_no"]), "drafts")
    hot = hot_keys.find_hot_keys(staged, ["job_id", "invoice_no"], rows_per_task=300, fraction=0.2)
    assert [(r.invoice_no, 8 <= r["_parts"] <= 13) for r in hot.table.collect()] == [("N0", True)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = hot_keys.spread_join(staged, drafts_side(draft), ["job_id", "invoice_no"], hot)
        per_task = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert joined.count() == 9000 and joined.filter(F.col("subject").isNull()).count() == 0
    assert per_task < 3000
    columns = ["invoice_no", "client", "outcome", "send_error", "retry_count"]
    plain = outcomes.decide_outcomes(staged, draft).select(*columns)
    spread = outcomes.decide_outcomes(staged, draft, rows_per_task=300).select(*columns)
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    assert plain.count() == 9000


def drafts_side(draft):
    return draft.select("job_id", "invoice_no", "subject")


def test_nothing_is_spread_without_a_crowded_key(spark):
    rows = star.send_results(spark, FOLDER)
    assert hot_keys.find_hot_keys(rows, ["job_id", "invoice_no"]) is None


def test_copies_collapse_before_the_shuffle_in_profiles(spark):
    table = spark.range(0, 9000, 1, 6).select(F.when(F.col("id") % 3 != 0, F.col("id")).otherwise(F.lit(-1)).alias("v"))
    assert profiling.duplicate_rows(table).first()[0] == 2999
    assert "partial_count" in plan(profiling.duplicate_rows(table))


def test_rows_read_by_job_are_written_unshuffled(spark, tmp_path):
    rows = write_and_read(outcomes.audit_rows(outcomes.decide_outcomes(*tables(spark)), star.now()), "rows")
    by_job, table = (PartitionedTable(spark, str(tmp_path / name), AUDIT) for name in ("by_job", "audit"))
    by_job.append(rows)
    jobs = list(range(star.JOBS))
    audit.append_new(table, by_job.read(jobs), jobs, by_job=True)
    assert len(list((tmp_path / "audit").rglob("*.parquet"))) <= len(list((tmp_path / "by_job").rglob("*.parquet")))
    assert table.read().exceptAll(rows).count() == 0 and rows.exceptAll(table.read()).count() == 0
    audit.append_new(table, by_job.read(jobs), jobs, by_job=True)
    assert table.read().count() == rows.count()


def test_the_fold_shuffles_no_marks_and_sorts_its_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        staged, draft, sends = (write_and_read(rows, "fold") for rows in tables(spark))
        lines = plan(outcomes.decide_outcomes(staged, draft, sends)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    fold = next(k for k, line in enumerate(lines) if "Generate inline" in line)
    assert not any(" Sort [" in line for line in lines[:fold])
    shuffled = [lines[k + 1] for k, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 3 and not any("_asked" in line for line in shuffled)


def test_white_space_is_cut_from_either_end_alone(spark):
    blanks = fv.WHITE_SPACE
    texts = ["", "a", "a b", *(f"{b}a{c}b" for b in blanks for c in "x　"), *(f"é{b}a{b}" for b in blanks), blanks, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("cut")).collect()
    assert [r.cut for r in rows] == [None if r.t is None else r.t.strip(blanks) for r in rows]
