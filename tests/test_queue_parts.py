"""The queue in hash parts: what an update writes, and what happens when two writers meet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duebook.operators import drafts, normalize
from duebook.plans.followup import Store, run_follow_up
from duebook.plans.retry_cycle import run_retry_cycle
from duebook.sources.tables import ConcurrentUpdate, KeyedTable, create_once, read_small

AS_OF, NOW = dt.date(2026, 5, 14), dt.datetime(2026, 5, 14, 13)
KIND = "k string, x int"


def keyed(spark, tmp_path, **more):
    return KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], KIND).schema, ["k"], 50, **more)


def put(spark, rows):
    new = spark.createDataFrame(rows, KIND)
    return new, lambda old: old.join(new, "k", "left_anti").unionByName(new)


def test_only_touched_parts_are_written(spark, tmp_path):
    table = keyed(spark, tmp_path, keep=2)
    assert table.read().count() == 0 and table.rewrite(*put(spark, [])) == 0
    table.rewrite(*put(spark, [(f"k{n}", n) for n in range(500)]))
    before = table.folders(1)
    assert table.rewrite(*put(spark, [("k7", -7), ("new", 1), (None, 2)])) <= 3
    after = table.folders(2)
    assert sum(before.get(p) != after.get(p) for p in range(50)) <= 3
    rows = {r.k: r.x for r in table.read().collect()}
    assert len(rows) == 502 and (rows["k7"], rows["new"], rows[None], rows["k8"]) == (-7, 1, 2, 8)
    table.rewrite(spark.createDataFrame([("new",)], "k string"), lambda old: old.filter("k <> 'new'"))
    assert table.versions() == [2, 3] and table.read().filter("k = 'new'").count() == 0
    with pytest.raises(ValueError, match="other keys"):
        table.rewrite(spark.createDataFrame([("k1",)], "k string"), lambda old: put(spark, [(f"k{n}", 0) for n in range(99)])[0])


def test_a_second_writer_works_on_what_the_first_left(spark, tmp_path):
    table, calls = keyed(spark, tmp_path), []
    keys, change = put(spark, [("a", 1)])

    def meanwhile(old):
        if not calls:
            keyed(spark, tmp_path).rewrite(*put(spark, [("b", 2), ("a", 0)]))
        calls.append(1)
        return change(old)

    table.rewrite(keys, meanwhile)
    assert len(calls) == 2 and {r.k: r.x for r in table.read().collect()} == {"a": 1, "b": 2}

    def always(old):
        keyed(spark, tmp_path).rewrite(*put(spark, [("b", 3)]))
        return change(old)

    with pytest.raises(ConcurrentUpdate):
        table.rewrite(keys, always, tries=2)


def test_a_file_is_created_once(spark, tmp_path):
    path = str(tmp_path / "claim")
    assert create_once(spark, path, "one é") and not create_once(spark, path, "two")
    assert read_small(spark, path) == "one é" and [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["claim"]


def raw(spark, numbers, client="Client"):
    rows = [(1, f"N{n}", client, f"c{n}@b.co", 1.0, AS_OF - dt.timedelta(days=5)) for n in numbers]
    return spark.createDataFrame(rows, "job_id long, invoice_number string, client_name string, recipient_email string, amount double, due_date date")


def run(store, rows, now=NOW):
    staged = normalize.stage_invoices(normalize.normalize_invoices(rows), F.lit(AS_OF))
    made = drafts.template_drafts(staged)
    sends = made.select("job_id", "invoice_no", F.lit(False).alias("success"), F.lit("mailer").alias("provider"), F.lit("timeout").alias("message"))
    run_follow_up(store, rows, made, AS_OF, now, sends)
    return made, sends


def test_entries_of_invoices_that_went_are_closed(spark, tmp_path):
    store = Store(spark, str(tmp_path), queue_parts=8)
    run(store, raw(spark, range(6)))
    run(store, raw(spark, range(3)).unionByName(raw(spark, [3], client=" ")), NOW + dt.timedelta(hours=1))
    status = {r.invoice_no: r.status for r in store.queue.read().collect()}
    assert status == {"N0": "pending", "N1": "pending", "N2": "pending", "N3": "resolved", "N4": "resolved", "N5": "resolved"}


def test_a_row_per_retry(spark, tmp_path):
    found = []
    for row_per_retry in (False, True):
        store = Store(spark, str(tmp_path / str(row_per_retry)), queue_parts=4)
        made, sends = run(store, raw(spark, range(2)))
        soft = sends.withColumn("message", F.lit("timeout again"))
        for hours in (2, 6):
            run_retry_cycle(store, made, NOW + dt.timedelta(hours=hours), soft, row_per_retry=row_per_retry)
        found.append(store.audit.read().filter("send_status = 'failed'").count())
        counts = {r.retry_count for r in store.queue.read().collect()}
        assert counts == {2}
    assert found[0] < found[1] == 6
