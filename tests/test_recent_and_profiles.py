"""Newest pages out of folders by time, profiles out of stored sketches, and exports."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook.operators import profiling, views
from duebook.sources import files
from duebook.sources.recent import RecentTable
from duebook.sources.tables import PartitionedTable

START = dt.datetime(2026, 1, 1)
KIND = "created_at timestamp, job_id long, invoice_no string"


def hours(spark, first, last, per_hour=10):
    rows = spark.range(first * per_hour, last * per_hour)
    at = F.lit(START) + F.make_dt_interval(hours=F.floor(F.col("id") / per_hour).cast("int"), mins=(F.col("id") % per_hour).cast("int"))
    return rows.select(at.alias("created_at"), (F.col("id") % 3).alias("job_id"), F.col("id").cast("string").alias("invoice_no"))


def recent(spark, tmp_path, seconds=3600):
    return RecentTable(spark, str(tmp_path / "feed"), spark.createDataFrame([], KIND).schema, seconds)


def test_newest_pages_open_as_many_files_whatever_the_history(spark, tmp_path):
    table, opened = recent(spark, tmp_path), []
    assert table.newest(5).count() == 0 and table.spans() == [] and table.read().count() == 0
    for first in (0, 20, 40, 60):
        table.append(hours(spark, first, first + 20))
        found = table.newest(25)
        opened.append(len({name.split("_span=")[1].split("/")[0] for name in found.inputFiles()}))
        wanted = views.email_feed(hours(spark, 0, first + 20), limit=25).collect()
        assert views.email_feed(found, limit=25).collect() == wanted
    assert opened == [4, 4, 4, 4]


def test_newest_of_a_view_from_a_time_on(spark, tmp_path):
    table = recent(spark, tmp_path)
    rows = hours(spark, 0, 30).unionByName(spark.createDataFrame([(None, 1, "x"), (None, 2, "y")], KIND))
    table.append(rows)
    at = START + dt.timedelta(hours=12, minutes=5)

    def page(t):
        return views.next_page(t.filter("job_id = 1"), (at, 10**6, "~"), 7)

    assert page(table.newest(7, page, at=at)).collect() == page(rows).collect()
    rare = table.newest(1, lambda t: t.filter("invoice_no = 'y'")).collect()
    assert [(r.created_at, r.invoice_no) for r in rare] == [(None, "y")]
    assert table.spans()[-1] is None and table.read().count() == rows.count()
    assert table.newest(10**6).count() == rows.count()
    with pytest.raises(ValueError):
        RecentTable(spark, "x", table.schema, 0)


def test_times_before_1970_and_repeated_appends(spark, tmp_path):
    table = recent(spark, tmp_path, 86400)
    old = spark.createDataFrame([(dt.datetime(1969, 12, 30), 1, "old"), (dt.datetime(1970, 1, 5), 1, "new")], KIND)
    table.append(old)
    table.append(old)
    assert table.spans() == [4, -2]
    assert [r.invoice_no for r in table.newest(2).collect()] == ["new", "new"]


def test_an_append_over_many_spans_makes_few_folders(spark, tmp_path):
    table = RecentTable(spark, str(tmp_path / "feed"), spark.createDataFrame([], KIND).schema, 3600, most_folders=10)
    rows, late = hours(spark, 0, 300), hours(spark, 290, 295, per_hour=3)
    table.append(rows)
    assert len(table.spans()) <= 10 and table.read().count() == rows.count()
    table.append(late)  # in folders of an hour, next to a wide one that ends later
    everything = rows.unionByName(late)
    for n in (1, 25, 200, 2000):
        assert views.email_feed(table.newest(n), limit=n).collect() == views.email_feed(everything, limit=n).collect()
    at = START + dt.timedelta(hours=100, minutes=30)

    def page(t):
        return views.next_page(t.filter("job_id = 1"), (at, 10**6, "~"), 7)

    assert page(table.newest(7, page, at=at)).collect() == page(everything).collect()


def test_a_wide_folder_does_not_hide_later_rows_of_the_next(spark, tmp_path):
    table = RecentTable(spark, str(tmp_path / "feed"), spark.createDataFrame([], KIND).schema, 3600, most_folders=1)
    table.append(hours(spark, 0, 60, per_hour=1))
    table.append(spark.createDataFrame([(START + dt.timedelta(hours=61), 1, "new")], KIND))
    wide, narrow = table.folders()
    assert wide.width > 1 == narrow.width and narrow.last < wide.last
    assert [r.invoice_no for r in views.email_feed(table.newest(1), limit=1).collect()] == ["new"]


def test_profile_out_of_stored_sketches(spark, tmp_path):
    rows = spark.range(60000).select(
        (F.col("id") % 4).alias("job_id"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("numbers"),
        F.concat(F.lit("c"), F.col("id") % 700).alias("client"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("id") % 2 == 0, "true").otherwise("False").alias("flag"),
        F.when(F.col("id") < 30000, "1").otherwise("1.5").alias("mixed"),
    )
    sketches = profiling.profile_sketches(rows)
    table = PartitionedTable(spark, str(tmp_path / "profiles"), sketches.schema)
    table.replace(sketches)
    table.replace(profiling.profile_sketches(rows.filter("job_id = 2")))  # a job run again counts once
    exact = {r.column_name: r for r in profiling.column_profile(rows).collect()}
    found = {r.column_name: r for r in profiling.profile_from_sketches(table.read()).collect()}
    assert found.keys() == exact.keys()
    for name, row in exact.items():
        assert (found[name].type, found[name].filled_percent) == (row.type, row.filled_percent)
        assert abs(found[name].unique_values - row.unique_values) <= 0.02 * row.unique_values
    one = profiling.profile_from_sketches(table.read([3])).filter("column_name = 'job_id'").first()
    assert one.unique_values == 1
    assert profiling.profile_from_sketches(table.read().limit(0)).count() == 0


def test_groups_with_different_types_count_as_text(spark):
    a = profiling.profile_sketches(spark.createDataFrame([(1, 5)], "job_id long, x long"))
    b = profiling.profile_sketches(spark.createDataFrame([(2, "a")], "job_id long, x string"))
    found = {r.column_name: r.type for r in profiling.profile_from_sketches(a.unionByName(b)).collect()}
    assert found == {"job_id": "bigint", "x": "object"}


def test_exports_keep_blanks_quotes_and_lines(spark, tmp_path):
    kind = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    rows = [(" x ", 'say "hi", twice'), ("two\nlines", "tab\t"), ("é", None)]
    files.export_csv(spark.createDataFrame(rows, kind), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(kind).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(rows, key=lambda r: r[0])
