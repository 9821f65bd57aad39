import datetime as dt
import math
import sys

import pytest
from dateutil.parser import parse
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions import dates, errors, money, text
from duebook.operators.normalize import stage_for


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


BOUNDARY_DATES = [
    ("2026-05-12", (12, 5)), ("2026-05-13", (5, 13)), ("2026-13-05", (5, 13)),
    ("20260512", (12, 5)), ("2026/05/06", (6, 5)), ("05.06.2026", (6, 5)),
    ("01/02/2026", (2, 1)), ("02/13/2026", (2, 13)), ("1 May 2026", (5, 1)),
    ("May 3, 2026", (5, 3)), ("2026-05-12T00:00:00", (12, 5)), (" 2026-05-13 ", (5, 13)),
    ("", None), ("None", None), (None, None), ("2026-05/13", None), ("30 Feb 2026", None),
    ("2026-00-10", None), ("32/13/2026", None), ("29 feb 2024", (2, 29)),
]


def test_due_date_boundaries(spark):
    got = column(spark, [t for t, _ in BOUNDARY_DATES], "string", dates.parse_due_date)
    years = {"29 feb 2024": 2024}
    want = [
        None if md is None else dt.date(years.get(t, 2026), *md) for t, md in BOUNDARY_DATES
    ]
    assert got == want


def test_due_dates_equal_a_free_form_parser(spark):
    shapes = [
        "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y",
        "%d.%m.%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S",
        "%Y-%m-%d %H:%M",
    ]
    days = [dt.datetime(2023, 11, 3, 7, 5) + dt.timedelta(days=9 * i) for i in range(110)]
    texts = [day.strftime(shape) for shape in shapes for day in days]
    want = [parse(t, dayfirst=True).date() for t in texts]
    assert column(spark, texts, "string", dates.parse_due_date) == want


def test_iso_mode(spark):
    got = column(
        spark, ["2026-05-12", "20260512", "01/02/2026"], "string", lambda c: dates.parse_due_date(c, "iso")
    )
    assert got == [dt.date(2026, 5, 12), dt.date(2026, 5, 12), dt.date(2026, 2, 1)]
    with pytest.raises(ValueError):
        dates.parse_due_date(F.lit("x"), "other")


def test_stage_boundaries(spark):
    as_of = dt.date(2026, 5, 14)
    days = [-1, 0, 1, 7, 8, 14, 15, 21, 22, 30, 31, 365]
    due = [as_of - dt.timedelta(days=d) for d in days]
    late = column(spark, due, "date", lambda c: dates.days_overdue(c, F.lit(as_of)))
    assert late == [max(d, 0) for d in days]
    names = column(spark, due, "date", lambda c: stage_for(dates.days_overdue(c, F.lit(as_of))))
    assert names == ["No_overdue"] * 2 + ["1st Follow-Up"] * 2 + ["2nd Follow-Up"] * 2 + [
        "3rd Follow-Up"
    ] * 2 + ["4th Follow-Up"] * 2 + ["Escalation Flag"] * 2


def test_strip_cuts_what_python_cuts(spark):
    samples = [f"{c}a{c}b{c}" for c in fv.WHITE_SPACE] + ["​x​", "", "  "]
    assert column(spark, samples, "string", text.strip) == [s.strip() for s in samples]
    assert set(fv.WHITE_SPACE) == {chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()}


def test_masked_addresses(spark):
    given = [None, "", "x", "@d.com", "a@d.com", "ap@d.com", "abc@d.com", "a@b@c", "häßlich@d.com"]
    want = ["", "", "", "*@d.com", "a*@d.com", "a*@d.com", "ab*@d.com", "a*@b@c", "hä*****@d.com"]
    assert column(spark, given, "string", text.mask_email) == want


def test_numbers_print_as_in_python(spark):
    values = [0.5, 1.5, 2.5, 45250.75, 1234567.5, 0.125, 2.675, 0.0, 1e9 + 0.005, 99.995]
    assert column(spark, values, "double", lambda c: money.grouped_amount(c, 0)) == [f"{v:,.0f}" for v in values]
    assert column(spark, values, "double", lambda c: money.grouped_amount(c, 2)) == [f"{v:,.2f}" for v in values]
    assert column(spark, values, "double", lambda c: money.rounded(c, 2)) == [round(v, 2) for v in values]


def test_currency_texts(spark):
    given = ["INR 5", "$5", " 7 ", " € 3", "1234.5", "£1", "GBP9", "x"]
    want = ["INR 5", "$5", "INR 7.00", "€ 3", "INR 1,234.50", "£1", "GBP9", None]
    assert column(spark, given, "string", money.currency_text) == want


def test_rates_and_shares(spark):
    row = spark.range(1).select(
        money.percent(F.lit(1), F.lit(800), 2).alias("tie"),
        money.percent(F.lit(0), F.lit(0), 2).alias("empty"),
        *[c.alias(n) for n, c in money.outcome_shares(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).items()],
        money.live_progress(F.lit(9), F.lit(4)).alias("live"),
        money.count_or_zero(F.lit("12.9")).alias("cut"),
        money.count_or_zero(F.lit("NaN")).alias("nan"),
    ).first()
    assert (row.tie, row.empty, row.live, row.cut, row.nan) == (round(1 / 800 * 100, 2), 0.0, 1.0, 12, 0)
    assert (row.sent_share, row.remaining) == (0.0, 0)


def test_subject_keeps_placeholders_of_the_number(spark):
    row = spark.range(1).select(
        text.subject_line(
            F.lit("#{invoice_no} ₹{amount} ({days_overdue})"), F.lit("A{amount}{days_overdue}"), F.lit(45250.75), F.lit(9)
        ).alias("s")
    ).first()
    assert row.s == "#A{amount}{days_overdue} ₹45,251 (9)"


def test_fill_template_is_one_pass(spark):
    filled = text.fill_template("{{x}} {a} {b}", {"a": F.lit("{b}"), "b": F.lit(None).cast("string")})
    assert spark.range(1).select(filled.alias("s")).first().s == "{x} {b} None"


def test_body_leaves_empty_parts_out(spark):
    row = spark.range(1).select(
        text.assemble_body(F.lit(" Hi "), F.lit("\n"), F.lit(None).cast("string")).alias("a"),
        text.assemble_body(F.lit("Hi"), F.lit("x"), F.lit("Bye ")).alias("b"),
    ).first()
    assert (row.a, row.b) == ("Hi", "Hi\n\nx\n\nBye")


def test_error_classes(spark):
    given = [f"X {t.upper()} y" for t in fv.RETRYABLE_ERROR_TEXTS] + ["bad request", "", None]
    got = column(spark, given, "string", errors.error_class)
    assert got == ["retryable"] * len(fv.RETRYABLE_ERROR_TEXTS) + ["permanent"] * 3


def test_waiting_times(spark):
    assert column(spark, [0, 4, 5, 6, 30, 2000], "int", errors.backoff_minutes) == [1, 16, 32, 60, 60, 60]
    assert column(spark, [0, 1, 2, 3], "int", errors.wait_before_retry) == [2, 4, 8, 16]
    assert column(spark, [0, 1, 4], "int", errors.waited_until) == [0, 2, 30]
    assert math.isclose(sum([2, 4, 8, 16]), 30)
