"""Rules a draft must pass, and the fold over its revisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.text import strip, words_only
from duebook.operators.hot_keys import HotKeys, spread_join
from duebook.schemas import DRAFT_FIELDS

KEY = ["job_id", "invoice_no"]
EMAIL_ADDRESS = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
_DRAFT_TYPE = "struct<" + ",".join(f"{name}:string" for name in DRAFT_FIELDS) + ">"
CHECKED_VALUES = ["client", "invoice_no", "days_overdue", "payment_link"]
#: Stands for the number of a rule where a revision isn't there yet.
_AWAITING = -1


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _filled(template: str, name: str, value: Column) -> Column:
    before, after = template.split("{" + name + "}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after))


def _ruling(status: str, rule: int, feedback: Column | str) -> Column:
    text = F.lit(feedback) if isinstance(feedback, str) else feedback
    return F.struct(F.lit(status).alias("status"), F.lit(rule).alias("rule"), text.alias("feedback"))


def record_fault(draft: Column) -> Column:
    """Name of the first field that makes the draft no valid record; null if it is one."""
    fault = F
    for name in DRAFT_FIELDS:
        fault = fault.when(draft[name].isNull(), F.lit(name))
    return fault.when(~strip(draft["recipient"]).rlike(EMAIL_ADDRESS), F.lit("recipient")).when(
        ~draft["tone"].isin(*fv.DRAFT_TONES), F.lit("tone")
    )


def draft_text(draft: Column) -> Column:
    return F.concat_ws(" ", draft["greeting"], draft["body"], draft["closing"])


def first_missing_value(text: Column, values: Column, strict: bool = False) -> Column:
    """The first of client, number, days and link the text lacks; null if it has them all.

    Plain search finds ``1`` inside ``2026-05-13``; ``strict`` looks for whole words. ``values`` are those of
    ``invoice_marks``, ``text`` is padded alike.
    """
    missing = F
    for k, name in enumerate(CHECKED_VALUES):
        missing = missing.when(~text.contains(values[k]), F.col(name).cast("string"))
    return missing


def invoice_marks(strict: bool = False) -> Column:
    """What the rules ask of an invoice's drafts, as struct(revisions, recipient, tone, subject, values).

    Needs the columns of ``with_subject``; a whole draft is approved if its ``draft_marks`` equal these
    and its text holds all values.
    """
    values = [F.col(name).cast("string") for name in CHECKED_VALUES]
    return F.struct(
        F.greatest(F.lit(1), F.col("max_retries") - F.col("retry_count")).cast("int").alias("revisions"),
        F.lower(strip(F.col("contact_email"))).alias("recipient"),
        strip(F.col("tone")).alias("tone"),
        strip(F.col("expected_subject")).alias("subject"),
        F.array(*[words_only(v) if strict else v for v in values]).alias("values"),
    )


def draft_marks(draft: Column) -> Column:
    """What the rules read of a draft without its invoice, as struct(kind, fault, recipient, tone, subject).

    ``kind`` is empty, invalid or whole; ``fault`` names what makes it invalid.
    """
    fault = record_fault(draft)
    return F.struct(
        F.when(_all([draft[name].isNull() for name in DRAFT_FIELDS]), F.lit("empty"))
        .when(fault.isNotNull(), F.lit("invalid"))
        .otherwise(F.lit("whole"))
        .alias("kind"),
        fault.alias("fault"),
        F.lower(strip(draft["recipient"])).alias("recipient"),
        strip(draft["tone"]).alias("tone"),
        strip(draft["subject"]).alias("subject"),
    )


def searched_text(draft: Column, strict: bool = False) -> Column:
    """The draft's text as ``first_missing_value`` searches it; never null."""
    return words_only(draft_text(draft)) if strict else draft_text(draft)


def _checks(draft: Column, marks: Column, asked: Column, lacking: Column) -> list[tuple[int, Column]]:
    """The rules in the order they are asked, each with the condition that breaks it."""
    return [
        (1, draft.isNull() | (marks["kind"] == "empty")),
        (6, marks["kind"] == "invalid"),
        (2, ~marks["recipient"].eqNullSafe(asked["recipient"])),
        (3, marks["tone"] != asked["tone"]),
        (4, marks["subject"] != asked["subject"]),
        (5, lacking),
    ]


def _feedback(marks: Column, missing: Column) -> dict[int, Column]:
    """What is said of a draft that breaks a rule."""
    return {
        1: F.lit(fv.TEXT_NO_DRAFT),
        6: F.concat(F.lit("Draft record is not valid: "), marks["fault"]),
        2: F.lit(fv.TEXT_WRONG_RECIPIENT),
        3: _filled(fv.TEXT_WRONG_TONE, "tone", F.col("tone")),
        4: _filled(fv.TEXT_WRONG_SUBJECT, "subject", F.col("expected_subject")),
        5: _filled(fv.TEXT_MISSING_VALUE, "value", missing),
    }


def judge(
    draft: Column,
    strict: bool = False,
    marks: Column | None = None,
    asked: Column | None = None,
    text: Column | None = None,
) -> Column:
    """First rule a draft fails, as struct(status, rule, feedback).

    ``status`` is approved, rejected, or invalid for a draft that is no proper record. ``marks`` and ``asked`` are the
    draft's and the invoice's marks and ``text`` its ``searched_text``, where they have been worked out before. With
    marks and text given, the draft is only asked whether it is there.
    """
    marks = draft_marks(draft) if marks is None else marks
    asked = invoice_marks(strict) if asked is None else asked
    text = searched_text(draft, strict) if text is None else text
    missing = first_missing_value(text, asked["values"], strict)
    feedback, ruling = _feedback(marks, missing), F
    for rule, broken in _checks(draft, marks, asked, missing.isNotNull()):
        ruling = ruling.when(broken, _ruling("invalid" if rule == 6 else "rejected", rule, feedback[rule]))
    return ruling.otherwise(_ruling("approved", 0, ""))


def judge_drafts(invoices: DataFrame, drafts: DataFrame, strict: bool = False) -> DataFrame:
    """Judge every revision of every invoice; an invoice without any gets rule 1.

    Needs the columns of ``with_subject``. Drafts are made unique per revision first, so an
    invoice number used many times does not multiply with drafts used many times.

    The text is made searchable once per draft, before the join, and only what the rules read is joined. Written
    into the rules it would be made anew for each value looked for and each column of the ruling.
    """
    one_each = drafts.groupBy(*KEY, "revision").agg(F.min(F.struct(*DRAFT_FIELDS)).alias("_draft"))
    draft = F.col("_draft")
    read = F.struct(draft_marks(draft).alias("_marks"), searched_text(draft, strict).alias("_text"))
    one_each = one_each.select(*KEY, "revision", F.inline(F.array(read)))
    asked = [F.col("tone"), F.col("expected_subject"), *[F.col(name) for name in CHECKED_VALUES if name not in KEY]]
    slim = invoices.select(*KEY, *asked, invoice_marks(strict).alias("_asked"))
    text = F.col("_text")
    ruling = judge(text, strict, F.col("_marks"), F.col("_asked"), text)
    return slim.join(one_each, KEY, "left").select(*KEY, "revision", F.inline(F.array(ruling)))


def drafts_by_invoice(drafts: DataFrame, revisions: int) -> DataFrame:
    """One row per invoice with the array ``_drafts`` of its first revisions, null where one lacks.

    Each has the ``draft`` and its ``marks``, worked out where the drafts are read. The aggregation is partial on
    the map side, so a key with very many rows arrives as one row per task. It also leaves the drafts
    partitioned by the join key.
    """
    draft = F.struct(*DRAFT_FIELDS)
    marked = drafts.filter(F.col("revision") < revisions).select(
        *KEY, "revision", F.struct(draft.alias("draft"), draft_marks(draft).alias("marks")).alias("_one")
    )
    return marked.groupBy(*KEY).agg(
        F.array(*[F.min(F.when(F.col("revision") == k, F.col("_one"))) for k in range(revisions)]).alias("_drafts")
    )


def fold_revisions(
    invoices: DataFrame,
    drafts: DataFrame,
    revisions: int = fv.MAX_REVISIONS,
    strict: bool = False,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Examine each invoice's revisions in order until one settles it.

    Adds ``draft_state`` (approved, invalid, exhausted or awaiting_draft), ``rejections``,
    ``draft_feedback``, ``draft_rule`` and ``draft``, the last one examined. An invoice looks at
    max(1, max_retries - retry_count) revisions; ``revisions`` is the largest such number the plan
    is made for, and a row that needs more stops the job rather than being judged on fewer.

    What the rules read of a draft alone is worked out before the join, what they read of an invoice after it, so
    it isn't shuffled, and so are the texts, once each. The expression applied to the array of drafts is not compiled:
    it only compares, and gives the number of the rule that each breaks. Written out once per revision it
    would make more generated code than the JVM compiles. The words are made for the revision that
    settles the invoice. The result comes out of ``inline``,
    because a later filter on it would otherwise be pushed down as many copies of the rules.
    """
    grouped = drafts_by_invoice(drafts, revisions)
    nothing = F.array_repeat(F.lit(None).cast(grouped.schema["_drafts"].dataType.elementType), revisions)
    joined = spread_join(invoices, grouped, KEY, hot)
    ones = [F.get(F.col("_drafts"), F.lit(k)) for k in range(revisions)]
    texts = [F.when(one["marks"]["kind"] == "whole", searched_text(one["draft"], strict)) for one in ones]
    rows = joined.withColumns(
        {"_asked": invoice_marks(strict), "_texts": F.array(*texts), "_drafts": F.coalesce("_drafts", nothing)}
    )
    asked, rules = F.col("_asked"), F.col("_rules")

    def rule_on(one: Column, place: Column) -> Column:
        text = F.get(F.col("_texts"), place)
        lacking = _any([~text.contains(asked["values"][k]) for k in range(len(CHECKED_VALUES))])
        rule = F.when(one.isNull(), F.lit(_AWAITING))
        for number, broken in _checks(one["draft"], one["marks"], asked, lacking):
            rule = rule.when(broken, F.lit(number))
        return rule.otherwise(F.lit(0))

    limit = asked["revisions"]
    too_many = F.raise_error(
        F.concat(F.lit("fold_revisions needs revisions >= "), limit.cast("string"))
    ).cast("int")
    rows = rows.withColumns(
        {"_rules": F.transform("_drafts", rule_on), "_limit": F.when(limit > revisions, too_many).otherwise(limit)}
    )
    ends = [
        F.when((F.lit(k) < F.col("_limit")) & ~F.get(rules, F.lit(k)).between(1, 5), F.lit(k + 1)) for k in range(revisions)
    ]
    rows = rows.withColumn("_at", F.coalesce(*ends, "_limit"))
    rows = rows.withColumn("_end", F.get(rules, F.col("_at") - 1))
    waiting = F.col("_end") == _AWAITING
    rows = rows.withColumn("_last", F.col("_at") - F.when(waiting, F.lit(2)).otherwise(F.lit(1)))
    last = {"_rule": "_rules", "_one": "_drafts", "_text": "_texts"}
    rows = rows.withColumns({name: F.get(F.col(of), F.col("_last")) for name, of in last.items()})
    one, rule = F.col("_one"), F.col("_rule")
    feedback = F
    for number, said in _feedback(one["marks"], first_missing_value(F.col("_text"), asked["values"], strict)).items():
        feedback = feedback.when(rule == number, said)
    exhausted = F.col("_end").between(1, 5)
    folded = F.struct(
        F.when(waiting, F.lit("awaiting_draft"))
        .when(exhausted, F.lit("exhausted"))
        .when(F.col("_end") == 6, F.lit("invalid"))
        .otherwise(F.lit("approved"))
        .alias("draft_state"),
        F.when(exhausted, F.col("_at")).otherwise(F.col("_at") - 1).alias("rejections"),
        F.coalesce(feedback, F.lit("")).alias("draft_feedback"),
        rule.alias("draft_rule"),
        one["draft"].alias("draft"),
    )
    return rows.select(*invoices.columns, F.inline(F.array(folded)))


def next_step(status: Column, retry_count: Column, max_retries: Column) -> Column:
    """Where a validated draft goes next."""
    return (
        F.when(status == "approved", F.lit("send"))
        .when(retry_count >= max_retries, F.lit("escalate"))
        .otherwise(F.lit("regenerate"))
    )
