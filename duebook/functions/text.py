"""Text expressions: stripping, masking, links, subjects, bodies."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook import fixed_values as fv
from duebook.functions.money import grouped_amount


def strip(text: Column) -> Column:
    """Cut white space, Unicode included, from both ends.

    Only the ends are looked at first, as ``btrim`` goes through the whole text even where there is nothing to cut.
    """
    ends = [F.substring(text, 1, 1), F.substring(text, -1, 1)]
    cut = ends[0].isin(*fv.WHITE_SPACE) | ends[1].isin(*fv.WHITE_SPACE)
    return F.when(cut, F.btrim(text, F.lit(fv.WHITE_SPACE))).otherwise(text)


def is_blank(text: Column) -> Column:
    """Whether a text is null or all white space; looks no further than its first other character."""
    return text.isNull() | (F.ltrim(text, F.lit(fv.WHITE_SPACE)) == "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def mask_email(email: Column) -> Column:
    """Hide the local part behind its first letters; '' where there is no address.

    An empty local part gives ``*@domain``.
    """
    at = F.instr(email, "@")
    hidden = (
        F.when(at == 1, F.lit("*"))
        .when(at <= 3, F.concat(F.left(email, F.lit(1)), F.lit("*")))
        .otherwise(F.concat(F.left(email, F.lit(2)), F.repeat(F.lit("*"), at - 3)))
    )
    return F.when(email.isNull() | (at == 0), F.lit("")).otherwise(
        F.concat(hidden, F.substring(email, at, F.length(email)))
    )


def payment_link(invoice_no: Column, link: Column | None = None) -> Column:
    """The link already present, else the one made from the invoice number."""
    made = F.concat(F.lit(fv.PAYMENT_LINK_BASE), invoice_no)
    return made if link is None else F.coalesce(F.nullif(link, F.lit("")), made)


def subject_line(template: Column, invoice_no: Column, amount: Column, days: Column) -> Column:
    """Fill a subject template held in a column.

    The invoice number is free text, so it goes in last: a placeholder inside it stays as it is.
    """
    filled = F.replace(template, F.lit("{amount}"), grouped_amount(amount, 0))
    filled = F.replace(filled, F.lit("{days_overdue}"), days.cast("string"))
    return F.replace(filled, F.lit("{invoice_no}"), invoice_no)


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Fill a template known when the plan is made, in one concatenation.

    The template is cut at its placeholders first, so text put in is never searched again.
    """
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit(fv.NO_FEEDBACK)))
    return F.concat(*parts) if parts else F.lit("")


def assemble_body(greeting: Column, body: Column, closing: Column) -> Column:
    """Greeting, body and closing with a blank line between; empty ones left out."""
    return F.concat_ws("\n\n", *[blank_to_null(part) for part in (greeting, body, closing)])


def words_only(text: Column) -> Column:
    """Letters and digits, everything else a space, padded for whole-word search."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]", " "), F.lit(" "))


def short_time(ts: Column, length: int = 19) -> Column:
    """A time stamp as text, cut to seconds (19) or minutes (16)."""
    return F.left(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(length))


def job_label(job_id: Column, status: Column, created_at: Column) -> Column:
    return F.concat_ws(
        " · ",
        F.concat(F.lit("#"), job_id.cast("string")),
        F.upper(status),
        short_time(created_at, 16),
    )
