"""Profile of a table: cells, copies, columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import percent


def table_profile(table: DataFrame) -> DataFrame:
    """Rows, columns and empty cells in one pass."""
    empty = reduce(
        lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in table.columns]
    )
    return table.agg(
        F.count("*").alias("rows"),
        F.lit(len(table.columns)).cast("long").alias("columns"),
        empty.alias("empty_cells"),
    )


def duplicate_rows(table: DataFrame) -> DataFrame:
    """Rows that are exact copies of another, the first of each group not counted."""
    groups = table.groupBy(*table.columns).agg(F.count("*").alias("_copies"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def without_duplicates(table: DataFrame) -> DataFrame:
    return table.dropDuplicates()


def _cell_counts(column: str, data_type: str) -> dict[str, Column]:
    """Filled cells of a column and, where it's text, how many a reader would take for other types."""
    value = F.col(column)
    if data_type != "string":
        none = F.lit(0).cast("long")
        return {"filled": F.count(value), "whole": none, "number": none, "yes_no": none}
    return {
        "filled": F.count(value),
        "whole": F.count_if(value.rlike(r"^\s*[+-]?\d+\s*$")),
        "number": F.count_if(F.btrim(value).try_cast("double").isNotNull()),
        "yes_no": F.count_if(value.isin("True", "False", "true", "false", "TRUE", "FALSE")),
    }


def _guessed_type(data_type: Column, rows: Column, filled: Column, whole: Column, number: Column, yes_no: Column) -> Column:
    """What a reader that guesses types would call a column with these counts."""
    complete = rows == filled
    return (
        F.when(data_type != "string", data_type)
        .when(filled == 0, F.lit("float64"))
        .when((whole == filled) & complete, F.lit("int64"))
        .when(number == filled, F.lit("float64"))
        .when((yes_no == filled) & complete, F.lit("bool"))
        .otherwise(F.lit("object"))
    )


def column_profile(table: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, share filled and number of different values.

    Different values are counted exactly by grouping (column, value) pairs, so a value that fills a
    third of the table is one row per task after the first step. ``approximate`` counts them by
    sketch in the same pass as the rest, for tables where even that shuffle is too much.
    """
    types = dict(table.dtypes)
    facts = [
        F.struct(
            F.lit(c).alias("column_name"),
            _guessed_type(F.lit(types[c]), F.count("*"), **_cell_counts(c, types[c])).alias("type"),
            percent(F.count(F.col(c)), F.count("*"), 1).alias("filled_percent"),
            (F.approx_count_distinct(c) if approximate else F.lit(0).cast("long")).alias("unique_values"),
        )
        for c in table.columns
    ]
    profile = table.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))
    if approximate:
        return profile
    pairs = table.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in table.columns
                ]
            )
        )
    ).filter(F.col("value").isNotNull())
    unique = (
        pairs.groupBy("column_name", "value").agg(F.lit(1).alias("_one"))
        .groupBy("column_name").agg(F.count("*").alias("unique_values"))
    )
    return (
        profile.drop("unique_values")
        .join(F.broadcast(unique), "column_name", "left")
        .select(
            "column_name", "type", "filled_percent",
            F.coalesce("unique_values", F.lit(0).cast("long")).alias("unique_values"),
        )
    )


#: A stored profile: a row per group and column; counts add up, sketches unite.
PROFILE = (
    "column_name string, data_type string, rows long, filled long, whole long, number long, yes_no long, values binary"
)


def profile_sketches(table: DataFrame, by: str = "job_id", precision: int = 14) -> DataFrame:
    """Per value of ``by`` and column what a profile needs, in one pass; see ``PROFILE``.

    Different values are kept as a sketch of 2 to the power of ``precision`` registers, with a standard
    error of about 0.8 % at 14, so a row has a few kilobytes whatever it stands for. ``by`` itself is
    profiled too. Empty cells aren't values.
    """
    types = dict(table.dtypes)
    facts = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(types[c]).alias("data_type"),
            F.count("*").alias("rows"),
            *(count.alias(name) for name, count in _cell_counts(c, types[c]).items()),
            F.hll_sketch_agg(F.col(c).cast("string"), precision).alias("values"),
        )
        for c in table.columns
    ]
    return table.groupBy(by).agg(F.array(*facts).alias("facts")).select(by, F.inline("facts"))


def profile_from_sketches(sketches: DataFrame) -> DataFrame:
    """The column profile of all groups together, as ``column_profile`` gives it, ``unique_values`` estimated.

    Reads the stored sketches only. A column that the groups hold with different types counts as text.
    """
    counts = ["rows", "filled", "whole", "number", "yes_no"]
    whole = sketches.groupBy("column_name").agg(
        F.when(F.min("data_type") == F.max("data_type"), F.min("data_type")).otherwise(F.lit("string")).alias("data_type"),
        *(F.sum(c).alias(c) for c in counts),
        F.hll_sketch_estimate(F.hll_union_agg("values", True)).alias("unique_values"),
    )
    return whole.select(
        "column_name",
        _guessed_type(F.col("data_type"), *(F.col(c) for c in counts)).alias("type"),
        percent(F.col("filled"), F.col("rows"), 1).alias("filled_percent"),
        "unique_values",
    )
