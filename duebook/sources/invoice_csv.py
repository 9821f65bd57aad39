"""Invoice files: one file, a folder of like files, or a folder of mixed column orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duebook import fixed_values as fv


def missing_columns(columns: list[str]) -> list[str]:
    return sorted(set(fv.REQUIRED_COLUMNS) - set(columns))


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = _hadoop_path(spark, path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def header_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _null_tokens(df: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    if not tokens:
        return df
    return df.select(
        *[F.when(~F.col(c).isin(*tokens), F.col(c)).alias(c) for c in df.columns]
    )


def read_invoice_csv(
    spark: SparkSession,
    path: str | None,
    multi_line: bool = False,
    null_tokens: tuple[str, ...] = (),
    with_file: bool = False,
) -> DataFrame:
    """Read one invoice file, or a folder of files with the same header, as text columns.

    Columns are taken by name, extra ones are kept. Files whose header differs from the first
    one's are an error; ``read_mixed_csv`` reads those. ``multi_line`` allows line ends inside
    quotes, at the price that a file is no longer split. ``null_tokens`` lists words to read as
    missing, such as ``NA``; by default only empty cells are.
    """
    if not path:
        raise ValueError("an invoice file path is required")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no such invoice file: {path}")
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(".csv"):
        raise ValueError("an invoice file must end in .csv")
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    columns = reader.csv(path).columns
    lacking = missing_columns(columns)
    if columns and lacking:
        raise ValueError(f"Missing required columns: {', '.join(lacking)}")
    rows = reader.option("enforceSchema", False).schema(header_schema(columns)).csv(path)
    if not columns or rows.isEmpty():
        raise ValueError("the invoice file has no rows")
    if with_file:
        files = F.col("_metadata.file_path").alias("file_path")
        return _null_tokens(rows.select("*", files), null_tokens)
    return _null_tokens(rows, null_tokens)


def _header_width(spark: SparkSession, path: str | list[str]) -> int:
    """Cells of the widest line that holds all required names; 0 if there is none."""
    lines = spark.read.text(path)
    for name in fv.REQUIRED_COLUMNS:
        lines = lines.filter(F.col("value").contains(name))
    commas = F.length("value") - F.length(F.replace(F.col("value"), F.lit(","), F.lit("")))
    return lines.agg(F.coalesce(F.max(commas + 1), F.lit(0))).first()[0]


def _cell_rows(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all files as arrays of cells, the header of each file that has one)."""
    cells = [f"_c{i}" for i in range(max(_header_width(spark, path), len(fv.REQUIRED_COLUMNS)))]
    rows = (
        spark.read.schema(header_schema(cells)).option("escape", '"').csv(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.array(*[F.trim(F.col(c)) for c in cells]).alias("cells"),
        )
    )
    required = F.array(*[F.lit(c) for c in fv.REQUIRED_COLUMNS])
    is_header = F.size(F.array_intersect("cells", required)) == len(fv.REQUIRED_COLUMNS)
    headers = rows.filter(is_header).groupBy("file_path").agg(F.min("cells").alias("names"))
    return rows.filter(~is_header), headers


def headless_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder without a row that holds all required names: they give no invoices."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), "length")
    return files.join(_cell_rows(spark, path)[1], "file_path", "left_anti")


def read_mixed_csv(
    spark: SparkSession, path: str | list[str], null_tokens: tuple[str, ...] = ()
) -> DataFrame:
    """Read a folder, or a list, of invoice files that each have their own column order.

    Each file's header is the row holding all required names; its cells say which column is
    which. The headers, one row per file, are joined back on the file. Rows are read as wide as
    the widest header. Files without a header are listed by ``headless_files``.
    """
    rows, headers = _cell_rows(spark, path)
    found = rows.join(headers, "file_path")

    def cell(name: str):
        value = F.element_at("cells", F.array_position("names", name).cast("int"))
        return F.when(~value.isin(*null_tokens), value) if null_tokens else value

    return found.select("file_path", *[cell(name).alias(name) for name in fv.REQUIRED_COLUMNS])


def with_job_ids(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """Give rows read with their file the job of that file (``uploads``: file_path, job_id)."""
    return rows.join(uploads.select("file_path", "job_id"), "file_path")
