"""Typed table reads and writes (Parquet first, CSV for exchange)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..session import new_path


#: Quotes in quoted CSV fields are doubled, as RFC 4180 has it.
CSV_QUOTES = {"quote": '"', "escape": '"'}


def read_jobs_csv(spark: SparkSession, path: str, schema: StructType | str,
                  header: bool = True, multi_line: bool = False) -> DataFrame:
    """CSV with an explicit schema (no type guessing); the header line, if
    any, is skipped and its names replaced by the schema's.

    Quotes inside a quoted field are doubled; ``multi_line`` reads fields that
    hold line ends, at the price of one task per file. A line that doesn't fit the
    schema has its text in ``_corrupt_record`` and NULL where a value is bad;
    :func:`csv_rejects` lists these, :func:`csv_rows` the others.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    first = schema.fields[0].name
    schema = StructType(list(schema.fields)).add("_corrupt_record", "string")
    # the reader wants another column read next to the line's text
    line = F.concat("_corrupt_record", F.substring(F.coalesce(F.col(first).cast("string"), F.lit("")), 1, 0))
    return (spark.read.schema(schema).options(header=header, mode="PERMISSIVE", multiLine=multi_line, **CSV_QUOTES)
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path).withColumn("_corrupt_record", line))


def csv_lines(text: DataFrame, schema: StructType | str, line_col: str = "value") -> DataFrame:
    """CSV lines of a text column, read like :func:`read_jobs_csv` reads files."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = StructType(list(schema.fields)).add("_corrupt_record", "string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", **CSV_QUOTES}
    return text.select(F.from_csv(F.col(line_col), whole.simpleString()[7:-1].replace(":", " "), options)
                       .alias("c")).select("c.*")


def csv_rows(read: DataFrame) -> DataFrame:
    """The rows that fit the schema."""
    return read.where("_corrupt_record IS NULL").drop("_corrupt_record")


def csv_rejects(read: DataFrame) -> DataFrame:
    """line: the text of the rows that don't fit the schema."""
    return read.where("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("line"))


def csv_ready(df: DataFrame) -> DataFrame:
    """Array columns as JSON text so the table can be written as CSV."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, ArrayType)
                       else F.col(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: list[str] | None = None, sort_within: list[str] | None = None) -> str:
    """Create / replace / append a table at ``path``.

    ``sort_within`` orders rows inside each file (e.g. by event time) so
    that Parquet min/max statistics prune row groups on range filters.
    """
    if fmt == "csv":
        df = csv_ready(df)
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.options(header=True, **CSV_QUOTES)
    w.format(fmt).save(path)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """A table that ``write_table`` wrote. CSV has a header line and doubled quotes; without
    ``schema`` its columns are text, and with one, lines that don't fit are left to ``read_jobs_csv``."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, **CSV_QUOTES)
    return reader.format(fmt).load(path)


def compute(df: DataFrame, name: str) -> DataFrame:
    """Materialise a query as a table in the shared scratch folder and read
    it back (a new path every time: a plan never overwrites its own input)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
