"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.session import new_path

#: Characters that count as white space in the operators' rules.
SPACES = " \t\n\x0b\x0c\r"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh path of the shared scratch folder and read it
    back: later steps read files that survive lost executors instead of
    computing ``df`` again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns of ``df`` (new name = old name), whatever else it holds.

    Columns are found by position: exactly spelled names first, then names that
    differ by case only. Names with dots and other columns that clash don't matter.
    """
    def place(name: str) -> int:
        for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
            found = [i for i, c in enumerate(df.columns) if same(c)]
            if found:
                return found[0]
        raise ValueError(f"no column {name!r}; have {df.columns}")

    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"c{place(old)}").alias(new) for new, old in columns.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, with as many underscores behind it as no column of ``df`` has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> str:
    """The name as a column reference, also if it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
