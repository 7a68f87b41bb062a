"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import vigil
from vigil.session import ensure_checkpoint_dir, stored  # noqa: F401  stored: for the operators

# Functions sent to Python workers travel by value, so the executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(vigil)

#: ASCII white space, the only separators between words (the byte split of Python agrees with it).
BLANK = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share (see ``vigil.session``)."""
    return ensure_checkpoint_dir(spark)


def quoted(name: str) -> str:
    """A column's name as an expression: dots and backticks are part of it."""
    return "`" + name.replace("`", "``") + "`"


def every_column(df: DataFrame) -> list[str]:
    return [quoted(c) for c in df.columns]


def unused(name: str, df: DataFrame) -> str:
    """``name`` for a column to add, with underscores behind it while the table has one of that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(df: DataFrame, value: Column | str) -> int:
    """One number over the whole input: the sum of ``value`` (0 for no rows)."""
    return int(df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).first()["n"])


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix64(x):
    """A bijective 64-bit finaliser (numpy uint64 in and out)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
