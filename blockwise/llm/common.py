"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blockwise.session import cut, scratch_path  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str = "text") -> Column:
    """The text's UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def numbered(docs: DataFrame, name: str, *columns: Column) -> DataFrame:
    """``columns`` of every row with a row number ``name``, written once: rows
    are told apart whatever they hold (nulls, repeated rows), and every
    reader sees the same numbers."""
    return cut(docs.select(F.monotonically_increasing_id().alias(name), *columns))


def identity(id_col: str, text: str) -> Column:
    """128 bits that tell rows apart by id and text, null unlike any value;
    rows with equal id and text share it."""
    own = F.col(id_col).cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(F.char_length(own).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(own, F.lit("")),
                                  F.coalesce(F.concat(F.lit("t"), F.col(text)), F.lit("n")))))


def hash_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null ids count as remainder 0)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % n, F.lit(0))
