"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words between white space, as Java and Python patterns.
SPACED_WORD = "[^\\x20\\x09-\\x0D]+"


#: A key that more than one row in so many has is a hot one; so there are at most so many of them.
HOT_SHARE = 1000
#: So many narrow rows (an id and a digest) may be broadcast.
BROADCAST_ROWS = 200_000


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder: the one the session names; a temporary one only where none is named and Spark is local."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="proofline-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again, so that its lineage ends there."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a fresh folder within the shared checkpoint folder and read again."""
    path = f"{_shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, to be broadcast if they are at most so many; for narrow rows that are cheap to count."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def left_join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` left-joined with ``right``, which has one row for each of ``keys``; null keys meet nothing.

    Rows with a null key are not shuffled, and neither are those with a hot key,
    of which there are fewer than ``HOT_SHARE``: their rows of ``right`` are broadcast.
    """
    counts = left.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("__n"))
    counts = checkpointed(counts.where("__n > 1"))
    least = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] / HOT_SHARE
    hot = counts.where(F.col("__n") > least).select(*keys, F.lit(True).alias("__hot"))
    marked = left.join(F.broadcast(hot), keys, "left")
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]
    cold = marked.where(known & F.col("__hot").isNull()).join(right, keys, "left").select(*columns)
    few = right.join(F.broadcast(hot.drop("__hot")), keys, "left_semi")
    warm = marked.where(~known | F.col("__hot")).join(F.broadcast(few), keys, "left").select(*columns)
    return cold.unionByName(warm)


def lower_az(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case.

    For pure ASCII ``lower`` does the same and is many times faster.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*(quoted(name).alias(name) for name in df.columns))


def tagged(column: Column) -> Column:
    """A string key that is never null and keeps null apart from every value."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), column.cast("string")))
