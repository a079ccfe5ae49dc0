"""Vectors and replies by the content of what was asked for: a model is asked only what it was not asked before."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .providers import ChatModel, Embedder, complete_column, embed_column
from .sinks import kept

KEY = "content_key"


def content_key(column: str, model: str, options: Sequence[str] = ()) -> Column:
    """The digest of a text with the model and the options that it is given to; null and the empty text differ."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("m"), F.col(column).alias("t"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(options))), {"ignoreNullFields": "false"}), 256)


def _remembered(rows: DataFrame, path: str, key: Column, ask: Callable[[DataFrame], DataFrame], values: Sequence[str], error: str) -> DataFrame:
    """``rows`` with ``values`` and ``error``, from the table at ``path`` or from ``ask``; what went well is added to the table, what failed is asked for again next time.

    Equal contents are asked for once.  Two runs at the same time may both ask
    and both add; one of such rows is read.
    """
    keyed = rows.withColumn(KEY, key)
    try:
        before = rows.sparkSession.read.parquet(path).dropDuplicates([KEY])
    except AnalysisException:  # nothing was asked before
        before = None
    new = keyed.dropDuplicates([KEY])
    if before is not None:
        new = new.join(before.select(KEY), KEY, "left_anti")
    known = kept(ask(new).select(KEY, *values, error), "asked")
    well = known.where(F.col(error).isNull()).drop(error)
    if not well.isEmpty():
        well.write.mode("append").parquet(path)
    if before is not None:
        known = known.unionByName(before.select(KEY, *values, F.lit(None).cast("string").alias(error)))
    return keyed.join(known, KEY, "left").drop(KEY)


def embed_remembered(rows: DataFrame, make: Callable[[], Embedder], path: str, model: str, column: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with ``embedding`` and ``embed_error`` as ``embed_column`` gives them; ``path`` is the table of the vectors of all models."""
    if "embedding" in rows.columns:
        return embed_column(rows, make, column, batch, errors=True)
    return _remembered(rows, path, content_key(column, model), lambda new: embed_column(new, make, column, batch, errors=True), ["embedding"], "embed_error")


def complete_remembered(rows: DataFrame, make: Callable[[], ChatModel], path: str, model: str, column: str = "prompt", options: Sequence[str] = ()) -> DataFrame:
    """``rows`` with what ``complete_column`` adds; ``path`` is the table of the replies of all models.  Rows without a prompt are not asked for."""
    values = ["reply", "prompt_tokens", "completion_tokens", "finish_reason", "latency_ms"]
    ask = lambda new: complete_column(new.where(F.col(column).isNotNull()), make, column, options)
    return _remembered(rows.drop(*values, "error"), path, content_key(column, model, options), ask, values, "error")
