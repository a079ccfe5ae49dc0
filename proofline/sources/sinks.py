"""Writers of reviews, runs and what is kept."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append_reviews(reviews: DataFrame, path: str) -> None:
    reviews.write.mode("append").json(path)


def write_reviews(reviews: DataFrame, path: str) -> None:
    reviews.write.mode("overwrite").json(path)


def shared_folder(rows: DataFrame) -> str:
    """The checkpoint folder that the session names.

    Where none is named, local sessions use a temporary one; a cluster's must be
    shared, so there that is an error.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="proofline-"))
    return context.getCheckpointDir()


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet to a fresh folder below the shared folder and read again: what they cost, and what models replied, is fixed."""
    path = f"{shared_folder(rows)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with ``name``: their place, from 0, in ``order`` over the whole table; written as ``kept``.

    Rows are dealt by range of the order; each task numbers its own, and the
    tasks' sizes say where each begins, so no task sees all.
    """
    dealt = kept(rows, name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed, task = kept(dealt, name), F.shiftright(name, 33)  # a task's number stands above its rows' places
    sizes = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("task", before.alias("before"))
    at = placed.withColumn("task", task).join(F.broadcast(begins), "task")
    return at.withColumn(name, F.col("before") + F.col(name) - F.shiftleft("task", 33)).select(*rows.columns, name)


def run_id() -> str:
    """The time, in UTC, as a name."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def write_run(path: str, manifest: DataFrame, name: str | None = None, **parts: DataFrame) -> str:
    """Each part as JSON lines and the one-row manifest under ``path``/``name`` (the time, if nothing is said); returns that folder."""
    folder = f"{path}/{name or run_id()}"
    for part, rows in parts.items():
        rows.write.mode("overwrite").json(f"{folder}/{part}")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return folder


def rounded(rows: DataFrame, digits: int = 4) -> DataFrame:
    """``rows`` with doubles rounded half to even, as reports show them."""
    return rows.withColumns({c: F.bround(c, digits) for c, kind in rows.dtypes if kind == "double"})


def nested(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """``parents`` as JSON documents with their children as a list."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in children.columns if c != key)))).alias(name))
    joined = parents.join(lists, key, "left")
    return joined.select(key, F.to_json(F.struct(*joined.columns)).alias("document"))
